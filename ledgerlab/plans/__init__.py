"""Declarative filter, expression and pivot trees turned into Spark columns."""
