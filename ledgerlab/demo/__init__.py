"""Ledgers and documents derived from star-schema tables, for queries and benchmarks."""
