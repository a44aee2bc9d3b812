"""Column -> Column helpers built only from Spark expressions."""
