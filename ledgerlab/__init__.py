"""PySpark-native table analysis, ledger reconciliation and document-field extraction."""
