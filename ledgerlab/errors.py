"""Errors raised before any Spark job starts."""


class InvalidSpec(ValueError):
    """A filter, expression, pivot or mapping breaks its closed vocabulary or limits."""


class EmptyDataset(ValueError):
    """An ingest or a derived dataset would hold no rows."""


class ExportTooLarge(ValueError):
    """A download would pass the row bound of its format."""
