"""Pivot specification: groups, measures, optional cross-tab, order and percentages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions.values import is_numeric
from ledgerlab.plans.filters import column_of

MAX_GROUPS, MAX_MEASURES, MAX_CROSSTAB = 6, 10, 50

# Output names of the measures and of the row total.
PREFIX = {
    "count": "conteo", "count_distinct": "unicos", "sum": "suma",
    "avg": "promedio", "min": "minimo", "max": "maximo",
}
ROW_TOTAL = "Total"
SEPARATOR = " · "

NUMERIC_ONLY = {"sum", "avg"}
ZERO_WHEN_EMPTY = {"sum", "count", "count_distinct"}
ADDITIVE = {"sum", "count"}


@dataclass(frozen=True)
class Measure:
    aggregation: str
    column: str | None = None

    @property
    def alias(self) -> str:
        return PREFIX[self.aggregation] + (f"_{self.column}" if self.column else "")


@dataclass(frozen=True)
class PivotSpec:
    group_by: list[str]
    measures: list[Measure]
    pivot_column: str | None = None
    filter: dict | None = None
    sort_column: str | None = None
    sort_measure: int | None = None
    direction: str = "desc"
    percent_of_total: bool = False

    @classmethod
    def from_dict(cls, data: dict) -> "PivotSpec":
        """Build from the JSON shape `{filter, group_by, measures, pivot_column, sort, percent_of_total}`."""
        sort = data.get("sort") or {}
        return cls(
            group_by=list(data["group_by"]),
            measures=[Measure(m["aggregation"], m.get("column")) for m in data["measures"]],
            pivot_column=data.get("pivot_column"),
            filter=data.get("filter"),
            sort_column=sort.get("column"),
            sort_measure=sort.get("measure_index"),
            direction=sort.get("direction", "desc"),
            percent_of_total=bool(data.get("percent_of_total")),
        )

    def label(self, measure: Measure, value=None) -> str:
        """Output column of a cross-tab value, or of the row total when no value is given."""
        head = ROW_TOTAL if value is None else str(value)
        return head if len(self.measures) == 1 else head + SEPARATOR + measure.alias

    def check(self, df: DataFrame) -> None:
        """Reject a specification that breaks the closed vocabulary or its limits."""
        if not 1 <= len(self.group_by) <= MAX_GROUPS:
            raise InvalidSpec(f"give 1..{MAX_GROUPS} group columns")
        if not 1 <= len(self.measures) <= MAX_MEASURES:
            raise InvalidSpec(f"give 1..{MAX_MEASURES} measures")
        for name in [*self.group_by, *([self.pivot_column] if self.pivot_column else [])]:
            column_of(df, name)
        if self.pivot_column in self.group_by:
            raise InvalidSpec("the cross-tab column cannot be a group column")
        for measure in self.measures:
            self._check_measure(df, measure)
        if self.sort_column is not None and self.sort_column not in self.group_by:
            raise InvalidSpec("sort by a group column or a measure")
        if self.sort_measure is not None and not 0 <= self.sort_measure < len(self.measures):
            raise InvalidSpec("the measure to sort by does not exist")
        if self.direction not in ("asc", "desc"):
            raise InvalidSpec(f"unknown direction: {self.direction!r}")

    def _check_measure(self, df: DataFrame, measure: Measure) -> None:
        if measure.aggregation not in PREFIX:
            raise InvalidSpec(f"unknown aggregation: {measure.aggregation!r}")
        if measure.column is None and measure.aggregation != "count":
            raise InvalidSpec(f"{measure.aggregation} needs a column")
        if measure.column is not None:
            column_of(df, measure.column)
            if measure.aggregation in NUMERIC_ONLY and not is_numeric(df.schema[measure.column].dataType):
                raise InvalidSpec(f"{measure.aggregation} needs a numeric column, {measure.column!r} is not")
        if self.percent_of_total and measure.aggregation not in ADDITIVE:
            raise InvalidSpec("percent of total applies to sum and count only")
