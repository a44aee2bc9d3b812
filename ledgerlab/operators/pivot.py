"""Pivot tables: conditional aggregates over one shuffle, never one pass per output column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions.values import as_text, round_half_away
from ledgerlab.operators.tables import ROUND_PLACES, distinct_list, where
from ledgerlab.plans.filters import column_of
from ledgerlab.plans.pivots import MAX_CROSSTAB, NUMERIC_ONLY, ZERO_WHEN_EMPTY, Measure, PivotSpec

_AGGREGATE = {
    "count": F.count, "count_distinct": F.count_distinct,
    "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
}


def _aggregate(df: DataFrame, measure: Measure, condition: Column | None = None) -> Column:
    value = column_of(df, measure.column) if measure.column else F.lit(1)
    if measure.aggregation == "avg":
        value = value.cast("double")
    return _AGGREGATE[measure.aggregation](value if condition is None else F.when(condition, value))


def _shown(df: DataFrame, measure: Measure, aggregate: Column) -> Column:
    if measure.aggregation not in NUMERIC_ONLY:
        return aggregate
    dtype = T.DoubleType() if measure.aggregation == "avg" else df.schema[measure.column].dataType
    return round_half_away(aggregate, dtype, ROUND_PLACES)


def _percent(part: Column, whole: Column) -> Column:
    ratio = F.lit(100.0) * part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return round_half_away(ratio, T.DoubleType(), 2)


def crosstab_values(df: DataFrame, spec: PivotSpec) -> list | None:
    """Distinct values of the cross-tab column over the unfiltered data; more than 50 is an error."""
    if spec.pivot_column is None:
        return None
    values, more = distinct_list(df, spec.pivot_column, limit=MAX_CROSSTAB)
    if more:
        raise InvalidSpec(f"the cross-tab would make more than {MAX_CROSSTAB} columns")
    return values


def _cells(df: DataFrame, spec: PivotSpec, values: list | None) -> list[tuple[str, Measure, Column | None]]:
    """(output name, measure, condition) of every output column."""
    if values is None:
        return [(m.alias, m, None) for m in spec.measures]
    by = column_of(df, spec.pivot_column)
    cells = [(spec.label(m, v), m, by == F.lit(v)) for v in values for m in spec.measures]
    cells += [(spec.label(m), m, None) for m in spec.measures]
    names = [name.lower() for name in [*spec.group_by, *(name for name, _, _ in cells)]]
    if len(names) > len(set(names)):
        raise InvalidSpec("a value of the cross-tab is named like another column; use pivot_long")
    return cells


def _grand(rows: DataFrame, spec: PivotSpec) -> DataFrame:
    return rows.agg(F.struct(*[_aggregate(rows, m).alias(f"m{i}") for i, m in enumerate(spec.measures)]).alias("g"))


def pivot(df: DataFrame, spec: PivotSpec, values: list | None = None) -> DataFrame:
    """The pivot as an ordered DataFrame. `values` are the cross-tab values when already known."""
    spec.check(df)
    if values is None:
        values = crosstab_values(df, spec)
    rows = where(df, spec.filter)
    cells = _cells(rows, spec, values)
    grouped = _grouped(rows, spec, cells, spec.group_by, percent=False)
    outputs = [F.col(f"_c{i}") for i in range(len(cells))]
    if spec.percent_of_total:
        # The grand totals are one row: a scalar subquery, no window over all groups in one task.
        grand = _grand(rows, spec).scalar()
        outputs = [
            _zero(values, m, c, _percent(o, grand.getField(f"m{spec.measures.index(m)}")))
            for o, (_, m, c) in zip(outputs, cells)
        ]
    named = [o.alias(name) for o, (name, _, _) in zip(outputs, cells)]
    return _ordered(grouped.select(*[column_of(grouped, n) for n in spec.group_by], *named), spec)


def _grouped(rows: DataFrame, spec: PivotSpec, cells: list, groups: list[str], percent: bool) -> DataFrame:
    """The groups with every cell as `_c0`, `_c1`, ...; without groups one row.

    Several distinct counts would make Spark expand every row once for each of them. Instead a counted column is made
    distinct within the groups first, each of its values with a flag for every cell it is counted in: two aggregations
    of partial results, and as many rows as there are values.
    """
    distinct = [i for i, (_, m, _) in enumerate(cells) if m.aggregation == "count_distinct"]
    if len(distinct) <= 1:
        return rows.groupBy([column_of(rows, n) for n in groups]).agg(
            *[_cell(rows, spec, m, c, percent).alias(f"_c{i}") for i, (_, m, c) in enumerate(cells)])
    keys = [column_of(rows, n).alias(f"_g{k}") for k, n in enumerate(groups)]
    plain = [_cell(rows, spec, m, c, percent).alias(f"_c{i}") for i, (_, m, c) in enumerate(cells) if i not in distinct]
    out = rows.groupBy(keys).agg(*(plain or [F.count(F.lit(1)).alias("_n")]))
    for name in dict.fromkeys(cells[i][1].column for i in distinct):
        mine = [i for i in distinct if cells[i][1].column == name]
        value = column_of(rows, name)
        flags = [F.lit(True) if cells[i][2] is None else cells[i][2] for i in mine]
        values = rows.filter(value.isNotNull()).groupBy(*keys, value.alias("_v")).agg(
            *[F.bool_or(flag).alias(f"_f{i}") for i, flag in zip(mine, flags)])
        counts = values.groupBy([F.col(f"_g{k}").alias(f"_h{k}") for k in range(len(groups))]).agg(
            *[F.count_if(F.col(f"_f{i}")).alias(f"_c{i}") for i in mine])
        same = reduce(lambda a, b: a & b, [F.col(f"_g{k}").eqNullSafe(F.col(f"_h{k}")) for k in range(len(groups))], F.lit(True))
        out = out.join(counts, same, "left").drop(*[f"_h{k}" for k in range(len(groups))])
    out = out.na.fill(0, [f"_c{i}" for i in distinct])
    return out.select(*[F.col(f"_g{k}").alias(n) for k, n in enumerate(groups)], *[f"_c{i}" for i in range(len(cells))])


def pivot_long(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """The cross-tab as rows (groups, `valor`, measures): any number of values, any names, one aggregation.

    Values are the text of the cross-tab column, NULL included.
    """
    spec.check(df)
    if spec.pivot_column is None:
        raise InvalidSpec("give a cross-tab column")
    rows = where(df, spec.filter)
    value = as_text(column_of(rows, spec.pivot_column), rows.schema[spec.pivot_column].dataType).alias("valor")
    shown = [_shown(rows, m, _aggregate(rows, m)).alias(m.alias) for m in spec.measures]
    return rows.groupBy(*[column_of(rows, n) for n in spec.group_by], value).agg(*shown)


def _zero(values: list | None, measure: Measure, condition: Column | None, cell: Column) -> Column:
    if condition is not None and measure.aggregation in ZERO_WHEN_EMPTY:
        return F.coalesce(cell, F.lit(0))
    return cell


def _cell(rows: DataFrame, spec: PivotSpec, measure: Measure, condition: Column | None, percent: bool) -> Column:
    aggregate = _aggregate(rows, measure, condition)
    if spec.percent_of_total:
        return _percent(aggregate, _aggregate(rows, measure)) if percent else aggregate
    return _zero(None, measure, condition, _shown(rows, measure, aggregate))


def _ordered(out: DataFrame, spec: PivotSpec) -> DataFrame:
    groups = [column_of(out, n).asc_nulls_last() for n in spec.group_by]
    if spec.sort_column is not None:
        key = spec.sort_column
    elif spec.sort_measure is not None:
        measure = spec.measures[spec.sort_measure]
        key = measure.alias if spec.pivot_column is None else spec.label(measure)
    else:
        return out.orderBy(groups)
    first = column_of(out, key)
    return out.orderBy([first.desc_nulls_last() if spec.direction == "desc" else first.asc_nulls_last(), *groups])


def pivot_totals(df: DataFrame, spec: PivotSpec, values: list | None = None) -> DataFrame:
    """The grand-total row, with the pivot's own column names."""
    spec.check(df)
    if values is None:
        values = crosstab_values(df, spec)
    rows = where(df, spec.filter)
    cells = _cells(rows, spec, values)
    row = _grouped(rows, spec, cells, [], percent=True)
    return row.select(*[_zero(values, m, c, F.col(f"_c{i}")).alias(name) for i, (name, m, c) in enumerate(cells)])


def pivot_count(df: DataFrame, spec: PivotSpec) -> DataFrame:
    """How many groups the pivot has (for paging)."""
    spec.check(df)
    rows = where(df, spec.filter)
    groups = rows.select([column_of(rows, n) for n in spec.group_by]).distinct()
    return groups.agg(F.count(F.lit(1)).alias("grupos"))
