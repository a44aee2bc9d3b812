"""Projection, filter, search, paging, computed columns, replace, dedupe and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions.values import as_text, is_numeric, round_half_away
from ledgerlab.plans.expressions import MAX_COMPUTED, expression_column
from ledgerlab.plans.filters import column_of, filter_column, search_column

MAX_PAGE = 1000
MAX_RULES = 20
TOP_VALUES = 10
ROUND_PLACES = 6
_DOUBLE = T.DoubleType()


def where(df: DataFrame, tree: dict | None = None, search: str | None = None) -> DataFrame:
    """Rows that satisfy the filter tree and hold the search term in any column."""
    for condition in (filter_column(df, tree), search_column(df, search)):
        if condition is not None:
            df = df.filter(condition)
    return df


def select_columns(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """The named columns, all when none is named."""
    return df.select([column_of(df, n) for n in names]) if names else df


def _direction(column: Column, direction: str) -> Column:
    if direction not in ("asc", "desc"):
        raise InvalidSpec(f"unknown direction: {direction!r}")
    return column.asc_nulls_last() if direction == "asc" else column.desc_nulls_last()


def order_by(df: DataFrame, sort: list[tuple[str, str]]) -> DataFrame:
    """Sort by (column, 'asc'|'desc') pairs over the result's columns, NULLs last both ways."""
    return df.orderBy([_direction(column_of(df, name), way) for name, way in sort]) if sort else df


def page(df: DataFrame, limit: int = 100, offset: int = 0, sort: list[tuple[str, str]] | None = None) -> DataFrame:
    """One page. With `sort`, the other columns break ties, so pages do not overlap."""
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise InvalidSpec(f"limit must be 1..{MAX_PAGE} and offset >= 0")
    if sort:
        rest = [(name, "asc") for name in df.columns if name not in {s[0] for s in sort}]
        df = order_by(df, list(sort) + rest)
    return df.offset(offset).limit(limit)


def page_after(df: DataFrame, sort: list[tuple[str, str]], last: dict | None, limit: int = 100) -> DataFrame:
    """The page that follows the row `last` (column -> value of every column) in the order of `page`.

    A filter takes the place of the offset, so a deep page costs what the first one does.
    """
    ways = dict(sort) | {name: "asc" for name in df.columns if name not in dict(sort)}
    if last is not None:
        beyond, equal = F.lit(False), F.lit(True)
        for name, way in ways.items():
            column, value = column_of(df, name), F.lit(last[name])
            if last[name] is not None:  # NULLs come last both ways
                after = column > value if way == "asc" else column < value
                beyond = beyond | (equal & F.coalesce(after | column.isNull(), F.lit(True)))
            equal = equal & column.eqNullSafe(value)
        df = df.filter(beyond)
    return page(df, limit, 0, list(ways.items()))


def count_matches(df: DataFrame, tree: dict | None = None, search: str | None = None) -> DataFrame:
    """One row `total`."""
    return where(df, tree, search).agg(F.count(F.lit(1)).alias("total"))


def distinct_values(df: DataFrame, column: str, search: str | None = None, limit: int | None = None) -> DataFrame:
    """Sorted distinct non-null values; with a `limit`, one more than it so that a cut can be told.

    The search keeps `%` and `_` as wildcards.
    """
    value = column_of(df, column)
    hits = df.filter(value.isNotNull())
    if search:
        hits = hits.filter(as_text(value, df.schema[column].dataType).ilike(f"%{search}%"))
    found = hits.select(value.alias("value")).distinct().orderBy("value")
    return found if limit is None else found.limit(limit + 1)


def distinct_list(df: DataFrame, column: str, search: str | None = None, limit: int = 500) -> tuple[list, bool]:
    """(values, truncated); at most `limit + 1` values reach the driver."""
    values = [row.value for row in distinct_values(df, column, search, limit).collect()]
    return values[:limit], len(values) > limit


def with_computed(df: DataFrame, columns: list[tuple[str, dict]]) -> DataFrame:
    """Append computed columns; each expression sees the source columns only."""
    if len(columns) > MAX_COMPUTED:
        raise InvalidSpec(f"more than {MAX_COMPUTED} computed columns")
    added: dict[str, Column] = {}
    for name, tree in columns:
        alias = name.strip()
        if not alias or alias in df.columns or alias in added:
            raise InvalidSpec(f"computed column name empty or taken: {alias!r}")
        added[alias] = expression_column(df, tree)
    return df.select("*", *[c.alias(a) for a, c in added.items()])


def replace_values(df: DataFrame, rules: list[dict]) -> DataFrame:
    """Find and replace. A rule is `{column, mode: exact|contains, search, replace, case_sensitive}`.

    Exact rules look at the original value, first hit wins; contains rules run after, in order.
    Columns with rules become text.
    """
    if not 1 <= len(rules) <= MAX_RULES:
        raise InvalidSpec(f"give 1..{MAX_RULES} rules")
    by_column: dict[str, list[dict]] = {}
    for rule in rules:
        column_of(df, rule["column"])
        if rule.get("mode", "exact") not in ("exact", "contains") or not rule.get("search"):
            raise InvalidSpec(f"bad replacement rule: {rule!r}")
        by_column.setdefault(rule["column"], []).append(rule)
    return df.select([
        _replaced(as_text(column_of(df, f.name), f.dataType), by_column[f.name]).alias(f.name)
        if f.name in by_column else column_of(df, f.name)
        for f in df.schema
    ])


def _replaced(text: Column, rules: list[dict]) -> Column:
    chain = None
    for rule in (r for r in rules if r.get("mode", "exact") == "exact"):
        search = F.lit(rule["search"])
        hit = text == search if rule.get("case_sensitive", True) else F.lower(text) == F.lower(search)
        replacement = F.lit(rule.get("replace", ""))
        chain = F.when(hit, replacement) if chain is None else chain.when(hit, replacement)
    out = text if chain is None else chain.otherwise(text)
    for rule in (r for r in rules if r.get("mode", "exact") == "contains"):
        out = F.replace(out, F.lit(rule["search"]), F.lit(rule.get("replace", "")))
    return out


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Distinct rows; equal rows collapse before the shuffle."""
    return df.distinct()


def drop_duplicate_keys(df: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """First row per key in `order`; by default the remaining columns, so the choice is stable.

    A rank of one is limited per task before the shuffle, so a hot key sends one row per task.
    """
    by = [column_of(df, k) for k in keys]
    ties = order or [column_of(df, n).asc_nulls_last() for n in df.columns if n not in keys] or by
    rank = F.row_number().over(Window.partitionBy(by).orderBy(ties))
    return df.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def dedupe_counts(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Rows before and after the dedupe; NULL keys count as equal, and no rows give zeros."""
    names = keys or df.columns
    per_key = df.groupBy([column_of(df, n).alias(f"_k{i}") for i, n in enumerate(names)]).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("antes"), F.count(F.lit(1)).alias("despues"))


def column_stats(df: DataFrame, column: str) -> DataFrame:
    """total, non_null, nulls, distinct, minimum, maximum; sum and average of numeric columns."""
    value, dtype = column_of(df, column), df.schema[column].dataType
    aggregates = [
        F.count(F.lit(1)).alias("total"),
        F.count(value).alias("non_null"),
        (F.count(F.lit(1)) - F.count(value)).alias("nulls"),
        F.count_distinct(value).alias("distinct_count"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    ]
    if is_numeric(dtype):
        aggregates += [
            round_half_away(F.sum(value), dtype, ROUND_PLACES).alias("total_sum"),
            round_half_away(F.avg(value.cast("double")), _DOUBLE, ROUND_PLACES).alias("average"),
        ]
    return df.agg(*aggregates)


def top_values(df: DataFrame, column: str, limit: int = TOP_VALUES) -> DataFrame:
    """Most frequent non-null values, then text order."""
    value = column_of(df, column)
    text = as_text(F.col("_v"), df.schema[column].dataType)
    counts = df.filter(value.isNotNull()).groupBy(value.alias("_v")).agg(F.count(F.lit(1)).alias("freq"))
    return counts.select(text.alias("value"), "freq").orderBy(F.desc("freq"), "value").limit(limit)


def schema_of(df: DataFrame) -> list[dict]:
    """Names and types, as stored with a dataset."""
    return [{"name": f.name, "type": f.dataType.simpleString()} for f in df.schema]
