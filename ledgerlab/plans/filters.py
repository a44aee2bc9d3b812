"""Filter tree -> Column.

A tree is plain data: a condition is `{"type": "condition", "column", "operator", "value"}`
and a group is `{"type": "group", "combinator": "and"|"or", "children": [...]}`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions.values import as_text, literal_for

MAX_DEPTH = 6
MAX_NODES = 200


def column_of(df: DataFrame, name: str) -> Column:
    """A column of `df` by exact name; anything else is an error."""
    if name not in df.columns:
        raise InvalidSpec(f"unknown column: {name!r}")
    return F.col("`" + name.replace("`", "``") + "`")


def _scalar(node: dict):
    value = node.get("value")
    if value is None or isinstance(value, list):
        raise InvalidSpec(f"operator {node['operator']!r} needs one value")
    return value


def _values(node: dict) -> list:
    value = node.get("value")
    if not isinstance(value, list):
        raise InvalidSpec(f"operator {node['operator']!r} needs a list of values")
    return value


_COMPARE = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
}
_TEXT = {
    "contains": lambda c, v: c.contains(v),
    "not_contains": lambda c, v: ~c.contains(v),
    "starts_with": lambda c, v: c.startswith(v),
    "ends_with": lambda c, v: c.endswith(v),
}


def _condition(df: DataFrame, node: dict) -> Column:
    operator = node.get("operator")
    column = column_of(df, node.get("column"))
    dtype = df.schema[node["column"]].dataType
    if operator in _COMPARE:
        return _COMPARE[operator](column, literal_for(_scalar(node), dtype))
    if operator in _TEXT:
        return _TEXT[operator](as_text(column, dtype), F.lit(str(_scalar(node))))
    if operator == "is_null":
        return column.isNull()
    if operator == "is_not_null":
        return column.isNotNull()
    if operator in ("in", "not_in"):
        values = [literal_for(v, dtype) for v in _values(node)]
        if not values:
            return F.lit(operator == "not_in")
        return column.isin(values) if operator == "in" else ~column.isin(values)
    if operator == "between":
        values = _values(node)
        if len(values) != 2:
            raise InvalidSpec("between needs exactly two values")
        low, high = (literal_for(v, dtype) for v in values)
        return column.between(low, high)
    raise InvalidSpec(f"unknown operator: {operator!r}")


def _check_size(root: dict) -> None:
    level, depth, nodes = [root], 0, 0
    while level:
        depth, nodes = depth + 1, nodes + len(level)
        level = [child for node in level for child in node.get("children") or []]
    if depth > MAX_DEPTH:
        raise InvalidSpec(f"filter nested deeper than {MAX_DEPTH}")
    if nodes > MAX_NODES:
        raise InvalidSpec(f"filter has more than {MAX_NODES} nodes")


def _build(df: DataFrame, node: dict) -> Column | None:
    if node.get("type", "group" if "children" in node else "condition") == "condition":
        return _condition(df, node)
    combinator = node.get("combinator", "and")
    if combinator not in ("and", "or"):
        raise InvalidSpec(f"unknown combinator: {combinator!r}")
    parts = [c for c in (_build(df, child) for child in node.get("children") or []) if c is not None]
    if not parts:
        return None
    return reduce((lambda a, b: a & b) if combinator == "and" else (lambda a, b: a | b), parts)


def filter_column(df: DataFrame, tree: dict | None) -> Column | None:
    """The condition of a tree over `df`, or None when it holds no condition."""
    if not tree:
        return None
    _check_size(tree)
    return _build(df, tree)


def search_column(df: DataFrame, term: str | None) -> Column | None:
    """Case-insensitive literal substring in any column; None for a blank term."""
    term = (term or "").strip()
    if not term or not df.columns:
        return None
    escaped = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    hits = [as_text(column_of(df, f.name), f.dataType).ilike(f"%{escaped}%") for f in df.schema]
    return reduce(lambda a, b: a | b, hits)
