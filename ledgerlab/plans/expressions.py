"""Expression tree -> Column, for computed columns.

Nodes are plain data: `{"kind": "column", "name"}`, `{"kind": "literal", "value"}` and
`{"kind": "function", "fn", "args"}`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.errors import InvalidSpec
from ledgerlab.functions.values import MOMENTS, as_text, round_half_away, type_of
from ledgerlab.plans.filters import column_of

MAX_DEPTH = 8
MAX_NODES = 100
MAX_COMPUTED = 20


def _text(df: DataFrame, arg: Column) -> Column:
    return as_text(arg, type_of(df, arg))


def _date(df: DataFrame, arg: Column) -> Column:
    """Safe date: text must look like y-m-d, other junk gives NULL."""
    if isinstance(type_of(df, arg), MOMENTS):
        return arg.cast("date")
    text = arg.cast("string")
    return F.when(text.rlike(r"^\s*\d+-\d+-\d+"), text.try_cast("date"))


def _substr(text: Column, start: Column, length: Column | None = None) -> Column:
    # Position 0 is the slot before the first character: it takes one character of the length.
    if length is None:
        return F.substring(text, F.when(start == 0, 1).otherwise(start), F.length(text))
    return F.when(start == 0, F.substring(text, F.lit(1), length - 1)).otherwise(F.substring(text, start, length))


def _literal_int(arg: Column | None, raw: dict | None) -> int:
    if arg is None:
        return 0
    if not raw or raw.get("kind") != "literal":
        raise InvalidSpec("round takes a literal number of places")
    return int(raw["value"])


_BINARY = {
    "add": F.try_add,  # NULL where the result does not fit
    "sub": F.try_subtract,
    "mul": F.try_multiply,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}
_UNARY_TEXT = {"upper": F.upper, "lower": F.lower, "trim": F.trim, "length": F.length}
_DATE_PART = {"year": F.year, "month": F.month, "day": F.dayofmonth}

# Fewest and most arguments of every function (None = any number).
ARITY = {
    "concat": (2, None), "upper": (1, 1), "lower": (1, 1), "trim": (1, 1), "length": (1, 1),
    "substr": (2, 3), "replace": (3, 3), "add": (2, 2), "sub": (2, 2), "mul": (2, 2), "div": (2, 2),
    "round": (1, 2), "if": (3, 3), "eq": (2, 2), "ne": (2, 2), "gt": (2, 2), "gte": (2, 2),
    "lt": (2, 2), "lte": (2, 2), "and": (2, None), "or": (2, None), "not": (1, 1), "year": (1, 1),
    "month": (1, 1), "day": (1, 1), "datediff_days": (2, 2),
}


def _function(df: DataFrame, node: dict) -> Column:
    name, raw = node.get("fn"), node.get("args") or []
    if name not in ARITY:
        raise InvalidSpec(f"unknown function: {name!r}")
    low, high = ARITY[name]
    if len(raw) < low or (high is not None and len(raw) > high):
        raise InvalidSpec(f"{name} takes {low}{'+' if high is None else f'-{high}'} arguments, got {len(raw)}")
    args = [_build(df, child) for child in raw]
    if name in _BINARY:
        return _BINARY[name](*args)
    if name in _UNARY_TEXT:
        return _UNARY_TEXT[name](_text(df, args[0]))
    if name in _DATE_PART:
        return _DATE_PART[name](_date(df, args[0]))
    if name == "concat":
        return F.concat_ws("", *[_text(df, a) for a in args])
    if name == "substr":
        return _substr(_text(df, args[0]), *args[1:])
    if name == "replace":
        return F.replace(*[_text(df, a) for a in args])
    if name == "div":
        return args[0].cast("double") / F.nullif(args[1].cast("double"), F.lit(0.0))
    if name == "round":
        places = _literal_int(args[1] if len(args) > 1 else None, raw[1] if len(raw) > 1 else None)
        return round_half_away(args[0], type_of(df, args[0]), places)
    if name == "if":
        return F.when(args[0], args[1]).otherwise(args[2])
    if name == "and":
        return reduce(lambda a, b: a & b, args)
    if name == "or":
        return reduce(lambda a, b: a | b, args)
    if name == "not":
        return ~args[0]
    return F.datediff(_date(df, args[1]), _date(df, args[0]))


def _build(df: DataFrame, node: dict) -> Column:
    kind = node.get("kind")
    if kind == "column":
        return column_of(df, node.get("name"))
    if kind == "literal":
        return F.lit(node.get("value"))
    if kind == "function":
        return _function(df, node)
    raise InvalidSpec(f"unknown expression node: {kind!r}")


def expression_column(df: DataFrame, tree: dict) -> Column:
    """The Column of an expression tree over `df`."""
    level, depth, nodes = [tree], 0, 0
    while level:
        depth, nodes = depth + 1, nodes + len(level)
        level = [child for node in level for child in node.get("args") or []]
    if depth > MAX_DEPTH:
        raise InvalidSpec(f"expression nested deeper than {MAX_DEPTH}")
    if nodes > MAX_NODES:
        raise InvalidSpec(f"expression has more than {MAX_NODES} nodes")
    return _build(df, tree)


def col(name: str) -> dict:
    """Shorthand for a column node."""
    return {"kind": "column", "name": name}


def lit(value) -> dict:
    """Shorthand for a literal node."""
    return {"kind": "literal", "value": value}


def fn(name: str, *args) -> dict:
    """Shorthand for a function node; bare Python values become literals."""
    return {"kind": "function", "fn": name, "args": [a if isinstance(a, dict) else lit(a) for a in args]}
