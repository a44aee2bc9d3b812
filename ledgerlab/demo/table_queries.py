"""Table-analysis queries over the star-schema tables, with their SQL checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo.ledgers import table
from ledgerlab.operators import pivot as P
from ledgerlab.operators import tables as T
from ledgerlab.plans.expressions import col, fn
from ledgerlab.plans.pivots import Measure, PivotSpec

QUERIES, SQL = {}, {}

_PRICED = "cast(l_extendedprice as decimal(18,2)) AS precio"


def query(sql: str | None = None):
    """Register a query under its function name, with the SQL that checks it."""
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function
    return add


def _items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_shipdate",
        "l_quantity", F.col("l_extendedprice").cast("decimal(18,2)").alias("precio"))


def leaf(column: str, operator: str, value=None) -> dict:
    return {"type": "condition", "column": column, "operator": operator, "value": value}


def group(combinator: str, *children: dict) -> dict:
    return {"type": "group", "combinator": combinator, "children": list(children)}


@query("""SELECT l_orderkey, l_linenumber, l_returnflag, cast(l_quantity as double) AS l_quantity FROM lineitem
WHERE l_shipdate >= timestamp '1996-01-01' AND (l_returnflag IN ('A','R') OR l_quantity BETWEEN 10 AND 20)
AND (l_linestatus != 'F' OR l_linenumber IN (1, 2)) AND l_returnflag IS NOT NULL""")
def filter_tree(spark: SparkSession, sf: str) -> DataFrame:
    tree = group("and", leaf("l_shipdate", "gte", "1996-01-01"),
                 group("or", leaf("l_returnflag", "in", ["A", "R"]), leaf("l_quantity", "between", [10, 20])),
                 group("or", leaf("l_linestatus", "ne", "F"), leaf("l_linenumber", "in", [1, 2])),
                 leaf("l_returnflag", "is_not_null"), group("and"))
    return T.select_columns(T.where(table(spark, sf, "lineitem"), tree), ["l_orderkey", "l_linenumber", "l_returnflag", "l_quantity"])


@query("""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name LIKE '%ring%' AND p_brand NOT LIKE '%#2%'
AND (p_type LIKE 'E%' OR p_type LIKE '%D') AND p_partkey NOT IN (1, 2) AND p_size > 3""")
def filter_text(spark: SparkSession, sf: str) -> DataFrame:
    tree = group("and", leaf("p_name", "contains", "ring"), leaf("p_brand", "not_contains", "#2"),
                 group("or", leaf("p_type", "starts_with", "E"), leaf("p_type", "ends_with", "D")),
                 leaf("p_partkey", "not_in", [1, 2]), leaf("p_size", "gt", 3))
    return T.select_columns(T.where(table(spark, sf, "part"), tree), ["p_partkey", "p_name", "p_brand"])


@query("""SELECT * FROM customer WHERE (cast(c_custkey as varchar) ILIKE '%13%' OR c_name ILIKE '%13%' OR cast(c_nationkey as varchar) ILIKE '%13%'
OR cast(c_acctbal as varchar) ILIKE '%13%' OR c_mktsegment ILIKE '%13%')""")
def search_any(spark: SparkSession, sf: str) -> DataFrame:
    return T.where(table(spark, sf, "customer"), search=" 13 ")


@query("""SELECT o_orderkey, minimo, mayor FROM (SELECT o_orderkey, o_totalprice / 1e12 AS minimo, o_totalprice * 1e14 AS mayor FROM orders)
WHERE cast(minimo as varchar) ILIKE '%e-0%' OR cast(mayor as varchar) ILIKE '%e-0%'""")
def search_doubles(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    return T.where(table(spark, sf, "orders").select("o_orderkey", (price / 1e12).alias("minimo"), (price * 1e14).alias("mayor")), search="e-0")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') AS estado FROM orders WHERE nullif(o_orderstatus, 'F') IS NULL")
def filter_is_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("estado"))
    return T.where(rows, group("and", leaf("estado", "is_null")))


@query("""SELECT p_partkey, p_retailprice * p_size AS valor FROM part ORDER BY valor DESC NULLS LAST, p_partkey LIMIT 100""")
def order_result(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    valued = T.with_computed(rows, [("valor", fn("mul", col("p_retailprice"), col("p_size")))]).select("p_partkey", "valor")
    return T.page(valued, 100, 0, [("valor", "desc")])


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey, o_custkey LIMIT 200 OFFSET 150""")
def order_page_after(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"])
    sort = [("o_orderpriority", "desc"), ("o_totalprice", "asc")]
    last = T.page(rows, 1, 149, sort).first().asDict()
    return T.page_after(rows, sort, last, 200)


@query("""SELECT o_orderkey, o_custkey, o_orderpriority, o_totalprice FROM orders
ORDER BY o_orderpriority DESC NULLS LAST, o_totalprice ASC NULLS LAST, o_orderkey, o_custkey LIMIT 200 OFFSET 100""")
def order_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = T.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"])
    return T.page(rows, 200, 100, [("o_orderpriority", "desc"), ("o_totalprice", "asc")])


@query("SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def count_matches(spark: SparkSession, sf: str) -> DataFrame:
    return T.count_matches(table(spark, sf, "orders"), group("and", leaf("o_orderstatus", "eq", "F"), leaf("o_totalprice", "gt", 100000)))


@query("""SELECT DISTINCT p_name AS value FROM part WHERE p_name IS NOT NULL AND p_name ILIKE '%re%'""")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return T.distinct_values(table(spark, sf, "part"), "p_name", "RE")


@query("""SELECT c_custkey, concat(upper(trim(c_mktsegment)), '-', lower(c_name), '-', cast(c_nationkey as varchar)) AS etiqueta,
length(c_name) AS largo, substr(c_name, 0, 4) AS inicio, substr(c_name, 10) AS resto, replace(c_name, 'Customer', 'Cliente') AS nombre,
CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 10 THEN 'obra' ELSE 'otro' END AS clase FROM customer""")
def computed_text(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    name = col("c_name")
    out = T.with_computed(rows, [
        ("etiqueta", fn("concat", fn("upper", fn("trim", col("c_mktsegment"))), "-", fn("lower", name), "-", col("c_nationkey"))),
        ("largo", fn("length", name)), ("inicio", fn("substr", name, 0, 4)), ("resto", fn("substr", name, 10)),
        ("nombre", fn("replace", name, "Customer", "Cliente")),
        ("clase", fn("if", fn("and", fn("eq", col("c_mktsegment"), "BUILDING"), fn("lt", col("c_nationkey"), 10)), "obra", "otro"))])
    return out.drop("c_name", "c_nationkey", "c_mktsegment")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS neto,
round(l_extendedprice / nullif(l_discount, 0), 3) AS razon, l_quantity + l_linenumber AS suma, l_quantity - 7 AS resta,
((l_quantity >= 25) OR (NOT (l_linenumber != 3))) AS grande FROM lineitem""")
def computed_math(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
    price, discount, quantity, line = col("l_extendedprice"), col("l_discount"), col("l_quantity"), col("l_linenumber")
    out = T.with_computed(rows, [
        ("neto", fn("round", fn("mul", price, fn("sub", 1, discount)), 2)), ("razon", fn("round", fn("div", price, discount), 3)),
        ("suma", fn("add", quantity, line)), ("resta", fn("sub", quantity, 7)),
        ("grande", fn("or", fn("gte", quantity, 25), fn("not", fn("ne", line, 3))))])
    return out.drop("l_quantity", "l_extendedprice", "l_discount")


@query("""SELECT o_orderkey, year(cast(o_orderdate as date)) AS anio, month(cast(o_orderdate as date)) AS mes,
day(cast(o_orderdate as date)) AS dia, date_diff('day', date '1998-01-01', cast(o_orderdate as date)) AS dias FROM orders""")
def computed_dates(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    when = col("o_orderdate")
    return T.with_computed(rows, [("anio", fn("year", when)), ("mes", fn("month", when)), ("dia", fn("day", when)),
                                  ("dias", fn("datediff_days", "1998-01-01", when))]).drop("o_orderdate")


@query("""SELECT o_orderkey, CASE WHEN lower(o_orderpriority) = lower('5-low') THEN 'BAJA' WHEN o_orderpriority = '1-URGENT' THEN 'ALTA'
ELSE o_orderpriority END AS o_orderpriority, CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS o_orderstatus FROM orders""")
def replace_exact(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return T.replace_values(rows, [
        {"column": "o_orderpriority", "search": "5-low", "replace": "BAJA", "case_sensitive": False},
        {"column": "o_orderpriority", "search": "1-URGENT", "replace": "ALTA"},
        {"column": "o_orderstatus", "search": "F", "replace": ""}])


@query("""SELECT p_partkey, replace(replace(CASE WHEN p_name = 'red widget' THEN 'rojo' ELSE p_name END, 'ring', 'aro'), 'ro', 'RO') AS p_name,
replace(cast(p_retailprice as varchar), '.', ',') AS p_retailprice FROM part""")
def replace_contains(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return T.replace_values(rows, [
        {"column": "p_name", "mode": "contains", "search": "ring", "replace": "aro"},
        {"column": "p_name", "search": "red widget", "replace": "rojo"},
        {"column": "p_name", "mode": "contains", "search": "ro", "replace": "RO"},
        {"column": "p_retailprice", "mode": "contains", "search": ".", "replace": ","}])


@query("SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem")
def dedupe_rows(spark: SparkSession, sf: str) -> DataFrame:
    return T.drop_duplicate_rows(table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_keys(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return T.drop_duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query("SELECT count(*) AS antes, count(DISTINCT (l_orderkey, l_linenumber)) AS despues FROM lineitem")
def dedupe_counts(spark: SparkSession, sf: str) -> DataFrame:
    return T.dedupe_counts(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(f"""SELECT count(*) AS total, count(precio) AS non_null, count(*) - count(precio) AS nulls, count(DISTINCT precio) AS distinct_count,
cast(min(precio) as double) AS minimum, cast(max(precio) as double) AS maximum, cast(round(sum(precio), 6) as double) AS total_sum,
round(cast(sum(precio) as double) / count(precio), 2) AS average FROM (SELECT {_PRICED} FROM lineitem)""")
def column_stats(spark: SparkSession, sf: str) -> DataFrame:
    out = T.column_stats(_items(spark, sf), "precio")
    doubles = {n: F.col(n).cast("double") for n in ("minimum", "maximum", "total_sum")}
    return out.withColumns(doubles).withColumn("average", F.round("average", 2))


@query("""SELECT p_brand AS value, count(*) AS freq FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand ORDER BY freq DESC, value LIMIT 10""")
def top_values(spark: SparkSession, sf: str) -> DataFrame:
    return T.top_values(table(spark, sf, "part"), "p_brand")


def _doubles(df: DataFrame) -> DataFrame:
    return df.select([F.col(f"`{f.name}`").cast("double").alias(f.name) if f.dataType.typeName() == "decimal" else F.col(f"`{f.name}`")
                      for f in df.schema])


@query(f"""SELECT l_returnflag, l_linestatus, cast(round(sum(precio), 6) as double) AS suma_precio, count(*) AS conteo,
count(l_quantity) AS conteo_l_quantity, count(DISTINCT l_suppkey) AS unicos_l_suppkey, round(avg(l_quantity), 6) AS promedio_l_quantity,
min(l_partkey) AS minimo_l_partkey, max(l_partkey) AS maximo_l_partkey
FROM (SELECT *, {_PRICED} FROM lineitem) WHERE l_quantity > 1 GROUP BY l_returnflag, l_linestatus ORDER BY suma_precio DESC""")
def pivot_basic(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(
        ["l_returnflag", "l_linestatus"],
        [Measure("sum", "precio"), Measure("count"), Measure("count", "l_quantity"), Measure("count_distinct", "l_suppkey"),
         Measure("avg", "l_quantity"), Measure("min", "l_partkey"), Measure("max", "l_partkey")],
        filter=group("and", leaf("l_quantity", "gt", 1)), sort_measure=0)
    return _doubles(P.pivot(_items(spark, sf), spec))


@query(f"""SELECT l_suppkey, coalesce(cast(sum(CASE WHEN l_returnflag='A' THEN precio END) as double), 0) AS "A · suma_precio",
round(avg(CASE WHEN l_returnflag='A' THEN l_quantity END), 6) AS "A · promedio_l_quantity",
coalesce(cast(sum(CASE WHEN l_returnflag='N' THEN precio END) as double), 0) AS "N · suma_precio",
round(avg(CASE WHEN l_returnflag='N' THEN l_quantity END), 6) AS "N · promedio_l_quantity",
coalesce(cast(sum(CASE WHEN l_returnflag='R' THEN precio END) as double), 0) AS "R · suma_precio",
round(avg(CASE WHEN l_returnflag='R' THEN l_quantity END), 6) AS "R · promedio_l_quantity",
cast(sum(precio) as double) AS "Total · suma_precio", round(avg(l_quantity), 6) AS "Total · promedio_l_quantity"
FROM (SELECT *, {_PRICED} FROM lineitem) GROUP BY l_suppkey""")
def pivot_crosstab(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(["l_suppkey"], [Measure("sum", "precio"), Measure("avg", "l_quantity")], pivot_column="l_returnflag", sort_measure=0)
    return _doubles(P.pivot(_items(spark, sf), spec))


_PCT = "round(100.0 * {0} / (SELECT count(*) FROM lineitem), 2)"


@query(f"""SELECT l_suppkey, {_PCT.format("count(CASE WHEN l_linestatus='F' THEN 1 END)")} AS "F",
{_PCT.format("count(CASE WHEN l_linestatus='O' THEN 1 END)")} AS "O", {_PCT.format("count(*)")} AS "Total" FROM lineitem GROUP BY l_suppkey""")
def pivot_percent(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(["l_suppkey"], [Measure("count")], pivot_column="l_linestatus", percent_of_total=True)
    return P.pivot(_items(spark, sf), spec)


@query(f"""SELECT cast(sum(CASE WHEN l_returnflag='A' THEN precio END) as double) AS "A", cast(sum(CASE WHEN l_returnflag='N' THEN precio END) as double) AS "N",
cast(sum(CASE WHEN l_returnflag='R' THEN precio END) as double) AS "R", cast(sum(precio) as double) AS "Total" FROM (SELECT *, {_PRICED} FROM lineitem)""")
def pivot_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(P.pivot_totals(_items(spark, sf), PivotSpec(["l_suppkey"], [Measure("sum", "precio")], pivot_column="l_returnflag")))


@query("SELECT count(*) AS grupos FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)")
def pivot_count(spark: SparkSession, sf: str) -> DataFrame:
    return P.pivot_count(_items(spark, sf), PivotSpec(["l_suppkey", "l_returnflag"], [Measure("count")]))


@query(f"""SELECT l_suppkey, l_returnflag AS valor, cast(sum(precio) as double) AS suma_precio, count(DISTINCT l_partkey) AS unicos_l_partkey
FROM (SELECT *, {_PRICED} FROM lineitem) GROUP BY l_suppkey, l_returnflag""")
def pivot_long(spark: SparkSession, sf: str) -> DataFrame:
    spec = PivotSpec(["l_suppkey"], [Measure("sum", "precio"), Measure("count_distinct", "l_partkey")], pivot_column="l_returnflag")
    return _doubles(P.pivot_long(_items(spark, sf), spec))


def _distinct_cells() -> str:
    flags = [(f"{flag} · ", f"CASE WHEN l_returnflag = '{flag}' THEN {{0}} END") for flag in "ANR"] + [("Total · ", "{0}")]
    return ", ".join(f'count(DISTINCT {form.format(column)}) AS "{head}unicos_{column}"' for head, form in flags for column in ("l_partkey", "l_orderkey")) + \
        ", " + ", ".join(f'cast(coalesce(sum({form.format("precio")}), 0) as double) AS "{head}suma_precio"' for head, form in flags)


@query(f"""SELECT l_suppkey, l_linestatus, {_distinct_cells()} FROM (SELECT *, {_PRICED} FROM lineitem) GROUP BY l_suppkey, l_linestatus""")
def crosstab_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """A cross-tab of two distinct counts beside a sum: no row is expanded for them."""
    return _doubles(P.pivot(_items(spark, sf), _DISTINCT))


@query(f"""SELECT {_distinct_cells()} FROM (SELECT *, {_PRICED} FROM lineitem)""")
def crosstab_distinct_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _doubles(P.pivot_totals(_items(spark, sf), _DISTINCT))


_DISTINCT = PivotSpec(["l_suppkey", "l_linestatus"], [Measure("count_distinct", "l_partkey"), Measure("count_distinct", "l_orderkey"), Measure("sum", "precio")],
                      pivot_column="l_returnflag")
