"""Ledgers derived row by row from the star-schema tables.

The inputs hold no vouchers, so every `lineitem` (and `orders`) row becomes one. Each list below
is plain SQL expressions that Spark (`selectExpr`) and the check engine both read, so both start
from the same rows; the operators themselves are written separately for each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = "cast(l_extendedprice as decimal(18,2))"
_IGV = f"cast({_BASE} * cast(0.18 as decimal(3,2)) as decimal(18,2))"
_NUMBER = "cast(l_orderkey * 8 + l_linenumber as string)"
_SUPP3 = "lpad(cast(l_suppkey % 100 as string), 3, '0')"
_SUPP2 = "lpad(cast(l_suppkey % 100 as string), 2, '0')"
_TYPE = ("CASE WHEN l_orderkey % 41 = 0 THEN '14' WHEN l_orderkey % 5 = 0 THEN '03' WHEN l_orderkey % 5 = 1 THEN '07'"
         " WHEN l_orderkey % 5 = 2 THEN '08' ELSE '01' END")
_LINE_NO = ("l_partkey * 1000000 + cast(l_quantity as bigint) * 10000"
            " + cast(round(l_tax * 100) as bigint) * 100 + cast(round(l_discount * 100) as bigint)")
_NO_CENTS = "cast(0 as decimal(18,2))"
_PLUS = "cast({0} as decimal(18,2))"


def _series(receipt: str) -> str:
    return (f"CASE WHEN l_orderkey % 41 = 0 THEN concat('T', {_SUPP3}) WHEN l_orderkey % 5 = 0 THEN {receipt}"
            f" WHEN l_orderkey % 5 = 1 THEN concat('FC', {_SUPP2}) WHEN l_orderkey % 5 = 2 THEN concat('FD', {_SUPP2})"
            f" ELSE concat('F', {_SUPP3}) END")


def _bump(amount: str, modulus: int, extra: str) -> str:
    return f"cast({amount} + CASE WHEN l_orderkey % {modulus} = 0 THEN {_PLUS.format(extra)} ELSE {_NO_CENTS} END as decimal(18,2))"


# One sales month: ship days are folded into January 2024. Company receipts name their series in
# digits or lower case; numbers carry leading zeros.
SALES_COMPANY = {
    "tipo_cdp": _TYPE,
    "serie": _series(f"CASE WHEN l_suppkey % 2 = 0 THEN lpad(cast(l_suppkey % 100 as string), 4, '0') ELSE concat('b', {_SUPP3}) END"),
    "numero": f"concat('00', {_NUMBER})",
    "numero_final": f"CASE WHEN l_orderkey % 5 = 0 AND l_linenumber % 3 = 0 THEN cast(l_orderkey * 8 + l_linenumber + 2 as string) ELSE '' END",
    "fecha_emision": "make_date(2024, 1, day(l_shipdate))",
    "base_imponible": _BASE,
    "igv": _IGV,
    "importe_total": f"cast({_BASE} + {_IGV} as decimal(18,2))",
    "mto_exonerado": f"CASE WHEN l_returnflag = 'A' THEN cast(l_quantity as decimal(18,2)) ELSE {_NO_CENTS} END",
    "razon_social": "CASE WHEN l_partkey % 7 = 0 THEN '' ELSE concat('Cliente ', cast(l_partkey as string)) END",
    "moneda": "CASE WHEN l_orderkey % 3 = 0 THEN 'USD' ELSE 'PEN' END",
    "line_no": _LINE_NO,
}
# The authority's month: some numbers, amounts and days differ.
SALES_AUTHORITY = {
    "tipo_cdp": _TYPE,
    "serie": _series(f"concat('B', {_SUPP3})"),
    "numero": f"concat(CASE WHEN l_orderkey % 17 = 0 THEN '9' ELSE '' END, {_NUMBER})",
    "fecha_emision": "make_date(2024, CASE WHEN l_orderkey % 19 = 0 THEN 2 ELSE 1 END, CASE WHEN l_orderkey % 19 = 0 THEN 1 ELSE day(l_shipdate) END)",
    "base_imponible": _bump(_BASE, 11, "2.00"),
    "igv": _bump(_IGV, 13, "2.00"),
    "importe_total": _bump(f"{_BASE} + {_IGV}", 29, "5.00"),
    "mto_exonerado": f"CASE WHEN l_returnflag = 'A' THEN cast(l_quantity as decimal(18,2)) ELSE {_NO_CENTS} END",
    "razon_social": "concat('Cliente ', cast(l_partkey as string))",
    "moneda": "CASE WHEN l_orderkey % 3 = 0 THEN 'USD' ELSE 'PEN' END",
    "line_no": _LINE_NO,
}

_MONTH = "cast(year(l_shipdate) * 100 + month(l_shipdate) as string)"
_NEXT = ("cast(CASE WHEN month(l_shipdate) = 12 THEN (year(l_shipdate) + 1) * 100 + 1"
         " ELSE year(l_shipdate) * 100 + month(l_shipdate) + 1 END as string)")
_BUY_TYPE = ("CASE WHEN l_orderkey % 43 = 0 THEN '14' WHEN l_orderkey % 6 = 0 THEN '07' WHEN l_orderkey % 6 = 1 THEN '08'"
             " WHEN l_orderkey % 6 = 2 THEN '30' WHEN l_orderkey % 6 = 3 THEN '50' WHEN l_orderkey % 6 = 4 THEN '54' ELSE '01' END")


def _split(flag: str, amount: str) -> str:
    return f"CASE WHEN l_returnflag = '{flag}' THEN {amount} ELSE {_NO_CENTS} END"


_BUY_COMMON = {
    "ruc_proveedor": "concat('20', lpad(cast(l_suppkey as string), 9, '0'))",
    "tipo_cdp": _BUY_TYPE,
    "serie": "concat('E', lpad(cast(l_linenumber as string), 3, '0'))",
    "fecha_emision": "cast(l_shipdate as date)",
    "bi_dgng": _split("N", _BASE),
    "bi_dng": _split("R", _BASE),
    "valor_adq_ng": "cast(l_quantity as decimal(18,2))",
    "line_no": _LINE_NO,
}
# Purchases of every ship month; a quarter is declared one month late.
PURCHASES_COMPANY = {
    **_BUY_COMMON,
    "periodo": f"CASE WHEN l_orderkey % 4 = 0 THEN {_NEXT} ELSE {_MONTH} END",
    "numero": "lpad(cast(l_orderkey as string), 12, '0')",
    "base_imponible": _split("A", _BASE),
    "igv": _split("A", _IGV),
    "igv_dgng": _split("N", _IGV),
    "igv_dng": _split("R", _IGV),
    "importe_total": f"cast({_BASE} + {_IGV} as decimal(18,2))",
    "moneda": "CASE WHEN l_orderkey % 3 = 0 THEN 'USD' ELSE 'PEN' END",
    "tipo_cambio": "cast(3.7 as decimal(9,3))",
    "razon_social": "concat('Proveedor ', cast(l_suppkey as string))",
}
PURCHASES_AUTHORITY = {
    **_BUY_COMMON,
    "periodo": _MONTH,
    "numero": "concat(CASE WHEN l_orderkey % 17 = 0 THEN '9' ELSE '' END, cast(l_orderkey as string))",
    "base_imponible": _bump(_split("A", _BASE), 11, "4.00"),
    "igv": _split("A", _IGV),
    "igv_dgng": _bump(_split("N", _IGV), 13, "2.00"),
    "igv_dng": _split("R", _IGV),
    "importe_total": f"cast({_BASE} + {_IGV} as decimal(18,2))",
    "moneda": "CASE WHEN l_orderkey % 3 = 0 THEN ' usd ' WHEN l_orderkey % 37 = 0 THEN 'EUR' ELSE 'PEN' END",
    "tipo_cambio": "cast(3.7 + CASE WHEN l_orderkey % 31 = 0 THEN 0.005 ELSE 0.001 END as decimal(9,3))",
    "razon_social": "concat('Proveedor ', cast(l_suppkey as string))",
}

# Sales lines of this period (lineitem) and of earlier periods (orders, one per order month).
LINES_CURRENT = {
    "periodo": "'20240100'",
    "cuo": f"concat('M', {_NUMBER})",
    "fecha_emi": "cast(l_shipdate as date)",
    "fecha_doc_mod": "CASE WHEN l_orderkey % 3 = 0 THEN cast(l_shipdate as date) - 20 END",
    "tipo": _TYPE,
    "serie": "concat('F', lpad(cast(l_orderkey % 50 as string), 3, '0'))",
    "numero": f"concat('00', {_NUMBER})",
    "numero_final": "''",
    "razon_social": "concat('Cliente ', cast(l_partkey as string))",
    "base_imponible": _BASE,
    "igv": _IGV,
    "total": f"cast({_BASE} + {_IGV} as decimal(18,2))",
    "moneda": "CASE WHEN l_linenumber % 3 = 0 THEN 'usd' WHEN l_linenumber % 3 = 1 THEN 'PEN' ELSE '' END",
    "tc": "cast(3.3 + (l_partkey % 400) * cast(0.001 as decimal(4,3)) as decimal(7,3))",
}
LINES_PREVIOUS = {
    "periodo": "concat(cast(year(o_orderdate) * 100 + month(o_orderdate) as string), '00')",
    "tipo": _TYPE.replace("l_orderkey", "o_orderkey"),
    "serie": "concat('F', lpad(cast(o_orderkey % 50 as string), 3, '0'))",
    "numero": "cast(o_orderkey * 8 + o_custkey % 7 as string)",
    "numero_final": "CASE WHEN o_orderkey % 10 = 0 THEN cast(o_orderkey * 8 + 7 as string) ELSE '' END",
}
# Numbers for the gap check: receipts and credit notes numbered along the order keys.
GAP_LEDGER = {
    "tipo_cdp": "CASE WHEN o_orderkey % 2 = 0 THEN '03' ELSE '07' END",
    "serie": "concat('b', lpad(cast(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 40 END as string), 3, '0'))",
    "numero": "cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey - CASE WHEN o_orderkey % 4500 = 0 THEN 3 ELSE 0 END ELSE o_custkey * 5 + o_orderkey % 5 END as string)",
    "numero_final": "cast(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5 ELSE o_custkey * 5 + o_orderkey % 5 + o_orderkey % 9 END as string)",
}
# One sell/buy pair per weekday with orders.
QUOTE_RATE = "cast(cast(3.3 as decimal(7,3)) + (count(*) % 400) * cast(0.001 as decimal(4,3)) as decimal(7,3))"


def as_sql(columns: dict[str, str], table: str) -> str:
    """The derivation as a SELECT over one table."""
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows to the session's number of shuffle partitions before CPU-heavy work."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def derive(spark: SparkSession, sf_dir: str, columns: dict[str, str], source: str = "lineitem") -> DataFrame:
    return table(spark, sf_dir, source).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exchange-rate quotes on order weekdays."""
    from pyspark.sql import functions as F

    days = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("fecha"))
    rates = days.groupBy("fecha").agg(F.expr(QUOTE_RATE).alias("venta"))
    return rates.filter(F.weekday("fecha") < 5).select(
        "fecha", (F.col("venta") - F.lit("0.005").cast("decimal(7,3)")).cast("decimal(7,3)").alias("compra"), "venta")


QUOTES_SQL = f"""SELECT fecha, cast(venta - cast(0.005 as decimal(7,3)) as decimal(7,3)) AS compra, venta FROM (
  SELECT fecha, {QUOTE_RATE} AS venta FROM (SELECT cast(o_orderdate as date) AS fecha FROM orders) GROUP BY fecha)
  WHERE isodow(fecha) <= 5"""
