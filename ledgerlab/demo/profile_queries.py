"""Column roles, amounts, layouts, attendance sheets and stored scenarios as queries, with their SQL checks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.demo import ledgers as D
from ledgerlab.demo.ledger_queries import _BUY_CTE, _role_sql, purchases, shown
from ledgerlab.operators import attendance as A
from ledgerlab.operators import profile as P
from ledgerlab.operators.vouchers import CODES, WORDS
from ledgerlab.session import cut_lineage, shared_folder
from ledgerlab.sinks import writers

QUERIES, SQL = {}, {}


def query(sql: str):
    def add(function):
        QUERIES[function.__name__] = function
        SQL[function.__name__] = sql
        return function
    return add


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# --- roles and amounts ---------------------------------------------------------------------------
_COMPANY = D.as_sql(D.SALES_COMPANY, "lineitem")


def _greedy(scores: str, roles: list[str], columns: list[str], least: float) -> str:
    """The same assignment as a chain of steps: a role's best column that no earlier role has."""
    place = " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(columns))
    steps, taken = [f"puntos AS ({scores})"], []
    for k, role in enumerate(roles):
        free = " AND ".join(["true", *(f"columna NOT IN (SELECT columna FROM r{j})" for j in taken)])
        steps.append(f"r{k} AS (SELECT '{role}' AS rol, columna, {role} AS puntos FROM puntos WHERE {role} > {least} AND {free}"
                     f" ORDER BY {role} DESC, CASE columna {place} END LIMIT 1)")
        taken.append(k)
    return f"WITH {', '.join(steps)} " + " UNION ALL ".join(f"SELECT rol, columna, round(puntos, 6) AS puntos FROM r{k}" for k in taken)


_PROFILED = ["tipo_cdp", "serie", "numero", "importe_total"]
_BY_CONTENTS = _greedy(_role_sql(), list(P.LEDGER_ROLES), _PROFILED, P.MIN_SCORE)
_HEADED = {"tipo_cdp": "Tipo", "serie": "Num Serie", "numero": "otro", "importe_total": "Monto"}


@query(f"""SELECT 'contenido' AS caso, * FROM ({_BY_CONTENTS}) UNION ALL VALUES ('cabecera', 'tipo_cdp', 'Tipo', NULL), ('cabecera', 'serie', 'Num Serie', NULL),
('cabecera', 'numero', 'Num Serie', NULL), ('cabecera', 'importe_total', 'Monto', NULL)""")
def assigned_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Ledger roles by contents alone, and by headings of which one names two roles."""
    rows = D.derive(spark, sf, D.SALES_COMPANY).select(_PROFILED)
    by_contents = P.ledger_roles(rows).select(F.lit("contenido").alias("caso"), "rol", "columna", F.round("puntos", 6).alias("puntos"))
    headed = P.ledger_roles(rows.select([F.col(c).alias(name) for c, name in _HEADED.items()]), named=True)
    return by_contents.unionByName(headed.select(F.lit("cabecera").alias("caso"), "rol", "columna", "puntos"))


_VOUCHERS = {
    "a": "CASE WHEN l_orderkey % 9 = 0 THEN lpad(cast(l_suppkey as string), 8, '1') ELSE concat('20', lpad(cast(l_suppkey as string), 9, '0')) END",
    "b": "CASE l_linenumber % 4 WHEN 0 THEN 'Factura' WHEN 1 THEN '03' WHEN 2 THEN 'nota de credito' ELSE 'otra cosa' END",
    "c": "CASE WHEN l_orderkey % 7 = 0 THEN '12' ELSE concat('F', lpad(cast(l_suppkey % 100 as string), 3, '0')) END",
    "d": "cast(l_orderkey * 8 + l_linenumber as string)", "e": "concat('comentario ', cast(l_partkey as string))"}


def _voucher_scores() -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS columna, trim(cast({c} as varchar)) AS v FROM l" for c in _VOUCHERS)
    ruc, dni = r"regexp_matches(v, '^(10|15|16|17|20)\d{9}$')", r"regexp_matches(v, '^\d{8}$')"
    codes, words = ", ".join(map(str, CODES)), " OR ".join(f"lower(v) LIKE '%{w}%'" for w in WORDS)
    points = {
        "ruc": f"CASE WHEN {ruc} THEN 1.0 WHEN {dni} THEN 0.5 ELSE 0.0 END",
        "tipo": rf"CASE WHEN regexp_matches(v, '^\d+$') AND try_cast(v as int) IN ({codes}) OR {words} THEN 1.0 ELSE 0.0 END",
        "serie": f"CASE WHEN regexp_matches(v, '^[A-Za-z][A-Za-z0-9]{{2,3}}$') THEN 1.0 WHEN regexp_matches(v, '^[A-Za-z0-9]{{1,4}}$') THEN 0.6 ELSE 0.0 END",
        "numero": rf"CASE WHEN regexp_matches(v, '^\d{{1,10}}$') AND NOT {dni} THEN 1.0 ELSE 0.0 END"}
    scores = ", ".join(f"avg({form}) AS {role}" for role, form in points.items())
    return f"WITH l AS ({D.as_sql(_VOUCHERS, 'lineitem')}) SELECT columna, {scores} FROM ({long}) WHERE v NOT IN ('', 'nan', 'None', '<NA>') GROUP BY columna"


@query(_greedy(_voucher_scores(), P.VOUCHER_ROLES, list(_VOUCHERS), P.VOUCHER_MIN_SCORE))
def voucher_roles(spark: SparkSession, sf: str) -> DataFrame:
    roles = P.voucher_roles(D.derive(spark, sf, _VOUCHERS))
    return roles.select("rol", "columna", F.round("puntos", 6).alias("puntos"))


_AMOUNTS = ["line_no", "mto_exonerado", "igv", "importe_total", "base_imponible"]


@query(f"""WITH l AS ({_COMPANY}), s AS (SELECT avg(CASE WHEN abs(base_imponible + igv - importe_total) <= 0.5 THEN 1.0 ELSE 0.0 END) AS p FROM l)
SELECT r.rol, r.rol AS columna, round(p, 6) AS proporcion FROM s, (VALUES ('importe_total'), ('base_imponible'), ('igv')) r(rol)""")
def amount_roles(spark: SparkSession, sf: str) -> DataFrame:
    """Base, tax and total among the columns of a ledger, found by their sums."""
    roles = P.amount_roles(D.derive(spark, sf, D.SALES_COMPANY), _AMOUNTS)
    return roles.withColumn("proporcion", F.round("proporcion", 6))


_SUGGESTED = {
    "a": "date_format(l_shipdate, 'dd/MM/yyyy')", "b": "CASE WHEN l_orderkey % 5 = 0 THEN '03' ELSE '01' END", "c": "concat('F', lpad(cast(l_suppkey % 100 as string), 3, '0'))",
    "d": "cast(l_orderkey * 8 + l_linenumber as string)", "e": "cast(cast(l_extendedprice as decimal(18,2)) as string)",
    "f": "cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(0.18 as decimal(3,2)) as decimal(18,2)) as string)",
    "g": "cast(cast(cast(l_extendedprice as decimal(18,2)) * cast(1.18 as decimal(3,2)) as decimal(18,2)) as string)"}


@query("""SELECT * FROM (VALUES ('sugerido', false, 'fecha_emision', 'a'), ('sugerido', false, 'tipo_cdp', 'b'), ('sugerido', false, 'serie', 'c'), ('sugerido', false, 'numero', 'd'),
('sugerido', false, 'base_imponible', 'e'), ('sugerido', false, 'igv', 'f'), ('sugerido', false, 'importe_total', 'g'),
('cabecera', true, 'fecha_emision', 'Fecha'), ('cabecera', true, 'tipo_cdp', 'Tipo'), ('cabecera', true, 'numero', 'Comprobante'), ('cabecera', true, 'base_imponible', 'Neto'),
('cabecera', true, 'igv', 'Impuesto'), ('cabecera', true, 'importe_total', 'Total')) v(caso, combinado, rol, columna) WHERE (SELECT count(*) FROM lineitem) > 0""")
def suggested_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """A mapping suggested by patterns and sums of a ledger without headings, and by headings, series and number in one column."""
    rows = D.derive(spark, sf, _SUGGESTED)
    joined = rows.select(F.col("a").alias("Fecha"), F.col("b").alias("Tipo"), F.concat_ws("-", "c", "d").alias("Comprobante"), F.col("e").alias("Neto"),
                         F.col("f").alias("Impuesto"), F.col("g").alias("Total"))
    out = []
    for name, df, named in (("sugerido", rows, False), ("cabecera", joined, True)):
        mapping, combined = P.suggest_mapping(df, "ventas", named)
        out += [(name, combined, role, column) for role, column in mapping.items()]
    return spark.createDataFrame(out, "caso STRING, combinado BOOLEAN, rol STRING, columna STRING")


@query("""SELECT * FROM (VALUES ('a', 'estandar'), ('b', 'plataforma'), ('c', 'guardado'), ('d', 'sugerido'), ('e', 'desconocido')) v(caso, nivel) WHERE (SELECT count(*) FROM lineitem) > 0""")
def mapping_levels(spark: SparkSession, sf: str) -> DataFrame:
    """The level at which the mapping of each of five files is found."""
    rows = D.derive(spark, sf, {**_SUGGESTED, "p": "date_format(l_shipdate, 'yyyyMM00')"})
    at = {0: "p", 3: "a", 5: "b", 6: "c", 7: "d", 13: "e", 15: "f", 24: "g"}
    book = rows.select([(F.col(at[k]) if k in at else F.lit("")).alias(f"c{k}") for k in range(30)])
    platform = rows.select(F.col("a").alias("Issued Date"), F.col("b").alias("Type Description"), F.concat_ws("-", "c", "d").alias("Number"),
                           F.col("e").alias("Amount Net"), F.col("f").alias("Amount Tax"), F.col("g").alias("Amount Total"))
    plain, vague = rows.drop("p"), rows.select(F.lit("x").alias("a"), F.lit("y z").alias("b"))
    found = [("a", P.propose_mapping(book)[0]), ("b", P.propose_mapping(platform, named=True)[0]), ("c", P.propose_mapping(plain, {"numero": "d"})[0]),
             ("d", P.propose_mapping(plain)[0]), ("e", P.propose_mapping(vague)[0])]
    return spark.createDataFrame(found, "caso STRING, nivel STRING")


# --- layout of files -----------------------------------------------------------------------------
# A file for each year of orders: even years have two lines and a blank one above their headings.
@query("""SELECT cast(year(o_orderdate) as varchar) AS anio, CASE WHEN year(o_orderdate) % 2 = 0 THEN ';' ELSE '|' END AS separador, year(o_orderdate) % 2 = 0 AS cabecera,
CASE WHEN year(o_orderdate) % 2 = 0 THEN 2 ELSE 0 END AS saltar FROM orders GROUP BY ALL""")
def file_layouts(spark: SparkSession, sf: str) -> DataFrame:
    folder, orders = _folder(spark, "layouts"), D.table(spark, sf, "orders")
    even = F.col("anio") % 2 == 0
    sep = F.when(even, ";").otherwise("|")
    price, day = F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.date_format("o_orderdate", "dd/MM/yyyy")
    rows = orders.select(F.year("o_orderdate").alias("anio"), F.col("o_orderkey").alias("orden"), price.alias("precio"), day.alias("dia"))
    data = rows.select("anio", "orden", F.concat_ws("§", F.lit("01"), F.concat(F.lit("F001-"), F.col("orden")), "dia", "precio").alias("value"))
    heads = rows.select("anio").distinct().filter(even).select("anio", F.posexplode(F.array(*map(F.lit, [
        "REPORTE DE VENTAS", "Empresa: COMERCIAL NORTE", "", "Tipo§Numero§Fecha§Total"]))).alias("orden", "value"))
    lines = heads.select("anio", (F.col("orden") - 10).cast("long").alias("orden"), "value").unionByName(data).withColumn("value", F.replace("value", F.lit("§"), sep))
    lines.repartition("anio").sortWithinPartitions("anio", "orden").select("anio", "value").write.partitionBy("anio").text(folder)
    found = P.profile_text_files(spark, folder)
    return found.select(F.regexp_extract("archivo", r"anio=(\d+)", 1).alias("anio"), "separador", "cabecera", "saltar")


# --- attendance ------------------------------------------------------------------------------------
@query("""SELECT o_custkey AS archivo, o_orderkey AS pagina, CASE WHEN o_orderkey % 5 = 0 THEN 'T' || o_orderkey ELSE (SELECT arg_min('T' || p.o_orderkey, p.o_orderkey) FROM orders p
  WHERE p.o_custkey = o.o_custkey AND p.o_orderkey % 5 = 0 AND p.o_orderkey < o.o_orderkey) END AS trabajador,
CASE WHEN o_orderkey % 3 = 0 THEN 'D' || o_orderkey ELSE (SELECT arg_min('D' || p.o_orderkey, p.o_orderkey) FROM orders p
  WHERE p.o_custkey = o.o_custkey AND p.o_orderkey % 3 = 0 AND p.o_orderkey < o.o_orderkey) END AS dni, o_orderstatus AS nota FROM orders o""")
def carried_headers(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of a file (the orders of a customer) filled from the first earlier page that names a worker or an id."""
    pages = D.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("archivo"), F.col("o_orderkey").alias("pagina"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("T"), F.col("o_orderkey"))).alias("trabajador"),
        F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("D"), F.col("o_orderkey"))).alias("dni"), F.col("o_orderstatus").alias("nota"))
    return A.carry_headers(pages)


@query("""SELECT 'Persona ' || o_orderkey AS trabajador, lpad(cast(o_custkey as varchar), 8, '4') AS dni, 'ANALISTA' AS cargo, o_orderpriority AS departamento, 'Diurno' AS turno,
strftime(o_orderdate, '%Y-%m-%d') AS fecha, '08:05:00' AS hora_entrada, '17:10:30' AS hora_salida, CASE WHEN o_orderkey % 7 <> 0 THEN 8.0 END AS horas_normales,
cast(o_custkey % 4 as double) AS horas_extras, o_orderkey % 3 <> 2 AS firma_presente FROM orders WHERE o_orderkey % 11 <> 0""")
def attendance_vertical(spark: SparkSession, sf: str) -> DataFrame:
    """A sheet with a row per day under headings of its own wording."""
    key = F.col("o_orderkey")
    sheet = D.table(spark, sf, "orders").select(
        F.when(key % 11 != 0, F.concat(F.lit(" Persona "), key)).alias("Apellidos y Nombres"), F.lpad(F.col("o_custkey").cast("string"), 8, "4").alias("Nro Documento"),
        F.lit("ANALISTA").alias("Puesto"), F.col("o_orderpriority").alias("Area"), F.lit("Diurno").alias("Jornada"),
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("Fecha"), F.lit("8:05").alias("Hora Entrada"), F.lit("17:10:30").alias("Hora Salida"),
        F.when(key % 7 == 0, "no aplica").otherwise("8").alias("Horas Normales"), (F.col("o_custkey") % 4).cast("string").alias("Sobretiempo"),
        F.when(key % 3 == 0, "Si").when(key % 3 == 1, "X").otherwise("falta").alias("Firma"))
    return A.attendance_vertical(sheet)


# --- stored scenarios -------------------------------------------------------------------------------
_AGAIN, _SHEET = "199503", 40


@query(_BUY_CTE + f"""SELECT periodo, escenario, count(*) AS filas, count(*) > {_SHEET} AS desborda_hoja, CASE WHEN periodo = '{_AGAIN}' THEN 'carga-2' ELSE 'carga-1' END AS carga FROM (
SELECT periodo, CASE WHEN campos = '' THEN 'D' ELSE 'C' END AS escenario FROM campos
UNION ALL SELECT e.periodo, 'A' FROM e ANTI JOIN campos c ON c.periodo = e.periodo AND c.ruc_proveedor = e.ruc_proveedor AND c.tipo_cdp = e.tipo_cdp AND c.serie = e.serie AND c.numero = e.numero
UNION ALL SELECT s.periodo, 'B' FROM s ANTI JOIN e USING (periodo, ruc_proveedor, tipo_cdp, serie, kn)) GROUP BY periodo, escenario""")
def scenario_files(spark: SparkSession, sf: str) -> DataFrame:
    """All periods stored as one load, one period as another that comes twice, counted as they are read back."""
    folder = _folder(spark, "scenarios")
    writers.store_scenarios(purchases(spark, sf), folder, "carga-1", _SHEET)
    # All rows are written once; only those that come again are kept aside.
    again = cut_lineage(writers.read_scenarios(spark, folder).filter(F.col("periodo") == _AGAIN).drop("carga"), "scenario-rows")
    for _ in range(2):
        manifest = writers.store_scenarios(again, folder, "carga-2", _SHEET)
    stored = writers.read_scenarios(spark, folder).groupBy("periodo", "escenario", "carga").agg(F.count(F.lit(1)).alias("filas"))
    return stored.join(manifest.select("periodo", "escenario", "carga", "desborda_hoja"), ["periodo", "escenario", "carga"])


@query("SELECT source AS archivo, doc_id, lang, n_chars FROM documents")
def documents_by_file(spark: SparkSession, sf: str) -> DataFrame:
    """Documents written as one folder of text files for each source, and read back."""
    folder = _folder(spark, "by-file")
    writers.write_documents(D.table(spark, sf, "documents").select(F.col("source").alias("archivo"), "doc_id", "lang", "n_chars"), folder, by_file=True)
    return spark.read.option("header", True).schema("doc_id BIGINT, lang STRING, n_chars BIGINT, archivo STRING").csv(folder)


@query("""SELECT s.separador, o_orderkey, o_orderpriority, round(o_totalprice, 2) AS precio FROM orders, (VALUES ('comma'), ('pipe'), ('semicolon'), ('tab')) s(separador)""")
def exported_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Orders written with each separator, and read back."""
    rows, parts = D.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("precio")), None
    for name, sep in writers.SEPARATORS.items():
        folder = _folder(spark, "texts")
        writers.write_txt(rows, folder, name)
        read = spark.read.option("header", True).option("sep", sep).schema("o_orderkey BIGINT, o_orderpriority STRING, precio DOUBLE").csv(folder)
        read = read.select(F.lit(name).alias("separador"), "*")
        parts = read if parts is None else parts.unionByName(read)
    return shown(parts)
