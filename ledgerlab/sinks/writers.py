"""Downloads, derived datasets, scenario files and rate snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlab.errors import EmptyDataset, ExportTooLarge, InvalidSpec
from ledgerlab.operators.reconcile import Reconciliation, difference_text
from ledgerlab.operators.records import REPORT_COLUMNS
from ledgerlab.operators.tables import schema_of
from ledgerlab.session import shuffles_dropped
from ledgerlab.sinks import versions

# Text separators, and the rows that a sheet holds.
SEPARATORS = {"tab": "\t", "pipe": "|", "semicolon": ";", "comma": ","}
MAX_SHEET_ROWS = 1_048_575


def export_guard(df: DataFrame, cap: int | None = None, sheet: bool = False) -> int:
    """Row count of a download; more than its bound (if it has one) is an error. The count stops past the bound."""
    bounds = [bound for bound in (cap, MAX_SHEET_ROWS if sheet else None) if bound is not None]
    if not bounds:
        return df.count()
    bound = min(bounds)
    rows = df.limit(bound + 1).count()
    if rows > bound:
        raise ExportTooLarge(f"the download would pass {bound} rows")
    return rows


def write_csv(df: DataFrame, path: str) -> None:
    """Comma-separated part files with a heading."""
    df.write.option("header", True).csv(path)


def write_txt(df: DataFrame, path: str, separator: str = "tab") -> None:
    """Text part files with one of the named separators."""
    if separator not in SEPARATORS:
        raise InvalidSpec(f"unknown separator: {separator!r}")
    df.write.option("header", True).option("sep", SEPARATORS[separator]).csv(path)


def materialize(df: DataFrame, path: str) -> tuple[list[dict], int]:
    """Store a derived dataset; returns its schema and row count, no rows is an error."""
    if df.isEmpty():  # before the write: a folder left behind would block the next try
        raise EmptyDataset("the derived dataset holds no rows")
    df.write.mode("errorifexists").parquet(path)
    stored = df.sparkSession.read.parquet(path)
    return schema_of(stored), stored.count()


def catalog_row(spark: SparkSession, name: str, origin: str, schema: list[dict], rows: int, path: str) -> DataFrame:
    """One metadata row of a dataset: append it to the catalog table."""
    if origin not in ("uploaded", "pivot", "computed", "replaced", "deduped"):
        raise InvalidSpec(f"unknown origin: {origin!r}")
    return spark.createDataFrame(
        [(name, origin, schema, rows, path)],
        "name STRING, origin STRING, columns ARRAY<STRUCT<name: STRING, type: STRING>>, row_count BIGINT, path STRING")


def scenario_file(result: Reconciliation, letter: str, stored: DataFrame | None = None) -> DataFrame:
    """A scenario as flat report columns: the alert as a word, the differing fields as text."""
    rows = result.scenario(letter, stored)
    if result.book == "ventas":
        rows = rows.drop("ruc_proveedor", "periodo_hallazgo", *[f"{n}_{s}" for n in (
            "bi_dgng", "igv_dgng", "bi_dng", "igv_dng", "valor_adq_ng", "moneda", "tipo_cambio") for s in ("empresa", "sunat")])
    else:
        rows = rows.drop("status_description")
    if letter == "C":
        rows = rows.withColumn("campos_diferentes", difference_text(F.col("diferencias"))).drop("diferencias")
    if letter != "D":
        rows = rows.withColumn("alerta", F.when(F.col("es_alerta_roja"), "ROJA").otherwise("AMBAR")).drop("es_alerta_roja")
    return rows


def write_scenarios(result: Reconciliation, path: str) -> DataFrame:
    """Store all scenarios once, write one CSV folder per scenario from that table, and return the
    row count of each with whether it passes a sheet's bound."""
    base = path.rstrip("/")
    result.rows.write.partitionBy("escenario").parquet(f"{base}/tabla")
    stored = result.rows.sparkSession.read.parquet(f"{base}/tabla")
    for letter in "ABCD":
        write_csv(scenario_file(result, letter, stored), f"{base}/{letter}")
    return stored.groupBy("escenario").agg(F.count(F.lit(1)).alias("filas")).withColumn("desborda_hoja", F.col("filas") > MAX_SHEET_ROWS)


def store_scenarios(rows: DataFrame | Reconciliation, path: str, load: str, sheet_rows: int = MAX_SHEET_ROWS) -> DataFrame:
    """Store the scenario rows of some periods as a load, and return the manifest: (periodo, escenario, carga, filas, desborda_hoja).

    Partitions are named by period, scenario and load, so a load that is repeated overwrites its own and nothing else; a
    load's rows are the same each time. Rows of a partition are gathered into few files first (adaptive execution splits large
    ones), or every task would write a file into each; a reconciliation gathers its own, while they are narrow. The manifest is a table of versions: readers see a period as it was before the load
    or after it, never between, and partitions that an earlier load of the same period left are not named any more.
    """
    base = path.rstrip("/")
    pairs = f"{base}/pares-{uuid.uuid4().hex}" if isinstance(rows, Reconciliation) else None
    gathered = rows.gathered_rows(pairs) if pairs else rows.hint("rebalance", "periodo", "escenario")
    spark, loaded = gathered.sparkSession, gathered.withColumn("carga", F.lit(load))
    with shuffles_dropped(spark):
        (loaded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("periodo", "escenario", "carga")
            .parquet(f"{base}/tabla"))
    if pairs:
        versions.drop(spark, pairs)
    counts = _table(spark, base).filter(F.col("carga") == load).groupBy("periodo", "escenario", "carga").agg(F.count(F.lit(1)).alias("filas"))
    counts = counts.withColumn("desborda_hoja", F.col("filas") > sheet_rows)
    earlier = versions.base_of(spark, f"{base}/manifiesto", load)
    if earlier is not None:
        counts = counts.unionByName(earlier.join(counts.select("periodo").distinct(), "periodo", "left_anti"))
    versions.commit(counts, f"{base}/manifiesto", load)
    return versions.read_version(spark, f"{base}/manifiesto")


def _table(spark: SparkSession, base: str) -> DataFrame:
    """Stored rows of all loads; partition names are text."""
    stored = spark.read.parquet(f"{base}/tabla")
    return stored.withColumns({name: F.col(name).cast("string") for name in ("periodo", "escenario", "carga")})


def read_scenarios(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows that the manifest names, of its newest version or of an earlier one."""
    base = path.rstrip("/")
    manifest = versions.read_version(spark, f"{base}/manifiesto", version)
    if manifest is None:
        raise EmptyDataset(f"nothing has been stored at {path}")
    return _table(spark, base).join(manifest.select("periodo", "escenario", "carga"), ["periodo", "escenario", "carga"], "left_semi")


def write_records_csv(report: DataFrame, path: str) -> None:
    """The records report with its labels, separated by semicolons; each file begins with a byte-order mark."""
    named = report.select([F.col(n).alias(label) for n, label in REPORT_COLUMNS.items()])
    named = named.withColumnRenamed(named.columns[0], "\ufeff" + named.columns[0])
    named.write.option("header", True).option("sep", ";").csv(path)


def write_documents(df: DataFrame, path: str, by_file: bool = False) -> None:
    """Extracted documents; `by_file` gives one folder per source file, written by every task that
    holds rows of it (no shuffle gathers a file)."""
    if by_file:
        df.write.partitionBy("archivo").option("header", True).csv(path)
    else:
        write_csv(df, path)


def write_by_type(classified: DataFrame, path: str) -> DataFrame:
    """Store classified texts in one folder per type, so that each extractor reads only its own."""
    classified.write.partitionBy("tipo").parquet(path)
    return classified.sparkSession.read.parquet(path)


def next_snapshot(df: DataFrame, folder: str) -> str:
    """Write a table as a new snapshot below `folder`; readers open the latest complete one."""
    stamp = df.sparkSession.sql("SELECT date_format(current_timestamp(), 'yyyyMMddHHmmssSSS')").first()[0]
    path = f"{folder.rstrip('/')}/{stamp}-{uuid.uuid4().hex[:8]}"
    df.write.mode("errorifexists").parquet(path)
    return path


def latest_snapshot(spark: SparkSession, folder: str) -> DataFrame | None:
    """The newest snapshot with a success mark, None before the first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return None
    names = sorted((s.getPath().toString() for s in system.listStatus(root)), reverse=True)
    done = next((n for n in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(n + "/_SUCCESS"))), None)
    return spark.read.parquet(done) if done else None
