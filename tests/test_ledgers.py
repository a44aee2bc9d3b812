"""Reconciliation, receipts, numbering and exchange-rate rules on pinned cases."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlab.operators import fx, ledger, receipts, reconcile, reports, sequence
from ledgerlab.sinks import writers

COLUMNS = "tipo_cdp STRING, serie STRING, numero STRING, fecha_emision DATE, base_imponible DOUBLE, igv DOUBLE, importe_total DOUBLE, line_no BIGINT"
DAY = date(2026, 7, 1)


def book(spark, *rows):
    full = [(t, s, n, d, base, igv, base + igv, i) for i, (t, s, n, d, base, igv) in enumerate(rows)]
    return spark.createDataFrame(full, COLUMNS)


def compared(spark, company, authority):
    return receipts.receipts_by_day(ledger.conform(book(spark, *company)), ledger.conform(book(spark, *authority))).collect()


def test_series_form(spark):
    df = spark.createDataFrame([("0127",), ("0006",), ("58",), (" b001 ",), ("B621",), ("12345",)], "s STRING")
    assert [r[0] for r in df.select(receipts.receipt_series(F.col("s"))).collect()] == ["B127", "B006", "B058", "B001", "B621", "B12345"]


@pytest.mark.parametrize("company", [[("03", "B001", str(i), DAY, 55.0, 10.0) for i in range(3)], [("03", "B001", "1", DAY, 165.0, 30.0)]])
def test_grouping_style_does_not_matter(spark, company):
    authority = [("03", "B001", str(i), DAY, 55.0, 10.0) for i in range(3)]
    (row,) = compared(spark, company, authority)
    assert (row.estado, float(row.igv_empresa), float(row.igv_sunat)) == ("cuadra", 30.0, 30.0)


@pytest.mark.parametrize("igv, base, state, fields, red", [
    ((100, 80), (500, 500), "difiere", ["igv", "importe"], True), ((100, 100.5), (500, 502), "cuadra", [], False),
    ((100, 100), (500, 505), "difiere", ["base", "importe"], False)])
def test_receipt_tolerances(spark, igv, base, state, fields, red):
    (row,) = compared(spark, [("03", "B001", "1", DAY, float(base[0]), float(igv[0]))], [("03", "B001", "1", DAY, float(base[1]), float(igv[1]))])
    assert (row.estado, row.campos_diferentes, row.es_alerta_roja) == (state, fields, red)


def test_one_sided_receipts(spark):
    rows = {r.serie: r for r in compared(spark, [("03", "B001", "1", DAY, 5.0, 0.9)], [("03", "B002", "1", DAY, 50.0, 9.0)])}
    assert (rows["B001"].estado, rows["B001"].es_alerta_roja) == ("solo_empresa", False)
    assert (rows["B002"].estado, rows["B002"].es_alerta_roja) == ("solo_sunat", True)


def test_scenarios(spark):
    other = date(2026, 7, 2)
    company = book(
        spark, ("01", "F001", "0001", DAY, 100.0, 18.0), ("01", "F001", "2", DAY, 100.0, 18.0), ("01", "F001", "3", DAY, 100.0, 100.0),
        ("01", "f001", "3", DAY, 100.0, 18.0), ("14", "T1", "9", DAY, 1.0, 1.0), ("07", "FC01", "5", DAY, 10.0, 0.05))
    authority = book(
        spark, ("01", "F001", "1", DAY, 100.0, 18.5), ("01", "F001", "2", DAY, 100.0, 20.0), ("01", "F001", "3", DAY, 100.0, 18.0),
        ("01", "F001", "77", DAY, 100.0, 18.0), ("01", "F001", "78", other, 100.0, 18.0))
    result = reconcile.reconcile(company, authority)
    assert {(r.serie, r.numero, r.es_alerta_roja) for r in result.scenario("A").collect()} == {("FC01", "5", False)}
    assert [r.numero for r in result.scenario("B").collect()] == ["77"]
    (c,) = result.scenario("C").collect()
    assert (c.numero, [(d.campo, d.diferencia) for d in c.diferencias], c.es_alerta_roja) == ("2", [("igv", Decimal("-2.000"))], True)
    assert sorted(r.numero for r in result.scenario("D").collect()) == ["0001", "3"]
    assert {(r.tipo_cdp, r.cantidad) for r in result.excluded.collect()} == {("14", 1)}
    assert {r.lado: r.sobrantes for r in result.surplus.collect()} == {"empresa": 1, "sunat": 0}
    summary = result.summary().first()
    assert (summary.escenario_a, summary.escenario_b, summary.escenario_c, summary.escenario_d) == (1, 1, 1, 2)
    assert summary.igv_diferencia_total == Decimal("20.00") and summary.tiene_alertas_rojas


def test_coverage(spark):
    company = book(spark, ("01", "F001", "1", DAY, 1.0, 1.0))
    authority = book(spark, ("01", "F001", "2", DAY, 1.0, 1.0), ("01", "F001", "3", date(2026, 7, 9), 1.0, 1.0))
    count = lambda coverage: reconcile.reconcile(company, authority, coverage=coverage).scenario("B").count()
    assert (count(None), count([]), count(["2026-07-09"]), count(["2026-07-30"])) == (1, 2, 1, 0)
    undated = company.withColumn("fecha_emision", F.lit(None).cast("date"))
    assert reconcile.reconcile(undated, authority).scenario("B").count() == 2


def test_empty_purchases(spark):
    empty = book(spark)
    result = reconcile.reconcile(empty, empty, "compras")
    row = result.summary().first()
    assert (row.escenario_a, row.escenario_b, row.igv_diferencia_total, row.tiene_alertas_rojas) == (0, 0, Decimal("0.00"), False)


def test_late_rescue(spark):
    company = book(spark, ("01", "E001", "1", date(2026, 5, 3), 1.0, 1.0), ("01", "E001", "2", date(2024, 1, 3), 1.0, 1.0)).withColumn("periodo", F.lit("202607"))
    authority = book(spark, ("01", "E001", "1", date(2026, 5, 3), 1.0, 1.0), ("01", "E001", "2", date(2024, 1, 3), 1.0, 1.0))
    authority = authority.withColumn("periodo", F.date_format("fecha_emision", "yyyyMM"))
    result = reconcile.reconcile(company, authority, "compras", late=True)
    (found,) = result.scenario("D").collect()
    assert (found.numero, found.periodo_hallazgo) == ("1", "202605")
    assert [r.numero for r in result.scenario("A").collect()] == ["2"]


def test_written_scenarios_match(spark, tmp_path):
    company = book(spark, ("01", "F001", "1", DAY, 1.0, 1.0), ("01", "F001", "2", DAY, 9.0, 9.0), ("03", "B001", "1", DAY, 9.0, 9.0))
    authority = book(spark, ("01", "F001", "1", DAY, 1.0, 1.0))
    counts = writers.write_scenarios(reconcile.reconcile(company, authority), str(tmp_path / "out"))
    assert {r.escenario: r.filas for r in counts.collect()} == {"A": 2, "D": 1}
    read = spark.read.option("header", True).csv(str(tmp_path / "out/A"))
    assert {r.alerta for r in read.collect()} == {"ROJA"}


def gaps(spark, rows, bucket, block=3):
    df = spark.createDataFrame([("03", "B1", str(a), str(b)) for a, b in rows], "tipo_cdp STRING, serie STRING, numero STRING, numero_final STRING")
    return [(r.faltantes, int(r.cantidad)) for r in sequence.number_gaps(df, bucket, block).collect()]


@pytest.mark.parametrize("bucket", [5, 100, 1_000_000])
def test_gaps(spark, bucket):
    assert gaps(spark, [(700, 720), (724, 729), (731, 740)], bucket) == [("721-723, 730", 4)]
    assert gaps(spark, [(1, 500), (3, 4), (502, 502)], bucket) == [("501", 1)]
    assert gaps(spark, [(1, 1)], bucket) == [] and gaps(spark, [(1, 1), (2, 2)], bucket) == []
    assert gaps(spark, [(10, 10), (41, 41)], bucket) == [("11-40", 30)]
    assert gaps(spark, [(10, 10), (42, 42)], bucket) == [("numeración irregular (del 10 al 42; 2 registros) — revisar manualmente", 31)]


def test_gaps_match_brute_force(spark):
    import random

    rng = random.Random(5)
    for _ in range(3):
        rows = [(a, a + rng.randrange(4)) for a in (rng.randrange(400) for _ in range(150))]
        covered = {n for a, b in rows for n in range(a, b + 1)}
        missing = [n for n in range(min(covered), max(covered)) if n not in covered]
        (got,) = gaps(spark, rows, 7) or [("", 0)]
        assert got[1] == len(missing)


PLE = "periodo STRING, cuo STRING, fecha_emi DATE, fecha_doc_mod DATE, tipo STRING, serie STRING, numero STRING, numero_final STRING, razon_social STRING, igv DOUBLE, total DOUBLE, moneda STRING, tc DECIMAL(7,3)"


def lines(spark, *rows):
    return spark.createDataFrame([(p, "M1", DAY, None, t, s, n, "", "X", 1.0, 1.0, "PEN", None) for p, t, s, n in rows], PLE)


def test_duplicates(spark):
    now = lines(spark, ("20260900", "01", "F001", "10"), ("20260900", "01", "F001", "0010"), ("20260900", "01", "F001", "11"))
    assert sequence.duplicate_rows_in_period(now).count() == 2
    previous = lines(spark, ("20260800", "01", "F001", "5"), ("20260800", "03", "B001", "7"), ("20260800", "01", "F009", "99"))
    current = lines(spark, ("20260900", "01", "F001", "5"), ("20260900", "03", "B001", "7"), ("20260900", "01", "F009", "99"), ("20260900", "01", "F009", "99"))
    assert [(r.serie, r.numero) for r in sequence.duplicates_vs_previous(current, previous).collect()] == [("F001", "5")]


def test_duplicates_of_two_current_periods(spark):
    previous = lines(spark, ("20260800", "01", "F001", "5"), ("20261000", "01", "F001", "6"))
    current = lines(spark, ("20260900", "01", "F001", "5"), ("20261000", "01", "F001", "5"), ("20260900", "01", "F001", "6"))
    found = sorted((r.periodo, r.numero) for r in sequence.duplicates_vs_previous(current, previous).collect())
    assert found == [("20260900", "5"), ("20261000", "5")]  # number 6 is declared later only


def test_gap_rows(spark):
    found = gap_list(spark, [("1", ""), ("200", "205"), ("300", "")])
    assert found == [(2, 199, 198), (206, 299, 94)]


def test_previous_periods(spark):
    previous = lines(spark, ("20260700", "01", "FA10", "1"), ("20260800", "01", "FA10", "1"), ("20260800", "01", "FA57", "2"))
    current = lines(spark, ("20260900", "01", "FA10", "1"), ("20260900", "01", "FA57", "2"))
    found = {r.serie: r.periodos_previos for r in sequence.duplicates_vs_previous(current, previous).collect()}
    assert found == {"FA10": ["20260700", "20260800"], "FA57": ["20260800"]}
    assert {r.periodo for r in sequence.latest_period(previous).collect()} == {"20260800"}


@pytest.mark.parametrize("first, text, count", [("12", "11", 1), ("41", "11-40", 30), ("42", "numeración irregular (del 11 al 41) — revisar manualmente", 31)])
def test_cuts(spark, first, text, count):
    (row,) = sequence.series_cuts(lines(spark, ("20260900", "03", "B1", first)), lines(spark, ("20260800", "03", "B1", "10"))).collect()
    assert (row.faltantes, int(row.cantidad)) == (text, count)
    assert sequence.series_cuts(lines(spark, ("20260900", "03", "B1", "11")), lines(spark, ("20260800", "03", "B1", "10"))).count() == 0


@pytest.mark.parametrize("days, text", [
    ([], "Mes completo"), ([1], "01/07/2026"), ([1, 2, 3], "del 01/07/2026 al 03/07/2026"), ([1, 3], "01/07/2026, 03/07/2026"),
    ([1, 3, 5, 7, 9, 11, 13], "7 días entre el 01/07/2026 y el 13/07/2026")])
def test_coverage_text(spark, days, text):
    df = spark.createDataFrame([(date(2026, 7, d),) for d in days], "fecha DATE")
    assert sequence.coverage_text(df).first().cobertura == text


def quotes(spark, *rows):
    return spark.createDataFrame([(d, Decimal(b), Decimal(s)) for d, b, s in rows], "fecha DATE, compra DECIMAL(7,3), venta DECIMAL(7,3)")


def test_calendar(spark):
    jan = lambda d: date(2019, 1, d)
    q = quotes(spark, (jan(2), "3.369", "3.373"), (jan(3), "3.368", "3.371"), (jan(4), "3.356", "3.360"), (jan(7), "3.349", "3.353"), (jan(8), "3.340", "3.345"))
    got = {r.fecha.day: (str(r.compra), str(r.venta)) for r in fx.fx_calendar(q, jan(2), jan(8)).collect()}
    weekend = ("3.356", "3.360")
    assert got == {3: ("3.369", "3.373"), 4: ("3.368", "3.371"), 5: weekend, 6: weekend, 7: weekend, 8: ("3.349", "3.353")}
    one = fx.fx_calendar(quotes(spark, (jan(4), "3.3", "3.4")), jan(3), jan(6)).collect()
    assert sorted(r.fecha.day for r in one) == [5, 6]


def fx_line(spark, tipo="01", day=date(2026, 9, 7), tc="3.418", moneda="USD", mod=None):
    return spark.createDataFrame([("202609", "M1", day, mod, tipo, "F001", "1", "", "X", 2338.12, 1.0, moneda, Decimal(tc))], PLE)


def test_rate_differences(spark):
    rates = quotes(spark, (date(2026, 9, 7), "3.3", "3.369"), (date(2026, 9, 4), "3.3", "3.400"))
    span = (date(2026, 9, 1), date(2026, 9, 30))
    (row,) = fx.fx_differences(fx_line(spark), rates, *span).collect()
    assert (float(row.dif_igv), row.tipo_label, row.num_documento) == (33.52, "01 - Factura", "F001-1")
    for quiet in (fx_line(spark, moneda="PEN"), fx_line(spark, tc="3.369"), fx_line(spark, day=date(2026, 9, 20)), fx_line(spark, tc="0")):
        assert fx.fx_differences(quiet, rates, *span).count() == 0
    (note,) = fx.fx_differences(fx_line(spark, "07", mod=date(2026, 9, 4)), rates, *span).collect()
    assert float(note.tc_sunat) == 3.4


def test_upsert_keeps_manual_days(spark):
    stored = quotes(spark, (date(2026, 9, 1), "1", "1"), (date(2026, 9, 2), "1", "1")).select(
        "*", F.when(F.dayofmonth("fecha") == 1, "manual").otherwise("bcrp").alias("fuente"), F.current_timestamp().alias("updated_at"))
    new = quotes(spark, (date(2026, 9, 1), "2", "2"), (date(2026, 9, 2), "2", "2"), (date(2026, 9, 3), "2", "2"))
    got = {r.fecha.day: (float(r.venta), r.fuente) for r in fx.upsert_fx(stored, new, "sunat").collect()}
    assert got == {1: (1.0, "manual"), 2: (2.0, "sunat"), 3: (2.0, "sunat")}
    assert {r.fuente for r in fx.edit_fx(stored, new).collect()} == {"manual"}


def test_validity_and_tickets(spark):
    rows = spark.createDataFrame([("01", "F", "1"), ("01", "F", "2")], "tipo_cdp STRING, serie STRING, numero STRING")
    codes = spark.createDataFrame([("01", "F", "1", "2")], "tipo_cdp STRING, serie STRING, numero STRING, estado_cp STRING")
    assert {r.numero: r.validez for r in reconcile.attach_validity(rows, codes).collect()} == {"1": "ANULADO", "2": ""}
    tickets = spark.sql("SELECT * FROM VALUES ('202601', 1, 'a', timestamp'2026-01-02'), ('202601', 2, 'b', timestamp'2026-01-02 05:00'), ('202602', 3, 'c', timestamp'2026-01-01') AS t(periodo, id, ticket, creado)")
    fresh = reconcile.latest_per_key(tickets, F.lit("2026-01-02 12:00:00").cast("timestamp"))
    assert {r.periodo: r.ticket for r in fresh.collect()} == {"202601": "b"}


def test_matrix(spark):
    rows = receipts.receipts_by_day(
        ledger.conform(book(spark, ("03", "B1", "1", DAY, 10.0, 5.0), ("03", "B2", "1", DAY, 10.0, 5.0))),
        ledger.conform(book(spark, ("03", "B1", "1", DAY, 10.0, 1.0), ("03", "B2", "1", date(2026, 7, 2), 10.0, 0.5))))
    matrix = {r.serie: r for r in reports.difference_matrix(rows).collect()}
    assert float(matrix["B1"]["2026-07-01"]) == 4.0 and float(matrix["B2"]["2026-07-02"]) == -0.5
    assert [r.serie for r in reports.series_ranking(rows).collect()] == ["B2", "B1"]


def gap_list(spark, numbers):
    rows = spark.createDataFrame([("03", "B001", a, b) for a, b in numbers], "tipo_cdp STRING, serie STRING, numero STRING, numero_final STRING")
    return sorted((int(r.desde), int(r.hasta), int(r.cantidad)) for r in sequence.gap_rows(rows, bucket=50).collect())


def purchase_book(spark, *rows):
    schema = "periodo STRING, ruc_proveedor STRING, tipo_cdp STRING, serie STRING, numero STRING, fecha_emision DATE, igv DOUBLE, line_no BIGINT, mto_exonerado DOUBLE"
    return spark.createDataFrame([(p, "20100070970", t, s, n, d, igv, k, 7.5) for k, (p, t, s, n, d, igv) in enumerate(rows)], schema)


def test_late_purchases_carry_only_what_a_scenario_needs(spark):
    june, july = date(2026, 6, 9), date(2026, 7, 9)
    company = purchase_book(
        spark, ("202607", "01", "f1", "001", june, 5.0), ("202607", " 01", "F1", "1", june, 18.0), ("202607", "01", "F1", "02", july, 18.0),
        ("202607", "01", "F1", "3", july, 18.0), (None, "01", "F1", "4", july, 18.0), ("202607", "01", "F1", "5", june, 18.0))
    authority = purchase_book(
        spark, ("202606", "01", "F1", "1", june, 18.0), ("202607", "01", "F1", "2", july, 20.0), (None, "01", "F1", "4", july, 18.0),
        ("202606", "01", "F1", "5", june, 18.0), ("202607", "01", "F1", "5", june, 30.0))
    result = reconcile.reconcile(company, authority, "compras", late=True)
    told = lambda letter, *extra: sorted(tuple(r) for r in result.scenario(letter).select("periodo", "tipo_cdp", "serie", "numero", *extra).collect())
    own = [(r.periodo, r.numero) for r in result.scenario("A").collect()]
    assert sorted(own, key=str) == [("202607", "3"), (None, "4")]
    assert sorted(((r.periodo, r.numero) for r in result.scenario("B").collect()), key=str) == [("202606", "1"), ("202606", "5"), (None, "4")]
    assert told("C", "periodo_hallazgo") == [("202607", "01", "F1", "02", ""), ("202607", "01", "F1", "5", "")]
    assert told("D", "periodo_hallazgo") == [("202607", " 01", "F1", "1", "202606")]
    counts = {r.escenario: r["count"] for r in result.rows.groupBy("escenario").count().collect()}
    assert counts == {"A": 2, "B": 3, "C": 2, "D": 1}
    plan = result.scenario("D").select("periodo", "numero")._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "mto_exonerado" in line and "LogicalRDD" not in line]


def test_a_load_is_gathered_while_narrow_and_reads_a_ledger_once(spark, tmp_path):
    ours = [("202401", str(k), "10.00" if k % 3 else None, "USD" if k % 2 else None) for k in range(8)] + [("202402", "30", "7.00", None)]
    theirs = [("202401", f"00{k}", "10.00", "PEN") for k in range(2, 12)] + [("202312", "30", "9.00", "PEN")]

    def book(rows, name):
        df = spark.createDataFrame(rows, "periodo STRING, numero STRING, importe_total STRING, moneda STRING")
        df.selectExpr("*", "'01' AS tipo_cdp", "'F001' AS serie", "'20100070970' AS ruc_proveedor", "date '2023-12-05' AS fecha_emision").write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    result = reconcile.reconcile(book(ours, "e"), book(theirs, "s"), "compras", late=True)
    names = result.rows.columns
    rows = sorted(map(str, result.rows.collect()))
    writers.store_scenarios(result, str(tmp_path / "s"), "uno")
    assert sorted(map(str, writers.read_scenarios(spark, str(tmp_path / "s")).select(names).collect())) == rows
    assert {r.escenario for r in result.rows.collect()} == set("ABCD") and not list((tmp_path / "s").glob("pares*"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    plan = result.rows._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("ReusedExchange") >= 2  # the rescue reads both ledgers' shuffles
