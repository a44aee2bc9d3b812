"""Readers, profiles and streams over files written by the tests."""

import json
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerlab.demo import detail_queries, reader_queries
from ledgerlab.demo.stream_queries import as_files
from ledgerlab.errors import EmptyDataset, InvalidSpec
from ledgerlab.functions import normalize
from ledgerlab.operators import profile
from ledgerlab.session import cut_lineage
from ledgerlab.sinks import versions, writers
from ledgerlab.sources import delimited, feeds, files, ledgers, lines
from ledgerlab.streaming import hashes, jobs


def put(path, data):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def sales_row(number, name, total="118.00"):
    return "|".join(["20260800", "1", "M1", "04/08/2026", "01/01/0001", "01", "F001", number, " ", "6", "20111111111", name, "0.00", "100.00", "0.00",
                     "18.00", "0.00", "0.00", "0.00", "0.00", "", "", "0.00", "0.00", total, "PEN", "1.000", " ", "1", ""])


def purchase_row(number):
    return "|".join(["20260800", "1", "M1", "04/08/2026", "", "01", "E001", "2026", number, "", "6", "20111111111", "PROVEEDOR", "100.00", "18.00", "0", "0",
                     "0", "0", "0", "0", "0", "0", "118.00", "PEN", "0", ""])


def ple_line(number="00000010", period="20260900", fields=36):
    out = [" "] * fields
    for at, value in {0: period, 1: "1", 3: "07/09/2026", 5: "01", 6: "f001", 7: number, 11: "AÑO SAC", 15: "10.00", 24: "66.00", 25: "pen", 26: "1.000"}.items():
        if at < fields:
            out[at] = value
    return "|".join(out)


def test_ingest(spark, tmp_path):
    source = put(tmp_path / "a.csv", "serie,igv,fecha\nB001,69.05,2026-01-02\nB002,20.12,2026-01-03\n")
    schema, rows = delimited.ingest(spark, source, str(tmp_path / "d"))
    assert rows == 2 and [(c["name"], c["type"]) for c in schema] == [("serie", "string"), ("igv", "double"), ("fecha", "date")]
    assert delimited.open_dataset(spark, str(tmp_path / "d")).count() == 2
    with pytest.raises(InvalidSpec):
        delimited.ingest(spark, source, str(tmp_path / "d"))
    with pytest.raises(EmptyDataset):
        delimited.ingest(spark, put(tmp_path / "b.csv", "serie,igv\n"), str(tmp_path / "e"))


def test_ladder_pads_short_rows(spark, tmp_path):
    source = put(tmp_path / "a.csv", "a;b;c\n1;2;3\n4;5\n")
    _, rows = delimited.ingest(spark, source, str(tmp_path / "d"))
    stored = delimited.open_dataset(spark, str(tmp_path / "d")).orderBy("a").collect()
    assert rows == 2 and stored[1].c is None


def test_ladder_keeps_surplus_fields(spark, tmp_path):
    source = put(tmp_path / "a.csv", "id,v\n1,2\n2,3,4\n5\n")
    schema, rows = delimited.ingest(spark, source, str(tmp_path / "d"))
    stored = delimited.open_dataset(spark, str(tmp_path / "d"))
    assert delimited.rung(spark, str(tmp_path / "d")) == "raw" and rows == 3
    assert [c["name"] for c in schema] == ["id", "v", "_c2"]
    assert sorted(map(tuple, stored.collect())) == [("1", "2", None), ("2", "3", "4"), ("5", None, None)]


def test_an_empty_file_blocks_no_retry(spark, tmp_path):
    source = put(tmp_path / "a.csv", "id,v\n")
    with pytest.raises(EmptyDataset):
        delimited.ingest(spark, source, str(tmp_path / "d"))
    put(tmp_path / "a.csv", "id,v\n1,2\n")
    assert delimited.ingest(spark, source, str(tmp_path / "d"))[1] == 1
    with pytest.raises(EmptyDataset):
        writers.materialize(spark.range(0), str(tmp_path / "m"))
    assert writers.materialize(spark.range(3), str(tmp_path / "m"))[1] == 3


def test_a_folder_of_several_encodings(spark, tmp_path):
    put(tmp_path / "in/a.csv", "id,v\n1,café\n".encode("latin-1"))
    put(tmp_path / "in/b.csv", "id,v\n2,niño\n".encode())
    put(tmp_path / "in/c.csv", "id,v\n3,5 €\n".encode("cp1252"))
    put(tmp_path / "in/d.csv", "id,v\n4,ÿþ\n".encode("utf-16"))
    put(tmp_path / "in/e.csv", "id,v\n5,ÿþ no mark\n6,x\n".encode("latin-1"))
    for mode in ("normal", "raw"):
        df = delimited.read_delimited(spark, str(tmp_path / "in"), sep=",", mode=mode)
        rows = {int(r.id): r.v for r in df.collect()}
        assert rows == {1: "café", 2: "niño", 3: "5 €", 4: "ÿþ", 5: "ÿþ no mark", 6: "x"}


def test_a_book_is_judged_by_all_its_lines(spark, tmp_path):
    good, bad = sales_row("1", "A"), sales_row("2", "B", "999.00")
    source = put(tmp_path / "a.txt", "\n".join([good] * 2500 + [bad] * 400))
    with pytest.raises(InvalidSpec):
        ledgers.read_ledger_sales(spark, source)
    put(tmp_path / "a.txt", "\n".join([good] * 2500 + [bad] * 100))
    assert ledgers.read_ledger_sales(spark, source).count() == 2600


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252", "utf-16"])
def test_encodings(spark, tmp_path, encoding):
    for name, end in (("a", "\n"), ("b", "\r\n")):
        source = put(tmp_path / f"{name}.csv", f"nombre,n{end}AÑO,1{end}SÍ,2{end}".encode(encoding))
        df = delimited.read_delimited(spark, source, sep=",")
        assert {(r.nombre, r.n) for r in df.collect()} == {("AÑO", 1), ("SÍ", 2)}


def test_ple_sales_lines(spark, tmp_path):
    source = put(tmp_path / "a.txt", (ple_line() + "\r\n\n" + ple_line("11") + "\n" + ple_line(fields=20) + "\n").encode("latin-1"))
    rows = ledgers.read_ple_sales(spark, source).orderBy("line_no").collect()
    assert [r.numero for r in rows] == ["00000010", "11"]
    assert (rows[0].razon_social, rows[0].serie, rows[0].moneda, rows[0].fecha_emi, rows[0].fecha_doc_mod, rows[0].igv) == (
        "AÑO SAC", "F001", "PEN", date(2026, 9, 7), None, Decimal("10.00"))


def test_books(spark, tmp_path):
    source = put(tmp_path / "v/a.txt", sales_row("00000100", "CLIENTE NORMAL SAC") + "\n" + sales_row("00000101", '"INGENIERIA Y CONSTRUCCIONES EIRL') + "\n")
    rows = ledgers.read_ledger_sales(spark, source).collect()
    assert {r.numero for r in rows} == {"00000100", "00000101"} and rows[0].base_imponible == Decimal("100.00")
    bad = put(tmp_path / "w/a.txt", sales_row("1", "X", "500.00"))
    with pytest.raises(InvalidSpec):
        ledgers.read_ledger_sales(spark, bad)
    buys = put(tmp_path / "c/a.txt", purchase_row("77") + "\n" + purchase_row(" "))
    (row,) = ledgers.read_ledger_purchases(spark, buys).collect()
    assert (row.numero, row.ruc_proveedor, row.importe_total, row.tipo_cambio) == ("77", "20111111111", Decimal("118.00"), Decimal("1.000"))
    platform = put(tmp_path / "p/a.csv", "Type description,Number,Issued date,Amount net,Amount tax,Amount total\nBoleta,B001-7,5/1/2026,\"1,000.00\",180,1180\nFactura,,5/1/2026,1,1,1\n")
    (row,) = ledgers.read_ledger_platform(spark, platform).collect()
    assert (row.tipo_cdp, row.serie, row.numero, row.fecha_emision, row.base_imponible) == ("03", "B001", "7", date(2026, 1, 5), Decimal("1000.00"))
    found = {p: ledgers.detect_ledger_format(spark, f, "ventas").first() for p, f in {"v": source, "w": bad, "c": buys, "p": platform}.items()}
    assert {p: r.formato for p, r in found.items()} == {"v": "ple_ventas", "w": "ple_no_cuadra", "c": "ple_compras", "p": "plataforma"}
    assert found["c"].aviso and not found["v"].aviso


def test_mapped(spark, tmp_path):
    text = "REPORTE\nTIPO;NUMERO;FECHA;BASE;IGV;TOTAL\nFactura;F001-12;5/1/2026;1.000,50;180;1.180,50\nTOTAL;;;;;5\nBoleta;77;6/1/2026;1;1;2\n"
    source = put(tmp_path / "a.txt", text)
    columns = {"tipo_cdp": 0, "numero": 1, "fecha_emision": 2, "base_imponible": 3, "igv": 4, "importe_total": 5}
    rows = ledgers.read_ledger_mapped(spark, source, columns, ";", skip_rows=1, header=True, combined=True).orderBy("line_no").collect()
    assert [(r.tipo_cdp, r.serie, r.numero, r.base_imponible) for r in rows] == [("01", "F001", "12", Decimal("1000.50")), ("03", "", "77", Decimal("1.00"))]
    few = ledgers.read_ledger_minimal(spark, source, {"tipo_cdp": 0, "numero": 1, "importe_total": 5}, ";", 1, True).orderBy("line_no").collect()
    assert [(r.serie, r.numero) for r in few] == [("F001", "12"), ("", "77")]


def test_proposal(spark, tmp_path):
    row = [""] * 28
    for at, value in {4: "04/08/2026", 6: "01", 7: "F001", 8: "7", 14: "100.00", 15: "-10.00", 16: "18,50", 25: "108.5", 27: "0"}.items():
        row[at] = value
    blank = [""] * 28
    source = put(tmp_path / "a.txt", "\n".join(["|".join(f"c{i}" for i in range(28)), "|".join(row), "|".join(blank)]))
    (got,) = ledgers.read_authority_proposal(spark, source, "ventas").collect()
    assert (got.base_imponible, got.igv, got.fecha_emision, got.tipo_cambio) == (Decimal("90.00"), Decimal("18.50"), date(2026, 8, 4), Decimal("1.000"))


def test_line_order_over_splits(spark, tmp_path):
    source = put(tmp_path / "a.txt", "".join(f"{i}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "70000")
    try:
        df = lines.text_lines(spark, source)
        assert df.rdd.getNumPartitions() > 1
        assert [int(r.value) for r in df.orderBy("line_no").select("value").collect()] == list(range(60_000))
        assert [int(r.value) for r in lines.first_lines(df, 3).orderBy("n").collect()] == [0, 1, 2]
        assert lines.after_first(df, 10).count() == 59_990
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_quotes_by_name(spark, tmp_path):
    feed = {"config": {"series": [{"name": "...SBS... - Venta"}, {"name": "...SBS... - Compra"}]},
            "periods": [{"name": "02.Ene.19", "values": ["3.373", "3.369"]}, {"name": "03.Set.19", "values": ["n.d.", "3.3"]}, {"name": "04.Set.19", "values": ["3.5", "3.4"]}]}
    rows = feeds.read_fx_quotes(spark, put(tmp_path / "a.json", json.dumps(feed))).orderBy("fecha").collect()
    assert [(r.fecha, r.compra, r.venta) for r in rows] == [(date(2019, 1, 2), Decimal("3.369"), Decimal("3.373")), (date(2019, 9, 4), Decimal("3.400"), Decimal("3.500"))]
    daily = feeds.read_fx_daily(spark, put(tmp_path / "t.txt", "07/09/2026|3.418|3.421|\nbasura\n99/99/2026|1|2|\n")).collect()
    assert [(r.fecha, r.venta) for r in daily] == [(date(2026, 9, 7), Decimal("3.421"))]


def invoice(root="Invoice", items=("Cemento", "Arena", "Cal")):
    line = {"Invoice": "InvoiceLine", "CreditNote": "CreditNoteLine", "DebitNote": "DebitNoteLine"}[root]
    rows = "".join(f"<cac:{line}><cac:Item><cbc:Description>{i}</cbc:Description></cac:Item></cac:{line}>" for i in items)
    return (f'<?xml version="1.0" encoding="UTF-8"?><{root} xmlns="urn:x" xmlns:cac="urn:cac" xmlns:cbc="urn:cbc"><cbc:ID>F001-7</cbc:ID><cbc:IssueDate>2026-08-04</cbc:IssueDate>'
            "<cac:AccountingSupplierParty><cac:Party><cac:PartyIdentification><cbc:ID>20131312955</cbc:ID></cac:PartyIdentification><cac:PartyLegalEntity>"
            "<cbc:RegistrationName>FERRETERIA SAC</cbc:RegistrationName></cac:PartyLegalEntity></cac:Party></cac:AccountingSupplierParty>"
            f'<cac:LegalMonetaryTotal><cbc:PayableAmount currencyID="PEN">118.00</cbc:PayableAmount></cac:LegalMonetaryTotal>{rows}</{root}>')


def test_invoice_xml(spark, tmp_path):
    put(tmp_path / "x/a.xml", invoice())
    put(tmp_path / "x/b.xml", invoice("CreditNote", ("Devolucion",)))
    put(tmp_path / "x/c.xml", "<otra>cosa</otra>")
    put(tmp_path / "x/d.xml", "<Invoice><cbc:ID>roto")
    rows = {r.tipo: r for r in feeds.read_invoices_xml(spark, str(tmp_path / "x")).collect()}
    assert set(rows) == {"01", "07"}
    assert (rows["01"].id, rows["01"].ruc, rows["01"].monto, rows["01"].moneda, rows["01"].fecha) == ("F001-7", "20131312955", "118.00", "PEN", "2026-08-04")
    assert rows["01"].descripcion == "Factura de FERRETERIA SAC — Cemento; Arena… — PEN 118.00"
    assert rows["07"].concepto == "Devolucion"
    every = {r.tipo: r.concepto for r in feeds.read_invoices_xml(spark, str(tmp_path / "x"), descriptions=None).collect()}
    assert every["01"] == "Cemento; Arena; Cal"


def test_roles(spark):
    df = spark.createDataFrame([("01", f"F{100 + i % 3}", f"{1000 + i:012d}", f"{i + 1}.5{i % 9}") for i in range(200)], "a STRING, b STRING, c STRING, d STRING")
    mapping = profile.profile_column_roles(df)
    assert mapping.columns == {"tipo_cdp": "a", "serie": "b", "numero": "c", "importe_total": "d"} and 0 < mapping.confidence <= 1
    named = profile.profile_column_roles(df.toDF("Tipo", "Serie", "Numero", "Importe Total"), named=True)
    assert named.confidence == 0.9
    ruc = df.select(F.lit("20131312955").alias("r"), F.lit("Factura").alias("t"), "b", F.substring("c", 6, 7).alias("c"))
    assert profile.profile_voucher_roles(ruc).columns == {"ruc": "r", "tipo": "t", "serie": "b", "numero": "c"}


def test_roles_with_ties_and_clashes(spark):
    rows = [(1, "x", "b", 0.9, 2), (1, "x", "a", 0.9, 1), (2, "y", "a", 1.0, 1), (2, "y", "c", 0.4, 3), (0, "z", "h", None, 4), (3, "z", "c", 0.8, 3), (3, "w", "h", 0.8, 4)]
    found = profile.assign_roles(spark.createDataFrame(rows, "turno INT, rol STRING, columna STRING, puntos DOUBLE, lugar INT"))
    assert sorted(map(tuple, found.collect()), key=str) == sorted([("z", "h", None), ("x", "a", 0.9), ("y", "c", 0.4)], key=str)
    assert profile.assign_roles(spark.createDataFrame([], "turno INT, rol STRING, columna STRING, puntos DOUBLE, lugar INT")).collect() == []


def test_amount_roles_without_a_pair(spark):
    df = spark.createDataFrame([(f"{i}.25", f"{i * 3}.75") for i in range(1, 50)], "a STRING, b STRING")
    assert [(r.rol, r.columna) for r in profile.amount_roles(df, ["a", "b"]).collect()] == [("importe_total", "b")]
    assert profile.amount_roles(df.select(F.lit("x").alias("a")), ["a"]).collect() == []


def test_amount_columns(spark):
    df = spark.createDataFrame([(str(i), f"{i}.25", f"{i * 0.18 + 0.045:.2f}", f"{i * 1.18 + 0.295:.2f}") for i in range(1, 100)], "id STRING, base STRING, igv STRING, total STRING")
    assert profile.detect_amount_columns(df, df.columns) == {"base_imponible": "base", "igv": "igv", "importe_total": "total"}


def test_suggestion(spark):
    df = spark.createDataFrame([("05/01/2026", "01", f"F001-{i}", f"{i}.25", f"{i * 0.18 + 0.045:.2f}", f"{i * 1.18 + 0.295:.2f}") for i in range(1, 60)], "f STRING, t STRING, n STRING, b STRING, i STRING, z STRING")
    mapping, combined = profile.suggest_mapping(df)
    assert combined and mapping == {"fecha_emision": "f", "tipo_cdp": "t", "numero": "n", "base_imponible": "b", "igv": "i", "importe_total": "z"}
    assert profile.propose_mapping(df, {"numero": "n"}) == ("guardado", {"numero": "n"})
    assert profile.propose_mapping(df)[0] == "sugerido"


def test_file_profiles(spark, tmp_path):
    put(tmp_path / "p/a.txt", "REPORTE DE VENTAS\n\nTipo;Numero;Fecha;Total\n" + "".join(f"01;F001-{i};05/01/2026;{i}.50\n" for i in range(9)))
    put(tmp_path / "p/b.txt", "".join(f"01|F001-{i}|05/01/2026|{i}.50\n" for i in range(9)))
    rows = {r.archivo[-5:]: (r.separador, r.cabecera, r.saltar) for r in profile.profile_text_files(spark, str(tmp_path / "p")).collect()}
    assert rows == {"a.txt": (";", True, 1), "b.txt": ("|", False, 0)}


def test_attachment_stream(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj\n" + b" " * 100
    inbox, store = tmp_path / "in", str(tmp_path / "store")
    put(inbox / "a.pdf", pdf), put(inbox / "copy.pdf", pdf), put(inbox / "bad.pdf", b"x" * 90)
    run = lambda: jobs.ingest_attachments_stream(spark, str(inbox), store, 7, 10_000, str(tmp_path / "ck")).awaitTermination()
    run()
    assert spark.read.parquet(f"{store}/adjuntos").count() == 1
    put(inbox / "again.pdf", pdf), put(inbox / "new.pdf", pdf + b"1")
    run()
    stored = spark.read.parquet(f"{store}/adjuntos")
    assert {r.nombre for r in stored.collect()} & {"new.pdf"} and stored.count() == 2
    assert [r.motivo for r in spark.read.parquet(f"{store}/rechazados").collect()] == ["tipo_no_reconocido"]


def test_attachment_stream_of_two_companies(spark, tmp_path):
    pdf = b"%PDF-1.4\n1 0 obj\n" + b" " * 100
    store = str(tmp_path / "store")
    for company in (1, 2, 1):
        put(tmp_path / f"in{company}/{len(list(tmp_path.rglob('*.pdf')))}.pdf", pdf)
        jobs.ingest_attachments_stream(
            spark, str(tmp_path / f"in{company}"), f"{store}/{company}", company, 10_000, str(tmp_path / f"ck{company}")).awaitTermination()
    for company in (1, 2):
        assert spark.read.parquet(f"{store}/{company}/adjuntos").count() == 1


def test_stored_hashes_are_few_files_and_read_by_bucket(spark, tmp_path):
    store, sha = str(tmp_path / "h"), F.sha2(F.col("id").cast("string"), 256)
    for lote in range(7):
        fresh = spark.range(lote * 50, lote * 50 + 50).select(F.lit(1).alias("company_id"), sha.alias("sha256"), F.lit("a.pdf").alias("nombre"))
        hashes.add(spark, store, fresh, lote, buckets=4, merge_after=3)
        if lote in (2, 6):
            hashes.add(spark, store, fresh, lote, buckets=4, merge_after=3)  # a replay, once right behind a merge
    known = hashes.known_hashes(spark, store)
    assert known.select("sha256").distinct().count() == 350 and hashes.state(spark, store)["base"]
    assert known.groupBy("lote").agg(F.count_distinct("sha256").alias("n")).filter("n <> 50").isEmpty()
    assert len(list((tmp_path / "h").glob("base-*"))) <= 2 and len(list((tmp_path / "h").glob("delta-*"))) <= 6
    base = hashes.state(spark, store)["base"]
    assert len(list(Path(base).rglob("part-*.parquet"))) == 4
    plan = hashes.known_hashes(spark, store, [1])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [(bucket" in plan


def test_versions(spark, tmp_path):
    folder = str(tmp_path / "t")
    assert versions.read_version(spark, folder) is None and versions.base_of(spark, folder, "x") is None
    assert versions.commit(spark.range(1), folder, "a") == 1
    assert versions.commit(spark.range(2), folder, "b") == 2
    assert versions.base_of(spark, folder, "b").count() == 1
    assert versions.commit(spark.range(3), folder, "b") == 2  # the same writer again
    assert [versions.read_version(spark, folder, v).count() for v in (None, -1, 1, 2)] == [3, 1, 1, 3]
    spark.range(9).write.parquet(f"{folder}/v00000009-lost")  # a writer that never came to move the pointer
    assert versions.read_version(spark, folder).count() == 3
    assert versions.commit(spark.range(4), folder, keep=1) == 3
    with pytest.raises(InvalidSpec):
        versions.read_version(spark, folder, 1)
    with pytest.raises(InvalidSpec):
        versions.read_version(spark, folder, -1)


def test_a_scenario_that_a_load_empties_is_read_no_more(spark, tmp_path):
    rows = spark.createDataFrame([("202401", "A", 1), ("202401", "B", 2), ("202402", "A", 3), ("202402", "A", 4)], "periodo STRING, escenario STRING, n INT")
    path = str(tmp_path / "s")
    with pytest.raises(EmptyDataset):
        writers.read_scenarios(spark, path)
    manifest = writers.store_scenarios(rows, path, "uno", sheet_rows=1)
    assert {(r.periodo, r.escenario): (r.filas, r.desborda_hoja) for r in manifest.collect()} == {
        ("202401", "A"): (1, False), ("202401", "B"): (1, False), ("202402", "A"): (2, True)}
    for _ in range(2):
        writers.store_scenarios(rows.filter("n = 1").withColumn("n", F.lit(9)), path, "dos")
    assert sorted((r.periodo, r.escenario, r.n) for r in writers.read_scenarios(spark, path).collect()) == [("202401", "A", 9), ("202402", "A", 3), ("202402", "A", 4)]
    assert writers.read_scenarios(spark, path, version=1).count() == 4


def test_files_are_opened_only_where_they_are_asked_for(spark, tmp_path):
    put(tmp_path / "f/a.bin", b"x" * 10), put(tmp_path / "f/b.bin", b"y" * 200)
    found = feeds.read_attachments(spark, str(tmp_path / "f"), lengths=(100, 1000), changed=("2000-01-01", "2100-01-01"))
    assert [(r.nombre, bytes(r.content)) for r in found.collect()] == [("b.bin", b"y" * 200)]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = found.select("nombre", "length")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "content" not in plan.split("ReadSchema")[-1] and "LessThanOrEqual(length,1000)" in plan and "modificationTime" in plan.split("PushedFilters")[-1]


def test_fields_of_badly_formed_lines(spark):
    lines = ["a;b;c", 'a;"b;c";d', '"a ""b;"" c";d', "", ";;", 'a;"never closed;b', '"x"', 'a;"b"";"";c";d;e']
    got = spark.createDataFrame([(k, line) for k, line in enumerate(lines)], "k INT, v STRING").select("k", delimited.field_count(F.col("v"), ";").alias("n"))
    assert [r.n for r in got.orderBy("k").collect()] == [3, 3, 2, 1, 3, 3, 1, 4]
    wide = spark.createDataFrame([("a||b||\"c||d\"",)], "v STRING").select(delimited.field_count(F.col("v"), "||").alias("n"))
    assert wide.first().n == 3


def test_a_field_of_a_megabyte(spark, tmp_path):
    long = "x;" * 500_000
    padded = put(tmp_path / "a.csv", f'a;b;c\n1;2;3\n4;"{long}"\n')
    assert delimited.ingest(spark, padded, str(tmp_path / "d"), sep=";")[1] == 2 and delimited.rung(spark, str(tmp_path / "d")) == "padded"
    assert {len(r.b) for r in delimited.open_dataset(spark, str(tmp_path / "d")).collect()} == {1, len(long)}
    surplus = put(tmp_path / "b.csv", f'a;b;c\n1;2;3\n4;"{long}";5;6\n')
    assert delimited.ingest(spark, surplus, str(tmp_path / "e"), sep=";")[1] == 2 and delimited.rung(spark, str(tmp_path / "e")) == "raw"
    stored = delimited.open_dataset(spark, str(tmp_path / "e"))
    wide = stored.filter("a = '4'").first()
    assert len(stored.columns) == delimited.RAW_COLUMNS and ";".join(wide) == f'4;"{long}";5;6'


def test_a_folder_of_one_encoding_is_read_by_its_name(spark, tmp_path):
    put(tmp_path / "in/a.csv", "id,v\n1,niño\n"), put(tmp_path / "in/b.csv", "id,v\n2,x\n")
    assert delimited.encodings_of(spark, str(tmp_path / "in")) == [("UTF-8", None, [str(tmp_path / "in")])]


def test_rate_stream(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "tc")
    put(inbox / "1.txt", "07/09/2026|3.418|3.421|\n08/09/2026|3.4|3.5|\n")
    run = lambda: jobs.fx_daily_stream(spark, str(inbox), table, str(tmp_path / "ck")).awaitTermination()
    run()
    put(inbox / "2.txt", "08/09/2026|3.6|3.7|\n")
    run()
    rows = {r.fecha.day: (float(r.venta), r.fuente) for r in writers.latest_snapshot(spark, table).collect()}
    assert rows == {7: (3.421, "sunat"), 8: (3.7, "sunat")}


def test_cut_lineage_and_files(spark, tmp_path):
    df = spark.range(5).select("id", F.when(F.col("id") < 3, "a.pdf").otherwise("b.pdf").alias("archivo"))
    assert cut_lineage(df, "t").count() == 5
    writers.write_documents(df, str(tmp_path / "docs"), by_file=True)
    assert sorted(p.name for p in (tmp_path / "docs").iterdir() if p.is_dir()) == ["archivo=a.pdf", "archivo=b.pdf"]


def test_mapping_levels(spark):
    book = spark.createDataFrame([tuple(sales_row(str(k), "A").split("|")) for k in range(1, 30)], [f"c{k}" for k in range(30)])
    level, mapping = profile.propose_mapping(book)
    assert level == "estandar" and (mapping["numero"], mapping["importe_total"]) == ("c7", "c24")
    names = ["Type Description", "Number", "Issued Date", "Amount Net", "Amount Tax", "Amount Total"]
    rows = spark.createDataFrame([("BOLETA", f"B001-{k}", "05/01/2026", "10", "1.8", "11.8") for k in range(9)], names)
    assert profile.propose_mapping(rows, named=True) == ("plataforma", {
        "fecha_emision": "Issued Date", "tipo_cdp": "Type Description", "numero": "Number", "base_imponible": "Amount Net",
        "igv": "Amount Tax", "importe_total": "Amount Total"})
    own = rows.toDF("Tipo Doc", "Nro", "Fecha Emision", "Valor", "Impuesto", "Importe")
    mapping, combined = profile.suggest_mapping(own, named=True)
    assert combined and mapping == {"fecha_emision": "Fecha Emision", "tipo_cdp": "Tipo Doc", "numero": "Nro", "base_imponible": "Valor",
                                    "igv": "Impuesto", "importe_total": "Importe"}


def test_files_of_rows_lie_in_one_folder(spark, tmp_path):
    rows = spark.range(300).selectExpr("concat('doc-', id, '.pdf') AS nombre", "concat('text ñ ', id) AS value")
    odd = spark.createDataFrame([("doc-7.pdf", "twice"), ("none.pdf", None)], "nombre STRING, value STRING")
    as_files(rows.unionByName(odd), str(tmp_path / "f"))
    found = {path.name: path.read_bytes().decode() for path in (tmp_path / "f").rglob("*.pdf")}
    assert found == {**{f"doc-{k}.pdf": f"text ñ {k}\n" for k in range(300)}, "doc-7.pdf": "text ñ 7\ntwice\n", "none.pdf": "\n"}
    assert all(path.is_file() for path in (tmp_path / "f").iterdir())  # paths sort as names do; a folder for each file took longest
    assert {r.nombre for r in feeds.read_attachments(spark, str(tmp_path / "f")).collect()} == set(found)


def test_datasets_are_stored_beyond_the_limit_of_a_download(spark, tmp_path, monkeypatch):
    spark.range(30).selectExpr("id AS o_orderkey", "1.5D AS o_totalprice", "date '2024-01-05' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(str(tmp_path / "orders.parquet"))
    monkeypatch.setattr(detail_queries, "DOWNLOAD_ROWS", 10)
    found = detail_queries.materialized(spark, str(tmp_path)).collect()
    assert sorted((r.columna, r.filas) for r in found) == [("dia", 30), ("o_orderkey", 30), ("o_orderpriority", 30), ("precio", 30)]


def test_a_batch_of_many_files_is_few_parts(spark, tmp_path):
    as_files(spark.range(4000).selectExpr("concat('doc-', id, '.pdf') AS nombre", "concat('%PDF-1.4 ', repeat('x', 90), id) AS value"), str(tmp_path / "in"))
    store = str(tmp_path / "store")
    many = 8 * spark.sparkContext.defaultParallelism
    files = feeds.read_attachments(spark, str(tmp_path / "in")).repartition(2 * many)
    jobs.store_attachments(store)(jobs.checked(files, 7, 10_000), 0)
    assert len(list((tmp_path / "store/entrada").glob("part-*.parquet"))) <= many
    assert jobs.attachment_log(spark, store).filter("estado = 'guardado'").count() == 4000


def test_lines_are_split_once_and_judged_in_one_pass(spark, tmp_path, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    fields = ["20260100", "1", "", "05/01/2026", "", "01", "F001", "", "12", "", "", "20100070970", "A"] + ["10.00", "1.80"] + [""] * 8 + ["11.80", "PEN", "1.000", ""]
    (tmp_path / "a.txt").write_text("\ufeff" + "\n".join(["|".join(fields)] * 3))
    monkeypatch.setattr(DataFrame, "isEmpty", lambda self: pytest.fail("the lines are read again"))
    rows = ledgers.read_ledger_purchases(spark, str(tmp_path))
    assert [(r.numero, float(r.importe_total), r.fecha_emision.isoformat()) for r in rows.collect()] == [("12", 11.8, "2026-01-05")] * 3
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("split(value") == 1


def test_books_that_do_not_add_up_are_named(spark, tmp_path):
    fields = ["20260100", "1", "", "05/01/2026", "", "01", "F001", "", "12", "", "", "20100070970", "A"] + ["10.00", "1.80"] + [""] * 8 + ["11.80", "PEN", "1.000", ""]
    (tmp_path / "a.txt").write_text("|".join(fields))
    (tmp_path / "b.txt").write_text("|".join(fields).replace("11.80", "99.00"))
    with pytest.raises(InvalidSpec, match=r"b\.txt"):
        ledgers.read_ledger_purchases(spark, str(tmp_path))
    (tmp_path / "short").mkdir()
    (tmp_path / "short" / "c.txt").write_text("1|2")
    with pytest.raises(InvalidSpec, match="short"):
        ledgers.read_ledger_purchases(spark, str(tmp_path / "short"))


def test_what_cannot_be_a_number_is_not_read_as_one(spark):
    texts = ["", " ", "x", "1e2", "+5", "-.5", "7.", "1 2", "F001", "12/01/2024", "٣", "\t8\n", "NaN", "--1", "1,234.56", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [float(r[0]) for r in rows.select(normalize.plain_amount(F.col("t"))).collect()]
    assert got == [0, 0, 0, 100, 5, -0.5, 7, 0, 0, 0, 3, 8, 0, 0, 1234.56, 0]
    assert "rlike" in str(normalize.plain_amount(F.col("t")))


def test_rows_of_a_load_are_stored_in_few_files(spark, tmp_path):
    rows = spark.range(400).selectExpr("concat('20240', 1 + id % 2) AS periodo", "'A' AS escenario", "id AS n").repartition(16)
    writers.store_scenarios(rows, str(tmp_path / "s"), "uno")
    assert len(list((tmp_path / "s/tabla").rglob("part-*.parquet"))) == 2
    assert writers.read_scenarios(spark, str(tmp_path / "s")).count() == 400


def test_an_invoice_is_parsed_once(spark):
    files = spark.createDataFrame([("a", bytearray(invoice().encode())), ("b", None), ("c", bytearray(b"<otra/>"))], "archivo STRING, content BINARY")
    rows = feeds.parse_invoices(files)
    assert [(r.archivo, r.id, r.concepto) for r in rows.collect()] == [("a", "F001-7", "Cemento; Arena; Cal")]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_xml(") == 1  # not in a filter and again below it


def test_plain_amounts_are_read_directly(spark):
    texts = ["12.5", "-0.005", "1.0049999", "0.005", "9999999999999999.99", "9999999999999999.999999", "12345678901234567", "1,234.5", "1.234,56", "1e2", "+5", " 7 ", "7.",
             ".5", "05/01/2026", "F001", "E", "", None, "12.5\n", "1.2.3", "\xa03.1\xa0", "٣"]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    got = [r[0] for r in rows.select(normalize.parse_amount(F.col("t"))).collect()]
    assert [str(v) for v in got] == [
        "12.50", "-0.01", "1.01", "0.01", "9999999999999999.99", "0.00", "0.00", "1234.50", "1234.56", "100.00", "5.00", "7.00", "7.00",
        "0.50", "0.00", "0.00", "0.00", "0.00", "0.00", "12.50", "0.00", "3.10", "3.00"]
    direct = str(normalize.parse_amount(F.col("t"))).split("transform")[0]  # before, every value was read in steps
    assert "[0-9]{1,16}" in direct


def test_files_are_listed_as_spark_finds_them(spark, tmp_path):
    for name in ("a.bin", "x/b c.bin", "x/y/ñ%20.bin", "x/y/_no.bin", ".no/d.bin", "_no/e.bin", "_k=1/f.bin", "x/g._COPYING_"):
        put(tmp_path / "f" / name, name * 3)
    names = ["path", "modificationTime", "length", "content"]
    for path in (tmp_path / "f", tmp_path / "f/x/*", tmp_path / "f/a.bin"):
        theirs = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(path)).select(names)
        ours = files.list_files(spark, str(path))
        assert sorted(ours.withColumn("content", files.content_of(F.col("path"))).collect()) == sorted(theirs.collect())
    assert files.list_files(spark, str(tmp_path / "none")) is None


def test_stream_keeps_no_name_for_each_file(spark, tmp_path):
    for k in range(60):
        put(tmp_path / f"in/{k % 3}/{k:02d}.pdf", b"%PDF-1.4\n1 0 obj\n" + b" " * (100 + k))
    run = lambda: jobs.ingest_attachments_stream(spark, str(tmp_path / "in"), str(tmp_path / "store"), 7, 10_000, str(tmp_path / "ck")).awaitTermination()
    run(), run()
    assert len(list((tmp_path / "ck/commits").glob("[0-9]*"))) == 1  # without new files there is no batch
    put(tmp_path / "in/1/00.pdf", b"%PDF-1.4\n1 0 obj\n" + b" " * 300)  # files are known by their paths
    put(tmp_path / "in/1/again.pdf", b"%PDF-1.4\n1 0 obj\n" + b" " * 100)
    run()
    logged = "".join(path.read_text() for path in (tmp_path / "ck/sources/0").glob("[0-9]*"))
    assert ".pdf" not in logged and logged.count("path") <= 6
    log = jobs.attachment_log(spark, str(tmp_path / "store")).collect()
    assert sorted((r.lote, r.estado) for r in log) == [(0, "guardado")] * 60 + [(1, "duplicado"), (1, "guardado")]


def test_files_of_formats_are_packed(spark, tmp_path, monkeypatch):
    lines_ = spark.range(1, 41).selectExpr(
        "id * 6 + 4 AS l_orderkey", "id AS l_partkey", "id % 5 AS l_suppkey", "cast(id % 3 AS int) AS l_linenumber", "cast(id AS double) AS l_quantity", "id * 10.5D AS l_extendedprice",
        "0.01D AS l_discount", "0.02D AS l_tax", "element_at(array('A', 'N', 'R'), cast(id % 3 AS int) + 1) AS l_returnflag", "timestamp_ntz '1995-03-05 00:00:00' AS l_shipdate")
    lines_.coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    for module in (detail_queries, reader_queries):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path / "kept"))
    found = detail_queries.file_formats(spark, str(tmp_path)).filter("libro = 'ventas'").collect()
    assert sorted((r.caso, r.formato) for r in found) == [("a", "ple_ventas"), ("b", "ple_compras"), ("c", "plataforma"), ("d", "ple_no_cuadra"), ("e", "desconocido")]
    parts = [p.name for p in (tmp_path / "kept").rglob("part-*")]
    assert len(parts) == 5 and all(name.endswith(".gz") for name in parts)
