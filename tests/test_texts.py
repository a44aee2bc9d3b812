"""Value parsing, classification, extraction, best reading, corrections and attachment checks."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlab.functions import identity as I
from ledgerlab.functions import normalize as N
from ledgerlab.functions import text as X
from ledgerlab.operators import attachments, attendance, classify, documents, records, vouchers

COMPANY, PERSON = "20131312955", "10417844398"


def one(spark, rule, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING")
    return [r[0] for r in df.orderBy("i").select(rule(F.col("t"))).collect()]


def valid_person():
    body = "1041784439"
    check = (11 - sum(int(d) * w for d, w in zip(body, I.WEIGHTS)) % 11) % 10
    return body + str(check)


def test_ruc(spark):
    assert one(spark, I.ruc_is_valid, COMPANY, "20131312954", "30131312955", valid_person(), "", "2013131295a") == [True, False, False, True, False, False]
    assert one(spark, I.ruc_find, f"RUC: {COMPANY}", f"xx {COMPANY} yy", "12345", f"9{COMPANY}1", None) == [COMPANY, COMPANY, None, COMPANY, None]


def test_period(spark):
    texts = ["03/2026", "2026-03", "marzo 2026", "202603", "13/2026", "032026", "Setiembre de 2026", "Marzo 1990", None]
    assert one(spark, I.parse_period, *texts) == ["202603"] * 4 + [None, "202603", "202609", None, None]


def test_money(spark):
    texts = ["S/ 1,500.00", "1.234,56", "75.00", "6,500", "6500", "1,234,567", "us$ 12.5", "nada", "99999999999", "S/ *****326.00"]
    assert one(spark, I.money_amount, *texts) == [Decimal(v) if v else None for v in (
        "1500.00", "1234.56", "75.00", "6500.00", "6500.00", "1234567.00", "12.50", None, None, "326.00")]
    assert [m.moneda for m in one(spark, I.parse_money, "$ 5", "5 soles", "5 dolares", "5")] == ["USD", "PEN", "USD", "PEN"]


def test_dates_and_numbers(spark):
    assert one(spark, I.parse_payment_date, "15/04/2026", "2026-04-15", "31/02/2026", "1.2.26", "x") == [
        date(2026, 4, 15), date(2026, 4, 15), None, date(2026, 2, 1), None]
    assert one(spark, I.parse_operation_number, "  987-654-321 ", "987654321", "12") == ["987-654-321", "987654321", None]
    assert one(spark, X.any_date, "Emisión: 05/01/24 y 01/02/2023", "el 2024-03-04", "sin fecha") == ["2024-01-05", "2024-03-04", None]
    assert one(spark, X.due_date, "VENCE: 05/ENE/2024", "Vencimiento 06/07/2024", "x") == ["2024-01-05", "2024-07-06", None]
    assert one(spark, X.time_of_day, "a las 8:05", "18:00:09", "no") == ["08:05:00", "18:00:09", None]


def test_amount_labels(spark):
    rule = lambda t: X.amount(t, ["TOTAL"])
    assert one(spark, rule, "Sub Total 5.00 TOTAL 7.50", "TOTAL a pagar S/ 1,234.5", "Total: 3.20", "SUBTOTAL 9.00") == [7.5, 1234.5, 3.2, None]


def test_vouchers_in_text(spark):
    series = one(spark, lambda t: F.struct(*[c.alias(n) for n, c in zip("ab", X.voucher(t))]), "F001 - 0000123", "B1-77", "Serie: E001 el Número: 45", "nada")
    assert [(r.a, r.b) for r in series] == [("F001", "0000123"), ("B1", "77"), ("E001", "45"), (None, None)]


def test_normalisers(spark):
    assert one(spark, N.parse_amount, "1234.56", "1,234.56", "1.234,56", "1234,56", "x", "", "-5") == [
        Decimal(v) for v in ("1234.56", "1234.56", "1234.56", "1234.56", "0.00", "0.00", "-5.00")]
    assert one(spark, N.parse_date_text, "5/1/2024", "2024-01-05", "hoy") == ["2024-01-05", "2024-01-05", "hoy"]
    assert one(spark, N.normalize_doc_type, "PE03", "03", "Boleta", "Factura electrónica ref", "7", "0", "XX") == ["03", "03", "03", "01", "07", "0", "XX"]
    assert one(spark, N.book_date, "01/01/0001", "04/08/2026", "31/02/2026") == [None, date(2026, 8, 4), None]


def test_classify(spark):
    df = spark.createDataFrame([
        (1, "Factura Electrónica\nF001-00000087"), (2, "BOLETA DE VENTA\nB001-00000123"), (3, "nada que ver"),
        (4, "NOTA DE CRÉDITO ELECTRÓNICA NC01-00000012"), (5, "Consumo de gas natural Cálidda")], "doc_id INT, texto STRING")
    got = {r.doc_id: (r.tipo, r.confianza) for r in classify.with_type(df).collect()}
    assert got == {1: ("factura_electronica", 1.0), 2: ("boleta_venta", 1.0), 3: ("desconocido", 0.0), 4: ("nota_credito", 1.0), 5: ("recibo_gas", 1.0)}


def test_needles_keep_every_match():
    import re

    for _, _, patterns in classify.RULES:
        for pattern in patterns:
            for words in [classify._needles(pattern)]:
                sample = re.sub(r"\\[a-zA-Z]|[^A-ZÁÉÍÓÚÑ|]", " ", pattern)
                assert all(w in sample for w in words)


def test_each_alternative_is_tried_alone_and_finds_the_same(spark):
    from ledgerlab.functions.text import found

    assert classify._alternatives(r"M[3³]\s*(?:AGUA|GAS)|A[|]B|C\|D") == [r"M[3³]\s*(?:AGUA|GAS)", "A[|]B", r"C\|D"]
    assert (classify._signs(r"\bkWh\b"), classify._signs(r"M[3³]\s*(?:GAS)"), classify._signs(r"\bF\d{3}")) == (["kWh"], ["M3", "M³"], [])
    assert classify._letter_first(r"\bO\.?N\b|\bX?Y") == r"O(?<=\bO)\.?N\b|\bX?Y"
    texts = ["AFP", "XAFP", "O.N.P.", "LA ONP", "ONPE", "CARBONP", "F001-00012", "XF001-00012", "ÑF001-00012", "F001 – 12345", "B12-1", "M³ AGUA", "M 3 GAS",
             "CONSUMO 5 M3", "12 kWh", "NC01-00001", "ANC01-00001", "ENEL", "ENELA", "LUZ  DEL\nSUR", "LUZ DEL NORTE", "WOMAN", "WOM", "DNI", "", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING")
    patterns = [p for _, _, patterns in classify.RULES for p in patterns]
    got = rows.select(*[F.struct(classify._matches(F.col("t"), p).alias("a"), found(F.col("t"), p, "").alias("b")).alias(f"p{k}") for k, p in enumerate(patterns)])
    assert all(bool(pair.a) == bool(pair.b) for row in got.collect() for pair in row)


def test_payments_are_read_by_all_tasks(spark, tmp_path):
    from ledgerlab.demo import detail_queries

    orders = spark.range(1, 41).selectExpr("id AS o_orderkey", "id AS o_custkey", "'1-URGENT' AS o_orderpriority", "cast(id as double) AS o_totalprice")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    assert detail_queries.payments(spark, str(tmp_path)).rdd.getNumPartitions() == 8


def test_later_patterns_decide_only_where_earlier_ones_fail(spark):
    text = ("RUC del arrendador: 20100070971\nRUC: 20100070970", "RUC: 20100070971", "Nro de la operacion: 12-34\nNumero de orden: 5555", "nroperacion 77\nOPERACIÓN 1234 x OPERACION: 98765")
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id INT, texto STRING")
    got = {(r.doc_id, r.campo): (r.valor, r.confianza) for r in records.extract_profile_fields(docs).collect()}
    assert got[0, "ruc_contribuyente"] == ("20100070970", 0.85)
    assert got[1, "ruc_contribuyente"] == ("20100070971", 0.383)
    assert got[2, "numero_de_operacion"] == ("12-34", 0.95)
    assert got[3, "numero_de_operacion"][0] in ("1234", "98765")


def test_invoice_table_row(spark):
    text = "DESCRIPCION CANT\n2.00 UNIDAD Cemento gris x 25.00 50.00\nTOTAL 50.00"
    labelled = "Concepto del pago: alquiler de local\n"
    assert one(spark, documents.item_description, text, labelled, "sin items") == ["Cemento gris x", "alquiler de local", None]


def test_fee_receipt_computes_missing(spark):
    df = spark.createDataFrame([(1, "RECIBO POR HONORARIOS\nHONORARIOS S/ 1,000.00")], "doc_id INT, texto STRING")
    row = documents.extract_fields(df, "recibo_honorarios").first()
    assert (row.monto_honorarios, row.retencion_monto, row.neto_pagar, row.moneda) == (1000.0, 40.0, 960.0, "PEN")


def test_all_types_extract(spark):
    df = spark.createDataFrame([(1, "Nombre: ANA\nN° DNI: 12345678\nCLARO ENEL SEDAPAL CALIDDA")], "doc_id INT, texto STRING")
    for kind in documents.FIELDS:
        assert documents.extract_fields(df, kind).columns == ["doc_id", *documents.document_fields(kind)]
    fields = documents.fields_as_map(documents.extract_fields(df, "recibo_agua"), documents.document_fields("recibo_agua")).first()
    assert fields.campos["empresa"] == "SEDAPAL"


def test_merge_corrections(spark):
    df = spark.sql("SELECT map('a', '1', 'b', '2') AS x, map('b', '9', 'c', '3') AS y")
    assert df.select(documents.merge_corrections(F.col("x"), F.col("y")).alias("m")).first().m == {"a": "1", "b": "9", "c": "3"}


def test_attendance(spark):
    df = spark.createDataFrame([
        (1, "PLANILLA\nQuispe Mamani Ana 40000001 05/01/2024 08:05 17:10 X"), (2, "TRABAJADOR: ROJAS DIAZ ANA\nDNI 40000002"), (3, "nada")], "doc_id INT, texto STRING")
    rows = {r.doc_id: r for r in attendance.extract_attendance(df).collect()}
    assert (rows[1].trabajador, rows[1].fecha, rows[1].hora_salida, rows[1].firma_presente) == ("Quispe Mamani Ana", "2024-01-05", "17:10", True)
    assert (rows[2].trabajador, rows[2].dni, rows[2].fecha) == ("ROJAS DIAZ ANA", "40000002", None) and 3 not in rows
    sheet = spark.createDataFrame([("Ana", "40000001", "5/1/2024", "8:05", "17:10", "si", None)], "`Apellidos y Nombres` STRING, DNI STRING, Fecha STRING, Ingreso STRING, Salida STRING, Firma STRING, Turno STRING")
    row = attendance.attendance_vertical(sheet.withColumn("Fecha", F.lit("05/01/2024"))).first()
    assert (row.trabajador, row.fecha, row.hora_entrada, row.firma_presente) == ("Ana", "2024-01-05", "08:05:00", True)
    assert attendance.is_wide([str(i) for i in range(1, 12)]) and not attendance.is_wide(["dni", "1"])


def test_header_carry_over(spark):
    pages = spark.createDataFrame([("a", 1, None, "1"), ("a", 2, "ANA", None), ("a", 3, None, None), ("b", 1, None, None)], "archivo STRING, pagina INT, trabajador STRING, dni STRING")
    got = {(r.archivo, r.pagina): (r.trabajador, r.dni) for r in attendance.carry_headers(pages).collect()}
    assert got == {("a", 1): (None, "1"), ("a", 2): ("ANA", "1"), ("a", 3): ("ANA", "1"), ("b", 1): (None, None)}


RENT = f"""CONSTANCIA DE PAGO
Formulario 1683 - Impuesto a la Renta de Primera Categoria
Arrendamiento de predio

RUC del Arrendador: {COMPANY}
Nombre / Razon Social: INVERSIONES LIMA SAC
RUC del Arrendatario: {valid_person()}
Periodo Tributario: 03/2026
Fecha de Pago: 15/04/2026
Numero de Operacion: 987654321
Monto de Alquiler: S/ 1,500.00
Importe Pagado: S/ 75.00
"""


def test_profile(spark):
    assert one(spark, records.recognise_profile, RENT, "Factura de luz del mes. Total a pagar: 90.00") == [True, False]
    df = spark.createDataFrame([(1, RENT)], "doc_id INT, texto STRING")
    fields = records.best_field(records.extract_profile_fields(df))
    row = records.build_record(fields).first()
    assert (row.ruc_contribuyente, row.ruc_inquilino, row.periodo, row.fecha_de_pago) == (COMPANY, valid_person(), "202603", date(2026, 4, 15))
    assert (row.importe_pagado, row.monto_alquiler, row.numero_de_operacion) == (Decimal("75.00"), Decimal("1500.00"), "987654321")
    assert (row.nombre_contribuyente, row.completitud, row.estrategia_usada) == ("INVERSIONES LIMA SAC", "complete", "native_pdf_text")


def readings(spark, *rows):
    costs = records.STRATEGY_COST
    return spark.createDataFrame([(1, c, v, conf, s, costs[s]) for c, v, conf, s in rows], "doc_id INT, campo STRING, valor STRING, confianza DOUBLE, estrategia STRING, costo INT")


def test_best_field(spark):
    native, ocr = "native_pdf_text", "local_ocr"
    best = {r.campo: r.valor for r in records.best_field(readings(
        spark, ("ruc_contribuyente", "A", 0.98, native), ("ruc_contribuyente", "B", 0.5, ocr), ("importe_pagado", "75.00", 0.8, ocr),
        ("periodo", "x", 0.9, ocr), ("periodo", "y", 0.9, native))).collect()}
    assert best == {"ruc_contribuyente": "A", "importe_pagado": "75.00", "periodo": "y"}


@pytest.mark.parametrize("paid, extra, level, state, enough", [
    (0.95, [], "complete", "not_required", True), (0.5, [], "partial", "pending", False),
    (None, [], "partial", "pending", False), (0.95, [("nombre_inquilino", "x", 0.4, "local_ocr")], "complete", "pending", True)])
def test_quality(spark, paid, extra, level, state, enough):
    rows = [("ruc_contribuyente", COMPANY, 0.98, "native_pdf_text"), ("periodo", "202603", 0.96, "native_pdf_text")]
    rows += [("importe_pagado", "75.00", paid, "native_pdf_text")] if paid else []
    row = records.quality(readings(spark, *rows, *extra)).first()
    assert (row.completitud, row.estado_de_revision, row.suficiente) == (level, state, enough)


def test_corrections(spark):
    df = spark.createDataFrame([(1, RENT), (2, RENT)], "record_id INT, texto STRING")
    built = records.build_record(records.best_field(records.extract_profile_fields(df, "record_id"), "record_id"), "record_id")
    fixes = spark.createDataFrame([(1, "periodo", "abril 2026"), (1, "nombre_inquilino", " ANA "), (2, "periodo", "nada"), (2, "importe_pagado", "10.00")], "record_id INT, campo STRING, valor STRING")
    fixed, rejected = records.apply_corrections(built, fixes)
    rows = {r.record_id: r for r in fixed.collect()}
    assert (rows[1].periodo, rows[1].nombre_inquilino, rows[1].estado_de_revision, rows[1].confianza_por_campo["periodo"]) == ("202604", "ANA", "approved", 1.0)
    assert (rows[2].periodo, rows[2].importe_pagado) == ("202603", Decimal("75.00"))
    assert [(r.record_id, r.campo, r.motivo) for r in rejected.collect()] == [(2, "periodo", "valor_no_valido")]


def test_the_last_correction_of_a_field_counts(spark):
    df = spark.createDataFrame([(1, RENT)], "record_id INT, texto STRING")
    built = records.build_record(records.best_field(records.extract_profile_fields(df, "record_id"), "record_id"), "record_id")
    fixes = spark.createDataFrame([(1, "nombre_inquilino", "ZOE", 1), (1, "nombre_inquilino", "ANA", 2)], "record_id INT, campo STRING, valor STRING, paso INT")
    fixed, _ = records.apply_corrections(built, fixes, order="paso")
    assert fixed.first().nombre_inquilino == "ANA"


def test_names_and_codes(spark):
    assert one(spark, I.clean_name, "JUAN PEREZ RUC 10", "ANA   X", "LIMA SAC;:", None) == ["JUAN PEREZ", "ANA", "LIMA SAC", ""]
    assert one(spark, I.normalize_code, "R. U.C", None) == ["RUC", ""]


PDF = b"%PDF-1.4\n1 0 obj\n" + b" " * 100


@pytest.mark.parametrize("content, name, reason", [
    (PDF, "recibo.pdf", None), (b"\x89PNG\r\n\x1a\n" + b"0" * 80, "foto.pdf", "extension_no_coincide_con_contenido"),
    (b"no soy un documento valido" * 4, "x.pdf", "tipo_no_reconocido"), (b"%PDF-", "x.pdf", "archivo_vacio_o_truncado"),
    (PDF + b"/JavaScript (app.alert)", "malo.pdf", "pdf_con_contenido_activo"), (PDF, "../x.pdf", "nombre_invalido"),
    (PDF + b"1 0 obj " * 90, "x.pdf", "pdf_sospechoso_de_bomba"), (b"RIFF0000WEBP" + b"0" * 80, "a.webp", None), (b"RIFF0000WAVE" + b"0" * 80, "a.webp", "tipo_no_reconocido"),
    (PDF + b" " * 2000, "x.pdf", "tamano_excedido")])
def test_attachments(spark, content, name, reason):
    df = spark.createDataFrame([(content, name)], "content BINARY, nombre STRING")
    row = attachments.validate_attachment(df, 1500).first()
    assert row.motivo == reason and row.ok == (reason is None) and len(row.sha256) == 64


def test_voucher_rows(spark):
    raw = spark.createDataFrame([("20-1", "Factura", "f001", "N 0012"), ("1", "99", "F1", "1"), ("1", "01", "", "1"), ("1", "Boleta", "B1", "x")], "r STRING, t STRING, s STRING, n STRING")
    (row,) = vouchers.read_voucher_list(raw, "r", "t", "s", "n").collect()
    assert (row.id, row.ruc, row.tipo_num, row.tipo_texto) == ("F001-12", "201", 1, "Factura")
    report = vouchers.voucher_report(spark.sql("SELECT 'a' AS id, '01' AS tipo, 'E' AS emisor, '2' AS ruc, true AS pdf, false AS xml, 'OK' AS estado, 'PEN' AS moneda, '5.00' AS monto, 'f' AS fecha, 'd' AS descripcion")).first()
    assert (report.Tipo, report.PDF, report.XML, report.Monto) == ("Factura", "Sí", "No", "PEN 5.00")


def test_pending_and_origin(spark):
    files = spark.sql("SELECT * FROM VALUES (1, 7, 10, 'a.pdf'), (2, 7, 10, 'b.pdf') AS t(id, company_id, message_id, original_name)")
    mails = spark.sql("SELECT 10 AS id, 3 AS job_id, 'x@y' AS sender, 's' AS subject, timestamp'2026-01-01' AS received_at")
    done = spark.sql("SELECT 1 AS attachment_id, 7 AS company_id")
    assert [r.id for r in records.pending_extraction(files, mails, done, 3).collect()] == [2]
    assert records.origin_lookup(done, files, mails).first().nombre_adjunto == "a.pdf"


def test_labels(spark):
    from ledgerlab.operators import field_labels

    for kind in [*documents.FIELDS, "asistencia"]:
        assert all(field_labels.document_labels(kind).values())
    df = spark.createDataFrame([(1, "ENEL")], "doc_id INT, texto STRING")
    shown = field_labels.labelled(documents.extract_fields(df, "recibo_luz"), "recibo_luz", ["doc_id"])
    assert shown.columns[:3] == ["doc_id", "Empresa", "RUC Empresa"] and "Total a Pagar" in shown.columns


def test_labels_are_looked_for_only_where_they_are(spark):
    texts = ["SubTotal 1.50\nigv: 2.00", "İGV S/ 3.00", "ıgv 4.00", "subtotal x\nSUBTOTAL S/ 5.25", "REDONDEOK 1.00", "sin montos", None]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING").withColumn("u", F.upper("t"))
    labels = [["SUBTOTAL", "Sub Total"], ["IGV"], ["REDONDEOK"], ["TOTAL"]]
    rows = df.select(*[X.amount(F.col("t"), x).alias(f"a{k}") for k, x in enumerate(labels)], *[X.amount(F.col("t"), x, F.col("u")).alias(f"b{k}") for k, x in enumerate(labels)]).collect()
    assert [tuple(r)[:4] for r in rows] == [tuple(r)[4:] for r in rows] and [r.b1 for r in rows[:3]] == [2.0, 3.0, 4.0] and rows[4].b2 == 1.0


def test_documents_of_a_small_table_are_dealt_to_all_tasks(spark, tmp_path):
    from ledgerlab.demo import document_queries

    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "id + 0.5D AS o_totalprice", "timestamp_ntz '1995-03-05 00:00:00' AS o_orderdate",
                               "'1-URGENT' AS o_orderpriority").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    found = document_queries.QUERIES["all_invoice_fields"](spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {(r.moneda, r.descripcion) for r in found.collect()} == {("PEN", "Servicio logistico tipo B"), ("USD", "Cemento gris")}
