"""Attachment checks over file bytes, and content-hash deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlab.functions.text import rx

# Limits, signatures (hex) with mime and extensions, active-content markers.
MIN_BYTES, MAX_PAGES, MAX_OBJECTS, MAX_OBJECTS_PER_KB = 64, 500, 50_000, 40
SIGNATURES = [
    ("255044462D", "application/pdf", [".pdf"]),
    ("FFD8FF", "image/jpeg", [".jpg", ".jpeg"]),
    ("89504E470D0A1A0A", "image/png", [".png"]),
    ("52494646", "image/webp", [".webp"]),
]
WEBP_MARK = "57454250"
SAFE_NAME = r"^[\w\s.,()\[\]\-+#&@]{1,255}$"
PAGE_MARK = r"/Type\s*/Page(?![s/\w])"
ACTIVE = ["/JavaScript", "/JS ", "/Launch", "/EmbeddedFile"]


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def _head(content: Column, start: int, size: int) -> Column:
    return F.hex(F.substring(content, start, size))


def mime_of(content: Column) -> Column:
    """Mime type by signature, NULL when none fits."""
    out = None
    for signature, mime, _ in SIGNATURES:
        hit = _head(content, 1, len(signature) // 2) == signature
        if mime == "image/webp":
            hit = hit & (_head(content, 9, 4) == WEBP_MARK)
        out = F.when(hit, mime) if out is None else out.when(hit, mime)
    return out


def _bad_name(name: Column) -> Column:
    unsafe = name.contains("\x00") | name.contains("/") | name.contains("\\") | name.contains("..")
    return F.coalesce(name, F.lit("")).eqNullSafe("") | unsafe | ~name.rlike(rx(SAFE_NAME))


def _pdf_reason(content: Column) -> Column:
    # One character per byte, so that text functions count bytes.
    text = F.decode(content, "ISO-8859-1")
    objects = F.regexp_count(text, F.lit(" obj"))
    kilobytes = F.greatest(F.floor(F.length(content) / 1024), F.lit(1))
    active = text.contains(ACTIVE[0])
    for mark in ACTIVE[1:]:
        active = active | text.contains(mark)
    return (
        F.when(objects > MAX_OBJECTS, "pdf_demasiados_objetos")
        .when(objects / kilobytes > MAX_OBJECTS_PER_KB, "pdf_sospechoso_de_bomba")
        .when(F.regexp_count(text, F.lit(PAGE_MARK)) > MAX_PAGES, "pdf_demasiadas_paginas")
        .when(active, "pdf_con_contenido_activo"))


def validate_attachment(files: DataFrame, max_bytes: int, content: str = "content", name: str = "nombre") -> DataFrame:
    """Append ok, mime, sha256 and motivo (the first reason to reject, NULL when fine)."""
    data, label = F.col(content), F.col(name)
    mime = mime_of(data)
    fits = F.lit(False)
    for _, kind, extensions in SIGNATURES:
        for extension in extensions:
            fits = fits | ((mime == kind) & F.lower(label).endswith(extension))
    early = (
        F.when(F.length(data) < MIN_BYTES, "archivo_vacio_o_truncado").when(F.length(data) > max_bytes, "tamano_excedido")
        .when(_bad_name(label), "nombre_invalido"))
    reason = F.coalesce(
        early, F.when(mime.isNull(), "tipo_no_reconocido").when(~fits, "extension_no_coincide_con_contenido")
        .when(mime == "application/pdf", _pdf_reason(data)))
    shown = F.when(early.isNotNull() | mime.isNull(), "").otherwise(mime)
    return files.withColumns({"sha256": content_hash(data), "mime": shown, "motivo": reason}).withColumn("ok", F.col("motivo").isNull())


def new_attachments(files: DataFrame, stored: DataFrame, company: str = "company_id") -> DataFrame:
    """Validated files whose (company, hash) is not stored yet, one per hash.

    Which paths are new is decided on hashes alone; contents are then picked by path, so many
    copies of one file do not meet in one task.
    """
    key = [company, "sha256"]
    first = files.filter("ok").groupBy(key).agg(F.min("path").alias("path"))
    chosen = first.join(stored.select(key), key, "left_anti").select("path")
    return files.filter("ok").join(chosen, "path", "left_semi")
