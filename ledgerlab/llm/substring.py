"""Removing passages that another document has already: repeated windows of a fixed number of words.

1. Rabin-Karp hashes of every window of a text are taken in numpy, once per distinct window of a batch of documents
   (with the least doc_id of the batch), and dealt out by the hash's first bits to `parts`: a row holds all hashes of
   one batch for one part, packed seven bytes each, so a window costs some eight bytes of shuffle instead of a row.
2. Spark groups by part. Within one the least doc_id of every window over the whole table is found, and each document
   with a greater id gets its repeated hashes back. A passage in a third of all documents is one entry per batch; its
   other places in the batch are answers at once and are grouped with nothing.
3. Documents meet their repeated hashes by doc_id, the windows become maximal intervals of words, and those go.

The number of parts follows from the input's bytes, so that a part holds some three million windows at any scale.
Hashes are of 64 bits at least (7 bytes and the part's bits, up to 64): two different windows of one part are taken for
one with a probability of about 4e-11 a window.

Defined cases: a null or empty text has no words: nothing to remove, the digest of the empty text; texts shorter than a
window stay; rows without doc_id neither remove nor lose words; rows of one doc_id are one document, each row judged
against smaller ids only; an empty table gives an empty result; further columns are ignored. Windows are judged on
the input: a passage removed from one document still removes it from later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.llm.tables import ids_and_texts
from ledgerlab.llm.words import window_hashes, word_hashes, words_of

WIDTH = 13
# Bytes of text for each part: about six a window, so three million windows.
PART_BYTES = 18 << 20
LEAST_BITS = 6
# Windows that a task gathers before it packs them.
BATCH_WINDOWS = 1_000_000


def _packed(hashes: np.ndarray) -> bytes:
    """Seven low bytes of each hash; the part's number stands for high ones."""
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 7, 8), np.uint8)
    wide[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return wide.view("<u8").reshape(-1)


LOW = np.uint64((1 << 56) - 1)


def _dealt(ids: np.ndarray, hashes: np.ndarray, shift: int) -> Iterator[tuple]:
    """Rows (part, ids, counts, hashes) of a batch: the least id of each hash, by part.

    A hash that a smaller id of the batch has is known to be repeated: it is an answer already. All of a batch's answers are
    one row whose part is a negative number of the batch's own, so they meet no other batch's.
    """
    order = np.lexsort((ids, hashes))
    ids, hashes = ids[order], hashes[order]
    first = np.ones(len(hashes), bool)
    first[1:] = hashes[1:] != hashes[:-1]
    least = ids[np.flatnonzero(first)][np.cumsum(first) - 1]
    again = ids > least
    for known, pick in ((False, first), (True, again)):
        own, held = ids[pick], hashes[pick]
        if not len(own):
            continue
        if known:
            part = np.full(len(own), -1 - (xxhash.xxh32_intdigest(own.tobytes() + held.tobytes()) >> 1))
        else:
            part = (held >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(own), np.int64)
        order = np.lexsort((own, part))
        own, held, part = own[order], held[order], part[order]
        edges = np.flatnonzero(np.diff(part, prepend=part[0] - 1))
        for start, end in zip(edges, np.append(edges[1:], len(part)), strict=True):
            docs, counts = np.unique(own[start:end], return_counts=True)
            yield int(part[start]), docs.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), _packed(held[start:end])


PART_ROWS = "part int, ids binary, counts binary, hashes binary"
PART_SCHEMA = pa.schema([("part", pa.int32()), ("ids", pa.binary()), ("counts", pa.binary()), ("hashes", pa.binary())])
ANSWERS = "doc_id long, hashes binary"
ANSWER_SCHEMA = pa.schema([("doc_id", pa.int64()), ("hashes", pa.binary())])


def windows_by_part(docs: DataFrame, width: int, shift: int) -> DataFrame:
    """(part, ids, counts, hashes): the distinct windows of batches of documents, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[np.ndarray] = []
        hashes: list[np.ndarray] = []
        held = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows = list(_dealt(np.concatenate(ids), np.concatenate(hashes), shift)) if ids else []
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind.type) for column, kind in zip(zip(*rows, strict=True), PART_SCHEMA, strict=True)],
                    schema=PART_SCHEMA)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                found = window_hashes(word_hashes(words_of(text.as_py())), width)
                if doc_id is None or not len(found):
                    continue
                found = np.unique(found)
                ids.append(np.full(len(found), doc_id, np.int64))
                hashes.append(found)
                held += len(found)
                if held >= BATCH_WINDOWS:
                    yield from out()
                    ids, hashes, held = [], [], 0
        yield from out()

    return docs.mapInArrow(pack, PART_ROWS)


def repeated_windows(packed: DataFrame) -> DataFrame:
    """(doc_id, hashes): for each document the windows that a smaller doc_id has too; several rows per document."""

    def split(ids: np.ndarray, hashes: np.ndarray) -> pa.Table:
        order = np.argsort(ids, kind="stable")
        ids, hashes = ids[order], hashes[order]
        docs, starts = np.unique(ids, return_index=True)
        ends = [*starts[1:], len(ids)]
        data = [_packed(hashes[a:b]) for a, b in zip(starts, ends, strict=True)] if len(docs) else []
        return pa.Table.from_arrays([pa.array(docs, pa.int64()), pa.array(data, pa.binary())], schema=ANSWER_SCHEMA)

    def judge(table: pa.Table) -> pa.Table:
        ids, hashes = [], []
        for row_ids, counts, data in zip(table["ids"], table["counts"], table["hashes"], strict=True):
            ids.append(np.repeat(np.frombuffer(row_ids.as_py(), "<i8"), np.frombuffer(counts.as_py(), "<u4")))
            hashes.append(_unpacked(data.as_py()))
        ids, hashes = np.concatenate(ids), np.concatenate(hashes)
        if table["part"][0].as_py() < 0:
            return split(ids, hashes)
        order = np.lexsort((ids, hashes))
        ids, hashes = ids[order], hashes[order]
        first = np.ones(len(hashes), bool)
        first[1:] = hashes[1:] != hashes[:-1]
        again = ids > ids[np.flatnonzero(first)][np.cumsum(first) - 1]
        return split(ids[again], hashes[again])

    return packed.groupBy("part").applyInArrow(judge, ANSWERS)


def covered(repeated: np.ndarray, n_words: int, width: int) -> np.ndarray:
    """Which words lie in a repeated window: starts of windows become maximal intervals of words."""
    edges = np.zeros(n_words + 1, np.int64)
    starts = np.flatnonzero(repeated)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return np.cumsum(edges[:-1]) > 0


def intervals(removed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of removed words as (start, end), end exclusive."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], removed.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _parts(docs: DataFrame, part_bytes: int) -> int:
    """Bits of the part's number, from the table's bytes of text; 64 parts at least, for parallelism."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(LEAST_BITS, int(np.ceil(np.log2(max(1, total / part_bytes)))))


def without_repeats(docs: DataFrame, width: int = WIDTH, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, n_words, removed, kept) of every row: intervals of removed words, and the text that stays."""
    texts = ids_and_texts(docs)
    packed = windows_by_part(texts, width, 64 - _parts(texts, part_bytes))
    repeated = repeated_windows(packed).groupBy("doc_id").agg(F.collect_list("hashes").alias("repeated"))
    joined = texts.join(repeated.hint("shuffle_hash"), "doc_id", "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, spans, kept = [], [], []
            for text, again in zip(batch.column("text"), batch.column("repeated").to_pylist(), strict=True):
                words = words_of(text.as_py())
                removed = np.zeros(len(words), bool)
                if again:
                    own = window_hashes(word_hashes(words), width) & LOW
                    removed = covered(np.isin(own, _unpacked(b"".join(again))), len(words), width)
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in intervals(removed)])
                kept.append(b" ".join(word for word, gone in zip(words, removed.tolist(), strict=True) if not gone)
                            if again else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, CUT_SCHEMA.field("removed").type),
                 pa.array([value.decode("utf-8", "surrogatepass") for value in kept], pa.string())], schema=CUT_SCHEMA)

    return joined.select("doc_id", "text", "repeated").mapInArrow(cut, CUTS)


CUTS = "doc_id long, n_words long, removed array<struct<start: long, end: long>>, kept string"
CUT_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()),
    ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.string())])


def digest(cut: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of what `without_repeats` gives."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda total, run: total + run["end"] - run["start"])
    return cut.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2(F.encode("kept", "utf-8"), 256).alias("kept_sha256"))


