"""Byte-level BPE: encoding by a queue of merge ranks over a linked list of symbols, decoding by vocabulary strings.

Each piece of a text (the split of the tokenizer file's byte-level pre-tokenizer) becomes a doubly linked list of byte
symbols. A heap holds (rank, position) of every adjacent pair that has a merge; the least is taken, entries whose
symbols have changed since are skipped, and the two neighbours of the joined symbol are pushed anew. A piece of n bytes
costs O(n log n), whatever its length. Pieces already seen by a task are looked up in a table of bounded size.

Defined cases: a null text encodes as the empty text (no ids); texts of any length are encoded whole; rows are
independent, so repeated rows and ids give the same result each; an empty table gives an empty result; further columns
are passed through by `encode` and ignored by the query. Strings of added tokens are cut out first, as the file says.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.llm.tables import ids_and_texts

# Fixed value: how the byte-level pre-tokenizer splits a text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Pieces that a task remembers at most, in each of two generations. It decides speed alone.
REMEMBERED = 300_000
# Longer pieces are not remembered, so that the table's memory is bounded.
REMEMBERED_BYTES = 64


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte: itself where printable in Latin-1, else the next from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [byte for byte in range(256) if byte not in shown]
    return {byte: chr(byte) for byte in shown} | {byte: chr(0x100 + k) for k, byte in enumerate(hidden)}


class _Table(dict):
    """Ids of pieces as little-endian bytes, computed when first asked for."""

    def __init__(self, codec: "Codec"):
        super().__init__()
        self.codec = codec
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = np.asarray(self.codec.merge(piece.encode("utf-8")), "<u4").tobytes()
        if len(piece) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:  # pieces still in use come back from the older generation
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """One tokenizer file (byte-level BPE without normalizer), loaded once per task process."""

    _loaded: dict[str, "Codec"] = {}

    @classmethod
    def load(cls, path: str) -> "Codec":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        byte_of = {letter: byte for byte, letter in byte_letters().items()}
        raw = lambda token: bytes(byte_of[letter] for letter in token)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(token): number for token, number in vocab.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[left], vocab[right]] = rank, vocab[left + right]
        added = {token["content"]: token["id"] for token in spec["added_tokens"]}
        size = max([*vocab.values(), *added.values()]) + 1
        self.strings: list[bytes] = [b""] * size
        for token, number in self.ids.items():
            self.strings[number] = token
        for token, number in added.items():
            self.strings[number] = token.encode("utf-8")
        self.added = {token: np.asarray([number], "<u4").tobytes() for token, number in added.items()}
        longest_first = sorted(added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")") if added else None
        self.pieces = regex.compile(PIECES)
        self.table = _Table(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        symbols = [self.ids[piece[k:k + 1]] for k in range(len(piece))]
        count = len(symbols)
        before, after = list(range(-1, count - 1)), list(range(1, count + 1))
        queue: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < count:
                found = self.merges.get((symbols[left], symbols[right]))
                if found:
                    heapq.heappush(queue, (found[0], left, symbols[left], symbols[right]))

        for position in range(count - 1):
            offer(position)
        while queue:
            _, left, first, second = heapq.heappop(queue)
            right = after[left]
            if symbols[left] != first or right >= count or symbols[right] != second:
                continue  # stale: one of the two has been joined to another since
            symbols[left] = self.merges[first, second][1]
            symbols[right] = -1
            after[left] = after[right]
            if after[left] < count:
                before[after[left]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [symbol for symbol in symbols if symbol >= 0]

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        look = self.table.__getitem__
        if self.cut is None or not any(token in text for token in self.added):
            return b"".join(map(look, self.pieces.findall(text)))
        parts = self.cut.split(text)
        return b"".join(
            self.added[part] if part in self.added else b"".join(map(look, self.pieces.findall(part))) for part in parts)

    def decode(self, ids: bytes) -> str:
        """The text of ids: their vocabulary strings, one after another."""
        numbers = np.frombuffer(ids, "<u4").tolist()
        return b"".join(map(self.strings.__getitem__, numbers)).decode("utf-8", "replace")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """`docs` with a further column of token ids (array of int), by the tokenizer file at `path`."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def of(texts):
        codec = Codec.load(path)
        return texts.map(lambda value: np.frombuffer(codec.encode(value or ""), "<u4").astype(np.int32))

    return docs.withColumn(ids, of(F.col(text)))


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """`encoded` with a further column of the text that its ids stand for; null ids give the empty text."""

    @F.pandas_udf("string")
    def of(lists):
        codec = Codec.load(path)
        return lists.map(lambda value: codec.decode(np.asarray([] if value is None else value, "<u4").tobytes()))

    return encoded.withColumn(text, of(F.col(ids)))


DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


# Ids that leave a task at once where they are asked for.
IDS_AT_ONCE = 1 << 20


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row: encoded, then decoded from the ids alone.

    Ids live only inside the task, a text at a time, so memory is bounded by the longest text of a batch. With `with_ids` a
    further column `ids` has them, in small batches.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.load(path)
        for batch in batches:
            rows, held = [], 0
            for doc_id, value in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                ids = codec.encode(value.as_py())
                decoded = hashlib.sha256(codec.decode(ids).encode("utf-8")).hexdigest()
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), decoded, *([ids] if with_ids else [])))
                held += len(ids) // 4 if with_ids else 0
                if held >= IDS_AT_ONCE:
                    yield _rows(rows, schema)
                    rows, held = [], 0
            if rows:
                yield _rows(rows, schema)

    return ids_and_texts(docs).mapInArrow(digest, DIGESTS + (", ids array<int>" if with_ids else ""))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array([value.as_py() for value in columns[0]], pa.int64())]
    arrays += [pa.array(column, field.type) for column, field in zip(columns[1:4], list(schema)[1:4], strict=True)]
    if len(columns) > 4:
        offsets = np.concatenate([[0], np.cumsum(columns[1])]).astype(np.int32)
        arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(columns[4]), "<i4"), pa.int32())))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
