"""Token ids as Parquet files: one list column, delta-packed ids of documents, small pages with indexes.

`write_tokens` range-partitions the texts by doc_id, sorts each partition and encodes it on the way to the writer, so
files and rows within files ascend by doc_id and nothing but the text is shuffled. In the files

* `ids` is a list column with dictionary pages (a vocabulary fits one dictionary page; an id takes its index's bits),
* `doc_id` and `n_tokens` are written without dictionary in the format's second version, so they are delta-packed,
* row groups and pages are bounded, and column and offset indexes are written: a reader of a few documents, or of
  counts alone, touches those pages only (`read_tokens(..., between)` and `token_starts`).

Defined cases: a null text encodes as the empty text, its row holds the end id alone; a null doc_id sorts first; rows
that repeat a doc_id are kept, ordered by text; an empty table gives empty files and an empty result; further columns
are left out of the files.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlab.llm.bpe import byte_letters
from ledgerlab.llm.tables import ids_and_texts
from ledgerlab.session import shared_folder

ROW_GROUP_BYTES = 32 << 20
PAGE_BYTES = 128 << 10
PAGE_ROWS = 1000
DICTIONARY_BYTES = 2 << 20
# Words a task remembers at most in each of two generations, and their greatest length. They decide speed alone.
REMEMBERED, REMEMBERED_LENGTH = 500_000, 48
# Controls that Python parts words at though the tokenizer's white space does not hold them.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[ \t\n\r]+")
# Marks that end a word. The tokenizer parts them from a letter or digit before them; letters of Latin-1 only, as those
# have no normal form that ends in a combining mark, which would belong with the marks.
_ENDS = ".,;:!?"
_BEFORE_ENDS = re.compile("[A-Za-z0-9\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]\\Z")
# Words that the normalizer leaves alone and the split keeps whole: small letters of Latin-1.
_PLAIN = re.compile("[a-z\u00DF-\u00F6\u00F8-\u00FF]+\\Z")
# The normalizer and the split that words are taken apart by.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LETTERS = {byte: letter for byte, letter in byte_letters().items()}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Ids of a word as little-endian bytes, asked of the library when first met.

    The tokenizer's split never crosses white space and its normalizer works within words, so a text's ids are the ids
    of its words, one after another (pinned by a test against whole texts).
    """

    _loaded: dict[str, "_Words"] = {}

    @classmethod
    def load(cls, path: str) -> "_Words":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if (spec["normalizer"], spec["pre_tokenizer"]) != (NORMALIZER, SPLIT) or any(token["normalized"] for token in spec["added_tokens"]):
            raise ValueError(f"words of {path} can't be encoded one by one: its normalizer or split is another")
        self.added = [token["content"].lower() for token in spec["added_tokens"]]
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            bare = word.rstrip(_ENDS)
            parted = bare and len(bare) < len(word) and _BEFORE_ENDS.search(bare)
            ids = (self.get(bare) or self._asked(bare)) + self[word[len(bare):]] if parted else self._asked(word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:  # words still in use come back from the older generation
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def _asked(self, word: str) -> bytes:
        """Ids by the library; for a plain word its model alone, on the letters that stand for the word's bytes."""
        if _PLAIN.match(word):
            letters = word if word.isascii() else word.encode("utf-8").decode("latin-1").translate(_LETTERS)
            return _packed([token.id for token in self.model.tokenize(letters)])
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text."""
        if _latin(text):
            low = text.lower()  # the same as the tokenizer's own lower case there, and fewer words to remember
            # Added tokens are cut out of the text as it is written: beside one, or what lower case makes one, words stay.
            text = text if any(token in low for token in self.added) else low
        words = _BLANKS.split(text) if _SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


def _latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 1) -> None:
    """Write (doc_id, n_tokens, ids) of every row below `path`, ascending by doc_id; `end_id` closes each document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
    end = b"" if end_id is None else _packed([end_id])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words.load(tokenizer)
        for batch in batches:
            for part in _parts(batch):
                lists = [words.encode(value.as_py()) + end for value in part.column("text")]
                counts = np.fromiter((len(ids) // 4 for ids in lists), np.int64, len(lists))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                values = np.frombuffer(b"".join(lists), "<i4")
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts), ids], schema=schema)

    ordered = ids_and_texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    (ordered.mapInArrow(encode, "doc_id long, n_tokens long, ids array<int>").write
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary#doc_id", "false").option("parquet.enable.dictionary#n_tokens", "false")
        .option("parquet.dictionary.page.size", str(DICTIONARY_BYTES)).option("parquet.block.size", str(ROW_GROUP_BYTES))
        .option("parquet.page.size", str(PAGE_BYTES)).option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .parquet(path))


def _parts(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in pieces, so that ids of few texts are in memory at once."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def read_tokens(spark: SparkSession, path: str, between: tuple[int, int] | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) of the files, or of a range of doc_id: other row groups and pages are skipped."""
    tokens = spark.read.parquet(path)
    return tokens if between is None else tokens.filter(F.col("doc_id").between(*between))


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, start): the ids in all documents before each row. Reads the counts alone, not the ids.

    Running sums are taken per file; what earlier files hold comes from one row per file.
    """
    counts = spark.read.parquet(path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "n_tokens")
    files = counts.groupBy("file").agg(F.sum("n_tokens").alias("held"))
    number = F.regexp_extract("file", r"part-(\d+)", 1).cast("long")  # names ascend as text only up to five digits
    earlier = Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = files.select("file", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (counts.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
            .join(files, "file").select("file", "row", (F.col("offset") + F.col("inside")).alias("start")))


def checked(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the files, the checksum taken from the ids that were read."""
    schema = pa.schema([("doc_id", pa.int64()), ("file", pa.string()), ("row", pa.int64()), ("n_tokens", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets = ids.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(values[4 * a:4 * b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("file").cast(pa.string()), batch.column("row"),
                 pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], schema=schema)

    rows = spark.read.parquet(path).select(
        "doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    sums = rows.mapInArrow(digest, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
    return sums.join(token_starts(spark, path), ["file", "row"]).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_folder(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
