"""Best-fit packing of token sequences: large-item matching, then small pieces into the tightest gaps.

1. `pieces` encodes every text, closes it with an end id and cuts what is longer than the capacity.
2. The plan needs only how many pieces there are of each length, at most `capacity` numbers:
   * a piece above a third of the capacity meets at most one other such piece in a sequence: from the longest down, each
     is matched with the longest remaining one that fits beside it;
   * shorter pieces, from the longest down, go into the tightest gap that holds them, and into a new sequence where none
     does. Pieces of one length are placed in groups: once one is in the tightest gap, what is left of that gap is the
     tightest for the next, so a gap of g takes g div l of them and equal gaps are treated alike. A length adds at most
     three groups of sequences, whatever the number of pieces.
3. `placed` numbers the pieces of each length (a number within the task that cut them, and an offset by task from the
   counts) and looks the place of that number up in the plan. No piece moves through the driver, and no window gathers
   the pieces of a length.

Within a task a text's ids are those of its words: the tokenizer's split never lets a piece begin before a single space
and end behind it. Words already seen are looked up in a table of bounded size; others go to a rank-merging encoder built
from the same file. Texts with runs of spaces are encoded whole. Tests hold the ids against the tokenizers library.

Defined cases: a null text is empty, its one piece is the end id; a text of exactly the capacity is not cut; of a longer
one the first piece takes what is over; rows that repeat a doc_id, or have none, are documents of their own; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlab.llm.bpe import PIECES, Codec
from ledgerlab.llm.tables import ids_and_texts
from ledgerlab.session import cut_lineage

CAPACITY, END_ID = 2048, 0
# Words that a task remembers at most in each of two generations, and their greatest length. They decide speed alone.
REMEMBERED, REMEMBERED_LENGTH = 400_000, 48
# White space at least this long is split by another engine.
LONG_BLANK = 1000
_BLANKS = re.compile(rf"\s{{{LONG_BLANK}}}")
# Ids that leave a task at once.
IDS_AT_ONCE = 1 << 20


class _Words(dict):
    """Ids of a word behind a space, as little-endian bytes, computed when first asked for."""

    _loaded: dict[str, "_Words"] = {}

    @classmethod
    def load(cls, path: str) -> "_Words":
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        self.codec = Codec.load(path)
        ranks = {token: number for token, number in self.codec.ids.items() if token.decode("utf-8", "replace") not in self.codec.added}
        # The encoder merges by the id of the joined token: the same as by rank where ids follow the merges' order.
        if any(number - rank != 256 for rank, number in self.codec.merges.values()):
            raise ValueError(f"ids of {path} do not follow its merges")
        self.encoder = tiktoken.Encoding("file", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        self.older: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        if len(text) > LONG_BLANK and _BLANKS.search(text):  # the encoder's split would run out of stack on these
            return self.codec.encode(text)
        return np.asarray(self.encoder.encode_ordinary(text), "<u4").tobytes()

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.whole(" " + word)
        if len(word) <= REMEMBERED_LENGTH:
            if len(self) >= REMEMBERED:  # words still in use come back from the older generation
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        if "  " in text:
            return self.whole(text)
        first, *others = text.split(" ")
        return self.whole(first) + b"".join(map(self.__getitem__, others))

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        added = self.codec.added
        if not any(token in text for token in added):
            return self.plain(text)
        return b"".join(added[part] if part in added else self.plain(part) for part in self.codec.cut.split(text))


def cut_places(count: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of `count` ids: whole ones behind a first that may be shorter."""
    first = count - (-(-count // capacity) - 1) * capacity
    return [(0, first), *((start, capacity) for start in range(first, count, capacity))]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, task, nth) of every piece; nth counts the pieces of a length within a task."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()),
                        ("ids", pa.list_(pa.int32())), ("task", pa.int64()), ("nth", pa.int64())])
    end = np.asarray([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task, seen = _Words.load(path), TaskContext.get().partitionId(), Counter()
        rows: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            doc_id, piece, start, length, ids, nth = zip(*rows, strict=True)
            offsets = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32()))
            return pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int32()), lists, pa.array([task] * len(rows), pa.int64()), pa.array(nth, pa.int64())],
                schema=schema)

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = words.encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut_places(len(ids) // 4, capacity)):
                    rows.append((doc_id, piece, start, length, ids[4 * start:4 * (start + length)], seen[length]))
                    seen[length] += 1
                    held += length
                    if held >= IDS_AT_ONCE:
                        yield flush()
                        rows, held = [], 0
        if rows:
            yield flush()

    return ids_and_texts(docs).mapInArrow(
        cut, "doc_id long, piece int, start long, length int, ids array<int>, task long, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first, each, sequence, offset): pieces number first, first + 1, ... of a length go `each` to a sequence.

    The first of them is at `offset` of `sequence`; runs end where the next one of the same length begins.
    """
    placed: list[tuple[int, int, int, int, int]] = []
    left = {length: count for length, count in counts.items() if count}
    used = Counter()  # pieces of a length that have a place
    sequences = 0
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, number of sequences), ascending

    def put(length: int, each: int, sequence: int, offset: int, count: int) -> None:
        placed.append((length, used[length], each, sequence, offset))
        used[length] += count

    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        place = bisect_left(large, capacity - length + 1) - 1  # the longest one that fits beside it
        if place < 0:
            many = left[length]
            put(length, 1, sequences, 0, many)
            gap = capacity - length
            left[length] = 0
        elif (partner := large[place]) == length and left[length] > 1:
            many = left[length] // 2
            put(length, 2, sequences, 0, 2 * many)
            gap = capacity - 2 * length
            left[length] -= 2 * many
        elif partner == length:  # the last of its length: the next shorter one, if any
            many, gap = 1, capacity - length
            put(length, 1, sequences, 0, 1)
            left[length] = 0
            if place:
                partner = large[place - 1]
                put(partner, 1, sequences, length, 1)
                gap -= partner
                left[partner] -= 1
                if not left[partner]:
                    large.remove(partner)
        else:
            many = min(left[length], left[partner])
            put(length, 1, sequences, 0, many)
            put(partner, 1, sequences, length, many)
            gap = capacity - length - partner
            left[length] -= many
            left[partner] -= many
            if not left[partner]:
                large.remove(partner)
        if not left[length]:
            large.remove(length)
        if gap:
            insort(gaps, (gap, sequences, many))
        sequences += many
    for length in sorted((length for length in left if 3 * length <= capacity), reverse=True):
        count = left[length]
        while count:
            place = bisect_left(gaps, (length, -1, -1))
            if place < len(gaps):
                gap, sequence, many = gaps.pop(place)
            else:  # no gap holds it: as many new sequences as it fills
                gap, sequence, many = capacity, sequences, -(-count // (capacity // length))
                sequences += many
            each = gap // length
            full = min(many, count // each)
            rest = count - full * each if full < many else 0
            if full:
                put(length, each, sequence, capacity - gap, full * each)
                if gap - each * length:
                    insort(gaps, (gap - each * length, sequence, full))
            if rest:
                put(length, rest, sequence + full, capacity - gap, rest)
                insort(gaps, (gap - rest * length, sequence + full, 1))
            untouched = many - full - (rest > 0)
            if untouched:
                insort(gaps, (gap, sequence + full + (rest > 0), untouched))
            count -= full * each + rest
    return placed


def _place_of(rows: Iterable[tuple[int, int, int, int, int]]):
    """Column function (length, number) -> (sequence_id, offset) of a plan."""
    length, first, each, sequence, offset = (np.asarray(column, np.int64) for column in zip(*sorted(rows), strict=True))

    @F.pandas_udf("sequence_id long, offset long")
    def of(lengths, numbers):
        import pandas as pd

        lengths, numbers = lengths.to_numpy(np.int64), numbers.to_numpy(np.int64)
        # Runs are in order of length and first number: the last one that begins at or before the piece's.
        begins, ends = np.searchsorted(length, lengths), np.searchsorted(length, lengths, "right")
        run = begins.copy()
        width = ends - begins
        while (width > 1).any():  # all pieces halve their ranges of runs together
            half = width // 2
            right = (half > 0) & (first[run + half] <= numbers) if len(run) else half > 0
            run = np.where(right, run + half, run)
            width = np.where(right, width - half, half)
        inside = numbers - first[run]
        return pd.DataFrame({"sequence_id": sequence[run] + inside // each[run],
                             "offset": offset[run] + inside % each[run] * lengths})

    return of


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`pieces`, or some of its columns and others, with (sequence_id, offset) instead of (task, nth)."""
    cut = cut_lineage(cut, "packing-pieces")  # numbers within tasks must stay as they are
    counts = cut_lineage(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("many")), "packing-counts")
    totals = {row["length"]: row["many"] for row in counts.groupBy("length").agg(F.sum("many").alias("many")).collect()}
    runs = plan(totals, capacity)
    if not runs:
        return cut.drop("task", "nth").withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    earlier = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    before = counts.select("length", "task", F.coalesce(F.sum("many").over(earlier), F.lit(0)).alias("before"))
    numbered = cut.join(before, ["length", "task"])
    place = _place_of(runs)(F.col("length"), F.col("before") + F.col("nth"))
    columns = [name for name in cut.columns if name not in ("task", "nth")]
    return numbered.withColumn("place", place).select(*columns, "place.sequence_id", "place.offset")


def packed(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece of every document."""
    return placed(pieces(docs, path, capacity, end_id), capacity)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the training sequences of `packed`, each at most a capacity long."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    rows = packed_pieces.groupBy("sequence_id").agg(ordered.alias("held"))
    return rows.select("sequence_id", F.flatten(F.col("held")["ids"]).alias("ids"), F.col("held")["doc_id"].alias("doc_ids"))


def ids_crc32(ids: str) -> Column:
    """Unsigned crc32 of a column of ids as little-endian unsigned 32-bit integers."""

    @F.pandas_udf("long")
    def of(lists):
        return lists.map(lambda values: zlib.crc32(np.asarray(values, "<u4").tobytes()))

    return of(F.col(ids))


def places(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): as `packed`, with a checksum in place of the ids.

    The checksum is taken before pieces are numbered and placed, so no ids are stored or shuffled.
    """
    cut = pieces(docs, path, capacity, end_id)
    return placed(cut.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"),
                             ids_crc32("ids").alias("ids_crc32"), "task", "nth"), capacity)
