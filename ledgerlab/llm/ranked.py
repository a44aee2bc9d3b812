"""Ranked lexical search: the best documents of every item, by branch and bound over trees of documents.

1. Items are grouped into blocks of a bounded number of terms. Every document is restricted to the terms of a block:
   a vector of (term, occurrences), terms in order of document frequency, the most frequent first.
2. Vectors are range-sorted, so that documents that share their most frequent terms lie in one partition, side by side.
   A task takes some hundreds of them at a time as a tree: vectors with a common beginning share its path, chains without a
   branch are one edge, and the documents below a node are neighbours in the sorted order. A node knows the greatest
   occurrences of every term below it, the least length norm m and the least doc_id.
3. A score grows with occurrences and falls with m, so these three bound the score of every document below the node, for
   each item by its own terms. The tree is walked depth first, from the most promising child on; an item goes down into a child only while
   the bound beats its k-th best so far (at equal scores: while a smaller doc_id may be there), and its best of earlier
   trees of the task count. The bound of a single document is its score.
4. A task gives k rows an item at most; Spark ranks them.

Scores are whole numbers held in doubles where they stay below 2**53, else in 64-bit integers: both exact.

Defined cases: a document with null or empty text or without any term is in no count and no result; documents without a
doc_id count, and come last among equal scores; rows that repeat a doc_id are documents of their own; an item without
terms has no result; items that repeat an item_id and its terms are one, the same item_id with other terms gives results
of its own; a null item_id is an item like others; empty tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlab.session import cut_lineage

K = 10
# Terms (with repeats over items) and items that one pass over the documents takes: what is broadcast and held by a task.
BLOCK_TERMS, BLOCK_ITEMS = 16_384, 256
# Documents of a tree, and of a node that is not divided further. They decide speed and memory alone.
TREE_DOCS, LEAF_DOCS = 512, 12
# Terms that decide in which partition a document lies.
RANGE_TERMS = 12
NO_ID = np.iinfo(np.int64).max
# Letters, digits and every byte of other characters are parts of terms; the other bytes part them; A-Z become small.
_BYTES = bytes(byte if byte >= 0x80 or chr(byte).isalnum() else 0x20 for byte in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return text.translate(_BYTES).split()


def _bytes_of(column) -> Iterator[bytes]:
    return (value.as_py() or b"" for value in column)


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, item, terms) of different items: `item` stands for a set of terms."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [sorted(set(terms_of(text))) for text in _bytes_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(lists, pa.list_(pa.binary()))],
                                             names=["item_id", "terms"])

    rows = items.select(items["item_id"].cast("long").alias("item_id"), items["text"].cast("binary").alias("text"))
    rows = rows.mapInArrow(split, "item_id long, terms array<binary>").filter(F.size("terms") > 0)
    key = F.sha2(F.array_join(F.transform("terms", F.hex), " "), 256)
    return rows.withColumn("item", key).dropDuplicates(["item_id", "item"])


def restricted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term: its size, and its terms in the vocabulary with their occurrences."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())),
                        ("times", pa.list_(pa.int32()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.get
        for batch in batches:
            ids, sizes, terms, times, ends = [], [], [], [], [0]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), _bytes_of(batch.column("text")), strict=True):
                words = terms_of(text)
                if not words:
                    continue
                held = Counter(map(number, words))
                held.pop(None, None)
                ids.append(doc_id)
                sizes.append(len(words))
                terms.extend(held.keys())
                times.extend(held.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times, pa.int32()))], schema=schema)

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("binary").alias("text"))
    return rows.filter("octet_length(text) > 0").mapInArrow(count, "doc_id long, n long, terms array<int>, times array<int>")


def _ranked_vectors(vectors: DataFrame, rank: np.ndarray, documents: int, length: int) -> DataFrame:
    """(doc_id, m, ranks, times): terms as ranks of document frequency, ascending; m is the length norm."""
    schema = pa.schema([("doc_id", pa.int64()), ("m", pa.int64()), ("ranks", pa.list_(pa.int32())),
                        ("times", pa.list_(pa.int32()))])

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            offsets = batch.column("terms").offsets.to_numpy()
            ranks = rank[batch.column("terms").flatten().to_numpy(zero_copy_only=False)]
            times = batch.column("times").flatten().to_numpy(zero_copy_only=False)
            placed = np.lexsort((ranks, np.repeat(np.arange(batch.num_rows), np.diff(offsets))))
            offsets = pa.array(offsets - offsets[0])
            norms = [100 - 90 + 90 * n * documents // length for n in batch.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(norms, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(ranks[placed], pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(times[placed], pa.int32()))], schema=schema)

    return vectors.filter(F.size("terms") > 0).mapInArrow(order, "doc_id long, m long, ranks array<int>, times array<int>")


class Best:
    """The k best (score, doc_id) of every item so far."""

    def __init__(self, items: int, k: int):
        self.scores = np.zeros((items, k), np.int64)
        self.ids = np.full((items, k), np.iinfo(np.int64).min)  # an empty place is beaten by scores above 0 alone
        self.k = k

    def beats(self, items: np.ndarray, bounds: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Whether a bound (rows: nodes with their least doc_id, columns: items) may still enter."""
        last = self.scores[items, -1]
        return (bounds > last) | ((bounds == last) & (ids[:, None] < self.ids[items, -1]))

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[item], scores]), np.concatenate([self.ids[item], ids])
        first = np.lexsort((ids, -scores))[:self.k]
        self.scores[item], self.ids[item] = scores[first], ids[first]


class Tree:
    """Documents in order of their rank vectors; a node is a range of neighbours."""

    def __init__(self, ids: np.ndarray, norms: np.ndarray, vectors: list[np.ndarray], times: list[np.ndarray]):
        self.ids, self.norms = ids, norms
        self.terms, place = np.unique(np.concatenate(vectors), return_inverse=True)
        self.times = np.zeros((len(ids), len(self.terms)), np.int64)
        self.times[np.repeat(np.arange(len(ids)), [len(vector) for vector in vectors]), place] = np.concatenate(times)
        self.shared = np.fromiter(map(_common, vectors, vectors[1:]), np.int64, len(vectors) - 1)

    def children(self, low: int, high: int) -> np.ndarray:
        """Where the children of a node begin: its documents part where their common path is shortest."""
        if high - low <= LEAF_DOCS:
            return np.arange(low, high)
        shared = self.shared[low:high - 1]
        return np.concatenate([[low], low + 1 + np.flatnonzero(shared == shared.min())])

    def search(self, asked: np.ndarray, weights: np.ndarray, best: Best) -> None:
        """Walk the tree; `asked` (terms x items) says which terms an item has, both by rank."""
        wanted, every = asked[self.terms], np.arange(asked.shape[1])
        stack = [(0, len(self.ids), np.arange(len(self.terms)), wanted, every, None)]
        while stack:
            low, high, columns, wanted, items, bound = stack.pop()
            if bound is not None:  # the k-th best may have risen since the node was put aside
                still = best.beats(items, bound[None], self.ids[low:high].min()[None])[0]
                if not still.any():
                    continue
                wanted, items = wanted[:, still], items[still]
            starts = self.children(low, high)
            ends = np.append(starts[1:], high)
            below = self.times[low:high, columns]
            times = np.maximum.reduceat(below, starts - low, axis=0)
            held = np.flatnonzero(times.any(0))
            times, columns, wanted = times[:, held], columns[held], wanted[held]
            norms = np.minimum.reduceat(self.norms[low:high], starts - low)
            ids = np.minimum.reduceat(self.ids[low:high], starts - low)
            gains = weights[self.terms[columns]] * ((1_000_000_000 * times) // (1000 * times + 8 * norms[:, None]))
            bounds = (gains.astype(wanted.dtype) @ wanted).astype(np.int64)
            open_ = best.beats(items, bounds, ids)
            single = ends - starts == 1
            for place in np.flatnonzero((open_ & single[:, None]).any(0)):
                rows = np.flatnonzero(open_[:, place] & single)
                best.add(items[place], bounds[rows, place], ids[rows])
            inner = np.flatnonzero(open_.any(1) & ~single)
            for node in inner[np.argsort(bounds[inner].max(1), kind="stable")]:  # the most promising is popped first
                mine = open_[node]
                stack.append((starts[node], ends[node], columns, wanted[:, mine], items[mine], bounds[node, mine]))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common beginning."""
    size = min(len(a), len(b))
    differ = a[:size] != b[:size]
    place = int(differ.argmax()) if size else 0
    return place if size and differ[place] else size


def _search(keys: list[str], asked: np.ndarray, weights: np.ndarray, k: int):
    """(item, doc_id, score): the k best of every item among the documents of a task."""
    schema = pa.schema([("item", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(keys), k)
        for batch in batches:
            for at in range(0, batch.num_rows, TREE_DOCS):
                part = batch.slice(at, TREE_DOCS)
                ids = part.column("doc_id").fill_null(NO_ID).to_numpy()
                ends = part.column("ranks").offsets.to_numpy() - part.column("ranks").offsets.to_numpy()[0]
                ranks, times = (np.split(part.column(name).flatten().to_numpy(zero_copy_only=False), ends[1:-1])
                                for name in ("ranks", "times"))
                Tree(ids, part.column("m").to_numpy(), ranks, times).search(asked, weights, best)
        item, place = np.nonzero(best.scores > 0)
        ids = best.ids[item, place]
        yield pa.RecordBatch.from_arrays(
            [pa.array([keys[row] for row in item], pa.string()), pa.array(ids, mask=ids == NO_ID),
             pa.array(best.scores[item, place])], schema=schema)

    return walk


def _block(docs: DataFrame, held: list, k: int) -> DataFrame:
    """(item, doc_id, score): at most k rows of a task for each item of a block of (item, terms) rows."""
    terms = sorted({bytes(term) for row in held for term in row["terms"]})
    vocabulary = {term: number for number, term in enumerate(terms)}
    vectors = cut_lineage(restricted(docs, vocabulary), "ranked-vectors")
    documents, length = vectors.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    frequency = np.zeros(len(terms), np.int64)  # one number for each term of the block
    for row in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        frequency[row["term"]] = row["count"]
    order = np.lexsort((np.arange(len(terms)), -frequency))
    rank = np.empty(len(terms), np.int32)
    rank[order] = np.arange(len(terms))
    weights = np.array([floor(1000 * log((2 * documents + 2) / (2 * int(frequency[term]) + 1))) for term in order], np.int64)
    largest = max(len(row["terms"]) for row in held) * int(weights.max(initial=0)) * 1_000_000
    asked = np.zeros((len(terms), len(held)), float if largest < 2 ** 53 else np.int64)
    for column, row in enumerate(held):
        asked[[rank[vocabulary[bytes(term)]] for term in row["terms"]], column] = 1
    vectors = _ranked_vectors(vectors, rank, documents, max(length, 1))
    # Equal vectors may be many: doc_id is part of the range, so that they are dealt out too.
    # The range looks at the first terms only, as the driver takes a sample of it.
    begin = F.slice("ranks", 1, RANGE_TERMS)
    ordered = vectors.repartitionByRange(begin, "doc_id").sortWithinPartitions("ranks", "doc_id")
    return ordered.mapInArrow(_search([row["item"] for row in held], asked, weights, k), "item string, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item of (item_id, text), scores above 0."""
    items = cut_lineage(item_terms(items), "ranked-items")
    different = items.groupBy("item").agg(F.first("terms").alias("terms"))
    many, total = items.agg(F.count_distinct("item"), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    blocks = max(-(-total // BLOCK_TERMS), -(-many // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64("item"), F.lit(max(blocks, 1)))
    found = items.sparkSession.createDataFrame([], "item string, doc_id long, score long")
    for number in range(blocks):
        held = different.filter(block == number).orderBy("item").collect()  # bounded: a block of terms
        if held:
            found = found.unionByName(_block(docs, held, k))
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return items.select("item_id", "item").join(found, "item").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
