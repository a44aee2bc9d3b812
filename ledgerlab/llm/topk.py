"""Exact top-k search by inner product: distributed histogram selection.

Every component is floor(scale * x), so scores are whole numbers. Queries and candidates are packed into blocks of a fixed
number of vectors; each pair of a query block and a candidate block is one matrix product in numpy, inside the task
that holds the pair, and only counts leave it.

1. Each round splits the range in which a query's k-th best score may lie into `BINS` bins (first the range that the
   largest norms allow), counts the scores of every bin over all candidates, and keeps the bin that holds the k-th.
   A block sends no bin below its own k-th best: such a bin can't hold the global one. Rounds end when a bin is one
   score wide, after log(range) / log(BINS) of them, whatever the data.
2. A last pass keeps the scores that reach the k-th value; of scores equal to it a block keeps the k least vec_ids.
   Spark ranks what is left: at most 2k rows of a query and block.

Scores are recomputed in each round instead of stored: a product costs less than a shuffle of all scores. The blocks of
queries are dealt to all candidate blocks; that is the stated query set against all rows, in blocks.

Vectors of different lengths have no inner product: each length is searched among its own, blocks hold one length.

Defined cases: vectors that are null, empty, hold null or non-finite components, or have no vec_id take no part; zero vectors
score 0 and take part; a query never meets
its own vec_id (rows that repeat it included); repeated rows are candidates of their own, and of rows that repeat a query's
vec_id the one with the least vector asks; with fewer than k candidates all are returned; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlab.session import cut_lineage

K, SCALE, EVERY = 20, 64, 20
BINS = 256
QUERY_BLOCK, CANDIDATE_BLOCK = 512, 8192


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * component) of the vectors that take part, as an array of long."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0)).filter(finite)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale)).alias("v"))


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """(width, block, blocks, ids, data, lows): vectors of one length packed into blocks, as little-endian 64-bit integers."""
    rows = rows.withColumn("width", F.size("v"))
    many = rows.groupBy("width").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))  # a row a length
    dealt = rows.join(many, "width").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int"))
    schema = pa.schema([("width", pa.int32()), ("block", pa.int32()), ("blocks", pa.int32()), ("ids", pa.binary()), ("data", pa.binary()),
                        ("lows", pa.binary())])

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(table["vec_id"].to_numpy(), kind="stable")
        values = table["v"].combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]
        packed = [table["vec_id"].to_numpy()[order], values, table["low"].to_numpy()[order]]
        keys = [pa.array([table[name][0].as_py()], pa.int32()) for name in ("width", "block", "blocks")]
        return pa.Table.from_arrays([*keys, *[pa.array([part.astype("<i8").tobytes()], pa.binary()) for part in packed]], schema=schema)

    return dealt.select("width", "block", "blocks", "vec_id", "v", "low").groupBy("width", "block").applyInArrow(
        pack, "width int, block int, blocks int, ids binary, data binary, lows binary")


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of pairs of blocks, one in memory at a time."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _scores(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of queries and candidates of a pair of blocks, and their scores (own pairs: the least number)."""
    q_ids, c_ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["c_ids"], "<i8")
    left = np.frombuffer(row["q_data"], "<i8").reshape(len(q_ids), -1)
    right = np.frombuffer(row["c_data"], "<i8").reshape(len(c_ids), -1)
    bound = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * left.shape[1]
    if bound < 2.0 ** 52:  # products and sums are exact in doubles, which have a faster matrix product
        scores = np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    else:
        scores = left @ right.T
    scores[q_ids[:, None] == c_ids[None, :]] = np.iinfo(np.int64).min
    return q_ids, c_ids, scores


def _histogram(k: int, step: int):
    """(query_id, bin, count) of a pair of blocks within each query's range; bins below the block's own k-th are left out."""
    schema = pa.schema([("query_id", pa.int64()), ("bin", pa.int64()), ("count", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            q_ids, _, scores = _scores(row)
            if scores.shape[1] > k:  # what is below a block's own k-th best can't be among the k best of all
                scores = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k:]
            lows = np.frombuffer(row["lows"], "<i8")[:, None]
            # One bin more for scores above the range: they are better than the k-th.
            bins = np.where(scores >= lows, np.minimum((np.maximum(scores, lows) - lows) // step, BINS), -1)
            keys, counts = np.unique(np.arange(len(q_ids))[:, None] * (BINS + 2) + bins + 1, return_counts=True)
            real = keys % (BINS + 2) > 0
            keys, counts = keys[real], counts[real]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[keys // (BINS + 2)]), pa.array(keys % (BINS + 2) - 1), pa.array(counts.astype(np.int64))],
                schema=schema)

    return count


def _reaching(k: int):
    """(query_id, vec_id, score) of scores that reach the k-th value; of those equal to it the k least vec_ids."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _pairs(batches):
            q_ids, c_ids, scores = _scores(row)
            lows = np.frombuffer(row["lows"], "<i8")[:, None]
            equal = scores == lows
            equal &= np.cumsum(equal, axis=1) <= k  # candidates ascend by vec_id
            query, place = np.nonzero((scores > lows) | equal)
            yield pa.RecordBatch.from_arrays(
                [pa.array(q_ids[query]), pa.array(c_ids[place]), pa.array(scores[query, place])], schema=schema)

    return keep


def top_k(vectors: DataFrame, k: int = K, scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row whose vec_id is divisible by `every`."""
    rows = cut_lineage(whole_vectors(vectors, scale), "topk-vectors")
    square = F.aggregate("v", F.lit(0.0), lambda total, c: total + c.cast("double") * c)
    largest = rows.agg(F.max(square)).first()[0]
    spread = int(largest or 0) + 1  # no inner product is larger: Cauchy-Schwarz
    queries = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries = cut_lineage(queries.withColumn("low", F.lit(-spread).cast("long")), "topk-queries")
    candidates = cut_lineage(_blocks(rows.withColumn("low", F.lit(0).cast("long")), CANDIDATE_BLOCK).select(
        "width", F.col("block").alias("c_block"), "blocks", F.col("ids").alias("c_ids"), F.col("data").alias("c_data")), "topk-candidates")
    c_blocks = candidates.groupBy("width").agg(F.max("blocks").alias("c_blocks"))

    def pairs() -> DataFrame:
        """Each block of queries beside each block of candidates."""
        asked = _blocks(queries, QUERY_BLOCK).join(c_blocks, "width").select(
            "width", F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), "lows",
            F.explode(F.sequence(F.lit(0), F.col("c_blocks") - 1)).alias("c_block"))
        return asked.join(candidates.drop("blocks"), ["width", "c_block"]).drop("width", "c_block")

    width = 2 * spread + 1
    while width > 1:
        step = -(-width // BINS)
        counts = pairs().mapInArrow(_histogram(k, step), "query_id long, bin long, count long")
        counts = counts.groupBy("query_id", "bin").agg(F.sum("count").alias("count"))
        above = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most BINS + 1 rows of a query
        reached = counts.withColumn("above", F.sum("count").over(above)).filter(F.col("above") >= k)
        bins = reached.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("bin").alias("bin"))
        low = F.col("low") + F.coalesce(F.col("bin"), F.lit(0)) * step
        queries = cut_lineage(queries.join(bins, "vec_id", "left").select("vec_id", "v", low.alias("low")), "topk-queries")
        width = step
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    kept = pairs().mapInArrow(_reaching(k), "query_id long, vec_id long, score long")
    return (kept.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
