"""Near-duplicate embeddings by an inverted multi-index: all links with a cosine of at least 0.9, in doubles.

1. Equal vectors are one node with a count (hot vectors collapse before anything is compared).
2. Two codebooks, one for each half of a vector, are fitted by k-means on a bounded sample; a cell of the grid is a pair
   of codewords. Cells follow from the number of nodes, so that one holds some fifty of them.
3. Each node visits the cells nearest to it in the order of the multi-sequence algorithm (a heap over the two sorted
   lists of half distances). How many it visits is fitted on the sample for the target recall: sampled vectors are turned
   by a random angle of exactly the threshold, the hardest link there is, and the rank of the turned vector's cell in
   the order is read off.
4. A cell's residents and visitors meet in blocks and are verified exactly, as one matrix product. A pair counts for the
   visitor; it counts for the resident too unless the resident visits the visitor's cell and counts it there: every link
   found from either side is counted once for each of its ends, and no pair leaves the task. Links leave as forests.

Vectors of different lengths have no cosine: each length has an index of its own and links among its own.

Defined cases: vectors that are null, zero or hold null or non-finite components link with nothing and stand for themselves; a null vec_id links with nothing, its component is null; rows that repeat a
vec_id and vector link like any copies; ties have no effect; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.llm.graph import components
from ledgerlab.llm.minhash import forest
from ledgerlab.session import cut_lineage

THRESHOLD, RECALL = 0.9, 0.99
# Vectors that codebooks and the number of visits are fitted on at most, and codewords of a half at most.
SAMPLE, CODEWORDS = 20_000, 256
NODES_PER_CELL = 50
BLOCK = 2048
LEAST_CODEWORDS = 4


@dataclass(frozen=True)
class Index:
    """Codebooks of the two halves, and how many cells a vector visits."""

    left: np.ndarray
    right: np.ndarray
    visits: int

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.left.shape[1]
        return _square(unit[:, :cut], self.left), _square(unit[:, cut:], self.right)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        a, b = self.distances(unit)
        return a.argmin(1) * len(self.right) + b.argmin(1)


def _square(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((points ** 2).sum(1)[:, None] - 2 * points @ words.T + (words ** 2).sum(1), 0)


def nearest_cells(a: np.ndarray, b: np.ndarray, count: int) -> list[int]:
    """The `count` cells with the least a[i] + b[j], in order: the multi-sequence algorithm."""
    rows, columns = a.argsort(kind="stable"), b.argsort(kind="stable")
    heap, seen, out = [(a[rows[0]] + b[columns[0]], 0, 0)], {(0, 0)}, []
    while heap and len(out) < count:
        _, i, j = heapq.heappop(heap)
        out.append(int(rows[i]) * len(b) + int(columns[j]))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (a[rows[x]] + b[columns[y]], x, y))
    return out


def _codebook(points: np.ndarray, words: int, random: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """k-means from random points."""
    points = np.unique(points, axis=0)
    book = points[random.choice(len(points), min(words, len(points)), replace=False)].copy()
    for _ in range(rounds):
        own = _square(points, book).argmin(1)
        for word in range(len(book)):
            if (held := own == word).any():
                book[word] = points[held].mean(0)
    return book


def fit(sample: np.ndarray, words: int, threshold: float = THRESHOLD, recall: float = RECALL) -> Index:
    """Codebooks and visits from unit vectors."""
    random = np.random.default_rng(11)
    cut = max(1, sample.shape[1] // 2)
    left, right = _codebook(sample[:, :cut], words, random), _codebook(sample[:, cut:], words, random)
    index = Index(left, right, 1)
    some = sample[random.permutation(len(sample))[:4000]]
    noise = random.standard_normal(some.shape)
    noise -= (noise * some).sum(1)[:, None] * some
    noise /= np.linalg.norm(noise, axis=1)[:, None] + 1e-300
    turned = threshold * some + np.sqrt(1 - threshold ** 2) * noise
    a, b = index.distances(some)
    own = index.cells(turned)
    reach = a[np.arange(len(some)), own // len(right)] + b[np.arange(len(some)), own % len(right)]
    # Cells that come no later than the turned vector's: counted in a sorted list of the grid's sums.
    ranks = [int(((x[:, None] + y[None]) <= far + 1e-12).sum()) for x, y, far in zip(a, b, reach, strict=True)]
    # A link is found from either end; measured on vectors turned at random, half of what one end misses the other finds.
    return Index(left, right, int(np.quantile(ranks, 1 - 2 * (1 - recall), method="higher")))


def nodes_of(vectors: DataFrame) -> DataFrame:
    """(node, many, v): distinct usable vectors in doubles, their least vec_id and number of rows."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    rows = rows.filter("vec_id is not null and size(v) > 0")
    rows = rows.filter(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0))
    return rows.groupBy("v").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("many")).select("node", "many", "v")


def _matrix(column) -> np.ndarray:
    """Unit vectors of a list column, in doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return _units(flat.reshape(len(column), -1))


def _units(values: np.ndarray) -> np.ndarray:
    values = values / np.abs(values).max(1, initial=1e-300)[:, None]  # else squares of tiny or huge ones are lost
    return values / np.linalg.norm(values, axis=1)[:, None]


def _packed(values: np.ndarray) -> list[bytes]:
    """Vectors as bytes: of single precision where that loses nothing, else of double."""
    short = values.astype("<f4")
    exact = (short.astype(float) == values).all(1)
    return [(a if whole else b).tobytes() for whole, a, b in zip(exact, short, values.astype("<f8"), strict=True)]


def _unpacked(held: list[bytes], width: int) -> np.ndarray:
    """Unit vectors, in doubles, of what `_packed` gave."""
    if all(len(value) == 4 * width for value in held):
        return _units(np.frombuffer(b"".join(held), "<f4").reshape(-1, width).astype(float))
    return _units(np.stack([np.frombuffer(value, "<f4" if len(value) == 4 * width else "<f8").astype(float) for value in held]))


_PLACE = pa.struct([("node", pa.int64()), ("many", pa.int64()), ("vector", pa.binary()), ("cell", pa.int32()),
                    ("visits", pa.list_(pa.int32()))])


def _placed(nodes: DataFrame, index: Index) -> DataFrame:
    """(node, many, vector, cell, visits) of every node."""
    schema = pa.schema(list(_PLACE))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units, raw = _matrix(batch.column("v")), batch.column("v").flatten().to_numpy(zero_copy_only=False)
            a, b = index.distances(units)
            visits = [nearest_cells(x, y, index.visits) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("many"), pa.array(_packed(raw.reshape(len(units), -1)), pa.binary()),
                 pa.array(index.cells(units), pa.int32()), pa.array(visits, pa.list_(pa.int32()))], schema=schema)

    return nodes.mapInArrow(place, "node long, many long, vector binary, cell int, visits array<int>")


def _met(placed: DataFrame, threshold: float, width: int) -> DataFrame:
    """(a, b, n): links of forests with n null, and what a block adds to the links of node a with b null."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                sides = []
                for name in ("residents", "visitors"):
                    side = batch.column(name).slice(at, 1).flatten()
                    units = _unpacked(side.field("vector").to_pylist(), width)
                    sides.append((side, units, side.field("node").to_numpy(), side.field("many").to_numpy()))
                (residents, r_units, r_ids, r_many), (visitors, v_units, v_ids, v_many) = sides
                linked = v_units @ r_units.T >= threshold
                linked &= v_ids[:, None] != r_ids[None]
                # Which residents visit each visitor's cell, and so count it there.
                flat = residents.field("visits")
                owner = np.repeat(np.arange(len(r_ids)), np.diff(flat.offsets.to_numpy()))
                seen = flat.flatten().to_numpy()
                cells, place = np.unique(visitors.field("cell").to_numpy(), return_inverse=True)
                spot = np.searchsorted(cells, seen)
                good = (spot < len(cells)) & (cells[np.minimum(spot, len(cells) - 1)] == seen)
                there = np.zeros((len(cells), len(r_ids)), bool)
                there[spot[good], owner[good]] = True
                counts = dict.fromkeys(v_ids.tolist(), 0)
                for node, n in zip(v_ids.tolist(), (linked @ r_many).tolist(), strict=True):
                    counts[node] += n
                for node, n in zip(r_ids.tolist(), ((linked & ~there[place]).T @ v_many).tolist(), strict=True):
                    counts[node] = counts.get(node, 0) + n
                counts = {node: n for node, n in counts.items() if n}
                ids, inverse = np.unique(np.concatenate([v_ids, r_ids]), return_inverse=True)
                links = _forest(linked, inverse[:len(v_ids)], inverse[len(v_ids):], ids)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([a for a, _ in links] + list(counts), pa.int64()),
                     pa.array([b for _, b in links] + [None] * len(counts), pa.int64()),
                     pa.array([None] * len(links) + list(counts.values()), pa.int64())], schema=schema)

    residents = placed.select("cell", "node", F.struct("node", "many", "vector", "visits").alias("held"))
    visitors = placed.select(F.explode("visits").alias("at"), "node", F.struct("node", "many", "vector", "cell").alias("held"))
    full = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("r_blocks"))
    busy = visitors.groupBy("at").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("v_blocks"))
    sizes = full.join(busy, full["cell"] == busy["at"]).drop("at")
    block = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    packed_r = residents.join(sizes, "cell").select("cell", block("r_blocks").alias("i"), "held").groupBy("cell", "i").agg(
        F.collect_list("held").alias("residents"))
    packed_v = visitors.join(sizes, visitors["at"] == sizes["cell"]).select("cell", block("v_blocks").alias("j"), "held")
    packed_v = packed_v.groupBy("cell", "j").agg(F.collect_list("held").alias("visitors"))
    pairs = packed_r.join(packed_v, "cell")
    return pairs.select("residents", "visitors").mapInArrow(meet, "a long, b long, n long")


def _forest(linked: np.ndarray, v_at: np.ndarray, r_at: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Forest of the links between visitors (rows) and residents (columns); a node may be both."""
    rows, columns = np.flatnonzero(linked.any(1)), np.flatnonzero(linked.any(0))
    if not len(rows):
        return []
    used, where = np.unique(np.concatenate([v_at[rows], r_at[columns]]), return_inverse=True)
    square = np.zeros((len(used), len(used)), bool)
    square[np.ix_(where[:len(rows)], where[len(rows):])] |= linked[np.ix_(rows, columns)]
    return [(int(ids[used[i]]), int(ids[used[root]])) for i, root in forest(square | square.T)]


def _links_of(nodes: DataFrame, width: int, total: int, threshold: float, recall: float) -> DataFrame:
    """What `_met` finds among nodes of one length."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toArrow().column("v").combine_chunks()
    words = int(np.clip(np.sqrt(total / NODES_PER_CELL), LEAST_CODEWORDS, CODEWORDS))
    index = fit(_matrix(sample), words, threshold, recall)
    return cut_lineage(_met(cut_lineage(_placed(nodes, index), "vector-cells"), threshold, width), "vector-links")


def linked(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    nodes = cut_lineage(nodes_of(vectors), "vectors")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("v"))
    lengths = nodes.groupBy(F.size("v").alias("width")).count().filter("count > 1").collect()  # a row a length
    met = [_links_of(nodes.filter(F.size("v") == row["width"]), row["width"], row["count"], threshold, recall) for row in sorted(lengths)]
    if met:
        links = reduce(DataFrame.unionByName, met)
        counts = links.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
        found = components(links.filter("b is not null").select("a", "b"))
        # Vectors of two lengths may share a vec_id: their links and components are its own.
        nodes = nodes.join(counts, "node", "left").join(found, "node", "left")
    else:
        nodes = nodes.withColumn("n", F.lit(0)).withColumn("component", F.col("node"))
    owner = nodes.select(F.col("v").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("many") - 1).alias("n_links"),
                         F.coalesce("component", "node").alias("component_id"))
    joined = rows.join(owner, (rows["v"] == owner["same"]) & rows["vec_id"].isNotNull(), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                         component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
