"""Near-duplicates by MinHash and a multi-index Hamming join, confirmed on whole shingle sets.

A document's set holds its distinct windows of `width` words (A-Z lower-cased). Its signature is `VALUES` MinHash values
of `BITS` bits each; the distance of two signatures is the number of values that differ.

1. Sets that are equal are one node (least doc_id); copies never meet each other again.
2. Signatures are split into chunks. By pigeonhole, signatures at a distance below twice their number agree in some chunk
   but for one value, so all patterns with one value of a chunk left out are enumerated as keys (70 per node), and every
   such pair shares a key. At a similarity of 0.85 that is 99.6 % of pairs by guarantee; as any chunk may be the one,
   a pair is missed with a probability of about 3e-6, and less the more alike it is. `scheme` derives chunks and distance
   from the percentage asked for, so that this holds at any (10 chunks of 7 at 85, 12 of 6 at 80).
3. Nodes that share a key are compared by signature distance, within the task and never as rows; what remains is one
   spanning forest per key. Keys with many nodes are split into blocks, and blocks meet in pairs.
4. The forests' components are candidate groups: each node's whole set is compared exactly with that of its group's least
   node. What links there is settled, as only components are asked for; the others are verified against all of the group (by
   products of 0/1 matrices for larger groups, in pairs of blocks). Links leave as forests, and their components are the result.

Defined cases: texts with fewer words than `width` are one shingle, the whole sequence; null and empty texts have an
empty set, link with nothing and stand for themselves; rows without doc_id link with nothing, their component is null
and they are kept; rows that repeat a doc_id are one document, with the links of either; an empty table gives an empty
result; further columns are ignored by `groups` and kept by `kept_documents`.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.llm.graph import components
from ledgerlab.llm.tables import ids_and_texts
from ledgerlab.llm.words import mix, window_hashes, word_hashes, words_of
from ledgerlab.session import cut_lineage

WIDTH, PERCENT = 5, 85
CHUNKS, CHUNK = 10, 7
VALUES, BITS = CHUNKS * CHUNK, 16
# Chance at most to miss a pair at the percentage itself, by its chunks and by its distance.
MISSED = 3.5e-6
# Nodes of one key, or of one group, in a block; two blocks meet in a task.
KEY_BLOCK, GROUP_BLOCK = 1024, 384
# Cells of a 0/1 matrix in memory at most.
CELLS = 8 << 20


@dataclass(frozen=True)
class Scheme:
    """Signatures of chunks * chunk values; nodes of one key are candidates up to the distance."""

    chunks: int
    chunk: int
    distance: int

    @property
    def values(self) -> int:
        return self.chunks * self.chunk

    @functools.cached_property
    def numbers(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Factors of the values, and spread and places of the keys."""
        random = np.random.default_rng(20240501)
        odd = [random.integers(0, 2**63, shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
               for shape in (self.values, (self.chunks, self.chunk))]
        return *odd, random.integers(0, 2**63, (self.chunks, self.chunk), dtype=np.uint64)


@functools.cache
def scheme(percent: int) -> Scheme:
    """The longest chunks, some `VALUES` values in all, that miss few enough pairs at a percentage; a chunk of one value misses none."""
    alike = percent / 100
    for chunk in range(CHUNK, 0, -1):
        chunks = math.ceil(VALUES / chunk)
        shared = alike**chunk + chunk * (1 - alike) * alike**(chunk - 1)
        if (1 - shared)**chunks <= MISSED:
            break
    values, beyond, distance = chunks * chunk, 0.0, chunks * chunk
    while distance:  # how many values of a pair differ is a binomial number: its upper tail stays below the chance
        beyond += math.comb(values, distance) * (1 - alike)**distance * alike**(values - distance)
        if beyond > MISSED:
            break
        distance -= 1
    return Scheme(chunks, chunk, distance)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    hashes = word_hashes(words_of(text, lower=True))
    if 0 < len(hashes) < width:
        return mix(window_hashes(hashes, len(hashes)) + np.uint64(len(hashes)))
    return np.unique(window_hashes(hashes, width))


def signature(members: np.ndarray, by: Scheme = scheme(PERCENT)) -> np.ndarray:
    """MinHash values: bits of the least product of any shingle with each factor."""
    factors, _, _ = by.numbers
    least = np.full(by.values, np.iinfo(np.uint64).max)
    for start in range(0, len(members), 2048):
        np.minimum(least, (members[start:start + 2048, None] * factors).min(0), out=least)
    return (mix(least) & np.uint64((1 << BITS) - 1)).astype("<u2")


def chunk_keys(values: np.ndarray, by: Scheme = scheme(PERCENT)) -> np.ndarray:
    """Keys of signatures (rows): for every chunk and place in it, a hash of the chunk without that place."""
    _, spread, places = by.numbers
    parts = values.reshape(-1, by.chunks, by.chunk).astype(np.uint64) + np.uint64(1)
    parts = mix(parts * spread + spread)
    return mix(parts.sum(2, dtype=np.uint64)[:, :, None] - parts + places).reshape(len(values), -1)


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (i, root) that connect what a symmetric 0/1 matrix connects."""
    todo, out = np.ones(len(linked), bool), []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = linked[root] & todo
        while front.any():
            todo &= ~front
            out += [(int(i), root) for i in np.flatnonzero(front)]
            front = linked[front].any(0) & todo
    return out


SIGNED = "doc_id long, n_shingles long, same binary, signature binary"
_SIGNED_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("same", pa.binary()), ("signature", pa.binary())])
_LINK_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def signed(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, same, signature) of every row; `same` is a 128-bit hash of the set, null if it is empty."""
    by = scheme(percent)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, same, signatures = [], [], []
            for text in batch.column("text"):
                members = shingles(text.as_py(), width)
                counts.append(len(members))
                same.append(xxhash.xxh3_128_digest(members.tobytes()) if len(members) else None)
                signatures.append(signature(members, by).tobytes() if len(members) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(same, pa.binary()),
                 pa.array(signatures, pa.binary())], schema=_SIGNED_SCHEMA)

    return ids_and_texts(docs).mapInArrow(sign, SIGNED)


def _in_blocks(rows: DataFrame, group: str, size: int, *carried: str) -> DataFrame:
    """Rows of groups of `many` nodes dealt to pairs of blocks: (group, i, j, node, ...), i <= j."""
    blocks = F.ceil(F.col("many") / size).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(group, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", *carried)


def candidate_links(nodes: DataFrame, by: Scheme = scheme(PERCENT), block: int = KEY_BLOCK) -> DataFrame:
    """(a, b): a forest of pairs within the signature distance, for every key that several of (node, signature) share."""
    key_schema = pa.schema([("key", pa.int64()), ("node", pa.int64())])

    def enumerate_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(-1, by.values)
                keys = chunk_keys(values, by).view(np.int64).ravel()
                owners = np.repeat(batch.column("node").to_numpy(), by.values)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(owners)], schema=key_schema)

    keys = nodes.select("node", "signature").mapInArrow(enumerate_keys, "key long, node long")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    members = _in_blocks(keys.join(shared, "key"), "key", block)
    # Near copies share many keys: equal lists of nodes are compared once.
    lists = members.groupBy("key", "i", "j").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    lists = cut_lineage(lists.filter(F.size("nodes") > 1).select("nodes").distinct(), "shared-keys")
    lists = lists.select(F.xxhash64("nodes").alias("list"), F.explode("nodes").alias("node"))
    with_values = lists.join(nodes, "node").groupBy("list").agg(F.collect_list(F.struct("node", "signature")).alias("held"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            held = batch.column("held")
            for at in range(batch.num_rows):
                row = held.slice(at, 1).flatten()
                ids = row.field("node").to_numpy()
                order = ids.argsort()  # the least node is a root wherever it is, so forests share their links
                ids = ids[order]
                values = np.frombuffer(b"".join(row.field("signature").to_pylist()), "<u2").reshape(-1, by.values)[order]
                near = np.empty((len(ids), len(ids)), bool)
                for start in range(0, len(ids), 64):
                    near[start:start + 64] = (values[start:start + 64, None] != values[None]).sum(2) <= by.distance
                for i, root in forest(near):
                    a.append(int(ids[i]))
                    b.append(int(ids[root]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK_SCHEMA)

    found = with_values.mapInArrow(compare, "a long, b long")
    # A node has a root for each of its keys at most: it keeps the least, the others are linked to that one.
    roots = found.groupBy("a").agg(F.sort_array(F.collect_set("b")).alias("roots"))
    roots = roots.select(F.explode(F.transform("roots", lambda root, at: F.struct(
        F.when(at == 0, F.col("a")).otherwise(root).alias("a"), F.get("roots", F.lit(0)).alias("b")))).alias("link"))
    return roots.select("link.a", "link.b").distinct()


def linked_sets(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which sets share 100 * intersection >= percent * union, exactly."""
    sizes = np.asarray([len(members) for members in sets])
    if len(sets) == 2:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        both = np.asarray([[sizes[0], common], [common, sizes[1]]])
    else:
        _, names, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owners = np.repeat(np.arange(len(sets)), sizes)
        keep = counts[names] > 1  # a shingle of one set alone is in no intersection
        shared = np.cumsum(counts > 1) - 1
        owners, names = owners[keep], shared[names[keep]]
        both = np.zeros((len(sets), len(sets)), np.int64)
        width = max(1, CELLS // len(sets))
        order = np.argsort(names, kind="stable")
        owners, names = owners[order], names[order]
        for low in range(0, int(shared[-1]) + 1 if len(shared) else 0, width):
            a, b = np.searchsorted(names, [low, low + width])
            ones = np.zeros((len(sets), min(width, int(shared[-1]) + 1 - low)), np.float32)
            ones[owners[a:b], names[a:b] - low] = 1
            both += np.rint(ones @ ones.T).astype(np.int64)
        np.fill_diagonal(both, sizes)
    union = sizes[:, None] + sizes[None, :] - both
    return 100 * both >= percent * union


def verified_links(docs: DataFrame, groups: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(a, b): a forest of the exact links within each candidate group; `groups` holds (node, component)."""
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("many"))
    wanted = groups.join(sizes, "component").withColumnRenamed("node", "doc_id")
    texts = ids_and_texts(docs).join(wanted.hint("shuffle_hash"), "doc_id")
    set_schema = pa.schema([("component", pa.int64()), ("many", pa.int64()), ("node", pa.int64()), ("members", pa.binary())])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members = [shingles(text.as_py(), width).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("component"), batch.column("many"), batch.column("doc_id"),
                                              pa.array(members, pa.binary())], schema=set_schema)

    sets = texts.select("component", "many", "doc_id", "text").mapInArrow(
        gather, "component long, many long, node long, members binary")
    blocks = _in_blocks(sets, "component", GROUP_BLOCK, "members").groupBy("component", "i", "j").agg(
        F.collect_list(F.struct("node", "members")).alias("held"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            held = batch.column("held")
            for at in range(batch.num_rows):
                row = held.slice(at, 1).flatten()
                if len(row) < 2:
                    continue
                ids = row.field("node").to_numpy()
                order = ids.argsort()
                ids, members = ids[order], row.field("members").take(pa.array(order))
                found = [np.frombuffer(value.as_py(), np.uint64) for value in members]
                for i, root in forest(linked_sets(found, percent)):
                    a.append(int(ids[i]))
                    b.append(int(ids[root]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINK_SCHEMA)

    return blocks.mapInArrow(verify, "a long, b long")


def groups(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    rows = cut_lineage(signed(docs, width, percent), "signatures")
    usable = rows.filter("same is not null and doc_id is not null")
    nodes = cut_lineage(usable.groupBy("same").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature")),
                        "signature-nodes")
    link = candidate_links if percent == PERCENT else functools.partial(candidate_links, by=scheme(percent))
    near = components(link(nodes.select("node", "signature")))
    links = verified_links(docs, near, width, percent)
    # Sets that share a node id are one document already; a doc_id with several sets links them.
    several = usable.select(F.col("doc_id").alias("a"), "same").join(nodes.select("same", F.col("node").alias("b")), "same")
    several = several.groupBy("a").agg(F.min("b").alias("low"), F.max("b").alias("high")).filter("low <> high")
    links = links.unionByName(several.select(F.col("low").alias("a"), F.col("high").alias("b")))
    found = components(links)
    owner = nodes.join(found, "node", "left").select("same", F.coalesce("component", "node").alias("component_id"))
    joined = rows.join(owner, "same", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.least(F.coalesce("component_id", "doc_id"), F.col("doc_id")))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def kept_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """`docs` without the documents that are not kept."""
    gone = groups(docs, width, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone_id"], "left_anti")
