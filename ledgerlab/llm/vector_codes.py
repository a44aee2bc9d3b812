"""Vector codes: a codebook for each part of a vector, learnt by k-means, with memoised grid cells for the assignment.

Components become floor(scale * x); a vector is cut into `PARTS` consecutive parts, and a part's code is the index of its
nearest codebook entry. Each task keeps a hash table of grid cells for each part:

1. a part's coarse cell is floor(component / step) for each of its components: a box of the space;
2. when a cell is first met, every entry's least and greatest squared distance to the box is taken. An entry whose least
   distance is beyond the least of all greatest ones is dominated: it is nearest to no point of the box. The others,
   ties included, are cached under the cell;
3. parts are compared with the cached entries of their cell alone, in whole numbers.

A round sums parts by entry inside the tasks and in Spark; only sums of entries reach the driver, 4 x 256 of them whatever
the table's size. The first codebook comes from the least vec_ids, found by narrowing an approximate quantile.

Vectors of different lengths have codebooks of their own for each length. A length that `PARTS` does not divide is cut at
floor(k * length / PARTS).

Defined cases: vectors that are null or hold null or non-finite components are dropped; empty vectors have empty parts,
entry 0 and error 0; a null vec_id is kept and comes after all others when the first codebook is taken, as do, among rows
that repeat a vec_id, greater vectors; equal parts get equal codes, ties the lower index; with fewer than 256 rows the
codebook is as long as the table; null labels are one label; components are held within +-2**c, with c such that squared
distances stay below 2**62 (for 64 components 2**27 after scaling, so x up to 131072); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.session import cut_lineage

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
# Cells that a task remembers at most for a part, in each of two generations. It decides speed alone.
REMEMBERED = 50_000
# Vectors that are assigned at once, which bounds the tables of distances.
AT_ONCE = 2048
LARGEST_LONG = 2 ** 63 - 1


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): floor(scale * component) of the vectors that are kept, as an array of long."""
    label = vectors["label"] if "label" in vectors.columns else F.lit(None).cast("int")
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), label.alias("label"),
                          vectors["embedding"].cast("array<double>").alias("x"))
    rows = rows.filter(F.col("x").isNotNull()).filter(
        F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    bound = F.pow(F.lit(2.0), F.floor((62 - F.log2(F.greatest(F.size("x"), F.lit(1)))) / 2 - 1))
    held = F.transform("x", lambda c: F.floor(F.greatest(F.least(c * scale, bound), -bound)).cast("long"))
    return rows.select("vec_id", "label", held.alias("v"))


def cuts(width: int) -> list[int]:
    """Where the parts of a vector begin, and the end of the last."""
    return [k * width // PARTS for k in range(PARTS + 1)]


class Cells:
    """Nearest entries of one part's codebook, by the cached entries of grid cells."""

    def __init__(self, book: np.ndarray):
        self.book = book
        # Half the spread of a component over the entries: finer cells repeat less, coarser ones keep more entries.
        self.step = max(1, int(book.std(0).mean() / 2)) if book.size else 1
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def open_entries(self, cells: np.ndarray) -> np.ndarray:
        """Which entries are not dominated across the box of each cell (cells x entries)."""
        least = np.zeros((len(cells), len(self.book)), np.int64)
        most = np.zeros_like(least)
        for place in range(cells.shape[1]):
            levels, own = np.unique(cells[:, place], return_inverse=True)
            low = levels[:, None] * self.step
            below, above = low - self.book[:, place], self.book[:, place] - (low + self.step - 1)
            least += (np.maximum(np.maximum(below, above), 0) ** 2)[own]
            most += (np.maximum(np.abs(below), np.abs(above)) ** 2)[own]
        return least <= most.min(1, keepdims=True)

    def cached(self, cells: np.ndarray) -> list[bytes]:
        """The open entries of each of these different cells, one byte an entry, ascending."""
        keys = [cell.tobytes() for cell in cells]
        found = [self.known.get(key) or self.older.get(key) for key in keys]
        new = [place for place, entries in enumerate(found) if entries is None]
        if new:
            for place, row in zip(new, self.open_entries(cells[new]), strict=True):
                found[place] = np.flatnonzero(row).astype(np.uint8).tobytes()
        if len(self.known) + len(keys) > REMEMBERED:  # cells still in use come back from the older generation
            self.older, self.known = self.known, {}
        self.known.update(zip(keys, found, strict=True))
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest entry of each point, and the squared distance."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        grid = np.ascontiguousarray(points // self.step)
        rows = grid.view(np.dtype((np.void, grid.shape[1] * grid.itemsize))).ravel()
        _, first, own = np.unique(rows, return_index=True, return_inverse=True)
        lists = self.cached(grid[first])
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        entries = np.frombuffer(b"".join(lists), np.uint8).astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        # One row for each point and open entry, points in order and entries ascending.
        each = sizes[own]
        starts = np.cumsum(each) - each
        point = np.repeat(np.arange(len(points)), each)
        entry = entries[np.arange(len(point)) - np.repeat(starts - begins[own], each)]
        distance = ((points[point] - self.book[entry]) ** 2).sum(1)
        best = np.minimum.reduceat(distance, starts)
        hits = np.flatnonzero(distance == best[point])
        chosen = hits[np.unique(point[hits], return_index=True)[1]]  # the first of a point has the lowest index
        return entry[chosen], best


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of a list column, vectors of one length at a time and few at once."""
    sizes = np.diff(column.offsets.to_numpy())
    flat, starts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()[:-1]
    for width in np.unique(sizes):
        rows = np.flatnonzero(sizes == width)
        for at in range(0, len(rows), AT_ONCE):
            some = rows[at:at + AT_ONCE]
            yield some, flat[starts[some][:, None] + np.arange(width)]


class _Assigner:
    """Cells of every part of every length, for one task."""

    def __init__(self, books: dict[int, list[np.ndarray]]):
        self.cells = {width: [Cells(book) for book in parts] for width, parts in books.items()}

    def __call__(self, vectors: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(part, its points, nearest entries, squared distances)."""
        ends = cuts(vectors.shape[1])
        for part, cells in enumerate(self.cells[vectors.shape[1]]):
            points = vectors[:, ends[part]:ends[part + 1]]
            yield part, points, *cells.nearest(points)


_SUMS = "width int, part int, entry int, place int, total long, many long"


def _sums(books: dict[int, list[np.ndarray]]):
    """Sums and counts of the parts of each entry over a task."""
    schema = pa.schema([("width", pa.int32()), ("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()),
                        ("total", pa.int64()), ("many", pa.int64())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(books)
        totals = {width: [(np.zeros_like(book), np.zeros(len(book), np.int64)) for book in parts]
                  for width, parts in books.items()}
        for batch in batches:
            for _, vectors in _matrices(batch.column("v")):
                for part, points, entries, _ in assign(vectors):
                    total, many = totals[vectors.shape[1]][part]
                    np.add.at(total, entries, points)
                    many += np.bincount(entries, minlength=len(many))
        for width, parts in totals.items():
            for part, (total, many) in enumerate(parts):
                used = np.flatnonzero(many)
                places = total.shape[1]
                columns = [np.full(len(used) * places, width), np.full(len(used) * places, part), np.repeat(used, places),
                           np.tile(np.arange(places), len(used)), total[used].ravel(), np.repeat(many[used], places)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column.astype(np.int64)).cast(field.type) for column, field in zip(columns, schema, strict=True)],
                    schema=schema)

    return add


def first_books(rows: DataFrame, entries: int = ENTRIES) -> dict[int, list[np.ndarray]]:
    """Codebooks from the least vec_ids of each length: a few hundred rows reach the driver."""
    books = {}
    for width, count in sorted((row["width"], row["count"]) for row in rows.groupBy(F.size("v").alias("width")).count().collect()):
        open_rows = rows.filter(F.size("v") == width)
        bound, left = None, count
        while left > 16 * entries:  # the quantile's rank is right within a ten-thousandth, so that enough stay below
            share = max(4 * entries / left, 2e-4)
            lower = open_rows.agg(F.percentile_approx("vec_id", share, 10_000)).first()[0]
            if lower is None or lower == bound:
                break
            bound = lower
            below = open_rows.filter(F.col("vec_id") <= bound)
            least = below.count()
            if least < entries:  # more rows without a vec_id than with one
                break
            open_rows, left = below, least
        chosen = open_rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
        whole, ends = np.array([row["v"] for row in chosen], np.int64).reshape(len(chosen), width), cuts(width)
        books[width] = [whole[:, ends[part]:ends[part + 1]].copy() for part in range(PARTS)]
    return books


def learnt_books(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, list[np.ndarray]]:
    """Codebooks of every length after the rounds: each entry the floor of the mean of its parts, unused entries as they were."""
    books = first_books(rows, entries)
    for _ in range(rounds if books else 0):
        sums = rows.select("v").mapInArrow(_sums(books), _SUMS).groupBy("width", "part", "entry", "place").agg(
            F.sum("total").alias("total"), F.sum("many").alias("many"))
        for row in sums.collect():
            books[row["width"]][row["part"]][row["entry"], row["place"]] = row["total"] // row["many"]
    return books


def digest(books: list[np.ndarray]) -> str:
    """sha256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(value) for book in books for value in book.ravel().tolist()).encode()).hexdigest()


def coded(rows: DataFrame, books: dict[int, list[np.ndarray]]) -> DataFrame:
    """(vec_id, label, code, error, codebooks_sha256) of every row of `whole_vectors`."""
    digests = {width: digest(parts) for width, parts in books.items()}
    out = T.StructType([rows.schema["vec_id"], rows.schema["label"], T.StructField("code", T.StringType()),
                        T.StructField("error", T.LongType()), T.StructField("codebooks_sha256", T.StringType())])

    def assign_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        assign = _Assigner(books)
        for batch in batches:
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            errors, shas = np.zeros(batch.num_rows, np.int64), [""] * batch.num_rows
            for rows_of, vectors in _matrices(batch.column("v")):
                for part, _, entries, distances in assign(vectors):
                    codes[rows_of, part] = entries
                    errors[rows_of] += distances
                for row in rows_of:
                    shas[row] = digests[vectors.shape[1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array([code.tobytes().hex() for code in codes], pa.string()),
                 pa.array(errors), pa.array(shas, pa.string())],
                names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.mapInArrow(assign_all, out)


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept row; at most 256 entries."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    rows = cut_lineage(whole_vectors(vectors, scale), "code-vectors")
    found = cut_lineage(coded(rows, learnt_books(rows, entries, rounds)), "codes")
    # Summed as decimals: a label may hold most of a large table.
    sums = found.groupBy(F.col("label").alias("same")).agg(F.sum(F.col("error").cast("decimal(20,0)")).alias("total"))
    error = F.least(F.col("total"), F.lit(LARGEST_LONG).cast("decimal(20,0)")).cast("long")
    return found.join(sums, found["label"].eqNullSafe(sums["same"])).select(
        "vec_id", "code", "error", error.alias("label_error"), "codebooks_sha256")
