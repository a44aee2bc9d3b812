"""Mixing sources to target weights by weighted fair queueing. Only DataFrame functions; no Python on the executors.

Each source is shuffled (order of the md5 of its doc_ids) and repeated at most `repeats` times. The k-th word of that
sequence has the virtual finish time k / target; sorting all words of all sources by it and truncating at the total
budget is fair queueing with the document as packet and the word as unit. Because targets are shares of the budget,
the cut falls at virtual time 1: a document is taken as far as its words finish by then, so each source yields its
target to the word, and at most one document of a source is cut. `mixed` gives the amount per document, `stream` the
taken copies in global order of virtual finish time (one range sort).

Targets: `share` of all words is divided by weight; a target stops at `repeats` times its source's size, and what that
leaves is shared again by weight until none is above. That is one water level, found from the sources ordered by the
level at which they fill up, without a loop.

A hot source is no hot task: running sums are taken within (source, 1024 slices of the shuffle order); the sums of
slices are one small row each.

Defined cases: a null text has size 0 and takes nothing; null sources are one source, last in order; rows with a null
or repeated doc_id are documents of their own (the text's hash breaks ties; equal rows are interchangeable); sources
without words have target 0; an empty table gives an empty result; further columns are ignored by `mixed` and kept
by `stream`, which adds none of its own unless asked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerlab.session import cut_lineage

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, REPEATS = 1.5, 2


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
            repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per source, weights dealt by code point.

    The windows without a partition see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every, filled = Window.partitionBy(), Window.orderBy("level")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.select("source", "source_size", weight.alias("weight"))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats)
    ranked = ranked.withColumn("level", F.col("cap") / F.col("weight"))
    ranked = (ranked.withColumn("budget", F.sum("source_size").over(every) * share)
              .withColumn("full_below", F.sum("cap").over(filled))
              .withColumn("weight_above", F.sum("weight").over(every) - F.sum("weight").over(filled)))
    full = F.col("full_below") + F.col("level") * F.col("weight_above") <= F.col("budget")
    ranked = ranked.withColumn("full", full)
    spent = F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(every)
    open_weight = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)
    level = F.col("weight") * (F.col("budget") - spent) / F.when(open_weight > 0, open_weight)
    return ranked.select("source", "source_size",
                         F.when(F.col("full"), F.col("cap").cast("double")).otherwise(level).alias("target"))


def _key(source: Column) -> Column:
    """A source as a key that is never null."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _rows(docs: DataFrame, *carried: Column) -> DataFrame:
    place = F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        docs["doc_id"].alias("doc_id"), docs["source"].alias("source"), n_words(docs["text"]).alias("size"),
        F.xxhash64(docs["text"]).alias("mark"), place.alias("place"), _slice(place).alias("slice"), *carried)


def _slice(place: Column) -> Column:
    """One of 1024 slices of the shuffle order, from its first ten bits."""
    return F.shiftright(F.conv(F.substring(place, 1, 3), 16, 10).cast("int"), 2)


def _queued(rows: DataFrame, weights, share, repeats) -> DataFrame:
    """`rows` with (source_size, target, before): words of the source's shuffle before each document."""
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    shares = targets(slices.groupBy("source").agg(F.sum("held").alias("source_size")), weights, share, repeats)
    shares = shares.select(_key(F.col("source")).alias("key"), "source_size", "target")
    slices = slices.select(_key(F.col("source")).alias("key"), "slice",
                           F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    inside = (Window.partitionBy("key", "slice").orderBy("place", F.col("doc_id").asc_nulls_last(), "size", "mark")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (rows.withColumn("key", _key(F.col("source"))).join(slices.join(shares, "key"), ["key", "slice"])
            .withColumn("before", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))))


def _taken(repeats: int) -> Column:
    """Words of a document that finish by virtual time 1, over all passes through its source."""
    quota = F.floor("target").cast("long")
    total = F.lit(0).cast("long")
    for turn in range(repeats):
        start = F.col("source_size") * turn + F.col("before")
        total = total + F.greatest(F.lit(0), F.least(quota - start, F.col("size")))
    return total


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
          repeats: int = REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row of (doc_id, text, source, ...)."""
    rows = cut_lineage(_rows(docs), "mix-sizes")
    return _queued(rows, weights, share, repeats).select(
        "doc_id", "size", "source_size", "target", _taken(repeats).alias("taken"))


def stream(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS,
           finish: str | None = None) -> DataFrame:
    """The taken copies with the columns of `docs`, in global order of virtual finish time.

    A copy that is cut keeps its first taken words, joined by one space. `finish` names a column for the time.
    """
    columns = docs.columns
    queued = _queued(_rows(docs, F.struct(*[docs[name] for name in columns]).alias("row")), weights, share, repeats)
    starts = F.array(*[F.col("source_size") * turn + F.col("before") for turn in range(repeats)])
    copies = queued.select("row", "size", "target", F.explode(starts).alias("start"))
    copies = copies.withColumn("amount", F.least(F.floor("target").cast("long") - F.col("start"), F.col("size")))
    copies = copies.filter("amount > 0")
    cut = F.array_join(F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1)), F.lit(1),
                               F.col("amount").cast("int")), " ")
    text = F.when(F.col("amount") < F.col("size"), cut).otherwise(F.col("row.text"))
    copies = copies.withColumn("finish", (F.col("start") + F.col("size")) / F.col("target"))
    copies = copies.repartitionByRange("finish", "row.doc_id").sortWithinPartitions("finish", "row.doc_id")
    return copies.select(*[text.alias(name) if name == "text" else F.col("row")[name].alias(name) for name in columns],
                         *([F.col("finish").alias(finish)] if finish else []))
