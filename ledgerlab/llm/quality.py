"""Quality classifier: an ensemble of few conjunctive rules over statistics of a text.

1. `statistics` reads each whole text once and gives some twenty numbers (shares of letters, capitals, digits, marks,
   repeated words and lines, lengths). The label, language, source and id of a document are no part of them.
2. Rules: the paths of random trees (Spark ML) fitted on a bounded sample of labelled rows are conjunctions of
   `statistic <= threshold` and `statistic > threshold`.
3. Weights: a lasso logistic regression over the rules' 0/1 columns (Spark ML, L1) keeps few of them.
4. `score` compiles intercept and rules into one Spark column expression; nothing is looked up while scoring.

Learning takes at most `SAMPLE` labelled rows (those with the least md5 of their ids), never held-out ones; everything
else covers all rows. Trees are fitted on all threads of the cluster, the model is a few hundred numbers.

Defined cases: null and empty texts have statistics of 0 and get the model's score for them; very long texts are read
whole; rows of one doc_id are scored apart; without any labelled row, or with one label only, every score is that
label's share (0.5 without any); an empty table gives an empty result; further columns are ignored.
"""

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.llm.tables import ids_and_texts, is_held_out
from ledgerlab.session import cut_lineage

# Labelled rows to learn from at most.
SAMPLE = 20_000
TREES, DEPTH, L1 = 20, 4, 0.002
THRESHOLD = 0.5
_STATISTICS = [
    "log_chars", "log_words", "chars_per_word", "letters", "capitals", "digits", "blanks", "stops", "bangs", "bars",
    "marks", "distinct_words", "repeated_neighbours", "top_word", "distinct_lines", "words_per_line", "words_per_stop",
    "long_words", "short_words", "title_words",
]
STATISTICS_DDL = "doc_id long, " + ", ".join(f"{name} double" for name in _STATISTICS)
_SCHEMA = pa.schema([("doc_id", pa.int64()), *((name, pa.float64()) for name in _STATISTICS)])
# Bytes that `bytes.translate` takes out to be counted by the difference in length.
_CAPITALS, _SMALL = bytes(range(65, 91)), bytes(range(97, 123))
_DIGITS, _BLANKS, _STOPS = b"0123456789", b" \t\n\r\x0b\x0c", b".,;:?"
_WIDE = bytes(range(128, 256))


def _of(text: str) -> list[float]:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    chars, count = len(data), len(words)
    if not count:
        return [math.log1p(chars), *[0.0] * (len(_STATISTICS) - 1)]
    counted = lambda taken: chars - len(data.translate(None, taken))
    capitals, digits, blanks, stops = counted(_CAPITALS), counted(_DIGITS), counted(_BLANKS), counted(_STOPS)
    letters = capitals + counted(_SMALL) + counted(_WIDE)
    bangs, bars = data.count(b"!"), data.count(b"|")
    if text.isascii():
        upper = capitals
    else:
        upper = capitals + sum(map(str.isupper, text.translate(_NO_ASCII)))
    lines = [line for line in data.split(b"\n") if line]
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    lengths = list(map(len, words))
    neighbours = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(chars), math.log1p(count), (chars - blanks) / count, letters / chars, upper / max(letters, 1),
        digits / chars, blanks / chars, stops / chars, bangs / chars, bars / chars,
        (chars - letters - digits - blanks - stops - bangs - bars) / chars, len(seen) / count, neighbours / count,
        max(seen.values()) / count, len(set(lines)) / max(len(lines), 1), count / max(len(lines), 1),
        count / (1 + data.count(b".")), sum(n > 12 for n in lengths) / count, sum(n < 3 for n in lengths) / count,
        sum(map(bytes.istitle, words)) / count,
    ]


_NO_ASCII = dict.fromkeys(range(128))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, statistic, ...) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_of(text.as_py()) for text in batch.column("text")]
            columns = [pa.array(column, pa.float64()) for column in zip(*rows, strict=True)] if rows else [
                pa.array([], pa.float64()) for _ in _STATISTICS]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], schema=_SCHEMA)

    return ids_and_texts(docs).mapInArrow(measure, STATISTICS_DDL)


@dataclass(frozen=True)
class Rules:
    """An intercept and weighted conjunctions: ((statistic, above, threshold), ...) -> weight."""

    intercept: float
    weights: tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...] = ()

    def to_json(self) -> str:
        return json.dumps({"intercept": self.intercept, "weights": self.weights})

    @classmethod
    def from_json(cls, text: str) -> "Rules":
        held = json.loads(text)
        return cls(held["intercept"], tuple(
            (tuple((name, above, limit) for name, above, limit in terms), weight) for terms, weight in held["weights"]))


def holds(terms: tuple[tuple[str, bool, float], ...]) -> Column:
    """A conjunction as a Spark column."""
    out = F.lit(True)
    for name, above, limit in terms:
        out = out & (F.col(name) > limit if above else F.col(name) <= limit)
    return out


def score(rules: Rules) -> Column:
    """The ensemble as one Spark column: the logistic of intercept and weights of the rules that hold."""
    total = F.lit(rules.intercept)
    for terms, weight in rules.weights:
        total = total + F.when(holds(terms), weight).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def tree_paths(text: str) -> set[tuple[tuple[str, bool, float], ...]]:
    """All paths from a root to an inner or outer node, from the printed form of Spark's trees."""
    found, path = set(), []
    for line in text.splitlines():
        match = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if match:
            depth = (len(match[1]) - 4) // 1
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, _STATISTICS[int(match[3])], match[4] == ">", float(match[5])))
            found.add(_tight(tuple(term[1:] for term in path)))
        elif re.match(r" *Tree \d+", line):
            path = []
    return found


def _tight(terms: tuple[tuple[str, bool, float], ...]) -> tuple[tuple[str, bool, float], ...]:
    """One bound of each statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, limit in terms:
        known = bounds.get((name, above))
        bounds[name, above] = limit if known is None else max(known, limit) if above else min(known, limit)
    return tuple((name, above, limit) for (name, above), limit in sorted(bounds.items()))


def chosen(labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> DataFrame:
    """(doc_id, label) of at most `sample` labelled rows that are not held out."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.filter("doc_id is not null and label in (0, 1)").filter(~is_held_out())
    known = known.groupBy("doc_id").agg(F.min("label").alias("label"))
    return known.orderBy(F.md5(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(sample)


def learn(rows: DataFrame) -> Rules:
    """Rules from a bounded sample: (label, statistic, ...)."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = cut_lineage(rows, "quality-sample")
    counts = {row["label"]: row["count"] for row in rows.groupBy("label").count().collect()}
    if len(counts) < 2:
        share = next(iter(counts), 0.5)
        return Rules(20.0 * (2 * share - 1))

    rows = rows.coalesce(max(1, min(8, sum(counts.values()) // 2000)))
    inputs = VectorAssembler(inputCols=_STATISTICS, outputCol="features")
    data = inputs.transform(rows).select("label", "features", *_STATISTICS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, minInstancesPerNode=5,
                                    featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(data)
    rules = sorted(tree_paths(forest.toDebugString))
    if not rules:
        return Rules(0.0)
    names = [f"rule_{k}" for k in range(len(rules))]
    fired = data.select("label", *[holds(terms).cast("double").alias(name) for terms, name in zip(rules, names, strict=True)])
    fired = VectorAssembler(inputCols=names, outputCol="features").transform(fired).select("label", "features")
    fired = cut_lineage(fired, "quality-rules")
    model = LogisticRegression(elasticNetParam=1.0, regParam=L1, maxIter=60, standardization=False).fit(fired)
    kept = [(terms, float(w)) for terms, w in zip(rules, model.coefficients.toArray(), strict=True) if abs(w) > 1e-9]
    return Rules(float(model.intercept), tuple(kept))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    measured = cut_lineage(statistics(docs), "quality-statistics")
    # At most `sample` rows are broadcast.
    rules = learn(measured.join(F.broadcast(chosen(labels, sample=sample)), "doc_id"))
    out = measured.select("doc_id", is_held_out().alias("held_out"), score(rules).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """`docs` without the rows that score below the threshold; all columns stay as they are."""
    sampled = cut_lineage(chosen(labels, sample=sample), "quality-labels")
    known = ids_and_texts(docs).join(F.broadcast(sampled), "doc_id")
    rules = learn(statistics(known).join(F.broadcast(sampled), "doc_id"))
    measured = docs.select(F.struct(*[docs[name] for name in docs.columns]).alias("row"),
                           _measures(F.coalesce(docs["text"], F.lit(""))).alias("measures"))
    passed = measured.select("row", "measures.*").filter(score(rules) >= threshold)
    return passed.select(*[F.col("row")[name].alias(name) for name in docs.columns])


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in _STATISTICS]))
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_of(text) for text in texts], columns=_STATISTICS, dtype=float)
