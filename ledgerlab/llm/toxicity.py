"""Toxicity by compression distance: windows of a text compressed with a toxic and with an ordinary zstandard dictionary.

1. Dictionaries are built from a bounded sample of labelled rows (never held-out ones): the ordinary one holds the words
   that most ordinary documents have, the toxic one the same words and, before them, those which toxic documents have
   many times as often. Copies of a document count once, in frequencies and in totals: a document stands for its group of
   near-duplicates, confirmed on whole shingle sets (`minhash`). As both end alike, an ordinary window compresses to
   about the same length with either, and what remains is due to toxic passages.
2. A text is cut into windows of `WINDOW` words; each is compressed with both dictionaries, with a fixed tail that keeps
   even the shortest window compressible. The gain of a window is the difference of the two lengths in bytes.
3. The gains of a document (largest, how many windows reach 1, 2, 3, 4 and 5 bytes, mean, windows) are calibrated to a
   probability by a logistic regression on the sample. The model is two dictionaries of some 20 kB and ten numbers.

Defined cases: null and empty texts have one empty window, without gain, and get the model's score for it; very long
texts are read whole, window by window; rows of one doc_id are scored apart; without both labels every score is the
only label's share (0.5 without any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.llm import minhash
from ledgerlab.llm.tables import ids_and_texts, is_held_out
from ledgerlab.session import cut_lineage

# Labelled rows of each label to learn from at most.
SAMPLE_TOXIC, SAMPLE_ORDINARY = 4_000, 8_000
WINDOW = 6
# Words of the dictionaries at most; a toxic word is in so many distinct toxic documents, in this share of
# them, and so many times as often as in ordinary ones.
ORDINARY_WORDS, TOXIC_WORDS, LEAST_DOCS, LEAST_SHARE, LEAST_RATIO = 3_000, 2_000, 3, 0.01, 20.0
THRESHOLD = 0.7
# Bytes of a word's beginning that count as terms too: forms that the sample lacks share it.
BEGINS = (4, 5)
# Percentage of common shingles at which documents of the sample are copies.
COPIES = 80
# A beginning is kept if it is in so many times as many toxic documents as the best word with it.
SHARED_BEGINNING = 1.5
TAIL = b" ~tail~of~every~window~that~keeps~it~compressible~ "
STEPS = (1, 2, 3, 4, 5)
_EDGES = b".,;:!?\"'()"


def _words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").split()


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...]
    centre: tuple[float, ...]
    scale: tuple[float, ...]

    def score(self, gains: np.ndarray) -> np.ndarray:
        scaled = (gains - np.asarray(self.centre)) / np.asarray(self.scale)
        return 1.0 / (1.0 + np.exp(-np.clip(self.weights[0] + scaled @ np.asarray(self.weights[1:]), -30, 30)))


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    how = zstandard.ZstdCompressionParameters.from_level(
        3, window_log=17, min_match=4, strategy=zstandard.STRATEGY_LAZY, hash_log=15, chain_log=15, search_log=4,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


def window_gains(text: str, ordinary, toxic, width: int = WINDOW) -> np.ndarray:
    """Bytes that the toxic dictionary saves in each window of a text."""
    words = _words(text)
    windows = [b" " + b" ".join(words[at:at + width]) + TAIL for at in range(0, len(words), width)] or [TAIL]
    lengths = [len(ordinary(window)) - len(toxic(window)) for window in windows]
    return np.asarray(lengths)


def _features(gains: np.ndarray) -> list[float]:
    return [float(gains.max()), float(gains.min()), float(gains.mean()), float(np.log1p(len(gains))),
            *[float(np.log1p((gains >= step).sum())) for step in STEPS]]


def gains(docs: DataFrame, ordinary: bytes, toxic: bytes) -> DataFrame:
    """(doc_id, gains) of every row of (doc_id, text): the numbers that are calibrated."""
    schema = pa.schema([("doc_id", pa.int64()), ("gains", pa.list_(pa.float64()))])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain, bad = _compressor(ordinary).compress, _compressor(toxic).compress
        for batch in batches:
            rows = [_features(window_gains(text.as_py(), plain, bad)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, schema.field("gains").type)],
                                             schema=schema)

    return docs.mapInArrow(measure, "doc_id long, gains array<double>")


def _sample(labels: DataFrame, label: str, limits: dict[int, int]) -> DataFrame:
    """(doc_id, label) of at most so many rows of each label, those with the least md5 of their ids."""
    known = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter("doc_id is not null").filter(~is_held_out()).groupBy("doc_id").agg(F.min("label").alias("label"))
    place = F.md5(F.col("doc_id").cast("string").cast("binary"))
    parts = [known.filter(F.col("label") == value).orderBy(place, "doc_id").limit(limit) for value, limit in limits.items()]
    return parts[0].unionByName(parts[1])


def _units(sample: DataFrame) -> DataFrame:
    """(doc_id, label, text, stands_for) of the sample: near copies stand for the least doc_id of their group."""
    groups = minhash.groups(sample, percent=COPIES).groupBy("doc_id").agg(F.min("component_id").alias("stands_for"))
    return sample.join(groups, "doc_id")


def _document_words(sample: DataFrame) -> DataFrame:
    """(label, word, whole, stands_for): distinct words of each document, and how they begin."""
    schema = pa.schema([("label", pa.int32()), ("word", pa.binary()), ("whole", pa.bool_()), ("stands_for", pa.int64())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text, unit in zip(*map(batch.column, ("label", "text", "stands_for")), strict=True):
                words = {bare for word in _words(text.as_py()) if (bare := word.strip(_EDGES))}
                if words:
                    begins = {word[:size] for word in words for size in BEGINS if len(word) > size} - words
                    count = len(words) + len(begins)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([label.as_py()] * count, pa.int32()), pa.array([*words, *begins], pa.binary()),
                         pa.array([True] * len(words) + [False] * len(begins)),
                         pa.array([unit.as_py()] * count, pa.int64())], schema=schema)

    return sample.select("label", "text", "stands_for").mapInArrow(split, "label int, word binary, whole boolean, stands_for long")


def dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """The ordinary and the toxic dictionary from (doc_id, label, text) of a bounded sample."""
    units = cut_lineage(_units(sample), "toxicity-units")
    found = _document_words(units).groupBy("word").agg(
        *[F.count_distinct(F.when(F.col("label") == value, F.col("stands_for"))).alias(name)
          for name, value in (("plain", 0), ("bad", 1))], F.max("whole").alias("whole"))
    found = cut_lineage(found, "toxicity-words")
    totals = {row["label"]: row["many"] for row in units.groupBy("label").agg(
        F.count_distinct("stands_for").alias("many")).collect()}
    often = found.filter("whole and plain > 0").orderBy(F.desc("plain"), "word").limit(ORDINARY_WORDS)
    ratio = (F.col("bad") / totals[1]) / ((F.col("plain") + 1) / totals[0])
    least = max(LEAST_DOCS, LEAST_SHARE * totals[1])
    typical = found.filter((F.col("bad") >= least) & (ratio > LEAST_RATIO)).orderBy(F.desc("bad"), "word").limit(TOXIC_WORDS)
    plain = b" ".join(bytes(row["word"]) for row in often.collect()[::-1]) + TAIL  # the most frequent come last, nearest
    terms = typical.collect()
    # A beginning that one word has alone says no more than that word, and shorter matches mislead.
    whole = [row for row in terms if row["whole"]]
    best = {row["word"]: max((w["bad"] for w in whole if w["word"].startswith(row["word"])), default=0) for row in terms}
    terms = [row for row in terms if row["whole"] or row["bad"] > SHARED_BEGINNING * best[row["word"]]]
    bad = b" ".join(bytes(row["word"]) for row in terms[::-1])
    return b" " + plain, b" " + bad + b" " + plain


def _fit(values: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights (intercept first), centre and scale by Newton steps."""
    centre, scale = values.mean(0), values.std(0) + 1e-9
    data = np.column_stack([np.ones(len(values)), (values - centre) / scale])
    weights = np.zeros(data.shape[1])
    for _ in range(40):
        chance = 1.0 / (1.0 + np.exp(-np.clip(data @ weights, -30, 30)))
        pull = data.T @ (labels - chance) - ridge * weights
        curve = (data * (chance * (1 - chance))[:, None]).T @ data + ridge * np.eye(len(weights))
        step = np.linalg.solve(curve, pull)
        weights = weights + step
        if np.abs(step).max() < 1e-8:
            break
    return weights, centre, scale


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model | float:
    """The model, or the only label's share if there are not both labels."""
    chosen = _sample(labels, label, {1: SAMPLE_TOXIC, 0: SAMPLE_ORDINARY})
    sample = cut_lineage(ids_and_texts(docs).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # bounded sample
    found = [row["label"] for row in sample.select("label").distinct().collect()]
    if len(found) < 2:
        return float(found[0]) if found else 0.5
    ordinary, toxic = dictionaries(sample)
    rows = gains(sample, ordinary, toxic).join(F.broadcast(chosen), "doc_id").select("gains", "label").collect()
    values = np.asarray([row["gains"] for row in rows])
    weights, centre, scale = _fit(values, np.asarray([row["label"] for row in rows], float))
    return Model(ordinary, toxic, tuple(weights), tuple(centre), tuple(scale))


def scored(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels)
    texts = ids_and_texts(docs)
    if isinstance(model, float):
        out = texts.select("doc_id", F.lit(model).alias("score"))
    else:
        schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                values = np.asarray(batch.column("gains").to_pylist(), float).reshape(batch.num_rows, -1)
                scores = model.score(values) if batch.num_rows else np.empty(0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], schema=schema)

        out = gains(texts, model.ordinary, model.toxic).mapInArrow(judge, "doc_id long, score double")
    return out.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
