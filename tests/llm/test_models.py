"""Classifiers by held-out accuracy, searches on embeddings against brute force, and the pipeline."""

import importlib
import math
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlab.llm import embedding_dedup, quality, topk, toxicity
from ledgerlab.llm.graph import components
from ledgerlab.llm.tables import read

SF = "/root/testdata/sf0.01"


def auc(rows, label):
    scores = np.asarray([r.score for r in rows])
    truth = np.asarray([r[label] for r in rows])
    order = scores.argsort(kind="stable")
    ranks = np.empty(len(rows))
    ranks[order] = np.arange(1, len(rows) + 1)
    for value in np.unique(scores):
        ranks[scores == value] = ranks[scores == value].mean()
    good, bad = truth.sum(), (1 - truth).sum()
    return (ranks[truth == 1].sum() - good * (good + 1) / 2) / (good * bad)


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.99), (toxicity, "toxic", 0.92)])
def test_held_out_accuracy(spark, module, label, least):
    docs, labels = read(spark, "/root/testdata/sf0.1", "documents"), read(spark, "/root/testdata/sf0.1", "labels")
    out = module.scored(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert auc(rows, label) >= least
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= module.THRESHOLD) for r in rows)


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_on_odd_tables(make_docs, labels, module):
    odd = [(1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (None, "x")]
    out = module.scored(make_docs(odd, ("label", "score")), labels([])).collect()
    assert [r.score for r in out] == [0.5] * 5
    one = module.scored(make_docs(odd), labels([(1, 1, 1), (2, 1, 1), (3, 1, 1)])).collect()
    assert {r.predicted for r in one} == {1}
    assert module.scored(make_docs([]), labels([(1, 1, 1)])).collect() == []


def test_toxic_words_of_documents_that_share_a_common_word(spark, make_docs):
    """Documents of their own count each, though all share the word with the least hash; copies count once."""
    random = np.random.default_rng(4)
    vocabulary = [f"w{k}" for k in range(500)] + ["vileword", "copiedword"]
    common = min(vocabulary, key=lambda word: xxhash.xxh3_64_intdigest(word.encode()))
    texts = [" ".join([common, *random.choice(vocabulary[:500], 20), *["vileword"] * (k % 2)]) for k in range(80)]
    copied = " ".join([*vocabulary[:40], "copiedword"])
    rows = [(k, k % 2, text) for k, text in enumerate(texts)] + [(1000 + k, 1, f"{copied} x{k}") for k in range(50)]
    plain, bad = toxicity.dictionaries(spark.createDataFrame(rows, "doc_id long, label int, text string"))
    learnt = bad[:len(bad) - len(plain)].split()
    assert b"vileword" in learnt and b"copiedword" not in learnt


def test_accepted_drops_rejects_only(spark, make_docs, clashing, labels):
    docs = [(k, "Plain words make a plain sentence, here and there." if k % 2 else "BUY!!! NOW!!! " * 9) for k in range(400)]
    out = quality.accepted(make_docs(docs, clashing), labels([(k, k % 2, 0) for k in range(400)]))
    assert set(clashing) < set(out.columns)
    assert sorted(r.doc_id for r in out.collect()) == list(range(1, 400, 2))


def test_rules_survive_their_json():
    rules = quality.Rules(0.5, (((("bangs", True, 0.25), ("digits", False, 1e-3)), -1.5),))
    assert quality.Rules.from_json(rules.to_json()) == rules


EMBEDDINGS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                           T.StructField("label", T.IntegerType())])
ODD = [(9001, None), (9002, [0.0] * 8), (9003, [None] + [1.0] * 7), (9004, [float("nan")] * 8), (9005, [float("inf")] * 8),
       (9006, []), (9007, [1.0] * 3), (None, [1.0] + [0.0] * 7)]


def vectors(count, seed, spread=0.1):
    random = np.random.default_rng(seed)
    base = random.standard_normal((max(1, count // 6), 8))
    rows = base[random.integers(0, len(base), count)] + spread * random.standard_normal((count, 8))
    rows[: count // 10] = rows[0]
    return [(k, [float(np.float32(x)) for x in row]) for k, row in enumerate(rows)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], EMBEDDINGS).withColumn("node", F.lit(1)).withColumn("v", F.lit(2))


def test_embedding_links(spark, make_docs):
    rows = vectors(600, 1)
    unit = np.asarray([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    label = np.arange(len(rows))
    while True:
        new = np.asarray([label[near[k]].min() for k in range(len(rows))])
        if (new == label).all():
            break
        label = new
    out = {r.vec_id: r for r in embedding_dedup.linked(table(spark, rows + ODD)).collect()}
    assert len(out) == len(rows) + len(ODD)
    found = sum(out[k].n_links for k in range(len(rows)))
    assert found <= near.sum() - len(rows) and found >= 0.98 * (near.sum() - len(rows))
    assert all(out[k].n_links <= near[k].sum() - 1 for k in range(len(rows)))
    wrong = sum(out[k].component_id != label[k] for k in range(len(rows)))
    assert wrong <= 0.02 * len(rows)
    assert all(out[k].n_links == 0 and out[k].component_id == k and out[k].kept for k, _ in ODD[:-1])
    assert out[None].component_id is None
    assert embedding_dedup.linked(table(spark, [])).collect() == []


def test_nearest_cells_come_in_order():
    random = np.random.default_rng(2)
    a, b = random.random(7), random.random(9)
    sums = (a[:, None] + b[None]).ravel()
    assert embedding_dedup.nearest_cells(a, b, 20) == sums.argsort(kind="stable")[:20].tolist()


def test_top_k(spark, make_docs, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 50)
    monkeypatch.setattr(topk, "BINS", 16)
    rows = vectors(400, 3) + [(7777, [0.5] * 8), (7777, [0.5] * 8)]
    usable = rows + [ODD[1]]
    whole = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in usable]
    want = []
    for q, v in whole:
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in whole if i != q)[:20]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    got = topk.top_k(table(spark, rows + ODD)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    few = topk.top_k(table(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])])).collect()
    assert sorted(map(tuple, few)) == [(0, 1, 1, 0), (0, 2, 2, -4096)]
    assert topk.top_k(table(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    out = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert all(out[k] == 0 for k in range(41)) and all(out[k] == 100 for k in range(101, 160))


def test_pipeline(spark, make_docs):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = read(spark, SF, "documents")
    columns, sizes = docs.columns, []
    before = {r.doc_id for r in docs.collect()}
    for name, stage in pipeline.STAGES[:4]:
        folder = f"{pipeline.shared_folder(spark)}/test-{name}-{zlib.crc32(str(id(docs)).encode())}"
        stage(spark, docs, SF).write.mode("overwrite").parquet(folder)
        docs = spark.read.parquet(folder)
        assert docs.columns == columns
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before
        before = ids
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] == sizes[2] < sizes[3]
    labels = read(spark, SF, "labels")
    assert pipeline.tokens(spark, docs, SF).count() == docs.count()
    bad = labels.filter("quality = 0").count()
    assert docs.select("doc_id").distinct().join(labels.filter("quality = 0"), "doc_id").count() <= 0.05 * bad


def test_stages_on_odd_tables(spark, make_docs, clashing):
    from ledgerlab.session import cut_lineage

    pipeline = importlib.import_module("corpus_pipeline")
    odd = [(1, None, None), (2, "", ""), (None, "no id at all", "a"), (4, "x" * 20000, "b"), (5, "one two three " * 4000, "b"),
           (6, "mail a@b.co or +1 (555) 010-1234", "a"), (6, "mail a@b.co or +1 (555) 010-1234", "a")]
    for rows in (odd, []):
        docs = make_docs(rows, clashing)
        for name, stage in pipeline.STAGES[1:]:
            before = docs.columns
            docs = cut_lineage(stage(spark, docs, SF), f"test-{name}")
            if name != pipeline.STAGES[-1][0]:
                assert docs.columns == before, name
                assert (docs.count() > 0) == bool(rows), name
        assert (docs.count() > 0) == bool(rows)
        assert pipeline.quality_classifier(spark, make_docs(rows, clashing), SF).columns == before


def test_vectors_of_every_length_take_part(spark):
    random.seed(21)
    long = [(k, [1.0, 0.01 * (k % 3), 0.0]) for k in range(0, 60)]
    short = [(100 + k, [0.5, 0.5]) for k in range(21)] + [(200, [0.5, -0.5]), (201, [7.0])]
    links = {r.vec_id: r for r in embedding_dedup.linked(table(spark, long + short)).collect()}
    assert {links[k].n_links for k, _ in long} == {59} and {links[k].component_id for k, _ in long} == {0}
    assert {links[100 + k].n_links for k in range(21)} == {20} and {links[100 + k].component_id for k in range(21)} == {100}
    assert (links[200].n_links, links[200].component_id, links[201].n_links) == (0, 200, 0)
    found = {}
    for row in topk.top_k(table(spark, long + short)).collect():
        found.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    assert sorted(found) == [0, 20, 40, 100, 120, 200]
    whole = {k: [math.floor(64 * c) for c in v] for k, v in long + short}
    for query, rows in found.items():
        best = sorted((-sum(a * b for a, b in zip(whole[query], v)), k) for k, v in whole.items() if k != query and len(v) == len(whole[query]))[:20]
        assert sorted(rows) == [(place, k, -score) for place, (score, k) in enumerate(best, 1)]


def test_recall_of_links_at_the_threshold(spark):
    random_ = np.random.default_rng(4)
    base = random_.standard_normal((1500, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = random_.standard_normal(base.shape)
    noise -= (noise * base).sum(1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    turned = 0.903 * base + np.sqrt(1 - 0.903 ** 2) * noise
    every = np.concatenate([base, turned]).astype(np.float32)
    unit = every.astype(float) / np.linalg.norm(every.astype(float), axis=1)[:, None]
    linked = unit @ unit.T >= 0.9
    np.fill_diagonal(linked, False)
    got = {r.vec_id: r.n_links for r in embedding_dedup.linked(table(spark, list(enumerate(every.tolist())))).collect()}
    want = linked.sum(1)
    assert want.sum() >= 2900 and all(got[k] <= want[k] for k in got)
    assert sum(got.values()) >= 0.99 * want.sum()


def test_toxicity_scores_of_a_fixed_model_by_a_plain_loop(make_docs):
    """Odd texts too: each score from the compressed lengths of every window, counted one by one."""
    from ledgerlab.llm.tables import ids_and_texts

    ordinary, toxic = b" the of and to in that it was for on are with as they at ", b" vileword badword uglything the of and to in that it was for on are with as they at "
    model = toxicity.Model(ordinary, toxic, (-1.0, 0.5, 0.1, 2.0, -0.2, 0.3, 0.2, 0.1, 0.1, 0.4), (0.0,) * 9, (1.0,) * 9)
    texts = [None, "", "   ", "the cat sat on the mat with vileword and badword in that place", "VileWord! badword? uglything", "x" * 30000, "word " * 9000,
             "one two three vileword five six seven", "one two three vileword five six seven"]
    got = toxicity.gains(ids_and_texts(make_docs(list(enumerate(texts)))), ordinary, toxic).collect()
    scores = model.score(np.asarray([row.gains for row in got]))
    for row, score in zip(got, scores, strict=True):
        words = (texts[row.doc_id] or "").lower().encode().split()
        saved = []
        for at in range(0, max(len(words), 1), 6):
            window = (b" " + b" ".join(words[at:at + 6]) if words else b"") + toxicity.TAIL
            saved.append(len(toxicity._compressor(ordinary).compress(window)) - len(toxicity._compressor(toxic).compress(window)))
            if len(saved) > 200 and set(words) == {b"word"}:  # all whole windows of one repeated word are alike
                saved += [saved[0]] * (len(range(0, len(words), 6)) - len(saved))
                break
        numbers = [max(saved), min(saved), sum(saved) / len(saved), math.log1p(len(saved)), *[math.log1p(sum(s >= step for s in saved)) for step in range(1, 6)]]
        assert np.allclose(row.gains, numbers), row.doc_id
        want = 1 / (1 + math.exp(-(model.weights[0] + sum(w * n for w, n in zip(model.weights[1:], numbers)))))
        assert abs(score - want) < 1e-9, row.doc_id
    by_id = {row.doc_id: score for row, score in zip(got, scores, strict=True)}
    assert by_id[4] > by_id[0] == by_id[1] == by_id[2] and by_id[7] == by_id[8]
