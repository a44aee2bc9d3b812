"""Vector codes, ranked search and packing against brute force, on small tables with the odd cases in."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T
from tokenizers import Tokenizer

from ledgerlab.llm import packing, ranked, vector_codes

SF = "/root/testdata/sf0.001"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
NAN, INF = float("nan"), float("inf")


# --- vector codes -------------------------------------------------------------------------------------------------

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                        T.StructField("label", T.IntegerType())])


def brute_codes(rows, entries=256, rounds=4, scale=1024):
    """{(vec_id, vector): (code, error)}, {label: error} and the codebook digest of each length."""
    kept = [(i, tuple(math.floor(scale * c) for c in v), label) for i, v, label in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    codes, by_label, digests = {}, Counter(), {}
    for width in {len(v) for _, v, _ in kept}:
        mine = sorted((row for row in kept if len(row[1]) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        ends = [k * width // 4 for k in range(5)]
        parts = [[row[1][ends[k]:ends[k + 1]] for row in mine] for k in range(4)]
        books = [[list(p) for p in points[:entries]] for points in parts]

        def nearest(book, point):
            return min((sum((a - b) ** 2 for a, b in zip(point, entry, strict=True)), k) for k, entry in enumerate(book))

        for _ in range(rounds):
            for points, book in zip(parts, books, strict=True):
                held = {}
                for point in points:
                    held.setdefault(nearest(book, point)[1], []).append(point)
                for k, group in held.items():
                    book[k] = [sum(column) // len(group) for column in zip(*group, strict=True)]
        for place, (vec_id, vector, label) in enumerate(mine):
            found = [nearest(book, points[place]) for points, book in zip(parts, books, strict=True)]
            codes[vec_id, vector] = "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)
            by_label[label] += sum(d for d, _ in found)
        digests[width] = vector_codes.digest([np.array(book, np.int64) for book in books])
    return kept, codes, by_label, digests


def check_codes(spark, rows, clashing=(), **options):
    frame = spark.createDataFrame(rows, VECTORS)
    for name in clashing:
        frame = frame.withColumn(name, frame["vec_id"])
    got = vector_codes.vector_codes(frame, **options).collect()
    kept, codes, by_label, digests = brute_codes(rows, **options)
    want = [(i, *codes[i, v], by_label[label], digests[len(v)]) for i, v, label in kept]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_vector_codes(spark, clashing):
    random.seed(7)
    some = [[random.gauss(0, 0.2) for _ in range(12)] for _ in range(40)]
    rows = [(k, [c + random.choice([0, 0, 0.01, -0.002]) for c in random.choice(some)], random.choice([None, 0, 1, 2]))
            for k in range(420)]
    rows += [(1000, None, 0), (1001, [0.1] * 11 + [NAN], 0), (1002, [INF] * 12, 1), (1003, [None] * 12, 1), (5, rows[5][1], 2),
             (5, [0.5] * 12, None), (None, [-0.5] * 12, 3), (7, rows[8][1], 0), (2000, [0.0] * 12, 1)]
    check_codes(spark, rows, ("v", "x", "part", "entry", "width", "same", "total", "code"))
    check_codes(spark, rows, entries=8, rounds=2, scale=64)


def test_vector_codes_of_several_lengths(spark):
    random.seed(8)
    rows = [(k, [random.uniform(-1, 1) for _ in range(random.choice([0, 3, 8, 8, 8, 16]))], k % 3) for k in range(200)]
    check_codes(spark, rows)
    check_codes(spark, rows, entries=4)


def test_vector_codes_of_few_equal_and_no_rows(spark):
    check_codes(spark, [(k, [0.25] * 8, 1) for k in range(30)])  # ties: the least index
    check_codes(spark, [(9, [0.25] * 8, None)])
    assert vector_codes.vector_codes(spark.createDataFrame([], VECTORS)).collect() == []
    huge = vector_codes.vector_codes(spark.createDataFrame([(1, [3e38] * 8, 1), (2, [-3e38] * 8, 1)], VECTORS)).collect()
    assert sorted((r.vec_id, r.code, r.error) for r in huge) == [(1, "00000000", 0), (2, "01010101", 0)]


def test_first_books_hold_the_least_ids(spark):
    rows = [(k * 7919 % 20011, [float(k * 7919 % 20011 % 97)] * 4, 0) for k in range(20011)]
    books = vector_codes.first_books(vector_codes.whole_vectors(spark.createDataFrame(rows, VECTORS), 1), entries=16)
    assert books[4][0].ravel().tolist() == list(range(16))
    none = [(None, [float(k % 5)] * 4, 0) for k in range(300)] + [(k, [9.0] * 4, 0) for k in range(3)]
    books = vector_codes.first_books(vector_codes.whole_vectors(spark.createDataFrame(none, VECTORS), 1), entries=16)
    assert books[4][0].ravel().tolist() == [9] * 3 + [0] * 13


def test_dominated_entries_are_skipped_and_no_nearest_one_is():
    random_ = np.random.default_rng(3)
    book = random_.integers(-500, 500, (256, 3))
    cells = vector_codes.Cells(book)
    points = random_.integers(-600, 600, (5000, 3))
    entries, distances = cells.nearest(points)
    every = ((points[:, None] - book[None]) ** 2).sum(2)
    assert (entries == every.argmin(1)).all() and (distances == every.min(1)).all()
    again = cells.nearest(points)
    assert (again[0] == entries).all()
    assert np.mean([len(held) for held in cells.known.values()]) < 64  # of 256


# --- ranked search ------------------------------------------------------------------------------------------------

def terms(text):
    out, word = [], ""
    for letter in text or "":
        if ord(letter) >= 128 or letter in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
            word += letter.lower() if ord(letter) < 128 else letter
        elif word:
            out.append(word)
            word = ""
    return [*out, word] if word else out


def brute_ranked(docs, items, k=10):
    held = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs if terms(text)]
    count, length = len(held), sum(n for _, _, n in held)
    df = Counter(term for _, words, _ in held for term in words)
    out = []
    for item_id, words in {(item_id, frozenset(terms(text))) for item_id, text in items}:
        scores = []
        for doc_id, tf, n in held:
            m = 10 + 90 * n * count // length
            score = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[term] + 1))) * (10 ** 9 * tf[term] // (1000 * tf[term] + 8 * m))
                        for term in words if tf[term])
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0))
        out += [(item_id, rank, None if none else doc_id, -score) for rank, (score, none, doc_id) in enumerate(sorted(scores)[:k], 1)]
    return out


def check_ranked(spark, docs, items, make_docs, extra=(), **options):
    frame = spark.createDataFrame(items, "item_id long, text string")
    for name in extra:
        frame = frame.withColumn(name, frame["item_id"])
    got = ranked.ranked(make_docs(docs, extra), frame, **options).collect()
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(map(tuple, got), key=key) == sorted(brute_ranked(docs, items, **options), key=key)
    return got


def test_ranked_search(spark, make_docs):
    random.seed(11)
    common = ["the", "of", "and", "in", "to"]
    rare = [f"w{k}" for k in range(60)] + ["año", "中文", "x\u0000y", "É1"]
    text = lambda n: random.choice([" ", "-", ", "]).join(random.choice(common if random.random() < 0.6 else rare) for _ in range(n))
    docs = [(k, text(random.randint(1, 60)) if k % 3 else "The same copy, of w1 and w2 in W3!") for k in range(900)]
    docs += [(None, text(40)), (None, "w1 w1 w2"), (5000, None), (5001, ""), (5002, " ?! "), (5003, "w5 " * 30000),
             (5004, "Q" * 200000), (6, docs[6][1]), (7, text(9))]
    items = [(k, text(random.randint(1, 30))) for k in range(40)]
    items += [(100, None), (101, ""), (102, "unknown words only"), (103, "the"), (104, docs[3][1]), (104, docs[3][1]),
              (104, "w9 año"), (None, "É1 中文 É1"), (105, "of " * 50000 + "w7")]
    check_ranked(spark, docs, items, make_docs, ("item", "rank", "score", "terms", "n", "m"))
    check_ranked(spark, docs, items[:5], make_docs, k=3)


def test_ranked_search_in_several_blocks(spark, make_docs, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_ITEMS", 3)
    random.seed(12)
    words = [f"t{k}" for k in range(30)]
    docs = [(k, " ".join(random.choices(words, k=random.randint(1, 20)))) for k in range(200)]
    items = [(k, " ".join(random.choices(words, k=4))) for k in range(13)]
    assert len(check_ranked(spark, docs, items, make_docs)) == 130


def test_ranked_search_of_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert ranked.ranked(make_docs([]), items).collect() == []
    assert ranked.ranked(make_docs([(1, "a")]), items.limit(0)).collect() == []
    assert ranked.ranked(make_docs([(1, "zz")]), items).collect() == []


def test_trees_share_paths_and_bounds_prune():
    random_ = np.random.default_rng(5)
    vectors = sorted((np.unique(random_.zipf(1.5, 12).clip(1, 80) - 1).astype(np.int32) for _ in range(400)), key=lambda v: v.tolist())
    times = [random_.integers(1, 4, len(vector)).astype(np.int32) for vector in vectors]
    ids, norms = random_.permutation(400), random_.integers(10, 400, 400)
    tree = ranked.Tree(ids, norms, vectors, times)
    starts = tree.children(0, 400)
    depth = tree.shared.min()
    assert 1 < len(starts) < 400 and all((vectors[a - 1][:depth] == vectors[a][:depth]).all() for a in starts[1:])
    asked = (random_.random((80, 20)) < 0.1).astype(float)
    weights = random_.integers(0, 9000, 80)
    best = ranked.Best(20, 5)
    tree.search(asked, weights, best)
    full = np.zeros((400, 80), np.int64)
    for row, (vector, counts) in enumerate(zip(vectors, times, strict=True)):
        full[row, vector] = counts
    scores = (weights * (10 ** 9 * full // (1000 * full + 8 * norms[:, None]))).astype(float) @ asked
    for item in range(20):
        order = np.lexsort((ids, -scores[:, item]))[:5]
        assert best.ids[item].tolist() == ids[order].tolist() and best.scores[item].tolist() == scores[order, item].tolist()


# --- packing ------------------------------------------------------------------------------------------------------

ODD = [(1, None), (2, ""), (3, " "), (4, "  two  spaces \n\n end "), (5, "word " * 9000), (6, "x" * 40000), (7, "\n" * 3000 + "a"),
       (8, "é中🎉<|endoftext|>y <|endoftext|>"), (8, "repeated id"), (8, "repeated id"), (None, "no id"), (9, "tab\tand\x1c \x85  it's")]


def check_packed(rows, got, capacity, end_id=0):
    """Pieces are whole and cut rightly, sequences are gapless; the number of sequences."""
    library = Tokenizer.from_file(BYTE_BPE)
    want, held = Counter(), {}
    for doc_id, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        pieces = -(-len(ids) // capacity)
        places = [0, *range(len(ids) - (pieces - 1) * capacity, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(places, places[1:], strict=False)):
            want[doc_id, piece, a, b - a, zlib.crc32(np.asarray(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    for row in got:
        held.setdefault(row.sequence_id, []).append((row.offset, row.length))
    for places in held.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held)


@pytest.mark.parametrize("capacity", [2048, 100, 7])
def test_packing(spark, make_docs, capacity):
    sample = spark.read.parquet(f"{SF}/documents.parquet").limit(200 if capacity == 2048 else 40).collect()
    rows = ODD + [(r.doc_id + 100, r.text) for r in sample]
    got = packing.places(make_docs(rows, ("length", "task", "nth", "place", "sequence_id", "many")), BYTE_BPE, capacity).collect()
    count = check_packed(rows, got, capacity)
    assert count <= 1.02 * sum(r.length for r in got) / capacity + 2


def test_packed_sequences_hold_the_ids(spark, make_docs):
    rows = ODD + [(20 + k, f"text number {k} " * (k % 40)) for k in range(120)]
    packed = packing.packed(make_docs(rows), BYTE_BPE, 512)
    sequences = {r.sequence_id: r for r in packing.sequences(packed).collect()}
    for row in packed.collect():
        ids = sequences[row.sequence_id].ids
        assert len(ids) <= 512 and ids[row.offset:row.offset + row.length] == row.ids
        assert row.doc_id in sequences[row.sequence_id].doc_ids
    assert sum(len(r.ids) for r in sequences.values()) == sum(row.length for row in packed.collect())


def test_packing_of_an_empty_table(spark, make_docs):
    assert packing.places(make_docs([]), BYTE_BPE).collect() == []


def test_words_encode_as_the_library_does():
    library, words = Tokenizer.from_file(BYTE_BPE), packing._Words.load(BYTE_BPE)
    random.seed(5)
    parts = ["a", "b", " ", "  ", "\n", "\t", "\x1c", " ", " ", "　", "'s", "'t", "1", "²", "é", "中", "🎉", "<|endoftext|>", ".",
             "\r", "\x85", " ab", "Hello", " 'll", "İ"]
    for _ in range(4000):
        text = "".join(random.choices(parts, k=random.randint(0, 14)))
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text
    for text in ("a" + "\n" * 2000 + " b", " " * 3000, "x" * 5000 + "  y"):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def brute_best_fit(lengths, capacity):
    """Contents of sequences, one piece after another."""
    bins = []
    large = sorted((length for length in lengths if 3 * length > capacity), reverse=True)
    while large:
        first = large.pop(0)
        partner = next((length for length in large if first + length <= capacity), None)
        if partner is not None:
            large.remove(partner)
        bins.append([first] if partner is None else [first, partner])
    for length in sorted((length for length in lengths if 3 * length <= capacity), reverse=True):
        fitting = [held for held in bins if sum(held) + length <= capacity]
        if fitting:
            max(fitting, key=sum).append(length)
        else:
            bins.append([length])
    return Counter(tuple(sorted(held)) for held in bins)


def test_plan_is_best_fit_one_by_one():
    random.seed(9)
    for capacity in (12, 30, 100):
        for _ in range(60):
            top = random.choice([capacity, capacity // 2, capacity // 4])
            lengths = [random.randint(1, max(1, top)) for _ in range(random.randint(0, 120))]
            counts, seen = Counter(lengths), Counter()
            runs = packing.plan(counts, capacity)
            held = {}
            for length, first, each, sequence, offset in runs:
                later = [run[1] for run in runs if run[0] == length and run[1] > first]
                for number in range(first, min(later, default=counts[length])):
                    place = number - first
                    held.setdefault(sequence + place // each, []).append((offset + place % each * length, length))
                    seen[length] += 1
            assert seen == counts
            for places in held.values():
                ends = [offset + length for offset, length in sorted(places)]
                assert [offset for offset, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= capacity
            assert Counter(tuple(sorted(length for _, length in places)) for places in held.values()) == brute_best_fit(lengths, capacity)


def test_plan_is_small_whatever_the_number_of_pieces():
    counts = {length: 10 ** 9 + length * 7919 % 1000 for length in range(1, 2049)}
    runs = packing.plan(counts)
    assert len(runs) < 5 * 2048
    sequences = max(sequence for _, _, _, sequence, _ in runs)
    assert sequences <= 1.01 * sum(length * count for length, count in counts.items()) / 2048
