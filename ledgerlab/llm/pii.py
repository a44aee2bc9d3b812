"""Personal data: four fixed kinds, and identifiers that contexts learnt from them point at.

`scan` reads each whole text once and gives the base spans (email, ip, card, phone), and as candidates every other token
that holds an @ or six digits, and every run of shorter digit groups with six digits in all ('020 7946 0958', '(555) 123
4567'; one space apart, of any number of groups). Each has its left contexts: the one and the two words before it.

`patterns` bootstraps from the base entities as seeds. Contexts and distinct entity strings form a graph. A context's
confidence for a kind is the sum of its strings' scores for that kind over all strings seen with it (smoothed); a
candidate string's score is the noisy-or of its contexts' confidences. Both are computed by Spark joins and
aggregations over the whole graph, round after round until no context gains, so an unknown string can vouch for further
contexts, also for those without any seed. What a context itself, or the same place in one word more or less, says of a
string counts for that context by seeds alone: no context raises itself. Contexts with enough support
(distinct seeds and scores of strings) and confidence are patterns; `discovered` marks the candidates behind them.

Distinct strings count, so a line copied into a third of all documents is one vote. The graph's joins are inner joins on
strings and contexts of tables that were aggregated before, which adaptive execution splits where a context is hot.

Patterns of the fixed kinds never scan a run of characters twice (runs are matched possessively, emails from their @),
so time is linear in the text's length.

Defined cases: a null or empty text has no spans: counts of 0, empty strings, the digest of the empty string; rows
that repeat a doc_id are judged by their own text; a null doc_id is kept as such; an empty table gives an empty result;
further columns are ignored by `found` and kept by `redacted`. Where spans of two kinds overlap both are reported, and
redaction replaces their union once, by the kind listed first.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlab.llm.tables import ids_and_texts
from ledgerlab.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
# Rounds go on while a context gains more confidence than this.
GAIN = 0.001
# A pattern has so much support by distinct strings and this confidence; a candidate has this score and so many digits (or an @).
LEAST_SEEDS, LEAST_CONFIDENCE, LEAST_SCORE, LEAST_DIGITS = 12, 0.85, 0.85, 6
# Words and strings that are longer stand in the graph by a 128-bit hash: it only asks whether two are equal. Of the token that an
# entity begins within, so many characters before it are its context.
LONG = 64

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ANY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
# Characters of a digit group, how a further one begins, and what ends a run of them.
_GROUP, _OPENS, _ENDS = frozenset("0123456789().-+"), tuple("0123456789("), ".,;:!?\"'[]{}<>"


def emails(text: str) -> list[tuple[int, int]]:
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)
    return out


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def _is_ip(text: str) -> bool:
    parts = [part.lstrip("0") for part in text.split(".")]
    return all(len(part) <= 3 and int(part or 0) <= 255 for part in parts)


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, in the order of `KINDS`: leftmost, not overlapping within a kind, failing matches dropped."""
    out: list[list[tuple[int, int]]] = [emails(text) if "@" in text else [], [], [], []]
    if _DIGIT.search(text):
        out[1] = [m.span() for m in _IP.finditer(text) if _is_ip(m[0])]
        out[2] = [m.span() for m in _CARD.finditer(text) if _is_card(m[0])]
        if "+" in text:
            out[3] = [m.span() for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    """`kind:start:end` by kind, then start, joined by commas."""
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def _name(text: str) -> str:
    """A string as a node of the graph."""
    return text if len(text) <= LONG else "#" + xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _context(words: list[str]) -> str:
    return " ".join(_name(re.sub("[0-9]+", "0", word.lower())) for word in words)


def _groups(text: str, run: list[tuple[int, int]]) -> tuple[int, int] | None:
    """The span of neighbouring digit groups, if they are several and have enough digits."""
    if len(run) < 2:
        return None
    start, end = run[0][0], run[-1][1]
    if text[start] == "(" and text.find(")", start, end) in (-1, end - 1):  # brackets around the whole run
        start += 1
    if text[end - 1] == ")" and text.count(")", start, end) > text.count("(", start, end):
        end -= 1
    return (start, end) if len(_digits(text[start:end])) >= LEAST_DIGITS else None


def mentions(text: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, str, list[str], int, int]]:
    """(kind or -1, string, contexts, start, end) of base entities and of other tokens or digit groups that may be identifiers."""
    if not _ANY.search(text):
        return []
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    starts = [start for start, _ in tokens]

    def contexts(start: int) -> list[str]:
        index = bisect.bisect_left(starts, start)
        before = [text[a:b] for a, b in tokens[max(0, index - 2):index]]
        if index and tokens[index - 1][1] > start:  # the entity begins within a token: what leads up to it is context
            before[-1] = text[max(tokens[index - 1][0], start - LONG):start]
        return [_context(before[-n:]) for n in (1, 2) if len(before) >= n]

    taken = sorted((a, b, kind) for kind, own in enumerate(spans) for a, b in own)
    out = [(kind, _name(text[a:b]), contexts(a), a, b) for a, b, kind in taken]
    covered, reach = 0, -1
    run: list[tuple[int, int]] = []  # digit groups one space apart, each too short to be a candidate

    def close() -> None:
        whole = _groups(text, run)
        if whole:
            out.append((-1, _name(text[slice(*whole)]), contexts(whole[0]), *whole))
        run.clear()

    for a, b in tokens:
        if run and text[run[-1][1]:a] != " ":  # more than a space apart, or punctuation behind the last group
            close()
        while covered < len(taken) and taken[covered][0] < b:
            reach = max(reach, taken[covered][1])
            covered += 1
        if reach > a:
            close()
            continue
        token = text[a:b]
        bare = token.strip(".,;:!?\"'()[]{}<>")
        if bare and ("@" in bare or len(_digits(bare)) >= LEAST_DIGITS):
            start = a + token.index(bare)
            out.append((-1, _name(bare), contexts(start), start, start + len(bare)))
        group = token.lstrip("\"'[{<").rstrip(_ENDS)
        if not _GROUP.issuperset(group) or not 0 < len(_digits(group)) < LEAST_DIGITS:
            close()
            continue
        if run and not token.startswith(_OPENS):
            close()
        start = b - len(token.lstrip("\"'[{<"))
        run.append((start, start + len(group)))
    close()
    return out


_MENTION = "struct<kind: int, string: string, contexts: array<string>, start: int, end: int>"
_MENTION_TYPE = pa.struct([("kind", pa.int32()), ("string", pa.string()), ("contexts", pa.list_(pa.string())),
                           ("start", pa.int32()), ("end", pa.int32())])
_SCAN_SCHEMA = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), *((f"n_{kind}", pa.int64()) for kind in KINDS),
                          ("base", pa.string()), ("mentions", pa.list_(_MENTION_TYPE))])
SCAN = ("doc_id long, mark long, " + ", ".join(f"n_{kind} long" for kind in KINDS)
        + f", base string, mentions array<{_MENTION}>")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, n_..., base, mentions) of every row; `mark` is a hash of the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, base, found = [[] for _ in KINDS], [], []
            for value in batch.column("text"):
                text = value.as_py()
                spans = base_spans(text)
                for column, own in zip(counts, spans, strict=True):
                    column.append(len(own))
                base.append(listed([(kind, a, b) for kind, own in enumerate(spans) for a, b in own]))
                found.append([dict(zip(("kind", "string", "contexts", "start", "end"), row, strict=True))
                              for row in mentions(text, spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("mark"), *[pa.array(column, pa.int64()) for column in counts],
                 pa.array(base, pa.string()), pa.array(found, pa.list_(_MENTION_TYPE))], schema=_SCAN_SCHEMA)

    return ids_and_texts(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(read, SCAN)


def patterns(scanned: DataFrame, rounds: int | None = None, least_seeds: int = LEAST_SEEDS,
             least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """(context, kind, confidence) of high-confidence contexts, from the graph of contexts and strings; `rounds` at most."""
    each = scanned.select(F.explode("mentions").alias("m")).select("m.kind", "m.string", F.explode("m.contexts").alias("context"))
    edges = cut_lineage(each.groupBy("context", "string", "kind").agg(F.lit(1).alias("one")).drop("one"), "pii-graph")
    seeds = edges.filter("kind >= 0").groupBy("context", "kind").agg(F.count(F.lit(1)).cast("double").alias("seeds"))
    degree = edges.groupBy("context").agg(F.count(F.lit(1)).alias("degree"))
    unknown = edges.filter("kind < 0").select("context", "string")
    votes, before, done = seeds.withColumn("more", F.lit(0.0)), None, 0
    while True:
        # Any context may qualify: by its seeds, by the strings that others vouch for, or by both.
        support = F.coalesce("seeds", F.lit(0.0)) + F.coalesce("more", F.lit(0.0))
        alone = F.when(F.col("seeds") >= least_seeds, F.col("seeds") / (F.col("degree") + 1))
        confident = votes.withColumn("support", support).filter(F.col("support") >= least_seeds).join(degree, "context").select(
            "context", "kind", (F.col("support") / (F.col("degree") + 1)).alias("confidence"),
            F.when(alone >= 0.5, alone).otherwise(0.0).alias("alone"))
        confident = cut_lineage(confident, "pii-patterns")
        done += 1
        gained = confident.filter("confidence >= 0.5")
        if before is not None:
            gained = gained.join(before, ["context", "kind"], "left").filter(
                F.col("confidence") > F.coalesce("old", F.lit(0.0)) + GAIN)
        if done == rounds or not gained.limit(1).count():
            return confident.filter(F.col("confidence") >= least_confidence).select("context", "kind", "confidence")
        before = confident.select("context", "kind", F.col("confidence").alias("old"))
        votes = seeds.join(_votes(unknown, confident), ["context", "kind"], "full")


def _votes(unknown: DataFrame, confident: DataFrame) -> DataFrame:
    """(context, kind, more): scores of a context's unknown strings, each the noisy-or over the string's contexts."""
    miss = lambda name: F.log1p(-F.least(F.col(name), F.lit(0.999999)))
    last = F.substring_index("context", " ", -1)
    given = unknown.join(confident.filter("confidence >= 0.5"), "context").select(
        "string", "kind", "context", last.alias("last"), miss("confidence").alias("now"),
        (miss("alone") - miss("confidence")).alias("back"))
    total = given.groupBy("string", "kind").agg(F.sum("now").alias("total"))
    # Contexts of one and two words that end alike are the same place: what they gained is taken back for each other.
    own = given.select("string", "kind", F.explode(F.array_distinct(F.array("context", "last"))).alias("context"), "back")
    own = own.groupBy("string", "kind", "context").agg(F.sum("back").alias("back"))
    shorter = given.filter("context = last").select("string", "kind", "last", F.col("back").alias("back_last"))
    asked = unknown.withColumn("last", last).join(total, "string").join(own, ["string", "kind", "context"], "left").join(
        shorter, ["string", "kind", "last"], "left")
    left = F.col("total") + F.coalesce("back", F.lit(0.0)) + F.when(
        F.col("context") != F.col("last"), F.coalesce("back_last", F.lit(0.0))).otherwise(0.0)
    return asked.groupBy("context", "kind").agg(F.sum(1 - F.exp(F.least(left, F.lit(0.0)))).alias("more"))


def discovered(scanned: DataFrame, confident: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, mark, more): further spans of each text, as structs (kind, start, end); texts without any are left out."""
    places = scanned.select("doc_id", "mark", F.explode("mentions").alias("m")).filter("m.kind < 0").select(
        "doc_id", "mark", "m.start", "m.end", F.explode("m.contexts").alias("context"))
    miss = F.log1p(-F.least(F.col("confidence"), F.lit(0.999999)))
    scored = places.join(confident, "context").groupBy("doc_id", "mark", "start", "end", "kind").agg(
        (1 - F.exp(F.sum(miss))).alias("score")).filter(F.col("score") >= least_score)
    best = scored.groupBy("doc_id", "mark", "start", "end").agg(
        F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    return best.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_set(F.struct("kind", "start", "end"))).alias("more"))


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    scanned = cut_lineage(scan(docs), "pii-scan")
    more = discovered(scanned, patterns(scanned)).withColumnRenamed("doc_id", "id").withColumnRenamed("mark", "text_mark")
    rows = scanned.join(more, scanned["doc_id"].eqNullSafe(more["id"]) & (scanned["mark"] == more["text_mark"]), "left")
    base = F.transform(F.filter(F.split("base", ","), lambda item: item != ""), lambda item: F.struct(
        (F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(item, F.lit(":"), F.lit(1))).cast("int") - 1).alias("kind"),
        F.split_part(item, F.lit(":"), F.lit(2)).cast("int").alias("start"),
        F.split_part(item, F.lit(":"), F.lit(3)).cast("int").alias("end")))
    every = F.array_sort(F.concat(base, F.col("more")))
    text = F.array_join(F.transform(every, lambda span: F.concat_ws(
        ":", F.element_at(F.array(*map(F.lit, KINDS)), span["kind"] + 1), span["start"], span["end"])), ",")
    return rows.select("doc_id", *[f"n_{kind}" for kind in KINDS],
                       F.sha2(F.encode("base", "utf-8"), 256).alias("base_sha256"),
                       F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"))


def _replaced(text: str, spans: list[tuple[int, int, int]]) -> str:
    """Each union of overlapping spans replaced by the name of its first kind."""
    out, at, k = [], 0, 0
    spans = sorted((a, b, kind) for kind, a, b in spans)
    while k < len(spans):
        a, b, kind = spans[k]
        k += 1
        while k < len(spans) and spans[k][0] < b:
            b, kind, k = max(b, spans[k][1]), min(kind, spans[k][2]), k + 1
        out += [text[at:a], f"<{KINDS[kind]}>"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """`docs` with every span of its text replaced by `<kind>`; other columns and texts without spans stay as they are."""
    columns = docs.columns
    scanned = cut_lineage(scan(docs), "pii-scan")
    more = discovered(scanned, patterns(scanned)).select(
        F.col("doc_id").alias("id"), F.col("mark").alias("text_mark"), "more")
    rows = docs.select(F.struct(*[docs[name] for name in columns]).alias("row"))
    same = F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("text_mark"))

    @F.pandas_udf("string")
    def clean(texts, extra):
        out = []
        for text, more_spans in zip(texts, extra, strict=True):
            if text:
                spans = [(kind, a, b) for kind, own in enumerate(base_spans(text)) for a, b in own]
                spans += [] if more_spans is None else [(m["kind"], m["start"], m["end"]) for m in more_spans]
                text = _replaced(text, spans) if spans else text
            out.append(text)
        return texts.__class__(out, dtype=object)

    joined = rows.join(more, same, "left").withColumn("clean", clean(F.col("row.text"), F.col("more")))
    return joined.select(*[F.col("clean").alias(name) if name == "text" else F.col("row")[name].alias(name) for name in columns])


