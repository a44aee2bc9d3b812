"""The registered queries of this package: each operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlab.llm import (bpe, embedding_dedup, minhash, mixing, packing, pii, quality, ranked, substring, token_files, topk, toxicity,
                           vector_codes)
from ledgerlab.llm.tables import read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(read(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.linked(read(spark, sf_dir, "embeddings"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_folder(spark)
    token_files.write_tokens(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_files.checked(spark, folder)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.without_repeats(read(spark, sf_dir, "documents")))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(read(spark, sf_dir, "documents"))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(read(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(read(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.places(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_toxicity": op2_toxicity,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_bpe": op4_bpe,
    "op5_token_files": op5_token_files,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_minhash": op7_minhash,
    "op8_topk": op8_topk,
    "op9_pii": op9_pii,
    "op10_quality": op10_quality,
    "op11_vector_codes": op11_vector_codes,
    "op12_ranked_search": op12_ranked_search,
    "op13_best_fit": op13_best_fit,
}

# Terms of the ranked search: other characters than the first 128 that are neither letters nor digits, A-Z made small.
TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
         r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")


def _code_rounds(rounds: int = 4) -> str:
    """The rounds of `op11_vector_codes`, each a pair of tables."""
    nearest = """
near{n} as (
  select vec_id, part, p, min(struct_pack(d := d, entry := entry)) as best
  from (select a.vec_id, a.part, a.p, b.entry, list_sum(list_transform(list_zip(a.p, b.p), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d
        from parts a join book{n} b using (part))
  group by vec_id, part, p),"""
    update = """
sums{n} as (
  select part, entry, place, sum(p[place]) as total, count(*) as many
  from (select part, best.entry as entry, p, unnest(range(1, len(p) + 1)) as place from near{n}) group by part, entry, place),
moved{n} as (
  select part, entry, list(floor(total / many)::bigint order by place) as p from sums{n} group by part, entry),
book{m} as (select part, entry, coalesce(m.p, b.p) as p from book{n} b left join moved{n} m using (part, entry)),"""
    return "".join(nearest.format(n=n) + update.format(n=n, m=n + 1) for n in range(rounds)) + nearest.format(n=rounds)


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SQL = {
    "op1_mixing": rf"""
with sized as (
  select doc_id, source, len({WORDS})::bigint as size, md5(coalesce(doc_id::varchar, '')) as place from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select source, source_size, ([3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from sources),
levels as (
  select *, source_size * 2 as cap, (source_size * 2)::double / weight as level,
         sum(source_size) over ()::double * 1.5 as budget from ranked),
filled as (
  select *, sum(cap) over (order by level) + level * (sum(weight) over () - sum(weight) over (order by level)) <= budget
         as is_full from levels),
shares as (
  select source, source_size, case when is_full then cap::double else
      weight * (budget - (sum(case when is_full then cap else 0 end) over ())::double)
      / (sum(case when is_full then 0 else weight end) over ())::double end as target from filled),
queued as (
  select s.*, source_size, target, coalesce(sum(size) over (partition by s.source order by place, s.doc_id, size
      rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from sized s join shares h on s.source is not distinct from h.source)
select doc_id, size, source_size, target,
       (greatest(0, least(floor(target)::bigint - before, size))
        + greatest(0, least(floor(target)::bigint - source_size - before, size)))::bigint as taken
from queued""",
    "op6_substring_dedup": rf"""
with texts as (select doc_id, {WORDS} as words from documents),
places as (select doc_id, words, unnest(range(1, len(words) - 11)) as pos from texts where len(words) >= 13),
windows as (select doc_id, pos, array_to_string(words[pos:pos + 12], ' ') as passage from places),
firsts as (select passage, min(doc_id) as first_id from windows group by passage),
repeated as (select doc_id, pos from windows join firsts using (passage) where doc_id > first_id),
gone as (select distinct doc_id, pos + step as place from repeated, (select unnest(range(0, 13)) as step)),
each_word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as place from texts),
kept as (
  select w.doc_id, count(g.place) as n_removed,
         coalesce(string_agg(case when g.place is null then word end, ' ' order by w.place), '') as kept
  from each_word w left join gone g on w.doc_id = g.doc_id and w.place = g.place group by w.doc_id)
select t.doc_id, len(words)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from texts t left join kept k using (doc_id)""",
    "op8_topk": """
with usable as (
  select vec_id, embedding::double[] as x from embeddings
  where embedding is not null and len(embedding) > 0 and vec_id is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
whole as (select vec_id, list_transform(x, lambda c: floor(64 * c)::bigint) as v from usable),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v::double[], c.v::double[])::bigint as score
  from whole q join whole c on q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
ranked as (
  select *, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20""",
    "op11_vector_codes": f"""
with kept as (
  select vec_id, label, list_transform(embedding::double[], lambda c: floor(1024 * c)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding::double[], lambda c: c is null or not isfinite(c))) = 0),
parts as materialized (
  select vec_id, label, part, v[len(v) // 4 * part + 1:len(v) // 4 * (part + 1)] as p from kept, (select unnest(range(0, 4)) as part)),
book0 as (
  select part, (row_number() over (partition by part order by vec_id) - 1)::int as entry, p from parts
  where vec_id in (select vec_id from kept order by vec_id limit 256)),{_code_rounds()}
codes as (
  select vec_id, lower(string_agg(printf('%02x', best.entry), '' order by part)) as code, sum(best.d)::bigint as error
  from near4 group by vec_id),
digest as (
  select sha256(string_agg(c::varchar, ',' order by part, entry, place)) as codebooks_sha256
  from (select part, entry, unnest(p) as c, unnest(range(1, len(p) + 1)) as place from book4))
select c.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from codes c join kept using (vec_id), digest""",
    "op12_ranked_search": rf"""
with words as (
  select doc_id, unnest(t) as term, len(t) as n from (select doc_id, {TERMS} as t from documents)),
docs as (select doc_id, any_value(n)::bigint as n from words group by doc_id),
totals as (select count(*)::bigint as cnt, sum(n)::bigint as lng from docs),
asked as (select distinct item_id, unnest({TERMS}) as term from benchmark),
held as (select doc_id, term, count(*)::bigint as tf from words where term in (select term from asked) group by doc_id, term),
weights as (
  select term, floor(1000 * ln((2 * cnt + 2)::double / (2 * df + 1)::double))::bigint as w
  from (select term, count(*)::bigint as df from held group by term), totals),
scored as (
  select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * cnt) // lng)))))::bigint as score
  from asked join weights using (term) join held using (term) join docs using (doc_id), totals group by item_id, doc_id),
best as (
  select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score
  from scored where score > 0)
select item_id, rank, doc_id, score from best where rank <= 10""",
}
