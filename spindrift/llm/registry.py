"""The registered queries of the corpus operators, and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import alignment, brown_lm, byte_bpe, filter_audit, imatch, language, line_dedup, ngram_join, packing, pii, quality, topk, toxicity
from spindrift.llm.common import fold_of, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_good")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    digests = F.sha2(pii.joined(F.col("spans"), True), 256).alias("base_sha256"), pii.joined(F.col("spans"), False).alias("spans")
    scores = F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores")
    return found.select("doc_id", *map(count, pii.BASE_KINDS), *digests, scores)


def op4_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold_of("doc_id", 7) == 2
    model = brown_lm.fit(docs.filter(~held_out))
    return brown_lm.score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.fit(table(spark, sf_dir, "documents"))
    return language.pages(table(spark, sf_dir, "pages"), model)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels, held_out = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of("doc_id", 5) == 0
    machine = toxicity.fit(docs, labels.filter(~held_out))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents"), WORD_BPE))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.encode(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, with_decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return coded.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"), k=10)


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)


OP1_SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s),
links as (select a.doc_id as a, b.doc_id as b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 10 * a.n >= 9 * b.n and 10 * b.n >= 9 * a.n
          group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))),
both_ways as (select a, b from links union all select b, a from links),
reach as (select a as doc_id, b as other from both_ways union select r.doc_id, l.b from reach r join both_ways l on l.a = r.other)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(min(r.other), s.doc_id)) as component_id
from s left join reach r on r.doc_id = s.doc_id group by s.doc_id, len(s.s)
"""

OP10_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select vec_id as query_id, unnest(v) as x, generate_subscripts(v, 1) as i from v where vec_id % 100 = 0),
c as (select vec_id, unnest(v) as x, generate_subscripts(v, 1) as i from v),
s as (select query_id, vec_id, cast(sum(q.x * c.x) as bigint) as score from q join c on q.i = c.i and c.vec_id is distinct from q.query_id group by all),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select * from r where rank <= 10
"""


OP11_SQL = r"""
with docs as (select coalesce(doc_id, -9223372036854775807 - 1) as k0, doc_id, coalesce(text, '') as text from documents),
ordered as (select *, row_number() over (order by k0, md5(text)) as r, count(*) over () as total from docs),
pairs as (select a.k0, a.r, a.doc_id, a.text, length(a.text) as n_chars, b.r as next_r,
          substr(a.text, 1, length(a.text) - length(a.text) // 2) || substr(b.text, 1, length(a.text) // 2) as edited from ordered a join ordered b on b.r = a.r % a.total + 1),
texts as (select r, 0 as edited, text from pairs union all select r, 1, edited from pairs),
found as (select r, edited, list_transform(list_distinct(list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')),
          lambda w: cast('0x' || substr(md5(w), 1, 15) as bigint)) as terms from texts),
each_term as (select r, edited, unnest(terms) as term from found),
lexicon as (select term from each_term where edited = 0 group by term having count(*) * 2000 >= (select count(*) from docs) and count(*) * 4 <= (select count(*) from docs)),
in_band as (select r, edited, list(term) as terms from each_term semi join lexicon using (term) group by all),
kept as (select f.r, f.edited, list_sort(coalesce(b.terms, f.terms)) as k from found f left join in_band b on b.r = f.r and b.edited = f.edited),
subsets as (select r, edited, [k] || flatten(list_transform(range(64), lambda g: [list_filter(k, lambda t: t >> 54 = g), list_filter(k, lambda t: t >> 54 = g and (t >> 52) & 3 = 0), list_filter(k, lambda t: t >> 54 = g and (t >> 50) & 15 = 0)])) as s from kept),
marks as (select r, edited, list_transform(s, lambda x: case when len(x) = 0 then '' else substr(md5(array_to_string(x, ',')), 1, 8) end) as m from subsets),
three as (select p.doc_id, p.n_chars, p.edited, own.m as a, cut.m as b, nxt.m as c from pairs p join marks own on own.r = p.r and own.edited = 0 join marks cut on cut.r = p.r and cut.edited = 1 join marks nxt on nxt.r = p.next_r and nxt.edited = 0),
sums as (select *, len(list_filter(range(1, 194), lambda i: a[i] <> '' or b[i] <> '')) as ab, len(list_filter(range(1, 194), lambda i: a[i] <> '' and a[i] = b[i])) as ab_same,
         len(list_filter(range(1, 194), lambda i: a[i] <> '' or c[i] <> '')) as ac, len(list_filter(range(1, 194), lambda i: a[i] <> '' and a[i] = c[i])) as ac_same from three)
select doc_id, cast(n_chars as bigint) as n_chars, sha256(edited) as edited_sha256, array_to_string(a, ',') as fingerprint, array_to_string(b, ',') as edited_fingerprint,
       case when ab = 0 then 1.0::double else ab_same::double / ab end as near_edited, case when ac = 0 then 1.0::double else ac_same::double / ac end as near_next from sums
"""


OP12_SQL = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
f as (select doc_id, part, cast(len(w) < 100 as int) + 2 * cast(100 * len(list_distinct(w)) < 80 * len(w) as int) + 4 * cast(100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) as int)
      + 8 * cast(regexp_matches(t, '[#$%&*|]') as int) + 16 * cast(coalesce(min(doc_id) over (partition by t) < doc_id, false) as int) as mask from w),
l as (select doc_id, max(cast(quality = 1 as int)) as good, max(cast(toxic = 1 as int)) as toxic from labels group by doc_id),
m as (select part, mask, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic from f left join l using (doc_id) group by all),
x as (select unnest([0, 1, 2, 3, 4]) as f),
p as (select [a.f, b.f, c.f, d.f, e.f] as o from x a, x b, x c, x d, x e where len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s as (select o, list_reduce(list_transform(o, lambda i: substr('ABCDE', i + 1, 1)), lambda a, b: a || b) as filter_order, unnest([1, 2, 3, 4, 5]) as step from p),
b as (select *, 1 << o[step] as bit, list_sum(list_transform(o[1:step - 1], lambda i: 1 << i)) as b from s),
before as (select filter_order, step, bit, cast(coalesce(b, 0) as bigint) as b from b),
r as (select part, filter_order, step, bit, cast(sum(case when mask & (b | bit) = 0 then n else 0 end) as bigint) as kept, cast(sum(case when mask & b = 0 and mask & bit <> 0 then n else 0 end) as bigint) as removed,
      cast(sum(case when mask & b <> 0 and mask & bit <> 0 then n else 0 end) as bigint) as redundant, cast(sum(case when mask = bit then n else 0 end) as bigint) as unique_fails,
      cast(sum(case when mask & b = 0 and mask & bit <> 0 then good else 0 end) as bigint) as good_lost, cast(sum(case when mask & b = 0 and mask & bit <> 0 then toxic else 0 end) as bigint) as toxic_lost from m, before group by all)
select part, filter_order, cast(step as int) as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, bit) as bigint) as shapley from r
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_quality_rules, op3_pii, op4_brown_lm, op5_language_id, op6_toxicity, op7_best_fit_packing, op8_byte_bpe, op9_line_dedup, op10_topk, op11_imatch, op12_filter_audit, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": OP1_SQL, "op10_topk": OP10_SQL, "op11_imatch": OP11_SQL, "op12_filter_audit": OP12_SQL}
