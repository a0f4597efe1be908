"""Learned operators against plain sums, normalisation and held-out rows; the pipeline against plain versions of its stages."""

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import brown_lm, language, line_dedup, packing, pii, toxicity
from spindrift.llm.common import fold_of

from .helpers import AWKWARD, docs, sample, wide
from .test_exact import WORD_BPE, check_packing, distance, filled, plain_links

SMALL = "/root/testdata/sf0.001"


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


def plain_score(text, model, counts):
    """log10 probability under the class model, from the classes, a plain count of words and the pairs of classes."""
    items = brown_lm.Items(model.frequent, model.endings)
    total, before = 0.0, 0
    for w in (x.encode() for x in tokens(text)):
        k = int(model.of[items[w]])
        total += model.transitions[before, k] + math.log10((counts[w] + 1) / (model.class_tokens[k] + model.class_words[k] + 1))
        before = k
    return total


@pytest.mark.parametrize("per", [1, 200, 1_000_000])
def test_lm_scores_equal_plain_sums(spark, per):
    rows = [*AWKWARD, *[(r.doc_id + 100, r.text) for r in sample(spark, 60).collect()]]
    train = [(d, t) for d, t in rows if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2]
    df = docs(spark, rows)
    model = brown_lm.fit(df.filter(fold_of("doc_id", 7) != 2), classes=8, per=per, seeds=40, endings=20)
    counts = Counter(w.encode() for _, t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    assert (model.train_tokens, model.vocabulary) == (n, v)
    assert set(model.frequent) == {w for w, c in counts.items() if c >= max(2, n / per) and w}
    # Classes, their sizes and their transitions, counted from the texts.
    items = brown_lm.Items(model.frequent, model.endings)
    of = lambda w: int(model.of[items[w]])
    sizes, kinds, pairs = Counter(), Counter(of(w) for w in counts), np.zeros((8, 8))
    for _, t in train:
        line = [0, *(of(w.encode()) for w in tokens(t))]
        sizes.update(line[1:])
        for a, b in zip(line, line[1:]):
            pairs[a, b] += 1
    assert [sizes[k] for k in range(8)] == model.class_tokens.tolist() and [kinds[k] for k in range(8)] == model.class_words.tolist()
    share = (pairs.sum(axis=0) + 1) / (pairs.sum() + 8)
    assert model.transitions == pytest.approx(np.log10((pairs + 50 * share) / (pairs.sum(axis=1, keepdims=True) + 50)))
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score) for r in brown_lm.score(df, model).collect()), key=lambda r: repr(r[:3]))
    wanted = []
    for d, t in rows:
        seen = [counts[w.encode()] for w in tokens(t)]
        wanted.append((d, len(seen), sum(c > 0 for c in seen), sum(math.log10((c + 1) / (n + v + 1)) for c in seen), plain_score(t, model, counts)))
    wanted.sort(key=lambda r: repr(r[:3]))
    assert [g[:3] for g in got] == [w[:3] for w in wanted]
    for at in (3, 4):
        assert sorted(g[at] for g in got) == pytest.approx(sorted(w[at] for w in wanted), rel=1e-9)


def test_lm_of_all_frequent_words_beats_that_of_few_and_single_words(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = fold_of("doc_id", 7) == 2
    fitted = {name: brown_lm.fit(df.filter(~held), classes=24, seeds=300, endings=100, **more) for name, more in (("few", {"per": 2000, "rounds": 0}), ("still", {"rounds": 0}), ("all", {}))}
    model = fitted["all"]
    assert (10**model.transitions).sum(axis=1) == pytest.approx(np.ones(24), abs=1e-9)
    # Each class's words take (c + 1) / (tokens + words + 1) each; what is left, 1 / (...), is the unknown words'.
    assert model.class_tokens.sum() == model.train_tokens and model.class_words.sum() == model.vocabulary
    scored = {name: brown_lm.score(df.filter(held), m) for name, m in fitted.items()}
    found = {name: brown_lm.perplexity(x) for name, x in scored.items()}
    assert found["all"] < found["still"] and found["all"] < found["few"]
    total = scored["all"].agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]
    empty = brown_lm.fit(df.limit(0), classes=4, seeds=10, endings=5)
    assert brown_lm.score(df.limit(3), empty).count() == 3 and brown_lm.score(df.limit(0), model).count() == 0
    assert brown_lm.score(wide(spark), model).count() == len(AWKWARD) and brown_lm.perplexity(scored["all"].limit(0)) is None


def test_gains_are_those_of_moving_a_small_item():
    rng = np.random.default_rng(3)
    table = rng.integers(50_000, 90_000, (5, 5)).astype(float)
    item = rng.integers(0, 4, 10).astype(float)
    exact = []
    for k in range(5):
        with_item = table.copy()
        with_item[k] += item[:5]
        with_item[:, k] += item[5:]
        exact.append(brown_lm.information(with_item) - brown_lm.information(table))
    gain = brown_lm.gains(item[None], table)[0]
    # Up to what is the same in every class.
    assert gain - gain.mean() == pytest.approx(np.array(exact) - np.mean(exact), abs=2e-3)


def test_exchange_separates_two_vocabularies():
    rng = np.random.default_rng(1)
    counts = np.zeros((21, 21))
    for lo in (1, 11):
        counts[lo : lo + 10, lo : lo + 10] = rng.integers(20, 40, (10, 10))
    counts[0, 1:] = counts[1:, 0] = 2
    of = brown_lm.exchange(counts, 3)
    assert len(set(of[1:11])) == 1 and len(set(of[11:])) == 1 and of[1] != of[11]


PAGES = [
    (1, "https://a.example.de/x", '<html lang="de-DE"><body>der die das und nicht</body>'),
    (2, "https://a.example.de/fr/x", None),
    (3, None, "<html><script>var a='the the the'</script>le la les des une est"),
    (4, "not a url", ""),
    (5, "http://u:p@b.example.com:80/en", '<HTML data-x=1 LANG=en>the of and to'),
    (5, "http://u:p@b.example.com:80/en", '<HTML data-x=1 LANG=en>the of and to'),
    (None, "https://c.example.at", "<p>" + "und der die das nicht " * 3000),
    (6, "https://www.shop.co.uk/my/x", "<p>caf&eacute; &amp; th&#233;"),
    (7, "https://pub.shop.co.uk/us/", "<script " * 5),
]


def test_tags_are_taken_out_in_one_pass():
    tags = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
    rng = random.Random(1)
    parts = ["<", ">", "<script", "</script>", "<STYLE", "</style >", "<!--", "-->", "a", " ", "<b>", "</b", "scripty", "é"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randrange(12)))
        assert language.plain(text) == tags.sub(" ", text)
    assert language.plain("caf&eacute; &lt;b&gt; <b>&#228;</b>") == "café <b>  ä "
    began = time.time()
    for piece in ("<script ", "<!--", "<style", "<", "</script ", "<script></style>"):
        assert len(language.plain(piece * 50_000)) >= 0
    assert time.time() - began < 5


def test_language_evidence_is_fused_as_in_plain_sums(spark):
    model = language.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), rows=300)
    table = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("row", F.lit("x"))
    host, domain, hinted = language.address(F.col("url"), model.languages)
    seen = [tuple(r) for r in table.select(host, domain, hinted, language.declared(F.col("html"))).collect()]
    assert seen[0] == ("a.example.de", "example.de", "de", "de") and seen[1][2] == "fr" and seen[4] == ("b.example.com", "example.com", "en", "en")
    assert [s[1:3] for s in seen[-2:]] == [("shop.co.uk", "en")] * 2
    got = {(r.page_id, r.host): r for r in language.pages(table, model).collect()}
    clashing = language.identify(table.select("page_id", "html", F.lit("h").alias("host"), *[F.lit(c).alias(c) for c in ("domain", "declared", "hinted", "language", "posterior", "accepted", "own", "evidence")]), model, "html")
    assert clashing.columns == ["page_id", "own", "evidence", "host", "domain", "declared", "hinted", "language", "posterior", "text_language", "accepted"] and clashing.count() == len(PAGES)
    assert language.pages(table, model).count() == len(PAGES)
    names, n = model.languages, len(model.languages)
    rows = []
    for (page, _, html), (h, d, hint, said) in zip(PAGES, seen):
        t = language.trigrams(language.plain(html or ""))
        ll = model.log_p.astype(np.float32)[:, t].sum(axis=1, dtype=float) * min(0.1, 200 / max(1, len(t)))
        e = np.maximum(ll - ll.max(), -60)
        for c, right in ((said, 0.9), (hint, 0.8)):
            if c in names:
                e = e + np.where(np.array(names) == c, math.log(right), math.log((1 - right) / (n - 1)))
        rows.append((page, h or "", d or "", e))
    weight = [np.exp(e - e.max()) / np.exp(e - e.max()).sum() for *_, e in rows]
    overall = sum(weight) + 1
    overall = overall / overall.sum()
    for row, (page, h, d, e) in enumerate(rows):
        of = lambda k, x: [w for i, (w, r) in enumerate(zip(weight, rows)) if r[k] == x and i != row]
        share = (sum(of(2, d)) + 10 * overall) / (len(of(2, d)) + 10)
        prior = (sum(of(1, h)) + 10 * share) / (len(of(1, h)) + 10)
        final = e + np.log(prior)
        p = np.exp(final - final.max())
        assert got[page, h].language == names[int(final.argmax())]
        assert got[page, h].posterior == pytest.approx(float((p / p.sum()).max()), rel=1e-6)
    assert not got[4, ""].accepted and got[1, "a.example.de"].language == "de" and got[None, "c.example.at"].accepted
    assert language.pages(table.limit(0), model).count() == 0
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.pages(table, none).filter("accepted or language is not null").count() == 0


def right(m, x, y):
    place = {int(t): i for i, t in enumerate(m.terms)}
    z = np.array([m.logit(np.array([place[t] for t in r.tolist() if t in place], int)) for r in x])
    return ((z > 0) == (y > 0)).mean()


def test_machine_learns_pairs_that_single_terms_miss():
    rng = np.random.default_rng(2)
    x = [np.unique(np.concatenate([rng.choice([1, 2], rng.integers(0, 3)), 10 + rng.integers(0, 30, 3)])) for _ in range(3000)]
    y = np.array([float({1, 2} <= set(r.tolist())) for r in x])
    assert right(toxicity.train(x[:2000], y[:2000], epochs=15), x[2000:], y[2000:]) > 0.98
    # Each term alone says nothing here: the label is whether both or neither of two are there.
    x = [np.unique(np.concatenate([rng.permutation([1, 2])[: rng.integers(0, 3)], 10 + rng.integers(0, 60, 8)])) for _ in range(4000)]
    y = np.array([float((1 in r) == (2 in r)) for r in x])
    assert right(toxicity.train(x[:3000], y[:3000], least_value=0.2), x[3000:], y[3000:]) > 0.98


def test_toxicity_scores_equal_plain_sums_over_all_pairs_of_terms(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    machine = toxicity.fit(df, labels, rows=200)
    assert len(machine.terms) == len(set(machine.terms.tolist())) > 5000
    place = {int(t): i for i, t in enumerate(machine.terms)}
    rows = [*AWKWARD, *[(r.doc_id, r.text) for r in df.limit(40).collect()]]
    got = sorted(((r.doc_id, r.score) for r in toxicity.score(docs(spark, rows), machine).collect()), key=repr)
    wanted = []
    for d, t in rows:
        strip = toxicity.STRIP.decode()
        known = sorted({place[h] for w in tokens(t)[:-1] if (h := zlib.crc32(w.encode().strip(strip.encode())) % toxicity.BUCKETS) in place})
        z = machine.bias + sum(machine.weights[i] for i in known)
        f = machine.factors[known]
        z += sum(float(f[i] @ f[j]) for i in range(len(known)) for j in range(i)) if len(known) < 400 else float((np.triu(f @ f.T, 1)).sum())
        wanted.append((d, 1 / (1 + math.exp(-max(-30, min(30, z))))))
    wanted.sort(key=repr)
    assert [d for d, _ in got] == [d for d, _ in wanted]
    assert sorted(x for _, x in got) == pytest.approx(sorted(x for _, x in wanted), abs=1e-9)
    strings = toxicity.fit(df.withColumn("doc_id", F.col("doc_id").cast("string")), labels.withColumn("doc_id", F.col("doc_id").cast("string")), rows=50)
    assert toxicity.score(docs(spark, rows), strings).count() == len(rows)


def test_toxicity_on_held_out_labels(spark):
    df, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = fold_of("doc_id", 5) == 0
    machine = toxicity.fit(df, labels.filter(~held))
    got = toxicity.score(df, machine).join(labels.filter(held), "doc_id").toPandas()
    assert 0 <= got.score.min() and got.score.max() <= 1
    rank, bad = got.score.rank(), got.toxic == 1
    auc = (rank[bad].sum() - bad.sum() * (bad.sum() + 1) / 2) / (bad.sum() * (~bad).sum())
    assert auc > 0.97
    assert ((got.score >= 0.5) & ~bad).sum() <= 0.01 * (~bad).sum()
    assert toxicity.score(wide(spark), machine).count() == len(AWKWARD)
    assert toxicity.score(docs(spark, []), machine).count() == 0
    alone = toxicity.fit(df, labels.limit(0))
    assert toxicity.score(df.limit(5), alone).select("score").distinct().count() == 1


def plain_stages(rows):
    """(doc_id, text) after line dedup, near copies and redaction, by plain loops."""
    import xxhash

    def digest(s):
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        return h - (1 << 64) if h >= 1 << 63 else h

    rows = [(d, t) for d, t in rows if t and t.strip()]
    first, lines = {}, {}
    for d, t in sorted(rows, key=lambda r: (r[0], digest(r[1]))):
        for pos, x in enumerate(t.split("\n")):
            if filled(x):
                first.setdefault(x, (d, pos))
                if len(x) >= 24:
                    lines[x] = digest(x)
    by_size = {}
    for x in lines:
        by_size.setdefault(len(x), []).append(x)
    near = set()
    for x in lines:
        bag = Counter(x)
        for n in range(len(x) - 2, len(x) + 3):
            for y in by_size.get(n, []):
                if lines[y] < lines[x] and x not in near:
                    other = Counter(y)
                    if sum(((bag - other) | (other - bag)).values()) <= 4 and distance(x, y) <= 2:
                        near.add(x)
    left = []
    for d, t in rows:
        kept = [x for pos, x in enumerate(t.split("\n")) if not filled(x) or (x not in near and first[x] == (d, pos))]
        if "\n".join(kept).strip() or len(kept) == t.count("\n") + 1:
            left.append((d, "\n".join(kept)))
    component = {d: c for d, _, c in plain_links(left, 5, 80)}
    return [(d, pii.redact_text(t, [(s, e, k) for k, s, e, sure, _ in pii.spans_of(t) if sure >= 0.5])) for d, t in left if component[d] == d]


def test_pipeline_equals_plain_stages(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = corpus_pipeline.run(spark, SMALL).collect()
    wanted = {}
    for d, t in plain_stages([(r.doc_id, r.text) for r in table.collect()]):
        ids = packing.ids_of(t, WORD_BPE, True) + bytes(4)
        wanted.update({(d, n): (at // 4, min(2048, len(ids) // 4 - at // 4), zlib.crc32(ids[at : at + 8192])) for n, at in enumerate(range(0, len(ids), 8192))})
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == wanted
    check_packing(got)


def test_stages_keep_the_columns_and_take_awkward_rows(spark):
    table = spark.createDataFrame([(d, t, "en", "s", 3) for d, t in AWKWARD] + [(77, "the of and to in that is was for it with", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = table
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, rows, SMALL)
        if name != "best_fit_packing":
            assert out.columns == table.columns, name
            assert out.filter("text is not null and n_chars <> length(text)").count() == 0 or name == "language_id"
        rows = out
    assert rows.count() > 0
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), SMALL).count() == 0, name


def test_copies_with_a_short_line_leave_no_stub(spark):
    long, other = "a line that is long enough to take part", "another line that is long enough as well"
    rows = [(1, f"Les.\n{long}"), (2, f"Les.\n{long}"), (3, f"Les.\n\n{long}s"), (4, f"Own.\n{long}"), (5, f"Les.\n{other}"), (6, "Les."), (7, f"Own.\n{other}\n{other}"), (8, None), (9, " \n")]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs(spark, rows), SMALL).collect()}
    # Of the near lines of 1 and 3 one stays. 2, 6 and 7 keep no line; 8 and 9 lost none.
    kept = got.pop(3, None)
    assert kept in (None, f"\n{long}s") and got.pop(1) == (f"Les.\n{long}" if kept is None else "Les.")
    assert got == {4: "Own.", 5: other, 8: None, 9: " \n"}


def test_near_copies_with_spread_edits_go(spark):
    words = [f"w{random.Random(4).randrange(5000) * i % 5003}" for i in range(1, 1001)]
    copy = ["other" if i % 50 == 25 else w for i, w in enumerate(words)]
    far = ["other" if i % 25 == 12 else w for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(copy)), (3, " ".join(far))]
    # 2 is near 1 by five-word sets, not by three-word sets at 90 %; 3 is near neither.
    assert [c for _, _, c in plain_links(rows)] == [1, 2, 3] and [c for _, _, c in plain_links(rows, 5, 80)] == [1, 1, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs(spark, rows), SMALL).collect()) == [1, 3]


def test_a_random_order_changes_nothing(spark):
    rows = [(i, "\n".join(random.Random(i % 7).choices(["a line of some length here", "another line that is long", "short"], k=3))) for i in range(30)]
    one = {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert one == {r.doc_id: r.text for r in line_dedup.dedup(docs(spark, rows[::-1])).collect()}
