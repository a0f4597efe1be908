"""Operators with one right answer, against plain versions."""

import base64
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from spindrift.llm import byte_bpe, line_dedup, ngram_join, packing, pii, prefilter, quality, topk
from spindrift.llm.common import join_counted
from spindrift.llm.components import components

from .helpers import AWKWARD, docs, rows_of, sample, wide

RANKS = P.path("byte_bpe_50k.tiktoken")
WORD_BPE = P.path("word_bpe_49k.json")


def texts_of(df):
    return [(r.doc_id, r.text or "") for r in df.collect()]


def test_byte_bpe_equals_the_library_and_round_trips(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    long = [(100 + i, "".join(rng.choice("ab é1 \n.") for _ in range(5000))) for i in range(4)]
    df = docs(spark, [*AWKWARD, *long, long[0]])
    for chunk, overlap in ((32768, 2048), (300, 40), (50, 7)):
        got = byte_bpe.decode(byte_bpe.encode(df, RANKS, P.PATTERN, chunk, overlap), RANKS)
        found = Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in got.collect())
        at_once = byte_bpe.encode(df, RANKS, P.PATTERN, chunk, overlap, with_decoded=True)
        assert found == Counter((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in at_once.collect())
        wanted = Counter((i, np.asarray(plain.encode_ordinary(t), "<u4").tobytes(), t.encode()) for i, t in texts_of(df))
        assert found == wanted
    assert byte_bpe.encode(docs(spark, []), RANKS, P.PATTERN).count() == 0
    strings = df.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert rows_of(byte_bpe.encode(strings, RANKS, P.PATTERN, 300, 40), "ids") == rows_of(byte_bpe.encode(df, RANKS, P.PATTERN), "ids")
    assert byte_bpe.encode(wide(spark), RANKS, P.PATTERN).count() == len(AWKWARD)


def plain_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(reversed(d)))
        out += [("card", *m.span())] if 16 <= len(d) <= 19 and total % 10 == 0 else []
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_pii_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("0123456789  ..@@ab+-()\n_") for _ in range(rng.randrange(200))) for _ in range(3000)]
    texts += [" 4111 1111-1111 1111 a.b@c.d@e.f 1.2.3.4.5.6.7.8 +1 (555) 010-9999 256.1.1.1", "1" * 3000, "a" * 3000 + "@", "+1" * 500]
    texts += [r.text for r in sample(spark).collect() if r.text]
    for t in texts:
        assert [s[:3] for s in pii.spans_of(t) if s[4]] == plain_spans(t)


def test_pii_takes_awkward_rows(spark):
    got = pii.detect(wide(spark))
    assert got.count() == len(AWKWARD) and got.filter("size(spans) > 0").count() == 0 and got.columns == ["doc_id", "text", "spans"]
    assert pii.detect(docs(spark, [])).count() == 0
    assert pii.redact(wide(spark)).columns == wide(spark).columns
    text = "IBAN: GB82 WEST 1234 5698 7654 32 or bob@mail.example.com"
    kinds = [(s[0], s[3]) for s in pii.spans_of(text)]
    assert kinds == [("email", 0.8), ("iban", 0.9)]
    assert pii.spans_of("GB82 WEST 1234 5698 7654 33") == []
    assert pii.redact(docs(spark, [(1, text), (2, None)])).collect()[0].text == "IBAN: <IBAN> or <EMAIL>"


@pytest.mark.parametrize(
    "before, span, after, kind",
    [
        ("my card is ", "3782 822463 10005", " thanks", "short_card"),
        ("", "378282246310005", " is the amex to use", "short_card"),
        ("please call ", "(555) 010-9999", " at noon", "local_phone"),
        ("reach us at ", "555 010 9999", " (tel)", "local_phone"),
    ],
)
def test_pii_ambiguous_spans_pass_or_fail_by_their_context_alone(spark, before, span, after, kind):
    found = lambda text: [s[:3] for s in pii.spans_of(text) if s[3] >= 0.5]
    assert found(before + span + after) == [(kind, len(before), len(before) + len(span))]
    assert found("xx yy " + span + " zz") == [] and found(before + span + " invoice" + after) == []
    # Words count only as wholes and within reach.
    assert found("hotel recall " + span + " zz") == [] and found(before + "x" * 60 + " " + span + " " + "x" * 60 + after) == []
    rows = docs(spark, [(1, before + span + after), (2, "xx " + span)])
    assert [r.text for r in pii.redact(rows).orderBy("doc_id").collect()] == [f"{before}<{kind.upper()}>{after}", "xx " + span]
    assert [len(r.spans) for r in pii.detect(rows).orderBy("doc_id").collect()] == [1, 0]


def test_pii_words_against_a_span_lower_its_score(spark):
    for text, kind, kept in (("host 10.2.3.4", "ip", True), ("version 10.2.3.4", "ip", False), ("x GB82 WEST 1234 5698 7654 32", "iban", True), ("article GB82 WEST 1234 5698 7654 32", "iban", False)):
        [(found, *_, sure, base)] = pii.spans_of(text)
        assert found == kind and (sure >= 0.5) == kept
        # A base span is found whatever its score; what is redacted follows the score.
        [row] = pii.detect(docs(spark, [(1, text)])).collect()
        assert len(row.spans) == (kept or base)
        assert ("<" in pii.redact(docs(spark, [(1, text)])).collect()[0].text) == kept
    assert pii.spans_of("phone +49 30 1234567, 2024-01-01 or call 2024-01-01") == [("phone", 6, 20, 1.0, True)]
    assert [s[3] for s in pii.spans_of("invoice 4111 1111 1111 1111")] == [0.5]


@pytest.mark.parametrize(
    "iban, after",
    [
        ("DE89370400440532013000", " BIC COBADEFF"),
        ("GB82 WEST 1234 5698 7654 32", " 2024-01-01"),
        ("DE89 3704 0044 0532 0130 00", " EUR 5"),
        ("GB82WEST12345698765432", " I said"),
        ("DE89 3704 0044 0532 0130 00", " GB82 WEST 1234 5698 7654 33"),
    ],
)
def test_pii_finds_ibans_among_capitals_and_digits(spark, iban, after):
    for before in ("", "to ", "AB12 CDEF GHIJ KLMN "):
        assert pii.redact(docs(spark, [(1, before + iban + after)])).collect()[0].text == before + "<IBAN>" + after
    assert [s for s in pii.spans_of(iban + "X" + after) if s[0] == "iban"] == []


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_equal_the_plain_ones(spark):
    rng = random.Random(2)
    for t in [x or "" for _, x in AWKWARD] + [" ".join(rng.choice("abc") for _ in range(n)) for n in range(0, 400, 7)]:
        assert quality.counts_of(t)[:5] == plain_counts(t)


def test_quality_posteriors_equal_a_plain_em_over_documents_and_no_bad_vote_raises_them(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    names = [f"vote_{k}" for k in quality.rules()]
    rows = quality.judge(table).collect()
    votes = [tuple(r[n] for n in names) for r in rows if not r.base_failed]
    good = [0.1 if -1 in v else 0.95 for v in votes]
    for _ in range(60):
        share = min(max(sum(good) / len(votes), 0.01), 0.99)
        tables = []
        for r in range(len(names)):
            bad = {v: sum(1 - g for x, g in zip(votes, good) if x[r] == v) + {-1: 3, 0: 1, 1: 1}[v] for v in (-1, 0, 1)}
            fine = {v: sum(g for x, g in zip(votes, good) if x[r] == v) + {-1: 1, 0: 1, 1: 3}[v] for v in (-1, 0, 1)}
            fine[-1] = min(fine[-1], 0.01 * sum(fine.values()))
            p, q = ({v: x[v] / sum(x.values()) for v in x} for x in (bad, fine))
            # The least rising sequence of ratios: of all runs of votes through each, the largest of the least means.
            mean = lambda i, j: sum(q[v] for v in range(i, j + 1)) / sum(p[v] for v in range(i, j + 1))
            tables.append({v: max(min(mean(i, j) for j in range(v, 2)) for i in range(-1, v + 1)) for v in (-1, 0, 1)})
            assert tables[-1][-1] <= 1 + 1e-12 and tables[-1][1] >= 1 - 1e-12
        odds = [share / (1 - share) * math.prod(t[v] for t, v in zip(tables, x)) for x in votes]
        good = [o / (1 + o) for o in odds]
    assert [r.p_good for r in rows if not r.base_failed] == pytest.approx(good, abs=1e-9)
    for t in tables:
        assert t[-1] <= t[0] <= t[1]
    # Not all rules must pass: bad votes of the weak rules are outweighed, and equal votes have equal results.
    large = quality.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    outvoted = large.filter("kept and (vote_dup_lines < 0 or vote_repeats < 0)")
    assert outvoted.count() > 10 and large.filter("vote_symbols < 0 and kept").count() == 0
    clean = large.filter(" and ".join(f"{n} >= 0" for n in names)).agg(F.max("p_good")).first()[0]
    assert outvoted.agg(F.max("p_good")).first()[0] < clean
    assert large.groupBy("base_failed", *names).agg(F.countDistinct("p_good").alias("n")).filter("n > 1").count() == 0


def test_quality_of_ties_at_the_threshold_and_repeated_rows(spark):
    rows = [(1, "a word of the text " * 4), (1, "a word of the text " * 4), (2, "Good words here, and a line that ends well. " * 1 + " ".join(f"w{i}" for i in range(40)))]
    got = quality.judge(docs(spark, rows)).collect()
    assert len(got) == 3 and len({tuple(r) for r in got if r.doc_id == 1}) == 1
    [at] = {r.p_good for r in got if r.doc_id == 2}
    assert [r.kept for r in quality.judge(docs(spark, rows), threshold=at).collect() if r.doc_id == 2] == [True]


def test_quality_keeps_good_and_drops_junk(spark):
    got = quality.judge(wide(spark))
    assert got.count() == len(AWKWARD)
    assert got.filter("base_failed <> (n_words < 20 or 100 * n_repeat_words > 30 * n_words)").count() == 0
    assert got.filter("kept and base_failed").count() == 0
    assert quality.judge(docs(spark, [])).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    scored = quality.judge(table).join(labels, "doc_id")
    # What fails the base is never kept, whatever its label.
    assert scored.filter("kept and quality = 1").count() > 0.99 * scored.filter("quality = 1 and not base_failed").count()
    assert scored.filter("not kept and quality = 0").count() > 0.9 * scored.filter("quality = 0").count()


def plain_links(rows, n=3, percent=90):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return sorted(((d, len(s), least.get(root(i), d) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near_copies(seed=3):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(500)]
    rows = []
    for n in (3, 9, 10, 11, 12, 15, 20, 21, 40, 41, 100, 400):
        base = [rng.choice(words) for _ in range(n)]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy) + 1)
                copy[at : at + rng.randrange(2)] = [rng.choice(words)] * rng.randrange(1 + n // 60 + 1)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    return rows


@pytest.mark.parametrize("capacity", [1 << 20, 4096])
def test_jaccard_components_equal_all_pairs(spark, capacity):
    rows = [*near_copies(), *AWKWARD]
    got = ngram_join.link(docs(spark, rows), n=3, percent=90, capacity=capacity)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_links(rows)


def test_jaccard_of_five_words_at_four_fifths_equals_all_pairs(spark):
    rows = [*near_copies(), *AWKWARD]
    got = ngram_join.link(docs(spark, rows), n=5, percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_links(rows, 5, 80)


def test_join_keeps_rows_of_heavy_keys_in_place(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(i, i) for i in range(2, 50)] + [(None, 7)], "k long, x long")
    right = spark.createDataFrame([(1, 3000, "a"), *((i, 1, "b") for i in range(3, 60))], "k long, n_rows long, y string")
    for how, n in (("inner", 3000 + 47), ("left", 3000 + 48 + 1)):
        got = rows_of(join_counted(left, right, ["k"], how), "k", "x", "y")
        assert got == rows_of(left.join(right.drop("n_rows"), ["k"], how), "k", "x", "y") and len(got) == n


def test_bit_table_lets_all_keys_pass_and_grows(spark):
    keys = spark.range(0, 40_000, 4).select(F.col("id").alias("k0"))
    got = prefilter.maybe_in(spark.range(40_000).select(F.col("id").alias("k0")), keys).groupBy((F.col("k0") % 4 == 0).alias("is_key"), "maybe").count().collect()
    found = {(r.is_key, r.maybe): r["count"] for r in got}
    assert found[True, True] == 10_000 and (True, False) not in found and found[False, True] < 30_000 / 8
    sizes = [prefilter.table_size(n) for n in (0, 10, 10**5, 10**7, prefilter.MOST)]
    assert sizes == [1 << 16, 1 << 16, 1 << 21, prefilter.MOST, 0]
    everything = prefilter.MOST
    try:
        prefilter.MOST = 8
        assert prefilter.maybe_in(keys, keys).filter("maybe").count() == 10_000
    finally:
        prefilter.MOST = everything


def test_jaccard_needs_no_bit_table(spark, monkeypatch):
    monkeypatch.setattr(prefilter, "MOST", 8)
    rows = near_copies(seed=7)[::2]
    got = ngram_join.link(docs(spark, rows), n=5, percent=80)
    assert rows_of(got, "doc_id", "n_shingles", "component_id") == plain_links(rows, 5, 80)


def test_jaccard_takes_empty_tables_and_clashing_columns(spark):
    assert ngram_join.link(docs(spark, [])).count() == 0
    assert rows_of(ngram_join.link(wide(spark), 3, 90), "doc_id", "n_shingles", "component_id") == plain_links(AWKWARD)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_the_counted_hashes_they_need(percent):
    rng = np.random.default_rng(4)
    bands, linked = ngram_join.Bands(percent), 0
    for n in (1, 2, 4, 9, 10, 13, 19, 20, 28, 57, 200, 1000):
        for _ in range(200):
            new = lambda m: rng.integers(0, 2**63, m, dtype=np.uint64)
            a = np.unique(new(n))
            most = n * (100 - percent) // 100 + 1
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[rng.integers(0, most + 1) :]], new(rng.integers(0, most + 1))]))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                linked += 1
                shared = len(np.intersect1d(ngram_join.counted(a, percent), ngram_join.counted(b, percent)))
                assert shared >= max(ngram_join.least_shared(len(x), percent) for x in (a, b))
                assert set(bands.of(len(a))) & set(bands.of(len(b)))
    assert linked > 500


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 5000)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.node: r.label for r in got.collect()} == {x: root(x) for x in list(parent)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def plain_dedup(rows, max_edits, min_chars):
    import xxhash

    def digest(s):
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        return h - (1 << 64) if h >= 1 << 63 else h

    order = sorted({(-(2**63) if d is None else d, digest(t), t) for d, t in rows if t is not None})
    first, lines = {}, set()
    for d, h, t in order:
        for pos, x in enumerate(t.split("\n")):
            if filled(x):
                first.setdefault(x, (d, h, pos))
                lines.add(x)
    lines = {x for x in lines if len(x) >= min_chars}
    stay, near = [], set()
    for x in sorted(lines, key=digest):
        if any(abs(len(x) - len(y)) <= max_edits and distance(x, y) <= max_edits for y in stay):
            near.add(x)
        else:
            stay.append(x)
    out = []
    for d, t in rows:
        kept = None if t is None else [x for pos, x in enumerate(t.split("\n")) if not filled(x) or (x not in near and first[x] == (-(2**63) if d is None else d, digest(t), pos))]
        out.append((d, t if t is None else "\n".join(kept), 0 if t is None else t.count("\n") + 1))
    return sorted(out, key=repr)


def filled(line):
    return line.strip(" \t\n\x0b\x0c\r") != ""


def line_rows():
    rng = random.Random(8)
    bases = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (24, 25, 26, 30, 31, 47, 90)]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(rng.randrange(6)):
            x = list(rng.choice(bases))
            for _ in range(rng.randrange(5)):
                at = rng.randrange(len(x))
                x[at : at + rng.randrange(2)] = rng.choice(["", "e", "f"])
            lines.append("".join(x))
        lines += rng.choices(["Les.", "Des.", " ", "", "\t", "a short line"], k=rng.randrange(3))
        rows.append((i % 50, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("max_edits", [1, 2, 3])
def test_line_dedup_equals_all_pairs(spark, max_edits):
    rows = [*line_rows(), *[(d, t) for d, t in AWKWARD if t is None or len(t) < 50_000]]
    got = line_dedup.dedup(docs(spark, rows), max_edits=max_edits)
    assert rows_of(got, "doc_id", "text", "n_lines") == plain_dedup(rows, max_edits, 24)


@pytest.mark.parametrize("cell", [1, 3])
def test_line_dedup_compares_all_cells_of_a_large_group(spark, monkeypatch, cell):
    """Lines of one template: each shares a segment with all others, few are near."""
    monkeypatch.setattr(line_dedup, "CELL", cell)
    rng = random.Random(2)
    rows = [(i, "the beginning that all of them share " + "".join(rng.choice("abc") for _ in range(5)) + " mid" + rng.choice(["", "x", "yz"])) for i in range(40)]
    assert rows_of(line_dedup.dedup(docs(spark, rows)), "doc_id", "text", "n_lines") == plain_dedup(rows, 2, 24)


@pytest.mark.parametrize("hot", [False, True])
def test_line_dedup_leaves_a_near_line_for_every_line_of_a_chain(spark, monkeypatch, hot):
    """Each line two edits from the next, in one chain and in several that share segments; with every key dealt as a hot one too."""
    if hot:
        monkeypatch.setattr(line_dedup, "HEAVY", 1_000_000_000)
    rng, rows = random.Random(3), []
    for chain in range(6):
        line = list("".join(rng.choice("abcdefgh ") for _ in range(30)) + " and then something that all chains share")
        for step in range(12):
            rows.append((len(rows), "".join(line)))
            for at in rng.sample(range(30), 2):
                line[at] = rng.choice("ijklmnop")
    got = line_dedup.dedup(docs(spark, rows))
    assert rows_of(got, "doc_id", "text", "n_lines") == plain_dedup(rows, 2, 24)
    kept = [r.text for r in got.collect() if r.text]
    assert all(any(distance(t, k) <= 2 for k in kept) for _, t in rows) and not any(distance(a, b) <= 2 for a in kept for b in kept if a < b)


def test_edit_distance_in_the_band_equals_the_plain_one(spark):
    rng, rows = random.Random(1), []
    for _ in range(3000):
        a = [rng.choice("abé\U0001f600") for _ in range(rng.randrange(1, 14))]
        b = list(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é", "xy"])
        rows += [("".join(a), "".join(b), distance("".join(a), "".join(b)))] if "".join(b) else []
    pairs = spark.createDataFrame(rows, "a string, b string, d int")
    for k in (1, 2, 3, 4):
        assert pairs.filter(line_dedup.within("a", "b", k) != (F.col("d") <= k)).count() == 0


def test_line_dedup_takes_lines_of_hundreds_of_thousands_of_characters(spark):
    line = "eeeeeeeeeee " * 33_000
    got = {r.doc_id: r for r in line_dedup.dedup(docs(spark, [(1, line), (2, line[:200_000] + "x" + line[200_000:]), (3, line[:-40])])).collect()}
    assert line.count("e") > 32_767 and sorted(got[i].n_near for i in (1, 2)) == [0, 1] and got[3].text == line[:-40]


def test_line_dedup_keeps_columns_and_takes_empty_tables(spark):
    got = line_dedup.dedup(wide(spark))
    assert got.columns == [*wide(spark).columns, "n_lines", "n_exact", "n_near"] and got.count() == len(AWKWARD)
    assert line_dedup.dedup(docs(spark, [])).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup(sample(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_topk_equals_all_pairs(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(np.float32(x)) for x in rng.integers(-2, 3, 4) / 3]) for i in range(400)]
    rows += [(401, None), (402, [1.0, None, 0.0, 0.0]), (403, [float("nan")] * 4), (404, [float("inf")] * 4), (None, [0.5] * 4), (500, [0.25, 0.5]), (600, [0.5, 0.5]), (17, [0.1] * 4), (200, [0.1] * 4)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, s string, dim int")
    vectors = topk.integer_vectors(df)
    plain = [(r.vec_id, r.v) for r in vectors.collect()]
    assert len(plain) == 405
    for k, block in ((10, 4096), (3, 16), (500, 64)):
        got = rows_of(topk.search(vectors, vectors.filter("vec_id % 100 = 0"), k, block, fan_in=3), "query_id", "rank", "vec_id", "score")
        wanted = []
        for q in sorted({i for i, _ in plain if i is not None and i % 100 == 0}):
            v = min(w for i, w in plain if i == q)
            hits = sorted((-sum(a * b for a, b in zip(v, w)), i is None, i or 0) for i, w in plain if i != q and len(w) == len(v))
            wanted += [(q, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(hits[:k])]
        assert got == sorted(wanted, key=repr)
    assert topk.search(vectors.limit(0), vectors.limit(0)).count() == 0
    joins = [x for x in topk.search(vectors, vectors)._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [" in x]
    assert any("s#" in x and "dim#" in x for x in joins)


def test_topk_products_are_exact_or_refused():
    big = np.array([[2**30, 2**30 - 1]])
    assert topk._products(big, big).tolist() == [[2**60 + (2**30 - 1) ** 2]]
    with pytest.raises(OverflowError):
        topk._products(big * 4, big)


def test_word_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORD_BPE)
    assert packing.by_ranks(WORD_BPE)
    for _, t in [*AWKWARD, *[(0, r.text) for r in sample(spark).collect()], (0, "don't I'LL we've 12ab _x_ ÀÉ ß ŉ Ǆ a\x1cb\x85c\xa0d e\u0301")]:
        ids = packing.ids_of(t or "", WORD_BPE, packing.by_ranks(WORD_BPE))
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(t or "", add_special_tokens=False).ids


def check_packing(got, size=2048):
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    return len(used)


def test_packing_places_every_piece_and_fills_sequences(spark):
    for df in (wide(spark), sample(spark)):
        cut = packing.pieces(df, WORD_BPE, with_ids=True)
        got = packing.pack(cut, shard_pieces=100).collect()
        by_doc = Counter()
        for r in got:
            assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length and r.start == 2048 * r.piece
            by_doc[r.doc_id] += r.length
        wanted = Counter()
        for d, t in texts_of(df):
            wanted[d] += len(packing.ids_of(t, WORD_BPE, True)) // 4 + 1
        assert by_doc == wanted
        assert check_packing(got) <= 1.05 * sum(r.length for r in got) / 2048 + 3
    assert packing.pack(packing.pieces(docs(spark, []), WORD_BPE)).count() == 0


def triplets(seed, n):
    """Items that fill n bins exactly, three a bin, which best fit does not find."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(760, 1000)
        b = rng.randrange(520, (2048 - a) // 2 + 1)
        out += [a, b, 2048 - a - b]
    return out


def test_breeding_beats_best_fit(spark):
    for seed in range(3):
        lengths = triplets(seed, 20)
        plain = packing.best_fit(packing.decreasing(list(range(60)), lengths), lengths, 2048, [])
        elites = [packing.breed(lengths, 2048, island, [], 8, 25) for island in range(3)]
        bred = packing.breed(lengths, 2048, 9, elites, 8, 25)
        assert sorted(i for b in bred for i in b) == list(range(60)) and all(packing.fill(b, lengths) <= 2048 for b in bred)
        assert len(bred) <= len(plain) - 2
        rows = [(i, n, "x", "y") for i, n in enumerate(lengths)]
        got = packing.pack(spark.createDataFrame(rows, "doc_id long, length long, shard string, bin string"))
        assert got.columns == ["doc_id", "length", "shard", "bin", "sequence_id", "offset"]
        assert check_packing(got.collect()) <= len(plain) - 2


def test_packing_merges_what_shards_leave(spark):
    rng = random.Random(5)
    lengths = [min(2048, int(rng.lognormvariate(5, 1)) + 1) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long")
    got = packing.pack(rows, shard_pieces=100).collect()
    assert sorted((r.doc_id, r.length) for r in got) == list(enumerate(lengths))
    # Thirty shards would leave thirty sequences partly filled.
    assert check_packing(got) <= -(-sum(lengths) // 2048) + 8


def test_breeding_is_dealt_over_as_many_tasks_as_islands(spark):
    settled = packing._settled(spark.createDataFrame([(i, triplets(i, 5)) for i in range(5)], "shard long, lengths array<long>"), 2048)
    plan = packing._plans(settled, 5, 2048, 3, 2, 4, 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") >= 2 and ", 15), REPARTITION_BY_NUM" in plan


def test_word_ids_are_looked_up_for_one_kind_of_file_only(tmp_path):
    import json

    whole = json.load(open(WORD_BPE, encoding="utf-8"))
    other = whole | {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}
    spaced = whole | {"pre_tokenizer": {**whole["pre_tokenizer"], "pretokenizers": [{**whole["pre_tokenizer"]["pretokenizers"][0], "pattern": {"Regex": " ?[a-z]+"}}, whole["pre_tokenizer"]["pretokenizers"][1]]}}
    for name, model in (("other", other), ("spaced", spaced)):
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(model), encoding="utf-8")
        assert not packing.by_ranks(str(path))
        from tokenizers import Tokenizer

        text = "Some Words, and ÀÉ more's"
        assert np.frombuffer(packing.ids_of(text, str(path), False), "<u4").tolist() == Tokenizer.from_file(str(path)).encode(text, add_special_tokens=False).ids


def test_crossover_keeps_whole_bins_and_all_items():
    rng = random.Random(3)
    lengths = [rng.randrange(1, 700) for _ in range(300)]
    plan = packing.breed(lengths, 2048, 1, [], 4, 5)
    assert sorted(i for b in plan for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in plan)
    one, other = packing.best_fit(list(range(300)), lengths, 2048, []), packing.best_fit(list(range(299, -1, -1)), lengths, 2048, [])
    child = packing.cross(one, other, lengths, 2048, rng)
    assert sorted(i for b in child for i in b) == list(range(300))
    assert len(plan) <= -(-sum(lengths) // 2048) + 1
