"""I-Match fingerprints, the filter audit and the tokenizer alignment against plain versions."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindrift.llm import alignment, filter_audit, imatch

from .helpers import AWKWARD, docs, rows_of, sample, wide


def plain_terms(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return sorted({int(hashlib.md5(w.encode()).hexdigest()[:15], 16) for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w})


def plain_fingerprints(rows):
    """rows (doc_id, text) of different keys."""
    ordered = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    df = Counter(t for _, text in rows for t in plain_terms(text or ""))
    lexicon = {t for t, n in df.items() if n * imatch.RARE >= len(rows) and n * imatch.COMMON <= len(rows)}
    digest = lambda ts: hashlib.md5(",".join(map(str, ts)).encode()).hexdigest()[:8] if ts else ""

    def mark(text):
        ts = plain_terms(text)
        ts = [t for t in ts if t in lexicon] or ts
        out = [digest(ts)]
        for g in range(64):
            own = [t for t in ts if t >> 54 == g]
            out += [digest(own), digest([t for t in own if t >> 52 & 3 == 0]), digest([t for t in own if t >> 50 & 15 == 0])]
        return out

    def like(a, b):
        filled = sum(x != "" or y != "" for x, y in zip(a, b))
        return sum(x != "" and x == y for x, y in zip(a, b)) / filled if filled else 1.0

    out = []
    for i, (doc_id, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = mark(text), mark(edited), mark(after)
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), ",".join(a), ",".join(b), like(a, b), like(a, c)))
    return out


SHOWN = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


@pytest.mark.parametrize("slot_bytes", [1 << 25, 3000])
def test_fingerprints_equal_plain_ones(spark, slot_bytes):
    rng = random.Random(4)
    rows = [(i, None if i == 7 else " ".join(rng.choice(["alpha", "Beta", "gamma", "x%d" % rng.randrange(400)]) for _ in range(rng.choice([0, 1, 5, 200])))) for i in range(-30, 90)]
    rows += [(None, "only one has no id"), (1000, "é\U0001f600 " * 40 + "long " * 5000)]
    got = imatch.fingerprints(docs(spark, rows), slot_bytes)
    assert rows_of(got, *SHOWN) == sorted(plain_fingerprints(rows), key=repr)


@pytest.mark.parametrize("slot_bytes", [1 << 25, 10])
def test_fingerprints_take_awkward_rows(spark, slot_bytes):
    got = imatch.fingerprints(wide(spark), slot_bytes)
    assert got.count() == len(AWKWARD) and got.columns == SHOWN
    by_text = {(r.doc_id, r.n_chars): r for r in got.collect()}
    assert by_text[5, 9].fingerprint == by_text[6, 9].fingerprint and by_text[5, 9].near_next == 1.0
    assert set(by_text[2, 0].fingerprint) == {","} and by_text[2, 0].near_edited == 1.0
    assert imatch.fingerprints(docs(spark, [])).count() == 0
    [alone] = imatch.fingerprints(docs(spark, [(1, "abcd ef")])).collect()
    assert alone.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and alone.near_next == 1.0
    # A document that repeats is one in the order; one id with many texts is dealt over slots.
    many = [(1, "same text here")] * 30 + [(5, f"{i}th text among those of one id") for i in range(60)] + [(9, "last")]
    rows = rows_of(imatch.fingerprints(docs(spark, many), slot_bytes), "doc_id", "edited_sha256")
    assert len(rows) == 91 and len({r for r in rows if r[0] == 1}) == 1 and len({r for r in rows if r[0] == 5}) == 60


def test_fingerprints_tell_edited_texts_from_others_without_python(spark):
    got = imatch.fingerprints(sample(spark))
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    rows = [r for r in got.collect() if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95 and np.mean([r.near_edited for r in rows]) > 0.1


def plain_audit(rows, names):
    """rows (mask, good, toxic)"""
    found, shapley = [], Counter()
    for order in itertools.permutations(range(len(names))):
        left = rows
        for at, f in enumerate(order):
            lost, left = [r for r in left if r[0] >> f & 1], [r for r in left if not r[0] >> f & 1]
            fails = [r for r in rows if r[0] >> f & 1]
            shapley[f] += len(lost)
            found.append(("".join(names[i] for i in order), at + 1, len(left), len(lost), len(fails) - len(lost), sum(r[0] == 1 << f for r in rows), sum(r[1] for r in lost), sum(r[2] for r in lost), f))
    return sorted((*r[:-1], shapley[r[-1]]) for r in found)


@pytest.mark.parametrize("names", ["A", "AB", "ABC", "ABCDE"])
def test_audit_of_all_orders_equals_filters_applied_one_by_one(spark, names):
    rng = random.Random(len(names))
    parts = {"": 0, "x": 1, "y": 90}
    rows = {p: [(rng.randrange(1 << len(names)), rng.random() < 0.4, rng.random() < 0.2) for _ in range(n)] for p, n in parts.items()}
    rows[""] = [(0, True, True)] * 3
    flat = [(p or None, None if m == 0 else m, 1, g or None, t) for p in rows for m, g, t in rows[p]]
    got = filter_audit.audit(spark.createDataFrame(flat, "part string, mask int, n bigint, good boolean, toxic boolean"), names)
    for p in rows:
        assert sorted(tuple(r)[1:] for r in got.filter(F.col("part") == p).collect()) == plain_audit(rows[p], names)
    assert got.count() == 3 * len(plain_audit([], names))
    assert filter_audit.audit(spark.createDataFrame([], "part string, mask int, n bigint, good boolean, toxic boolean")).count() == 0


def test_swapping_levels_keeps_diagrams_ordered_shared_and_whole():
    diagram = filter_audit.Diagram(4, {m: (m % 3,) for m in range(16)})
    whole = diagram.weights[diagram.root]
    for depth in filter_audit.swaps(4):
        diagram.swap(depth)
        assert diagram.weights[diagram.root] == whole == (sum(m % 3 for m in range(16)),)
    assert len(set(filter_audit.Diagram(5, {}).weights)) == 1 and len(filter_audit.Diagram(5, {m: (1,) for m in range(32)}).weights) == 6


def test_audit_masks_of_awkward_documents(spark):
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("mask", T.StringType()), T.StructField("n", T.StringType())])
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None, "a"), (2, "", "a"), (None, " ", "a"), (None, " ", "a"), (3, words, "b"), (4, words, None), (4, words, None), (5, words[:-4], "b"), (6, "UPPER & lower", "b"), (7, "w " * 200, "b")]
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (6, None, 1), (None, 1, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int")
    got = filter_audit.failure_masks(spark.createDataFrame([(*r, "m", "n") for r in rows], schema), labels)
    wanted = {("a", 1, 1, None, None): 1, ("a", 17, 1, None, None): 1, ("a", 1, 2, None, None): 1, ("b", 0, 1, True, False): 1, (None, 16, 2, None, None): 1, ("b", 1, 1, None, None): 1, ("b", 13, 1, None, True): 1, ("b", 2, 1, None, None): 1}
    assert Counter(map(tuple, got.select("part", "mask", "n", "good", "toxic").collect())) == wanted


A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def plain_alignment(texts):
    from tokenizers import Tokenizer
    import sentencepiece

    one, two = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    one.encode_special_tokens = True
    coders = alignment._coders(A, B)
    coded = []
    for t in texts:
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        whole = (" " + t).encode()
        if not t or b"".join(coders[0].bytes[i] for i in a) != whole or b"".join(coders[1].bytes[i] for i in b) != whole:
            a = b = []
        spans = []
        for ids, of in ((a, coders[0].bytes), (b, coders[1].bytes)):
            ends = list(itertools.accumulate(len(of[i]) for i in ids))
            spans.append([(e - len(of[i]), e, i) for e, i in zip(ends, ids)])
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        text, shared = [], 0
        for lo, hi in zip([0, *cuts], cuts):
            sides = [[i for s, e, i in side if lo <= s and e <= hi] for side in spans]
            shared += len(sides[0]) * len(sides[1])
            text.append("|".join(",".join(map(str, x)) for x in sides))
        found = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        coded.append((a, b, cuts, found, ";".join(text), shared))
    counts = Counter(p for c in coded for p in c[3])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [(len(a), len(b), len(cuts), len(f), sum(counts[p] == most[p[1]] for p in f), sum(counts[p] for p in f), hashlib.sha256(t.encode()).hexdigest() if a else "", s) for a, b, cuts, f, t, s in coded]


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 20])
def test_alignment_equals_all_pairs_of_tokens(spark, monkeypatch, frequent):
    monkeypatch.setattr(alignment, "FREQUENT", frequent)
    monkeypatch.setattr(alignment, "BLOCK", 7)
    rng = random.Random(6)
    texts = ["", "a", " ", "  two  spaces ", "\n\t", "straße İé\U0001f600", "▁ is taken for a space", "<s> </s> <0x41> <|endoftext|>", "ﬁ   　x", "漢字かな交じり文", "x" * 300]
    texts += ["".join(rng.choice("ab é1 \n.漢\U0001f600") for _ in range(rng.randrange(60))) for _ in range(60)] + ["the same words again and again"] * 5
    texts += [r.text[:600] for r in sample(spark, 40).collect() if r.text]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, None)]
    got = alignment.align(docs(spark, rows), A, B)
    wanted = plain_alignment([t or "" for _, t in rows])
    assert rows_of(got, *got.columns) == sorted(((i, *w) for (i, _), w in zip(rows, wanted)), key=repr)


def test_ranks_give_the_ids_of_the_tokenizer():
    from tokenizers import Tokenizer

    vocabulary = {"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4, "abc": 5}
    assert alignment.by_ranks(vocabulary, [("a", "b"), ("b", "c"), ("ab", "c")]) and not alignment.by_ranks(vocabulary, [("a", "b"), ("b", "c"), ("a", "bc")])
    plain, coder = Tokenizer.from_file(A), alignment.Coder(A)
    plain.encode_special_tokens = True
    rng = random.Random(3)
    texts = ["".join(f"a{chr(k)}1{chr(k)}.{chr(k)} {chr(k)}{chr(k)}\n" for k in range(alignment.SURE))]
    texts += ["".join(rng.choice(["'s", "'ll", "'", " ", "  ", "\n", "ab", "é", "7", "...", "\u0301", "漢", "<|endoftext|>", "\u2028"]) for _ in range(rng.randrange(30))) for _ in range(400)]
    for at in range(0, len(texts), 50):
        got = coder.encode(texts[at : at + 50])
        assert [g.tolist() for g in got] == [plain.encode(" " + t, add_special_tokens=False).ids for t in texts[at : at + 50]]


def test_alignment_takes_awkward_rows(spark):
    got = alignment.align(wide(spark), A, B)
    assert got.count() == len(AWKWARD) and got.filter("n_a = 0 and groups_sha256 <> ''").count() == 0 and got.filter("n_a > 0").count() > 5
    assert alignment.align(docs(spark, []), A, B).count() == 0


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_products_equal_dense_ones(block):
    rng = np.random.default_rng(2)
    for n, m, k in ((5, 7, 4), (1, 1, 1), (6, 3, 9), (0, 3, 2), (3, 0, 2), (4, 5, 0)):
        dense = [rng.integers(0, 3, (n, m)) * (rng.random((n, m)) < 0.4), rng.integers(0, 3, (m, k)) * (rng.random((m, k)) < 0.4)]
        sparse = [alignment.Csr(np.concatenate([[0], np.cumsum((d != 0).sum(axis=1))]).astype(np.int64), np.nonzero(d)[1], d[np.nonzero(d)], d.shape[1]) for d in dense]
        got = alignment.product(*sparse, block)
        out = np.zeros((n, k), np.int64)
        out[np.repeat(np.arange(n), np.diff(got.indptr)), got.indices] = got.data
        assert (out == dense[0] @ dense[1]).all() and got.n_cols == k
        assert (np.diff(got.indptr) <= alignment.product_sizes(*sparse)).all()
        back = alignment.transposed(alignment.transposed(sparse[0]))
        assert all((x == y).all() for x, y in zip(back[:3], sparse[0][:3]))
    found = alignment.aligned(np.array([2, 1, 3]), np.array([1, 2, 1, 2]))
    assert list(zip(np.repeat(np.arange(3), np.diff(found.links.indptr)), found.links.indices, found.links.data)) == [(0, 0, 1), (0, 1, 1), (1, 1, 1), (2, 2, 1), (2, 3, 2)]
    assert len(alignment.shared_group_links(found).indices) == 2 * 2 + 1 * 2
