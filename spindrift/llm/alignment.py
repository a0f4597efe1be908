"""Alignment of two tokenizers over the same texts, by products of sparse incidence matrices.

Of a text, each tokenizer has an incidence matrix, token by byte, in compressed rows. The product of one with the
other's transpose holds the tokens of both that overlap, and by how many bytes; the product of the two token-by-group
matrices holds those that lie in one group, a group being what lies between two bytes at which tokens of both end.
How often each pair of ids is linked in the corpus is counted in Spark, and each text is then told how its links rank.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import join_counted, slices, stored, text_or_empty

#: Pairs of ids whose counts are broadcast: those that more than one in so many rows of (text, pair) have, so at most so many.
FREQUENT = 200_000
#: Rows of the left matrix that are multiplied at once.
BLOCK = 1 << 15


class Csr(NamedTuple):
    """Compressed rows: row i has the columns indices[indptr[i]:indptr[i + 1]], all with their values in data."""

    indptr: np.ndarray
    indices: np.ndarray
    data: np.ndarray
    n_cols: int


def spread(counts: np.ndarray) -> Csr:
    """The incidence matrix whose row i has the next counts[i] columns."""
    indptr = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
    return Csr(indptr, np.arange(indptr[-1]), np.ones(indptr[-1], np.int64), int(indptr[-1]))


def transposed(m: Csr) -> Csr:
    order = np.argsort(m.indices, kind="stable")
    rows = np.repeat(np.arange(len(m.indptr) - 1), np.diff(m.indptr))
    indptr = np.concatenate([[0], np.cumsum(np.bincount(m.indices, minlength=m.n_cols), dtype=np.int64)])
    return Csr(indptr, rows[order], m.data[order], len(m.indptr) - 1)


def product_sizes(a: Csr, b: Csr) -> np.ndarray:
    """For each row of a, how many products of entries its row of a·b sums: the symbolic half of the product, which bounds its size."""
    total = np.concatenate([[0], np.cumsum(np.diff(b.indptr)[a.indices], dtype=np.int64)])
    return total[a.indptr[1:]] - total[a.indptr[:-1]]


def product(a: Csr, b: Csr, block: int = BLOCK) -> Csr:
    """a·b by rows: row i is the sum of the rows of b that row i of a names, each times a's value there. A block of rows at a time, so that what is not summed yet stays bounded."""
    indptr, indices, data = [np.zeros(1, np.int64)], [], []
    for lo in range(0, len(a.indptr) - 1, block):
        ends = a.indptr[lo : lo + block + 1]
        named, values = a.indices[ends[0] : ends[-1]], a.data[ends[0] : ends[-1]]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        size = b.indptr[named + 1] - b.indptr[named]
        # Places in b of all its rows that are named, one after the other.
        at = np.arange(size.sum()) + np.repeat(b.indptr[named] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) if len(size) else np.zeros(0, np.int64)
        cell = np.repeat(row, size) * b.n_cols + b.indices[at]
        value = np.repeat(values, size) * b.data[at]
        order = np.argsort(cell, kind="stable")
        cell, value = cell[order], value[order]
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
        indices.append(cell[first] % b.n_cols)
        data.append(np.add.reduceat(value, first) if len(first) else value)
        indptr.append(indptr[-1][-1] + np.cumsum(np.bincount(cell[first] // max(1, b.n_cols), minlength=len(ends) - 1)))
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return Csr(np.concatenate(indptr), join(indices), join(data), b.n_cols)


class Alignment(NamedTuple):
    """links: overlapping tokens (row: of a, column: of b) and their common bytes; group_a, group_b: token by group."""

    links: Csr
    group_a: Csr
    group_b: Csr


def aligned(length_a: np.ndarray, length_b: np.ndarray) -> Alignment:
    """The alignment of two sequences of tokens of these lengths in bytes, over the same bytes."""
    links = product(spread(length_a), transposed(spread(length_b)))
    end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    in_group = lambda ends: Csr(np.arange(len(ends) + 1), np.searchsorted(cuts, ends), np.ones(len(ends), np.int64), len(cuts))
    return Alignment(links, in_group(end_a), in_group(end_b))


def shared_group_links(found: Alignment) -> Csr:
    """All pairs of tokens in one group. Where the tokenizers never agree this grows with the product of their tokens; ``product_sizes`` tells its size beforehand."""
    return product(found.group_a, transposed(found.group_b))


def _byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes of Latin-1 stand for themselves, the others for the characters from 256 on in turn."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


#: What byte-level files of this kind cut texts at before they merge bytes; a fixed pattern of the format.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points from here on may be letters for one Unicode version and not for another; texts with one are left to the tokenizer. A test compares all below.
SURE = 0x530


def by_ranks(vocabulary: dict[str, int], merges: list[tuple[str, str]]) -> bool:
    """Whether merging the neighbours whose union comes first in the vocabulary gives the same ids as the merge list.

    It does if the merges before each one, applied to its union alone, leave just its two halves. This is tried for all of them.
    """
    rank, first = {pair: i for i, pair in enumerate(merges)}, len(vocabulary) - len(merges)
    for i, (left, right) in enumerate(merges):
        if vocabulary.get(left + right) != first + i:
            return False
        parts = list(left + right)
        while len(parts) > 1:
            least = min(rank.get(pair, i) for pair in zip(parts, parts[1:]))
            if least >= i:
                break
            joined: list[str] = []
            for part in parts:
                if joined and rank.get((joined[-1], part)) == least:
                    joined[-1] += part
                else:
                    joined.append(part)
            parts = joined
        if parts != [left, right]:
            return False
    return True


def _encoder(form: dict, tokenizer, token_bytes: list[bytes]):
    """Texts -> arrays of ids. Where ranks are proven to give the file's ids, texts of sure characters are merged by rank; all others go through the file's own tokenizer."""
    model, cut = form["model"], form["pre_tokenizer"]
    plainly = lambda texts: [np.array(e.ids, np.int64) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    known = form["normalizer"] is None and (cut["type"], cut.get("add_prefix_space"), cut.get("use_regex", True)) == ("ByteLevel", False, True)
    if not known or model.get("ignore_merges") or model.get("dropout") or not by_ranks(model["vocab"], merges):
        return plainly
    import regex
    import tiktoken

    ranks = tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks={token_bytes[i]: i for i in model["vocab"].values()}, special_tokens={})
    sure = regex.compile(f"[\\x00-{chr(SURE - 1)}]*").fullmatch

    def encode(texts: list[str]) -> list[np.ndarray]:
        fits = [sure(t) is not None for t in texts]
        rest = iter(plainly([t for t, f in zip(texts, fits) if not f]))
        return [ranks.encode_to_numpy(t, disallowed_special=()).astype(np.int64) if f else next(rest) for t, f in zip(texts, fits)]

    return encode


class Coder:
    """A tokenizer's file and the bytes of each of its ids. ``encode`` takes texts and gives arrays of ids."""

    def __init__(self, path: str):
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer, alphabet = Tokenizer.from_file(path), _byte_alphabet()
            tokenizer.encode_special_tokens = True
            vocabulary = tokenizer.get_vocab(with_added_tokens=False)
            self.bytes = [b""] * (max(vocabulary.values()) + 1)
            for token, i in vocabulary.items():
                self.bytes[i] = bytes(alphabet[c] for c in token)
            with open(path, encoding="utf-8") as f:
                encode = _encoder(json.load(f), tokenizer, self.bytes)
            self.encode = lambda texts: encode([" " + t for t in texts])
        else:
            import sentencepiece

            pieces = sentencepiece.SentencePieceProcessor(model_file=path)
            of = lambda i: bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode()
            self.bytes = [of(i) for i in range(pieces.get_piece_size())]
            self.encode = lambda texts: [np.array(ids, np.int64) for ids in pieces.encode(texts, num_threads=1)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        # What an id is written as, before another id of its side or after the last one.
        number = [str(i) for i in range(len(self.bytes))]
        self.inner, self.last = np.array([n + "," for n in number], object), number

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids.tolist()))

    def written(self, end: str) -> np.ndarray:
        return np.array([n + end for n in self.last], object)


@functools.cache
def _coders(path_a: str, path_b: str) -> tuple[Coder, Coder, np.ndarray, np.ndarray]:
    a, b = Coder(path_a), Coder(path_b)
    return a, b, a.written("|"), b.written(";")


def groups_text(ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, path_a: str, path_b: str) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group."""
    a, b, end_a, end_b = _coders(path_a, path_b)
    of_a, of_b = found.group_a.indices, found.group_b.indices
    n_a, n_b = np.bincount(of_a, minlength=found.group_a.n_cols), np.bincount(of_b, minlength=found.group_b.n_cols)
    until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
    words_a, words_b = a.inner[ids_a], b.inner[ids_b]
    words_a[until_a - 1], words_b[until_b - 1] = end_a[ids_a[until_a - 1]], end_b[ids_b[until_b - 1]]
    out = np.empty(len(ids_a) + len(ids_b), object)
    out[np.arange(len(ids_a)) + (until_b - n_b)[of_a]] = words_a
    out[np.arange(len(ids_b)) + until_a[of_b]] = words_b
    return "".join(out.tolist())[:-1]


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(row, doc_id, n_a, n_b, n_groups, n_links, n_shared, groups_sha256, pairs, times), a stored row for each row of docs.

    pairs are the id pairs that are linked in the text, each once, as id of a * vocabulary of b + id of b, and times how many links each has.
    n_shared counts the shared-group links.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = f"row bigint, doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_shared bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"

    def one(text: str, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple:
        a, b, *_ = _coders(path_a, path_b)
        whole = b" " + text.encode()
        if not text or a.joined(ids_a) != whole or b.joined(ids_b) != whole:
            return 0, 0, 0, 0, 0, "", [], []
        found = aligned(a.lengths[ids_a], b.lengths[ids_b])
        digest = hashlib.sha256(groups_text(ids_a, ids_b, found, path_a, path_b).encode()).hexdigest()
        rows = np.repeat(ids_a, np.diff(found.links.indptr))
        pairs, times = np.unique(rows * len(b.bytes) + ids_b[found.links.indices], return_counts=True)
        shared = int(product_sizes(found.group_a, transposed(found.group_b)).sum())
        return len(ids_a), len(ids_b), found.group_a.n_cols, len(rows), shared, digest, pairs, times

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, *_ = _coders(path_a, path_b)
        for batch in slices(batches, 100):
            texts = batch.column("text").to_pylist()
            columns = list(zip(*map(one, texts, a.encode(texts), b.encode(texts)))) or [[]] * 8
            numbers = [pa.array(c, pa.int64()) for c in columns[:5]]
            lists = [pa.array(c, pa.list_(pa.int64())) for c in columns[6:]]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *numbers, pa.array(columns[5], pa.string()), *lists], [f.split()[0] for f in fields.split(", ")])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_or_empty().alias("text"))
    return stored(numbered.mapInArrow(run, fields), "alignment-links")


def pair_counts(coded: DataFrame, vocabulary_b: int) -> DataFrame:
    """(pair, n_rows, n, best) of stored rows (pairs, times): how many rows and links hold the pair, and whether no pair of its id of b has more links."""
    counts = coded.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy(F.col("pairs").alias("pair")).agg(F.count("*").alias("n_rows"), F.sum("times").alias("n"))
    counts = stored(counts, "alignment-counts").withColumn("b", F.col("pair") % vocabulary_b)
    # As many rows as the vocabulary of b has ids.
    most = counts.groupBy("b").agg(F.max("n").alias("most"))
    return stored(counts.join(F.broadcast(most), "b").select("pair", "n_rows", "n", (F.col("n") == F.col("most")).alias("best")), "alignment-pairs")


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_shared), a row for each row of docs (doc_id, text).

    path_a names a byte-level file of ``tokenizers``, which encodes a space and the text, path_b a ``sentencepiece`` model, which
    encodes the text and adds the space. Strings of special tokens inside a text are plain text. A link is a token of each side whose bytes overlap; a
    pair of ids counts as often as links hold it anywhere in docs. n_best are the links whose pair has the highest count of all
    pairs of its id of b, ties included; count_sum adds up the counts of all links. Null and empty texts, and those whose tokens' bytes do not
    make the space and the text again, have no tokens: zeros and an empty groups_sha256. Rows that repeat are counted as often as they stand. doc_id may be of any type
    and null; other columns are left out. An empty table gives no rows.
    """
    coded = links(docs, path_a, path_b)
    each = coded.select("row", F.inline(F.arrays_zip("pairs", "times"))).withColumnsRenamed({"pairs": "pair"})
    scored = pair_counts(coded, len(_coders(path_a, path_b)[1].bytes))
    met = join_counted(each, scored, ["pair"], heavy=FREQUENT)
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
    return coded.join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256", "n_shared")
