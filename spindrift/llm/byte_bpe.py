"""Byte-level BPE encoding and decoding.

Texts of up to ``chunk + overlap`` characters are encoded where they are read. Longer ones are cut into overlapping
chunks that tasks pre-tokenise in parallel. Two neighbouring chunks see the same stretch of text, and where both have
a pre-token boundary at the end of a letter or digit run before white space, their cuts have resynchronised: no match
of the pattern spans that place, whatever precedes it. The text is cut at the first such place of each overlap; the
pieces between cuts are encoded in parallel and their ids concatenated. An overlap without such a place is no cut:
its two chunks are encoded as one piece.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import slices, text_or_empty


@lru_cache(maxsize=2)
def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def _bytes_of(path: str) -> list[bytes]:
    of = [b""] * (max(_ranks(path).values()) + 1)
    for token, rank in _ranks(path).items():
        of[rank] = token
    return of


def _decoded(ids: bytes, of: list[bytes]) -> bytes:
    return b"".join(map(of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _encode_column(df: DataFrame, column: str, ranks: str, pattern: str, with_decoded: bool) -> DataFrame:
    """Replace a text column by ``ids``, little-endian unsigned 32-bit ids as bytes, and with_decoded by their bytes too."""
    kept = [c for c in df.columns if c != column]
    names = [*kept, "ids", *(["decoded"] if with_decoded else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks, pattern)
        for batch in slices(batches, 200):
            ids = [encoding.encode_to_numpy(x.as_py(), disallowed_special=()).astype("<u4").tobytes() for x in batch.column(column)]
            coded = [ids, [_decoded(x, _bytes_of(ranks)) for x in ids]] if with_decoded else [ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.binary()) for x in coded)], names)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)
    return df.mapInArrow(run, f"{schema}, ids binary" + ", decoded binary" * with_decoded)


def _cuts(body: str, at: int, chunk: int, pattern) -> tuple[list[int], list[int]]:
    """Places (in the text) of the chunk's boundaries that end a letter or digit run before white space: in its first overlap, in its last."""
    ends = [m.end() for m in pattern.finditer(body)]
    sure = [p for p in ends if p < len(body) and body[p] in " \t\n" and body[p - 1].isalnum()]
    return [at + p for p in sure if p < chunk], [at + p for p in sure if p >= chunk]


def _pieces(texts: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(doc_id, text, copies) -> (doc_id, key, copies, piece_no, piece): pieces that concatenate to the text and are safe to encode alone."""
    chunks = texts.select(
        "doc_id",
        F.xxhash64("text").alias("key"),
        "copies",
        F.length("text").alias("n"),
        F.posexplode(F.expr(f"transform(sequence(0, length(text) - 1, {chunk}), s -> substring(text, s + 1, {chunk + overlap}))")).alias("i", "body"),
    ).repartition("doc_id", "key", "i")

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        matcher = regex.compile(pattern)
        for batch in batches:
            found = [_cuts(b.as_py(), i.as_py() * chunk, chunk, matcher) for b, i in zip(batch.column("body"), batch.column("i"))]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([[p for p in h if p < (i.as_py() * chunk + overlap)] for (h, _), i in zip(found, batch.column("i"))], longs), pa.array([t for _, t in found], longs)],
                [*batch.schema.names, "heads", "tails"],
            )

    seen = chunks.mapInArrow(tokenised, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, key bigint, copies bigint, n int, i int, body string, heads array<bigint>, tails array<bigint>")
    return (
        seen.withColumn("cut", F.expr("array_min(array_intersect(lag(tails) over (partition by doc_id, key, n order by i), heads))"))
        .withColumn("next", F.expr("lead(cut) over (partition by doc_id, key, n order by i)"))
        .withColumn("piece_no", F.expr("count(cut) over (partition by doc_id, key, n order by i)"))
        .withColumn("from", F.expr(f"coalesce(cut, i * {chunk})"))
        .withColumn("part", F.expr(f"substring(body, from - i * {chunk} + 1, coalesce(next, least(n, (i + 1) * {chunk})) - from)"))
        .groupBy("doc_id", "key", "n", "copies", "piece_no")
        .agg(F.expr("array_join(transform(array_sort(collect_list(struct(i, part))), x -> x.part), '')").alias("piece"))
        .repartition("doc_id", "key", "piece_no")
    )


def encode(docs: DataFrame, ranks: str, pattern: str, chunk: int = 32768, overlap: int = 2048, with_decoded: bool = False) -> DataFrame:
    """Ids of every whole text: (doc_id, ids binary of little-endian unsigned 32-bit ids[, decoded]), one row per input row.

    A null text is empty and has no ids. Rows that repeat are encoded and returned as often as they come. Columns
    other than doc_id and text are left out. ``ranks`` is a file that every executor has. A text without white space
    has no safe place to cut and is one piece. With ``with_decoded``, the ids are decoded where they were made.
    """
    docs = docs.select("doc_id", text_or_empty().alias("text"))
    long = F.length("text") > chunk + overlap
    short_ids = _encode_column(docs.filter(~long), "text", ranks, pattern, with_decoded)
    whole = docs.filter(long).groupBy("doc_id", "text").agg(F.count("*").alias("copies"))
    pieces = _encode_column(_pieces(whole, pattern, chunk, overlap), "piece", ranks, pattern, with_decoded)
    coded = [c for c in ("ids", "decoded") if c in pieces.columns]
    ordered = pieces.groupBy("doc_id", "key", "n", "copies").agg(F.array_sort(F.collect_list(F.struct("piece_no", *coded))).alias("pieces"))
    parts = ordered.select("doc_id", "copies", *[F.col("pieces")[c].alias(c) for c in coded])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1)
                yield pa.RecordBatch.from_arrays([row.column("doc_id"), row.column("copies"), *(pa.array([b"".join(row.column(c)[0].as_py())], pa.binary()) for c in coded)], ["doc_id", "copies", *coded])

    joined = parts.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, copies bigint, " + ", ".join(f"{c} binary" for c in coded))
    return short_ids.unionByName(joined.withColumn("copy", F.expr("explode(sequence(1L, copies))")).select("doc_id", *coded))


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Add ``decoded``, the bytes of each row's ids one after another; null ids have none."""
    names = [c for c in encoded.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            raw = [_decoded(x.as_py() or b"", _bytes_of(ranks)) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(raw, pa.binary())], [*names, "decoded"])

    schema = ", ".join(f"`{c}` {encoded.schema[c].dataType.simpleString()}" for c in names)
    return encoded.mapInArrow(run, f"{schema}, decoded binary")
