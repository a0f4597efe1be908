"""Exact top-k search: tiled matrix products of queries and shards, partial selection per tile, tree merging.

Vectors are packed into blocks of bounded size, one row a block. Every block of queries meets every shard of
candidates in one matrix product; each tile keeps its k best per query, and lists are merged a bounded number at a
time until one per query is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import stored


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of each component as double; vectors null or with a null or non-finite component are left out."""
    kept = vectors.select("vec_id", F.col("embedding").alias("e")).filter("e is not null and forall(e, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return kept.select("vec_id", F.expr(f"transform(e, x -> cast(floor({scale} * cast(x as double)) as bigint))").alias("v"))


def _blocks(vectors: DataFrame, parts: int, name: str) -> DataFrame:
    """One row per block: its number, dimension, ids and components. Dealt by hash, equal rows by a random number, so a block's size is bounded with high probability."""
    return (
        vectors.withColumn(name, F.pmod(F.xxhash64("vec_id", "v", F.floor(F.rand(13) * parts)), F.lit(parts)))
        .groupBy(name, F.size("v").alias("dim"))
        .agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))
        .select(name, "dim", F.col("rows.vec_id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_v"))
    )


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where no sum can leave their 53 bits, else in 64-bit integers; beyond these there is no result."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if bound >= 2**63:
        raise OverflowError("an inner product of these vectors may not fit 64 bits")
    if bound < 2**53:
        return (q.astype(np.float64) @ c.astype(np.float64).T).astype(np.int64)
    return q @ c.T


def best_of(scores: np.ndarray, ids: np.ndarray, named: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, then to rows without one."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], ~named[places], -scores[places]))][:k]


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096, fan_in: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other vectors by integer inner product, all if fewer.

    Both inputs hold (vec_id, v). A query never meets rows of its own vec_id. Vectors meet only those of equal length.
    Rows that repeat are separate candidates; of a repeated query id the smallest vector is asked once. A vector
    without an id is a candidate (and comes last among ties), not a query. Other columns are left out. An empty side gives no rows.

    Each block of queries is given a row for each shard, and both meet by the shard's number: as many keys as shards.
    """
    asked = queries.filter("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = vectors.select(F.lit(1).alias("all"), F.lit(0).alias("asked")).unionByName(asked.select(F.lit(0).alias("all"), F.lit(1).alias("asked")))
    n, n_asked = sizes.agg(F.coalesce(F.sum("all"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    parts = max(1, -(-n // block))
    shards = stored(_blocks(vectors.select("vec_id", "v"), parts, "s"), "topk-shards")
    asked = stored(_blocks(asked, max(1, -(-n_asked // block)), "q"), "topk-queries")
    spread = asked.withColumn("s", F.explode(F.expr(f"sequence(0L, {parts - 1}L)")))
    # Numbers of tasks of our own, as adaptive execution would join the few bytes of many tiles to few tasks.
    tasks = min(parts, 4096)
    tiles = shards.repartition(tasks, "s", "dim").join(spread.repartition(tasks, "s", "dim"), ["s", "dim"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for i in range(batch.num_rows):
                dim = batch.column("dim")[i].as_py()
                arrays = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("s_v", "q_ids", "q_v")}
                # Ids in the order of ties: as whole numbers, those that are null after all others.
                own = batch.column("s_ids")[i].values
                known = pa.compute.is_valid(own).to_numpy(zero_copy_only=False)
                arrays["s_ids"] = own.fill_null(0).to_numpy()
                c, q = arrays["s_v"].reshape(len(arrays["s_ids"]), dim), arrays["q_v"].reshape(len(arrays["q_ids"]), dim)
                shard = batch.column("s")[i].as_py()
                for lo in range(0, len(q), 256):
                    for query, scores in zip(arrays["q_ids"][lo : lo + 256], _products(q[lo : lo + 256], c)):
                        other = (arrays["s_ids"] != query) | ~known
                        ids, scores, named = arrays["s_ids"][other], scores[other], known[other]
                        top = best_of(scores, ids, named, k)
                        for column, values in zip(out, ([query] * len(top), [shard] * len(top), [i if x else None for i, x in zip(ids[top].tolist(), named[top])], scores[top].tolist())):
                            column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["query_id", "part", "vec_id", "score"])

    lists = tiles.mapInArrow(run, "query_id bigint, part bigint, vec_id bigint, score bigint")
    while True:
        parts = -(-parts // fan_in)
        lists = (
            lists.groupBy("query_id", F.floor(F.col("part") / fan_in).alias("part"))
            .agg(F.expr(f"slice(array_sort(collect_list(struct(-score as low, vec_id is null as unnamed, vec_id))), 1, {k})").alias("best"))
            .select("query_id", "part", F.posexplode("best").alias("at", "hit"))
            .select("query_id", "part", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.low")).alias("score"))
        )
        if parts <= 1:
            return lists.select("query_id", "rank", "vec_id", "score")
