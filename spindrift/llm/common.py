"""What the corpus operators share: table access, shared-folder tables, words, fixed-width digests."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words: space and 0x09 to 0x0D. bytes.split() cuts at exactly these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Temporary folders of applications that name no shared one, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Only in local mode, as in tests, may it be unset; then a temporary one is used."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    application = spark.sparkContext.applicationId
    if application not in _own:
        _own[application] = "file://" + tempfile.mkdtemp(prefix="spark-")
    return _own[application]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again.

    Cuts the lineage and survives lost executors. The folder is scratch space: the table must outlive the lazy
    frames that read it, so whoever owns the folder clears it after the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than one in so many of the rows of a join is heavy; so there are at most so many heavy keys.
HEAVY = 1000


def join_counted(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", heavy: int = HEAVY) -> DataFrame:
    """left joined (inner or left) with right, which has one row a key and ``n_rows``, how often left has it; n_rows is left out.

    Rows of heavy keys, which have more than one in ``heavy`` rows, stay where they are: their few rows of right, at most ``heavy``, are broadcast. All others are
    shuffled, so no task gets more than a small share of left. Both sides are read twice, so they should be stored.
    """
    total = right.agg(F.sum("n_rows")).first()[0] or 0
    others = [c for c in right.columns if c not in (*keys, "n_rows")]
    few = right.filter(F.col("n_rows") > total / heavy).select(*keys, F.struct(F.lit(0).alias("_"), *others).alias("_heavy"))
    tagged = left.join(F.broadcast(few), keys, "left")
    here = tagged.filter("_heavy is not null").select(*left.columns, *[F.col("_heavy")[c].alias(c) for c in others])
    moved = tagged.filter("_heavy is null").drop("_heavy").join(right.filter(F.col("n_rows") <= total / heavy).drop("n_rows"), keys, how)
    return here.unionByName(moved.select(here.columns))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task makes of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds


def lower_words(text: str) -> list[bytes]:
    """Words of the whole text with A-Z lower-cased; other letters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split()
