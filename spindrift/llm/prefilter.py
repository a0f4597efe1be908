"""A bit table that keeps rows without a partner out of a shuffle.

Rows travel as one struct column, ``row``, beside their key columns k0, k1, ..., so no column name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each key, so that about one row in so many passes by chance.
PER_KEY = 16
#: Bounds of the table's size in bits: 8 KB to 32 MB. With more than MOST / 4 keys nothing is sifted and the join that follows takes all rows.
LEAST, MOST = 1 << 16, 1 << 28
#: 64-bit words in a row of the table.
WORDS = 64


def packed(rows: DataFrame, *keys: Column) -> DataFrame:
    """(row, k0, k1, ...)"""
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    return rows.select(whole, *[k.alias(f"k{i}") for i, k in enumerate(keys)])


def key_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c[0] == "k" and c[1:].isdigit()]


def table_size(n_keys: int) -> int:
    """Bits of the table for so many keys: a power of two that grows with them; 0 if the bound leaves fewer than four a key."""
    if n_keys > MOST // 4:
        return 0
    return min(MOST, max(LEAST, 1 << (PER_KEY * n_keys - 1).bit_length() if n_keys else 0))


def _place(df: DataFrame, size: int) -> Column:
    return F.pmod(F.xxhash64(*key_names(df), F.lit(77)), F.lit(size))


def bits(keys: DataFrame, size: int) -> DataFrame:
    """keys (k0, ...) -> (slot, words): one bit for each key's hash, in rows of WORDS words. At most ``size`` bits, so it may be broadcast."""
    hashed = keys.select(_place(keys, size).alias("x"))
    words = hashed.groupBy(F.floor(F.col("x") / 64).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(x % 64 as int)))").alias("word"))
    by_place = F.map_from_entries(F.collect_list(F.struct((F.col("w") % WORDS).cast("int"), "word")))
    full = F.transform(F.sequence(F.lit(0), F.lit(WORDS - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long")))
    return words.groupBy(F.floor(F.col("w") / WORDS).alias("slot")).agg(by_place.alias("m")).select("slot", full.alias("words"))


def maybe_in(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """rows (with k0, ...) and a column ``maybe``: false only if the key is certainly not among keys; the join that follows decides.

    keys are counted first, so they should be a stored table.
    """
    size = table_size(keys.count())
    if not size:
        return rows.withColumn("maybe", F.lit(True))
    marked = rows.withColumn("_x", _place(rows, size)).withColumn("slot", F.floor(F.col("_x") / (64 * WORDS)))
    joined = marked.join(F.broadcast(bits(keys, size)), "slot", "left")
    bit = F.expr(f"shiftright(get(words, cast(_x div 64 % {WORDS} as int)), cast(_x % 64 as int)) & 1L")
    return joined.withColumn("maybe", F.coalesce(bit, F.lit(0)) == 1).drop("_x", "slot", "words")


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a packed frame whose key is not among keys (k0, ...); only rows that may have one are moved. Null keys stay."""
    sifted = maybe_in(rows, keys)
    return sifted.filter(~F.col("maybe")).select("row").unionByName(sifted.filter("maybe").join(keys, key_names(keys), "left_anti").select("row")).select("row.*")
