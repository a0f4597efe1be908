"""Documents to packed sequences: language ID, line dedup, n-gram Jaccard join, PII, best-fit packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.llm import language, line_dedup, ngram_join, packing, pii
from spindrift.llm.common import stored, table
from spindrift.llm.prefilter import maybe_in, packed, without

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear stay: the text has letters and the fused posterior is at least one half.

    ``lang`` is the declared language and ``source`` the host. The trigram models come from a bounded sample of the
    documents that declare one.
    """
    model = language.fit(docs)
    doc, digest = F.coalesce("doc_id", F.lit(-(2**63))), F.xxhash64("text")
    none = F.lit(None).cast("string")
    rows = docs.select(doc.alias("k0"), digest.alias("k1"), "text", F.col("source").alias("host"), F.lit("").alias("domain"), F.lower("lang").alias("declared"), none.alias("hinted"))
    found = language.identify(rows, model, "text")
    rejected = stored(found.filter("not accepted").select("k0", "k1").distinct(), "pipeline-rejected")
    return without(packed(docs, doc, digest), rejected)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; documents that keep no line of their own go with them."""
    left = line_dedup.dedup(docs)
    emptied = (F.col("n_exact") + F.col("n_near") > 0) & (F.trim(F.regexp_replace("text", "\\s+", " ")) == "")
    return _measured(left.filter(~F.coalesce(emptied, F.lit(False))).select(docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (four fifths of their five-word sets in common) the document with the smallest id stays; of rows with one id, one."""
    labels = stored(ngram_join.link(docs), "pipeline-components")
    copies = stored(labels.filter("doc_id <> component_id").select(F.col("doc_id").alias("k0")).distinct(), "pipeline-copies")
    left = without(packed(docs, F.col("doc_id")), copies)
    repeated = stored(labels.groupBy(F.col("doc_id").alias("k0")).count().filter("count > 1 and k0 is not null").select("k0"), "pipeline-repeated")
    sifted = maybe_in(packed(left, F.col("doc_id")), repeated)
    return sifted.filter("not maybe").select("row").unionByName(sifted.filter("maybe").dropDuplicates(["k0"]).select("row")).select("row.*")


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by the name of its kind."""
    return _measured(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the packed sequences."""
    packed = packing.pack(packing.pieces(docs, TOKENIZER))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", drop_near_copies),
    ("pii", redact_personal_data),
    ("best_fit_packing", pack_sequences),
]

#: Tokenizing and packing have no SQL form; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's result written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
