"""The corpus pipeline: language ID, line dedup, near-duplicate removal, source
mixing and packing, each stage over all that the one before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. Stages are written as Parquet in the
shared folder and read again, so a lost executor costs one stage's tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.llm import jaccard, langid, linededup, mixing, packing
from shardforge.llm.common import ROW, documents, stored, text_or_empty

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays unclear after all
    evidence, go. Languages are learned from the documents' own lang column."""
    out = langid.identify(langid.document_evidence(docs), docs.select("lang", "text"))
    return out.where("kept").select(f"{ROW}.doc.*").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are taken out; a document of which nothing stays
    goes. n_chars follows the text."""
    out = linededup.line_dedup(docs)
    emptied = (F.size("_removed") > 0) & (F.length(F.btrim("text", F.lit(linededup.BLANK))) == 0)
    n = F.when(F.size("_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return out.where(~emptied).withColumn("n_chars", n).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents with a Jaccard similarity of 0.8 on
    five-word shingles, the one with the smallest id stays (of equal ids, the
    one with the smallest text hash). Rows repeated with the same id and text
    count once."""
    low = F.lit(-(1 << 63))
    keep = jaccard.representatives(docs, percent=80, width=5).select(F.col("id").alias("_id"), F.col("text_hash").alias("_th"))
    keyed = docs.select(*COLUMNS, F.coalesce("doc_id", low).alias("_id"), F.xxhash64(text_or_empty(F.col("text"))).alias("_th"))
    return keyed.join(keep, ["_id", "_th"]).dropDuplicates(["_id", "_th"]).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.emit_mix(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: its span of words and its bin."""
    return packing.best_fit_packing(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("pack", pack),
]

# No SQL form: the language model and the packing order are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, out, sf_dir), name)
    return STAGES[-1][1](spark, out, sf_dir)
