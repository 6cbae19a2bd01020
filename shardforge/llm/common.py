"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.session import checkpoint_dir, ship_package, shuffles_freed, table

# A word is a run of code points other than space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
ROW = "_llm_row"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def boxed(df: DataFrame) -> DataFrame:
    """One struct column holding every input column, so that the columns an
    operator adds can't clash with the caller's names."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(ROW))


def field(name: str) -> Column:
    return F.col(f"{ROW}.`{name}`")


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("bigint")


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that is computed once: without this the
    optimiser copies the expression into every lambda call that reads it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def written(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from
    the files: lineage is cut and a lost executor costs no recomputation. The
    shuffles behind the files go at once."""
    checkpoint_dir(df.sparkSession)
    with shuffles_freed(df.sparkSession):
        return df.select("*").checkpoint(eager=True)     # planned anew: the setting counts when a DataFrame is made


def prepared(spark: SparkSession) -> None:
    """Make this package importable in Python workers."""
    ship_package(spark)


def bucket_of(col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod`` (null ids: null)."""
    return F.crc32(col.cast("string").cast("binary")) % mod


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared checkpoint folder and
    read back; compressed, so better than a checkpoint for larger tables. The
    shuffles behind the files go at once."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
