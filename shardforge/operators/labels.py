"""Label dropout (A5) and label lookup (D3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.functions.rng import seeded_uniform
from shardforge.functions.vectors import vec_add
from shardforge import constants as K


def label_dropout(label: Column, key: Column, p: float = K.CLASS_DROPOUT, null_class: int = K.NULL_CLASS,
                  seed: int = 0, force: Column | None = None) -> Column:
    """Replace the label by the null class with probability ``p`` (seeded by
    key), or, when a force column is given, exactly where force == 1."""
    if force is not None:
        drop = F.coalesce(force == F.lit(1), F.lit(False))
    else:
        drop = seeded_uniform(seed, "drop", key) < F.lit(float(p))
    return F.when(drop, F.lit(null_class)).otherwise(label).cast("int")


def label_lookup(df: DataFrame, table: DataFrame, label_col: str = "label",
                 table_label: str = "label", table_vec: str = "vec",
                 add_col: str | None = None, out_col: str = "cond") -> DataFrame:
    """Label -> vector from a class table (which holds the null-class row
    too), optionally summed with another vector column (condition c = t + y).

    The class table is keyed by class id, so it is as large as the class
    count, not the data; the join is left to the optimizer, which broadcasts
    it when its size is under the configured threshold. Rows whose label is
    absent from the table are kept with ``lookup_ok = false`` and a NULL
    vector (the error row)."""
    t = table.select(F.col(table_label).alias("_lbl"), F.col(table_vec).alias("_vec"))
    joined = df.join(t, df[label_col] == t["_lbl"], "left")
    vec = F.col("_vec")
    if add_col is not None:
        vec = F.when(F.col("_vec").isNotNull(), vec_add(F.col(add_col), F.col("_vec")))
    return (joined.withColumn(out_col, vec)
            .withColumn("lookup_ok", F.col("_lbl").isNotNull())
            .drop("_lbl", "_vec"))
