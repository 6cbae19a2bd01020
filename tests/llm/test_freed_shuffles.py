"""Steps that end in files of their own leave no shuffle files behind."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from shardforge.llm import linededup
from shardforge.llm.common import stored, written
from shardforge.llm.components import connected_components
from tests.llm.util import frame, sentence


def shuffle_files(spark):
    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return {str(f) for d in dirs for f in Path(d.getPath()).rglob("shuffle_*.data")}


def left_by(spark, work):
    """Shuffle files that ``work`` made and that are still there soon after."""
    before = shuffle_files(spark)
    work()
    for _ in range(50):
        left = shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_written_and_stored_free_their_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = spark.range(10000).withColumn("x", F.xxhash64("id")).repartition(5, "x")
    assert not left_by(spark, lambda: written(df))
    assert not left_by(spark, lambda: stored(df, "freed"))
    assert spark.conf.get(key) == before
    assert written(df).agg(F.sum("id"), F.count_distinct("x")).first()[:] == (49995000, 10000)


def test_component_rounds_free_their_shuffles(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out = []
    assert not left_by(spark, lambda: out.append(connected_components(edges)))
    rows = out[0].collect()
    assert {r["comp"] for r in rows} == {0} and {r["node"] for r in rows} == set(range(301))


def test_line_dedup_cuts_texts_once_and_frees_its_steps(spark, monkeypatch):
    rng = random.Random(8)
    passage = "\n".join(sentence(rng) for _ in range(9))
    rows = [(i, f"{sentence(rng)}\n{passage}\n{sentence(rng)}", "en", "s", None) for i in range(40)]
    cuts, cut = [], linededup.fine_units
    monkeypatch.setattr(linededup, "fine_units", lambda text: cuts.append(1) or cut(text))
    assert not left_by(spark, lambda: linededup.later_pairs(linededup.tables(frame(spark, rows), "doc_id", "text")[1]))
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame(spark, rows)).collect()}
    assert out[0] == rows[0][1] and all(passage not in out[i] for i in range(1, 40))
    assert len(cuts) == 2     # once by tables(), once by line_dedup()


def test_text_that_is_not_utf8_comes_back_as_it_was(spark):
    df = spark.createDataFrame([(1, bytearray(b"one \xff two. three\nfour")), (2, None)], "doc_id long, b binary")
    docs = df.select("doc_id", F.expr("cast(b as string)").alias("text"))
    out = linededup.line_dedup(docs).select("doc_id", F.col("text").cast("binary").alias("b"))
    assert {(r["doc_id"], r["b"] and bytes(r["b"])) for r in out.collect()} == {(1, b"one \xff two. three\nfour"), (2, None)}
