"""The two classifiers (held-out accuracy, defined cases) and the registered
queries against their oracles."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shardforge.llm import langid, quality, queries
from tests.conftest import SF_CHECK, SF_SMALL
from tests.llm.util import corpus, empty, frame
from tools.check_oracle import digest


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    rows = [tuple(r) for r in df.collect()]
    res = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in res.description]
    assert digest(df.columns, rows)[0] == digest(cols, res.fetchall())[0]


def test_registered(spark):
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_quality_held_out(spark):
    got = queries.QUERIES["op2_quality_classifier"](spark, SF_CHECK)
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    assert got.count() == docs.count()
    labels = spark.read.parquet(f"{SF_CHECK}/labels.parquet")
    held = got.where("held_out").join(labels, "doc_id")
    right = held.agg(F.avg((F.col("predicted") == F.col("quality")).cast("double"))).first()[0]
    assert right > 0.93


def test_quality_cases(spark):
    df = frame(spark, corpus())
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(40)] + [(3, 0, "x"), (3, 1, "x"), (None, 1, "x"), (5, None, "x")],
                                   "doc_id bigint, quality int, text string")
    out = quality.quality_scores(df, labels, per_label=10, buckets=1 << 10).collect()
    assert len(out) == df.count() and all(0.0 <= r["score"] <= 1.0 for r in out)
    none = quality.quality_scores(df, labels.limit(0), buckets=1 << 10).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality.quality_scores(empty(spark), labels, buckets=1 << 10).count() == 0


def test_language_accuracy(spark):
    out = queries.QUERIES["op10_language_id"](spark, SF_CHECK)
    n = sum(spark.read.parquet(f"{SF_CHECK}/{t}.parquet").count() for t in ("documents", "pages"))
    assert out.count() == n
    assert out.where("lang = declared").count() >= 0.99 * n
    assert out.where("not kept").count() <= 0.01 * n


def test_language_without_declaration(spark):
    """From the text and the host alone."""
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet").where("length(text) > 60")
    ev = langid.document_evidence(docs).withColumn("declared", F.lit(None).cast("string"))
    out = langid.identify(ev, docs.select("lang", "text"), per_lang=40).select("_llm_row.doc.lang", F.col("lang").alias("said"))
    assert out.where("lang = said").count() >= 0.99 * docs.count()


def test_host_prior_and_declaration_decide_without_text(spark):
    labelled = [("aa", "aba caba daba"), ("bb", "oxo pixo roxo")] * 5
    ev = [("aba caba daba", None, None, "h1", "d", k) for k in range(30)] + [("oxo roxo", None, None, "h2", "d", 50 + k) for k in range(30)] + \
         [("q", None, None, "h1", "d", 100), ("q", None, None, "h2", "d", 101), ("q", "bb", None, None, None, 102), ("1 2 3", "bb", None, "h2", "d", 103)]
    rows = spark.createDataFrame(ev, "text string, declared string, suffix string, host string, domain string, kept int")
    out = langid.identify(rows, spark.createDataFrame(labelled, "lang string, text string"), min_posterior=0.5)
    got = {r[0]: (r[1], r[2]) for r in out.select("_llm_row.kept", "lang", "kept").collect()}
    assert got[100][0] == "aa" and got[101][0] == "bb" and got[102][0] == "bb"
    assert got[103] == ("und", False)


def test_language_cases(spark):
    df = frame(spark, corpus())
    out = langid.identify(langid.document_evidence(df), df.select("lang", "text"))
    rows = out.select("_llm_row.doc.*", F.col("lang").alias("said"), F.col("kept").alias("keep")).select("doc_id", "said", "keep").collect()
    assert len(rows) == df.count()
    by_id = {r["doc_id"]: r for r in rows}
    assert not any(by_id[i]["keep"] for i in (3000, 3001, 3002))
    e = empty(spark)
    assert langid.identify(langid.document_evidence(e), e.select("lang", "text")).count() == 0
    assert langid.identify(langid.document_evidence(df), e.select("lang", "text")).where("kept").count() == 0


def test_page_evidence(spark):
    html = '<html lang="de"><head><script>var a="<p>";</script><style>x</style></head><body><!-- no -->Gut &amp; <b>da</b></body></html>'
    rows = [(1, "https://www.example.co/de/1", html), (2, "http://m.example.org:80/x", None), (3, None, "plain"), (4, "nonsense", "")]
    got = {r["page_id"]: r for r in langid.page_evidence(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    assert got[1]["text"].split() == ["Gut", "da"] and got[1]["declared"] == "de" and got[1]["suffix"] == "de"
    assert got[1]["host"] == "www.example.co" and got[1]["domain"] == "example.co"
    assert got[2]["host"] == "m.example.org" and got[2]["declared"] is None
    assert got[3]["host"] is None and got[4]["host"] is None
