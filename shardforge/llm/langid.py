"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied into one posterior over languages:

* text: trigrams around every letter (UTF-8 bytes, A-Z lower-cased) hashed
  into ``buckets``, one smoothed multinomial per language, learned from a
  bounded labelled sample (``per_lang`` texts of each language with the
  smallest text hash). The log-likelihood is averaged and counted as at most
  ``text_weight`` observations, because neighbouring trigrams depend on each
  other;
* the language the markup declares, through a confusion table P(declared |
  language) that is estimated over all rows by grouped aggregation;
* the address suffix: a language code in the address (a path part such as
  ``/de/`` or a country ending), used the same way;
* the host: a prior over languages, smoothed towards the prior of its domain,
  which is smoothed towards that of all rows; each is a grouped sum of the
  text posteriors, and a row's own part is taken out of its host's prior.

A row is kept when it has letters and its best language has a posterior of at
least ``min_posterior``; else its language is ``und``.

Hot hosts: host sums are partial aggregations, and the table of hosts meets
the rows (numbers only, no texts) in a join that the adaptive skew join can
split. Texts are read in one narrow pass and never shuffled.

Defined results: null or empty text is no text evidence and is rejected; null
declared language, address or host is no evidence of that kind; repeated rows
are each judged; with no labelled rows every row is rejected; an empty table
gives an empty result. Extra columns pass through untouched.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.llm.common import ROW, boxed, field, held, prepared, stored, text_or_empty, written
from shardforge.llm.textarrays import LOWER, U, mix, raw_bytes, slices, string_array

BUCKETS = 1 << 14


def trigrams(arr: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of the byte trigrams around each letter byte. Anything
    that is no letter, and the start and end of a text, is one separator, so
    every text with a letter has a trigram."""
    data, offs = raw_bytes(arr)
    n = len(arr)
    low = LOWER[data]
    pad = np.full(len(data) + n + 1, 32, np.uint8)
    pad[np.arange(len(data)) + np.repeat(np.arange(n) + 1, np.diff(offs))] = np.where((low >= 97) & (low <= 122) | (low >= 128), low, 32)
    owner = np.repeat(np.arange(n), np.diff(offs) + 1)
    at = np.flatnonzero(pad[1:-1] != 32)
    w = pad.astype(U)
    gram = w[at] | w[at + 1] << U(8) | w[at + 2] << U(16)
    return owner[at], (mix(gram) % U(buckets)).astype(np.int64)


def _sample_counts(buckets: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, part in slices(string_array(batch.column(1))):
                row, bucket = trigrams(part, buckets)
                lang = batch.column(0).slice(lo, len(part)).dictionary_encode()
                code = lang.indices.to_numpy(zero_copy_only=False)[row].astype(np.int64)
                key, n = np.unique(code * buckets + bucket, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [lang.dictionary.take(pa.array(key // buckets)), pa.array(key % buckets), pa.array(n.astype(np.int64))],
                    names=["lang", "bucket", "n"])
    return run


def text_model(labelled: DataFrame, per_lang: int, buckets: int) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities per bucket, from (lang, text)."""
    langs = [r[0] for r in labelled.where("lang is not null").groupBy("lang").count().orderBy("lang").collect()]
    counts = np.zeros((len(langs), buckets))
    for i, lang in enumerate(langs):
        part = (labelled.where((F.col("lang") == lang) & (F.length("text") > 0))
                .orderBy(F.xxhash64("text"), "text").limit(per_lang))
        for r in part.mapInArrow(_sample_counts(buckets), "lang string, bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
            counts[i, r[0]] = r[1]
    probs = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * buckets)
    return langs, np.log(probs).astype(np.float32)


def _loglik(model: np.ndarray) -> Callable:
    buckets = model.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, i = batch.num_rows, batch.schema.get_field_index("_text")
            total, grams = np.zeros((n, len(model))), np.zeros(n, np.int64)
            for lo, part in slices(string_array(batch.column(i))):
                row, bucket = trigrams(part, buckets)
                grams[lo:lo + len(part)] = np.bincount(row, minlength=len(part))
                for k, logp in enumerate(model):
                    total[lo:lo + len(part), k] = np.bincount(row, weights=logp[bucket], minlength=len(part))
            cols = [c for j, c in enumerate(batch.columns) if j != i]
            flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * len(model), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([*cols, flat, pa.array(grams)],
                                             names=[f.name for j, f in enumerate(batch.schema) if j != i] + ["ll", "grams"])
    return run


def _softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    e = F.transform(scores, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def _confusion(rows: DataFrame, said: str, langs: list[str]) -> list[list[float]]:
    """log P(said | language): smoothed sums of the text posteriors over all
    rows; what is said is one of the languages or something else."""
    code = F.coalesce(*[F.when(F.col(said) == x, F.lit(i)) for i, x in enumerate(langs)], F.lit(len(langs)))
    sums = {r["code"]: r for r in rows.where(F.col(said).isNotNull()).groupBy(code.alias("code"))
            .agg(*[F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(len(langs))]).collect()}
    n = len(langs)
    out = []
    for i in range(n):
        m = [1.0 + (float(sums[c][f"s{i}"]) if c in sums else 0.0) + (2.0 if c == i else 0.0) for c in range(n + 1)]
        out.append([math.log(x / sum(m)) for x in m])
    return out


def identify(rows: DataFrame, labelled: DataFrame, per_lang: int = 500, buckets: int = BUCKETS, text_weight: float = 40.0,
             strength: float = 5.0, min_posterior: float = 0.6) -> DataFrame:
    """``rows``: any columns plus text, declared, suffix, host, domain (give
    null where there is none). ``labelled``: (lang, text). Returns the rows as
    the struct ``_llm_row`` with lang, posterior, posteriors, kept."""
    prepared(rows.sparkSession)
    langs, model = text_model(labelled.select(F.col("lang").cast("string"), text_or_empty(F.col("text")).alias("text")), per_lang, buckets)
    keep_cols = [c for c in rows.columns if c != "text"]
    n = len(langs)
    if not n:
        return boxed(rows.select(*[F.col(f"`{c}`") for c in keep_cols])).select(
            ROW, F.lit("und").alias("lang"), F.lit(0.0).alias("posterior"), F.lit(None).cast("array<double>").alias("posteriors"), F.lit(False).alias("kept"))
    slim = rows.select(F.struct(*[F.col(f"`{c}`") for c in keep_cols]).alias(ROW), text_or_empty(F.col("text")).alias("_text"))
    schema = f"{ROW} {slim.schema[ROW].dataType.simpleString()}, ll array<double>, grams bigint"
    weighed = slim.mapInArrow(_loglik(model), schema)
    scale = F.least(F.col("grams").cast("double"), F.lit(text_weight)) / F.greatest(F.col("grams"), F.lit(1))
    base = held(weighed.select(ROW, "grams", "ll", *[field(c).cast("string").alias(c) for c in ("declared", "suffix", "host", "domain")]),
                "text_ll", F.transform("ll", lambda x: x * scale)).drop("ll")
    base = written(base.withColumn("post", _softmax(F.col("text_ll"))))
    seen = base.where("grams > 0")
    evidence = {c: _confusion(seen, c, langs) for c in ("declared", "suffix")}

    def told(c: str, i: int) -> Column:
        table = evidence[c][i]
        hit = F.coalesce(*[F.when(F.col(c) == x, F.lit(table[k])) for k, x in enumerate(langs)], F.lit(table[n]))
        return F.when(F.col(c).isNull(), F.lit(0.0)).otherwise(hit)

    sums = [F.sum(F.col("post")[i]).alias(f"s{i}") for i in range(n)]
    whole = seen.agg(*sums).first()
    total = sum(float(whole[i] or 0.0) for i in range(n))
    prior = [(float(whole[i] or 0.0) + 1.0) / (total + n) for i in range(n)]
    hosts = seen.where("host is not null").groupBy("host", "domain").agg(F.count(F.lit(1)).alias("hn"), *sums)
    domains = hosts.groupBy("domain").agg(F.sum("hn").alias("dn"), *[F.sum(f"s{i}").alias(f"d{i}") for i in range(n)])
    # smoothed towards the domain, which is smoothed towards all rows
    by_domain = [(F.coalesce(f"d{i}", F.lit(0.0)) + strength * prior[i]) / (F.coalesce("dn", F.lit(0)) + strength) for i in range(n)]
    hosts = (hosts.withColumn("dkey", F.coalesce("domain", F.lit("")))
             .join(domains.select(F.coalesce("domain", F.lit("")).alias("dkey"), "dn", *[f"d{i}" for i in range(n)])
                   .groupBy("dkey").agg(F.sum("dn").alias("dn"), *[F.sum(f"d{i}").alias(f"d{i}") for i in range(n)]), "dkey", "left")
             .select(F.col("host").alias("h_host"), "dkey", "hn", F.array(*[F.col(f"s{i}") for i in range(n)]).alias("hs"),
                     F.array(*by_domain).alias("dp")))
    hosts = stored(hosts, "hosts")     # with its size known, a small table is broadcast and the texts stay where they are
    joined = (base.withColumn("b_dkey", F.coalesce("domain", F.lit("")))
              .join(hosts, (F.col("host") == F.col("h_host")) & (F.col("b_dkey") == F.col("dkey")), "left"))
    # the row's own posterior is taken out of its host's sums
    own = F.when(F.col("grams") > 0, 1.0).otherwise(0.0)
    score = [F.col("text_ll")[i] + told("declared", i) + told("suffix", i) + F.log(
        F.when(F.col("hn").isNull(), F.lit(prior[i])).otherwise(
            (F.greatest(F.col("hs")[i] - own * F.col("post")[i], F.lit(0.0)) + strength * F.col("dp")[i])
            / (F.greatest(F.col("hn") - own, F.lit(0.0)) + strength))) for i in range(n)]
    fused = held(joined.select(ROW, "grams", F.array(*score).alias("score")), "s", F.col("score"))
    fused = held(fused.select(ROW, "grams", "s"), "posteriors", _softmax(F.col("s")))
    best = F.array_max("posteriors")
    lang = F.element_at(F.array(*[F.lit(x) for x in langs]), F.array_position("posteriors", best).cast("int"))
    return (fused.withColumn("kept", (F.col("grams") > 0) & (best >= min_posterior))
            .select(ROW, F.when(F.col("kept"), lang).otherwise(F.lit("und")).alias("lang"), best.alias("posterior"), "posteriors", "kept"))


# --- what the two tables offer as evidence -------------------------------

LANG_CODE = r"(?i)<html[^>]*\blang\s*=\s*[\"']?([a-z]{2,3})"
PATH_CODE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+/([a-z]{2})(?:[/?#]|$)"
HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)"


def _found(c: Column, pattern: str) -> Column:
    x = F.lower(F.regexp_extract(c, pattern, 1))
    return F.when(F.length(x) > 0, x)


def visible_text(html: Column) -> Column:
    """The text a reader sees: scripts, styles, comments and tags removed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"&[a-zA-Z0-9#]+;", " ")


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id, text, declared, suffix, host, domain from url and html."""
    host = _found(F.col("url"), HOST)
    ending = F.regexp_extract(host, r"\.([a-z]{2})$", 1)
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), visible_text(F.col("html")).alias("text"),
        _found(F.col("html"), LANG_CODE).alias("declared"),
        F.coalesce(_found(F.col("url"), PATH_CODE), F.when(F.length(ending) > 0, ending)).alias("suffix"),
        host.alias("host"), F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1).alias("domain"))


def document_evidence(docs: DataFrame) -> DataFrame:
    """The documents' lang column is what was declared, source is the host."""
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"), F.lower(F.col("lang").cast("string")).alias("declared"),
        F.lit(None).cast("string").alias("suffix"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("domain"))
