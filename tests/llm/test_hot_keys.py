"""Hot keys are split."""

from collections import Counter

from pyspark.sql import functions as F

from shardforge.llm import lm
from tests.llm.test_brute import brute_lm
from tests.llm.util import VOCAB, frame


def test_lm_rows_without_id_are_dealt_over_the_blocks(spark):
    rows = [(None, f"{VOCAB[k % 50]} {VOCAB[k % 7]} w{k}", "en", "s", None) for k in range(400)]
    rows += [(None, "one text many times", "en", "s", None)] * 300 + [(7, "one text many times", "en", "s", None)] * 5
    rows += [(20, "one text many times", "en", "s", None)] * 5 + [(None, None, "en", "s", None)] * 4
    df = frame(spark, rows)
    dealt = lm.deal(df.select("doc_id", F.lit(True).alias("train"), F.coalesce("text", F.lit("")).alias("text")), 10)
    per_block = [(r["n"], r["copies"]) for r in dealt.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")).collect()]
    assert len(per_block) == 10 and max(n for n, _ in per_block) < 90
    assert sum(c for _, c in per_block) == len(rows)
    got = lm.score_texts(df, mu=3.0, block_chars=900).collect()
    near = Counter((*r[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    assert near == Counter(brute_lm(rows, 2, 3.0))
