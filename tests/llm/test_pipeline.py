"""The pipeline's stages, each against a brute-force version of its decision."""

import random
from collections import Counter

import corpus_pipeline as cp
from shardforge.llm import langid
from shardforge.llm.common import documents
from tests.conftest import SF_SMALL
from tests.llm.test_brute import brute_components, brute_lines, check_packing
from tests.llm.util import corpus, empty, frame

COLS = cp.COLUMNS


def rows_of(df):
    return [tuple(r) for r in df.select(*COLS).collect()]


def test_stages_by_brute_force(spark):
    rows = corpus()
    stage = dict(cp.STAGES)
    df = frame(spark, rows)
    kept = stage["language_id"](spark, df, SF_SMALL)
    assert kept.columns == COLS
    ev = langid.identify(langid.document_evidence(df), df.select("lang", "text")).where("kept").select("_llm_row.doc.doc_id").collect()
    first = rows_of(kept)
    assert Counter(r[0] for r in first) == Counter(r[0] for r in ev)
    assert Counter(first) <= Counter(rows)
    assert {3000, 3001, 3002} & {r[0] for r in first} == set() and len(first) >= len(rows) - 6

    want = brute_lines(spark, first)
    second = rows_of(stage["line_dedup"](spark, frame(spark, first), SF_SMALL))
    expect = [(i, want[(i, t)]) for i, t, *_ in first if want[(i, t)].strip()]
    assert Counter((r[0], r[1]) for r in second) == Counter(expect)
    assert all(r[4] == len(r[1]) for r in second)

    third = rows_of(stage["near_duplicates"](spark, frame(spark, second), SF_SMALL))
    comps = brute_components(second, 80, 5)
    assert Counter(r[0] for r in third) == Counter({i: 1 for i, _, c in comps if i == c})

    fourth = rows_of(stage["source_mix"](spark, frame(spark, third), SF_SMALL))
    assert set(fourth) <= set(third) and max(Counter(fourth).values()) <= 3
    last = stage["pack"](spark, frame(spark, fourth), SF_SMALL).collect()
    check_packing(fourth, last, 2048, 4)


def test_stages_on_an_empty_table(spark):
    df = empty(spark).select(*COLS)
    for _, stage in cp.STAGES:
        df = stage(spark, df, SF_SMALL)
    assert df.count() == 0


def test_run_equals_its_stages(spark):
    out = documents(spark, SF_SMALL)
    for _, stage in cp.STAGES:
        out = stage(spark, out, SF_SMALL)
    ran = cp.run(spark, SF_SMALL)
    assert Counter(map(tuple, ran.collect())) == Counter(map(tuple, out.collect()))
    assert ran.select("doc_id").distinct().count() > 100


def test_near_duplicates_with_repeated_ids(spark):
    """One id with two texts: a near copy of another document goes, the other text stays."""
    rng = random.Random(7)
    a, b = (" ".join(f"w{rng.randint(0, 10**6)}" for _ in range(60)) for _ in range(2))
    rows = [(3, a, "en", "s", 1), (5, a + " tail", "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (3, a + " end", "en", "s", 1),
            (7, None, "en", "s", 0), (7, "", "en", "s", 0)]
    out = [(r[0], r[1]) for r in rows_of(dict(cp.STAGES)["near_duplicates"](spark, frame(spark, rows), SF_SMALL))]
    kept = [r for r in out if r[1]]
    assert len(out) == 3 and sorted(i for i, _ in kept) == [3, 5] and (5, b) in kept and kept != [(5, a + " tail")]
