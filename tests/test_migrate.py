"""Migration by rules in a trie, and comparison of key tables by digests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardforge.operators import hashtree, migrate
from shardforge.operators.keytable import parity

TENSOR = "snapshot int, key string, shape array<int>, values array<double>"


def brute_rename(rules, key):
    """All rules tried on a key: the longest wins, then names before *."""
    best = None
    for r in rules:
        want, have = r.source.split(".") if r.source else [], key.split(".")
        if len(want) > len(have) or not all(w in ("*", h) for w, h in zip(want, have)):
            continue
        rank = (len(want), [w != "*" for w in want])
        if best is None or rank > best[0]:
            best = (rank, r, [h for w, h in zip(want, have) if w == "*"], have[len(want):])
    if best is None:
        return None
    _, r, taken, rest = best
    return None if r.target is None else ".".join([x for x in (r.target.format(*taken), *rest) if x]), r.layout


def test_the_trie_equals_trying_every_rule():
    rng = random.Random(2)
    names = ["a", "b", "c", "1", "2"]
    for _ in range(200):
        sources = {".".join(rng.choice(names + ["*", "*"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 12))}
        rules = [migrate.rule(s, rng.choice([None, "x" + "".join(f".{{{i}}}" for i in range(s.count("*")))]), rng.choice(list(migrate.LAYOUTS))) for s in sources]
        trie = migrate.RuleTrie(rules)
        for _ in range(30):
            key = ".".join(rng.choice(names + ["z"]) for _ in range(rng.randint(1, 6)))
            assert trie.rename(key) == brute_rename(rules, key)
    with pytest.raises(ValueError, match="two rules"):
        migrate.RuleTrie([migrate.rule("a", "b"), migrate.rule("a", "c")])


def test_names_and_layouts_in_one_pass(spark):
    rng = np.random.default_rng(1)
    conv, linear, bias = rng.normal(size=(3, 2, 4, 5)), rng.normal(size=(6, 7)), rng.normal(size=6)
    rows = [(0, "enc.0.proj.weight", [3, 2, 4, 5], conv.ravel().tolist()), (0, "enc.0.fc.weight", [6, 7], linear.ravel().tolist()),
            (0, "enc.0.fc.bias", [6], bias.tolist()), (0, "enc.1.fc.weight", [2, 2], [1.0, None, 3.0, 4.0]), (0, "dec.3.x", [1], [1.0]),
            (0, "enc.18.x", [1], [2.0]), (0, "head.w", [1], [1.0]), (0, None, [1], [1.0]), (0, "other", None, None)]
    rules = [("enc.*", "blocks_{0}", None), ("enc.*.fc.weight", "blocks_{0}.fc.kernel", "linear"), ("enc.*.fc", "blocks_{0}.fc", "linear"),
             ("enc.*.proj.weight", "blocks_{0}.proj.kernel", "conv"), ("dec.*", "blocks_{0+15}", None), ("head", None, None)]
    table = spark.createDataFrame(rules, "source string, target string, layout string")
    df = spark.createDataFrame(rows, TENSOR).repartition(3)
    out = migrate.migrate(df, table)
    got = {r["new_key"]: (r["shape"], r["values"]) for r in out.collect()}
    assert got["blocks_0.proj.kernel"] == ([4, 5, 2, 3], conv.transpose(2, 3, 1, 0).ravel().tolist())
    assert got["blocks_0.fc.kernel"] == ([7, 6], linear.T.ravel().tolist())
    assert got["blocks_0.fc.bias"] == ([6], bias.tolist())           # one axis: nothing to permute
    assert got["blocks_1.fc.kernel"] == ([2, 2], [1.0, 3.0, None, 4.0])
    assert got["other"] == (None, None) and got[None] == ([1], [1.0]) and "head.w" not in got
    clash = migrate.migration_collisions(out, ["snapshot"]).collect()
    assert [(r["new_key"], r["n_sources"], r["first_source"], r["last_source"]) for r in clash] == [("blocks_18.x", 2, "dec.3.x", "enc.18.x")]
    assert {r["key"] for r in migrate.migrate(df, table, unmatched="drop").collect()} == {r[1] for r in rows} - {None, "other", "head.w"}
    with pytest.raises(Exception, match="no rule for"):
        migrate.migrate(df, table, unmatched="error").collect()
    with pytest.raises(Exception, match="values for shape"):
        migrate.migrate(spark.createDataFrame([(0, "enc.0.fc.weight", [2, 3], [1.0])], TENSOR), table).collect()
    assert migrate.migrate(df.limit(0), table).count() == 0


VALUES = "k string, p int, v double"


def _tables(spark, change):
    rng = random.Random(4)
    rows = [(f"m.{b}.{n}", p, rng.choice([None, 0.0, rng.random()])) for b in range(6) for n in ("w", "b") for p in range(20)]
    return spark.createDataFrame(rows, VALUES).repartition(4), spark.createDataFrame(change(rows), VALUES).repartition(3)


@pytest.mark.parametrize("change", [
    lambda rows: rows,
    lambda rows: [(k, p, None if k == "m.2.w" and p == 3 else 5.0 if k == "m.4.b" and p == 1 else v) for k, p, v in rows],
    lambda rows: [r for r in rows if r[0] != "m.1.w"] + [("m.9.w", 0, 1.0), ("m.0.w", 99, None)],
    lambda rows: [(k, p, 0.0 if v is None and k == "m.5.b" else v) for k, p, v in rows],
    lambda rows: rows[:0] + [("x", 1, 1.0)]])
def test_tree_parity_equals_parity(spark, change):
    a, b = _tables(spark, change)
    want = parity(a, b, ["k", "p"], "v", 6).first()
    got = hashtree.tree_parity(a, b, "k", "p", "v", 6).first()
    for c in ("n_common", "n_only_a", "n_only_b", "n_beyond"):
        assert got[c] == want[c], c
    assert got["max_abs_diff"] == pytest.approx(want["max_abs_diff"]) if want["max_abs_diff"] is not None else got["max_abs_diff"] is None
    assert tuple(got["worst_key"] or ()) == tuple(want["worst_key"] or ())
    equal = {k for k, in a.select("k").distinct().collect()}
    rows_a, rows_b = ({(r["k"], r["p"], r["v"]) for r in d.collect()} for d in (a, b))
    same = [k for k in equal if {r for r in rows_a if r[0] == k} == {r for r in rows_b if r[0] == k}]
    assert got["n_skipped"] == 20 * len(same)


def test_differing_subtrees(spark):
    a, b = _tables(spark, lambda rows: [(k, p, 5.0 if k == "m.4.b" and p == 1 else v) for k, p, v in rows if k != "m.1.w"])
    trees = [hashtree.tree_digests(hashtree.path_digests(d, "k", "p", "v")) for d in (a, b)]
    got = {(r["node"], r["kind"], r["n"]) for r in hashtree.differing_subtrees(*trees).collect()}
    assert got == {("", "differs", 240), ("m", "differs", 240), ("m.0", "equal", 40), ("m.2", "equal", 40), ("m.3", "equal", 40), ("m.5", "equal", 40),
                   ("m.1", "differs", 40), ("m.1.w", "only_a", 20), ("m.1.b", "equal", 20),
                   ("m.4", "differs", 40), ("m.4.b", "differs", 20), ("m.4.w", "equal", 20)}
    same = hashtree.differing_subtrees(trees[0], trees[0]).collect()
    assert [(r["node"], r["kind"]) for r in same] == [("", "equal")]


def test_equal_subtrees_are_not_shuffled_by_value(spark):
    """Few paths differ, so they are sent to the scans: only their values reach the join."""
    a, b = _tables(spark, lambda rows: [(k, p, 5.0 if k == "m.4.b" and p == 1 else v) for k, p, v in rows])
    plan = hashtree.tree_parity(a, b, "k", "p", "v", 6)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert plan.count("LeftSemi") >= 2 and F is not None
