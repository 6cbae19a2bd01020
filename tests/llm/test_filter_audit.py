"""The filter audit against counting by hand, in every order."""

import itertools
import random

from pyspark.sql import functions as F

from shardforge.llm import filter_audit
from tests.llm.util import corpus, empty, frame, words

LABELS = "doc_id bigint, quality int, toxic int"


def brute(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    docs = []
    for i, t, lang, *_ in rows:
        t, w = t or "", words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                 "D": any(c in "#$%&*|" for c in t), "E": i is not None and i > first[t]}
        docs.append((lang or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        here = [d for d in docs if d[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = here
            for k, f in enumerate(order):
                kept, gone = [d for d in left if f not in d[1]], [d for d in left if f in d[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), k + 1] = [len(kept), len(gone), sum(f in d[1] for d in here) - len(gone),
                                                    sum(d[1] == {f} for d in here), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                left = kept
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


def got(df):
    rows = df.collect()
    return {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in rows}, len(rows)


def test_filter_audit(spark):
    rng = random.Random(5)
    rows = corpus()
    rows = [(a, b if b is None or i % 6 else b + " 5% & more | $", c, d, e) for i, (a, b, c, d, e) in enumerate(rows)]
    rows += [(None, rows[3][1], "en", None, None)] * 2                    # no id: never a repeat
    rows += [(4000 + k, " ".join(["same words"] * 150), "en", None, None) for k in range(40)]   # a hot text
    ids = [r[0] for r in rows]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in rng.sample(ids, 60)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1)]
    lab = spark.createDataFrame(labels, LABELS).withColumn("part", F.lit(1))
    have, n = got(filter_audit.audit_filters(frame(spark, rows).withColumn("mask", F.lit(1)), lab))
    want = brute(rows, labels)
    assert n == len(want) == 600 * 3 and have == want


def test_empty_and_one_row(spark):
    lab = spark.createDataFrame([], LABELS)
    assert filter_audit.audit_filters(empty(spark), lab).count() == 0
    rows = [(None, None, None, None, None)]
    assert got(filter_audit.audit_filters(frame(spark, rows), lab))[0] == brute(rows, [])


def test_swaps_visit_every_order_once():
    for k in range(6):
        order, seen = list(range(k)), set()
        for s in [None, *filter_audit.adjacent_swaps(k)]:
            if s is not None:
                order[s], order[s + 1] = order[s + 1], order[s]
            seen.add(tuple(order))
        assert seen == set(itertools.permutations(range(k)))


def test_diagram_is_shared_and_canonical():
    """Equal counts are one node, and a diagram swapped into an order equals
    the one built in that order."""
    rng = random.Random(2)
    counts = {m: (rng.randint(0, 3),) for m in range(32)}
    d = filter_audit.Diagram(counts, 5)
    for s in filter_audit.adjacent_swaps(5):
        d.swap(s)
        again = filter_audit.Diagram({sum(1 << i for i, f in enumerate(d.order) if m >> f & 1): c for m, c in counts.items()}, 5)
        assert [len(x) for x in d.levels] == [len(x) for x in again.levels]
        assert [p[1:] for p in d.all_pass()] == [p[1:] for p in again.all_pass()]
    uniform = filter_audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(x) for x in uniform.levels] == [1] * 6 and uniform.weight[uniform.root] == (32,)
