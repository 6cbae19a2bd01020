"""The manifest against a plain tree that keeps every level."""

import random
from hashlib import sha256
from zlib import crc32

import pytest

from shardforge.llm import merkle
from tests.llm.util import corpus, empty, frame


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def way(levels, pos):
    """(siblings before, siblings behind) at each level."""
    out = []
    for nodes in levels[:-1]:
        a = pos - pos % 8
        out.append((nodes[a:pos], nodes[pos + 1:a + 8]))
        pos //= 8
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    low = -(1 << 63)
    leaves = {g: sorted((r[0] if r[0] is not None else low, bytes.fromhex(leaf(r)), i) for i, r in enumerate(rows) if r[2] == g) for g in langs}
    trees = {g: tree([x.hex() for _, x, _ in leaves[g]]) for g in langs}
    over = tree([trees[g][-1][0] for g in langs])
    out = []
    for k, g in enumerate(langs):
        for pos, (doc_id, x, i) in enumerate(leaves[g]):
            steps = way(trees[g], pos) + way(over, k)
            r = list(rows[i])
            if r[0] is not None and crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                r[1] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1])
            cur = leaf(r)
            for before, behind in steps:
                cur = h("".join(before) + cur + "".join(behind))
            proof = "".join("".join(a) + "".join(b) for a, b in steps)
            out.append((rows[i][0], x.hex(), trees[g][-1][0], over[-1][0], proof, cur))
    return sorted(out, key=str)


def got(df):
    return sorted(((r["row"], r["leaf"], r["subroot"], r["root"], r["proof"], r["folded"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("every", [1, 2, 4])
def test_manifest(spark, every):
    rows = corpus()
    docs = frame(spark, rows)
    m = merkle.build_manifest(docs, candidate=merkle.tampered_leaf(), every=every)
    assert [level for level, _ in m.rows.levels][:2] == [0, every]       # nothing between is stored
    have = got(merkle.proofs(m))
    assert have == brute(rows)
    bad = [r for r in have if r[5] != r[3]]
    assert bad and all(crc32(str(r[0]).encode()) % 3 == 0 for r in bad)


def test_many_parts_and_a_hot_part(spark):
    rng = random.Random(3)
    rows = [(i, f"Text {i}", f"part{rng.randint(0, 80)}" if i % 3 else "hot", None, i) for i in range(900)]
    rows += [(i, "Single", f"one{i}", "s", 1) for i in range(900, 910)] + [(7, "same", "hot", "s", 4)] * 70
    m = merkle.build_manifest(frame(spark, rows), candidate=merkle.tampered_leaf(), every=2)
    assert got(merkle.proofs(m)) == brute(rows)


def test_small_tables(spark):
    assert merkle.proofs(merkle.build_manifest(empty(spark))).count() == 0
    one = [(None, None, None, None, None)]
    assert got(merkle.proofs(merkle.build_manifest(frame(spark, one)))) == brute(one)
    for n in (2, 8, 9, 64, 65):
        rows = [(i, "T", "en", None, i) for i in range(n)]
        r = merkle.proofs(merkle.build_manifest(frame(spark, rows), every=1)).collect()
        assert len(r) == n and all(x["folded"] == x["root"] == x["subroot"] for x in r)


def test_heights():
    assert [merkle.height(n) for n in (1, 2, 8, 9, 64, 65, 8 ** 7)] == [0, 1, 1, 2, 2, 3, 7]
    assert merkle.places(17, 16) == [(0, 0), (2, 2)]
