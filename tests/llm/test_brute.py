"""Each operator against a plain brute-force version on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from shardforge.llm import chat, exact_dedup, fingerprints, jaccard, linededup, lm, mixing, packing
from shardforge.llm.components import connected_components
from tests.llm.util import corpus, empty, frame, sentence, words


@pytest.fixture(scope="module")
def rows():
    return corpus()


def crc(i):
    return zlib.crc32(str(i).encode())


# --- chat --------------------------------------------------------------------

CONV = "conv_id bigint, turn bigint, role string, text string"


def brute_chat(rows):
    convs = defaultdict(set)
    for c, t, r, x in rows:
        convs[c].add((t, r, x))
    low = lambda v: (v is not None, v if v is not None else "")
    seqs = {c: [(r, x) for t, r, x in sorted(s, key=lambda k: (low(k[0]) if k[0] is None else (True, k[0]), low(k[1]), low(k[2])))] for c, s in convs.items()}
    out = {}
    for c, s in seqs.items():
        if any(len(o) > len(s) and o[:len(s)] == s for o in seqs.values()):
            continue
        same = [k for k, o in seqs.items() if o == s]
        best = min((k for k in same if k is not None), default=None)
        if c == best:
            out[c] = (len(same), "".join(f"<|im_start|>{(r if r is not None else 'unknown').replace('<|', '< |')}\n{(x or '').replace('<|', '< |')}<|im_end|>\n" for r, x in s))
    return out


def chat_rows():
    rows = []
    long = [("user" if i % 2 == 0 else "assistant", f"turn {i} text") for i in range(40)]
    for c, n in enumerate([2, 4, 6, 40, 40, 39]):
        rows += [(c, i, r, x) for i, (r, x) in enumerate(long[:n])]
    rows += [(10, 5, "user", "turn 0 text"), (10, 9, "assistant", "turn 1 text")]          # other turn numbers, same prefix
    rows += [(11, 0, "user", "hi <|im_end|>"), (11, 0, "user", "hi <|im_end|>"), (11, 1, None, None)]
    rows += [(12, 0, "user", "hi <|im_end|>"), (12, 1, "unknown", "")]                      # not equal to 11
    rows += [(13, None, "system", "first"), (13, 0, "user", "b"), (13, 0, "user", "a")]
    rows += [(None, 0, "user", "null conversation")]
    return rows


def test_chat(spark):
    rows = chat_rows()
    df = spark.createDataFrame(rows, CONV).withColumn("seg", F.lit(1)).withColumn("k", F.lit(2))
    for segment in (4, 256):
        got = defaultdict(list)
        for r in chat.format_chats(df, segment).collect():
            got[r["conv_id"]].append((r["segment"], r["copies"], r["text"], r["n_segments"]))
        want = brute_chat(rows)
        assert set(got) == set(want)
        for c, parts in got.items():
            parts.sort()
            assert [p[0] for p in parts] == list(range(parts[0][3]))
            assert (parts[0][1], "".join(p[2] for p in parts)) == want[c]
    assert chat.format_chats(spark.createDataFrame([], CONV)).count() == 0


# --- mixing ------------------------------------------------------------------

def test_mixing(spark, rows):
    got = mixing.mix_sources(frame(spark, rows)).select("_llm_row.doc_id", "_llm_row.source", "size", "source_size", "target", "copies", "taken").collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(words(t))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while True:        # the rule as told: share, cut at the cap, share the rest again
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * size[s]]
        if not over:
            target.update({s: left * weight[s] / total for s in open_})
            break
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            open_.discard(s)
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and r["source_size"] == size[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in size:
        assert abs(taken[s] - target[s]) <= largest[s] + 1e-6
    again = mixing.mix_sources(frame(spark, rows).repartition(3)).select("_llm_row.doc_id", "copies").collect()
    assert Counter(map(tuple, again)) == Counter((r["doc_id"], r["copies"]) for r in got)
    emitted = mixing.emit_mix(frame(spark, rows))
    assert emitted.count() == sum(r["copies"] for r in got) and emitted.columns == frame(spark, rows).columns
    assert mixing.emit_mix(empty(spark)).count() == 0


# --- exact dedup ---------------------------------------------------------------

def test_exact_dedup(spark, rows):
    for history in (exact_dedup.half_history(), F.lit(True), F.lit(False)):
        got = exact_dedup.dedup_rows(frame(spark, rows), history, shard_keys=7).collect()
        assert len(got) == len(rows)
        groups = defaultdict(list)
        for i, t, *_ in rows:
            groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
        kept = Counter()
        for r in got:
            ids = groups[r["text_sha256"]]
            assert r["group_size"] == len(ids)
            assert r["keep_id"] == max((i for i in ids if i is not None), default=None)
            if r["kept"]:
                kept[r["text_sha256"]] += 1
                assert r["doc_id"] == r["keep_id"]
        assert set(kept) == set(groups) and set(kept.values()) == {1}
    assert exact_dedup.dedup_rows(empty(spark), F.lit(True)).count() == 0


def test_perfect_hash_is_minimal_and_rejects():
    keys = np.frombuffer(b"".join(hashlib.sha256(str(i).encode()).digest() for i in range(5000)), np.uint8).reshape(-1, 32)
    mph = exact_dedup.PerfectHash(keys)
    assert sorted(mph.slots(keys)) == list(range(5000))
    other = np.frombuffer(b"".join(hashlib.sha256(f"x{i}".encode()).digest() for i in range(1000)), np.uint8).reshape(-1, 32)
    assert mph.slots(other).max() < 5000


# --- fingerprints ---------------------------------------------------------------

def test_fingerprints(spark, rows):
    got = fingerprints.fingerprint_neighbours(frame(spark, rows), part_chars=3000).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    want = []
    for k, (i, t, *_) in enumerate(order):
        nxt, t = order[(k + 1) % len(order)][1] or "", t or ""
        n = len(t) // 2
        new = t[:len(t) - n] + nxt[:n]
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprints.fingerprint(t), fingerprints.fingerprint(new)))
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == Counter(want)
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert fingerprints.fingerprint_neighbours(empty(spark)).count() == 0
    one = fingerprints.fingerprint_neighbours(frame(spark, [rows[0]])).first()
    assert one["near_next"] == 1.0
    assert fingerprints.likeness(fingerprints.fingerprint(rows[1][1]), fingerprints.fingerprint(rows[1][1] + " more")) > 0.7


def slow_print(text):
    """The fingerprint with Python integers only, byte by byte."""
    mask, data = (1 << 64) - 1, text.encode("utf-8", "replace")

    def mixed(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 & mask
        x ^= x >> 27
        x = x * 0x94D049BB133111EB & mask
        return x ^ x >> 31
    byte = [mixed((b + 1) * 0x9E3779B97F4A7C15 & mask) for b in range(256)]
    roll = []
    for at in range(len(data)):
        window = data[max(0, at - 6):at + 1]
        roll.append(mixed(sum(byte[b] << k for k, b in enumerate(reversed(window))) & mask) >> 20 & 0xFFFFFFFF)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"

    def signature(block):
        out, start = "", 0
        for at, r in enumerate(roll):
            last = at + 1 == len(data)
            if last or (r % block == block - 1 and len(out) < 63):
                out += letters[hashlib.blake2b(data[start:at + 1], digest_size=4).digest()[0] & 63]
                start = at + 1
        return out
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and len(signature(block)) < 32:
        block //= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def slow_likeness(x, y):
    def edit(a, b):      # insertions and deletions
        row = list(range(len(b) + 1))
        for i, p in enumerate(a):
            nxt = [i + 1]
            for j, q in enumerate(b):
                nxt.append(row[j] if p == q else 1 + min(row[j + 1], nxt[j]))
            row = nxt
        return row[-1]

    def pair(a, b):
        n = min(4, len(a), len(b))
        if not n or not {a[i:i + n] for i in range(len(a) - n + 1)} & {b[i:i + n] for i in range(len(b) - n + 1)}:
            return 0.0
        return 1 - edit(a, b) / (len(a) + len(b))
    if x == y:
        return 1.0
    at = [dict(zip((int(v.split(":")[0]), 2 * int(v.split(":")[0])), v.split(":")[1:])) for v in (x, y)]
    return max([pair(at[0][b], at[1][b]) for b in at[0] if b in at[1]], default=0.0)


def test_fingerprints_by_an_independent_version(spark, rows):
    some = [r for r in rows if r[1] is None or len(r[1]) < 6000]
    line = sentence(random.Random(1), 9)
    some += [(9000 + k, "\n".join([line] * n), "en", "s", None) for k, n in enumerate((2, 50, 300))]
    prints = {t or "": slow_print(t or "") for _, t, *_ in some}
    got = fingerprints.fingerprint_neighbours(frame(spark, some), part_chars=3000).collect()
    order = sorted(some, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = []
    for (i, t, *_), (_, nxt, *_) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 2
        new = slow_print(t[:len(t) - n] + nxt[:n])
        want.append((i, prints[t], new, round(slow_likeness(prints[t], new), 9), round(slow_likeness(prints[t], prints[nxt]), 9)))
    assert Counter(want) == Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got)


def test_repetitive_texts_keep_a_signature():
    """A repeated line of many different windows has a signature worth comparing."""
    rng = random.Random(2)
    short = [len(fingerprints.fingerprint("\n".join([sentence(rng, 12)] * n)).split(":")[1]) for n in (50, 500) for _ in range(30)]
    assert sum(x < 20 for x in short) <= 2


def test_equal_rows_pack_in_linear_time():
    """20,000 equal pieces conflict with each other: a bin each, without a walk over all bins."""
    import time
    t0 = time.time()
    bins = packing.best_fit([3] * 20000 + [2] * 20000, [0] * 40000, [0] * 20000 + [1] * 20000, 2048, 4)
    assert len(set(bins[:20000])) == 20000 and set(bins[20000:]) == set(bins[:20000]) and time.time() - t0 < 5


def test_common_subsequence():
    def slow(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]
    rng = np.random.default_rng(3)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abcd"), rng.integers(0, 40))) for _ in range(2))
        assert fingerprints.common_subsequence(a, b) == slow(a, b)


def test_rolling_hash_in_cuts_equals_whole(monkeypatch):
    text = "".join(chr(97 + i * i % 26) for i in range(5000))
    whole = fingerprints.fingerprint(text)
    monkeypatch.setattr(fingerprints, "CUT", 97)
    assert fingerprints.fingerprint(text) == whole


# --- line dedup -------------------------------------------------------------------

BLANK = " \n\t\r"
TOKENS = re.compile(r"(?<=[ \t\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u2E80-\U0010FFFF])(?=\S)")


def is_passage(us, s, e, min_chars, min_tokens):
    whole = sum(k in (0, len(us)) or re.search(r"(\n|[.!?] )\Z", us[k - 1]) is not None for k in range(s, e + 1)) > 2
    return len("".join(us[s:e])) >= min_chars and (whole or len(TOKENS.split("".join(us[s:e]))) >= min_tokens)


def brute_lines(spark, rows, min_chars=50, min_tokens=25):
    """The rule on lists; the cut of long lines and the hashes of lines, gaps
    and texts are taken from Spark, texts are compared themselves."""
    texts = sorted({t for _, t, *_ in rows if t is not None})
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    df = df.select("x", F.xxhash64("x").alias("th"), linededup.fine_units(F.col("x")).alias("u"))
    df = df.withColumn("h", F.transform("u", lambda u: F.xxhash64(F.btrim(u, F.lit(BLANK)))))
    g = F.transform(F.sequence(F.lit(1), F.size("h") - 1), lambda i: F.xxhash64(F.get("h", i - 1), F.get("h", i)))
    of = {r["x"]: (r["th"], r["u"], r["g"]) for r in df.select("x", "th", "u", F.when(F.size("h") > 1, g).alias("g")).collect()}
    for t, (_, us, _) in of.items():
        assert "".join(us) == t
        cut = [u for u in re.split(r"(?<=\n)|(?<=[.!?] )", t) if u]
        if all(len(u.encode()) <= linededup.LONG_BYTES for u in cut):
            assert us == cut
    pair = {}
    for t, (_, us, g) in of.items():
        pair[t] = [(a.strip(BLANK), b.strip(BLANK)) for a, b in zip(us, us[1:])]
    bounds = {t: [k for k in range(len(g or [])) if k + 1 == len(g) or g[k] <= g[k + 1]] for t, (_, _, g) in of.items()}
    times = Counter(pair[t][k] for _, t, *_ in rows if t is not None for k in bounds[t])
    docs = {(i, t) for i, t, *_ in rows if t is not None}
    at = defaultdict(list)
    for i, t in docs:
        near, b = set(), bounds[t]
        for n, k in enumerate(b):
            if times[pair[t][k]] > 1:
                near |= set(range(b[n - 1] if n else 0, (b[n + 1] if n + 1 < len(b) else k) + 1))
        for k in near:
            at[pair[t][k]].append((i if i is not None else -(1 << 63), of[t][0], k, (i, t)))
    cover = defaultdict(set)
    for occ in at.values():
        for o in sorted(occ, key=lambda o: o[:3])[1:]:
            cover[o[3]] |= {o[2], o[2] + 1}
    out = {}
    for i, t in docs:
        us, gone, k = of[t][1], set(), 0
        while k < len(us):
            e = k
            while e in cover[i, t]:
                e += 1
            if e > k and is_passage(us, k, e, min_chars, min_tokens):
                gone |= set(range(k, e))
            k = max(e, k + 1)
        out[i, t] = "".join(u for j, u in enumerate(us) if j not in gone)
    return out


def test_line_dedup(spark, rows):
    df = frame(spark, rows)
    for limits in ((50, 25), (0, 0)):
        want = brute_lines(spark, rows, *limits)
        out = linededup.line_dedup(df, min_chars=limits[0], min_tokens=limits[1])
        assert out.columns == df.columns + ["_n_units", "_removed"]
        got = out.select("doc_id", "text", "n_chars", "lang").collect()
        assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, want[(i, t)] if t is not None else None) for i, t, *_ in rows)
        changed = sum(want[(i, t)] != t for i, t, *_ in rows if t is not None)
        assert 10 < changed < len(rows) // 2 or limits == (0, 0)
    assert linededup.line_dedup(empty(spark)).count() == 0


def test_line_dedup_columns_of_its_own_names(spark, rows):
    """_out passes through, _n_units and _removed of the input are replaced."""
    df = frame(spark, rows).select("*", *[F.lit("x").alias(c) for c in ("_out", "_removed", "_n_units", "_text", "_c0", "at", "cover")])
    out = linededup.line_dedup(df)
    assert out.columns == [c for c in df.columns if c not in ("_removed", "_n_units")] + ["_n_units", "_removed"]
    plain = linededup.line_dedup(frame(spark, rows))
    assert Counter(map(str, out.select("doc_id", "text", "_removed").collect())) == Counter(map(str, plain.select("doc_id", "text", "_removed").collect()))
    assert {r["_out"] for r in out.collect()} == {"x"}


def test_line_dedup_catches_a_moved_passage(spark):
    """A passage of eight lines keeps only its first copy."""
    rows = corpus(seed=4)
    out = linededup.line_dedup(frame(spark, rows)).select("doc_id", "text", "_n_units", "_removed").collect()
    with_passage = [r for r in out if r["doc_id"] is not None and r["doc_id"] < 80 and r["doc_id"] % 5 == 0]
    assert sum(len(r["_removed"]) for r in with_passage) >= 8 * (len(with_passage) - 3)     # the first document is there three times


def test_a_hot_chunk_and_hash_collisions(spark, monkeypatch):
    """A third of all rows share a passage; lines with equal hashes and other
    bytes are left alone."""
    rng = np.random.default_rng(4)
    def line(k):
        return " ".join(f"w{x}" for x in rng.integers(0, 10**6, k)) + ".\n"
    passage = "".join(line(9) for _ in range(7))
    rows = [(i, line(8) + (passage if i % 3 == 0 else line(9)) + line(7), "en", "s", None) for i in range(600)]
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame(spark, rows)).select("doc_id", "text").collect()}
    assert out[0] == rows[0][1] and all(passage[:-1] not in out[i] and len(out[i]) < len(rows[i][1]) - 300 for i in range(3, 600, 3))
    assert all(out[i] == rows[i][1] for i in range(600) if i % 3)
    texts, hashes = linededup.tables(frame(spark, rows), "doc_id", "text")
    found = linededup.later_pairs(hashes)
    assert linededup.unequal_lines(texts, found).count() == 0
    from pyspark.sql import DataFrame
    h = spark.createDataFrame([(passage.split("\n")[3],)], "x string").select(F.xxhash64("x").alias("h"))
    assert isinstance(h, DataFrame)
    monkeypatch.setattr(linededup, "unequal_lines", lambda *_: h)
    out = {r["doc_id"]: r["text"] for r in linededup.line_dedup(frame(spark, rows)).select("doc_id", "text").collect()}
    assert all(passage.split("\n")[3] in out[i] and passage.split("\n")[0] not in out[i] for i in range(3, 600, 3))


# --- Jaccard ---------------------------------------------------------------------

def brute_components(rows, percent, width):
    sets = []
    for _, t, *_ in rows:
        w = words(t, lower=True)
        sets.append({tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x] & sets[y])
            if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
                parent[find(x)] = find(y)
    low = {}
    for x, r in enumerate(rows):
        ids = [i for i in (low.get(find(x)), r[0]) if i is not None]
        low[find(x)] = min(ids, default=None)
    return Counter((r[0], len(sets[x]), low[find(x)]) for x, r in enumerate(rows))


def chains(rng_seed=5):
    """Sizes from 1 to 400 words, each with copies 1, 2, ... edits away."""
    rng = np.random.default_rng(rng_seed)
    rows, i = [], 5000
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 15, 18, 22, 27, 40, 60, 90, 150, 400]:
        w = [f"w{x}" for x in rng.integers(0, 10**6, size)]
        for step in range(6):
            rows.append((i, " ".join(w), "en", "s", 0))
            i += 1
            edit = rng.integers(0, 3)
            at = int(rng.integers(0, len(w)))
            if edit == 0:
                w = w[:at] + [f"v{i}"] + w[at + 1:]
            elif edit == 1:
                w = w + [f"v{i}"]
            elif len(w) > 1:
                w = w[1:]
    return rows


@pytest.mark.parametrize("percent,width", [(85, 4), (80, 5), (75, 2)])
def test_jaccard_components(spark, rows, percent, width, monkeypatch):
    data = rows + chains()
    got = jaccard.jaccard_components(frame(spark, data), percent=percent, width=width).collect()
    assert Counter(map(tuple, got)) == brute_components(data, percent, width)


def test_jaccard_empty(spark):
    assert jaccard.jaccard_components(empty(spark)).count() == 0


def test_every_linked_pair_shares_a_cell():
    rng = np.random.default_rng(9)
    for size in [6, 7, 8, 10, 13, 20, 33, 80, 200]:
        for _ in range(30):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            b = np.concatenate([a[int(rng.integers(0, max(1, size // 12))):], rng.integers(0, 2**63, int(rng.integers(0, max(1, size // 12) + 1))).astype(np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            cells, ids = jaccard.cell_rows([a, b], np.array([1, 2]), 85)
            if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
                assert set(cells[ids == 1]) & set(cells[ids == 2])


def near_sets(rng, groups, size, edits):
    """Sets in groups: each group is one random set with up to ``edits`` changed members."""
    out = []
    for _ in range(groups):
        base = rng.integers(0, 2**63, size).astype(np.uint64)
        for _ in range(40):
            x = base.copy()
            k = int(rng.integers(0, edits + 1))
            x[rng.choice(size, k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
            out.append(np.unique(x))
    return out


def count_vectors(sets):
    return np.array([np.minimum(np.bincount((jaccard.mix(s ^ jaccard.U(77)) % jaccard.U(jaccard.GROUPS)).astype(np.int64), minlength=jaccard.GROUPS), 255)
                     for s in sets]).astype(np.uint8)


@pytest.mark.parametrize("across", [False, True])
def test_tree_links_connect_what_all_pairs_connect(across):
    """The tree loses no component, and never puts out more links than it needs."""
    rng = np.random.default_rng(3)
    sets = near_sets(rng, 12, 120, 14)
    n, vec = np.array([len(s) for s in sets]), count_vectors(sets)
    side = rng.integers(0, 2, len(sets)) if across else np.zeros(len(sets), np.int64)
    comp = np.arange(len(sets))
    links = list(jaccard.tile_links(n, vec, comp, side, lambda i: sets[i], 85))
    root = np.arange(len(sets))
    merges = 0
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 85 * (n[i] + n[j] - both) and (not across or side[i] != side[j]) and root[i] != root[j]:
                root[root == root[j]] = root[i]
                merges += 1
    got = np.arange(len(sets))
    for i, j in links:
        assert got[i] != got[j] and (not across or side[i] != side[j])
        got[got == got[j]] = got[i]
    assert len(links) == merges < len(sets)
    pairs = {(int(x), int(y)) for x, y in zip(root, got)}
    assert len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
    assert len(jaccard.CountTree(n, vec).levels) >= 3      # leaves, boxes of leaves, a root
    # the groups of candidates hold every link, with fewer edges than points
    edges = list(jaccard.tile_forest(n, vec, comp, comp, side, 85))
    grp = np.arange(len(sets))
    for i, j in edges:
        assert grp[i] != grp[j]
        grp[grp == grp[j]] = grp[i]
    assert len(edges) < len(sets) and all(grp[i] == grp[j] for i, j in links)


def test_search_output_is_linear_in_the_members(spark):
    """A group whose members link in a chain of neighbours: the rows that
    leave the search stay below the members."""
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(300):
        w = list(words)
        for at in rng.choice(400, 12, replace=False):
            w[at] = f"x{k}_{at}"
        rows.append((k, " ".join(w), "en", "s", 0))
    got = {tuple(r) for r in jaccard.jaccard_components(frame(spark, rows)).collect()}
    assert Counter(got) == brute_components(rows, 85, 4)

def test_tiles_find_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 3)
    got = jaccard.jaccard_components(frame(spark, rows), percent=85, width=4).collect()
    assert Counter(map(tuple, got)) == brute_components(rows, 85, 4)


def test_connected_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(k, k + 1) for k in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["comp"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(parent)}


# --- packing ------------------------------------------------------------------------

def check_packing(rows, got, capacity, per_source):
    bins = defaultdict(list)
    pieces = defaultdict(list)
    text = {}
    for i, t, _, s, _ in rows:
        text[(i, s)] = t or ""
    for r in got:
        pieces[(r["doc_id"], r["source"])].append((r["first_word"], r["n_words"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
        else:
            assert r["n_words"] == 0
    times = Counter((i, s) for i, _, _, s, _ in rows)
    for key, spans in pieces.items():
        n = len(words(text[key]))
        assert sum(x[1] for x in spans) == n * times[key]
        starts = sorted(set(spans))
        assert [x[0] for x in starts] == list(range(0, max(n, 1), capacity))
    for b in bins.values():
        assert sum(r["n_words"] for r in b) == b[0]["bin_words"] <= capacity and len(b) == b[0]["bin_pieces"]
        assert max(Counter(r["source"] for r in b).values()) <= per_source
        assert max(Counter(text[(r["doc_id"], r["source"])] for r in b).values()) == 1


def test_packing(spark, rows):
    df = frame(spark, rows)
    for capacity, per_source, group in ((300, 2, 8192), (64, 1, 20)):
        got = packing.best_fit_packing(df, capacity=capacity, per_source=per_source, group_rows=group).collect()
        check_packing(rows, got, capacity, per_source)
    assert packing.best_fit_packing(empty(spark)).count() == 0


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = np.random.default_rng(6)
    for _ in range(20):
        n = 120
        sizes = sorted(rng.integers(1, 60, n).tolist(), reverse=True)
        sources, clusters = rng.integers(0, 4, n).tolist(), rng.integers(-1, 12, n).tolist()
        got = packing.best_fit(sizes, sources, clusters, 100, 2)
        bins = []
        for k in range(n):
            fits = [(100 - sum(sizes[j] for j in b), x) for x, b in enumerate(bins)
                    if sum(sizes[j] for j in b) + sizes[k] <= 100 and sum(sources[j] == sources[k] for j in b) < 2
                    and not any(clusters[j] == clusters[k] >= 0 for j in b)]
            if fits:
                room = min(fits)[0]
                assert (room, got[k]) in fits
            else:
                assert got[k] == len(bins)
                bins.append([])
            bins[got[k]].append(k)


# --- language model -------------------------------------------------------------------

def brute_lm(rows, order, mu):
    seqs = [["^ "] + words(t, lower=True) + [" $"] for _, t, *_ in rows]
    held = [i is not None and crc(i) % 10 == 0 for i, *_ in rows]
    c = [Counter() for _ in range(order)]
    for s, out in zip(seqs, held):
        if not out:
            for k in range(order):
                c[k].update(tuple(s[j:j + k + 1]) for j in range(len(s) - k))
    uni = Counter({g: x for g, x in c[0].items() if g != ("^ ",)})
    total, types = sum(uni.values()), len(uni)

    def p(gram):
        w = gram[-1:]
        if len(gram) == 1:
            return (uni[w] + 0.1) / (total + 0.1 * (types + 1))
        h = gram[:-1]
        low = p(gram[1:])
        n = c[len(h) - 1][h]
        return (c[len(gram) - 1][gram] + mu * low) / (n + mu)
    out = []
    for (i, *_), s, x in zip(rows, seqs, held):
        base = sum(math.log10(p((w,))) for w in s[1:])
        score = sum(math.log10(p(tuple(s[max(0, j - order + 1):j + 1]))) for j in range(1, len(s)))
        out.append((i, x, len(s) - 1, sum(uni[(w,)] > 0 for w in s[1:]), total, round(base, 5), round(score, 5)))
    return out


@pytest.mark.parametrize("order", [2, 3])
def test_lm(spark, rows, order):
    got = lm.score_texts(frame(spark, rows), order=order, mu=3.0, block_chars=9000).collect()
    near = Counter((*r[:5], round(r["base_score"], 5), round(r["score"], 5)) for r in got)
    assert near == Counter(brute_lm(rows, order, 3.0))
    assert lm.score_texts(empty(spark)).count() == 0
