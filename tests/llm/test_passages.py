"""Repeated passages inside foreign text (op6)."""

import random

from pyspark.sql import functions as F

from shardforge.llm import linededup
from tests.llm.util import VOCAB, frame, sentence


def cleaned(spark, rows):
    out = linededup.line_dedup(frame(spark, rows)).select("doc_id", "text").collect()
    return {r["doc_id"]: r["text"] for r in out}


def planted(lo, hi, join, seed=9, n=30):
    """Passages of lo to hi words, each in three foreign texts: (rows, passages)."""
    rng = random.Random(seed)
    rows, found = [], []
    for k in range(n):
        size, units = rng.randint(lo, hi), []
        while size:
            w = min(size, rng.randint(5, 20))
            units.append(" ".join(f"{rng.choice(VOCAB)}{rng.randint(0, 99)}" for _ in range(w)) + ".")
            size -= w
        found.append(units)
        for c in range(3):
            around = [" ".join(f"{rng.choice(VOCAB)}{rng.randint(0, 99)}" for _ in range(rng.randint(4, 15))) + "." for _ in range(10)]
            at = rng.randint(1, 9)
            rows.append((3 * k + c, join.join(around[:at] + units + around[at:]), "en", "s", None))
    return rows, found


def test_passage_between_foreign_units_goes_whole(spark):
    for join in ("\n", " "):
        for lo, hi in ((51, 60), (61, 80), (150, 250)):
            rows, found = planted(lo, hi, join)
            out = cleaned(spark, rows)
            for k, units in enumerate(found):
                assert out[3 * k] == rows[3 * k][1]
                assert not any(u in out[3 * k + c] for c in (1, 2) for u in units)
                assert all(len(rows[3 * k + c][1]) - len(out[3 * k + c]) <= len(join.join(units)) + 1 for c in (1, 2))


def test_short_lines_count_as_one_run(spark):
    """Nine lines of two words, each pair under 50 characters."""
    rng = random.Random(3)
    lines = [f"{VOCAB[k + 5]} q{k}" for k in range(9)]
    rows = [(i, "\n".join([sentence(rng)] + lines + [sentence(rng)]), "en", "s", None) for i in range(3)]
    out = cleaned(spark, rows)
    assert out[0] == rows[0][1] and all(x not in out[i] for i in (1, 2) for x in lines)


def test_one_unit_passages(spark):
    """Words without punctuation: a line of their own, inside a foreign line,
    few different words, and a script without blanks."""
    rng = random.Random(5)
    def some(n):
        return [f"{rng.choice(VOCAB)}{rng.randint(0, 99)}" for _ in range(n)]
    rows, words, lines = [], [], []
    for k in range(20):
        words.append(some(60))
        lines.append(" ".join(some(60)))
        rows += [(2 * k + c, " ".join(some(20) + words[k] + some(20)) + "\n" + " ".join(some(9)) + "\n" + lines[k] + "\n" + " ".join(some(9)), "en", "s", None) for c in (0, 1)]
    han = "".join(chr(0x4E00 + rng.randint(0, 3000)) for _ in range(120))
    rows += [(100 + c, " ".join(some(9)) + "\n" + han + "\n" + " ".join(some(9)), "zh", "s", None) for c in (0, 1)]
    beat = " ".join(["la", "di", "da"] * 20)
    rows += [(200 + c, " ".join(some(9)) + "\n" + beat + "\n" + " ".join(some(9)), "en", "s", None) for c in (0, 1)]
    common = " ".join(some(12))
    rows += [(300 + c, " ".join(some(9) + [common] + some(9)), "en", "s", None) for c in (0, 1)]
    out = cleaned(spark, rows)
    left = []
    for k in range(20):
        assert out[2 * k] == rows[2 * k][1] and lines[k] not in out[2 * k + 1]
        got = out[2 * k + 1].split()
        assert len(got) >= 58
        left.append(sum(a + " " + b in out[2 * k + 1] for a, b in zip(words[k], words[k][1:])))
        assert set(lines[k].split()) - set(got) != set()
    assert max(left) <= 30 and sum(left) / 20 <= 14
    assert han in out[100] and han not in out[101] and len(out[101]) < len(out[100]) - 110
    # the beat repeats inside itself, so its first beats stay
    assert "la di da" in out[200] and "la di" not in out[201]
    assert all(out[300 + c] == rows[-2 + c][1] for c in (0, 1))


def test_cuts_equal_the_plain_patterns(spark):
    """Parts, tokens and bare lines against the patterns as one would say them."""
    rng = random.Random(11)
    odd = linededup.ODD
    alphabet = "aabceAB13,;: \t\n\r.!? é漢😀ไ　\x0b"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 80))) for _ in range(4000)]
    texts += ["", " ", "a ", "\t", "a\n", "a\n ", "a \t", "\na", "a a", "a, a", "a,, a", "  a a", ", a", "漢字 a", "x\r\n", "a\x0b "]
    x = F.col("x")
    plain_parts = F.filter(F.regexp_extract_all("x", F.lit(rf"(?s).*?(?:{odd}[,;:]? (?={odd})|\z)"), F.lit(0)), lambda u: u != "")
    df = spark.createDataFrame([(t,) for t in texts], "x string").select(
        "x", linededup._matches(x, linededup.PART).alias("parts"), plain_parts.alias("plain_parts"),
        linededup._matches(x, linededup.TOKENS).alias("tokens"),
        F.filter(F.split("x", rf"(?<={linededup.TOKEN_END})(?=\S)", -1), lambda u: u != "").alias("plain_tokens"),
        linededup._bare(x).alias("bare"), F.btrim("x", F.lit(linededup.BLANK)).alias("plain_bare"))
    for r in df.collect():
        assert r["parts"] == r["plain_parts"] and r["tokens"] == r["plain_tokens"] and r["bare"] == r["plain_bare"], r["x"]


def test_places_and_texts_are_not_sorted(spark):
    """Places are aggregated as numbers, by hash; texts aren't sorted for the
    comparison of bytes, which keeps one row of each line."""
    rng = random.Random(12)
    passage = "\n".join(sentence(rng) for _ in range(9))
    rows = [(i, f"{sentence(rng)}\n{passage}\n{sentence(rng)}", "en", "s", None) for i in range(40)]
    texts, hashes = linededup.tables(frame(spark, rows), "doc_id", "text")
    found = linededup.later_pairs(hashes)
    plan = linededup.unequal_lines(texts, found)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "SortMergeJoin" not in plan and "HashAggregate" in plan
    chunks, bits = linededup.numbered(linededup.chunk_rows(hashes).groupBy("_id", "_th").agg(F.collect_set("i").alias("found")), hashes)
    pairs = linededup.pair_rows(hashes, chunks, bits)
    assert {t for c, t in pairs.dtypes} == {"bigint"}
    last = pairs.agg(F.max("place")).first()[0]
    assert last >> bits == chunks.agg(F.max("doc")).first()[0] and pairs.select("place").distinct().count() == pairs.count()


def test_repeated_and_null_ids_keep_the_first_place(spark):
    """Of equal ids, the first is told by the text's hash, then by position."""
    rng = random.Random(13)
    passage = "\n".join(sentence(rng) for _ in range(9)) + "\n"
    texts = [sentence(rng) + "\n" + passage + sentence(rng) + "\n" + passage for _ in range(4)]
    rows = [(i, t, "en", "s", None) for i in (None, 7) for t in texts + texts[:1]]
    out = linededup.line_dedup(frame(spark, rows)).select("doc_id", "text").collect()
    assert len(out) == len(rows)
    kept = {(r["doc_id"], r["text"]) for r in out if passage[:-1] in r["text"]}
    assert len(kept) == 1 and next(iter(kept))[0] is None and next(iter(kept))[1].count(passage[:-1]) == 1


def test_pairs_come_from_generated_code(spark):
    """The pairs beside repeated chunks, and the lines compared byte by byte,
    hold no lambda and no set of positions, which Spark would interpret, and
    are computed once: no filter in front of an explode repeats them."""
    rng = random.Random(14)
    passage = "\n".join(sentence(rng) for _ in range(9))
    rows = [(i, f"{sentence(rng)}\n{passage}\n{sentence(rng)}", "en", "s", None) for i in range(40)]
    texts, hashes = linededup.tables(frame(spark, rows), "doc_id", "text")
    chunks, bits = linededup.numbered(linededup.chunk_rows(hashes).groupBy("_id", "_th").agg(F.collect_set("i").alias("found")), hashes)
    pairs = linededup.pair_rows(hashes, chunks, bits)
    lines = linededup.unequal_lines(texts, linededup.later_pairs(hashes))
    for df in (pairs, lines):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("lambda", "array_distinct", "array_union") if x in plan], plan


def test_pairs_beside_any_chunks(spark):
    """Stretches beside listed chunks, merged in order, are the set of all."""
    rng = random.Random(15)
    rows = [(i, "\n".join(sentence(rng) for _ in range(rng.randint(2, 40))), "en", "s", None) for i in range(60)]
    _, hashes = linededup.tables(frame(spark, rows), "doc_id", "text")
    some = F.filter(F.sequence(F.lit(0), F.size("b") - 1), lambda i: (F.xxhash64("_th", i) % 3) != 0)
    listed = hashes.select("_id", "_th", F.reverse(some).alias("found")).where(F.size("found") > 0)
    chunks, bits = linededup.numbered(listed, hashes)
    got = sorted(r["place"] for r in linededup.pair_rows(hashes, chunks, bits).collect())
    want = []
    for r in hashes.join(chunks, ["_id", "_th"]).collect():
        near, b = set(), r["b"]
        for k in r["found"]:
            near |= set(range(b[k - 1] if k else 0, (b[k + 1] if k + 1 < len(b) else b[k]) + 1))
        want += [(r["doc"] << bits) + s for s in near]
    assert got == sorted(want) and len(got) > 100


def test_hashes_of_lines_with_any_blanks(spark):
    """Lines with tabs, carriage returns and leading blanks are hashed bare, as
    are the tokens of long ones; the lines give the text back."""
    rng = random.Random(16)
    rows = [(i, "".join(rng.choice(["ab", "c", "Z9", " ", " ", "  ", "\n", ". ", "\n "] + ["\t", "\r", "\r\n"] * (i % 2)) for _ in range(300)), "en", "s", None)
            for i in range(60)] + [(90, "x " * 400, "en", "s", None), (91, "x\t" * 400, "en", "s", None), (92, "", "en", "s", None)]
    given = {r[0]: r[1] for r in rows}
    texts, hashes = linededup.tables(frame(spark, rows), "doc_id", "text")
    of = {r["_id"]: r["h"] for r in hashes.collect()}
    plain = texts.select("_id", F.array_join("u", "").alias("t"), F.transform("u", lambda u: F.xxhash64(F.btrim(u, F.lit(linededup.BLANK)))).alias("h"))
    for r in plain.collect():
        assert r["t"] == given[r["_id"]]
        assert r["_id"] not in of or of[r["_id"]] == r["h"]
    assert len(of) > 60
