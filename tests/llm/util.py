"""Small tables with every awkward case, and brute-force helpers."""

import random
import re

from pyspark.sql import functions as F

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# names that the operators use inside
CLASH = ["n", "sid", "cell", "block", "size", "copies", "label", "score", "kept", "u", "h", "c", "a", "b", "_id", "_th", "comp", "host", "tie", "row"]


def words(text, lower=False):
    text = text or ""
    if lower:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return WORDS.findall(text)


def sentence(rng, n=10):
    return " ".join(rng.choice(VOCAB) for _ in range(n)).capitalize() + "."


VOCAB = ["the", "of", "and"] + ["".join(p) for p in zip("abcdefghijklmnop" * 8, "aeiou" * 26, "rstlnkm" * 19, "oaeiu" * 26)]


def corpus(seed=1, n=80):
    """Awkward rows: null and empty texts, null keys, repeated rows, exact and
    near copies, shared passages, a hot source, one very long text."""
    rng = random.Random(seed)
    passage = "\n".join(sentence(rng, 12) for _ in range(8))
    rows = []
    for i in range(n):
        body = [sentence(rng, rng.randint(3, 14)) for _ in range(rng.randint(1, 9))]
        if i % 5 == 0:
            body.insert(rng.randint(0, len(body)), passage)
        rows.append((i, "\n".join(body), rng.choice(["en", "de", None]), "hot" if i % 3 == 0 else f"s{i % 7}", None))
    base = " ".join(rng.choice(VOCAB) for _ in range(200))
    for k in range(12):    # near copies of one text
        w = base.split()
        w[k * 3] = "changed"
        rows.append((1000 + k, " ".join(w), "en", "hot", None))
    rows += [(2000 + k, rows[3][1], "en", "hot", None) for k in range(9)]     # exact copies
    rows += [(3000, None, "en", "hot", None), (3001, "", "en", None, None), (3002, " \n\t ", None, "s1", None),
             (3003, "One", "en", "s1", None), (3004, "one", "en", "s1", None), (None, "no id here at all", "en", "s2", None),
             (3005, "Ünïcode ßtraße 漢字 emoji 😀 fin", "de", "s2", None),
             (3006, " ".join(rng.choice(VOCAB) for _ in range(30000)), "en", "s3", None),
             (3007, "x" * 70000, "en", "s3", None)]
    rows += [rows[0], rows[0], rows[7]]                                       # repeated rows
    return [(a, b, c, d, len(b) if b is not None else None) for a, b, c, d, _ in rows]


def frame(spark, rows, extra=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    if extra:
        df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASH)])
    return df


def empty(spark):
    return frame(spark, [])
