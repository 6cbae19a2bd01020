"""Token files against encoding every whole text and reading the files plainly."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shardforge.llm import token_files
from tests.conftest import SF_SMALL
from tests.llm.util import corpus, empty, frame

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")

AWKWARD = ["", " ", "<|endoftext|>", "a<|endoftext|>b <|startoftext|>", "don't  DON'T 've\tit's", "é é ́x", " nbsp em \x85nel",
           "ΣΑΣ Σ ΟΔΟΣ", "İstanbul ǅ ß ẞ", "漢字かな 한국어 한", "😀👨‍👩‍👧 x\x00y", "a\x0bb\x0cc\rd", "1234 5.6e7 #$%&*|", "x" * 5000, "a.b,c!d", "A.́ Á. x̂.", "'t.s 's,'T!", "<|EndOfText|> <|endoftext|>. a<.B", "U.S.A. e.g. ...", "̀́ ̣"]


def whole(texts, end=2):
    t = Tokenizer.from_file(PATH)
    return [t.encode(x or "", add_special_tokens=False).ids + [end] for x in texts]


def test_words_equal_whole_texts(spark):
    rng = random.Random(1)
    alphabet = "aBzT.,!?;: 'sé́̈ñΣσ漢‍ \n\t1٣!<|>İ하"
    texts = AWKWARD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    want = whole(texts)
    for kw in ({}, {"remember": 50}, {"marks": ".,;:!?", "fold_case": True}, {"marks": "!", "joined": 3}):
        enc = token_files.WordEncoder(PATH, 2, **kw)
        for lo in range(0, len(texts), 1000):
            ids, offs = enc.encode(pa.array(texts[lo:lo + 1000], pa.large_string()).fill_null(""))
            assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == want[lo:lo + 1000]
    ids, offs = token_files.WordEncoder(PATH, 2, across_spaces=True).encode(pa.array([t or "" for t in texts], pa.large_string()))
    assert [ids[a:b].tolist() for a, b in zip(offs, offs[1:])] == want


def expected(rows):
    """(id, start, length, crc) of all rows in ascending id order."""
    ids = whole([r[1] for r in rows])
    groups = {}
    for r, x in zip(rows, ids):
        groups.setdefault(r[0], []).append(x)
    out, start = [], 0
    for key in sorted(groups, key=lambda k: (k is not None, k or 0)):
        for x in groups[key]:
            out.append((key, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
            start += len(x)
    return out, start


def check(have, rows):
    want, total = expected(rows)
    assert sorted(((r["id"], r["n_tokens"], zlib.crc32(bytes(r["ids"]))) for r in have), key=str) == sorted(want, key=str)
    pos = 0
    for r in sorted(have, key=lambda r: r["start"]):
        assert r["start"] == pos
        pos += r["n_tokens"]
    keys = [r["id"] for r in sorted(have, key=lambda r: r["start"])]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and pos == total


def test_round_trip(spark, tmp_path):
    rows = corpus() + [(9000 + i, t, "en", None, 1) for i, t in enumerate(AWKWARD)]
    rows += [(5, f"hot id {i}", "en", None, 1) for i in range(300)] + [(6, "equal rows", "en", None, 1)] * 300
    files = token_files.write_token_files(frame(spark, rows), str(tmp_path / "ids"), PATH, 2, bucket_keys=25)
    docs = frame(spark, rows)
    check(token_files.read_by_key(files, docs).collect(), rows)
    # the format: raw ids and offsets, shard after shard
    m, store = files.manifest, files.store
    assert m["width"] == 2 and m["buckets"] > 3 and len(m["shards"]) > 2
    raw = b"".join(store.read(s["stem"] + ".bin") for s in m["shards"])
    assert len(raw) == 2 * m["ids"] and sum(s["docs"] for s in m["shards"]) == len(rows)
    # the hot id is split over shards, single keys are found without Spark, strangers aren't
    again = token_files.TokenFiles.load(spark, str(tmp_path / "ids"))
    assert len(again.find(5)) == 301 and len(again.find(None)) == 1 and again.find(77777) == []
    assert again.find(3001)[0].tolist() == [2]
    strangers = spark.createDataFrame([(77777,), (3005,), (3005,)], "doc_id bigint")
    assert [r["id"] for r in token_files.read_by_key(again, strangers).collect()] == [3005]


def test_index_misses(spark):
    """Strangers that land on a slot are told apart by the fingerprint."""
    rng = np.random.default_rng(1)
    digests = rng.integers(0, 256, (500, 32), np.uint8)
    mph = token_files.PerfectHash(digests)
    assert sorted(mph.slots(digests)) == list(range(500))
    strangers = rng.integers(0, 256, (5000, 32), np.uint8)
    assert (mph.slots(strangers) >= 0).sum() > 1000


def test_empty(spark, tmp_path):
    files = token_files.write_token_files(empty(spark), str(tmp_path / "none"), PATH, 2)
    assert files.manifest["docs"] == 0 and token_files.read_by_key(files, empty(spark)).count() == 0 and files.find(1) == []
    only_null = frame(spark, [(None, None, None, None, None)])
    files = token_files.write_token_files(only_null, str(tmp_path / "one"), PATH, 2)
    assert [(r["id"], r["start"], r["n_tokens"]) for r in token_files.read_by_key(files, only_null).collect()] == [(None, 0, 1)]


def test_known_pieces_are_not_encoded_again():
    """Pieces that are remembered don't count against the bound once more."""
    rng = random.Random(2)
    texts = pa.array([" ".join("".join(rng.choice("bcdfgh") for _ in range(9)) for _ in range(40))] * 3, pa.large_string())
    enc = token_files.WordEncoder(PATH, 2, remember=50)
    first = enc.encode(texts)
    learned = []
    enc._learn = lambda pieces, *_: learned.extend(pieces)
    again = enc.encode(texts)
    assert not learned and all((a == b).all() for a, b in zip(first, again))
    assert [first[0][a:b].tolist() for a, b in zip(first[1], first[1][1:])] == whole(texts.to_pylist())
