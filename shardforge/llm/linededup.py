"""Line dedup with content-defined chunks of lines.

A text is cut into lines: at newlines, behind sentence ends, and, where such a
line is long, further at gaps between words that the words beside them choose.
The lines joined are the text again. A rolling hash over two neighbouring line
hashes belongs to each gap between lines; a gap whose hash is not above the
next one's is a boundary, and the two lines at a boundary are a chunk. Whether
a gap is one hangs on three lines only, so a passage that was moved or put into
foreign text gets the same boundaries again, but for its last gap, and any
repeated run of a few lines holds one.

Over the whole table:

1. Chunk hashes that occur more than once are found by partial aggregation and
   brought back to their documents. Between the boundaries beside a repeated
   chunk, and only there, every two neighbouring lines count from now on.
2. Neighbouring lines with an earlier place, by (id, text hash, position),
   cover their two lines. Lines that are covered, and lines at the earlier
   places, are compared byte by byte (blanks around a line aside): all texts of
   one line hash must be equal, else nothing that holds this hash is removed.
3. Each run of covered lines goes as a whole, if it is a passage: at least
   ``min_chars`` characters, and two whole lines or sentences or ``min_tokens``
   words. These two say what counts as a passage; with 0 every repeated run of
   two lines goes. Each removed line stands at an earlier place too.

The texts move once, into a table bucketed by document, and so are their line
hashes; every later step reads them in place, and only hashes, positions and the texts of repeated lines move. A
hot chunk is one row per map task in the aggregations, and its places meet one
row in joins that the adaptive skew join can split. All steps are DataFrame
functions.

Defined results: null or empty text is returned as it is; rows repeated with
the same id and text are one document for the comparison and get the same
result; a null id sorts first; an empty table gives an empty result. Other
columns pass through; columns of the input named ``_n_units`` or ``_removed``
are replaced by the result's."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardforge.functions.vectors import let
from shardforge.llm.common import held, text_or_empty, written
from shardforge.session import checkpoint_dir, estimated_bytes, shuffles_freed

BLANK = " \n\t\r"
# a line ends with a newline, or with a sentence mark and a space
LINE = r"[^\n.!?]*+(?:[.!?]++(?![ \n])[^\n.!?]*+)*+(?:[.!?]*+(?:\n|(?<=[.!?]) )|[.!?]*+\z)"
# words whose last letter and next first letter are of this class part a long line
ODD = "[acegikmoqsuwyACEGIKMOQSUWY13579]"
PART = rf"[^ ]*+(?: (?!(?={ODD})(?<={ODD}[,;:]? ))[^ ]*+)*+(?: |\z)"
# a token ends after blanks, or is one character of a script without blanks
TOKEN_END = r"[ \t฀-໿က-႟ក-៿⺀-￿\x{10000}-\x{10FFFF}]"
TOKENS = rf"(?:[^{TOKEN_END[1:]}++|{TOKEN_END}(?!\S))*+(?:{TOKEN_END}(?=\S)|\z)"
LONG_BYTES, LONG = 160, 8


def _bare(u: Column) -> Column:
    """Without blanks around it. Spark's ``btrim`` with characters is slow, so
    it is left to texts that need more than spaces cut off behind."""
    r = F.rtrim(u)
    other = (F.ascii(u) <= 32) | r.endswith("\n") | r.endswith("\t") | r.endswith("\r")
    return F.when(other, F.btrim(u, F.lit(BLANK))).otherwise(r)


def _bare_unit(u: Column) -> Column:
    """``_bare`` of a line of ``fine_units`` without tabs and carriage returns:
    a newline is its last character. Lambdas compute what they name each time
    they name it, so one cut instead of four counts."""
    return F.when((u < "!") | u.endswith("\n"), F.btrim(u, F.lit(BLANK))).otherwise(F.rtrim(u))


def _blanks(text: Column) -> Column:
    """Whether a text holds blanks that ``_bare_unit`` doesn't know."""
    return F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r"))


def _bound(value: Column, fn) -> Column:
    """``let`` for arrays of lines: ``transform`` copies each line of a result,
    ``aggregate`` doesn't."""
    return F.aggregate(F.array(value), F.array().cast("array<string>"), lambda _, v: fn(v))


def _span(arr: Column, s: Column, e: Column) -> Column:
    return F.slice(arr, s + 1, e - s)


def _long(unit: Column) -> Column:
    return F.octet_length(unit) > LONG_BYTES


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?!\z){pattern}"), F.lit(0))     # no empty match at the end


def _parts(unit: Column) -> Column:
    """A long line, cut where letters of one class meet across a blank (pieces
    of about five words)."""
    return F.when(~_long(unit), F.array(unit)).otherwise(_matches(unit, PART))


def _pieces(unit: Column) -> Column:
    """A long piece, cut at the gaps whose hash of the tokens beside them is
    the least of five in a row. The smallest hash of a stretch always cuts, so
    periodic text is cut too; pieces have about five tokens."""
    def cut(t):
        n = F.size(t)

        def by_hash(g):
            def behind_least(x, i):
                less = [F.coalesce(F.get(g, i + k) < x, F.lit(False)) for k in (-1, 1, -2, 2)]
                return F.when(~(less[0] | less[1] | less[2] | less[3]), i + 1)
            low = F.array_compact(F.transform(g, behind_least))
            return _bound(F.concat(F.array(F.lit(0)), low), lambda b: F.zip_with(
                b, F.concat(F.slice(b, 2, F.size(b)), F.array(n)), lambda s, e: F.array_join(_span(t, s, e), "")))
        bare = F.when(_blanks(unit), F.transform(t, _bare)).otherwise(F.transform(t, _bare_unit))
        return F.when(n <= LONG, F.array(unit)).otherwise(_bound(let(bare, _gaps), by_hash))
    return F.when(~_long(unit), F.array(unit)).otherwise(_bound(_matches(unit, TOKENS), cut))


def fine_units(text: Column) -> Column:
    """The lines of a text, the long ones cut further between words, and what
    is still long by hashes."""
    def finer(units, cut):
        return _bound(units, lambda u: F.when(F.exists(u, _long), cut(u)).otherwise(u))
    return finer(_matches(text, LINE), lambda u: finer(F.flatten(F.transform(u, _parts)), lambda p: F.flatten(F.transform(p, _pieces))))


# --- tables ------------------------------------------------------------------


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = text_or_empty(F.col(f"`{text_col}`"))
    rest = [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns) if c != text_col]
    return docs.select(
        *rest, F.col(f"`{text_col}`").cast("string").alias("_text"),
        F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(text).alias("_th"))


KEYS = ["_id", "_th"]


def bucketed(df: DataFrame, n: int) -> DataFrame:
    """``df`` as a table of the shared folder in ``n`` buckets of documents:
    joins and groups by document read it without a shuffle."""
    spark = df.sparkSession
    name = f"line_dedup_{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        # lines and hashes hardly repeat, so Parquet's dictionaries of them cost time only; zstd's level 1 takes half
        # the time of its usual one and leaves an eighth more
        (df.write.bucketBy(n, *KEYS).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1")
         .options(**{f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("u", "h")})
         .option("path", f"{checkpoint_dir(spark).rstrip('/')}/llm/{name}").saveAsTable(name))
    return spark.table(name)


def tables(docs: DataFrame, id_col: str, text_col: str, bucket_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """The lines of each text (u) and their hashes, in buckets. The texts move
    once and are cut once; ``_text`` stays where its lines don't give it back
    (bytes that aren't UTF-8)."""
    keyed = _keyed(docs, id_col, text_col)
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), estimated_bytes(keyed) // bucket_bytes)
    cut = held(keyed.repartition(n, *KEYS), "u", fine_units(F.col("_text")))
    odd = F.when(F.array_join("u", "") != F.col("_text"), F.col("_text"))
    hashed = held(cut, "h", F.when(_blanks(F.col("_text")), F.transform("u", lambda u: F.xxhash64(_bare(u)))).otherwise(
        F.transform("u", lambda u: F.xxhash64(_bare_unit(u))))).withColumn("_text", odd)
    texts = bucketed(hashed.withColumn("b", F.when(F.size("h") > 1, let(_gaps(F.col("h")), boundaries))), n)
    return texts.drop("h", "b"), texts.select("_id", "_th", "h", "b").where(F.size("h") > 1)


def _gap(h: Column, i: Column) -> Column:
    """The rolling hash of the gap behind line ``i``."""
    return F.xxhash64(F.get(h, i), F.get(h, i + 1))


def _gaps(h: Column) -> Column:
    return F.transform(F.slice(h, 1, F.size(h) - 1), lambda x, i: F.xxhash64(x, F.get(h, i + 1)))


def boundaries(g: Column) -> Column:
    """The gaps whose hash isn't above the next one's (the last gap is one)."""
    return F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i) <= F.coalesce(F.get(g, i + 1), F.lit((1 << 63) - 1)))


def chunk_rows(hashes: DataFrame) -> DataFrame:
    """_id, _th, i, ch: each chunk, at boundary ``i``."""
    rows = hashes.select("_id", "_th", "h", F.posexplode("b").alias("i", "s"))
    return rows.select("_id", "_th", "i", _gap(F.col("h"), F.col("s")).alias("ch"))


def numbered(listed: DataFrame, hashes: DataFrame) -> tuple[DataFrame, int]:
    """``listed`` and a number ``doc`` of each document, ascending with (id,
    text hash); the number of bits to leave for positions behind it."""
    rows = listed.withColumn("found", F.sort_array("found")).repartitionByRange(*KEYS).sortWithinPartitions(*KEYS)
    rows = written(rows.withColumn("doc", F.monotonically_increasing_id()))     # partition, then 33 bits
    part, row = F.shiftright("doc", 33), F.col("doc").bitwiseAND((1 << 33) - 1)
    with shuffles_freed(rows.sparkSession):
        top = rows.agg(F.max(part).alias("part"), F.max(row).alias("row")).first()
        bits = (hashes.agg(F.max(F.element_at("b", -1)).alias("s")).first()["s"] or 0).bit_length()
    of_row = (top["row"] or 0).bit_length()
    if (top["part"] or 0).bit_length() + of_row + bits > 63:
        raise ValueError("places of lines need more than 63 bits")
    return rows.withColumn("doc", F.shiftleft(part, of_row) + row), bits


def pair_rows(hashes: DataFrame, chunks: DataFrame, bits: int) -> DataFrame:
    """place (doc and s), ch, a, b: all neighbouring lines s, s + 1 (hashes a,
    b) between the boundaries beside the chunks ``found`` that ``chunks`` lists
    for a document, in ascending order (or the first and last gap); repeated
    documents repeat them. Each stretch begins behind the one before. All of it
    is generated code; outer explodes spare a filter that computes them again."""
    b, h, s, k, i = F.col("b"), F.col("h"), F.col("s"), F.col("k"), F.col("i")
    rows = hashes.join(chunks.hint("shuffle_hash"), KEYS).select("doc", "h", "b", "found", F.posexplode_outer("found").alias("k", "i"))
    last = F.when(k > 0, F.get(b, F.get("found", k - 1) + 1)).otherwise(-1)
    rows = rows.select("doc", "h", F.greatest(F.when(i > 0, F.get(b, i - 1)).otherwise(0), last + 1).alias("start"),
                       F.coalesce(F.get(b, i + 1), F.get(b, i)).alias("end")).where("start <= end")
    rows = rows.select("doc", "h", F.explode_outer(F.sequence("start", "end")).alias("s"))
    return rows.select((F.shiftleft("doc", bits) + s).alias("place"), _gap(h, s).alias("ch"), F.get(h, s).alias("a"), F.get(h, s + 1).alias("b"))


def later_pairs(hashes: DataFrame) -> DataFrame:
    """_id, _th, at: the pairs of each document that stand at an earlier place
    too, ascending, before the comparison of bytes; from: the earlier places. A place is
    one number, so that Spark aggregates it by hash instead of sorting."""
    chunks = chunk_rows(hashes)
    often = chunks.groupBy("ch").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("ch")
    listed, bits = numbered(chunks.join(often.hint("shuffle_hash"), "ch").groupBy(*KEYS).agg(F.collect_set("i").alias("found")), hashes)
    pairs = pair_rows(hashes, listed, bits)
    first = (pairs.groupBy("ch").agg(F.min("place").alias("w"), F.max("place").alias("z"), F.min("a").alias("a0"), F.max("a").alias("a1"),
                                     F.min("b").alias("b0"), F.max("b").alias("b1"))
             .where("w <> z and a0 = a1 and b0 = b1").select("ch", "w"))
    first = written(first)
    s, own = F.col("place").bitwiseAND((1 << bits) - 1).cast("int"), F.col("place") == F.col("w")
    places = (pairs.select("place", "ch").join(first.hint("shuffle_hash"), "ch").groupBy(F.shiftright("place", bits).alias("doc"))
              .agg(F.sort_array(F.collect_set(F.when(~own, s))).alias("at"), F.collect_set(F.when(own, s)).alias("from")))
    return written(listed.select("doc", *KEYS).join(places, "doc").select(*KEYS, "at", "from"))


def unequal_lines(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Line hashes that stand for different texts among the given places."""
    places = found.select(*KEYS, F.sort_array(F.concat("at", "from")).alias("at")).hint("shuffle_hash")
    a = texts.where("u is not null").select("_id", "_th", "u").join(places, KEYS)
    a = a.select("u", "at", F.posexplode_outer("at").alias("k", "p"))
    both = F.col("p") + F.when(F.get("at", F.col("k") + 1) == F.col("p") + 1, 0).otherwise(1)     # the next place has its second line
    line = _bare(F.get("u", F.col("s")))
    rows = a.select("u", F.explode_outer(F.sequence("p", both)).alias("s")).select(F.xxhash64(line).alias("h"), line.alias("line")).distinct()
    return rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h")


def _ends(unit: Column) -> Column:
    return unit.endswith("\n") | unit.endswith(". ") | unit.endswith("! ") | unit.endswith("? ")


def _counts(u: Column, run: Column, min_chars: int, min_tokens: int) -> Column:
    """Whether the run of lines (s, e) is a passage."""
    text = F.array_join(_span(u, run["s"], run["e"]), "")
    ends = F.size(F.filter(F.slice(u, F.greatest(run["s"], F.lit(1)), run["e"] - F.greatest(run["s"] - 1, F.lit(0))), _ends))
    edges = ends + (run["s"] == 0).cast("int") + ((run["e"] == F.size(u)) & ~_ends(F.get(u, run["e"] - 1))).cast("int")
    return (F.length(text) >= min_chars) & ((edges > 2) | (F.size(_matches(text, TOKENS)) >= min_tokens))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 50, min_tokens: int = 25) -> DataFrame:
    """Each row as given, its text without repeated passages, plus _n_units
    and _removed (positions in ``fine_units``)."""
    texts, hashes = tables(docs, id_col, text_col)
    found = later_pairs(hashes)
    bad = unequal_lines(texts, found).agg(F.collect_list("h").alias("bad"))     # hash collisions: a handful at most
    bad = set(bad.first()["bad"])
    at = found.where(F.size("at") > 0).select(*KEYS, "at")
    j = texts.join(at.hint("shuffle_hash"), KEYS, "left")
    s = F.col("at")
    if bad:
        wrong = F.array(*[F.lit(h) for h in sorted(bad)])
        s = F.filter(s, lambda i: ~F.array_contains(wrong, F.xxhash64(_bare(F.get("u", i)))) & ~F.array_contains(wrong, F.xxhash64(_bare(F.get("u", i + 1)))))
    begins = F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1) < x - 2, F.lit(True)))
    ends = F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1) > x + 2, F.lit(True)))
    runs = F.zip_with(begins, ends, lambda s, e: F.struct(s.alias("s"), (e + 2).alias("e")))
    j = held(j, "runs", F.filter(runs, lambda r: _counts(F.col("u"), r, min_chars, min_tokens)))
    before = F.transform("runs", lambda r, i: let(F.coalesce(F.get("runs", i - 1)["e"], F.lit(0)), lambda e: F.array_join(_span(F.col("u"), e, r["s"]), "")))
    behind = F.array_join(_span(F.col("u"), F.get("runs", F.size("runs") - 1)["e"], F.size("u")), "")
    text = F.when(F.coalesce(F.size("runs"), F.lit(0)) <= 0, F.coalesce("_text", F.array_join("u", ""))).otherwise(
        F.concat(F.array_join(before, ""), behind))
    removed = F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"] - 1)))
    new = {"_n_units": F.when(F.col("u").isNotNull(), F.size("u")).otherwise(0).cast("bigint"),
           "_removed": F.coalesce(removed, F.array().cast("array<int>"))}
    cols = [(text if c == text_col else F.col(f"_c{i}")).alias(c) for i, c in enumerate(docs.columns) if c not in new]
    return j.select(*cols, *[v.alias(c) for c, v in new.items()])
