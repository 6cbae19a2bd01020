"""The registered queries of the training-data operators and their oracles.
Each applies its operator, with production parameters, to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardforge.llm import chat, exact_dedup, filter_audit, fingerprints, jaccard, langid, linededup, lm, merkle, mixing, packing, quality, token_files
from shardforge.llm.common import ROW, bucket_of, documents, word_count
from shardforge.session import scratch_path, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def crc32_sql(value: str) -> str:
    """crc32 of a string of ASCII characters, bit by bit."""
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split({value}, ''), lambda c: [ascii(c)::BIGINT + 4294967296, -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda a, b: CASE WHEN b = -1 THEN CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END
                       ELSE xor(a, b - 4294967296) END))"""


@register("op1_chat_formatting", r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
r AS (SELECT *, coalesce(CAST(floor(turn / 256) AS BIGINT), -4611686018427387904) AS seg,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS k FROM t),
e AS (SELECT *, coalesce(length(role) || ':' || role, '-') || '|' || coalesce(length(text) || ':' || text, '-') || ';' AS enc FROM r),
p AS (SELECT conv_id, k, count(*) OVER (PARTITION BY conv_id) AS n,
        md5(string_agg(enc, '') OVER (PARTITION BY conv_id ORDER BY k)) AS h FROM e),
w AS (SELECT k AS n_turns, h, min(conv_id) AS conv_id, count(*) AS copies FROM p WHERE k = n GROUP BY k, h),
m AS (SELECT * FROM w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k = w.n_turns AND p.h = w.h AND p.k < p.n)),
s AS (SELECT e.conv_id, seg, count(*) AS turns,
        string_agg('<|im_start|>' || replace(coalesce(role, 'unknown'), '<|', '< |') || chr(10)
                   || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY k) AS text
      FROM e GROUP BY e.conv_id, seg)
SELECT s.conv_id, row_number() OVER (PARTITION BY s.conv_id ORDER BY seg) - 1 AS segment,
       count(*) OVER (PARTITION BY s.conv_id) AS n_segments, n_turns, copies, turns, s.text
FROM s JOIN m ON s.conv_id IS NOT DISTINCT FROM m.conv_id""")
def q_chat(spark, sf):
    return chat.format_chats(table(spark, sf, "conversations"))


@register("op2_quality_classifier")
def q_quality(spark, sf):
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    held = F.coalesce(bucket_of(F.col("doc_id"), 3) == 1, F.lit(False))
    scores = quality.quality_scores(docs, labels.where(~held).select("doc_id", "quality"))
    return scores.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op3_source_mixing", rf"""
WITH d AS (SELECT doc_id, source, len({SQL_WORDS.format("coalesce(text, '')")}) AS size,
             md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tie FROM documents),
c AS (SELECT *, CAST('0x' || substr(tie, 1, 4) AS INTEGER) % 4096 AS cell FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM c GROUP BY source),
w AS (SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1) AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
      FROM w WINDOW o AS (ORDER BY cap / w, source NULLS LAST)),
f AS (SELECT arg_min(level, (cap / w)) AS final FROM l WHERE level * w <= cap),
t AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), final * w) AS target,
        CAST('0x' || substr(md5('0|' || coalesce(source, '') || CASE WHEN source IS NULL THEN '|null' ELSE '' END), 1, 8) AS BIGINT) / 4294967296.0 AS u
      FROM l, f),
k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, cell, tie) AS rank FROM c)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, round(target, 6) AS target,
       CAST(CASE WHEN source_size > 0 THEN (floor(rank * (target / source_size) + u) - floor((rank - 1) * (target / source_size) + u)) * size ELSE 0 END AS BIGINT) AS taken
FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source""")
def q_mixing(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", word_count(F.col("text")).alias("words"))
    m = mixing.mix_sources(docs, size_col="words")
    return m.select(F.col(f"{ROW}.doc_id").alias("doc_id"), "size", "source_size", F.round("target", 6).alias("target"), "taken")


@register("op4_exact_dedup", f"""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 2 = 0 AS old FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size, bool_or(old) AS in_history FROM d GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256, in_history FROM d JOIN g USING (h)""")
def q_exact(spark, sf):
    docs = documents(spark, sf)
    return exact_dedup.dedup_rows(docs, exact_dedup.half_history())


@register("op5_fingerprints")
def q_fingerprints(spark, sf):
    return fingerprints.fingerprint_neighbours(documents(spark, sf))


@register("op6_line_dedup")
def q_lines(spark, sf):
    out = linededup.line_dedup(documents(spark, sf).select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_units").alias("n_units"), F.size("_removed").cast("bigint").alias("n_removed"),
                      F.col("_removed").alias("removed"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


_JACCARD_SQL = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {SQL_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS t FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(t) = 0 THEN []::VARCHAR[] WHEN len(t) < 4 THEN [array_to_string(t, ' ')]
        ELSE list_transform(range(1, len(t) - 2), lambda i: array_to_string(t[i:i + 3], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS m FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM i JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * m >= 85 * (p.n + q.n - m)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON l.x = r.doc_id WHERE r.c < l.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY 1, 2"""


@register("op7_jaccard_join", _JACCARD_SQL)
def q_jaccard(spark, sf):
    return jaccard.jaccard_components(documents(spark, sf))


@register("op8_best_fit_packing")
def q_packing(spark, sf):
    return packing.best_fit_packing(documents(spark, sf))


@register("op9_lm_scoring", rf"""
WITH d AS (SELECT doc_id, {crc32_sql("CAST(doc_id AS VARCHAR)")} % 10 = 0 AS held_out,
             list_append({SQL_WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}, ' ') AS t FROM documents),
o AS (SELECT doc_id, held_out, unnest(t) AS w, unnest(list_prepend('^ ', t)[1:len(t)]) AS h FROM d),
c AS (SELECT w, count(*) AS c FROM o WHERE NOT held_out GROUP BY w),
b AS (SELECT h, w, count(*) AS c FROM o WHERE NOT held_out GROUP BY h, w),
hc AS (SELECT h, sum(c) AS c FROM b GROUP BY h),
z AS (SELECT sum(c) AS n, sum(c) + 0.1::DOUBLE * (count(*) + 1) AS z FROM c),
x AS (SELECT o.doc_id, o.held_out, coalesce(c.c, 0) AS c, coalesce(b.c, 0) AS cb, coalesce(hc.c, 0) AS ch, z.n,
        (coalesce(c.c, 0) + 0.1::DOUBLE) / z.z AS p
      FROM o LEFT JOIN c ON c.w = o.w LEFT JOIN b ON b.h = o.h AND b.w = o.w LEFT JOIN hc ON hc.h = o.h, z)
SELECT doc_id, held_out, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, CAST(any_value(n) AS BIGINT) AS train_tokens,
       round(sum(log10(p)), 6) AS base_score, round(sum(log10((cb + 20.0::DOUBLE * p) / (ch + 20.0::DOUBLE))), 6) AS score
FROM x GROUP BY doc_id, held_out""")
def q_lm(spark, sf):
    s = lm.score_texts(documents(spark, sf))
    return s.withColumns({"base_score": F.round("base_score", 6), "score": F.round("score", 6)})


@register("op10_language_id")
def q_langid(spark, sf):
    docs, pages = documents(spark, sf), table(spark, sf, "pages")
    evidence = ["text", "declared", "suffix", "host", "domain"]
    d = langid.document_evidence(docs.select("doc_id", "text", "lang", "source")).select(
        F.col("doc.doc_id").alias("doc_id"), F.lit(None).cast("bigint").alias("page_id"), *evidence)
    p = langid.page_evidence(pages).select(F.lit(None).cast("bigint").alias("doc_id"), "page_id", *evidence)
    out = langid.identify(d.unionByName(p), docs.select("lang", "text"))
    return out.select(F.col(f"{ROW}.doc_id").alias("doc_id"), F.col(f"{ROW}.page_id").alias("page_id"),
                      F.col(f"{ROW}.declared").alias("declared"), "lang", "posterior", "kept")


def _merkle_sql(levels: int = 8, part_levels: int = 4) -> str:
    """Both trees level by level; a tree that has arrived at one node stays."""
    def tree(name: str, first: str, height: int) -> str:
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(height):
            out.append(f"{name}r{k} AS MATERIALIZED (SELECT part, pos // 8 AS run, list(d ORDER BY pos) AS ds, any_value(c) AS c FROM {name}{k} GROUP BY part, pos // 8)")
            out.append(f"{name}{k + 1} AS MATERIALIZED (SELECT part, run AS pos, CASE WHEN c = 1 THEN ds[1] ELSE sha256(array_to_string(ds, '')) END AS d, "
                       f"count(*) OVER (PARTITION BY part) AS c FROM {name}r{k})")
        return ",\n".join(out)

    def walk(name: str, runs: str, first: str, height: int) -> str:
        out = [f"{name}0 AS MATERIALIZED ({first})"]
        for k in range(height):
            rest = "list_concat({0}ds[p.pos % 8 + 2:])"
            out.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT p.* EXCLUDE (pos, cur, proof), p.pos // 8 AS pos,
                CASE WHEN c = 1 THEN cur ELSE sha256(array_to_string({rest.format("list_append(ds[1:p.pos % 8], cur), ")}, '')) END AS cur,
                CASE WHEN c = 1 THEN proof ELSE proof || array_to_string({rest.format("ds[1:p.pos % 8], ")}, '') END AS proof
                FROM {name}{k} p JOIN {runs}r{k} r ON r.part = p.part AND r.run = p.pos // 8)""")
        return ",\n".join(out)

    def leaf(text: str) -> str:
        enc = " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text))
        return f"sha256({enc})"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, lang, coalesce('=' || lang, '-') AS part, {leaf("text")} AS leaf,
       CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS cand,
       row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM documents),
{tree("a", "SELECT part, pos, leaf AS d, count(*) OVER (PARTITION BY part) AS c FROM t", levels)},
{tree("b", f"SELECT '' AS part, row_number() OVER (ORDER BY part) - 1 AS pos, d, count(*) OVER () AS c, part AS name FROM a{levels}", part_levels)},
{walk("p", "a", "SELECT doc_id, part, leaf, pos, cand AS cur, '' AS proof FROM t", levels)},
{walk("q", "b", f"SELECT doc_id, '' AS part, leaf, b.d AS subroot, b.pos, cur, proof FROM p{levels} p JOIN b0 b ON b.name = p.part", part_levels)}
SELECT doc_id, leaf, subroot, b.d AS root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = b.d AS verified
FROM q{part_levels} q JOIN b{part_levels} b ON b.part = q.part"""


@register("op11_merkle_manifest", _merkle_sql())
def q_merkle(spark, sf):
    out = merkle.proofs(merkle.build_manifest(documents(spark, sf), candidate=merkle.tampered_leaf()))
    return out.select(F.col("row").alias("doc_id"), "leaf", "subroot", "root", F.sha2(F.col("proof").cast("binary"), 256).alias("proof_sha256"),
                      F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))


@register("op12_token_files")
def q_token_files(spark, sf):
    import public_tokenizers
    docs = documents(spark, sf)
    files = token_files.write_token_files(docs, scratch_path(spark, "token-files"), public_tokenizers.path("word_bpe_49k.json"), end_id=2,
                                          marks=".,;:!?", fold_case=True)
    out = token_files.read_by_key(files, docs)
    return out.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@register("op13_filter_audit", rf"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x FROM documents),
e AS (SELECT x, min(doc_id) AS first FROM t GROUP BY x),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
w AS (SELECT t.*, first, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {SQL_WORDS.format("t.x")} AS ws
      FROM t JOIN e USING (x) LEFT JOIN g USING (doc_id)),
f AS (SELECT part, good, toxic,
        CASE WHEN len(ws) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 3 * length(x) THEN 'C' ELSE '' END
        || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > first THEN 'E' ELSE '' END AS fails
      FROM w),
c AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY part, fails),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
o AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM l a, l b, l c, l d, l e
      WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, substr(filter_order, 1, step - 1) AS before, substr(filter_order, step, 1) AS own
      FROM o, range(1, 6) r(step)),
r AS (SELECT part, filter_order, step, own, n, c.good, c.toxic, fails, contains(fails, own) AS hit,
        len(list_intersect(string_split(before, ''), string_split(fails, ''))) > 0 AND before <> '' AND fails <> '' AS gone FROM s, c),
z AS (SELECT part, filter_order, step, own, CAST(sum(n) FILTER (NOT gone AND NOT hit) AS BIGINT) AS kept,
        CAST(sum(n) FILTER (NOT gone AND hit) AS BIGINT) AS removed, CAST(sum(n) FILTER (gone AND hit) AS BIGINT) AS redundant,
        CAST(sum(n) FILTER (fails = own) AS BIGINT) AS unique_fails, CAST(sum(good) FILTER (NOT gone AND hit) AS BIGINT) AS good_lost,
        CAST(sum(toxic) FILTER (NOT gone AND hit) AS BIGINT) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant,
       coalesce(unique_fails, 0) AS unique_fails, coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM z""")
def q_filter_audit(spark, sf):
    return filter_audit.audit_filters(documents(spark, sf), table(spark, sf, "labels"))
