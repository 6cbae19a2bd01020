"""Vector features over tables (D2-D4, D6-D9).

Array columns and built-in higher-order functions wherever the work is a
per-row formula; joins and partial aggregations where the work crosses
rows; Arrow batches with NumPy for dense matrix products with broadcast
weights."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardforge.functions.vectors import act, let
from shardforge import constants as K


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# -- array <-> long helpers ------------------------------------------------------

def explode_vector(df: DataFrame, vec_col: str, idx: str = "j", val: str = "v") -> DataFrame:
    keep = [c for c in df.columns if c != vec_col]
    return df.select(*keep, F.posexplode_outer(vec_col).alias(idx, val))


def collect_vector(df: DataFrame, keys: list[str], idx: str = "j", val: str = "v",
                   out: str = "vec") -> DataFrame:
    """Long (keys, j, v) -> one array per key, ordered by j (the group size
    is the vector length, a bound fixed by the model width)."""
    return (df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(idx), F.col(val)))).alias("_s"))
            .select(*keys, F.transform("_s", lambda s: s[val]).alias(out)))


def mean_vectors(df: DataFrame, keys: list[str], vec_col: str, out: str = "vec") -> DataFrame:
    """Element-wise mean of an array column per group: a partial (map-side)
    aggregation on (group, element), so a group holding a third of the rows
    is still combined before the shuffle."""
    long = explode_vector(df.select(*keys, F.col(vec_col).cast("array<double>").alias("_x")), "_x")
    m = long.groupBy(*keys, "j").agg(F.avg("v").alias("v"))
    return collect_vector(m, keys, out=out)


# -- D3 label table --------------------------------------------------------------

def class_table(df: DataFrame, label_col: str, vec_col: str, null_class: int | None = None) -> DataFrame:
    """(label, vec) per class as the mean vector of its rows, plus the
    null-class row (the mean of all rows) when ``null_class`` is given."""
    t = mean_vectors(df, [label_col], vec_col).withColumnRenamed(label_col, "label")
    if null_class is not None:
        allm = mean_vectors(df.withColumn("_all", F.lit(null_class)), ["_all"], vec_col) \
            .withColumnRenamed("_all", "label")
        t = t.unionByName(allm)
    return t


# -- D4 modulation ---------------------------------------------------------------

def split_parts(vec, n_parts: int, dim: int) -> list[Column]:
    """Split one n*D parameter vector into its n parts of D."""
    vec = _c(vec)
    return [F.slice(vec, i * dim + 1, dim) for i in range(n_parts)]


def modulate(x, shift, scale) -> Column:
    """x * (1 + scale) + shift, element-wise."""
    return F.zip_with(F.zip_with(_c(x), _c(scale), lambda a, s: a * (F.lit(1.0) + s)), _c(shift),
                      lambda a, b: a + b)


def gated_residual(x, gate, f) -> Column:
    """x + gate * f, element-wise."""
    return F.zip_with(_c(x), F.zip_with(_c(gate), _c(f), lambda g, v: g * v), lambda a, b: a + b)


def modulate_tokens(df: DataFrame, params: DataFrame, key: str, tokens_col: str, params_col: str,
                    dim: int) -> DataFrame:
    """Per-token adaptive modulation with parameters per group key: the
    6*D vector splits into (shift, scale, gate) for two stages; the first
    stage gives ``modulated`` = x(1+scale)+shift and ``gated`` = x + gate *
    modulated for each token. The parameter table has one row per key and
    is joined by the optimizer's choice (broadcast when small)."""
    j = df.join(params.select(key, F.col(params_col).alias("_p")), key)
    shift, scale, gate = split_parts("_p", 6, dim)[:3]
    mod = F.transform(tokens_col, lambda t: modulate(t, shift, scale))
    return (j.withColumn("modulated", mod)
            .withColumn("gated", F.zip_with(tokens_col, "modulated", lambda t, m: gated_residual(t, gate, m)))
            .drop("_p"))


# -- D6 dense layers -------------------------------------------------------------

def dense_layer(x, w: np.ndarray, b: np.ndarray, activation: str | None = None) -> Column:
    """y = x W + b (W: in x out) as an expression with W as a literal —
    for small layers; ``dense_score`` is the Arrow path for large ones."""
    n_in, n_out = w.shape
    # one weight column per output, bound once per row with the input
    cols = F.array(*[F.array(*[F.lit(float(v)) for v in w[:, o]]) for o in range(n_out)])
    bl = F.array(*[F.lit(float(v)) for v in b])

    def body(args):
        xs, wc = args["x"], args["w"]
        return F.zip_with(wc, bl, lambda col, bias: F.aggregate(
            F.zip_with(xs, col, lambda a, c: a * c), bias, lambda acc, v: acc + v))
    y = let(F.struct(_c(x).alias("x"), cols.alias("w")), body)
    return F.transform(y, lambda v: act(activation, v)) if activation else y


_NP_ACTS = {
    None: lambda v: v,
    "identity": lambda v: v,
    "relu": lambda v: np.maximum(v, 0.0),
    "silu": lambda v: v / (1.0 + np.exp(-v)),
    "gelu_tanh": lambda v: 0.5 * v * (1.0 + np.tanh(math.sqrt(2.0 / math.pi) * (v + K.GELU_TANH_C * v ** 3))),
    "quick_gelu": lambda v: v / (1.0 + np.exp(-K.QUICK_GELU_C * v)),
    "tanh": np.tanh,
}


def dense_score(df: DataFrame, vec_col: str, layers: list[tuple[np.ndarray, np.ndarray]],
                activation: str = "gelu_tanh", out_col: str = "score") -> DataFrame:
    """Stacked MLP (activation between layers, none after the last), one
    NumPy matmul per Arrow batch. The weights are a Spark broadcast variable,
    deserialised once per Python worker."""
    import pyarrow as pa

    from shardforge.session import ensure_parallelism, ship_package
    spark = df.sparkSession
    ship_package(spark)
    df = ensure_parallelism(df)
    bc = spark.sparkContext.broadcast([(np.asarray(w, np.float64), np.asarray(b, np.float64)) for w, b in layers])
    f_act = _NP_ACTS[activation]
    def run(batches):
        ws = bc.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            from shardforge.functions.arrowbatch import from_matrix, to_matrix
            x = to_matrix(batch.column(vec_col))
            for li, (w, b) in enumerate(ws):
                x = x @ w + b
                if li < len(ws) - 1:
                    x = f_act(x)
            yield batch.append_column(out_col, from_matrix(x))

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType
    schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(DoubleType()))])
    return df.mapInArrow(run, schema)


# -- D7 group attention ------------------------------------------------------------

OUT_ROWS = 4096     # partial states that leave a task at once


def _block_partials(pairs: DataFrame, d: int, causal: bool) -> DataFrame:
    """For each (query block, key block) pair, the partial softmax state of
    every query: running max m, sum l and weighted value sum acc."""
    import pyarrow as pa
    scale = 1.0 / math.sqrt(d)

    def items(col):
        """Offsets of the blocks, and id, pos and vec of all their rows."""
        from shardforge.functions.arrowbatch import to_matrix
        at, rows = col.offsets.to_numpy(), col.values
        return (at, *[rows.field(c).to_numpy() for c in ("id", "pos")], to_matrix(rows.field("vec")))

    def run(batches):
        from shardforge.functions.arrowbatch import from_matrix
        for batch in batches:
            if not batch.num_rows:
                continue
            (q_at, q_id, q_pos, q_vec), (k_at, _, k_pos, k_vec) = items(batch.column("q_items")), items(batch.column("k_items"))
            out, size = [], 0
            for row in range(batch.num_rows):
                q, k = slice(q_at[row], q_at[row + 1]), slice(k_at[row], k_at[row + 1])
                kv = k_vec[k]
                s = (q_vec[q] @ kv.T) * scale
                if causal:
                    s = np.where(k_pos[k][None, :] <= q_pos[q][:, None], s, -np.inf)
                m = s.max(axis=1)
                has = np.isfinite(m)
                e = np.where(has[:, None], np.exp(s - np.where(has, m, 0.0)[:, None]), 0.0)
                acc = np.column_stack([e @ kv, e.sum(axis=1)])
                out.append((np.full(int(has.sum()), row), q_id[q][has], m[has], acc[has]))
                size += len(acc)
                if size >= OUT_ROWS or row == batch.num_rows - 1:
                    g, ids, ms, accs = (np.concatenate(c) for c in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("_g").take(pa.array(g, pa.int64())), pa.array(ids), pa.array(ms), from_matrix(accs)],
                        names=["_g", "q_id", "m", "acc"])
                    out, size = [], 0

    return pairs.mapInArrow(run, f"_g {pairs.schema['_g'].dataType.simpleString()}, q_id bigint, m double, acc array<double>")


def group_attention(df: DataFrame, group_cols: list[str], id_col: str, pos_col: str, vec_col: str,
                    causal: bool = False, block_rows: int = 1024, out_col: str = "attn",
                    dim: int | None = None) -> DataFrame:
    """softmax(q.k / sqrt(d)) weighted sum of the group's vectors for every
    row (query = key = value = the row vector; learned projections are
    dense layers before and after). ``causal`` keeps keys with pos <= the
    query's pos.

    Exact and skew-safe without materialising row pairs: rows are cut into
    blocks of at most ``block_rows`` consecutive positions inside their
    group (skew-safe numbering; block count from the group size), each (query block, key block) pair of
    a group meets once through an equi-join on (group, qblock, kblock), a
    NumPy task computes the partial softmax state per query, and the parts
    are merged per query with the log-sum-exp rule in two partial
    aggregations. The work is quadratic in the group size, as attention
    is; the tasks stay bounded by the block size: they read blocks as Arrow
    buffers, in batches of about 16 MB, and hand on their states in small ones."""
    from shardforge.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    d = dim or len(df.select(vec_col).first()[0])
    base = df.select(*group_cols, F.struct(*group_cols).alias("_g"), F.col(id_col).cast("bigint").alias("id"),
                     F.col(pos_col).cast("bigint").alias("pos"), F.col(vec_col).cast("array<double>").alias("vec"))
    # exact block bound: consecutive positions inside the group (skew-safe
    # numbering), block = position div block_rows
    from shardforge.operators.positions import positions_in_group
    numbered = positions_in_group(base, group_cols, ["id"], "_p")
    sizes = numbered.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    nb = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(block_rows))).cast("int")
    blocked = (numbered.join(sizes, "_g").withColumn("_nb", nb)
               .withColumn("_blk", F.floor(F.col("_p") / F.lit(block_rows)).cast("int")))
    blocks = blocked.groupBy("_g", "_blk", "_nb").agg(
        F.collect_list(F.struct("id", "pos", "vec")).alias("items"))
    qside = blocks.select("_g", F.col("_blk").alias("qb"),
                          F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("kb"),
                          F.col("items").alias("q_items"))
    kside = blocks.select("_g", F.col("_blk").alias("kb"),
                          F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("qb"),
                          F.col("items").alias("k_items"))
    pairs = qside.join(kside, ["_g", "qb", "kb"]).select("_g", "q_items", "k_items")
    # the partial states feed both the max pass and the weighted sums: write
    # them once instead of running the NumPy stage twice
    from shardforge.session import batch_rows, reliable_checkpoint
    with batch_rows(spark, 2 * block_rows * (8 * d + 32)):
        parts = reliable_checkpoint(_block_partials(pairs, d, causal))
    # an id is a position inside its group, so the group is part of every key
    mx = parts.groupBy("_g", "q_id").agg(F.max("m").alias("_M"))
    weighted = parts.join(mx, ["_g", "q_id"]).withColumn("_w", F.exp(F.col("m") - F.col("_M")))
    sums = (weighted.select("_g", "q_id", "_w", F.posexplode_outer("acc").alias("j", "a"))
            .groupBy("_g", "q_id", "j").agg(F.sum(F.col("a") * F.col("_w")).alias("a")))
    out = _normalised_vectors(sums, ["_g", "q_id"], d, out_col)
    keyed = df.withColumn("_g", F.struct(*group_cols)).withColumn("q_id", F.col(id_col).cast("bigint"))
    return keyed.join(out, ["_g", "q_id"]).drop("_g", "q_id")


def sequence_attention(df: DataFrame, vec_list_col: str, out_col: str = "attn", causal: bool = False,
                       block: int = 512) -> DataFrame:
    """The array form: one row holds a whole sequence as ARRAY<ARRAY<DOUBLE>>
    and gets the attended sequence in ``out_col`` (same length). No shuffle
    and no pair rows; scores are computed ``block`` queries at a time, and in
    causal mode against the keys up to the block's end only. Null and empty
    sequences give null and empty."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from shardforge.session import ship_package
    ship_package(df.sparkSession)

    def attend(x):
        out = np.empty_like(x)
        n, scale = len(x), 1.0 / math.sqrt(x.shape[1])
        for lo in range(0, n, block):
            hi = min(n, lo + block)
            keys = x[:hi] if causal else x
            s = (x[lo:hi] @ keys.T) * scale
            if causal:
                s = np.where(np.arange(hi)[None, :] <= np.arange(lo, hi)[:, None], s, -np.inf)
            e = np.exp(s - s.max(axis=1, keepdims=True))
            out[lo:hi] = (e / e.sum(axis=1, keepdims=True)) @ keys
        return out

    def run(batches):
        for batch in batches:
            rows = []
            for seq in batch.column(vec_list_col):
                v = seq.values
                if v is None or not len(v):
                    rows.append(None if v is None else [])
                    continue
                x = np.asarray(v.flatten().cast(pa.float64())).reshape(len(v), -1)
                rows.append(list(attend(x)))
            yield pa.RecordBatch.from_arrays(list(batch.columns) + [pa.array(rows, pa.list_(pa.list_(pa.float64())))],
                                             names=batch.schema.names + [out_col])

    schema = StructType(list(df.schema.fields) + [StructField(out_col, ArrayType(ArrayType(DoubleType())))])
    return df.mapInArrow(run, schema)


def _normalised_vectors(sums: DataFrame, keys: list[str], d: int, out_col: str) -> DataFrame:
    """(keys, j, a) with j = 0..d, where element d holds the softmax
    normaliser: one aggregation gives the vector a[0..d-1] / a[d]."""
    s = sums.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("j", "a"))).alias("_s"))
    return s.select(*keys, let(F.element_at("_s", d + 1)["a"], lambda norm: F.transform(
        F.slice("_s", 1, d), lambda e: e["a"] / norm)).alias(out_col))


def attention_pool(df: DataFrame, group_cols: list[str], vec_col: str, out_col: str = "pooled",
                   dim: int | None = None) -> DataFrame:
    """Attention pooling per group: the query is the group's mean vector,
    the tokens are the mean itself and the group's rows; output is the
    softmax(q.k / sqrt(d))-weighted sum of the tokens. Linear in the group
    size: two partial aggregations and a max pass, no pairs. Null groups are
    groups too: the key is a struct, whose nulls are equal."""
    vec = F.col(vec_col).cast("array<double>")
    base = df.select(F.struct(*group_cols).alias("_g"), vec.alias("vec"))
    d = dim or len(base.select("vec").first()[0])
    mean = mean_vectors(base, ["_g"], "vec", out="q")
    tokens = base.unionByName(mean.withColumnRenamed("q", "vec"))
    scored = tokens.join(mean, "_g").withColumn(
        "s", F.aggregate(F.zip_with("vec", "q", lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)
        / F.lit(math.sqrt(d)))
    mx = scored.groupBy("_g").agg(F.max("s").alias("_M"))
    w = scored.join(mx, "_g").withColumn("_w", F.exp(F.col("s") - F.col("_M")))
    # element d of every token is 1, so its weighted sum is the normaliser
    long = w.select("_g", "_w", F.posexplode_outer(F.concat("vec", F.array(F.lit(1.0)))).alias("j", "v"))
    sums = long.groupBy("_g", "j").agg(F.sum(F.col("v") * F.col("_w")).alias("a"))
    return _normalised_vectors(sums, ["_g"], d, out_col).select("_g.*", out_col)


# -- D8: all-pairs cosine similarity lives in operators/similarity.py ----------------

from shardforge.operators.similarity import cosine_topk  # noqa: E402, F401


# -- D9 feature extraction -------------------------------------------------------------

def parse_encoder_spec(spec: str) -> list[tuple[str, str, str]]:
    """"type-arch-size,..." -> [(type, arch, size)], exactly three fields."""
    out = []
    for part in spec.split(","):
        fields = part.strip().split("-")
        if len(fields) != 3 or not all(fields):
            raise ValueError(f"encoder spec {part!r} must have exactly three fields type-arch-size")
        out.append(tuple(fields))
    return out


def encoder_spec_table(spark, spec: str) -> DataFrame:
    """The spec as a table (ord, encoder, type, arch, size)."""
    rows = [(i, "-".join(t), *t) for i, t in enumerate(parse_encoder_spec(spec))]
    return spark.createDataFrame(rows, "ord int, encoder string, type string, arch string, size string")


def word_bucket(word: Column, dim: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint"), F.lit(dim))


def _hash_counts(text: Column, dim: int, bigram: bool) -> Column:
    """(bucket, value) of one text's words or word pairs: the buckets are
    sorted and the lengths of their runs are the counts, all inside the row."""
    def buckets(words):
        if bigram:
            words = let(words, lambda ws: F.transform(F.slice(ws, 1, F.greatest(F.size(ws) - 1, F.lit(0))),
                                                      lambda w, i: F.concat_ws(" ", w, ws[i + 1])))
        return F.sort_array(F.transform(words, lambda w: word_bucket(w, dim)))

    def runs(b):
        first = F.filter(F.transform(b, lambda v, i: F.when((i == 0) | (v != F.get(b, i - 1)), i)), lambda i: i.isNotNull())
        return let(first, lambda f: F.transform(f, lambda s, k: F.struct(
            F.get(b, s).alias("bucket"), (F.coalesce(F.get(f, k + 1), F.size(b)) - s).cast("double").alias("value"))))

    return F.when(text.isNotNull(), let(buckets(F.split(text, " ")), runs))


BUILTIN_ENCODERS = ("hash-bow", "hash-bigram")


def _custom_vectors(df: DataFrame, text_col: str, custom: list, registry: dict) -> DataFrame:
    """``df`` and the column _custom: one dense vector for each registry encoder."""
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    from shardforge.session import ship_package
    ship_package(df.sparkSession)
    fns = [(registry[key], size) for _name, key, size in custom]

    def run(batches):
        from shardforge.functions.arrowbatch import from_matrix
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            n = len(texts)
            mats = [from_matrix(np.asarray(fn(texts, size), dtype=np.float64).reshape(n, -1)) for fn, size in fns]
            # encoder-major vectors, taken row by row
            order = np.arange(n * len(mats)).reshape(len(mats), n).T.ravel()
            vectors = pa.concat_arrays(mats).take(pa.array(order))
            offsets = pa.array(np.arange(n + 1, dtype=np.int32) * len(mats))
            yield batch.append_column("_custom", pa.ListArray.from_arrays(offsets, vectors))

    return df.mapInArrow(run, StructType(
        [*df.schema.fields, StructField("_custom", ArrayType(ArrayType(DoubleType())))]))


def extract_features(df: DataFrame, id_col: str, text_col: str, spec: str,
                     registry: dict | None = None) -> DataFrame:
    """Long features (id, encoder, bucket, value) for every encoder of the
    spec, from one scan and without a shuffle: all words of a text are in its
    row. Built-in hashing encoders ("hash-bow-<dim>", "hash-bigram-<dim>")
    are Spark expressions over whole texts (null text: no rows); other
    encoders come from ``registry`` ("type-arch" -> callable(list of texts,
    size) -> 2-D array), run in one Arrow pass and give dense vectors. The id
    may have any type; a row that occurs twice gives its features twice."""
    from shardforge.session import ensure_parallelism
    builtin, custom = [], []
    for t, a, s in parse_encoder_spec(spec):
        name = f"{t}-{a}-{s}"
        if f"{t}-{a}" in BUILTIN_ENCODERS:
            builtin.append((name, int(s), a == "bigram"))
        elif registry and f"{t}-{a}" in registry:
            custom.append((name, f"{t}-{a}", s))
        else:
            raise ValueError(f"unknown encoder {name!r}")
    df = ensure_parallelism(df.select(id_col, text_col))
    if custom:
        df = _custom_vectors(df, text_col, custom, registry)
    parts = [F.struct(F.lit(name).alias("encoder"), _hash_counts(F.col(text_col), dim, bigram).alias("counts"))
             for name, dim, bigram in builtin]
    parts += [F.struct(F.lit(name).alias("encoder"), F.transform(
        F.get("_custom", k), lambda v, j: F.struct(j.cast("bigint").alias("bucket"), v.alias("value"))).alias("counts"))
        for k, (name, _key, _s) in enumerate(custom)]
    # explode_outer: a plain explode lets Spark infer size(counts) > 0 and
    # push that filter below the projection, hashing every text twice
    return (df.select(id_col, F.explode_outer(F.array(*parts)).alias("_e"))
            .select(id_col, "_e.encoder", F.explode_outer("_e.counts").alias("_c"))
            .where(F.col("_c").isNotNull()).select(id_col, "encoder", "_c.bucket", "_c.value"))


PUNCT_CHARS = (" ", "\n", ".", ",")  # Fixed values: the characters counted by punct-count


def punct_counts(texts: list, size: str) -> np.ndarray:
    """A small NumPy-side encoder for the registry: counts of space,
    newline, period and comma per text (the first ``size`` of them)."""
    chars = PUNCT_CHARS[:int(size)]
    return np.array([[0.0 if t is None else float(t.count(c)) for c in chars] for t in texts]).reshape(len(texts), len(chars))


def argmax_pick(ids) -> Column:
    """0-based position of the first maximum of an integer array (the
    end-of-text token pick)."""
    return let(_c(ids), lambda a: (F.array_position(a, F.array_max(a)) - F.lit(1)).cast("int"))

