"""Checkpoint migration as one job (E2 + C2): rules as data, one look-up per
key, names and layouts changed in the same pass.

A rule maps a dotted path to another one and may change the array's layout:

    rule("blocks.*.attn.qkv.weight", "blocks_{0}.attn.qkv.kernel", "linear")
    rule("decoder_blocks.*", "blocks_{0+15}")        # a prefix: the rest of the key follows
    rule("head", None)                               # keys below it go

``*`` stands for one segment; ``{i}`` is the i-th such segment and ``{i+n}``
the same as a number n larger. Rules form a trie over segments. A key takes the
rule at the deepest trie node that it reaches with whole segments; where a
name and a ``*`` lead to rules of one depth, the one whose names come first
wins. So the work per key depends on its length, not on the number of rules,
and rules can be added without thinking of their order. A key without a rule
stays, goes, or is an error (``unmatched``).

A row is one array: path, shape and values. Tasks look keys up and permute
values with NumPy, so the values move through no shuffle; only the collision
report groups by new name."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# axis orders of the layout rules: None reverses nothing
LAYOUTS = {"keep": None, "linear": (1, 0), "conv": (2, 3, 1, 0)}
MAX_RULE_BYTES = 64 << 20


@dataclass(frozen=True)
class Rule:
    source: str
    target: str | None
    layout: str = "keep"


def rule(source: str, target: str | None, layout: str = "keep") -> Rule:
    if layout not in LAYOUTS:
        raise ValueError(f"unknown layout {layout!r}")
    return Rule(source, target, layout)


class RuleTrie:
    """Rules by segments. ``find`` walks names and ``*`` at once."""

    def __init__(self, rules: list[Rule], sep: str = "."):
        self.sep, self.root = sep, {}
        for r in rules:
            node = self.root
            for segment in r.source.split(sep) if r.source else []:
                node = node.setdefault(segment, {})
            if None in node:
                raise ValueError(f"two rules for {r.source!r}")
            node[None] = r

    def find(self, key: str) -> tuple[Rule, list[str], list[str]] | None:
        """The rule, the segments its ``*`` took, the segments behind it."""
        segments = key.split(self.sep)
        here, best = [(self.root, ())], None
        for depth in range(len(segments) + 1):
            # in the order names before *, segment by segment
            hit = next(((n[None], taken) for n, taken in here if None in n), None)
            if hit is not None:
                best = (hit[0], list(hit[1]), segments[depth:])
            if depth == len(segments):
                break
            s = segments[depth]
            here = [x for n, taken in here for x in ([(n[s], taken)] if s in n and s != "*" else []) + ([(n["*"], (*taken, s))] if "*" in n else [])]
            if not here:
                break
        return best

    def rename(self, key: str) -> tuple[str | None, str] | None:
        """(new key or None, layout), None without a rule."""
        found = self.find(key)
        if found is None:
            return None
        r, taken, rest = found
        if r.target is None:
            return None, r.layout

        def fill(m):
            value = taken[int(m[1])]
            return str(int(value) + int(m[2])) if m[2] else value
        head = re.sub(r"\{(\d+)([+-]\d+)?\}", fill, r.target)
        return self.sep.join([x for x in (head, *rest) if x]), r.layout


def permuted(values: np.ndarray, shape: list[int], layout: str) -> tuple[np.ndarray, list[int]]:
    """Values in the layout's order. An array with fewer axes than the layout
    speaks of (a bias below a linear layer) stays as it is."""
    order = LAYOUTS[layout]
    if order is None or len(shape) != len(order):
        return values, shape
    if values.size != int(np.prod(shape, dtype=np.int64)):
        raise ValueError(f"migration: {values.size} values for shape {shape}")
    return np.ascontiguousarray(values.reshape(shape).transpose(order)).ravel(), [shape[i] for i in order]


def migrate(df: DataFrame, rules: list[Rule] | DataFrame, key_col: str = "key", shape_col: str = "shape", values_col: str = "values",
            unmatched: str = "keep", sep: str = ".") -> DataFrame:
    """``df`` with ``new_key``, and shape and values in their new layout; rows
    whose rule drops them are gone. A rule table has the columns source, target
    and layout (null: keep). ``unmatched``: "keep", "drop" or "error". Null
    values stay null; a null key counts as unmatched."""
    import pyarrow as pa
    from pyspark.sql.types import StringType, StructField, StructType

    from shardforge.session import ship_package
    spark = df.sparkSession
    ship_package(spark)
    if unmatched not in ("keep", "drop", "error"):
        raise ValueError("unmatched must be 'keep', 'drop' or 'error'")
    if isinstance(rules, DataFrame):     # configuration, checked before it is sent
        size = rules.agg(F.sum(F.length("source") + F.coalesce(F.length("target"), F.lit(0)))).first()[0] or 0
        if size > MAX_RULE_BYTES:
            raise ValueError(f"rules of {size} bytes are more than MAX_RULE_BYTES")
        rules = [rule(r["source"], r["target"], r["layout"] or "keep") for r in rules.collect()]
    sent = spark.sparkContext.broadcast(RuleTrie(rules, sep))

    def run(batches):
        trie, known = sent.value, {}
        for b in batches:
            keys, names, layouts, keep = b.column(key_col).to_pylist(), [], [], []
            for k in keys:
                if k not in known:
                    known[k] = trie.rename(k) if k is not None else None
                found = known[k]
                if found is None and unmatched == "error":
                    raise ValueError(f"migration: no rule for {k!r}")
                name, layout = found if found is not None else (k, "keep")
                keep.append(name is not None if found is not None else unmatched == "keep")
                names.append(name)
                layouts.append(layout)
            if len(known) > 1 << 20:
                known.clear()
            b = b.append_column("new_key", pa.array(names, pa.string()))
            shapes, values = b.column(shape_col).to_pylist(), b.column(values_col)
            new_shapes, new_values = [], []
            for i, (shape, layout) in enumerate(zip(shapes, layouts)):
                v = values[i].values
                if v is None or shape is None or not keep[i] or LAYOUTS[layout] is None:
                    new_shapes.append(shape)
                    new_values.append(None if v is None else v)
                    continue
                order, to = permuted(np.arange(len(v)), shape, layout)
                new_shapes.append(to)
                new_values.append(v.take(pa.array(order)))
            kind = values.type
            arrays = pa.array([None if v is None else v.to_pylist() for v in new_values], kind)
            cols = [arrays if n == values_col else pa.array(new_shapes, b.column(shape_col).type) if n == shape_col else b.column(n) for n in b.schema.names]
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names).filter(pa.array(keep, pa.bool_()))

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("new_key", StringType())]))


def migration_collisions(migrated: DataFrame, by: list[str], key_col: str = "key") -> DataFrame:
    """New names that several old ones took: by..., new_key, n_sources, first_source, last_source."""
    from shardforge.operators.keytable import key_collisions
    return key_collisions(migrated, by, key_col, "new_key")
