"""Merkle manifest of a dataset: sibling-shift self-joins level by level, proofs handed down, proofs checked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, renamed

#: Children of a node.
ARITY = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Siblings of one level, left to right, and the node's own place among them.
STEP = "struct<slot: int, siblings: array<binary>>"


def _hex(x: Column) -> Column:
    return F.lower(F.hex(x))


def digest(*texts: Column) -> Column:
    """SHA-256 of the texts, concatenated, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*texts).cast("binary"), 256))


def field(value: Column) -> Column:
    """A value so that no two lists of values concatenate alike: `-` for null, else its bytes' number, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""

    def climb(at: Column, step: Column) -> Column:
        left = F.slice(step["siblings"], F.lit(1), step["slot"])
        right = F.slice(step["siblings"], step["slot"] + 1, F.size(step["siblings"]))
        return F.unhex(F.sha2(F.concat_ws("", F.transform(F.concat(left, F.array(at), right), _hex)).cast("binary"), 256))

    return F.aggregate(proof, leaf, climb)


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """A frame from cut() with `part` and `place`: a row's rank by the columns of order, from 0, is its place plus the rows of the parts before (see starts()).

    Rows are dealt by ranges and sorted within them. Ties keep the order in which the rows were stored, so that a third of all rows may be alike.
    """
    dealt = df.withColumn("stored", F.monotonically_increasing_id()).repartitionByRange(*[F.col(c) for c in (*order, "stored")]).sortWithinPartitions(*order, "stored")
    return cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).drop("stored"))


def starts(rows: DataFrame) -> DataFrame:
    """(part, before): how many rows the parts before hold. One row a part is put in order here."""
    return rows.groupBy("part").agg(F.count("*").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))


def climb(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """nodes (tree, at, size, digest, ...) -> (levels, tops).

    A level's table has the nodes of the trees that have several nodes there, with their siblings' digests, left to right, and in slot 0 the parent's
    digest. Every node joins nodes of its tree at the places of its siblings: at XOR 1 in a binary tree, else its slot shifted around the run. tops[k] has the
    trees' single nodes at height k. Columns besides the four go with the nodes of the lowest level.
    """
    levels, tops = [], []
    while True:
        tops.append(nodes.where("size = 1"))
        nodes = nodes.where("size > 1")
        slot = F.pmod(F.col("at"), F.lit(arity))
        wide = nodes.withColumn("slot", slot.cast("int"))
        for t in range(1, arity):
            place = F.col("at").bitwiseXOR(F.lit(1)) if arity == 2 else F.col("at") - F.col("slot") + F.pmod(F.col("slot") + t, F.lit(arity))
            other = nodes.select("tree", F.col("at").alias(f"at{t}"), F.col("digest").alias(f"digest{t}"))
            wide = wide.withColumn(f"at{t}", place).join(other, ["tree", f"at{t}"], "left")
        near = F.array_sort(F.filter(F.array(*[F.struct(F.col(f"at{t}").alias("at"), F.col(f"digest{t}").alias("digest")) for t in range(1, arity)]), lambda x: x["digest"].isNotNull()))
        others = F.transform(near, lambda x: x["digest"])
        above = F.when(F.col("slot") == 0, digest(_hex(F.col("digest")), F.concat_ws("", F.transform(F.col("siblings"), _hex))))
        level = cut(wide.withColumn("siblings", others).withColumn("above", above).drop(*[f"{c}{t}" for c in ("at", "digest") for t in range(1, arity)]))
        if level.isEmpty():
            discard(level)
            return levels, tops
        levels.append(level)
        nodes = level.where("slot = 0").select("tree", F.floor(F.col("at") / arity).alias("at"), F.ceil(F.col("size") / arity).alias("size"), F.col("above").alias("digest"))


def handed_down(levels: list[DataFrame], tops: list[DataFrame], arity: int, extra: list[str]) -> DataFrame:
    """The lowest nodes (tree, digest, path, end, *extra): path has the steps to the top and, after these, those in the tops' `path`; end is the top's `end`.

    Goes from the top level down, each node taking its parent's path, so that a path is joined once a node and never as a whole tree.
    """
    up = None
    for k in range(len(levels), -1, -1):
        keep = extra if k == 0 else []
        here = tops[k].select("tree", "at", "digest", "path", "end", *keep)
        if k < len(levels):
            above = up.select("tree", F.col("at").alias("over"), F.col("path").alias("rest"), "end")
            step = F.struct("slot", "siblings").cast(STEP)
            level = levels[k].withColumn("over", F.floor(F.col("at") / arity))
            here = here.unionByName(level.join(above, ["tree", "over"]).select("tree", "at", "digest", F.concat(F.array(step), F.col("rest")).alias("path"), "end", *keep))
        up = here
    return up.drop("at")


def manifest(docs: DataFrame, checked: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source", arity: int = ARITY) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof, folded_root, verified), a row for each row of docs.

    A row's leaf is the digest of its fields. The leaves of a group, in order of their ids, make a tree whose nodes have `arity` children (the last of a level
    fewer, even one); the groups' roots, in order of their names' bytes with null first, make another in the same way. `proof` is an array of (slot, siblings), from the leaf to the
    root, and checks a row without any other: folded_root is where it leads from the row as it is found, `checked` saying which fields differ from what was stored (none
    do by default), and verified whether that is the root.

    Null fields are told from empty ones. Ids that repeat, null ones included (first of all), are ordered by their leaves and, where these are equal too, as
    they were read; equal leaves have equal digests, but proofs of their own. Columns other than fields don't matter. An empty table has no rows and no root.
    """
    now = {f: (checked or {}).get(f, F.col(f)) for f in fields}
    name = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    stored, found = (F.concat(*[field(x) for x in v]) for v in ([F.col(f) for f in fields], now.values()))
    same = F.lit(True)
    for f in checked or {}:
        same = same & F.col(f).eqNullSafe(now[f])
    leaves = cut(docs.select(F.col(id_col).alias("doc_id"), name.alias("name"), digest(stored).alias("digest"), F.when(~same, digest(found)).alias("found")))
    rows = ranked(leaves, "name", "doc_id", "digest")
    discard(leaves)
    before = F.broadcast(starts(rows))
    # A part's rows of a group are consecutive: one row for each (part, group), and the group's first rank and size with it.
    spans = cut(rows.groupBy("part", "name").agg(F.min("place").alias("first"), F.count("*").alias("n")).join(before, "part"))
    groups = ranked(spans.groupBy("name").agg(F.min(F.col("first") + F.col("before")).alias("zero"), F.sum("n").alias("size")), "name")
    trees = cut(groups.join(F.broadcast(starts(groups)), "part").select("name", "zero", "size", (F.col("place") + F.col("before")).alias("tree")))
    spans_of = spans.join(trees, "name").select("part", "name", "tree", "size", (F.col("before") - F.col("zero")).alias("shift"))
    nodes = rows.join(spans_of, ["part", "name"]).select("tree", (F.col("place") + F.col("shift")).alias("at"), "size", "digest", "doc_id", "found")
    nodes = cut(nodes)
    discard(rows, spans, groups)

    levels, tops = climb(nodes, arity)
    none = F.array().cast(f"array<{STEP}>")
    subroots = tops[0].select("tree", "digest")
    for top in tops[1:]:
        subroots = subroots.union(top.select("tree", "digest"))
    total = trees.count()
    high, peaks = climb(subroots.select(F.lit(0).alias("zero"), F.col("tree").alias("at"), F.lit(total).cast("long").alias("size"), "digest", "tree").withColumnRenamed("tree", "own").withColumnRenamed("zero", "tree"), arity)
    peaks = [p.withColumn("path", none).withColumn("end", F.col("digest")) for p in peaks]
    over = cut(handed_down(high, peaks, arity, ["own"]).select(F.col("own").alias("tree"), "path", F.struct(F.col("digest").alias("subroot"), F.col("end").alias("root")).alias("end")))
    discard(trees, *high)
    tops = [top.join(over, "tree") for top in tops]
    out = handed_down(levels, tops, arity, ["doc_id", "found"])
    path = F.transform("path", lambda s: F.struct(s["slot"].alias("slot"), F.transform(s["siblings"], _hex).alias("siblings")))
    out = out.withColumn("folded", folded(F.coalesce("found", "digest"), F.col("path")))
    return out.select(
        "doc_id", _hex(F.col("digest")).alias("leaf"), _hex(F.col("end.subroot")).alias("subroot"), _hex(F.col("end.root")).alias("root"), path.alias("proof"), _hex(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("end.root")).alias("verified"),
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256, in hex, of all siblings of a proof as text, from the leaf up, left to right."""
    return F.sha2(F.concat_ws("", F.flatten(F.transform(proof, lambda s: s["siblings"]))).cast("binary"), 256)
