"""Embedding near-dedup by spherical-cap filters.

A filter is a direction; a vector passes it if their cosine is at least a threshold, so vectors in one direction's cap meet there. Directions come from
structured random product codes: the (randomly rotated) space is cut in blocks, each block has a code book of unit vectors, and every
combination of one code word a block is a direction. The combinations that a vector passes are list-decoded from the
blocks' scores without trying them all. Several independent codes are used; vectors that share a filter are compared in double precision.

The threshold and the size of the code books follow the number of vectors, so that a filter takes about as many of
them at any scale and a linked pair shares about as many filters. Recall measured against all pairs: see the tests.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erfc, exp, pi, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hinted
from .components import components

COSINE = 0.95
#: Independent codes, blocks a code, vectors a filter takes, filters of a code that a pair at the least cosine shares: the last two are aimed at.
CODES, BLOCKS, CAP, SHARED = 3, 4, 10.0, 4.0
#: Filters that a vector gets in each code at least: its best ones.
LEAST = 3
#: Rows of a filter that are compared in one piece; more are dealt in parts, and every two parts meet.
PIECE, TASK_ROWS = 1024, 8000


def plan_code(vectors: int, cosine: float = COSINE) -> tuple[float, int]:
    """(threshold in standard deviations, code words a block) for so many vectors."""
    share = min(0.05, CAP / max(vectors, 1))
    lo, hi = 0.0, 12.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if erfc(mid / sqrt(2)) / 2 > share else (lo, mid)
    x = lo + (np.arange(2000) + 0.5) * 0.004
    both = sum(exp(-v * v / 2) / sqrt(2 * pi) * erfc((lo - cosine * v) / sqrt(2 * (1 - cosine * cosine))) / 2 for v in x.tolist()) * 0.004
    return lo, max(2, round((SHARED / max(both, 1e-300)) ** (1 / BLOCKS)))


def code_books(size: int, words: int, seed: int) -> tuple[np.ndarray, list[np.ndarray], list[int]]:
    """A rotation, a code book for each block of dimensions, and where the blocks start."""
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.standard_normal((size, size)))
    starts = [size * k // BLOCKS for k in range(BLOCKS + 1)]
    books = []
    for a, b in zip(starts, starts[1:]):
        book = rng.standard_normal((words, b - a))
        books.append(book / np.maximum(np.linalg.norm(book, axis=1, keepdims=True), 1e-12) * sqrt((b - a) / size))
    return turn, books, starts


def list_decode(scores: list[np.ndarray], least: float) -> np.ndarray:
    """The combinations of one entry of each list (as numbers in mixed radix) that sum to `least` or more, at any rate the LEAST best.

    Entries go first that can't reach it even with the best of the other lists, so the cost is that of the lists and of what is found.
    """
    words = len(scores[0])
    sums = np.zeros(1)
    for s in scores:
        sums = np.add.outer(sums, np.sort(s)[-LEAST:]).ravel()
    least = min(least, np.sort(sums)[-min(LEAST, len(sums))])
    tops = [s.max() for s in scores]
    slack = least - sum(tops) - 1e-9
    kept = [np.flatnonzero(s >= slack + top) for s, top in zip(scores, tops)]
    left = np.add.outer(scores[0][kept[0]], scores[1][kept[1]])
    right = np.add.outer(scores[2][kept[2]], scores[3][kept[3]])
    a, b = (np.flatnonzero(x.ravel() >= least - y.max() - 1e-9) for x, y in ((left, right), (right, left)))
    i, j = np.nonzero(np.add.outer(left.ravel()[a], right.ravel()[b]) >= least - 1e-12)
    one = (kept[0][:, None] * words + kept[1]).ravel()[a]
    two = (kept[2][:, None] * words + kept[3]).ravel()[b]
    return one[i] * words * words + two[j]


def unit(rows: list, kind=np.float64) -> np.ndarray:
    x = np.stack([np.frombuffer(r, kind) for r in rows]).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, parts: np.ndarray, filters: list[np.ndarray], own: int, cosine: float) -> list[tuple[int, int, int]]:
    """(id, links first seen at this filter, least id it is joined to here), for the rows that have links."""
    like = x @ x.T >= cosine
    np.fill_diagonal(like, False)
    if len(set(parts.tolist())) > 1:
        like &= parts[:, None] != parts
    some = np.flatnonzero(like.any(1))
    if not len(some):
        return []
    like, ids, copies = like[np.ix_(some, some)], ids[some], copies[some]
    before = [filters[i][filters[i] < own] for i in some]
    known, at = np.unique(np.concatenate(before), return_inverse=True)
    has = np.zeros((len(some), len(known)), np.float32)
    has[np.repeat(np.arange(len(some)), [len(b) for b in before]), at] = 1
    first = like & (has @ has.T == 0)
    links = first @ copies
    label = ids.copy()
    while True:
        low = np.minimum(label, np.where(like, label, np.iinfo(np.int64).max).min(1))
        if (low == label).all():
            return list(zip(ids.tolist(), links.tolist(), label.tolist()))
        label = low


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row for each row of vectors.

    Rows link whose cosine, in double precision, is at least `cosine`; n_links counts the other rows linked directly, component_id is the least id
    reachable, kept marks the row that has it. A vector that is null, empty, zero, or holds null or non-finite components links with
    nothing; nor do vectors of different lengths. Equal vectors are worked on once, with their number. Rows
    that repeat an id are copies if their vectors are equal, else versions of one vector: links of any count. Vectors of rows without an id
    take part only as copies of one with an id; their component is null otherwise. A cosine of just `cosine` links; an empty table gives none. Other columns don't matter.
    """
    spark = vectors.sparkSession
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column(1).to_pylist():
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(1)
                out.append(x.tobytes() if np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "v"])

    rows = cut(wide.mapInArrow(packed, "id long, v binary"))
    classes = cut(rows.where("v is not null").groupBy("v").agg(F.min("id").alias("node"), F.count("*").alias("copies")))
    least, words = plan_code(classes.count(), cosine)

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[int, list] = {}
        for batch in batches:
            out = []
            for v in batch.column(0).to_pylist():
                x = unit([v])[0]
                if len(x) not in codes:
                    codes[len(x)] = [code_books(len(x), words, 1000 * len(x) + c) for c in range(CODES)]
                found = []
                for c, (turn, books, starts) in enumerate(codes[len(x)]):
                    y = x @ turn
                    scores = [book @ y[a:b] for book, a, b in zip(books, starts, starts[1:])]
                    found.append(list_decode(scores, least / sqrt(len(x))) * CODES + c)
                # Vectors of different lengths don't meet (those whose lengths differ by 2^20 are told apart later).
                out.append((np.sort(np.concatenate(found)) << 20) + len(x) % (1 << 20))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["node", "copies", "v", "filters"])

    listed = cut(classes.where("node is not null").select("v", "node", "copies").mapInArrow(passed, "node long, copies long, v binary, filters array<long>"))
    each = listed.select("node", "copies", "v", "filters", F.explode("filters").alias("filter"))
    sizes = cut(listed.select(F.explode("filters").alias("filter")).groupBy("filter").agg(F.count("*").alias("size")).where("size > 1"))
    each = each.join(hinted(sizes), "filter").withColumn("many", F.ceil(F.col("size") / PIECE)).withColumn("part", F.pmod(F.xxhash64("node"), F.col("many")))
    # With one part, its rows meet each other; with several, those of every two do, and each part's own.
    meet = F.transform(F.sequence(F.lit(0).cast("long"), F.col("many") - 1), lambda k: F.struct(F.least("part", k).alias("i"), F.greatest("part", k).alias("j")))
    units = each.withColumn("unit", F.explode(meet)).select("filter", "unit.i", "unit.j", "part", "node", "copies", "v", "filters")
    blocks = max(1, int((sizes.agg(F.sum(F.col("size") * F.ceil(F.col("size") / PIECE))).first()[0] or 0) / TASK_ROWS))

    def meeting(table: pa.Table) -> pa.Table:
        raw = table["v"].to_pylist()
        keys = np.stack([*(table[k].to_numpy() for k in ("filter", "i", "j")), np.array([len(x) for x in raw], np.int64)], 1)
        order = np.lexsort(keys.T[::-1])
        cuts = np.flatnonzero((np.diff(keys[order], axis=0, prepend=keys[order][:1] - 1) != 0).any(1))
        ids, copies, parts = (table[k].to_numpy() for k in ("node", "copies", "part"))
        lists = table["filters"].combine_chunks()
        offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
        found = []
        for a, b in zip(cuts, [*cuts[1:], len(order)]):
            if b - a > 1:
                at = order[a:b]
                own = keys[at[0], 0]
                found += compare(ids[at], copies[at], unit([raw[k] for k in at]), parts[at], [flat[offsets[k] : offsets[k + 1]] for k in at], own, cosine)
        return pa.table({k: pa.array([x[i] for x in found], pa.int64()) for i, k in enumerate(("node", "links", "least"))})

    met = cut(units.withColumn("block", F.pmod(F.xxhash64("filter", "i", "j"), F.lit(blocks))).groupBy("block").applyInArrow(meeting, "node long, links long, least long"))
    joined = components(met.where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    facts = classes.join(met.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(joined, "node", "left")
    facts = cut(facts.select("v", "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id")))
    out = rows.join(facts, "v", "left").select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    discard(classes, listed, sizes, met)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
