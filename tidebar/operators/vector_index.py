"""Nearest vectors: inverted lists of coarse cells with product-quantised residuals, exact re-scoring; and an exact search in blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    """The index is fitted on at most `sample` vectors, the first by hash of their id; every vector is in it. cells: lists, one for 40 vectors of the sample at most; parts: pieces of a residual, each told by one of
    `codes` (at most 256) shapes; probes: lists a query reads; keep: candidates a query re-scores exactly for each result asked; piece: vectors of a list, and queries, that meet in one task."""

    sample: int = 20_000
    cells: int = 64
    parts: int = 32
    codes: int = 64
    probes: int = 48
    keep: int = 8
    piece: int = 20_000
    rounds: int = 12
    seed: int = 7


@dataclass(frozen=True)
class Model:
    size: int
    centers: np.ndarray
    shapes: np.ndarray


def unit(vectors: list | np.ndarray) -> np.ndarray:
    out = np.asarray(vectors, np.float64)
    return out / np.linalg.norm(out, axis=1, keepdims=True)


def _means(points: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """k centers, by nearest means from random points; an empty center takes the point farthest from its own."""
    k = min(k, len(points))
    centers = points[rng.choice(len(points), k, replace=False)]
    for _ in range(rounds):
        far = ((points**2).sum(1)[:, None] - 2 * points @ centers.T) + (centers**2).sum(1)
        own = far.argmin(1)
        for j in range(k):
            mine = own == j
            centers[j] = points[mine].mean(0) if mine.any() else points[far[np.arange(len(points)), own].argmax()]
    return centers


def _nearest(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return ((centers**2).sum(1) - 2 * points @ centers.T).argmin(1)


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors with an id whose components are all finite and not all zero. Of rows that repeat an id the greatest vector counts."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    fine = F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("vec_id"), v.alias("v")).where("v is not null and size(v) > 0").where(fine).groupBy("vec_id").agg(F.max("v").alias("v"))


def fit(vectors: DataFrame, settings: Settings = Settings()) -> Broadcast:
    """Centers and shapes learned from a bounded sample of usable() vectors of the commonest length; vectors of other lengths have lists of their own, searched whole."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(settings.sample).select("v").toPandas()["v"].tolist()
    rng = np.random.default_rng(settings.seed)
    lengths, counts = np.unique([len(v) for v in rows], return_counts=True) if rows else (np.array([1]), np.array([0]))
    size = int(lengths[counts.argmax()])
    points = unit([v for v in rows if len(v) == size]) if rows else np.ones((1, 1))
    centers = _means(points, max(1, min(settings.cells, len(points) // 40)), settings.rounds, rng)
    rest = points - centers[_nearest(points, centers)]
    parts = max(p for p in range(1, min(settings.parts, size) + 1) if size % p == 0)
    shapes = [_means(x, settings.codes, settings.rounds, rng) for x in np.split(rest, parts, axis=1)]
    return vectors.sparkSession.sparkContext.broadcast(Model(size, centers, np.stack(shapes)))


def build(vectors: DataFrame, model: Broadcast) -> DataFrame:
    """(cell, vec_id, code): every usable() vector's list and the shapes of its residual's parts; cell -length and no code for another length than the model's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            lengths = pdf["v"].map(len).to_numpy()
            cells, codes = -lengths.astype(np.int64), np.full(len(pdf), None, object)
            at = np.flatnonzero(lengths == m.size)
            if len(at):
                points = unit(pdf["v"].iloc[at].tolist())
                cells[at] = own = _nearest(points, m.centers)
                each = np.stack([_nearest(x, s) for x, s in zip(np.split(points - m.centers[own], len(m.shapes), axis=1), m.shapes)], axis=1).astype(np.uint8)
                codes[at] = [x.tobytes() for x in each]
            yield pd.DataFrame({"cell": cells, "vec_id": pdf["vec_id"], "code": codes})

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInPandas(run, f"cell long, vec_id {kind}, code binary")


def _probed(model: Broadcast, settings: Settings):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = model.value
        for pdf in batches:
            lists = []
            for v in pdf["v"]:
                if len(v) != m.size:
                    lists.append([-len(v)])
                    continue
                # Cosine with the centers' directions as they are: a list's vectors are near its center.
                close = m.centers @ unit([v])[0] - (m.centers**2).sum(1) / 2
                lists.append(np.argsort(-close, kind="stable")[: settings.probes].tolist())
            yield pd.DataFrame({"query_id": pdf["query_id"], "v": pdf["v"], "cell": lists})

    return run


def _scored(model: Broadcast, most: int):
    """For the queries and the list's vectors that meet: the `most` of each query with the greatest approximate cosine."""

    def run(key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        m, cell = model.value, int(key[0])
        ids, out = held["vec_id"].to_numpy(), []
        if not len(asked) or not len(held):
            return pd.DataFrame({"query_id": [], "vec_id": [], "near": []})
        if cell >= 0:
            codes = np.frombuffer(b"".join(held["code"]), np.uint8).reshape(len(held), len(m.shapes))
        for query, v in zip(asked["query_id"], asked["v"]):
            if cell < 0:
                near = np.ones(len(ids))
                best = np.arange(len(ids))
            else:
                q = unit([v])[0]
                table = np.einsum("pcd,pd->pc", m.shapes, q.reshape(len(m.shapes), -1))
                near = m.centers[cell] @ q + table[np.arange(len(m.shapes)), codes].sum(1)
                best = np.lexsort((ids, -near))[:most]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[best], "near": near[best]}))
        return pd.concat(out)

    return run


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, model: Broadcast, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, vec_id, similarity): for each of queries (query_id, v; usable ones) k vectors of the greatest cosine among those found, ties by vec_id.

    A query reads the lists whose centers are nearest. A list's vectors and the queries that read it are cut into pieces of bounded size, every piece of one meeting every piece of the
    other, so that a list with a third of all vectors is many tasks' work; each meeting hands on at most keep * k candidates a query, of which the best keep * k are scored exactly. Vectors of
    another length than the index's are all candidates of the queries of that length.
    """
    most = k * settings.keep
    kind, asked_kind = vectors.schema["vec_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    asked = queries.mapInPandas(_probed(model, settings), f"query_id {asked_kind}, v array<double>, cell array<long>").select("query_id", "v", F.explode("cell").alias("cell"))
    pieces = lambda df, name: df.groupBy("cell").agg(F.ceil(F.count("*") / settings.piece).cast("int").alias(name))
    sizes = pieces(index, "a").join(pieces(asked, "b"), "cell")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    held = index.join(sizes, "cell").select("cell", of("vec_id", "a").alias("i"), every("b").alias("j"), "vec_id", "code")
    meets = asked.join(sizes, "cell").select("cell", of("query_id", "b").alias("j"), every("a").alias("i"), "query_id", "v")
    by = ["cell", "i", "j"]
    found = meets.groupBy(*by).cogroup(held.groupBy(*by)).applyInPandas(_scored(model, most), f"query_id {asked_kind}, vec_id {kind}, near double")
    place = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id")
    # Only approximate scores may cut a query's candidates: those of other lengths have none.
    best = found.withColumn("n", F.row_number().over(place)).where((F.col("n") <= most) | (F.col("near") == 1.0)).select("query_id", "vec_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    both = best.join(queries.withColumnRenamed("v", "q"), "query_id").join(vectors, "vec_id")
    exact = both.select("query_id", "vec_id", (dot("v", "q") / (F.sqrt(dot("v", "v")) * F.sqrt(dot("q", "q")))).alias("similarity"))
    rank = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return exact.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("n")


def exact_top(rows: DataFrame, queries: DataFrame, k: int, weight: float = 1.0, word_weight: float = 0.0, piece: int = 8192, block: int = 1024) -> DataFrame:
    """(query_id, row_id, score): for each of queries (query_id, v, words) the k rows of (row_id, v, rest, words) with the greatest weight * cosine + word_weight * share of the query's (distinct) words that the row has +
    rest, ties by row_id; the cosine counts 0 where either vector is null, zero or not finite or they differ in length.

    Rows and queries are dealt to pieces of about these sizes, each piece of the one meets each of the other as a product of matrices, and only the k best of a query leave a meeting:
    nothing is broadcast and no pair is a row.
    """
    many, blocks = max(1, -(-rows.count() // piece)), max(1, -(-queries.count() // block))
    kind, asked_kind = rows.schema["row_id"].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    of = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    double = lambda c: F.transform(c, lambda x: x.cast("double")).alias("v")
    a = rows.select(of("row_id", many).alias("i"), every(blocks).alias("j"), "row_id", double("v"), "rest", "words")
    b = queries.select(every(many).alias("i"), of("query_id", blocks).alias("j"), "query_id", double("v"), "words")

    def matrix(vs: list, size: int) -> np.ndarray:
        out = np.zeros((len(vs), size))
        for i, v in enumerate(vs):
            if v is not None and len(v) == size and None not in (v.tolist() if isinstance(v, np.ndarray) else v):
                n = np.linalg.norm(np.asarray(v, np.float64))
                if n > 0 and np.isfinite(n):
                    out[i] = np.asarray(v, np.float64) / n
        return out

    def meet(_key: tuple, asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "row_id": [], "score": []})]
        ids, rest = held["row_id"].to_numpy(), held["rest"].to_numpy(np.float64)
        lengths = asked["v"].map(lambda v: -1 if v is None else len(v)).to_numpy()
        for size in np.unique(lengths) if len(held) else []:
            at = np.flatnonzero(lengths == size)
            own = matrix(held["v"].tolist(), max(size, 1))
            for part in np.array_split(at, -(-len(at) // 128)):
                scores = weight * (matrix(asked["v"].iloc[part].tolist(), max(size, 1)) @ own.T) + rest
                if word_weight:
                    wanted = [list(w) if w is not None else [] for w in asked["words"].iloc[part]]
                    places = {w: i for i, w in enumerate({w for ws in wanted for w in ws})}
                    has = np.zeros((len(held), len(places)))
                    for i, ws in enumerate(held["words"]):
                        has[i, [places[w] for w in (ws if ws is not None else ()) if w in places]] = 1
                    asks = np.zeros((len(part), len(places)))
                    for i, ws in enumerate(wanted):
                        asks[i, [places[w] for w in ws]] = 1 / max(1, len(ws))
                    scores = scores + word_weight * (asks @ has.T)
                for query, score in zip(asked["query_id"].iloc[part], scores):
                    # All that tie with the k-th stay until ids decide.
                    least = np.partition(score, -k)[-k] if len(score) > k else -np.inf
                    best = np.flatnonzero(score >= least)
                    best = best[np.lexsort((ids[best], -score[best]))][:k]
                    out.append(pd.DataFrame({"query_id": query, "row_id": ids[best], "score": score[best]}))
        return pd.concat(out)

    found = b.groupBy("i", "j").cogroup(a.groupBy("i", "j")).applyInPandas(meet, f"query_id {asked_kind}, row_id {kind}, score double")
    rank = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return found.withColumn("n", F.row_number().over(rank)).where(F.col("n") <= k).drop("n")
