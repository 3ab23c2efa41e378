"""Quality classifier: hashed word and character n-gram vectors, averaged per document, softmax output.

Each kind of feature (words, whether a word repeats the one before, n-grams of each length) has an equal share in the average.

The vectors and the output weights are learned together by mini-batch stochastic gradient descent in numpy, in one task, from a bounded
sample of labelled rows. As the output is linear in the average, scoring needs one number a bucket: these are all that the driver gets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, chunks, cut, discard, mix64, small_batches, spans_hash


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 17  #: hash buckets of words and n-grams, so at most as many entries for a training document
    grams: tuple[int, ...] = (3, 4)  #: lengths of character n-grams, in bytes
    size: int = 8
    rows: int = 3000  #: labelled documents to learn from at most, the first by hash of their id
    entries: int = 1 << 24  #: and no more of these than have so many entries in all: what the task that learns holds
    epochs: int = 4
    batch: int = 32
    rate: float = 0.3
    seed: int = 7
    threshold: float = 0.3


def feature_ids(texts: list[bytes], settings: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of (bucket of each feature, index of the text it starts in): words, word pairs, each length of n-gram."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    owner_stops = np.cumsum([len(x) + 1 for x in texts])
    blank = SPACE[data]
    edge = np.diff(blank.view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    mask = np.uint64(settings.buckets - 1)
    words, at = spans_hash(data, starts, ends), np.searchsorted(owner_stops, starts, side="right")
    same = (words[1:] == words[:-1]) & (at[1:] == at[:-1])
    # Words, and for each pair of neighbours whether it repeats a word (buckets 1 and 0).
    out = [((words & mask).astype(np.int32), at), (same.astype(np.int32), at[1:])]
    owner = np.repeat(np.arange(len(texts)), np.diff(owner_stops, prepend=0)) if texts else np.empty(0, np.int64)
    for n in settings.grams:
        if len(data) < n:
            out.append((np.empty(0, np.int32), np.empty(0, np.int64)))
            continue
        code = np.full(len(data) - n + 1, n, np.uint64)
        for k in range(n):
            code = (code << np.uint64(8)) | data[k : len(data) - n + 1 + k]
        inside = owner[: len(code)] == owner[n - 1 :]
        out.append(((mix64(code) & mask).astype(np.int32)[inside], owner[: len(code)][inside]))
    return out


def _training_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            parts = feature_ids(texts, settings)
            ids, at = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts])
            share = np.concatenate([1 / (len(parts) * np.bincount(x[1], minlength=len(texts)))[x[1]] for x in parts])
            order = np.argsort(at, kind="stable")
            stops = np.searchsorted(at[order], np.arange(len(texts) + 1))
            buckets, shares = [], []
            for i in range(len(texts)):
                these = order[stops[i] : stops[i + 1]]
                own, which = np.unique(ids[these], return_inverse=True)
                buckets.append(own)
                shares.append(np.bincount(which, share[these], len(own)).astype(np.float32))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(buckets, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["key", "label", "buckets", "shares"])

    return run


def train(labels: np.ndarray, buckets: list[np.ndarray], shares: list[np.ndarray], settings: Settings) -> tuple[np.ndarray, float]:
    """The log-odds of label 1 that each bucket adds where it is all of a document, and the log-odds of an empty one."""
    rng = np.random.default_rng(settings.seed)
    vectors = rng.uniform(-1, 1, (settings.buckets, settings.size)) / settings.size
    weights, bias = rng.uniform(-1, 1, (settings.size, 2)) / settings.size, np.zeros(2)
    vector_seen, weight_seen = np.full(vectors.shape, 1e-12), np.full(weights.shape, 1e-12)
    if len(labels):
        share = np.clip(np.bincount(labels, minlength=2) / len(labels), 1e-3, 1)
        bias = np.log(share)
    steps = settings.epochs * -(-len(labels) // settings.batch)
    step = 0
    for _ in range(settings.epochs):
        order = rng.permutation(len(labels))
        for at in range(0, len(order), settings.batch):
            rows = order[at : at + settings.batch]
            rate = settings.rate * (1 - step / steps)
            step += 1
            sizes = np.array([len(buckets[r]) for r in rows])
            rows, sizes = rows[sizes > 0], sizes[sizes > 0]
            if not len(rows):
                continue
            ids, part = np.concatenate([buckets[r] for r in rows]), np.concatenate([shares[r] for r in rows])[:, None]
            cuts = np.cumsum(sizes) - sizes
            mean = np.add.reduceat(vectors[ids] * part, cuts)
            logits = mean @ weights + bias
            logits -= logits.max(1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(rows)), labels[rows]] -= 1
            back = np.repeat(error @ weights.T, sizes, axis=0) * part
            # Each step is divided by the root of the squares seen so far: common and rare features move at like rates.
            slope = mean.T @ error
            weight_seen += slope * slope
            weights -= rate * slope / np.sqrt(weight_seen)
            for k in range(settings.size):
                slope = np.bincount(ids, back[:, k], settings.buckets)
                vector_seen[:, k] += slope * slope
                vectors[:, k] -= rate * slope / np.sqrt(vector_seen[:, k])
    return (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def _learned(settings: Settings):
    """One row of what train() gives for all rows that _training_rows made, in the order of their keys: the odds as bytes, and the base."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        order = pc.sort_indices(pa.chunked_array([b.column(0) for b in held])).to_pylist() if held else []
        labels = np.concatenate([np.empty(0, np.int64), *((b.column(1).to_numpy() > 0).astype(np.int64) for b in held)])[order]
        buckets, shares = ([np.asarray(x.values) for b in held for x in b.column(k)] for k in (2, 3))
        odds, base = train(labels, [buckets[k] for k in order], [shares[k] for k in order], settings)
        yield pa.RecordBatch.from_arrays([pa.array([odds.tobytes()], pa.binary()), pa.array([base])], names=["odds", "base"])

    return run


def _scores(model, settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds, base = model.value
        for batch, texts in chunks(batches):
            total, parts = np.zeros(len(texts)), feature_ids(texts, settings)
            for ids, at in parts:
                total += np.bincount(at, odds[ids], len(texts)) / np.maximum(np.bincount(at, minlength=len(texts)), 1) / len(parts)
            score = 1 / (1 + np.exp(-(total + base)))
            index = {n: i for i, n in enumerate(batch.schema.names)}
            yield pa.RecordBatch.from_arrays([*(batch.column(index[n]) for n in batch.schema.names if n != "text"), pa.array(score)], names=[*(n for n in batch.schema.names if n != "text"), "score"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit_quality(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"):
    """A broadcast (odds by bucket, base) learned from the rows of labels that aren't held out.

    At most settings.rows labelled documents are used, the first by hash of their id, and of these as many as have settings.entries entries in all; with none, every score is the same (0.5). An id with
    several labels counts as its highest, one with several texts as the least of them; null labels, ids and texts don't count.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(settings.rows)
    texts = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(known), "key").groupBy("key", "label").agg(F.min("text").alias("text")).select("key", "text", "label")
    kind = docs.schema[id_col].dataType.simpleString()
    found = cut(texts.mapInArrow(_training_rows(settings), f"key {kind}, label int, buckets array<int>, shares array<float>"))
    # At most settings.rows narrow rows are put in order here.
    upto = found.select("key", F.sum(F.size("buckets")).over(Window.orderBy(F.xxhash64("key"), "key")).alias("upto")).where(F.col("upto") <= settings.entries)
    # They are learned from in one task, too; without any there may be no task.
    learned = found.join(F.broadcast(upto), "key", "left_semi").coalesce(1).mapInArrow(_learned(settings), "odds binary, base double").first()
    discard(found)
    model = (np.frombuffer(learned["odds"], np.float32), learned["base"]) if learned else train(np.empty(0, np.int64), [], [], settings)
    return spark.sparkContext.broadcast(model)


def quality_scores(docs: DataFrame, model, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row for each row of docs.

    Whole texts are scored from their text alone; null and empty ones get the score of the base rate. Repeated rows score alike and other
    columns don't matter. A null id is not held out.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scores(model, settings), f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= settings.threshold, 1).otherwise(0).alias("predicted"))


def keep_good(docs: DataFrame, model, settings: Settings = Settings(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least settings.threshold."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, text_col):
            only = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.binary())], names=["row", "text"])
            scores = np.concatenate([x.column(1).to_numpy() for x in _scores(model, settings)(iter([only]))])
            yield part.filter(pa.array(scores >= settings.threshold))

    return docs.mapInArrow(run, docs.schema)
