"""What several operators share: cutting lineage in the shared folder, checked broadcasts, text chunks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast up to this many bytes of Parquet; above it the join shuffles.
BROADCAST_BYTES = 6 << 20
#: Texts are worked on in chunks of about this many bytes.
CHUNK_BYTES = 1 << 19
#: Bytes of a batch that Spark hands to Python.
BATCH_BYTES = 2 << 20
#: Characters of a text that are cut into words at a time.
PIECE = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset on a local master (tests), a new one of our own. On a cluster it must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidebar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def cut(df: DataFrame, seen: Observation | None = None, *counts) -> DataFrame:
    """df, written to the shared folder and read back: executors may come and go from here on. seen, if given, gets counts of what is written.

    If the driver finds none of the files that the tasks wrote, the folder isn't shared and this raises; an empty table has a file, too.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidebar-{uuid.uuid4().hex}"
    (df.observe(seen, *counts) if seen else df).write.parquet(path)
    system, hadoop = _files(spark, path)
    if not any(f.getPath().getName().startswith("part-") for f in system.listStatus(hadoop)):
        raise OSError(f"the driver sees no part of {path}: spark.checkpoint.dir isn't shared")
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def stored_bytes(df: DataFrame) -> int:
    """Bytes that cut() wrote."""
    system, hadoop = _files(df.sparkSession, df.written_to)
    return system.getContentSummary(hadoop).getLength()


def unused(name: str, taken: list[str]) -> str:
    """name, or a longer one that isn't a column yet."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def renamed(df: DataFrame, **names: str) -> DataFrame:
    """A frame from cut() with the columns old=new only, still known as written."""
    out = df.select(*[F.col(old).alias(new) for old, new in names.items()])
    out.written_to = df.written_to
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what cut() wrote for frames that nothing reads any more."""
    for df in frames:
        system, hadoop = _files(df.sparkSession, df.written_to)
        system.delete(hadoop, True)


def release(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect: Spark then deletes the shuffle files that no frame refers to any more, which else stay on disk until its next collection, and the heap shrinks to what plans and tasks in use need."""
    spark._jvm.System.gc()


def hinted(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A frame from cut(), marked for broadcast if what was written is small enough."""
    return F.broadcast(df) if stored_bytes(df) <= limit else df


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of a batch, so that one of long texts stays small; batches of short rows are as before."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 (null: empty), about CHUNK_BYTES each."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
        sizes = np.diff(np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1])
        at = size = 0
        for i, n in enumerate([*sizes.tolist(), None]):
            if n is None or size + n > CHUNK_BYTES and i > at:
                if i > at:
                    yield batch.slice(at, i - at), [x or b"" for x in col.slice(at, i - at).to_pylist()]
                at, size = i, 0
            size += n or 0


def pieces(text: str | bytes, edge: re.Pattern) -> Iterator[tuple[int, int]]:
    """Ranges of about PIECE characters of text, each but the last ending where edge matches."""
    at = 0
    while at < len(text):
        found = edge.search(text, at + PIECE)
        end = found.start() if found else len(text)
        yield at, end
        at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finalizer, which spreads every input bit."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


BASE = 0x9E3779B97F4A7C15
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        with np.errstate(over="ignore"):
            for k, b in enumerate((BASE, pow(BASE, -1, 1 << 64))):
                steps = np.full(max(n * 5 // 4, 1 << 19), b, np.uint64)
                steps[0] = 1
                _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[s:e], vectorised through one prefix sum."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, A-Z lower-cased, and the number of words up to each text's end."""
    data = np.frombuffer(b" ".join([*texts, b""]).lower(), np.uint8)
    blank = SPACE[data]
    edge = np.diff(blank.view(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(ends) < len(starts):
        ends = np.append(ends, len(data))
    stops = np.cumsum([len(x) + 1 for x in texts])
    return spans_hash(data, starts, ends), np.searchsorted(starts, stops)
