"""Several timeframes at one moment: a k-way as-of join, entry features and gates on it, alignment counts, ribbons, event snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..functions.linear import linear
from ..functions.variants import radar_state
from ..sources.market import TIMEFRAMES
from .gates import FRAMES

#: Bars that a timeframe needs before it says anything.
NEED = 55
RIBBON = ("1m", "5m", "15m", "30m", "1h", "4h", "1d")
#: Version of the entry features that backfill() writes.
VERSION = "public-entry-mtf-v1"


def snapshots(left: DataFrame, stream: DataFrame, frames: tuple[str, ...], left_time: str, by: tuple[str, ...] = ("symbol",), frame: str = "timeframe", time: str = "close_time", value: str = "features", strict: bool = False, bucket_ms: int | None = None, into: str = "tf") -> DataFrame:
    """left with a map `into`: for each frame the value of stream's last row of that key and frame at or before (strict: before) left_time; frames without one are missing.

    All frames and left are one stream, dealt once by key and sorted once by time; a window carries the frames' values along it. Of several rows of a frame at one time the
    greatest value counts, compared field by field. With bucket_ms, a key's rows are cut into buckets of time and dealt as such, so that a key with most rows is
    many tasks' work; what each bucket starts from is carried over one row a bucket. Values must not be null, keys may be.
    """
    keys = [F.col(k).alias(f"_k{i}") for i, k in enumerate(by)]
    names = [f"_k{i}" for i in range(len(by))]
    kind = stream.schema[value].dataType
    a = left.select(*keys, F.col(left_time).alias("_t"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast("string").alias("_frame"), F.lit(None).cast(kind).alias("_value"), F.struct(*left.columns).alias("_row"))
    b = stream.where(F.col(frame).isin(*frames)).select(*keys, F.col(time).alias("_t"), F.lit(1 if strict else 0).alias("_side"), F.col(frame).alias("_frame"), F.col(value).alias("_value"))
    rows = a.unionByName(b, allowMissingColumns=True)
    cuts = [] if bucket_ms is None else ["_bucket"]
    if bucket_ms is not None:
        rows = rows.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms)).repartition(*names, "_bucket")
    own = [F.when(F.col("_frame") == f, F.struct("_t", "_value")) for f in frames]
    w = Window.partitionBy(*names, *cuts).orderBy("_t", "_side", "_value").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *[F.last(x, ignorenulls=True).over(w).alias(f"_v{i}") for i, x in enumerate(own)])
    if bucket_ms is not None:
        ends = rows.groupBy(*names, "_bucket").agg(*[F.max(x).alias(f"_c{i}") for i, x in enumerate(own)])
        past = Window.partitionBy(*names).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*[F.col(k).alias(f"{k}c") for k in names], F.col("_bucket").alias("_bucketc"), *[F.last(f"_c{i}", ignorenulls=True).over(past).alias(f"_c{i}") for i in range(len(frames))])
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}c")) for k in (*names, "_bucket")])
        out = out.where("_row is not null").join(carried, same, "left")
        out = out.withColumns({f"_v{i}": F.coalesce(f"_v{i}", f"_c{i}") for i in range(len(frames))})
    entries = F.filter(F.array(*[F.struct(F.lit(f).alias("key"), F.col(f"_v{i}")["_value"].alias("value")) for i, f in enumerate(frames)]), lambda x: x["value"].isNotNull())
    return out.where("_row is not null").select("_row.*", F.map_from_entries(entries).alias(into))


def frame_features(candles: DataFrame) -> DataFrame:
    """(symbol, timeframe, close_time, features) of every closed bar with at least NEED bars: what the gates read, and atr_14 to put against a price."""
    averages = linear(candles, ["ema_9_r", "ema_21_r", "ema_50_r"])
    df = ind.prepare(candles).join(averages, ["symbol", "timeframe", "open_time"])
    bands = ind.bollinger()
    df = df.withColumns({"radar_bullish": radar_state(NEED), "volume_ratio_20": ind.volume_ratio(20), "orderflow_proxy_20": ind.flow_proxy(20), "rsi_14": ind.rsi_simple(14), "atr_14": ind.atr(14), "bb_width_pct": bands["bb_width"], "bb_position": bands["bb_position"]})
    up, down = (F.col("ema_9_r") > F.col("ema_21_r")) & (F.col("ema_21_r") > F.col("ema_50_r")), (F.col("ema_9_r") < F.col("ema_21_r")) & (F.col("ema_21_r") < F.col("ema_50_r"))
    alignment = F.when(up, "bullish").when(down, "bearish").otherwise("mixed")
    fields = F.struct("open_time", F.lit(True).alias("data_ready"), alignment.alias("alignment"), "radar_bullish", "volume_ratio_20", "orderflow_proxy_20", "rsi_14", "atr_14", ind.ratio(F.col("atr_14"), F.col("close")).alias("atr_pct"), "bb_width_pct", "bb_position")
    return df.where(F.col("bar") >= NEED).select("symbol", "timeframe", "close_time", fields.alias("features"))


def entry_features(signals: DataFrame, stream: DataFrame, time: str = "close_time", price: str | None = "price", frames: tuple[str, ...] = FRAMES, bucket_ms: int | None = None) -> DataFrame:
    """signals with the map `tf` that mtf_gate() takes, from bars closed by the signal's time; atr_pct is in parts of the signal's price, if it has one."""
    out = snapshots(signals, stream, frames, time, bucket_ms=bucket_ms)
    if price is None:
        return out
    return out.withColumn("tf", F.transform_values("tf", lambda _k, v: v.withField("atr_pct", ind.ratio(v["atr_14"], F.col(price)))))


def alignment_counts(frames: tuple[str, ...] = FRAMES, into: str = "tf") -> dict[str, Column]:
    """How many frames are bullish, bearish and neither (unknown ones too), the difference, and whether all are there."""
    said = [F.coalesce(F.col(into)[f]["alignment"], F.lit("unknown")) for f in frames]
    count = lambda word: reduce(lambda x, y: x + y, [F.when(x == word, 1).otherwise(0) for x in said])
    bull, bear = count("bullish"), count("bearish")
    return {"mtf_bullish_count": bull, "mtf_bearish_count": bear, "mtf_mixed_count": F.lit(len(frames)) - bull - bear, "mtf_alignment_score": bull - bear, "mtf_all_ready": F.size(into) == len(frames)}


def ribbon(symbols: DataFrame, stream: DataFrame, now_ms: int, frames: tuple[str, ...] = RIBBON) -> DataFrame:
    """(symbol, timeframe, alignment, data_ready, closed_at_ms) for each symbol and frame at one moment; `unknown` where there are too few bars."""
    at = snapshots(symbols.select("symbol").distinct().withColumn("_now", F.lit(now_ms).cast("long")), stream.withColumn("features", F.col("features").withField("close_time", F.col("close_time"))), frames, "_now")
    found = F.col("tf")[F.col("timeframe")]
    rows = at.select("symbol", "tf", F.explode(F.array(*[F.lit(f) for f in frames])).alias("timeframe"))
    return rows.select("symbol", "timeframe", F.coalesce(found["alignment"], F.lit("unknown")).alias("alignment"), found.isNotNull().alias("data_ready"), found["close_time"].alias("closed_at_ms"))


METRICS = ("rsi_14", "atr_pct", "bb_position", "bb_width_pct", "volume_ratio_20")


def event_snapshots(events: DataFrame, stream: DataFrame, start: str = "start_ms", frames: tuple[str, ...] = FRAMES, metrics: tuple[str, ...] = METRICS, bucket_ms: int | None = None) -> DataFrame:
    """A row an event and frame: metrics from bars closed before the event's start (m), from bars closed before one frame's length earlier (m_before) and their difference (m_delta).

    Looking back by a frame's length is looking at bars that close so much later: both are frames of one as-of join.
    """
    late = F.create_map(*[x for f in frames for x in (F.lit(f), F.lit(TIMEFRAMES[f]))])
    twice = stream.unionByName(stream.withColumn("close_time", F.col("close_time") + F.element_at(late, F.col("timeframe"))).withColumn("timeframe", F.concat("timeframe", F.lit("/before"))))
    found = snapshots(events, twice.where(F.split("timeframe", "/")[0].isin(*frames)), (*frames, *[f"{f}/before" for f in frames]), start, strict=True, bucket_ms=bucket_ms)
    rows = found.select(*events.columns, "tf", F.explode(F.array(*[F.lit(f) for f in frames])).alias("timeframe"))
    now, was = F.col("tf")[F.col("timeframe")], F.col("tf")[F.concat("timeframe", F.lit("/before"))]
    return rows.select(*events.columns, "timeframe", *[x for m in metrics for x in (now[m].alias(m), was[m].alias(f"{m}_before"), (now[m] - was[m]).alias(f"{m}_delta"))])


def backfill(trades: DataFrame, stream: DataFrame, time: str = "entry_time", price: str = "entry_price", version: str = VERSION, force: bool = False) -> DataFrame:
    """trades (symbol, time in ms, price, mtf_version, ...) with `tf` and alignment counts for those of another version than this one (force: all) that have a symbol and a time;
    rows already done keep what they have, so doing it twice changes nothing. Prices and results are left alone."""
    had = {c: F.col(c) if c in trades.columns else None for c in ("tf", "mtf_version", *alignment_counts())}
    due = F.lit(True) if force or had["mtf_version"] is None else ~F.col("mtf_version").eqNullSafe(F.lit(version))
    due = due & F.col("symbol").isNotNull() & F.col(time).isNotNull()
    # A row without a time has no snapshot; it goes along and stays as it is.
    fresh = entry_features(trades.withColumnsRenamed({c: f"_had_{c}" for c in had if had[c] is not None}).withColumn("_due", due if had["mtf_version"] is None else F.lit(True)), stream, time, price)
    if had["mtf_version"] is not None:
        stale = F.lit(True) if force else ~F.col("_had_mtf_version").eqNullSafe(F.lit(version))
        fresh = fresh.withColumn("_due", stale & F.col("symbol").isNotNull() & F.col(time).isNotNull())
    values = {"tf": F.col("tf"), "mtf_version": F.lit(version), **alignment_counts()}
    out = fresh.withColumns({f"_new_{c}": v for c, v in values.items()})
    kept = lambda c: F.when(F.col("_due"), F.col(f"_new_{c}")).otherwise(F.col(f"_had_{c}") if had[c] is not None else F.lit(None))
    return out.select(*[c for c in trades.columns if c not in values], *[kept(c).alias(c) for c in values])
