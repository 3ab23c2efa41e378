"""Streams that wait for time to pass: forecasts evaluated when they are due, positions marked, books sampled by the second, and a sink that rewrites only the ranges a batch touches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions.scalars import direction as direction_of
from ..functions.scalars import fold_text
from ..operators.joins import asof, within
from ..sources.market import upsert
from .market import _versions

#: The state store that timers need; set it in the session before the stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTCOME = "forecast_id string, status string, outcome_time long, outcome_price double, max_high double, min_low double"
FORECAST = ("forecast_id", "symbol", "created_ms", "due_ms")


class DueForecasts(StatefulProcessor):
    """Forecasts and bars of one symbol. A forecast is evaluated at the first bar that closes at or after its due time, once no earlier one can come (the watermark has reached that close); if the
    watermark passes due time + grace without one, it expires. Timers wake it; bars that no forecast can need any more go."""

    def __init__(self, grace_ms: int):
        self.grace_ms = grace_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "forecast_id string", "created long, due long")
        self.bars = handle.getMapState("bars", "close_time long", "close double, high double, low double")

    def _settled(self, mark: int) -> pd.DataFrame:
        """What can be said at this watermark; sets timers for the rest."""
        bars = sorted((k[0], tuple(v)) for k, v in self.bars.iterator())
        out, oldest = [], mark
        for (name,), (created, due) in list(self.pending.iterator()):
            end = next((t for t, _ in bars if t >= due), None)
            if end is not None and end <= min(mark, due + self.grace_ms):
                own = [b for t, b in bars if created <= t <= end]
                out.append((name, "evaluated", end, own[-1][0], max(b[1] for b in own), min(b[2] for b in own)))
            elif mark > due + self.grace_ms:
                out.append((name, "expired", None, None, None, None))
            else:
                oldest = min(oldest, created)
                self.handle.registerTimer(due + self.grace_ms + 1 if end is None else min(end, due + self.grace_ms + 1))
                continue
            self.pending.removeKey((name,))
        for t, _ in bars:
            if t < oldest:
                self.bars.removeKey((t,))
        return pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")]).astype({"outcome_time": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        mark = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if pd.isna(r.forecast_id):
                    self.bars.updateValue((int(r.close_time),), (float(r.close), float(r.high), float(r.low)))
                elif not self.pending.containsKey((r.forecast_id,)):
                    self.pending.updateValue((r.forecast_id,), (int(r.created_ms), int(r.due_ms)))
        yield self._settled(mark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._settled(timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def due_stream(forecasts: DataFrame, bars: DataFrame, late: str = "1 minute", grace_ms: int = 600_000) -> DataFrame:
    """Streams of forecasts (forecast_id, symbol, created_ms, due_ms) and closed bars (symbol, close_time, close, high, low) -> outcomes, for append mode.

    A forecast that comes twice within the watermark counts once; rows later than the watermark are dropped. Needs the state store of STORE.
    """
    at = lambda c: F.timestamp_millis(F.col(c))
    once = forecasts.select(*FORECAST).withColumn("at", at("created_ms")).withWatermark("at", late).dropDuplicatesWithinWatermark(["symbol", "forecast_id"])
    closed = bars.select("symbol", "close_time", "close", "high", "low").withColumn("at", at("close_time")).withWatermark("at", late)
    both = once.unionByName(closed, allowMissingColumns=True)
    return both.groupBy("symbol").transformWithStateInPandas(DueForecasts(grace_ms), OUTCOME, "append", "eventTime")


def due_batch(forecasts: DataFrame, bars: DataFrame, grace_ms: int = 600_000, now_ms: int | None = None) -> DataFrame:
    """The same from tables, as of now_ms (None: when everything has come): forecasts that are neither evaluated nor expired by then aren't there."""
    once = forecasts.select(*FORECAST).dropDuplicates(["symbol", "forecast_id"])
    seen = bars if now_ms is None else bars.where(F.col("close_time") <= now_ms)
    found = asof(once, seen.select("symbol", "close_time", "close"), ["symbol"], "due_ms", "close_time", ["close_time", "close"], forward=True, prefix="end_")
    fits = F.col("end_close_time") <= F.col("due_ms") + grace_ms
    done = found.where(fits)
    spans = within(done, seen.select("symbol", "close_time", "high", "low"), ["symbol"], "created_ms", "end_close_time", "close_time").groupBy("symbol", "forecast_id").agg(F.max("high").alias("max_high"), F.min("low").alias("min_low"))
    good = done.join(spans, ["symbol", "forecast_id"]).select("forecast_id", F.lit("evaluated").alias("status"), F.col("end_close_time").alias("outcome_time"), F.col("end_close").alias("outcome_price"), "max_high", "min_low")
    over = found.where(~F.coalesce(fits, F.lit(False))).where(F.lit(True) if now_ms is None else F.col("due_ms") + grace_ms < now_ms)
    return good.unionByName(over.select("forecast_id", F.lit("expired").alias("status")), allowMissingColumns=True)


def graded(outcomes: DataFrame, entry: str = "entry_price", direction: str = "direction", least: str = "min_move_pct", invalidation: str = "invalidation_price") -> DataFrame:
    """outcomes joined with their forecasts: return, direction by a threshold of at least 0.0001 (0.0015 if none is given), whether it was foreseen, how far the price went both ways, whether the invalidation level was hit."""
    base = F.nullif(F.col(entry), F.lit(0.0))
    threshold = F.greatest(F.lit(0.0001), F.coalesce(F.nullif(F.col(least), F.lit(0.0)), F.lit(0.0015)))
    ret = F.when(F.col("outcome_price").isNotNull(), F.coalesce(F.col("outcome_price") / base - 1, F.lit(0.0)))
    came = F.when(ret >= threshold, "up").when(ret <= -threshold, "down").when(ret.isNotNull(), "range")
    said = F.when(direction_of(fold_text(F.col(direction))).isin("up", "down"), direction_of(fold_text(F.col(direction))))
    hit = F.when(said == "up", F.col("min_low") <= F.col(invalidation)).when(said == "down", F.col("max_high") >= F.col(invalidation))
    return outcomes.withColumns({
        "outcome_return_pct": ret, "outcome_direction": came, "direction_correct": came == F.coalesce(said, F.lit("range")), "max_favorable_pct": F.col("max_high") / base - 1, "max_adverse_pct": F.col("min_low") / base - 1,
        "invalidation_hit": F.when(F.col("outcome_price").isNotNull(), hit),
    })


# Marking


def marks(positions: DataFrame, prices: DataFrame, longest: str = "1 day", every: str = "1 minute", late: str | None = None, commission: float = 0.0015) -> DataFrame:
    """positions (position_id, symbol, opened_at, quantity, entry_price; times are timestamps) marked by prices (symbol, time, seq, price): for each `every` the last price since the position opened and within
    `longest` of that, what the position is worth, and its result after the commission of its entry.

    With `late`, both sides are streams with watermarks that bound what the join and the windows keep, and a window comes when it is over; without, tables.
    """
    if late is not None:
        positions, prices = positions.withWatermark("opened_at", late), prices.withWatermark("time", late)
    p = prices.withColumnRenamed("symbol", "_symbol")
    both = positions.join(p, (F.col("symbol") == F.col("_symbol")) & (F.col("time") >= F.col("opened_at")) & (F.col("time") <= F.col("opened_at") + F.expr(f"INTERVAL {longest}")))
    last = both.groupBy(F.window("time", every), "position_id", "symbol", "quantity", "entry_price").agg(F.max_by("price", F.struct("time", "seq", "price")).alias("price"))
    gross = (F.col("price") - F.col("entry_price")) * F.col("quantity")
    return last.select(F.unix_millis("window.end").alias("marked_at"), "position_id", "symbol", "price", (F.col("price") * F.col("quantity")).alias("value"), (gross - F.col("entry_price") * F.col("quantity") * commission).alias("pnl"))


def sampled_books(books: DataFrame, fresh_s: int = 10, late: str | None = None) -> DataFrame:
    """books (symbol, updated_at as a timestamp, bid_qty, ask_qty, spread_pct, price) at every whole second, the last one of at most fresh_s seconds before: (symbol, captured_at, ...).

    A book speaks for the seconds after it; of the books that speak for a second the greatest by time, then by its numbers, counts, so that repeated rows change nothing. With `late` this is a stream,
    and a second comes once no book for it can.
    """
    first, last = F.ceil(F.unix_millis("updated_at") / 1000), F.floor(F.unix_millis("updated_at") / 1000) + fresh_s
    each = books.withColumn("second", F.explode(F.sequence(first, last))).withColumn("second", F.timestamp_seconds("second"))
    # The seconds run ahead of the books by fresh_s, and so does the watermark.
    each = each if late is None else each.withWatermark("second", f"{late} {fresh_s} seconds")
    best = each.groupBy("symbol", "second").agg(F.max(F.struct("updated_at", "bid_qty", "ask_qty", "spread_pct", "price")).alias("b"))
    total = F.col("b.bid_qty") + F.col("b.ask_qty")
    return best.select(
        "symbol", F.unix_seconds("second").alias("captured_at"), F.unix_millis("b.updated_at").alias("updated_ms"), "b.bid_qty", "b.ask_qty", "b.spread_pct", (total * F.nullif(F.col("b.price"), F.lit(0.0))).alias("depth"),
        F.when(total != 0, (F.col("b.bid_qty") - F.col("b.ask_qty")) / total).alias("orderflow_imbalance"),
    )


# A sink by ranges


def ranged_sink(path: str, keys: list[str], order: str, range_of: Column, kept: int = 3):
    """A foreachBatch function that lays each batch over a table at path, rewriting only the ranges (values of range_of, a function of keys) that the batch touches.

    Each batch writes its ranges' new rows to a folder of its own and then a list of which range is where; a list counts when it is whole, so readers (read_ranged) see all of a batch or
    none, and what an attempt that failed has left is overwritten. A batch that comes twice changes nothing. The last `kept` lists and what they name stay.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found = _versions(spark, f"{path}/lists")
        version = found[-1] + 1 if found else 0
        fresh = batch.withColumn("_range", range_of.cast("string")).persist()
        try:
            touched = [r[0] for r in fresh.select("_range").distinct().collect()]
            if not touched:
                return
            where = _where(spark, path, found[-1]) if found else {}
            old = [f"{path}/data/v{where[r]}/_range={_folder(r)}" for r in touched if r in where]
            stored = spark.read.parquet(*old) if old else fresh.drop("_range").limit(0)
            upsert(stored, fresh.drop("_range"), keys, order).withColumn("_range", range_of.cast("string")).repartition("_range").write.partitionBy("_range").mode("overwrite").parquet(f"{path}/data/v{version}")
        finally:
            fresh.unpersist()
        where |= dict.fromkeys(touched, version)
        spark.createDataFrame(list(where.items()), "range string, version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists/v{version}")
        folder = spark._jvm.org.apache.hadoop.fs.Path
        system = folder(path).getFileSystem(spark._jsc.hadoopConfiguration())
        lists = [*found, version][-kept:]
        named = {v for n in lists for v in _where(spark, path, n).values()}
        for v in found:
            if v not in lists:
                system.delete(folder(f"{path}/lists/v{v}"), True)
            if v not in named:
                system.delete(folder(f"{path}/data/v{v}"), True)

    return write


def _where(spark, path: str, version: int) -> dict[str | None, int]:
    return {r["range"]: r["version"] for r in spark.read.parquet(f"{path}/lists/v{version}").collect()}


def _folder(value: str | None) -> str:
    """The name that Spark gives a partition's folder: unusual characters as % and their code."""
    return "__HIVE_DEFAULT_PARTITION__" if value is None or value == "" else "".join(c if c.isalnum() and c.isascii() or c in "-_. " else "".join(f"%{b:02X}" for b in c.encode()) if c.isascii() else c for c in value)


def read_ranged(spark, path: str) -> DataFrame | None:
    """The table as of the last whole batch that ranged_sink wrote; None before the first."""
    found = _versions(spark, f"{path}/lists")
    if not found:
        return None
    return spark.read.parquet(*[f"{path}/data/v{v}/_range={_folder(r)}" for r, v in sorted(_where(spark, path, found[-1]).items(), key=str)])
