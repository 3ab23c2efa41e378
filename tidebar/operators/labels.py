"""What came after a bar: forward outcomes, first touches, spikes with cool-downs, controls. The only place that looks ahead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursive import scan


def ahead(ms: int):
    """Bars that open in (now, now + ms]."""
    return Window.partitionBy("symbol", "timeframe").orderBy("open_time").rangeBetween(1, ms)


def outcomes(candles: DataFrame, horizons: dict[str, int]) -> DataFrame:
    """For each named horizon in ms: greatest rise and fall and the last close's return, against this close; null without a later bar."""
    add: dict[str, Column] = {}
    for name, ms in horizons.items():
        w, base = ahead(ms), F.nullif(F.col("close"), F.lit(0.0))
        add |= {f"up_{name}": F.max("high").over(w) / base - 1, f"down_{name}": F.min("low").over(w) / base - 1, f"ret_{name}": F.last("close").over(w) / base - 1}
    return candles.withColumns(add)


def first_touch(candles: DataFrame, target: float, stop: float, bars: int) -> DataFrame:
    """outcome: 'stop' or 'target', whichever level from the next open is touched first in the next `bars` bars (stop first within one), else 'timeout';
    touch_bar: which of them. Null without a next bar."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("open_time")
    entry = F.lead("open").over(w)
    path = F.collect_list(F.struct("high", "low")).over(w.rowsBetween(1, bars))
    out = candles.withColumns({"_entry": entry, "_path": path})
    hit = F.transform("_path", lambda p, i: F.when(p["low"] <= F.col("_entry") * (1 - stop), F.struct((i + 1).alias("touch_bar"), F.lit("stop").alias("outcome"))).when(p["high"] >= F.col("_entry") * (1 + target), F.struct((i + 1).alias("touch_bar"), F.lit("target").alias("outcome"))))
    first = F.try_element_at(F.filter(hit, lambda h: h.isNotNull()), F.lit(1))
    return out.withColumns({"outcome": F.when(F.col("_entry").isNotNull(), F.coalesce(first["outcome"], F.lit("timeout"))), "touch_bar": first["touch_bar"]}).drop("_entry", "_path")


def trajectory(candles: DataFrame, bars: int = 15, whole: bool = False) -> DataFrame:
    """peak_bar, trough_bar, peak, trough, giveback: where the next bars' extremes lie and how much of the peak the last close gives back. whole: null where fewer than `bars` bars follow."""
    w = Window.partitionBy("symbol", "timeframe").orderBy("open_time")
    out = candles.withColumn("_p", F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, bars)))
    if whole:
        out = out.withColumn("_p", F.when(F.size("_p") == bars, F.col("_p")))
    highs, lows, base = F.transform("_p", lambda p: p["high"]), F.transform("_p", lambda p: p["low"]), F.nullif(F.col("close"), F.lit(0.0))
    end = F.try_element_at("_p", F.lit(-1))["close"]
    out = out.withColumns({"peak": F.array_max(highs) / base - 1, "trough": F.array_min(lows) / base - 1, "peak_bar": F.nullif(F.array_position(highs, F.array_max(highs)), F.lit(0)), "trough_bar": F.nullif(F.array_position(lows, F.array_min(lows)), F.lit(0)), "_end": end / base - 1})
    return out.withColumn("giveback", F.col("peak") - F.col("_end")).withColumn("first_direction", F.when(F.col("peak_bar") < F.col("trough_bar"), "up").when(F.col("trough_bar") < F.col("peak_bar"), "down").otherwise("both")).drop("_p", "_end")


class _Cooldown:
    def __init__(self, gap: int):
        self.gap, self.until = gap, None

    def step(self, r) -> list[tuple]:
        if r.hit and (self.until is None or r.open_time >= self.until):
            self.until = r.open_time + self.gap
            return [(r.open_time,)]
        return []

    def finish(self) -> list[tuple]:
        return []


def cooldown(marked: DataFrame, gap_ms: int, hit: str = "hit") -> DataFrame:
    """(symbol, timeframe, open_time) of hits, each at least gap_ms after the one kept before it: greedy, in order."""
    hits = marked.where(F.col(hit)).select("symbol", "timeframe", "open_time", F.lit(True).alias("hit"))
    return scan(hits, lambda _key: _Cooldown(gap_ms), ["symbol", "timeframe", "open_time", "hit"], "open_time long")


class _FromPeak:
    """Hits in order, none before the last one's peak and `gap` more."""

    def __init__(self, gap: int):
        self.gap, self.until = gap, None

    def step(self, r) -> list[tuple]:
        if self.until is not None and r.open_time < self.until:
            return []
        self.until = r.peak_time + self.gap
        return [(r.open_time,)]

    finish = _Cooldown.finish


def spikes(candles: DataFrame, rise: float, horizon_ms: int, gap_ms: int, onset_bars: int | None = None) -> DataFrame:
    """Bars from whose close the high rises by `rise` within the horizon, none before gap_ms after the peak of the one kept before it.

    With the move, the peak's time (its first bar), when the rise was crossed, and the onset: the first lowest low of the onset_bars (as many as the horizon has minutes) up to the crossing.
    """
    back = max(1, horizon_ms // 60_000) if onset_bars is None else onset_bars
    w, base = ahead(horizon_ms), F.nullif(F.col("close"), F.lit(0.0))
    bar = F.struct("open_time", "high", "low")
    order = Window.partitionBy("symbol", "timeframe").orderBy("open_time")
    path = candles.withColumns({"peak_price": F.max("high").over(w), "_next": F.collect_list(bar).over(w), "_past": F.collect_list(bar).over(order.rowsBetween(-back, 0))})
    path = path.withColumn("move", F.col("peak_price") / base - 1).where(F.col("move") >= rise)
    first = lambda test: F.try_element_at(F.filter("_next", test), F.lit(1))["open_time"]
    path = path.withColumns({"peak_time": first(lambda p: p["high"] == F.col("peak_price")), "crossed_at": first(lambda p: p["high"] / F.col("close") - 1 >= rise)})
    path = path.withColumn("crossed_at", F.coalesce("crossed_at", "peak_time"))
    run = F.concat("_past", F.filter("_next", lambda p: p["open_time"] <= F.col("crossed_at")))
    path = path.withColumn("_run", F.when(F.size(run) > back + 1, F.slice(run, -(back + 1), back + 1)).otherwise(run))
    lowest = F.array_min(F.transform("_run", lambda p: p["low"]))
    path = path.withColumn("onset_at", F.try_element_at(F.filter("_run", lambda p: p["low"] == lowest), F.lit(1))["open_time"])
    path = path.select("symbol", "timeframe", "open_time", "close", "move", "peak_price", "peak_time", "crossed_at", "onset_at")
    kept = scan(path, lambda _key: _FromPeak(gap_ms), ["symbol", "timeframe", "open_time", "peak_time"], "open_time long")
    return kept.join(path, ["symbol", "timeframe", "open_time"])


class _Controls:
    def __init__(self, apart: int):
        self.apart, self.at = apart, None

    def step(self, r) -> list[tuple]:
        if self.at is None or r.open_time - self.at >= self.apart:
            self.at = r.open_time
            return [(r.open_time,)]
        return []

    finish = _Cooldown.finish


def controls(candles: DataFrame, events: DataFrame, clear_ms: int, apart_ms: int) -> DataFrame:
    """Bars further than clear_ms from any event of their series, taken greedily at least apart_ms from each other."""
    from .joins import asof

    at = events.select("symbol", "timeframe", F.col("open_time").alias("event_time"))
    near = asof(candles.select("symbol", "timeframe", "open_time"), at, ["symbol", "timeframe"], "open_time", "event_time", ["event_time"], prefix="past_")
    near = asof(near, at, ["symbol", "timeframe"], "open_time", "event_time", ["event_time"], forward=True, prefix="next_")
    quiet = near.where((F.col("past_event_time").isNull() | (F.col("open_time") - F.col("past_event_time") > clear_ms)) & (F.col("next_event_time").isNull() | (F.col("next_event_time") - F.col("open_time") > clear_ms)))
    return scan(quiet, lambda _key: _Controls(apart_ms), ["symbol", "timeframe", "open_time"], "open_time long")


def excursions(trades: DataFrame, candles: DataFrame) -> DataFrame:
    """trades (trade_id, symbol, entry_time, exit_time, entry_price) with the best and worst price in between, and when."""
    from .joins import within

    both = within(trades, candles.select("symbol", "open_time", "high", "low"), ["symbol"], "entry_time", "exit_time", "open_time")
    early = -F.col("open_time")
    out = both.groupBy("trade_id", "entry_price").agg(F.max("high").alias("best"), F.min("low").alias("worst"), F.max_by("open_time", F.struct(F.col("high"), early)).alias("best_time"), F.min_by("open_time", F.struct("low", "open_time")).alias("worst_time"))
    base = F.nullif(F.col("entry_price"), F.lit(0.0))
    return out.select("trade_id", (F.col("best") / base - 1).alias("mfe"), (F.col("worst") / base - 1).alias("mae"), "best_time", "worst_time")


def evaluate_forecasts(forecasts: DataFrame, min_move: float = 0.0) -> DataFrame:
    """forecasts (direction, entry, outcome, high, low, invalidation): what happened, whether it was foreseen, whether the invalidation level was hit."""
    ret = F.col("outcome") / F.nullif(F.col("entry"), F.lit(0.0)) - 1
    came = F.when(ret >= min_move, "up").when(ret <= -min_move, "down").otherwise("flat")
    hit = F.when(F.col("direction") == "up", F.col("low") <= F.col("invalidation")).when(F.col("direction") == "down", F.col("high") >= F.col("invalidation"))
    return forecasts.withColumns({"outcome_return": ret, "outcome_direction": F.when(ret.isNotNull(), came), "correct": came == F.col("direction"), "invalidated": F.coalesce(hit, F.lit(False))})
