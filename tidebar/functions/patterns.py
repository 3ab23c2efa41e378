"""Candlestick patterns, price action and structure as columns over prepared candles (see indicators.prepare)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .indicators import atr, before, last, ready, series, volume_ratio, zscore


class Bar:
    """A bar some places back, as fields of a struct: its prices, body, range and direction."""

    NAMES = ("open", "high", "low", "close", "top", "bottom", "body", "range", "up", "down", "material", "falling", "rising")

    def __init__(self, fields: Column, back: int):
        for name in self.NAMES:
            setattr(self, name, fields[f"{name}_{back}"])

    @staticmethod
    def prices(back: int) -> list[Column]:
        """What the window gives of the bar; the trend into it is its close against that three bars earlier, or the first there is."""
        w = series()
        get = lambda c: F.col(c) if not back else F.lag(c, back).over(w)
        start = F.coalesce(F.lag("close", back + 3).over(w), F.first("close").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        return [*(get(c).alias(f"{c}_{back}") for c in ("open", "high", "low", "close")), start.alias(f"start_{back}")]

    @staticmethod
    def shape(x: Column, back: int) -> list[Column]:
        o, h, lo, c, start = (x[f"{n}_{back}"] for n in ("open", "high", "low", "close", "start"))
        top, bottom, size, here = F.greatest(o, c), F.least(o, c), F.greatest(h - lo, F.lit(1e-12)), x["bar"] - back > 1
        material = top - bottom >= F.greatest(size * 0.10, x["mean"] * 0.20)
        return [v.alias(f"{n}_{back}") for n, v in zip(Bar.NAMES, (o, h, lo, c, top, bottom, top - bottom, size, c > o, c < o, material, here & (c < start), here & (c > start)))]


def inside(inner: Bar, outer: Bar) -> Column:
    return (inner.top < outer.top) & (inner.bottom > outer.bottom)


def candlesticks() -> Column:
    """The reversal patterns that this closed bar completes, ['none'] if none. Rules: shape, a real body, and a trend to reverse."""
    mean = F.avg(F.abs(F.col("close") - F.col("open"))).over(last(20))
    return _of_bars(range(3), mean, _completed)


def _of_bars(backs, mean: Column, use) -> Column:
    """use(bars), where each field of the bars some places back is worked out once, however many rules use it."""
    prices = F.struct(*[x for k in backs for x in Bar.prices(k)], F.when(mean == 0, 1e-12).otherwise(mean).alias("mean"), F.col("bar").alias("bar"))
    shapes = lambda x: F.struct(*[v for k in backs for v in Bar.shape(x, k)], x["mean"].alias("mean"), x["bar"].alias("bar"))
    return F.element_at(F.transform(F.transform(F.array(prices), shapes), use), 1)


def _completed(x: Column) -> Column:
    c, p, f, mean, bar = Bar(x, 0), Bar(x, 1), Bar(x, 2), x["mean"], x["bar"]
    upper, lower = c.high - c.top, c.bottom - c.low
    solid = (c.body / c.range > 0.10) & c.material
    low_pin = solid & (lower >= F.greatest(c.body * 2, c.range * 0.45)) & (upper <= F.greatest(c.body * 0.75, c.range * 0.10))
    high_pin = solid & (upper >= F.greatest(c.body * 2, c.range * 0.45)) & (lower <= F.greatest(c.body * 0.75, c.range * 0.10))
    pair = p.material & c.material
    bull, bear = pair & p.falling & p.down & c.up, pair & p.rising & p.up & c.down
    small = (c.body <= p.body * 0.60) & inside(c, p)
    half = (p.open + p.close) / 2
    three = (bar >= 5) & (f.body >= mean)
    held, star = (p.body <= f.body * 0.60) & inside(p, f), (p.body <= f.body * 0.45) & (c.body >= f.body * 0.60)
    middle = (f.open + f.close) / 2
    rules = {
        "hammer": low_pin & p.falling, "hanging_man": low_pin & p.rising, "shooting_star": high_pin & p.rising, "inverted_hammer": high_pin & p.falling,
        "bullish_engulfing": bull & (c.open <= p.close) & (c.close >= p.open) & (c.body > p.body), "bearish_engulfing": bear & (c.open >= p.close) & (c.close <= p.open) & (c.body > p.body),
        "bullish_harami": bull & small, "bearish_harami": bear & small,
        "piercing_line": bull & (c.open <= p.close) & (c.close > half) & (c.close < p.open), "dark_cloud_cover": bear & (c.open >= p.close) & (c.close > p.open) & (c.close < half),
        "three_inside_up": three & f.falling & f.down & p.up & c.up & held & (c.close > f.open), "three_inside_down": three & f.rising & f.up & p.down & c.down & held & (c.close < f.open),
        "morning_star": three & f.falling & f.down & c.up & star & (c.close > middle), "evening_star": three & f.rising & f.up & c.down & star & (c.close < middle),
    }
    found = F.array_compact(F.array(*[F.when(r, F.lit(n)) for n, r in rules.items()]))
    return F.when((bar < 3) | (F.size(found) == 0), F.array(F.lit("none"))).otherwise(found)


def price_action() -> Column:
    """The setup of the bar before this one: pin bars, then inside bar, then fakeys, the later named winning."""
    return _of_bars(range(1, 4), F.lit(0.0), _setup)


def _setup(x: Column) -> Column:
    c, m, g = Bar(x, 1), Bar(x, 2), Bar(x, 3)
    upper, lower = c.high - c.top, c.bottom - c.low
    out = F.when((lower >= c.body * 2) & (lower >= upper * 1.5) & (c.close >= c.low + c.range * 0.6), "bullish_pin_bar").when((upper >= c.body * 2) & (upper >= lower * 1.5) & (c.close <= c.low + c.range * 0.4), "bearish_pin_bar").otherwise("none")
    out = F.when((m.high > m.low) & (c.high < m.high) & (c.low > m.low), "inside_bar").otherwise(out)
    nested = (m.high < g.high) & (m.low > g.low)
    fake = F.when(nested & (c.high > g.high) & (c.close < g.high), "bearish_fakey").when(nested & (c.low < g.low) & (c.close > g.low), "bullish_fakey")
    return F.when(x["bar"] < 4, "none").otherwise(F.coalesce(fake, out))


def with_td9(df: DataFrame, lookback: int = 4, most: int = 28) -> DataFrame:
    """td9_up, td9_down: how many bars in a row closed above (below) that `lookback` bars before, up to `most`."""
    w = series()
    sign = F.coalesce(F.signum(F.col("close") - F.lag("close", lookback).over(w)), F.lit(0.0))
    out = df.withColumn("_s", sign).withColumn("_new", F.when(F.coalesce(F.lag("_s").over(w), F.lit(-9.0)) != F.col("_s"), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.least(F.lit(most), F.row_number().over(Window.partitionBy("symbol", "timeframe", "_run").orderBy("open_time")))
    out = out.withColumns({"td9_up": F.when(F.col("_s") > 0, n).otherwise(0), "td9_down": F.when(F.col("_s") < 0, n).otherwise(0)}).drop("_s", "_new", "_run")
    return out.withColumn("td9_exhaustion", F.when(F.col("td9_up") >= 9, "uptrend_9").when(F.col("td9_down") >= 9, "downtrend_9").otherwise("none"))


def fair_value_gap(multiple: float = 0.25, size: Column | None = None) -> dict[str, Column]:
    """A gap between this bar and that two before of more than a multiple of `size`, ATR(14) unless given (0 while that is unknown)."""
    w = series()
    high, low = F.lag("high", 2).over(w), F.lag("low", 2).over(w)
    floor = F.coalesce(atr(14) if size is None else size, F.lit(0.0)) * multiple
    side = F.when(F.col("low") - high > floor, "bullish").when(low - F.col("high") > floor, "bearish").otherwise("none")
    return {"fvg_side": ready(3, side), "fvg_size": F.when(side == "bullish", F.col("low") - high).when(side == "bearish", low - F.col("high")), "fvg_filled": F.when(side == "bullish", F.col("close") <= high).when(side == "bearish", F.col("close") >= low)}


def with_wicks(df: DataFrame, n: int = 20) -> DataFrame:
    """Z-scores of this bar's wicks against the n before, and the rejection they show."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    out = df.withColumns({"_u": (F.col("high") - F.greatest("open", "close")) / span, "_l": (F.least("open", "close") - F.col("low")) / span})
    out = out.withColumns({"upper_wick_z": zscore("_u", n), "lower_wick_z": zscore("_l", n)})
    signal = F.when((F.col("upper_wick_z") >= 1.5) & (F.col("close") <= F.col("low") + span * 0.45), "bearish_rejection").when((F.col("lower_wick_z") >= 1.5) & (F.col("close") >= F.col("low") + span * 0.55), "bullish_rejection").otherwise("none")
    return out.withColumn("wick_signal", ready(n + 1, signal)).drop("_u", "_l")


def with_structure(df: DataFrame, n: int = 3, bounded: int = 180) -> DataFrame:
    """Swings confirmed by the n bars after them, and breaks of the last swing confirmed before this bar (within `bounded` bars)."""
    w = series()
    around = w.rowsBetween(-n, n)
    one = lambda c, edge: (F.col(c) == edge(c).over(around)) & (F.aggregate(F.collect_list(c).over(around), F.lit(0), lambda a, x: a + F.when(x == F.col(c), 1).otherwise(0)) == 1) & (F.count("*").over(around) == 2 * n + 1)
    out = df.withColumns({"_ph": F.when(one("high", F.max), F.struct(F.col("high").alias("price"), F.col("bar").alias("bar"))), "_pl": F.when(one("low", F.min), F.struct(F.col("low").alias("price"), F.col("bar").alias("bar")))})
    # A pivot k bars ago is confirmed n bars after it; it must have been so before this bar.
    known = w.rowsBetween(-(bounded - 1 - n), -(n + 1))
    out = out.withColumns({"swing_high": F.last("_ph", ignorenulls=True).over(known), "swing_low": F.last("_pl", ignorenulls=True).over(known)})
    bos = F.when(F.col("close") > F.col("swing_high.price"), "bullish").when(F.col("close") < F.col("swing_low.price"), "bearish").otherwise("none")
    ratio = volume_ratio(20)
    return out.withColumns({"bos": ready(2 * n + 3, bos), "structure_volume_confirmed": F.coalesce(ratio >= 1.2, F.lit(False))}).drop("_ph", "_pl")


def volume_profile(n: int = 48, bins: int = 16) -> Column:
    """Struct (poc, low, high) of the last n bars' typical prices by volume: the fullest bin's middle, and the value area grown from it
    to 70 % of the volume, taking the fuller neighbour each time (the lower one if equal)."""
    rows = F.collect_list(F.struct("high", "low", "typical", "volume")).over(last(n))
    floor, ceiling = F.array_min(F.transform(rows, lambda r: r["low"])), F.array_max(F.transform(rows, lambda r: r["high"]))

    def profile(v: Column) -> Column:
        width = (v["ceiling"] - v["floor"]) / bins
        index = lambda r: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor((r["typical"] - v["floor"]) / width)))
        held = lambda k: F.aggregate(v["rows"], F.lit(0.0), lambda a, r: a + F.when(index(r) == k, F.greatest(r["volume"], F.lit(0.0))).otherwise(0.0))
        sums = F.array(*[held(k) for k in range(bins)])

        def grow(s: Column) -> Column:
            top = F.array_position(s, F.array_max(s)).cast("int")
            total = F.aggregate(s, F.lit(0.0), lambda a, x: a + x)
            start = F.struct(top.alias("a"), top.alias("b"), F.element_at(s, top).alias("sum"))

            def step(at: Column, _: Column) -> Column:
                left = F.when(at["a"] > 1, F.element_at(s, F.greatest(at["a"] - 1, F.lit(1)))).otherwise(-1.0)
                right = F.when(at["b"] < bins, F.element_at(s, F.least(at["b"] + 1, F.lit(bins)))).otherwise(-1.0)
                done = (at["sum"] >= total * 0.70) | ((left < 0) & (right < 0))
                up = right > left
                grown = F.struct(F.when(up, at["a"]).otherwise(at["a"] - 1).alias("a"), F.when(up, at["b"] + 1).otherwise(at["b"]).alias("b"), (at["sum"] + F.when(up, right).otherwise(left)).alias("sum"))
                return F.when(done, at).otherwise(grown)

            end = F.aggregate(F.sequence(F.lit(1), F.lit(bins)), start, step)
            return F.transform(F.array(end), lambda e: F.struct((v["floor"] + (top - 0.5) * width).alias("poc"), (v["floor"] + (e["a"] - 1) * width).alias("low"), (v["floor"] + e["b"] * width).alias("high")))

        return F.element_at(F.flatten(F.transform(F.array(sums), grow)), 1)

    one = F.transform(F.array(F.struct(rows.alias("rows"), floor.alias("floor"), ceiling.alias("ceiling"))), lambda v: F.when(v["ceiling"] > v["floor"], profile(v)))
    return ready(12, F.element_at(one, 1))


def with_methodology(df: DataFrame, alignment: Column | None = None) -> DataFrame:
    """Regime, turtle break-out, Wyckoff event, Elliott shape, Fibonacci levels and their blend, over a snapshot() frame; null before bar 55."""
    w = series()
    col = F.col
    past = col("close") / F.lag("close", 20).over(w) - 1
    move = F.when(col("bar") >= 22, past).otherwise(0.0)
    atr_pct = F.coalesce(col("atr_pct"), F.lit(0.0))
    adx, plus, minus = (F.coalesce(col(c), F.lit(0.0)) for c in ("dx", "plus_di", "minus_di"))
    top55 = F.max("close").over(last(55))
    regime = F.when((F.abs(move) > F.greatest(atr_pct * 8, F.lit(0.03))) & (atr_pct > 0.01), F.when(move > 0, "bull_volatile").otherwise("bear_volatile"))
    regime = regime.when((adx >= 25) & (plus > minus), "bull_quiet").when((adx >= 25) & (minus > plus), "bear_quiet")
    regime = regime.when((col("volume_ratio") > 1.8) & (F.abs(move) < F.greatest(atr_pct * 2, F.lit(0.01))), F.when(col("close") >= top55 * 0.96, "distribution").otherwise("accumulation")).otherwise("range_transition")
    hi, lo = F.max("high").over(last(55)), F.min("low").over(last(55))
    span = hi - lo
    turtle = F.when(col("close") > F.max("high").over(before(20)), "up_20").when(col("close") < F.min("low").over(before(20)), "down_20").otherwise("none")
    place = (col("close") - col("low")) / F.greatest(col("high") - col("low"), F.lit(1e-12))
    effort = F.coalesce(F.nullif(col("volume_ratio"), F.lit(0.0)), F.lit(1.0)) > 1.2
    event = F.when((col("close") <= hi - span * 0.786) & (place > 0.7) & effort, "spring_candidate").when((col("close") >= lo + span * 0.786) & (place < 0.3) & effort, "upthrust_candidate")
    event = event.when((turtle == "up_20") & effort, "sign_of_strength_candidate").when((turtle == "down_20") & effort, "sign_of_weakness_candidate").otherwise("none")
    ups = F.sum(F.when(col("change") > 0, 1).otherwise(0)).over(last(8))
    out = df.withColumns({"regime": regime, "turtle": turtle, "wyckoff_event": event, "_ups": ups, "fib_236": hi - span * 0.236, "fib_382": hi - span * 0.382, "fib_618": hi - span * 0.618, "fib_786": hi - span * 0.786})
    elliott = F.least(F.lit(0.7), 0.35 + F.abs(2 * col("_ups") - 8) * 0.05)
    trend = F.lit(0.5) if alignment is None else F.when(alignment == "bullish", 0.8).when(alignment == "bearish", 0.2).otherwise(0.5)
    score = [
        0.25 * trend, 0.15 * F.least(F.lit(1.0), adx / 40), 0.15 * F.least(F.lit(1.0), F.coalesce(col("volume_ratio"), F.lit(0.0)) / 2),
        0.15 * F.when(col("turtle") == "up_20", 0.9).when(col("turtle") == "down_20", 0.1).otherwise(0.5),
        0.15 * F.when(col("wyckoff_event").isin("spring_candidate", "sign_of_strength_candidate"), 0.75).when(col("wyckoff_event").isin("upthrust_candidate", "sign_of_weakness_candidate"), 0.25).otherwise(0.5),
        0.10 * elliott, 0.05 * F.when(col("regime").isin("bull_quiet", "accumulation"), 1.0).otherwise(0.5),
    ]
    out = out.withColumns({"elliott": F.when((col("_ups") >= 6) | (col("_ups") <= 2), "impulse_candidate").otherwise("correction_or_range"), "confluence": reduce(lambda a, b: a + b, score)})
    names = ("regime", "turtle", "wyckoff_event", "elliott", "confluence", "fib_236", "fib_382", "fib_618", "fib_786")
    return out.withColumns({n: ready(55, col(n)) for n in names}).drop("_ups")
