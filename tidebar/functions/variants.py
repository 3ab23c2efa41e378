"""Variants of the indicators in `indicators`, as research frames define them: columns over prepared candles, null until they have the bars they need."""

from __future__ import annotations

from math import exp

from pyspark.sql import Column
from pyspark.sql import functions as F

from .indicators import atr, before, bollinger, last, ratio, ready, series


def weighted(c: str, weights: list[float], need: int | None = None) -> Column:
    """The sum of the last bars of a column times weights, the newest bar last."""
    n = len(weights)
    pairs = F.zip_with(F.collect_list(c).over(last(n)), F.array(*[F.lit(w) for w in weights]), lambda a, b: a * b)
    return ready(n if need is None else need, F.aggregate(pairs, F.lit(0.0), lambda a, x: a + x))


def seeded_weights(n: int, bars: int) -> list[float]:
    """What each of the last `bars` values weighs in an average with alpha = 2 / (n + 1) that starts from the mean of the first n of them."""
    a, rest = 2 / (n + 1), bars - n
    return [(1 - a) ** rest / n] * n + [a * (1 - a) ** (rest - 1 - k) for k in range(rest)]


def stochastic_raw(n: int = 14, smooth: int = 3, raw: str = "stoch_raw") -> dict[str, Column]:
    """From raw_stochastic(n) in column raw: %K as it is, %D the mean of the last `smooth` there are."""
    return {"stoch_fast_k": F.col(raw), "stoch_fast_d": ready(n, F.avg(raw).over(last(smooth)))}


def true_range() -> Column:
    """The first bar's range is that of the bar itself."""
    return F.coalesce("tr", F.col("high") - F.col("low"))


def atr_frame(n: int = 14) -> Column:
    return ready(n, F.avg(true_range()).over(last(n)))


def dx_frame(n: int = 14) -> Column:
    """DX from sums of directional moves; null where there is no move."""
    size = F.nullif(F.avg(true_range()).over(last(n)), F.lit(0.0))
    up, down = 100 * F.sum("dm_up").over(last(n)) / size, 100 * F.sum("dm_down").over(last(n)) / size
    return ready(n, 100 * F.abs(up - down) / F.nullif(up + down, F.lit(0.0)))


def adx_frame(n: int = 14, dx: str = "dx_frame") -> Column:
    """The mean of n values of dx_frame(n), in column dx, that are all known."""
    return F.when(F.count(dx).over(last(n)) == n, F.avg(dx).over(last(n)))


def obv_slope_share(n: int = 5) -> Column:
    """The change of the on-balance volume over n bars in parts of their volume."""
    return ready(n + 1, ratio(F.sum("obv_step").over(last(n)), F.sum("volume").over(last(n))))


def kernel_lower(bars: int = 30, width: float = 10, factor: float = 2.0) -> Column:
    """A Gaussian-weighted mean of closes less `factor` times their equally weighted distance from it."""
    weights = [exp(-((bars - 1 - k) ** 2) / (2 * width**2)) for k in range(bars)]
    shares = [w / sum(weights) for w in weights]
    basis = weighted("close", shares)
    off = F.zip_with(F.collect_list("close").over(last(bars)), F.array(*[F.lit(w) for w in shares]), lambda a, b: F.abs(a - basis) * b)
    return ready(bars + 1, basis - factor * F.aggregate(off, F.lit(0.0), lambda a, x: a + x))


def volume_flow(n: int = 50, noise: int = 30, cutoff: float = 0.2, most: float = 3.0, step: str = "log_step") -> Column:
    """Volume (at most `most` means) signed by moves of the typical price beyond `cutoff` standard moves, summed over n bars in parts of the mean volume. step: the log change of the typical price."""
    sigma = F.sqrt(F.sum(F.col(step) * F.col(step)).over(last(noise)) / noise)
    mean = F.avg("volume").over(before(n))
    bars = F.collect_list(F.struct(F.col(step).alias("d"), F.col("volume").alias("v"))).over(last(n))
    signed = F.transform(bars, lambda b: F.when(b["d"] > cutoff * sigma, F.least(b["v"], most * mean)).when(b["d"] < -cutoff * sigma, -F.least(b["v"], most * mean)).otherwise(0.0))
    return ready(n + noise + 1, F.when((mean != 0) & (sigma != 0), F.aggregate(signed, F.lit(0.0), lambda a, x: a + x) / mean))


def log_step() -> Column:
    past = F.lag("typical").over(series())
    return F.when((past > 0) & (F.col("typical") > 0), F.ln(F.col("typical") / past)).otherwise(0.0)


def squeeze(need: int = 42) -> dict[str, Column]:
    """Whether the 2-deviation bands lie inside the 1.5-ATR channel, and the close's distance from the middle of range and mean, now and a bar ago."""
    bands, size, middle = bollinger(20), atr(20), weighted("close", seeded_weights(20, 40))
    on = (bands["bb_lower"] > middle - 1.5 * size) & (bands["bb_upper"] < middle + 1.5 * size)
    push = F.col("close") - ((F.max("high").over(last(20)) + F.min("low").over(last(20))) / 4 + F.avg("close").over(last(20)) / 2)
    return {"squeeze_on": ready(need, F.when((size != 0) & (middle != 0), on)), "squeeze_push": ready(need, push)}


def widening(width: str = "bb_width", bars: int = 24, least: int = 12) -> Column:
    """Whether a width grows by 15 % after having lately been in its lowest quarter, of at least `least` known ones before."""
    past = F.collect_list(width).over(before(bars))
    low = F.array_min(F.slice(past, -F.lit(least), least))
    quarter = F.element_at(F.array_sort(past), (F.bround((F.size(past) - 1) * F.lit(0.25)) + 1).cast("int"))
    prev = F.lag(width).over(series())
    return F.coalesce(F.when(F.size(past) >= least, (F.col(width) >= prev * 1.15) & (low <= quarter)), F.lit(False))


def entry_shape() -> dict[str, Column]:
    """Of the bar and its trend: ATR against five bars ago, the lead of the plus side, lower wick and close in parts of the range. Needs plus_di, minus_di and atr_14."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    old = F.lag("atr_14", 5).over(series())
    return {
        "di_gap": F.col("plus_di") - F.col("minus_di"), "atr_expansion_5": F.when((F.col("atr_14") != 0) & (old != 0), F.col("atr_14") / old),
        "lower_wick_ratio": (F.least("open", "close") - F.col("low")) / span, "close_position": (F.col("close") - F.col("low")) / span,
    }


def sweep_reclaim(bars: int = 20, size: str = "atr_14", need: int = 91) -> Column:
    """A low well under those of the bars before, a close back above them in a rising bar with a long lower wick."""
    floor, body = F.min("low").over(before(bars)), F.abs(F.col("close") - F.col("open"))
    wick = F.least("open", "close") - F.col("low")
    return F.coalesce(ready(need, (F.col("low") < floor - 0.10 * F.col(size)) & (F.col("close") > floor) & (F.col("close") > F.col("open")) & (wick >= F.greatest(body * 1.5, 0.10 * F.col(size)))), F.lit(False))


def radar_state(need: int = 55) -> Column:
    """Averages of 9, 21 and 50 in order under the close, the shortest rising. Needs the recursive averages."""
    fast = F.col("ema_9_r")
    return F.coalesce(ready(need, (F.col("close") > fast) & (fast > F.col("ema_21_r")) & (F.col("ema_21_r") > F.col("ema_50_r")) & (fast > F.lag(fast).over(series()))), F.lit(False))


def hour_move(threshold: float = 0.20) -> Column:
    """'confirmed' where the close, 'wick_only' where only the high is `threshold` above the open."""
    base = F.nullif(F.col("open"), F.lit(0.0))
    return F.when(F.col("close") / base - 1 >= threshold, "confirmed").when(F.col("high") / base - 1 >= threshold, "wick_only")


def observed_regime(ret: Column, rsi: Column, gap: Column) -> Column:
    """What a series did before an event: ret in percent over 15 minutes, gap of the short over the middle average."""
    return F.when((ret <= -1) & (F.coalesce(rsi, F.lit(100.0)) <= 40), "dip_reversal").when((ret >= 1) & (F.coalesce(gap, F.lit(0.0)) > 0), "trend_continuation").otherwise("other")


def delta(c: str) -> Column:
    """The change of a number since the row before; null if either is unknown."""
    return F.col(c) - F.lag(c).over(series())
