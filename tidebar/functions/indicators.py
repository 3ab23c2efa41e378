"""Window indicators as columns. Each is null until it has the bars it needs; a flat or empty window has the value stated there.

`prepare` adds the columns that several share (all on one window of the series, sorted once); the functions then make a Column each.
Rolling frames are bounded, so that a long series needs one sort and a small buffer.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ("symbol", "timeframe")


def series():
    return Window.partitionBy(*SERIES).orderBy("open_time")


def last(n: int):
    return series().rowsBetween(1 - n, 0)


def before(n: int):
    """The n bars before this one."""
    return series().rowsBetween(-n, -1)


def ready(n: int, value: Column) -> Column:
    return F.when(F.col("bar") >= n, value)


def ratio(a: Column, b: Column, otherwise=None) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(otherwise).cast("double"))


def prepare(candles: DataFrame) -> DataFrame:
    """bar (1, 2, ...), prev_close, change, tr, typical, flow_up, flow_down, dm_up, dm_down, body_sign, obv_step."""
    w = series()
    lag = lambda c: F.lag(c).over(w)
    out = candles.withColumns({"bar": F.row_number().over(w), "prev_close": lag("close"), "_ph": lag("high"), "_pl": lag("low"), "typical": (F.col("high") + F.col("low") + F.col("close")) / 3})
    out = out.withColumns({"change": F.col("close") - F.col("prev_close"), "_pt": (F.col("_ph") + F.col("_pl") + F.col("prev_close")) / 3, "_up": F.col("high") - F.col("_ph"), "_down": F.col("_pl") - F.col("low")})
    flow = F.col("typical") * F.col("volume")
    return out.withColumns({
        "tr": F.when(F.col("prev_close").isNotNull(), F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("prev_close")), F.abs(F.col("low") - F.col("prev_close")))),
        "flow_up": F.when(F.col("typical") > F.col("_pt"), flow).otherwise(0.0), "flow_down": F.when(F.col("typical") < F.col("_pt"), flow).otherwise(0.0),
        "dm_up": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0), "dm_down": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0),
        "body_sign": F.signum(F.col("close") - F.col("open")), "obv_step": F.coalesce(F.signum("change") * F.col("volume"), F.lit(0.0)),
    }).drop("_ph", "_pl", "_pt", "_up", "_down")


def sma(c: str, n: int) -> Column:
    return ready(n, F.avg(c).over(last(n)))


def macd_finite(line: str = "macd_f_line", signal: int = 9, need: int = 35) -> dict[str, Column]:
    """Signal and histogram of a line of finite averages (12 less 26) in a column."""
    s = ema_finite(line, signal)
    return {"macd_f_signal": ready(need, s), "macd_f_hist": ready(need, F.col(line) - s)}


def ut_whole(n: int = 11, factor: float = 1.0, window: int = 250, need: int = 16) -> Column:
    """'buy' or 'sell' where the smoothed close crosses its trailing stop, with the stop worked out anew at each bar over the last `window` bars and this bar's mean range."""
    gap = factor * F.avg("tr").over(last(n))
    closes = F.collect_list((F.col("open") + F.col("high") + F.col("low") + F.col("close")) / 4).over(last(window))
    start = F.struct(F.lit(None).cast("double").alias("was"), F.lit(None).cast("double").alias("held"), F.lit(None).cast("double").alias("close"), F.lit(None).cast("double").alias("stop"))

    def step(at: Column, c: Column) -> Column:
        stop = F.when(at["stop"].isNull(), c - gap).when((c > at["stop"]) & (at["close"] > at["stop"]), F.greatest(at["stop"], c - gap)).when((c < at["stop"]) & (at["close"] < at["stop"]), F.least(at["stop"], c + gap)).when(c > at["stop"], c - gap).otherwise(c + gap)
        return F.struct(at["close"].alias("was"), at["stop"].alias("held"), c.alias("close"), stop.alias("stop"))

    def said(at: Column) -> Column:
        return F.when((at["close"] > at["stop"]) & (at["was"] <= at["held"]), "buy").when((at["close"] < at["stop"]) & (at["was"] >= at["held"]), "sell")

    return ready(need, F.when(gap > 0, F.aggregate(closes, start, step, said)))


def ema_finite(c: str, n: int) -> Column:
    """Weights exp(-k / (n - 1)) for the bar k ago, k < n."""
    weights = [exp(-k / (n - 1)) if n > 1 else 1.0 for k in range(n)]
    total = sum(weights)
    # One frame, one pass: the newest bar is the last of the collected window.
    window = F.collect_list(c).over(last(n))
    return ready(n, F.aggregate(F.zip_with(window, F.array(*[F.lit(x / total) for x in reversed(weights)]), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x))


def bollinger(n: int = 20, k: float = 2.0, c: str = "close") -> dict[str, Column]:
    mid, dev = F.avg(c).over(last(n)), F.stddev_pop(c).over(last(n))
    upper, lower = mid + k * dev, mid - k * dev
    return {"bb_upper": ready(n, upper), "bb_middle": ready(n, mid), "bb_lower": ready(n, lower), "bb_width": ready(n, ratio(upper - lower, mid)), "bb_position": ready(n, ratio(F.col(c) - lower, upper - lower))}


def rsi_simple(n: int = 14) -> Column:
    gain, loss = F.avg(F.greatest("change", F.lit(0.0))).over(last(n)), F.avg(F.greatest(-F.col("change"), F.lit(0.0))).over(last(n))
    return ready(n + 1, F.when(loss == 0, F.when(gain > 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + gain / loss)))


def atr(n: int = 14) -> Column:
    return ready(n + 1, F.avg("tr").over(last(n)))


def atr_before(n: int = 14) -> Column:
    """Over the n bars before this one."""
    return ready(n + 2, F.avg("tr").over(before(n)))


def raw_stochastic(n: int = 14) -> Column:
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return ready(n, F.when(hi == lo, 50.0).otherwise((F.col("close") - lo) / (hi - lo) * 100))


def stochastic(n: int = 14, smooth: int = 3, raw: str = "stoch_raw") -> dict[str, Column]:
    """From raw_stochastic(n) in column raw: %K is the mean of the last `smooth`, %D of the `smooth` before these (of the same where these are all)."""
    k = F.avg(raw).over(last(smooth))
    d = F.avg(raw).over(series().rowsBetween(1 - 2 * smooth, -smooth))
    return {"stoch_k": ready(n + smooth - 1, k), "stoch_d": ready(n + smooth - 1, F.when(F.col("bar") >= n + 2 * smooth - 1, d).otherwise(k))}


def cmo(n: int = 9) -> Column:
    up, down = F.sum(F.greatest("change", F.lit(0.0))).over(last(n)), F.sum(F.greatest(-F.col("change"), F.lit(0.0))).over(last(n))
    return ready(n + 1, ratio(100 * (up - down), up + down, 0.0))


def obv() -> dict[str, Column]:
    """On-balance volume and its change over the last four steps."""
    return {"obv": ready(2, F.sum("obv_step").over(series().rowsBetween(Window.unboundedPreceding, 0))), "obv_slope": ready(2, F.sum(F.when(F.col("bar") > 2, F.col("obv_step")).otherwise(0.0)).over(last(4)))}


def mfi(n: int = 14) -> Column:
    up, down = F.sum("flow_up").over(last(n)), F.sum("flow_down").over(last(n))
    return ready(n + 1, F.when(down != 0, 100 - 100 / (1 + up / down)).otherwise(100.0))


def dx(n: int = 14, least: int | None = None) -> dict[str, Column]:
    """DX and the directional indicators, from plain means over n bars."""
    size = F.avg("tr").over(last(n))
    up, down = ratio(100 * F.avg("dm_up").over(last(n)), size, 0.0), ratio(100 * F.avg("dm_down").over(last(n)), size, 0.0)
    need = 2 * n + 1 if least is None else least
    return {"dx": ready(need, ratio(100 * F.abs(up - down), up + down, 0.0)), "plus_di": ready(need, up), "minus_di": ready(need, down)}


def cci(n: int = 20) -> Column:
    mean = F.avg("typical").over(last(n))
    off = F.aggregate(F.collect_list("typical").over(last(n)), F.lit(0.0), lambda a, x: a + F.abs(x - mean)) / n
    return ready(n, ratio(F.col("typical") - mean, 0.015 * off, 0.0))


def awesome(fast: int = 5, slow: int = 34) -> Column:
    median = (F.col("high") + F.col("low")) / 2
    return ready(slow, F.avg(median).over(last(fast)) - F.avg(median).over(last(slow)))


def williams_r(n: int = 14) -> Column:
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return ready(n, ratio((hi - F.col("close")) * -100, hi - lo, -50.0))


def ultimate(periods: tuple[int, int, int] = (7, 14, 28)) -> Column:
    low = F.least("low", "prev_close")
    press, span = F.col("close") - low, F.greatest("high", "prev_close") - low
    part = [ratio(F.sum(press).over(last(p)), F.sum(span).over(last(p)), 0.5) for p in periods]
    return ready(max(periods) + 1, 100 * (4 * part[0] + 2 * part[1] + part[2]) / 7)


def vwap(n: int = 20, price: str = "typical") -> Column:
    """Volume-weighted mean of the typical price (or of the close: VWMA)."""
    return ready(n, ratio(F.sum(F.col(price) * F.col("volume")).over(last(n)), F.sum("volume").over(last(n))))


def midpoint(n: int = 26) -> Column:
    """Half-way between the highest and the lowest of n bars: the Ichimoku base line, the middle of a Donchian channel."""
    return ready(n, (F.max("high").over(last(n)) + F.min("low").over(last(n))) / 2)


def donchian(n: int = 20) -> dict[str, Column]:
    hi, lo = F.max("high").over(last(n)), F.min("low").over(last(n))
    return {"donchian_upper": ready(n, hi), "donchian_lower": ready(n, lo), "donchian_position": ready(n, ratio(F.col("close") - lo, hi - lo))}


def keltner(n: int = 20, k: float = 2.0, middle: Column | None = None) -> dict[str, Column]:
    mid = sma("close", n) if middle is None else middle
    return {"keltner_upper": mid + k * atr(14), "keltner_lower": mid - k * atr(14)}


def volume_ratio(n: int = 20, own: bool = False) -> Column:
    """Volume against the mean of the n bars before (own: of the last n)."""
    mean = F.avg("volume").over(last(n) if own else before(n))
    return ready(n if own else n + 1, F.when(mean > 0, F.col("volume") / mean))


def flow_proxy(n: int = 20) -> Column:
    """Volume-weighted close location and body direction, in [-1, 1]."""
    span = F.greatest(F.col("high") - F.col("low"), F.lit(1e-12))
    press = F.col("volume") * (0.7 * (2 * F.col("close") - F.col("high") - F.col("low")) / span + 0.3 * F.col("body_sign"))
    total = F.sum("volume").over(last(n))
    return ready(n, F.when(total != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(press).over(last(n)) / total))))


def choppiness(n: int = 14) -> Column:
    span = F.max("high").over(last(n)) - F.min("low").over(last(n))
    return ready(n + 1, F.when(span > 0, 100 * F.log10(F.sum("tr").over(last(n)) / span) / F.log10(F.lit(float(n)))).otherwise(100.0))


def chaikin_flow(n: int = 20) -> Column:
    span = F.col("high") - F.col("low")
    part = ratio(2 * F.col("close") - F.col("high") - F.col("low"), span, 0.0) * F.col("volume")
    return ready(n, ratio(F.sum(part).over(last(n)), F.sum("volume").over(last(n)), 0.0))


def change_over(n: int) -> Column:
    """close / close n bars ago - 1."""
    past = F.lag("close", n).over(series())
    return F.when(past != 0, F.col("close") / past - 1)


def poc_distance(n: int = 20) -> Column:
    """Distance of the close from that of the bar with most volume in n bars, the first of equals."""
    poc = F.max_by("close", F.struct(F.col("volume"), -F.col("open_time"))).over(last(n))
    return ready(n, ratio(F.col("close") - poc, poc))


def fractal_low() -> Column:
    """Whether the low two bars ago is the lowest of the last five: a fractal, confirmed."""
    return F.coalesce(ready(5, F.lag("low", 2).over(series()) == F.min("low").over(last(5))), F.lit(False))


def flat_share(n: int, least: float) -> Column:
    """Bars of the last n whose range is at most `least` percent of the low."""
    return ready(n, F.sum(F.when((F.col("high") - F.col("low")) * 100 <= least * F.col("low"), 1).otherwise(0)).over(last(n)))


def zscore(c: str, n: int) -> Column:
    dev = F.stddev_pop(c).over(before(n))
    return ready(n + 1, F.when(dev > 1e-12, (F.col(c) - F.avg(c).over(before(n))) / dev).otherwise(0.0))


def with_streak(df: DataFrame) -> DataFrame:
    """streak: bars since closes began to rise (positive) or fall (negative); 0 on an equal close. Islands of equal direction."""
    w = series()
    sign = F.coalesce(F.signum("change"), F.lit(0.0)).cast("int")
    out = df.withColumn("_s", sign).withColumn("_new", F.when(F.coalesce(F.lag("_s").over(w), F.lit(-9)) != F.col("_s"), 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("streak", F.col("_s") * F.row_number().over(Window.partitionBy(*SERIES, "_run").orderBy("open_time"))).drop("_s", "_new", "_run")


def connors_rsi(rsi: int = 3, rank: int = 100) -> Column:
    """Of simple RSI, the RSI of the last two streaks, and the share of the `rank` changes before that are smaller. Needs `streak`."""
    up, down = F.sum(F.greatest("streak", F.lit(0))).over(last(2)), F.sum(F.greatest(-F.col("streak"), F.lit(0))).over(last(2))
    streaks = F.when(down == 0, F.when(up != 0, 100.0).otherwise(50.0)).otherwise(100 - 100 / (1 + up / down))
    past = F.collect_list("change").over(series().rowsBetween(1 - rank, -1))
    smaller = F.aggregate(past, F.lit(0.0), lambda a, x: a + F.when(x < F.col("change"), 1.0).otherwise(0.0))
    return ready(rank + rsi + 2, (rsi_simple(rsi) + streaks + 100 * smaller / (rank - 1)) / 3)


def pivots(high: Column, low: Column, close: Column) -> dict[str, Column]:
    """Levels from the bar before: R1-R3 and S1-S3 as the reference tables define them, and Fibonacci ones."""
    p, span = (high + low + close) / 3, high - low
    out = {"r3": 2 * p - 2 * low, "r2": p + span, "r1": 2 * p - low, "p": p, "s1": 2 * p - high, "s2": p - span, "s3": 2 * p - 2 * high}
    return out | {f"f_{'r' if k > 0 else 's'}{i}": p + k * f * span for i, f in ((1, 0.382), (2, 0.618), (3, 1.0)) for k in (1, -1)}


def bucket(value: Column, buy: float, strong_buy: float, sell: float, strong_sell: float) -> Column:
    """A signal word; thresholds are tried in the order strong buy, buy, strong sell, sell."""
    return F.when(value.isNull(), "unknown").when(value >= strong_buy, "strong_buy").when(value >= buy, "buy").when(value <= strong_sell, "strong_sell").when(value <= sell, "sell").otherwise("neutral")


def snapshot(candles: DataFrame) -> DataFrame:
    """candles with the whole set of window indicators."""
    df = with_streak(prepare(candles)).withColumn("stoch_raw", raw_stochastic(14)).withColumn("rsi_14", rsi_simple(14))
    lo, hi = F.min("rsi_14").over(last(14)), F.max("rsi_14").over(last(14))
    df = df.withColumn("_sr", ready(28, F.when(hi == lo, 50.0).otherwise((F.col("rsi_14") - lo) / (hi - lo) * 100))).withColumn("_srk", ready(30, F.avg("_sr").over(last(3))))
    df = df.withColumns({
        **bollinger(), **stochastic(), **obv(), **dx(), **donchian(), **keltner(),
        "sma_9": sma("close", 9), "sma_20": sma("close", 20), "sma_50": sma("close", 50), "atr_14": atr(14), "cmo_9": cmo(9), "mfi_14": mfi(14), "cci_20": cci(20), "ao": awesome(), "williams_r": williams_r(), "ultimate": ultimate(),
        "vwap_20": vwap(20), "vwma_20": vwap(20, "close"), "base_26": midpoint(26), "volume_ratio": volume_ratio(20), "flow_proxy": flow_proxy(20), "chop": choppiness(14), "cmf_20": chaikin_flow(20), "crsi": connors_rsi(),
        "ema_9": ema_finite("close", 9), "ema_21": ema_finite("close", 21), "ema_50": ema_finite("close", 50), "return_1": change_over(1), "return_3": change_over(3), "return_12": change_over(12), "return_5": change_over(5), "return_20": change_over(20), "return_21": change_over(21), "atr_20": atr(20), "ema_20_f": ema_finite("close", 20), "mfi_16": mfi(16), "bb21_lower": bollinger(21)["bb_lower"], "bb21_upper": bollinger(21)["bb_upper"],
        "poc_distance": poc_distance(20), "fractal_low": fractal_low(), "stoch_rsi_k": ready(34, F.col("_srk")), "stoch_rsi_d": ready(34, F.avg("_srk").over(last(3))),
    })
    return df.withColumns({"adx": ready(28, F.avg("dx").over(last(14))), "atr_pct": ratio(F.col("atr_14"), F.col("close")), "macd_f_line": ema_finite("close", 12) - ema_finite("close", 26)}).withColumns({"macd_finite": ready(35, F.col("macd_f_line")), **macd_finite()}).drop("_sr", "_srk", "stoch_raw")
