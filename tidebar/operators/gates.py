"""Gates and scores on bars, books and plans: each says yes or no, and why not. What is unknown closes a gate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import last, ready, series
from ..sources.market import kline_max_age


def closed_if_null(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def reasons(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail or can't be told, in order."""
    return F.array_compact(F.array(*[F.when(~closed_if_null(ok), F.lit(name)) for name, ok in checks.items()]))


@dataclass(frozen=True)
class Liquid:
    """Ages in milliseconds, money in the quote currency, the spread in percent."""

    ticker_age: int = 15_000
    book_age: int = 5_000
    day_age: int = 30_000
    bars: int = 21
    least_volume: float = 1_000_000.0
    high_volume: float = 3_000_000.0
    least_ratio: float = 0.3
    most_spread: float = 0.30
    depth: float = 5.0
    warm: int = 20_000


def liquidity(df: DataFrame, now_ms: int, order_value: float, timeframe: str = "5m", limits: Liquid = Liquid(), started_ms: int | None = None) -> DataFrame:
    """df (ticker_ms, last_price; kline_ms, bars, volume, mean_volume of the 20 bars before; book_ms, bid_qty, ask_qty, spread_pct; day_ms, quote_volume) with missing_or_stale, volume_ratio, the failed checks and whether
    none has failed.

    Everything must be known and fresh; the day's volume large enough; the bar's volume at least a share of the mean, unless the day's is very large; the spread narrow; both sides of the book together worth several
    orders. What is unknown counts as 0 or fails. With started_ms, inputs that are missing in the first seconds after it are passed over, and so are the checks that rest on them.
    """
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    fresh = lambda c, age: closed_if_null(F.lit(now_ms) - F.col(c) <= age)
    ok = {
        "ticker": fresh("ticker_ms", limits.ticker_age), "kline": fresh("kline_ms", kline_max_age(timeframe)) & (zero("bars") >= limits.bars),
        "orderbook": fresh("book_ms", limits.book_age) & (zero("bid_qty") > 0) & (zero("ask_qty") > 0) & F.col("spread_pct").isNotNull(), "ticker_24h": fresh("day_ms", limits.day_age) & (zero("quote_volume") > 0),
    }
    out = df.withColumn("missing_or_stale", reasons(ok))
    early = F.lit(started_ms is not None and now_ms - started_ms <= limits.warm)
    excused = lambda *names: early & F.arrays_overlap("missing_or_stale", F.array(*[F.lit(n) for n in names]))
    ratio = F.when((zero("mean_volume") > 0) & (zero("bars") >= limits.bars), zero("volume") / zero("mean_volume")).otherwise(0.0)
    high = zero("quote_volume") >= limits.high_volume
    checks = {
        "fresh_inputs": (F.size("missing_or_stale") == 0) | early, "quote_volume": excused("ticker_24h") | (zero("quote_volume") >= limits.least_volume), "volume_ratio": excused("kline") | high | (F.col("volume_ratio") >= limits.least_ratio),
        "spread": excused("orderbook") | (F.col("spread_pct") <= limits.most_spread), "orderbook_depth": excused("ticker", "orderbook") | ((zero("bid_qty") + zero("ask_qty")) * zero("last_price") >= order_value * limits.depth),
    }
    out = out.withColumns({"volume_ratio": ratio, "high_liquidity": high})
    return out.withColumn("liquidity_reasons", reasons(checks)).withColumn("liquid", F.size("liquidity_reasons") == 0)


def microstructure_flags(spread: float = 0.003, imbalance: float = 0.35) -> Column:
    return F.array_compact(F.array(F.when(F.col("spread_pct") > spread, "wide_spread"), F.when(F.col("orderflow_imbalance") > imbalance, "bid_pressure"), F.when(F.col("orderflow_imbalance") < -imbalance, "ask_pressure"), F.when(F.col("bid_qty").isNull() | F.col("ask_qty").isNull(), "book_missing")))


def quality_score() -> Column:
    """log10 of the quote volume + ATR % up to 3 + volume ratio up to 3 - twice the spread %."""
    return F.log10(F.greatest(F.col("quote_volume"), F.lit(1.0))) + F.least(F.col("atr_pct") * 100, F.lit(3.0)) + F.least(F.coalesce("volume_ratio", F.lit(0.0)), F.lit(3.0)) - 2 * F.coalesce("spread_pct", F.lit(0.0)) * 100


def activity(prepared: DataFrame, flat: float = 0.05, short: int = 5, long: int = 30, most: float = 0.6, least_range: float = 0.3, warm: int = 30) -> DataFrame:
    """WARMING until there are `warm` bars; PASSIVE where too many of the last bars are flat or three bars hardly move; else ACTIVE."""
    quiet = F.when((F.col("high") - F.col("low")) * 100 <= flat * F.col("low"), 1).otherwise(0)
    lo = F.min("low").over(last(3))
    out = prepared.withColumns({f"flat_{short}": F.sum(quiet).over(last(short)), f"flat_{long}": F.sum(quiet).over(last(long)), "range_3": F.when(lo > 0, (F.max("high").over(last(3)) - lo) / lo * 100)})
    passive = (F.col(f"flat_{long}") > most * long) | (F.col(f"flat_{short}") == short) | (F.col("range_3") < least_range)
    return out.withColumn("activity", F.when(F.col("bar") < warm, "WARMING").when(F.coalesce(passive, F.lit(True)), "PASSIVE").otherwise("ACTIVE"))


def compressed(n: int = 12, share: float = 0.6) -> Column:
    """Whether the last n bars' range is at most a share of that of the n before."""
    w = series()
    now = F.max("high").over(last(n)) - F.min("low").over(last(n))
    past = w.rowsBetween(-2 * n + 1, -n)
    return ready(2 * n, now <= share * (F.max("high").over(past) - F.min("low").over(past)))


def bear_pressure(adx: float = 50, gap: float = 25, hour: float = 0.50, quarter: float = 0.50) -> Column:
    """A sell-off (returns in percent over 12 and 3 bars) in a strong trend led by the minus side. Unknown: no."""
    return closed_if_null((F.col("dx") >= adx) & (F.col("minus_di") - F.col("plus_di") >= gap) & (F.col("return_12") <= -hour / 100) & (F.col("return_3") <= -quarter / 100))


def entry_block(place: float = 0.60, reversal: float = 1.0, flow: str = "mfi_16", flow_bars: int = 16, data_ready: Column | None = None, alignment: Column | None = None) -> Column:
    """Why a reversal entry is blocked, null if it isn't: data that aren't ready; against falling averages also a close too low in its bar or a money flow that hasn't turned up."""
    usable = F.col("bar") >= 55 if data_ready is None else data_ready
    falling = (F.col("ema_9") < F.col("ema_21")) & (F.col("ema_21") < F.col("ema_50")) if alignment is None else alignment == "bearish"
    own = F.when(F.col("high") > F.col("low"), (F.col("close") - F.col("low")) / (F.col("high") - F.col("low"))).otherwise(0.0)
    turned = F.col(flow) >= F.lag(flow).over(series()) + reversal
    checks = F.when(F.col("bar") < flow_bars + 2, "bearish_reversal_data_insufficient").when(own < place, "bearish_reversal_candle_unconfirmed").when(~closed_if_null(turned), "bearish_reversal_mfi_unconfirmed")
    return F.when(~closed_if_null(usable), "technical_data_not_ready").when(closed_if_null(falling), checks)


FRAMES = ("1m", "5m", "15m", "1h", "4h")
MODES = ("bullish-count", "all-5", "all-5-volume-flow", "acetry-rule", "acetry-rule-relaxed", "high-tf", "score")


def mtf_gate(mode: str, frames: str = "tf") -> Column:
    """Whether features of five timeframes allow an entry. frames: a map from each of FRAMES to a struct with alignment ('bullish', 'bearish', 'mixed'), radar_bullish,
    volume_ratio_20, orderflow_proxy_20, rsi_14, atr_pct, bb_width_pct and bb_position. What is unknown counts against it."""
    of = lambda f, c: F.col(frames)[f][c]
    says = lambda f, *words: closed_if_null(of(f, "alignment").isin(*words))
    some = lambda checks: sum((F.when(x, 1).otherwise(0) for x in checks), F.lit(0))
    every = lambda checks: some(checks) == len(checks)
    bullish = some([says(f, "bullish") for f in FRAMES])
    radar = every([closed_if_null(of(f, "radar_bullish")) for f in FRAMES])
    high = says("1h", "bullish") & ~says("15m", "mixed")
    # The strict and the relaxed limits of RSI, ATR and band width.
    rsi, atr, width = (45, 0.0005, 0.005) if mode == "acetry-rule-relaxed" else (40, 0.00866, 0.03830)
    rule = every([closed_if_null(of("1m", "rsi_14") < rsi), closed_if_null(of("1m", "atr_pct") >= atr), closed_if_null(of("1m", "bb_width_pct") >= width), says("1h", "bullish"), says("4h", "bullish", "mixed")]) & (bullish >= 2)
    weights = {2: [high], 1: [says("15m", "bullish"), closed_if_null(of("5m", "atr_pct") >= 0.0034), closed_if_null(of("5m", "bb_position") <= 0.145)], -2: [says("1m", "mixed"), says("15m", "mixed") | says("1h", "mixed")]}
    score = sum((w * some(checks) for w, checks in weights.items()), F.lit(0))
    busy = every([closed_if_null(of(f, "volume_ratio_20") >= 1.0) & closed_if_null(of(f, "orderflow_proxy_20") >= 0.0) for f in ("1m", "5m")])
    return {"bullish-count": bullish >= 3, "all-5": radar, "all-5-volume-flow": radar & busy, "acetry-rule": rule, "acetry-rule-relaxed": rule, "high-tf": high, "score": score >= 2}[mode]


def plan_problems() -> Column:
    """What is wrong with a long trade plan (entry, stop, target, quantity, cash)."""
    return reasons({"no_quantity": F.col("quantity") > 0, "stop_not_below_entry": F.col("stop") < F.col("entry"), "target_not_above_entry": F.col("target") > F.col("entry"), "not_enough_cash": F.col("entry") * F.col("quantity") <= F.col("cash"), "reward_below_risk": (F.col("target") - F.col("entry")) >= (F.col("entry") - F.col("stop"))})


def order_value(cash: Column, share: float = 0.10, least: float = 100.0, fallback: float = 250.0, commission: float = 0.0015, ladder: bool = True) -> Column:
    """A share of the cash that is left after commission; with the ladder, below the least partial order the fallback order if there is cash for it, else all there is if that is a partial order."""
    free = cash / (1 + commission)
    own = free * max(0.001, min(share, 1.0))
    return F.when((own >= least) | F.lit(not ladder), own).when(free >= fallback, F.lit(fallback)).when(free >= least, free).otherwise(own)


def adr_capacity(days: int = 14, least: float = 0.02, left: float = 0.01, most: float = 0.80) -> dict[str, Column]:
    """Over daily bars, the last still open: the mean range of the days before in parts of their closes, how far the price is from today's open, the share used, and whether an entry still
    fits (yes while there are too few days or no open)."""
    own = F.when(F.col("close") > 0, (F.col("high") - F.col("low")) / F.col("close"))
    known = (F.count(own).over(series().rowsBetween(-days, -1)) == days) & (F.col("open") > 0)
    mean = F.avg(own).over(series().rowsBetween(-days, -1))
    moved = F.when(F.col("close") > 0, F.greatest("close", "open") / F.least("close", "open") - 1).otherwise(0.0)
    share = F.when(mean > 0, moved / mean).otherwise(1.0)
    fits = (mean >= least) & (mean - moved >= left) & (share <= most)
    return {"adr_pct": F.when(known, mean), "range_pct": F.when(known, moved), "utilization": F.when(known, share), "adr_ok": F.when(known, fits).otherwise(True)}


def quiet_score() -> Column:
    """How idle a series is, 0 to 1: flat bars, little range, little volume."""
    return F.least(F.lit(1.0), 0.5 * F.col("flat_30") / 30 + 0.3 * F.when(F.coalesce("range_3", F.lit(0.0)) < 0.3, 1.0).otherwise(0.0) + 0.2 * F.when(F.coalesce("volume_ratio", F.lit(0.0)) < 0.5, 1.0).otherwise(0.0))
