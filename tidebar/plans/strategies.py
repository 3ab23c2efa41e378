"""Rule strategies: buy and sell as boolean columns over one frame of features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import before, bollinger, last, mfi, ready, series, snapshot, ut_whole, volume_ratio
from ..functions.patterns import candlesticks, fair_value_gap, price_action, with_methodology, with_structure, with_td9, with_wicks
from ..functions.recursive import recursive
from ..operators.gates import bear_pressure


def features(candles: DataFrame) -> DataFrame:
    """candles with window, recursive, pattern and structure features."""
    df = snapshot(candles)
    df = with_methodology(with_structure(with_wicks(with_td9(df))))
    df = df.withColumns({**fair_value_gap(), "patterns": candlesticks(), "price_action": price_action(), "ut_whole": ut_whole(), "atr_stop": F.max("close").over(last(22)) - 3 * F.col("atr_14")})
    return df.join(recursive(candles), ["symbol", "timeframe", "open_time"])


def at(c: str, k: int = 1) -> Column:
    return F.lag(c, k).over(series())


def bb_mfi(candles_prepared: DataFrame, std: float = 2.0, bb: int = 21, flow: int = 16, entry_mfi: float = 59, exit_mfi: float = 69, exit_rsi: float = 69, rsi: str = "rsi_wilder", volume: float = 0.0) -> DataFrame:
    """The band and money-flow rule, third version: signal is 'buy' under the lower band with little money flow, 'sell' over the upper one with much."""
    bands = bollinger(bb, std)
    out = candles_prepared.withColumns({"_upper": bands["bb_upper"], "_lower": bands["bb_lower"], "_mfi": mfi(flow), "_vr": F.coalesce(volume_ratio(20), F.lit(0.0))})
    buy = (F.col("close") < F.col("_lower")) & (F.col("_mfi") < entry_mfi) & (F.col("_vr") >= volume)
    sell = (F.col("close") > F.col("_upper")) & (F.col("_mfi") > exit_mfi) & (F.col(rsi) > exit_rsi if rsi else F.lit(True))
    return out.withColumn("signal", F.when(buy, "buy").when(sell, "sell")).drop("_upper", "_lower", "_mfi", "_vr")


@dataclass(frozen=True)
class Levels:
    """The thresholds of the rules."""

    squeeze_width: float = 1.1
    squeeze_volume: float = 1.5
    pullback_rsi: tuple[float, float] = (40, 55)
    cmo_deep: float = 63
    crsi_low: float = 30
    pullback_adx: float = 18
    pullback_volume: float = 1.0
    pullback_touch: float = 1.002
    breakout_volume: float = 1.5
    flow: float = 0.10
    momentum_return: float = 0.003
    momentum_volume: float = 1.0
    momentum_adx: float = 18
    careful_return: float = 0.004
    careful_volume: float = 1.2
    careful_adx: float = 22
    score: int = 7
    close_place: float = 0.65
    reach_atr: float = 2.0
    oversold_rsi: float = 40
    adaptive_adx: float = 20
    adaptive_atr: tuple[float, float] = (0.0015, 0.012)
    gate_adx: float = 25
    gate_return: float = 0.01
    gate_volume: float = 1.1
    keltner_atr: float = 1.8
    keltner_volume: float = 1.5
    keltner_flow: float = 0.05
    keltner_retest: float = 1.001
    chop: float = 45
    chop_rsi: float = 52
    donchian_volume: float = 1.15
    dip_place: float = 0.55
    v1_rsi: tuple[float, float] = (30, 70)
    v2_rsi: tuple[float, float] = (42, 76)
    v3_mfi: tuple[float, float] = (59, 69)
    v3_rsi: float = 69


def rules(levels: Levels = Levels(), aligned: Column | None = None, book_flow: Column | None = None) -> dict[str, tuple[Column, Column]]:
    """name -> (buy, sell) over features(); a rule whose inputs are unknown doesn't hold.

    aligned: whether the next higher timeframe's averages rise, where known; book_flow: whether the order book leans to buyers. Without them, as in a replay of candles
    alone, the first is taken to hold and the flow proxy of the candles stands for the second where the rule needs one at all.
    """
    v, c, no, yes = levels, F.col, F.lit(False), F.lit(True)
    higher = yes if aligned is None else aligned
    optional = yes if book_flow is None else book_flow
    flow = lambda least: F.coalesce(c("flow_proxy"), F.lit(0.0)) >= least if book_flow is None else book_flow
    from_bar = lambda n: c("bar") >= n
    prev = at("close")
    rising, trend = c("close") > prev, (c("ema_9") > c("ema_21")) & (c("ema_21") > c("ema_50"))
    place = F.when(c("high") > c("low"), (c("close") - c("low")) / (c("high") - c("low"))).otherwise(0.0)
    squeezed = (c("bb_width") <= v.squeeze_width * F.min(F.when(c("bar") >= 21, c("bb_width"))).over(before(19))) & (c("volume") > v.squeeze_volume * F.avg("volume").over(last(10)))
    squeeze = squeezed & (c("close") > c("bb_upper"))
    points = [
        (trend, 2), ((c("return_5") >= v.momentum_return) & (c("return_20") > 0), 1), (c("volume_ratio") >= 1.2, 1), (c("volume_ratio") >= 1.0, 1), (c("dx") >= max(20, v.momentum_adx), 1),
        (c("macd_hist") > 0, 1), (c("rsi_wilder").between(48, 72), 1), (c("cmo_9") > 0, 1), (c("close") > c("vwap_20"), 1),
    ]
    score = sum((F.when(F.coalesce(x, no), w).otherwise(0) for x, w in points), F.lit(0))
    scored = from_bar(55) & (score >= v.score) & optional
    band = c("ema_20_f") + v.keltner_atr * c("atr_20")
    dip = place >= v.dip_place
    with_levels = lambda rsi: ((c("close") < c("bb21_lower")) & (c("rsi_13") > rsi[0]) & dip, (c("close") > c("bb21_upper")) & (c("rsi_13") > rsi[1]))
    out = {
        "ut_bot": (c("ut_whole") == "buy", c("ut_whole") == "sell"),
        "bollinger_squeeze": (squeeze, squeezed & (c("close") < c("bb_lower"))),
        "ema_pullback": (from_bar(55) & trend & (prev <= c("ema_21")) & (c("close") > c("ema_21")) & c("rsi_wilder").between(*v.pullback_rsi), from_bar(55) & (c("ema_9") < c("ema_21"))),
        "vwap_macd": (from_bar(46) & (c("close") > c("vwap_20")) & (c("macd_f_hist") > 0), from_bar(46) & (c("macd_f_hist") < 0)),
        "cmo_crsi": ((c("cmo_9") <= -v.cmo_deep) & (c("crsi_wilder") <= v.crsi_low), (c("cmo_9") >= v.cmo_deep) & c("crsi_wilder").isNotNull()),
        "ema_vwap": (
            from_bar(55) & trend & (c("dx") >= v.pullback_adx) & (c("volume_ratio") >= v.pullback_volume) & (c("close") > c("vwap_20")) & (F.min("low").over(before(3)) <= c("ema_21") * v.pullback_touch) & rising & (c("close") > c("ema_21")) & optional & higher, no),
        "breakout": (from_bar(25) & (c("close") > F.max("close").over(before(20))) & (c("volume") > v.breakout_volume * F.avg("volume").over(before(20))) & optional, no),
        "order_flow": (from_bar(5) & flow(v.flow) & rising & (prev > at("close", 2)), no),
        "momentum": (from_bar(30) & (c("return_5") > v.momentum_return) & (c("return_20") > 0) & (c("volume_ratio") >= v.momentum_volume) & (c("dx") >= v.momentum_adx) & optional & higher, no),
        "momentum_cost": (from_bar(55) & (c("return_5") >= v.careful_return) & (c("return_20") > 0) & (c("volume_ratio") >= v.careful_volume) & (c("dx") >= v.careful_adx) & optional & higher, no),
        "momentum_scored": (scored, no),
        "momentum_scored_v2": (scored & (c("close") > c("open")) & (place >= v.close_place) & (c("close") - c("ema_21") <= v.reach_atr * F.coalesce(F.nullif(c("atr_14"), F.lit(0.0)), c("close") * 0.01)), no),
        "oversold_trend": (from_bar(55) & (c("cmo_9") < 0) & (c("stoch_k") < 40) & (c("rsi_wilder") < v.oversold_rsi) & (c("ema_9") > c("ema_21")), no),
        "adaptive_trend": (from_bar(55) & trend & (c("dx") >= v.adaptive_adx) & c("atr_pct").between(*v.adaptive_atr) & higher, no),
        "regime_gate": (from_bar(55) & trend & (c("dx") >= v.gate_adx) & (c("return_21") >= v.gate_return) & (c("volume_ratio") >= v.gate_volume) & higher, no),
        "mean_reversion": (from_bar(110) & (c("close") < c("bb_lower")) & (c("crsi_wilder") < v.crsi_low) & optional, no),
        "bb_mfi_v1": with_levels(v.v1_rsi),
        "bb_mfi_v2": with_levels(v.v2_rsi),
        "bb_mfi_v3": ((c("close") < c("bb21_lower")) & (c("mfi_16") < v.v3_mfi[0]) & dip & ~bear_pressure(), (c("close") > c("bb21_upper")) & (c("rsi_13") > v.v3_rsi) & (c("mfi_16") > v.v3_mfi[1])),
        "squeeze_flow": (squeeze & flow(v.flow), no),
        "keltner_breakout": (
            from_bar(30) & (prev <= F.lag(band).over(series())) & (c("low") <= band * v.keltner_retest) & (c("close") > band) & (c("volume") >= v.keltner_volume * F.coalesce(F.when(from_bar(21), F.avg("volume").over(before(20))), F.lit(0.0))) & flow(v.keltner_flow) & higher, no),
        "chop_trend": (from_bar(30) & (c("chop") < v.chop) & (c("rsi_wilder") > v.chop_rsi) & rising & flow(0.0), no),
        "donchian_breakout": (from_bar(22) & (c("close") > F.max("close").over(before(20))) & (c("volume") >= v.donchian_volume * F.avg("volume").over(before(20))) & flow(0.0), no),
        "supertrend": ((c("supertrend") == 1) & (at("supertrend") == -1), (c("supertrend") == -1) & (at("supertrend") == 1)),
        "sar_trend": ((c("sar_trend") == 1) & (at("sar_trend") == -1) & (c("macd_hist") > 0), (c("sar_trend") == -1) & (at("sar_trend") == 1)),
        "fractal_trend": (c("fractal_low") & trend, c("ema_9") < c("ema_21")),
        "strong_candles": (F.exists("patterns", lambda p: p.isin("bullish_engulfing", "morning_star", "piercing_line", "three_inside_up")), F.exists("patterns", lambda p: p.isin("bearish_engulfing", "evening_star", "dark_cloud_cover", "three_inside_down"))),
        "rsi_bollinger": ((c("close") < c("bb_lower")) & (c("rsi_14") < 30), (c("close") > c("bb_upper")) | (c("rsi_14") > 70)),
        "tsi_force": ((c("tsi") > 0) & (at("tsi") <= 0) & (c("force") > 0), (c("tsi") < 0) & (at("tsi") >= 0)),
        "kama_trend": ((c("close") > c("kama")) & (at("close") <= at("kama")) & (c("efficiency") > 0.3), (c("close") < c("kama")) & (at("close") >= at("kama"))),
        "td9_exhaustion": (c("td9_down") >= 9, c("td9_up") >= 9),
        "structure_break": ((c("bos") == "bullish") & c("structure_volume_confirmed"), c("bos") == "bearish"),
    }
    return {k: (F.coalesce(b, no), F.coalesce(s, no)) for k, (b, s) in out.items()}


def with_signals(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """signals: a map from strategy to 'buy' or 'sell' (buy first), for those that say so. Rules that look back are worked out in one select."""
    chosen = {k: v for k, v in rules().items() if names is None or k in names}
    df = df.withColumns({f"_{k}": F.when(b, "buy").when(s, "sell") for k, (b, s) in chosen.items()})
    pairs = F.array(*[F.when(F.col(f"_{k}").isNotNull(), F.struct(F.lit(k).alias("key"), F.col(f"_{k}").alias("value"))) for k in chosen])
    return df.withColumn("signals", F.map_from_entries(F.array_compact(pairs))).drop(*[f"_{k}" for k in chosen])


def shifted(signal: Column) -> Column:
    """A signal as it can be acted on: one bar later."""
    return F.lag(signal).over(series())


def radar(df: DataFrame) -> DataFrame:
    """Each series' last bar with a 0-4 score of strength, best first: the gainers' radar and pump monitor."""
    w = series()
    newest = df.withColumn("_n", F.row_number().over(w.orderBy(F.col("open_time").desc()))).where("_n = 1").drop("_n")
    checks = [F.col("bb_position") >= 0.8, (F.col("ema_9") > F.col("ema_21")) & (F.col("close") > F.col("ema_9")), F.col("mfi_14") >= 45, F.col("rsi_wilder") >= 65]
    return newest.withColumn("radar", sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in checks), F.lit(0))).orderBy(F.desc("radar"), F.desc("volume"), "symbol")


def edge(buy: Column) -> Column:
    """Where a condition begins to hold."""
    return F.coalesce(buy, F.lit(False)) & ~F.coalesce(F.lag(buy).over(series()), F.lit(False))


def warm(df: DataFrame, n: int = 55) -> DataFrame:
    return df.where(ready(n, F.lit(True)))
