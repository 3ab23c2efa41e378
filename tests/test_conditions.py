"""Names that conditions may use, and the columns that only some rules need."""

from __future__ import annotations

from pyspark.sql import functions as F

from tests.test_series import walk
from tidebar.functions import indicators as ind
from tidebar.plans import conditions
from tidebar.sources.market import CANDLE

#: The names of definitions.
NAMES = """
    close open high low ema_9 ema_21 ema_50 price_vs_ema_9 price_vs_ema_21 price_vs_ema_50 rsi rsi_14 macd_histogram macd_hist adx atr_pct atr_trailing_stop atr_trailing_stop_pct volume_ratio volume_ratio_20 spread_pct orderflow_imbalance
    price_vs_vwap vwap vwap_distance_pct vwap_zone volume_profile_poc_distance return_5 return_21 chop stochastic_k bollinger_position mfi cci williams_r cmo crsi confluence_score regime_confidence mtf_alignment_score turtle_breakout
    turtle_breakout_confirmed wyckoff_score elliott_score fib_distance_support fib_distance_resistance rsi_bullish_divergence rsi_bearish_divergence macd_bullish_divergence macd_bearish_divergence td9_up_count td9_down_count td9_up_exhaustion
    td9_down_exhaustion bos_bullish bos_bearish structure_volume_confirmed fvg_bullish fvg_bearish wick_bullish_rejection wick_bearish_rejection vp_poc_distance vp_inside_value_area data_ready stale liquidity_fresh
""".split()


def test_all_names_are_known(spark):
    assert not [n for n in NAMES if n not in conditions.indicators()]


def test_only_named_columns_are_added(spark):
    df = ind.prepare(spark.createDataFrame(walk(8, n=80), CANDLE))
    assert conditions.with_needed(df, [{"indicator": "close", "op": "gt", "value": 1}], None).columns == df.columns
    rules = [{"indicator": "vp_inside_value_area", "op": "eq", "value": 1}, {"indicator": "vp_poc_distance", "op": "gte", "value": -1}]
    out = conditions.with_needed(df, rules)
    assert set(out.columns) - set(df.columns) == set(conditions.PROFILE)
    rows = out.orderBy("open_time").collect()
    assert [r["vp_inside_value_area"] for r in rows[:11]] == [None] * 11 and {r["vp_inside_value_area"] for r in rows[11:]} <= {0.0, 1.0}
    assert out.where(conditions.conditions(rules)).count() == sum(r["vp_inside_value_area"] == 1.0 for r in rows) > 0
    flags = df.withColumns({"rsi_wilder": F.lit(50.0), "macd_hist": F.col("close")})
    assert set(conditions.with_needed(flags, [{"indicator": "rsi_bullish_divergence", "op": "eq", "value": 1}]).columns) - set(flags.columns) == set(conditions.DIVERGENCES)
