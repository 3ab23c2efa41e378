"""The registered queries over the driver's tables, each beside the DuckDB SQL that it is checked with.

Ticks are `events`, candles their hourly bars, the trade ledger order lines with their orders, memory documents with embeddings and labels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import indicators as ind
from .functions.patterns import candlesticks, fair_value_gap, price_action, volume_profile, with_methodology, with_structure, with_td9, with_wicks
from .functions.recursive import recursive
from .functions.scalars import bounded
from .operators import gates, joins, labels, ledger, replay, retrieval, stats
from .plans import conditions, guarded_sql, strategies
from .session import table
from .sources import market
from .streaming.market import cascade_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return market.bars(market.ticks(table(spark, sf_dir, "events")), "1h")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ind.prepare(hourly(spark, sf_dir))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.ledger_of(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"))


def rounded(df: DataFrame, keys: list[str], columns: dict[str, Column], digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(n) for n, c in columns.items()])


def same(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


KEY = ["symbol", "open_time"]
W = "PARTITION BY symbol ORDER BY open_time"


def L(n: int) -> str:  # noqa: N802
    """SQL: over this bar and the n - 1 before."""
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def P(n: int) -> str:  # noqa: N802
    """SQL: over the n bars before."""
    return f"OVER ({W} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def r(**columns: str) -> str:
    return ", ".join(f"round({sql}, 6) AS {name}" for name, sql in columns.items())


def nine(**columns: str) -> str:
    return r(**columns).replace(", 6) AS", ", 9) AS")


def on(n: int, sql: str) -> str:
    return f"CASE WHEN bar >= {n} THEN {sql} END"


def over(a: str, b: str, otherwise: str = "NULL") -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE {otherwise} END"


TICKS = "t AS (SELECT event_type AS symbol, epoch_us(ts) // 1000 AS time, event_id AS seq, value AS price FROM events)"
BARS = f"""{TICKS}, c AS (SELECT symbol, (time // 3600000) * 3600000 AS open_time, arg_min(price, time) AS open, max(price) AS high, min(price) AS low, arg_max(price, time) AS close,
    CAST(count(*) AS DOUBLE) AS volume, sum(price) AS quote_volume FROM t GROUP BY ALL)"""
PREPARED = f"""{BARS}, p0 AS (SELECT *, row_number() OVER w AS bar, lag(close) OVER w AS prev_close, lag(high) OVER w AS ph, lag(low) OVER w AS pl, (high + low + close) / 3 AS typical FROM c WINDOW w AS ({W})),
    p AS (SELECT *, close - prev_close AS change, CASE WHEN prev_close IS NOT NULL THEN greatest(high - low, abs(high - prev_close), abs(low - prev_close)) END AS tr,
    CASE WHEN typical > (ph + pl + prev_close) / 3 THEN typical * volume ELSE 0 END AS fu, CASE WHEN typical < (ph + pl + prev_close) / 3 THEN typical * volume ELSE 0 END AS fd,
    CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0 END AS du, CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0 END AS dd,
    sign(close - open) AS body_sign, coalesce(sign(close - prev_close) * volume, 0) AS ob FROM p0)"""
DAY_S = "CAST(epoch({}) AS BIGINT)"
TRADES = f"""tr AS (SELECT l_returnflag || l_linestatus AS symbol, o_orderpriority AS strategy, least({DAY_S.format('o_orderdate')}, {DAY_S.format('l_shipdate')}) AS entry_time, greatest({DAY_S.format('o_orderdate')}, {DAY_S.format('l_shipdate')}) AS exit_time,
    l_extendedprice * (l_discount - l_tax) AS pnl, l_extendedprice * 0.0015 AS commission, l_extendedprice AS value, l_quantity AS quantity, o_orderstatus AS reason, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS trade_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# Sources, bars, checks


@query(f"WITH {BARS} SELECT symbol, open_time, open, high, low, close, volume, round(quote_volume, 6) AS quote_volume FROM c")
def candles_hourly(spark, sf_dir):
    return hourly(spark, sf_dir).select(*KEY, "open", "high", "low", "close", "volume", F.round("quote_volume", 6).alias("quote_volume"))


@query(f"WITH {BARS} SELECT symbol, (open_time // 14400000) * 14400000 AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close, sum(volume) AS volume FROM c GROUP BY 1, 2")
def candles_resampled(spark, sf_dir):
    return market.resample(hourly(spark, sf_dir), "4h").select(*KEY, "open", "high", "low", "close", "volume")


@query(f"""WITH {BARS}, g AS (SELECT *, open_time - lag(open_time) OVER ({W}) AS gap FROM c) SELECT symbol, count(*) AS candle_count, count(*) > count(DISTINCT open_time) AS duplicate_timestamps,
    count(*) FILTER (gap > 5400000) AS missing_gap_count, coalesce(max(gap) FILTER (gap > 5400000) / 1000, 0.0)::DOUBLE AS max_gap_seconds, count(*) = count(DISTINCT open_time) AS data_ready FROM g GROUP BY symbol""")
def data_quality(spark, sf_dir):
    return market.data_quality(hourly(spark, sf_dir), market.HOUR).drop("timeframe")


@query(f"WITH {TICKS} SELECT symbol, arg_max(price, time) AS last_price, max(time) AS timestamp FROM t GROUP BY symbol")
def latest_prices(spark, sf_dir):
    return market.latest(market.ticks(table(spark, sf_dir, "events")))


@query(f"WITH {BARS} SELECT symbol, round(count(*) / 720.0::DOUBLE, 6) AS coverage, max(open_time) AS last_open_time, count(*) / 720.0::DOUBLE >= 0.95 AS sufficient FROM c WHERE open_time BETWEEN 1704067200000 AND 1704067200000 + 720::BIGINT * 3600000 - 1 GROUP BY symbol")
def history_coverage(spark, sf_dir):
    start = 1_704_067_200_000
    out = market.coverage(hourly(spark, sf_dir), start, start + 720 * market.HOUR, market.HOUR, 0.95)
    return out.select("symbol", F.round("coverage", 6).alias("coverage"), "last_open_time", "sufficient")


@query(f"""WITH {BARS}, a AS (SELECT symbol, open_time, close, 1.0::DOUBLE AS fetched_at FROM c UNION ALL SELECT symbol, open_time, close * 2, 2.0 FROM c WHERE volume > 3)
    SELECT symbol, open_time, arg_max(close, fetched_at) AS close, max(fetched_at) AS fetched_at FROM a GROUP BY ALL""")
def candle_upsert(spark, sf_dir):
    old = hourly(spark, sf_dir).select(*KEY, "close", F.lit(1.0).alias("fetched_at"))
    fresh = hourly(spark, sf_dir).where("volume > 3").select(*KEY, (F.col("close") * 2).alias("close"), F.lit(2.0).alias("fetched_at"))
    return market.upsert(old, fresh, KEY)


@query(f"""WITH {BARS}, a AS (SELECT symbol, open_time, close, 1 AS arrival FROM c UNION ALL SELECT symbol, open_time, close + 1, 2 FROM c WHERE volume > 3), n AS (SELECT max(open_time) AS m FROM c),
    d AS (SELECT symbol, open_time, arg_max(close, arrival) AS close FROM a, n WHERE open_time + 3599999 <= n.m GROUP BY ALL) SELECT symbol, open_time, close FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS k FROM d) WHERE k <= 400""")
def closed_bars(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    twice = bars.withColumn("arrival", F.lit(1)).unionByName(bars.where("volume > 3").withColumn("close", F.col("close") + 1).withColumn("arrival", F.lit(2)))
    now = bars.agg(F.max("open_time")).first()[0]
    return market.closed(twice, now).select(*KEY, "close")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events WHERE json_extract(props, '$.k') IS NOT NULL")
def json_payload(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")).where("k is not null")


# Window indicators


@query(f"""WITH {PREPARED} SELECT symbol, open_time, {nine(
    sma_20=on(20, f'avg(close) {L(20)}'), bb_upper=on(20, f'avg(close) {L(20)} + 2 * stddev_pop(close) {L(20)}'), bb_lower=on(20, f'avg(close) {L(20)} - 2 * stddev_pop(close) {L(20)}'), atr_14=on(15, f'avg(tr) {L(14)}'),
    vwap_20=on(20, over(f'sum(typical * volume) {L(20)}', f'sum(volume) {L(20)}')), vwma_20=on(20, over(f'sum(close * volume) {L(20)}', f'sum(volume) {L(20)}')), base_26=on(26, f'(max(high) {L(26)} + min(low) {L(26)}) / 2'),
    donchian_upper=on(20, f'max(high) {L(20)}'), donchian_lower=on(20, f'min(low) {L(20)}'), volume_ratio=on(21, f'volume / avg(volume) {P(20)}'), return_12=f'CASE WHEN lag(close, 12) OVER ({W}) <> 0 THEN close / lag(close, 12) OVER ({W}) - 1 END')} FROM p""")
def window_averages(spark, sf_dir):
    b = ind.bollinger()
    cols = {"sma_20": ind.sma("close", 20), "bb_upper": b["bb_upper"], "bb_lower": b["bb_lower"], "atr_14": ind.atr(14), "vwap_20": ind.vwap(20), "vwma_20": ind.vwap(20, "close"), "base_26": ind.midpoint(26), "donchian_upper": ind.donchian()["donchian_upper"], "donchian_lower": ind.donchian()["donchian_lower"], "volume_ratio": ind.volume_ratio(20), "return_12": ind.change_over(12)}
    return rounded(prepared(spark, sf_dir), KEY, cols, 9)


UP, DOWN = "greatest(change, 0)", "greatest(-change, 0)"


@query(f"""WITH {PREPARED}, s AS (SELECT *, CASE WHEN bar >= 14 THEN CASE WHEN max(high) {L(14)} = min(low) {L(14)} THEN 50.0 ELSE (close - min(low) {L(14)}) / (max(high) {L(14)} - min(low) {L(14)}) * 100 END END AS raw,
    CASE WHEN bar >= 15 THEN CASE WHEN avg({DOWN}) {L(14)} = 0 THEN CASE WHEN avg({UP}) {L(14)} > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + avg({UP}) {L(14)} / avg({DOWN}) {L(14)}) END END AS rsi_14 FROM p)
    SELECT symbol, open_time, {r(rsi_14='rsi_14', stoch_k=on(16, f'avg(raw) {L(3)}'), stoch_d=on(16, f'CASE WHEN bar >= 19 THEN avg(raw) OVER ({W} ROWS BETWEEN 5 PRECEDING AND 3 PRECEDING) ELSE avg(raw) {L(3)} END'),
    cmo_9=on(10, over(f'100 * (sum({UP}) {L(9)} - sum({DOWN}) {L(9)})', f'sum({UP}) {L(9)} + sum({DOWN}) {L(9)}', '0')), mfi_14=on(15, f'CASE WHEN sum(fd) {L(14)} <> 0 THEN 100 - 100 / (1 + sum(fu) {L(14)} / sum(fd) {L(14)}) ELSE 100.0 END'),
    williams_r=on(14, over(f'(max(high) {L(14)} - close) * -100', f'max(high) {L(14)} - min(low) {L(14)}', '-50')), ao=on(34, f'avg((high + low) / 2) {L(5)} - avg((high + low) / 2) {L(34)}'),
    chop=on(15, f'CASE WHEN max(high) {L(14)} - min(low) {L(14)} > 0 THEN 100 * log10(sum(tr) {L(14)} / (max(high) {L(14)} - min(low) {L(14)})) / log10(14) ELSE 100.0 END'))} FROM s""")
def oscillators(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumn("stoch_raw", ind.raw_stochastic(14))
    return rounded(df, KEY, {"rsi_14": ind.rsi_simple(14), **ind.stochastic(), "cmo_9": ind.cmo(9), "mfi_14": ind.mfi(14), "williams_r": ind.williams_r(), "ao": ind.awesome(), "chop": ind.choppiness(14)})


@query(f"""WITH {PREPARED}, h AS (SELECT *, list(typical) {L(20)} AS tl, avg(typical) {L(20)} AS tm FROM p) SELECT symbol, open_time, {r(
    cci_20=on(20, over('typical - tm', '0.015 * list_avg(list_transform(tl, lambda x: abs(x - tm)))', '0')),
    ultimate=on(29, '100 * (4 * (' + over(f'sum(close - least(low, prev_close)) {L(7)}', f'sum(greatest(high, prev_close) - least(low, prev_close)) {L(7)}', '0.5') + ') + 2 * (' + over(f'sum(close - least(low, prev_close)) {L(14)}', f'sum(greatest(high, prev_close) - least(low, prev_close)) {L(14)}', '0.5') + ') + (' + over(f'sum(close - least(low, prev_close)) {L(28)}', f'sum(greatest(high, prev_close) - least(low, prev_close)) {L(28)}', '0.5') + ')) / 7'),
    flow=on(20, f'greatest(-1, least(1, sum(volume * (0.7 * (2 * close - high - low) / greatest(high - low, 1e-12) + 0.3 * body_sign)) {L(20)} / sum(volume) {L(20)}))'), cmf_20=on(20, over(f"sum(({over('2 * close - high - low', 'high - low', '0')}) * volume) {L(20)}", f'sum(volume) {L(20)}', '0')))} FROM h""")
def volume_oscillators(spark, sf_dir):
    return rounded(prepared(spark, sf_dir), KEY, {"cci_20": ind.cci(20), "ultimate": ind.ultimate(), "flow": ind.flow_proxy(20), "cmf_20": ind.chaikin_flow(20)})


DI_UP, DI_DOWN = over(f"100 * avg(du) {L(14)}", f"avg(tr) {L(14)}", "0"), over(f"100 * avg(dd) {L(14)}", f"avg(tr) {L(14)}", "0")


@query(f"""WITH {PREPARED}, d AS (SELECT *, {on(29, DI_UP)} AS plus_di, {on(29, DI_DOWN)} AS minus_di FROM p), x AS (SELECT *, CASE WHEN bar >= 29 THEN {over('100 * abs(plus_di - minus_di)', 'plus_di + minus_di', '0')} END AS dx FROM d)
    SELECT symbol, open_time, {r(plus_di='plus_di', minus_di='minus_di', dx='dx', adx=on(42, f'avg(dx) {L(14)}'), obv=on(2, f'sum(ob) OVER ({W})'), obv_slope=on(2, f'sum(CASE WHEN bar > 2 THEN ob ELSE 0 END) {L(4)}'))} FROM x""")
def directional(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumns(ind.dx())
    return rounded(df, KEY, {**same("plus_di", "minus_di", "dx"), "adx": ind.ready(42, F.avg("dx").over(ind.last(14))), **ind.obv()})


def _finite(n: int) -> str:
    from math import exp

    weights = [exp(-k / (n - 1)) for k in range(n)]
    total = sum(weights)
    return on(n, f"list_sum(list_transform(list_zip(list(close) {L(n)}, [{', '.join(repr(x / total) for x in reversed(weights))}]), lambda z: z[1] * z[2]))")


@query(f"WITH {PREPARED}, e AS (SELECT *, {_finite(9)} AS e9, {_finite(12)} AS e12, {_finite(26)} AS e26 FROM p) SELECT symbol, open_time, {r(ema_9='e9', macd_finite=on(35, 'e12 - e26'))} FROM e")
def finite_averages(spark, sf_dir):
    return rounded(prepared(spark, sf_dir), KEY, {"ema_9": ind.ema_finite("close", 9), "macd_finite": ind.ready(35, ind.ema_finite("close", 12) - ind.ema_finite("close", 26))})


@query(f"""WITH {PREPARED}, s AS (SELECT *, coalesce(CAST(sign(change) AS INTEGER), 0) AS sg FROM p), n AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER ({W}) THEN 1 ELSE 0 END AS nw FROM s), g AS (SELECT *, sum(nw) OVER ({W}) AS run FROM n),
    k AS (SELECT *, sg * row_number() OVER (PARTITION BY symbol, run ORDER BY open_time) AS streak FROM g), v AS (SELECT *, list(change) OVER ({W} ROWS BETWEEN 99 PRECEDING AND 1 PRECEDING) AS past, sum(greatest(streak, 0)) {L(2)} AS su, sum(greatest(-streak, 0)) {L(2)} AS sd, avg({UP}) {L(3)} AS gu, avg({DOWN}) {L(3)} AS gd FROM k)
    SELECT symbol, open_time, CAST(streak AS INTEGER) AS streak, {r(crsi=on(105, "((CASE WHEN gd = 0 THEN CASE WHEN gu > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + gu / gd) END) + (CASE WHEN sd = 0 THEN CASE WHEN su <> 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + su / sd) END) + 100 * CAST(len(list_filter(past, lambda x: x < change)) AS DOUBLE) / 99) / 3"))} FROM v""")
def connors_rsi(spark, sf_dir):
    df = ind.with_streak(prepared(spark, sf_dir))
    return df.select(*KEY, F.col("streak").cast("int").alias("streak"), F.round(ind.connors_rsi(), 6).alias("crsi"))


# Recursive indicators


def _ema_sql(n: int, col: str = "close", rows: str = "p") -> str:
    """A recursive table of the mean-seeded average of a column, by bar."""
    a = 2 / (n + 1)
    return f"""e{n} AS (SELECT symbol, bar, m AS v FROM (SELECT symbol, bar, avg({col}) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS m FROM {rows}) WHERE bar = {n}
        UNION ALL SELECT e.symbol, e.bar + 1, {a!r} * q.{col} + (1 - {a!r}) * e.v FROM e{n} e JOIN {rows} q ON q.symbol = e.symbol AND q.bar = e.bar + 1)"""


@query(f"""WITH RECURSIVE {PREPARED}, {_ema_sql(9)}, {_ema_sql(12)}, {_ema_sql(26)},
    w AS (SELECT symbol, bar, u, d FROM (SELECT symbol, bar, avg({UP}) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS u, avg({DOWN}) OVER (PARTITION BY symbol ORDER BY bar ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS d FROM p) WHERE bar = 15
        UNION ALL SELECT w.symbol, w.bar + 1, (w.u * 13 + greatest(q.change, 0)) / 14, (w.d * 13 + greatest(-q.change, 0)) / 14 FROM w JOIN p q ON q.symbol = w.symbol AND q.bar = w.bar + 1)
    SELECT p.symbol, p.open_time, {r(ema_9_r='e9.v', rsi_wilder='CASE WHEN w.d = 0 THEN 100.0 ELSE 100 - 100 / (1 + w.u / w.d) END', macd_line='CASE WHEN p.bar >= 34 THEN e12.v - e26.v END')}
    FROM p LEFT JOIN e9 ON e9.symbol = p.symbol AND e9.bar = p.bar LEFT JOIN e12 ON e12.symbol = p.symbol AND e12.bar = p.bar LEFT JOIN e26 ON e26.symbol = p.symbol AND e26.bar = p.bar LEFT JOIN w ON w.symbol = p.symbol AND w.bar = p.bar""")
def recursive_averages(spark, sf_dir):
    return rounded(recursive(hourly(spark, sf_dir), ["ema_9_r", "rsi_wilder", "macd_line"]), KEY, same("ema_9_r", "rsi_wilder", "macd_line"))


@query(f"""WITH RECURSIVE {BARS}, b AS (SELECT *, row_number() OVER ({W}) AS bar FROM c), h AS (SELECT symbol, bar, open_time, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM b WHERE bar = 1
    UNION ALL SELECT b.symbol, b.bar, b.open_time, (h.ho + h.hc) / 2, (b.open + b.high + b.low + b.close) / 4 FROM h JOIN b ON b.symbol = h.symbol AND b.bar = h.bar + 1) SELECT symbol, open_time, {r(ha_open='ho', ha_close='hc')} FROM h""")
def heikin_ashi(spark, sf_dir):
    return rounded(recursive(hourly(spark, sf_dir), ["ha_open", "ha_close"]), KEY, same("ha_open", "ha_close"))


@query()
def recursive_trends(spark, sf_dir):
    return rounded(recursive(hourly(spark, sf_dir)), [*KEY, "sar_trend", "supertrend", "ut_signal"], same("macd_signal", "macd_hist", "kama", "efficiency", "sar", "ut_stop", "tsi", "force", "bull_power", "bear_power"))


# Patterns and structure


def _bar(k: int) -> str:
    """SQL columns of the bar k back: o, h, l, c, top, bottom, body, range."""
    g = lambda c: f"lag({c}, {k}) OVER ({W})"
    return f"{g('open')} AS o{k}, {g('high')} AS h{k}, {g('low')} AS l{k}, {g('close')} AS c{k}, coalesce(lag(close, {k + 3}) OVER ({W}), first_value(close) OVER ({W})) AS t{k}"


def _patterns_sql() -> str:
    raw = f"WITH {PREPARED}, q AS (SELECT *, {', '.join(_bar(k) for k in range(3))}, CASE WHEN avg(abs(close - open)) {L(20)} = 0 THEN 1e-12 ELSE avg(abs(close - open)) {L(20)} END AS m FROM p)"
    more = ", ".join(f"greatest(o{k}, c{k}) AS top{k}, least(o{k}, c{k}) AS bot{k}, abs(c{k} - o{k}) AS b{k}, greatest(h{k} - l{k}, 1e-12) AS r{k}, bar - {k} > 1 AND c{k} < t{k} AS f{k}, bar - {k} > 1 AND c{k} > t{k} AS u{k}" for k in range(3))
    mat = ", ".join(f"b{k} >= greatest(r{k} * 0.10, m * 0.20) AS mat{k}" for k in range(2))
    solid, low, high = "b0 / r0 > 0.10 AND mat0", "bot0 - l0", "h0 - top0"
    lp, hp = f"{solid} AND {low} >= greatest(b0 * 2, r0 * 0.45) AND {high} <= greatest(b0 * 0.75, r0 * 0.10)", f"{solid} AND {high} >= greatest(b0 * 2, r0 * 0.45) AND {low} <= greatest(b0 * 0.75, r0 * 0.10)"
    bull, bear = "mat0 AND mat1 AND f1 AND c1 < o1 AND c0 > o0", "mat0 AND mat1 AND u1 AND c1 > o1 AND c0 < o0"
    small, half = "b0 <= b1 * 0.60 AND top0 < top1 AND bot0 > bot1", "(o1 + c1) / 2"
    three, held, star = "bar >= 5 AND b2 >= m", "b1 <= b2 * 0.60 AND top1 < top2 AND bot1 > bot2", "b1 <= b2 * 0.45 AND b0 >= b2 * 0.60"
    rules = {
        "hammer": f"{lp} AND f1", "hanging_man": f"{lp} AND u1", "shooting_star": f"{hp} AND u1", "inverted_hammer": f"{hp} AND f1", "bullish_engulfing": f"{bull} AND o0 <= c1 AND c0 >= o1 AND b0 > b1", "bearish_engulfing": f"{bear} AND o0 >= c1 AND c0 <= o1 AND b0 > b1",
        "bullish_harami": f"{bull} AND {small}", "bearish_harami": f"{bear} AND {small}", "piercing_line": f"{bull} AND o0 <= c1 AND c0 > {half} AND c0 < o1", "dark_cloud_cover": f"{bear} AND o0 >= c1 AND c0 > o1 AND c0 < {half}",
        "three_inside_up": f"{three} AND f2 AND c2 < o2 AND c1 > o1 AND c0 > o0 AND {held} AND c0 > o2", "three_inside_down": f"{three} AND u2 AND c2 > o2 AND c1 < o1 AND c0 < o0 AND {held} AND c0 < o2",
        "morning_star": f"{three} AND f2 AND c2 < o2 AND c0 > o0 AND {star} AND c0 > (o2 + c2) / 2", "evening_star": f"{three} AND u2 AND c2 > o2 AND c0 < o0 AND {star} AND c0 < (o2 + c2) / 2",
    }
    found = "concat_ws(',', " + ", ".join(f"CASE WHEN {x} THEN '{n}' END" for n, x in rules.items()) + ")"
    return f"{raw}, z AS (SELECT *, {more} FROM q), y AS (SELECT *, {mat} FROM z), x AS (SELECT symbol, open_time, bar, {found} AS found FROM y) SELECT symbol, open_time, CASE WHEN bar < 3 OR found = '' THEN 'none' ELSE found END AS patterns FROM x"


@query(_patterns_sql())
def candlestick_patterns(spark, sf_dir):
    return prepared(spark, sf_dir).select(*KEY, F.array_join(candlesticks(), ",").alias("patterns"))


@query(f"""WITH {BARS}, s AS (SELECT *, coalesce(sign(close - lag(close, 4) OVER ({W})), 0) AS sg FROM c), n AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER ({W}) THEN 1 ELSE 0 END AS nw FROM s), g AS (SELECT *, sum(nw) OVER ({W}) AS run FROM n),
    k AS (SELECT *, least(28, row_number() OVER (PARTITION BY symbol, run ORDER BY open_time)) AS n FROM g) SELECT symbol, open_time, CAST(CASE WHEN sg > 0 THEN n ELSE 0 END AS INTEGER) AS td9_up, CAST(CASE WHEN sg < 0 THEN n ELSE 0 END AS INTEGER) AS td9_down, CASE WHEN sg > 0 AND n >= 9 THEN 'uptrend_9' WHEN sg < 0 AND n >= 9 THEN 'downtrend_9' ELSE 'none' END AS td9_exhaustion FROM k""")
def td9(spark, sf_dir):
    return with_td9(prepared(spark, sf_dir)).select(*KEY, F.col("td9_up").cast("int").alias("td9_up"), F.col("td9_down").cast("int").alias("td9_down"), "td9_exhaustion")


@query(f"""WITH {PREPARED}, q AS (SELECT *, lag(high, 2) OVER ({W}) AS h2, lag(low, 2) OVER ({W}) AS l2, coalesce({on(15, f'avg(tr) {L(14)}')}, 0) * 0.25 AS fl, (high - greatest(open, close)) / greatest(high - low, 1e-12) AS u, (least(open, close) - low) / greatest(high - low, 1e-12) AS l FROM p),
    z AS (SELECT *, CASE WHEN bar >= 21 THEN CASE WHEN stddev_pop(u) {P(20)} > 1e-12 THEN (u - avg(u) {P(20)}) / stddev_pop(u) {P(20)} ELSE 0 END END AS uz, CASE WHEN bar >= 21 THEN CASE WHEN stddev_pop(l) {P(20)} > 1e-12 THEN (l - avg(l) {P(20)}) / stddev_pop(l) {P(20)} ELSE 0 END END AS lz FROM q)
    SELECT symbol, open_time, CASE WHEN bar >= 3 THEN CASE WHEN low - h2 > fl THEN 'bullish' WHEN l2 - high > fl THEN 'bearish' ELSE 'none' END END AS fvg_side, {r(upper_wick_z='uz', lower_wick_z='lz')},
    CASE WHEN bar >= 21 THEN CASE WHEN uz >= 1.5 AND close <= low + greatest(high - low, 1e-12) * 0.45 THEN 'bearish_rejection' WHEN lz >= 1.5 AND close >= low + greatest(high - low, 1e-12) * 0.55 THEN 'bullish_rejection' ELSE 'none' END END AS wick_signal FROM z""")
def gaps_and_wicks(spark, sf_dir):
    df = with_wicks(prepared(spark, sf_dir)).withColumns(fair_value_gap())
    return rounded(df, [*KEY, "fvg_side", "wick_signal"], same("upper_wick_z", "lower_wick_z"))


@query(f"""WITH {BARS}, b AS (SELECT *, row_number() OVER ({W}) AS bar, list(high) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS hs, list(low) OVER ({W} ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS ls FROM c),
    v AS (SELECT *, CASE WHEN len(hs) = 7 AND high = list_max(hs) AND len(list_filter(hs, lambda x: x = high)) = 1 THEN high END AS ph, CASE WHEN len(ls) = 7 AND low = list_min(ls) AND len(list_filter(ls, lambda x: x = low)) = 1 THEN low END AS pl FROM b),
    s AS (SELECT *, last_value(ph IGNORE NULLS) OVER ({W} ROWS BETWEEN 176 PRECEDING AND 4 PRECEDING) AS sh, last_value(pl IGNORE NULLS) OVER ({W} ROWS BETWEEN 176 PRECEDING AND 4 PRECEDING) AS sl FROM v)
    SELECT symbol, open_time, sh AS swing_high, sl AS swing_low, CASE WHEN bar >= 9 THEN CASE WHEN close > sh THEN 'bullish' WHEN close < sl THEN 'bearish' ELSE 'none' END END AS bos FROM s""")
def structure_breaks(spark, sf_dir):
    return with_structure(prepared(spark, sf_dir)).select(*KEY, F.col("swing_high.price").alias("swing_high"), F.col("swing_low.price").alias("swing_low"), "bos")


def _action_sql() -> str:
    bar = ", ".join(f"lag({c}, {k}) OVER ({W}) AS {c[0]}{k}" for k in (1, 2, 3) for c in ("open", "high", "low", "close"))
    up, low, body, rng = "h1 - greatest(o1, c1)", "least(o1, c1) - l1", "abs(c1 - o1)", "greatest(h1 - l1, 1e-12)"
    return f"""WITH {PREPARED}, q AS (SELECT *, {bar} FROM p) SELECT symbol, open_time, CASE WHEN bar < 4 THEN 'none' WHEN h2 < h3 AND l2 > l3 AND h1 > h3 AND c1 < h3 THEN 'bearish_fakey' WHEN h2 < h3 AND l2 > l3 AND l1 < l3 AND c1 > l3 THEN 'bullish_fakey'
        WHEN h2 > l2 AND h1 < h2 AND l1 > l2 THEN 'inside_bar' WHEN {low} >= {body} * 2 AND {low} >= ({up}) * 1.5 AND c1 >= l1 + {rng} * 0.6 THEN 'bullish_pin_bar' WHEN {up} >= {body} * 2 AND {up} >= ({low}) * 1.5 AND c1 <= l1 + {rng} * 0.4 THEN 'bearish_pin_bar' ELSE 'none' END AS price_action FROM q"""


@query(_action_sql())
def price_action_setups(spark, sf_dir):
    return prepared(spark, sf_dir).select(*KEY, price_action().alias("price_action"))


@query()
def volume_profiles(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumn("v", volume_profile())
    return rounded(df, KEY, {"poc": F.col("v.poc"), "area_low": F.col("v.low"), "area_high": F.col("v.high")})


@query()
def methodology(spark, sf_dir):
    df = with_methodology(ind.snapshot(hourly(spark, sf_dir)))
    return rounded(df, [*KEY, "regime", "turtle", "wyckoff_event", "elliott"], same("confluence", "fib_236", "fib_786"))


@query(f"""WITH {PREPARED}, a AS (SELECT *, sum(CASE WHEN (high - low) * 100 <= 0.05 * low THEN 1 ELSE 0 END) {L(5)} AS f5, sum(CASE WHEN (high - low) * 100 <= 0.05 * low THEN 1 ELSE 0 END) {L(30)} AS f30, CASE WHEN min(low) {L(3)} > 0 THEN (max(high) {L(3)} - min(low) {L(3)}) / min(low) {L(3)} * 100 END AS r3 FROM p)
    SELECT symbol, CASE WHEN bar < 30 THEN 'WARMING' WHEN coalesce(f30 > 18 OR f5 = 5 OR r3 < 0.3, true) THEN 'PASSIVE' ELSE 'ACTIVE' END AS activity, count(*) AS n FROM a GROUP BY ALL""")
def activity_states(spark, sf_dir):
    return gates.activity(prepared(spark, sf_dir)).groupBy("symbol", "activity").agg(F.count("*").alias("n"))


@query()
def entry_blocks(spark, sf_dir):
    df = ind.snapshot(hourly(spark, sf_dir)).withColumn("block", gates.entry_block())
    return df.groupBy("symbol", F.coalesce("block", F.lit("none")).alias("block")).agg(F.count("*").alias("n"))


# Joins on time


@query(f"""WITH {BARS}, k AS (SELECT symbol, (open_time // 14400000) * 14400000 + 14399999 AS close_time, arg_max(close, open_time) AS close FROM c GROUP BY ALL)
    SELECT c.symbol, c.open_time, k.close AS h4_close, k.close_time AS h4_close_time FROM c ASOF LEFT JOIN k ON c.symbol = k.symbol AND c.open_time + 3599999 >= k.close_time""")
def asof_higher_timeframe(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return joins.asof(bars, market.resample(bars, "4h"), ["symbol"], "close_time", "close_time", ["close", "close_time"], prefix="h4_").select(*KEY, "h4_close", "h4_close_time")


@query(f"""WITH {BARS} SELECT a.symbol, a.seq, f.open AS next_open, p.close AS past_close FROM t a ASOF LEFT JOIN c f ON a.symbol = f.symbol AND a.time <= f.open_time ASOF LEFT JOIN c p ON a.symbol = p.symbol AND a.time > p.open_time""")
def asof_forward_and_strict(spark, sf_dir):
    """Every tick with the first bar from its time on and the last one that began before it."""
    ticks, bars = market.ticks(table(spark, sf_dir, "events")).select("symbol", "time", "seq"), hourly(spark, sf_dir)
    out = joins.asof(ticks, bars, ["symbol"], "time", "open_time", ["open"], forward=True, prefix="next_")
    return joins.asof(out, bars, ["symbol"], "time", "open_time", ["close"], strict=True, prefix="past_").select("symbol", "seq", "next_open", "past_close")


@query(f"""WITH {TICKS}, m AS (SELECT a.symbol, a.seq, b.seq AS other, count(*) OVER (PARTITION BY a.seq) AS n FROM t a JOIN t b ON a.symbol = b.symbol AND a.seq <> b.seq AND b.time BETWEEN a.time - 30000 AND a.time + 30000)
    SELECT symbol, seq, other FROM m WHERE n = 1""")
def tolerance_join(spark, sf_dir):
    """Every tick that has just one other tick of its symbol within 30 seconds."""
    return joins.lone_neighbours(market.ticks(table(spark, sf_dir, "events")), ["symbol"], "time", "seq", 30_000)


@query(f"""WITH {BARS}, x AS (SELECT symbol, open_time AS entry_time, open_time + 36000000 AS exit_time, open AS entry_price FROM c WHERE open <> 0)
    SELECT x.symbol || '-' || x.entry_time AS trade_id, {r(mfe='max(c.high) / x.entry_price - 1', mae='min(c.low) / x.entry_price - 1')}, arg_max(c.open_time, (c.high, -c.open_time)) AS best_time, arg_min(c.open_time, (c.low, c.open_time)) AS worst_time FROM x JOIN c ON c.symbol = x.symbol AND c.open_time BETWEEN x.entry_time AND x.exit_time GROUP BY x.symbol, x.entry_time, x.entry_price""")
def trade_excursions(spark, sf_dir):
    """Every bar as a trade of ten hours."""
    bars = hourly(spark, sf_dir)
    t = bars.where("open <> 0").select(F.concat_ws("-", "symbol", "open_time").alias("trade_id"), "symbol", F.col("open_time").alias("entry_time"), (F.col("open_time") + 10 * market.HOUR).alias("exit_time"), F.col("open").alias("entry_price"))
    return rounded(labels.excursions(t, bars), ["trade_id", "best_time", "worst_time"], same("mfe", "mae"))


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS only_in FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL""")
def symmetric_difference(spark, sf_dir):
    a = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"))
    return joins.difference(a, table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), "k")


# Outcomes and statistics


@query(f"""WITH {BARS} SELECT symbol, open_time, {r(up_6h='max(high) OVER f / nullif(close, 0) - 1', down_6h='min(low) OVER f / nullif(close, 0) - 1', ret_6h='last_value(close) OVER f / nullif(close, 0) - 1')} FROM c WINDOW f AS ({W} RANGE BETWEEN 1 FOLLOWING AND 21600000 FOLLOWING)""")
def forward_outcomes(spark, sf_dir):
    return rounded(labels.outcomes(hourly(spark, sf_dir), {"6h": 6 * market.HOUR}), KEY, same("up_6h", "down_6h", "ret_6h"))


@query(f"""WITH {BARS}, b AS (SELECT *, row_number() OVER ({W}) AS bar, lead(open) OVER ({W}) AS e FROM c), x AS (SELECT b.symbol, b.open_time, b.e, n.bar - b.bar AS k, CASE WHEN n.low <= b.e * 0.9 THEN 'stop' WHEN n.high >= b.e * 1.1 THEN 'target' END AS o FROM b LEFT JOIN b n ON n.symbol = b.symbol AND n.bar BETWEEN b.bar + 1 AND b.bar + 12),
    g AS (SELECT symbol, open_time, any_value(e) AS e, arg_min(o, k) FILTER (o IS NOT NULL) AS o, min(k) FILTER (o IS NOT NULL) AS k FROM x GROUP BY ALL) SELECT symbol, open_time, CASE WHEN e IS NOT NULL THEN coalesce(o, 'timeout') END AS outcome, CAST(k AS INTEGER) AS touch_bar FROM g""")
def first_touches(spark, sf_dir):
    return labels.first_touch(hourly(spark, sf_dir), 0.10, 0.10, 12).select(*KEY, "outcome", F.col("touch_bar").cast("int").alias("touch_bar"))


@query()
def spike_events(spark, sf_dir):
    return rounded(labels.spikes(hourly(spark, sf_dir), 0.5, 6 * market.HOUR, 12 * market.HOUR, 6), [*KEY, "crossed_at", "peak_time", "onset_at"], same("move"))


@query()
def control_bars(spark, sf_dir):
    bars = hourly(spark, sf_dir)
    return labels.controls(bars, labels.spikes(bars, 0.5, 6 * market.HOUR, 12 * market.HOUR, 6), 3 * market.HOUR, 6 * market.HOUR).select(*KEY)


@query(f"""WITH {BARS}, l AS (SELECT symbol, open_time, close, list(high) OVER f AS hs, list(low) OVER f AS ls, list(close) OVER f AS cs FROM c WINDOW f AS ({W} ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING)),
    e AS (SELECT *, CAST(list_position(hs, list_max(hs)) AS BIGINT) AS pb, CAST(list_position(ls, list_min(ls)) AS BIGINT) AS tb FROM l)
    SELECT symbol, open_time, pb AS peak_bar, tb AS trough_bar, CASE WHEN pb < tb THEN 'up' WHEN tb < pb THEN 'down' ELSE 'both' END AS first_direction, {r(peak='list_max(hs) / nullif(close, 0) - 1', trough='list_min(ls) / nullif(close, 0) - 1', giveback='list_max(hs) / nullif(close, 0) - cs[-1] / nullif(close, 0)')} FROM e""")
def trajectories(spark, sf_dir):
    out = labels.trajectory(hourly(spark, sf_dir)).withColumns({c: F.col(c).cast("long") for c in ("peak_bar", "trough_bar")})
    return rounded(out, [*KEY, "peak_bar", "trough_bar", "first_direction"], same("peak", "trough", "giveback"))


@query(f"""WITH {TRADES}, e AS (SELECT strategy, value FROM tr WHERE pnl > 0), k AS (SELECT strategy, value FROM tr WHERE pnl <= 0), a AS (SELECT strategy, value, pnl > 0 AS ev, rank() OVER (PARTITION BY strategy ORDER BY value) + (count(*) OVER (PARTITION BY strategy, value) - 1) / 2.0 AS rk FROM tr)
    SELECT strategy, count(*) FILTER (ev) AS n_event, count(*) FILTER (NOT ev) AS n_control, {r(rank_biserial='2 * (avg(rk) FILTER (ev) - avg(rk) FILTER (NOT ev)) / count(*)')} FROM a GROUP BY strategy""")
def rank_biserial(spark, sf_dir):
    return rounded(stats.rank_biserial(trades(spark, sf_dir).withColumn("win", F.col("pnl") > 0), ["strategy"], "value", "win"), ["strategy", "n_event", "n_control"], same("rank_biserial"))


@query(f"""WITH {TRADES}, a AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY quantity) + (count(*) OVER (PARTITION BY symbol, quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY symbol ORDER BY pnl) + (count(*) OVER (PARTITION BY symbol, pnl) - 1) / 2.0 AS y FROM tr)
    SELECT symbol, {r(spearman='corr(x, y)')}, count(*) AS n FROM a GROUP BY symbol""")
def spearman(spark, sf_dir):
    return rounded(stats.spearman(trades(spark, sf_dir), ["symbol"], "quantity", "pnl"), ["symbol", "n"], same("spearman"))


@query(f"""WITH {TRADES}, u AS (SELECT pnl > 0 AS win, feature, value FROM (SELECT pnl, quantity, value AS size, CAST(exit_time - entry_time AS DOUBLE) AS hold FROM tr) UNPIVOT (value FOR feature IN (quantity, size, hold)))
    SELECT feature, count(*) FILTER (win) AS n_event, {r(mean_event='avg(value) FILTER (win)', median_event='median(value) FILTER (win)')}, count(*) FILTER (NOT win) AS n_control, {r(mean_control='avg(value) FILTER (NOT win)', median_control='median(value) FILTER (NOT win)', median_delta='median(value) FILTER (win) - median(value) FILTER (NOT win)')} FROM u GROUP BY feature""")
def feature_comparison(spark, sf_dir):
    t = trades(spark, sf_dir).select((F.col("pnl") > 0).alias("win"), "quantity", F.col("value").alias("size"), (F.col("exit_time") - F.col("entry_time")).cast("double").alias("hold"))
    return rounded(stats.compare_features(t, "win", ["quantity", "size", "hold"]), ["feature", "n_event", "n_control"], same("mean_event", "median_event", "mean_control", "median_control", "median_delta"))


def _rules_sql(rules: dict[str, str]) -> str:
    one = "SELECT '{n}' AS rule, count(*) FILTER ({x} AND w) AS tp, count(*) FILTER ({x} AND NOT w) AS fp, count(*) FILTER (NOT ({x}) AND w) AS fn, count(*) FILTER (NOT ({x}) AND NOT w) AS tn FROM v"
    return f"WITH {TRADES}, v AS (SELECT *, pnl > 0 AS w FROM tr), a AS (" + " UNION ALL ".join(one.format(n=n, x=x) for n, x in rules.items()) + f") SELECT rule, tp, fp, fn, tn, {r(precision='tp / (tp + fp)', recall='tp / (tp + fn)', fpr='fp / (fp + tn)', youden='tp / (tp + fn) - fp / (fp + tn)')} FROM a"


@query(_rules_sql({"large": "value > 50000", "many": "quantity >= 30"}))
def rule_scores(spark, sf_dir):
    t = trades(spark, sf_dir).withColumn("win", F.col("pnl") > 0)
    return rounded(stats.score_rules(t, "win", {"large": F.col("value") > 50000, "many": F.col("quantity") >= 30}), ["rule", "tp", "fp", "fn", "tn"], same("precision", "recall", "fpr", "youden"))


@query(f"""WITH {TRADES}, o AS (SELECT *, (row_number() OVER (ORDER BY exit_time, trade_id, value) - 1) / CAST(count(*) OVER () AS DOUBLE) AS a FROM tr), b AS (SELECT *, CASE WHEN a >= 0.8 THEN 2 WHEN a >= 0.6 THEN 1 ELSE 0 END AS part FROM o)
    SELECT part, count(*) AS trades, {r(net_pnl='sum(pnl)')}, min(exit_time) AS first_exit, max(exit_time) AS last_exit FROM b GROUP BY part""")
def chronological_parts(spark, sf_dir):
    parts = stats.chronological_split(trades(spark, sf_dir), "exit_time", ["trade_id", "value"])
    return parts.groupBy("part").agg(F.count("*").alias("trades"), F.round(F.sum("pnl"), 6).alias("net_pnl"), F.min("exit_time").alias("first_exit"), F.max("exit_time").alias("last_exit"))


@query(f"""WITH {TRADES}, b AS (SELECT strategy, count(*) AS n, avg(pnl) AS m, stddev_samp(pnl) AS s FROM tr GROUP BY strategy)
    SELECT strategy, any_value(b.n) AS n, {r(mean='any_value(b.m)', dev='any_value(b.s)', skew='avg((pnl - b.m) ** 3) / any_value(b.s) ** 3', kurtosis='avg((pnl - b.m) ** 4) / any_value(b.s) ** 4', sharpe='any_value(b.m) / any_value(b.s)')} FROM tr JOIN b USING (strategy) GROUP BY strategy""")
def return_moments(spark, sf_dir):
    return rounded(stats.moments(trades(spark, sf_dir), ["strategy"], "pnl"), ["strategy", "n"], same("mean", "dev", "skew", "kurtosis", "sharpe"))


@query(f"""WITH {TRADES}, l AS (SELECT symbol, strategy, list_sort(list(pnl)) AS v FROM tr GROUP BY ALL) SELECT symbol, strategy, v[greatest(1, CAST(ceil(len(v) * 0.75::DOUBLE) AS INTEGER))] AS p75_nearest, v[CAST(floor((len(v) - 1) * 0.75::DOUBLE) AS INTEGER) + 1] AS p75_floor FROM l""")
def percentile_variants(spark, sf_dir):
    n = F.col("n")
    places = {"p75_nearest": F.greatest(F.lit(1), F.ceil(n * F.lit(0.75))), "p75_floor": F.floor((n - 1) * F.lit(0.75)) + 1}
    return stats.ranked_values(trades(spark, sf_dir), ["symbol", "strategy"], "pnl", places)


@query()
def bootstrap_totals(spark, sf_dir):
    return stats.block_bootstrap(trades(spark, sf_dir), "pnl", ["exit_time", "trade_id", "value"], 200)


@query(f"""WITH {TRADES}, f AS (SELECT strategy, sum(pnl) AS net_pnl, count(*) AS total_trades FROM tr GROUP BY strategy), a AS (SELECT count(*) AS folds, CAST(sum(total_trades) AS BIGINT) AS trades, round(sum(net_pnl), 4) AS net_pnl, count(*) FILTER (net_pnl > 0) AS positive FROM f)
    SELECT *, concat_ws(',', CASE WHEN folds < 3 THEN 'insufficient_folds' END, CASE WHEN trades < 30 THEN 'insufficient_trades' END, CASE WHEN positive * 2 <= folds THEN 'insufficient_positive_fold_majority' END, CASE WHEN net_pnl <= 0 THEN 'non_positive_total_net_pnl' END) AS reasons, CASE WHEN folds >= 3 AND trades >= 30 AND positive * 2 > folds AND net_pnl > 0 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a""")
def walk_forward_verdict(spark, sf_dir):
    folds = trades(spark, sf_dir).groupBy("strategy").agg(F.sum("pnl").alias("net_pnl"), F.count("*").alias("total_trades"))
    return stats.accept_folds(folds).select("folds", "trades", F.round("net_pnl", 4).alias("net_pnl"), "positive", F.array_join("reasons", ",").alias("reasons"), "verdict")


# Ledger reports


@query(f"""WITH {TRADES} SELECT strategy, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, {r(net_pnl='sum(pnl)', win_rate='avg(CASE WHEN pnl > 0 THEN 1.0::DOUBLE ELSE 0 END)', profit_factor='coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0)', commission='sum(commission)', mean_hold='avg(exit_time - entry_time)')}, count(*) FILTER (regexp_matches(lower(reason), 'time|timeout|max_hold|early_failure|stale_position')) AS timeouts FROM tr GROUP BY strategy""")
def strategy_report(spark, sf_dir):
    return rounded(ledger.strategy_report(trades(spark, sf_dir)), ["strategy", "trades", "wins", "timeouts"], same("net_pnl", "win_rate", "profit_factor", "commission", "mean_hold"))


@query(f"WITH {TRADES}, n AS (SELECT strategy, reason, count(*) AS n FROM tr GROUP BY ALL) SELECT * FROM (SELECT strategy, reason, n, CAST(row_number() OVER (PARTITION BY strategy ORDER BY n DESC, reason) AS INTEGER) AS place FROM n) WHERE place <= 2")
def top_reasons(spark, sf_dir):
    return ledger.top_reasons(trades(spark, sf_dir), "strategy", 2)


@query(f"""WITH {TRADES}, a AS (SELECT *, sum(pnl) OVER w AS s, sum(CASE WHEN pnl < 0 THEN 0 ELSE 1 END) OVER w AS g FROM tr WINDOW w AS (PARTITION BY symbol ORDER BY exit_time, trade_id, value ROWS UNBOUNDED PRECEDING)),
    b AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY symbol ORDER BY exit_time, trade_id, value ROWS UNBOUNDED PRECEDING)) AS t, CASE WHEN pnl < 0 THEN sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, g ORDER BY exit_time, trade_id, value ROWS UNBOUNDED PRECEDING) ELSE 0 END AS k FROM a)
    SELECT symbol, count(*) AS trades, {r(expectancy='avg(pnl)', max_drawdown='max(t - s)')}, CAST(max(k) AS BIGINT) AS longest_losses, CAST(arg_max(k, (exit_time, trade_id, value)) AS BIGINT) AS current_losses FROM b GROUP BY symbol""")
def outcome_profile(spark, sf_dir):
    return rounded(ledger.outcome_profile(trades(spark, sf_dir)), ["symbol", "trades", "longest_losses", "current_losses"], same("expectancy", "max_drawdown"))


@query(f"""WITH {TRADES}, m AS (SELECT entry_time AS time, 1 AS kind, -value AS amount, trade_id FROM tr UNION ALL SELECT exit_time, 0, value + pnl, trade_id FROM tr), x AS (SELECT *, time // 86400 AS day, sum(amount) OVER (PARTITION BY time // 86400 ORDER BY time, kind, trade_id, amount ROWS UNBOUNDED PRECEDING) AS run FROM m),
    d AS (SELECT day, sum(amount) AS net, min(run) AS low FROM x GROUP BY day), c AS (SELECT *, 1e9::DOUBLE + coalesce(sum(net) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opening FROM d) SELECT day, round(opening, 4) AS opening, round(opening + low, 4) AS lowest, round(opening + net, 4) AS closing FROM c""")
def solvency_days(spark, sf_dir):
    return rounded(ledger.solvency(trades(spark, sf_dir), 1e9), ["day"], same("opening", "lowest", "closing"), 4)


@query(f"WITH {TRADES} SELECT CASE WHEN exit_time - entry_time >= 31536000 AND value / 100000 <= 0.5 THEN 'locked' ELSE 'normal' END AS label, count(*) AS trades, {r(net_pnl='sum(pnl)', mean_pnl='avg(pnl)', median_pnl='median(pnl)')} FROM tr GROUP BY 1")
def capital_lock(spark, sf_dir):
    out = ledger.capital_lock(trades(spark, sf_dir).withColumn("max_favorable_pct", F.col("value") / 100000), 31_536_000, 0.5)
    return rounded(out, ["label", "trades"], same("net_pnl", "mean_pnl", "median_pnl"))


@query(f"WITH {TRADES} SELECT symbol, strategy, exit_time, trade_id, pnl FROM tr WHERE strategy = '1-URGENT' ORDER BY exit_time DESC, trade_id, value LIMIT 50 OFFSET 10")
def trade_page(spark, sf_dir):
    return ledger.page(trades(spark, sf_dir), 50, 10, [F.col("exit_time").desc(), F.col("trade_id"), F.col("value")], strategy="1-URGENT").select("symbol", "strategy", "exit_time", "trade_id", "pnl")


FORECASTS = """f AS (SELECT event_id AS forecast_id, event_type AS symbol, CAST(5 + (event_id % 3) * 55 AS INTEGER) AS horizon_minutes, CASE WHEN event_id % 2 = 0 THEN 'bull' ELSE 'bear' END AS regime, CASE WHEN user_id % 2 = 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN event_id % 5 = 0 THEN 'pending' ELSE 'evaluated' END AS status,
    CASE WHEN event_id % 5 <> 0 THEN CAST(value > 50 AS INTEGER) END AS direction_correct, CAST(50 + event_id % 40 AS DOUBLE) AS confidence, CASE WHEN event_id % 5 <> 0 THEN value / 1000 END AS outcome_return_pct, epoch_ms(ts) AS created_at FROM events)"""


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    done = i % 5 != 0
    return table(spark, sf_dir, "events").select(i.alias("forecast_id"), F.col("event_type").alias("symbol"), (5 + (i % 3) * 55).cast("int").alias("horizon_minutes"), F.when(i % 2 == 0, "bull").otherwise("bear").alias("regime"), F.when(F.col("user_id") % 2 == 0, "up").otherwise("down").alias("direction"), F.when(done, "evaluated").otherwise("pending").alias("status"), F.when(done, (F.col("value") > 50).cast("int")).alias("direction_correct"), (50 + i % 40).cast("double").alias("confidence"), F.when(done, F.col("value") / 1000).alias("outcome_return_pct"), market.ms_of().alias("created_at"))


@query(f"""WITH {FORECASTS} SELECT horizon_minutes, count(*) AS total, count(*) FILTER (status = 'evaluated') AS evaluated, CAST(sum(direction_correct) FILTER (status = 'evaluated') AS BIGINT) AS correct, count(*) FILTER (status = 'pending') AS pending, {r(mean_confidence='avg(confidence)', mean_return="avg(outcome_return_pct) FILTER (status = 'evaluated')")} FROM f GROUP BY horizon_minutes""")
def forecast_report(spark, sf_dir):
    return rounded(ledger.forecast_report(forecasts(spark, sf_dir)), ["horizon_minutes", "total", "evaluated", "correct", "pending"], same("mean_confidence", "mean_return"))


@query(f"""WITH {FORECASTS}, b AS (SELECT * REPLACE (unnest([upper(symbol), NULL]) AS symbol) FROM f WHERE status = 'evaluated' AND direction_correct IS NOT NULL), m AS (SELECT *, row_number() OVER (PARTITION BY symbol, horizon_minutes, regime, direction ORDER BY created_at, forecast_id) > greatest(1, floor(count(*) OVER (PARTITION BY symbol, horizon_minutes, regime, direction) * 0.7::DOUBLE)) AS late FROM b),
    g AS (SELECT symbol, horizon_minutes, regime, direction, count(*) AS samples, count(*) FILTER (late) AS holdout, avg(direction_correct) FILTER (NOT late) AS a, avg(direction_correct) FILTER (late) AS l, avg(abs(confidence / 100 - direction_correct)) AS e FROM m GROUP BY ALL)
    SELECT symbol, horizon_minutes, regime, direction, samples, holdout, {r(accuracy='a', late_accuracy='l', calibration_error='e')}, CASE WHEN l >= 0.55 AND abs(l - a) <= 0.20 THEN 'active' ELSE 'candidate' END AS status FROM g WHERE samples >= 12 AND holdout >= 4""")
def forecast_lessons(spark, sf_dir):
    return rounded(ledger.lessons(forecasts(spark, sf_dir)), ["symbol", "horizon_minutes", "regime", "direction", "samples", "holdout", "status"], same("accuracy", "late_accuracy", "calibration_error"))


# Retrieval and text


@query("""WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 100 = 0), d AS (SELECT doc_id, text, CAST(embedding AS DOUBLE[]) AS e, quality, CAST(doc_id * 3600 AS DOUBLE) AS seen FROM documents JOIN embeddings ON doc_id = vec_id LEFT JOIN labels USING (doc_id)),
    z AS (SELECT doc_id, e, 0.15 * len(list_intersect(['of', 'the', 'under'], regexp_split_to_array(lower(text), '[^\\pL\\pN]+'))) / 3.0 + 0.15 * exp(-greatest(0, (5000000 - seen) / 86400) / 30) + CASE WHEN quality = 1 THEN 0.10 WHEN quality = 0 THEN -0.10 ELSE 0 END AS rest FROM d),
    s AS (SELECT query_id, doc_id AS document_id, 0.60 * coalesce(list_cosine_similarity(e, q.v), 0) + rest AS score FROM z, q)
    SELECT query_id, document_id, round(CAST(score AS DOUBLE), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS n FROM s) WHERE n <= 20""")
def memory_retrieval(spark, sf_dir):
    """Every vector whose id is divisible by 100 as a query, against all documents with a vector."""
    vectors = table(spark, sf_dir, "embeddings")
    docs = table(spark, sf_dir, "documents").join(vectors, F.col("doc_id") == F.col("vec_id")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    docs = docs.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"), "embedding", (F.col("doc_id") * 3600).cast("double").alias("observed_at"), F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure").alias("outcome"))
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), F.lit("of the under").alias("words"))
    return retrieval.retrieve(docs, asked, 5_000_000.0, 20).select("query_id", "document_id", F.round("score", 6).alias("score"))


@query("""WITH d AS (SELECT doc_id, lang, source, CASE WHEN quality = 1 THEN 'success' WHEN quality = 0 THEN 'failure' END AS o FROM documents JOIN labels USING (doc_id)), p AS (SELECT a.doc_id AS source_id, b.doc_id AS target_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.doc_id DESC) AS n FROM d a JOIN d b ON a.lang = b.lang AND a.source = b.source AND a.o <> b.o AND a.doc_id <> b.doc_id)
    SELECT source_id, target_id, 'contradicts' AS relation FROM p WHERE n <= 20""")
def contradiction_links(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("symbol"), F.col("source").alias("strategy"), F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failure").alias("outcome"), F.col("doc_id").alias("observed_at"))
    return retrieval.contradictions(d, d)


@query("""WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations), h AS (SELECT *, left(t, 100) AS head FROM t), e AS (SELECT *, regexp_extract(head, '^(.*[.!?])(?:\\s|$)', 1) AS sentence FROM h)
    SELECT conv_id, turn, CASE WHEN length(t) <= 100 THEN t WHEN length(sentence) >= 50 THEN sentence ELSE regexp_replace(head, '\\s+\\S*$', '') END AS short, sha256(t) AS hash FROM e""")
def text_helpers(spark, sf_dir):
    """Every turn of a conversation cut to 100 characters at a sentence or a word."""
    squeezed = F.trim(F.regexp_replace("text", r"\s+", " "))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", bounded(F.col("text"), 100).alias("short"), F.sha2(squeezed, 256).alias("hash"))


# Strategies, replays, the query surface


def _bb_sql() -> str:
    return f"{PREPARED}, b AS (SELECT *, CASE WHEN bar >= 21 THEN avg(close) {L(21)} - stddev_pop(close) {L(21)} END AS lo, CASE WHEN bar >= 21 THEN avg(close) {L(21)} + stddev_pop(close) {L(21)} END AS hi, CASE WHEN bar >= 17 THEN CASE WHEN sum(fd) {L(16)} <> 0 THEN 100 - 100 / (1 + sum(fu) {L(16)} / sum(fd) {L(16)}) ELSE 100.0 END END AS mf FROM p), s AS (SELECT symbol, open_time, CASE WHEN close < lo AND mf < 59 THEN 'buy' WHEN close > hi AND mf > 69 THEN 'sell' END AS signal FROM b)"


@query(f"WITH {_bb_sql()} SELECT symbol, coalesce(signal, 'none') AS signal, count(*) AS n FROM s GROUP BY ALL")
def signal_counts(spark, sf_dir):
    df = strategies.bb_mfi(prepared(spark, sf_dir), std=1.0, rsi="")
    return df.groupBy("symbol", F.coalesce("signal", F.lit("none")).alias("signal")).agg(F.count("*").alias("n"))


@query()
def strategy_signals(spark, sf_dir):
    df = strategies.with_signals(strategies.features(hourly(spark, sf_dir)))
    return df.select("symbol", F.explode("signals").alias("strategy", "signal")).groupBy("symbol", "strategy", "signal").agg(F.count("*").alias("n"))


@query(f"""WITH {PREPARED} SELECT symbol, count(*) AS bars, count(*) FILTER (bar >= 21 AND volume / avg_v > 1.2 AND bar >= 14 AND wr < -60) AS n FROM (SELECT *, avg(volume) {P(20)} AS avg_v, {over(f'(max(high) {L(14)} - close) * -100', f'max(high) {L(14)} - min(low) {L(14)}', '-50')} AS wr FROM p) GROUP BY symbol""")
def condition_hits(spark, sf_dir):
    rule = conditions.conditions([{"indicator": "volume_ratio_20", "op": "gt", "value": 1.2}, {"indicator": "williams_r", "op": "<", "value": -60}])
    df = prepared(spark, sf_dir).withColumns({"volume_ratio": ind.volume_ratio(20), "williams_r": ind.williams_r()})
    return df.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(rule).alias("n"))


def replay_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = strategies.bb_mfi(prepared(spark, sf_dir), std=1.0, rsi="").withColumns({"entry_signal": F.coalesce(F.col("signal") == "buy", F.lit(False)), "exit_signal": F.coalesce(F.col("signal") == "sell", F.lit(False))})
    plan = replay.scenarios(spark, [replay.Scenario(), replay.Scenario("wide", 0.3, 0.6, max_hold=48), replay.Scenario("trail", 0.3, None, trail=0.2), replay.Scenario("lock", 0.3, None, arm=0.1, lock=0.02)])
    return replay.replay(df, plan)


@query()
def replay_summary(spark, sf_dir):
    return rounded(replay.summary(replay_trades(spark, sf_dir), ["symbol", "name"]), ["symbol", "name", "trades", "wins"], same("net_pnl", "profit_factor", "commission", "max_drawdown"))


@query()
def replay_exit_reasons(spark, sf_dir):
    return replay.exit_reasons(replay_trades(spark, sf_dir), ["name"])


@query()
def shared_wallet(spark, sf_dir):
    out = replay.shared_wallet(replay_trades(spark, sf_dir), 1200.0, 2)
    return out.groupBy("name").agg(F.count("*").alias("trades"), F.count_if("taken").alias("taken"), F.round(F.sum(F.when(F.col("taken"), F.col("pnl"))), 6).alias("net_pnl"))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY customers DESC, n_name LIMIT 10")
def guarded_select(spark, sf_dir):
    text = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY customers DESC, n_name"
    return guarded_sql.guarded(spark, text, {n: table(spark, sf_dir, n) for n in ("customer", "nation")}, 10)


@query(f"""WITH {TRADES}, m AS (SELECT * FROM tr WHERE upper(strategy) = '1-URGENT' AND upper(symbol) = 'RF') SELECT symbol, strategy, exit_time, trade_id, round(pnl, 6) AS pnl, (SELECT count(*) FROM m) AS matched FROM m ORDER BY exit_time DESC, trade_id DESC LIMIT 200""")
def resource_trades(spark, sf_dir):
    return guarded_sql.resource({"trades": trades(spark, sf_dir)}, "Trades", "rf", "1-urgent", limit=200, order=("exit_time", "trade_id")).select("symbol", "strategy", "exit_time", "trade_id", F.round("pnl", 6).alias("pnl"), "matched")


@query()
def average_cascade(spark, sf_dir):
    return cascade_batch(hourly(spark, sf_dir), sequence=600, breakout=1800, outcome=1800)


@query()
def feature_snapshots(spark, sf_dir):
    df = strategies.radar(strategies.features(hourly(spark, sf_dir)))
    return df.select("symbol", "open_time", "radar", F.round("rsi_wilder", 6).alias("rsi"), F.round("bb_position", 6).alias("bb_position"), "regime", "bos")


from . import research_queries, series_queries  # noqa: E402, F401  register their own
