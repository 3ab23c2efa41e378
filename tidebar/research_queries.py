"""More registered queries: indicator variants and research summaries, with their DuckDB SQL."""

from __future__ import annotations

from math import exp

from pyspark.sql import functions as F

from .functions import indicators as ind
from .functions import variants as var
from .functions.recursive import recursive
from .operators import labels, ledger, research
from .queries import BARS, DI_DOWN, DI_UP, DOWN, FORECASTS, KEY, PREPARED, TRADES, UP, L, P, W, _ema_sql, forecasts, hourly, nine, on, over, prepared, query, r, rounded, same, trades
from .session import table
from .sources import market

SUM = "list_sum(list_transform(list_zip({a}, [{b}]), lambda z: {f}))"


def _weighted(weights: list[float], f: str = "z[1] * z[2]") -> str:
    return SUM.format(a=f"list(close) {L(len(weights))}", b=", ".join(map(repr, weights)), f=f)


KERNEL = [exp(-((29 - k) ** 2) / 200) for k in range(30)]
KERNEL = [w / sum(KERNEL) for w in KERNEL]


@query(f"""WITH {PREPARED}, a AS (SELECT *, coalesce(tr, high - low) AS tf, CASE WHEN bar >= 14 THEN CASE WHEN max(high) {L(14)} = min(low) {L(14)} THEN 50.0 ELSE (close - min(low) {L(14)}) / (max(high) {L(14)} - min(low) {L(14)}) * 100 END END AS raw FROM p),
    b AS (SELECT *, {on(14, f'100 * abs(sum(du) {L(14)} - sum(dd) {L(14)}) / nullif(sum(du) {L(14)} + sum(dd) {L(14)}, 0)')} AS dxf FROM a)
    SELECT symbol, open_time, {r(stoch_fast_k='raw', stoch_fast_d=on(14, f'avg(raw) {L(3)}'), atr_frame=on(14, f'avg(tf) {L(14)}'), dx_frame='dxf', adx_frame=f'CASE WHEN count(dxf) {L(14)} = 14 THEN avg(dxf) {L(14)} END', obv_slope=on(6, over(f'sum(ob) {L(5)}', f'sum(volume) {L(5)}')))} FROM b""")
def frame_variants(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumns({"stoch_raw": ind.raw_stochastic(14), "dx_frame": var.dx_frame()})
    return rounded(df, KEY, {**var.stochastic_raw(), "atr_frame": var.atr_frame(), "dx_frame": F.col("dx_frame"), "adx_frame": var.adx_frame(), "obv_slope": var.obv_slope_share()})


@query(f"""WITH {PREPARED}, a AS (SELECT *, {_weighted(KERNEL)} AS basis, list(close) {L(30)} AS cl, {on(40, _weighted(var.seeded_weights(20, 40)))} AS mid, {on(21, f'avg(tr) {L(20)}')} AS a20, avg(close) {L(20)} AS m20, stddev_pop(close) {L(20)} AS s20 FROM p)
    SELECT symbol, open_time, {r(kernel_lower=on(31, 'basis - 2 * ' + SUM.format(a='cl', b=', '.join(map(repr, KERNEL)), f='abs(z[1] - basis) * z[2]')), squeeze_push=on(42, f'close - ((max(high) {L(20)} + min(low) {L(20)}) / 4 + m20 / 2)'))},
    {on(42, 'CASE WHEN a20 <> 0 AND mid <> 0 THEN m20 - 2 * s20 > mid - 1.5 * a20 AND m20 + 2 * s20 < mid + 1.5 * a20 END')} AS squeeze_on FROM a""")
def squeezes(spark, sf_dir):
    s = var.squeeze()
    df = prepared(spark, sf_dir).withColumn("squeeze_on", s["squeeze_on"])
    return rounded(df, [*KEY, "squeeze_on"], {"kernel_lower": var.kernel_lower(), "squeeze_push": s["squeeze_push"]})


@query(f"""WITH {PREPARED}, g AS (SELECT *, CASE WHEN lag(typical) OVER ({W}) > 0 AND typical > 0 THEN ln(typical / lag(typical) OVER ({W})) ELSE 0.0 END AS d FROM p), h AS (SELECT *, sqrt(sum(d * d) {L(30)} / 30) AS sg, avg(volume) {P(50)} AS av, list({{'d': d, 'v': volume}}) {L(50)} AS b FROM g)
    SELECT symbol, open_time, {r(vfi=on(81, 'CASE WHEN av <> 0 AND sg <> 0 THEN list_sum(list_transform(b, lambda x: CASE WHEN x.d > 0.2::DOUBLE * sg THEN least(x.v, 3 * av) WHEN x.d < -0.2::DOUBLE * sg THEN -least(x.v, 3 * av) ELSE 0.0 END)) / av END'))} FROM h""")
def volume_flow(spark, sf_dir):
    return rounded(prepared(spark, sf_dir).withColumn("log_step", var.log_step()), KEY, {"vfi": var.volume_flow()})


@query(f"""WITH {PREPARED}, a AS (SELECT *, {on(29, DI_UP)} - {on(29, DI_DOWN)} AS gap, {on(15, f'avg(tr) {L(14)}')} AS a14, {on(20, over(f'4 * stddev_pop(close) {L(20)}', f'avg(close) {L(20)}'))} AS bw FROM p), b AS (SELECT *, lag(a14, 5) OVER ({W}) AS a5, lag(bw) OVER ({W}) AS pw, list(bw) FILTER (bw IS NOT NULL) {P(24)} AS ws, min(low) {P(20)} AS fl FROM a)
    SELECT symbol, open_time, {r(di_gap='gap', atr_expansion_5='CASE WHEN a14 <> 0 AND a5 <> 0 THEN a14 / a5 END', lower_wick_ratio='(least(open, close) - low) / nullif(high - low, 0)', close_position='(close - low) / nullif(high - low, 0)')},
    coalesce(len(ws) >= 12 AND bw >= pw * 1.15::DOUBLE AND list_min(ws[-12:]) <= list_sort(ws)[CAST(round_even((len(ws) - 1) * 0.25::DOUBLE, 0) AS INTEGER) + 1], false) AS widening,
    coalesce(bar >= 91 AND low < fl - 0.10::DOUBLE * a14 AND close > fl AND close > open AND least(open, close) - low >= greatest(abs(close - open) * 1.5, 0.10::DOUBLE * a14), false) AS sweep FROM b""")
def entry_shapes(spark, sf_dir):
    df = prepared(spark, sf_dir).withColumns({**ind.dx(), "atr_14": ind.atr(14), "bb_width": ind.bollinger()["bb_width"]})
    df = df.withColumns({"widening": var.widening(), "sweep": var.sweep_reclaim()})
    return rounded(df, [*KEY, "widening", "sweep"], var.entry_shape())


@query(f"""WITH RECURSIVE {PREPARED}, {_ema_sql(9)}, {_ema_sql(21)}, {_ema_sql(50)}, j AS (SELECT p.symbol, p.open_time, p.bar, p.close, e9.v AS a, e21.v AS b, e50.v AS c FROM p LEFT JOIN e9 ON e9.symbol = p.symbol AND e9.bar = p.bar LEFT JOIN e21 ON e21.symbol = p.symbol AND e21.bar = p.bar LEFT JOIN e50 ON e50.symbol = p.symbol AND e50.bar = p.bar)
    SELECT symbol, open_time, coalesce(bar >= 55 AND close > a AND a > b AND b > c AND a > lag(a) OVER ({W}), false) AS radar FROM j""")
def radar_states(spark, sf_dir):
    averages = recursive(hourly(spark, sf_dir), ["ema_9_r", "ema_21_r", "ema_50_r"])
    return prepared(spark, sf_dir).join(averages, ["symbol", "timeframe", "open_time"]).select(*KEY, var.radar_state().alias("radar"))


@query(f"""WITH RECURSIVE {PREPARED}, s AS (SELECT *, coalesce(CAST(sign(change) AS INTEGER), 0) AS sg FROM p), n AS (SELECT *, CASE WHEN sg IS DISTINCT FROM lag(sg) OVER ({W}) THEN 1 ELSE 0 END AS nw FROM s), g AS (SELECT *, sum(nw) OVER ({W}) AS run FROM n),
    k AS (SELECT *, sg * row_number() OVER (PARTITION BY symbol, run ORDER BY open_time) AS streak FROM g), q AS (SELECT *, CASE WHEN bar > 2 THEN streak - lag(streak) OVER ({W}) END AS ds, change / nullif(prev_close, 0) AS roc FROM k), z AS (SELECT *, list(roc) {L(100)} AS past FROM q),
    a AS (SELECT symbol, bar, u, d FROM (SELECT symbol, bar, avg({UP}) {L(3)} AS u, avg({DOWN}) {L(3)} AS d FROM z) WHERE bar = 4 UNION ALL SELECT a.symbol, a.bar + 1, (a.u * 2 + greatest(z.change, 0)) / 3, (a.d * 2 + greatest(-z.change, 0)) / 3 FROM a JOIN z ON z.symbol = a.symbol AND z.bar = a.bar + 1),
    b AS (SELECT symbol, bar, CAST(u AS DOUBLE) AS u, CAST(d AS DOUBLE) AS d FROM (SELECT symbol, bar, avg(greatest(ds, 0)) {L(2)} AS u, avg(greatest(-ds, 0)) {L(2)} AS d FROM z) WHERE bar = 4 UNION ALL SELECT b.symbol, b.bar + 1, (b.u + greatest(z.ds, 0)) / 2, (b.d + greatest(-z.ds, 0)) / 2 FROM b JOIN z ON z.symbol = b.symbol AND z.bar = b.bar + 1)
    SELECT z.symbol, z.open_time, {r(crsi_wilder="CASE WHEN z.bar >= 107 THEN ((CASE WHEN a.d = 0 THEN 100.0 ELSE 100 - 100 / (1 + a.u / a.d) END) + (CASE WHEN b.d = 0 THEN 100.0 ELSE 100 - 100 / (1 + b.u / b.d) END) + 100 * CAST(len(list_filter(past, lambda x: x < roc)) AS DOUBLE) / len(past)) / 3 END")}
    FROM z LEFT JOIN a ON a.symbol = z.symbol AND a.bar = z.bar LEFT JOIN b ON b.symbol = z.symbol AND b.bar = z.bar""")
def connors_wilder(spark, sf_dir):
    return rounded(recursive(hourly(spark, sf_dir), ["crsi_wilder"]), KEY, same("crsi_wilder"))


@query(f"""WITH {PREPARED}, m AS (SELECT *, {on(21, f'volume / nullif(avg(volume) {P(20)}, 0)')} AS vr, greatest(-1, least(1, sum(volume * (0.7 * (2 * close - high - low) / greatest(high - low, 1e-12) + 0.3 * body_sign)) {L(20)} / nullif(sum(volume) {L(20)}, 0))) AS fl, lag(close) OVER ({W}) AS c1, lag(close, 2) OVER ({W}) AS c2, max(close) {P(20)} AS top, avg(volume) {P(20)} AS mv,
    CASE WHEN bar >= 20 THEN {over(f'4 * stddev_pop(close) {L(20)}', f'avg(close) {L(20)}')} END AS bw, avg(close) {L(20)} + 2 * stddev_pop(close) {L(20)} AS bu, avg(close) {L(20)} - 2 * stddev_pop(close) {L(20)} AS bl FROM p),
    n AS (SELECT *, min(CASE WHEN bar >= 21 THEN bw END) {P(19)} AS lw, avg(volume) {L(10)} AS v10 FROM m), o AS (SELECT *, bw <= 1.1::DOUBLE * lw AND volume > 1.5 * v10 AS sq FROM n),
    s AS (SELECT symbol, unnest([CASE WHEN bar >= 25 AND close > top AND volume > 1.5 * mv THEN 'breakout:buy' END, CASE WHEN bar >= 22 AND close > top AND volume >= 1.15::DOUBLE * mv AND (CASE WHEN bar >= 20 THEN coalesce(fl, 0) ELSE 0 END) >= 0 THEN 'donchian_breakout:buy' END, CASE WHEN bar >= 20 AND fl >= 0.10::DOUBLE AND close > c1 AND c1 > c2 THEN 'order_flow:buy' END,
    CASE WHEN sq AND close > bu THEN 'bollinger_squeeze:buy' WHEN sq AND close < bl THEN 'bollinger_squeeze:sell' END, CASE WHEN sq AND close > bu AND fl >= 0.10::DOUBLE THEN 'squeeze_flow:buy' END]) AS said FROM o)
    SELECT symbol, split_part(said, ':', 1) AS strategy, split_part(said, ':', 2) AS signal, count(*) AS n FROM s WHERE said IS NOT NULL GROUP BY ALL""")
def rule_signals(spark, sf_dir):
    """The rules that need no recursion."""
    from .plans import strategies

    names = ["breakout", "donchian_breakout", "order_flow", "bollinger_squeeze", "squeeze_flow"]
    df = strategies.with_signals(strategies.features(hourly(spark, sf_dir)), names)
    return df.select("symbol", F.explode("signals").alias("strategy", "signal")).groupBy("symbol", "strategy", "signal").agg(F.count("*").alias("n"))


@query(f"""WITH {BARS}, m AS (SELECT symbol, CASE WHEN close / nullif(open, 0) - 1 >= 0.2::DOUBLE THEN 'confirmed' WHEN high / nullif(open, 0) - 1 >= 0.2::DOUBLE THEN 'wick_only' END AS move FROM c) SELECT symbol, move, count(*) AS n FROM m WHERE move IS NOT NULL GROUP BY ALL""")
def hour_moves(spark, sf_dir):
    df = hourly(spark, sf_dir).withColumn("move", var.hour_move(0.20)).where("move is not null")
    return df.groupBy("symbol", "move").agg(F.count("*").alias("n"))


@query(f"""WITH {PREPARED}, g AS (SELECT symbol, open_time, (close / nullif(lag(close) OVER ({W}), 0) - 1) * 100 AS ret, CASE WHEN bar >= 15 THEN CASE WHEN avg({DOWN}) {L(14)} = 0 THEN CASE WHEN avg({UP}) {L(14)} > 0 THEN 100.0 ELSE 50.0 END ELSE 100 - 100 / (1 + avg({UP}) {L(14)} / avg({DOWN}) {L(14)}) END END AS rsi,
    CASE WHEN bar >= 21 THEN avg(close) {L(9)} / avg(close) {L(21)} - 1 END AS gap, close - lag(close) OVER ({W}) AS dl FROM p)
    SELECT symbol, CASE WHEN ret <= -1 AND coalesce(rsi, 100) <= 40 THEN 'dip_reversal' WHEN ret >= 1 AND coalesce(gap, 0) > 0 THEN 'trend_continuation' ELSE 'other' END AS regime, count(*) AS n, {r(mean_delta='avg(dl)')} FROM g GROUP BY ALL""")
def observed_regimes(spark, sf_dir):
    gap = ind.ready(21, F.avg("close").over(ind.last(9)) / F.avg("close").over(ind.last(21)) - 1)
    df = prepared(spark, sf_dir).withColumns({"regime": var.observed_regime(ind.change_over(1) * 100, ind.rsi_simple(14), gap), "_d": var.delta("close")})
    return df.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.round(F.avg("_d"), 6).alias("mean_delta"))


@query(f"""WITH {TRADES} SELECT strategy, count(*) AS trades, {r(net_pnl='sum(pnl)', win_rate_pct='count(*) FILTER (pnl > 0) / count(*) * 100', profit_factor='coalesce(sum(pnl) FILTER (pnl > 0), 0) / nullif(-sum(pnl) FILTER (pnl < 0), 0)', commission='sum(commission)')}, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses FROM tr GROUP BY strategy""")
def cost_aware_metrics(spark, sf_dir):
    return rounded(research.cost_aware(trades(spark, sf_dir), ["strategy"]), ["strategy", "trades", "wins", "losses"], same("net_pnl", "win_rate_pct", "profit_factor", "commission"))


@query(f"""WITH {TRADES}, f AS (SELECT pnl > 0 AS w, unnest([{{'flag': 'large', 'x': value > 50000}}, {{'flag': 'long', 'x': exit_time - entry_time > 2592000}}, {{'flag': 'many', 'x': quantity >= 30}}], recursive := true) FROM tr)
    SELECT flag, count(*) FILTER (w) AS n_event, count(*) FILTER (NOT w) AS n_control, {r(rate_event='avg(CAST(x AS INTEGER)) FILTER (w)', rate_control='avg(CAST(x AS INTEGER)) FILTER (NOT w)')} FROM f GROUP BY flag""")
def flag_rates(spark, sf_dir):
    t = trades(spark, sf_dir).select((F.col("pnl") > 0).alias("w"), (F.col("value") > 50000).alias("large"), (F.col("exit_time") - F.col("entry_time") > 2592000).alias("long"), (F.col("quantity") >= 30).alias("many"))
    return rounded(research.rate_compare(t, "w", ["large", "long", "many"]), ["flag", "n_event", "n_control"], same("rate_event", "rate_control"))


@query(f"""WITH {TRADES}, e AS (SELECT CAST((value > 50000) AS INTEGER) + CAST(quantity >= 30 AS INTEGER) + CAST(exit_time - entry_time > 2592000 AS INTEGER) AS score, pnl FROM tr) SELECT t.threshold, score, count(*) AS n, {r(mean='avg(pnl)')} FROM e, (VALUES (1), (2), (3)) t(threshold) WHERE score >= threshold GROUP BY ALL""")
def score_thresholds(spark, sf_dir):
    one = lambda c: c.cast("int")
    score = one(F.col("value") > 50000) + one(F.col("quantity") >= 30) + one(F.col("exit_time") - F.col("entry_time") > 2592000)
    return rounded(research.threshold_summary(trades(spark, sf_dir).withColumn("score", score), [1, 2, 3], value="pnl"), ["threshold", "score", "n"], same("mean"))


def _ahead_sql(hours: int) -> str:
    f = f"OVER ({W} RANGE BETWEEN 1 FOLLOWING AND {hours * 3600000} FOLLOWING)"
    return f"SELECT '{hours}h' AS horizon, max(high) {f} / nullif(close, 0) - 1 AS up, min(low) {f} / nullif(close, 0) - 1 AS down, last_value(close) {f} / nullif(close, 0) - 1 AS ret FROM c"


def _at_sql(v: str, q: float) -> str:
    return f"list_sort(list({v}))[CAST(floor((count({v}) - 1) * {q}::DOUBLE) AS INTEGER) + 1]"


@query(f"""WITH {BARS}, o AS ({_ahead_sql(2)} UNION ALL {_ahead_sql(12)}) SELECT horizon, count(*) AS n, {r(median_up=_at_sql('up', 0.5), p75_up=_at_sql('up', 0.75), median_ret=_at_sql('ret', 0.5), median_down=_at_sql('down', 0.5), hit_rate='avg(CAST(up >= 0.01::DOUBLE AS INTEGER))', net_rate='avg(CAST(ret > 0.003::DOUBLE AS INTEGER))')} FROM o WHERE up IS NOT NULL GROUP BY horizon""")
def horizon_outcomes(spark, sf_dir):
    out = labels.outcomes(hourly(spark, sf_dir), {"2h": 2 * market.HOUR, "12h": 12 * market.HOUR})
    return rounded(research.horizon_summary(out, ["2h", "12h"]), ["horizon", "n"], same("median_up", "p75_up", "median_ret", "median_down", "hit_rate", "net_rate"))


@query(f"""WITH {TRADES}, w AS (SELECT strategy, exit_time // 31536000 AS span, sum(pnl) AS net FROM tr GROUP BY ALL), g AS (SELECT strategy, count(*) AS windows, arg_min(net, span) AS a, arg_max(net, span) AS b FROM w GROUP BY strategy), q AS (SELECT *, CASE WHEN a > 0 AND windows >= 2 THEN round(b / a, 4) END AS degradation_ratio FROM g)
    SELECT strategy, windows, degradation_ratio, CASE WHEN windows < 2 THEN 'INSUFFICIENT_WINDOWS' WHEN degradation_ratio >= 0.5 THEN 'STABLE' ELSE 'DEGRADED' END AS status FROM q""")
def walk_forward_degradation(spark, sf_dir):
    spans = trades(spark, sf_dir).groupBy("strategy", F.floor(F.col("exit_time") / 31536000).alias("span")).agg(F.sum("pnl").alias("net_pnl"))
    return research.degradation(spans, "span", by=["strategy"])


@query(f"""WITH {BARS}, e AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM c GROUP BY symbol), g AS (SELECT symbol, unnest(range(a, b + 1, 5400000)) AS sample_time FROM e) SELECT g.symbol, g.sample_time, c.close, CAST(timezone('Europe/Istanbul', to_timestamp(g.sample_time // 1000)) AS DATE) AS day FROM g ASOF LEFT JOIN c ON c.symbol = g.symbol AND g.sample_time >= c.open_time""")
def sampled_grid(spark, sf_dir):
    """Every 90 minutes, with the day in Istanbul."""
    out = research.sample_grid(hourly(spark, sf_dir), ["close"], 5_400_000)
    return out.select("symbol", "sample_time", "close", research.day_key(F.col("sample_time"), "Europe/Istanbul").alias("day"))


@query(f"""WITH {BARS}, n AS (SELECT *, row_number() OVER ({W}) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM c), k AS (SELECT DISTINCT symbol, CAST(round_even(i.i * (n - 1) / 24.0::DOUBLE, 0) AS BIGINT) AS p FROM n, range(25) i(i)) SELECT n.symbol, n.open_time, n.close FROM n LEFT JOIN k USING (symbol, p) WHERE n.n <= 25 OR k.p IS NOT NULL""")
def spaced_bars(spark, sf_dir):
    return research.spaced_sample(hourly(spark, sf_dir), "symbol", ["open_time"], 25).select(*KEY, "close")


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000) SELECT k, 'both' AS held FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT c_custkey, 'no_order' FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)""")
def set_filters(spark, sf_dir):
    """Keys in both of two sets, and customers without an order."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    both = orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")).intersect(customers.where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")))
    none = customers.select(F.col("c_custkey").alias("k")).join(orders.select(F.col("o_custkey").alias("k")), "k", "left_anti")
    return both.withColumn("held", F.lit("both")).unionByName(none.withColumn("held", F.lit("no_order")))


@query(f"""WITH {FORECASTS}, g AS (SELECT * REPLACE (CASE WHEN horizon_minutes = 60 THEN NULL ELSE symbol END AS symbol), json_array(regime, direction) AS tags FROM f) SELECT forecast_id, symbol, horizon_minutes FROM g WHERE (symbol IS NULL OR symbol = 'click') AND list_contains(CAST(tags AS VARCHAR[]), 'bull') AND created_at + horizon_minutes * 60000 <= 1706745600000""")
def due_in_scope(spark, sf_dir):
    """Forecasts for one symbol or for all, tagged in a JSON list, whose horizon is over."""
    f = forecasts(spark, sf_dir).withColumns({"symbol": F.when(F.col("horizon_minutes") != 60, F.col("symbol")), "tags": F.to_json(F.array("regime", "direction"))})
    found = research.due(research.listed(research.scoped(f, symbol="click"), "tags", "bull"), 1_706_745_600_000, F.col("horizon_minutes").cast("long") * 60_000)
    return found.select("forecast_id", "symbol", "horizon_minutes")


@query(f"""WITH {PREPARED}, d AS (SELECT *, {on(29, DI_UP)} AS pd, {on(29, DI_DOWN)} AS md, close / nullif(lag(close, 12) OVER ({W}), 0) - 1 AS r12, close / nullif(lag(close, 3) OVER ({W}), 0) - 1 AS r3 FROM p)
    SELECT symbol, count(*) AS bars, count(*) FILTER (CASE WHEN pd + md <> 0 THEN 100 * abs(pd - md) / (pd + md) ELSE 0 END >= 20 AND md - pd >= 5 AND r12 <= -0.005::DOUBLE AND r3 <= -0.005::DOUBLE) AS pressed FROM d GROUP BY symbol""")
def bear_pressure(spark, sf_dir):
    from .operators import gates

    df = prepared(spark, sf_dir).withColumns({**ind.dx(), "return_12": ind.change_over(12), "return_3": ind.change_over(3)})
    return df.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if(gates.bear_pressure(20, 5)).alias("pressed"))


@query(f"""WITH {BARS}, d0 AS (SELECT symbol, (open_time // 86400000) * 86400000 AS open_time, arg_min(open, open_time) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_time) AS close FROM c GROUP BY 1, 2), d AS (SELECT *, CASE WHEN close > 0 THEN (high - low) / close END AS own FROM d0),
    a AS (SELECT *, count(own) {P(14)} = 14 AND open > 0 AS known, avg(own) {P(14)} AS mean, CASE WHEN close > 0 THEN greatest(close, open) / least(close, open) - 1 ELSE 0 END AS moved FROM d), s AS (SELECT *, CASE WHEN mean > 0 THEN moved / mean ELSE 1 END AS share FROM a)
    SELECT symbol, open_time, {r(adr_pct='CASE WHEN known THEN mean END', range_pct='CASE WHEN known THEN moved END', utilization='CASE WHEN known THEN share END')}, CASE WHEN known THEN mean >= 0.02::DOUBLE AND mean - moved >= 0.01::DOUBLE AND share <= 0.8::DOUBLE ELSE true END AS adr_ok FROM s""")
def day_range_capacity(spark, sf_dir):
    from .operators import gates

    days = market.resample(hourly(spark, sf_dir), "1d")
    df = days.withColumns(gates.adr_capacity())
    return rounded(df, [*KEY, "adr_ok"], same("adr_pct", "range_pct", "utilization"))


@query(f"""WITH {PREPARED}, e AS (SELECT symbol, arg_max(close, open_time) AS close, arg_max(c12, open_time) AS c12, arg_max(bar, open_time) AS bar FROM (SELECT *, lag(close, 12) OVER ({W}) AS c12 FROM p) GROUP BY symbol), x AS (SELECT symbol, bar >= 50 AS ok, (close / nullif(c12, 0) - 1) * 10 AS score, CASE WHEN close > c12 THEN 'bullish' ELSE 'bearish' END AS way FROM e),
    a AS (SELECT count(*) AS n, avg(CASE WHEN way = 'bullish' THEN 1.0::DOUBLE ELSE 0 END) AS pt, avg(coalesce(score, 0)) AS m FROM x WHERE ok), s AS (SELECT *, CASE WHEN n >= 3 THEN greatest(0, least(100, 50 + pt * 35 + greatest(-15, least(15, m * 5)))) END AS s FROM a)
    SELECT n AS sample_size, CASE WHEN n < 3 THEN 'UNKNOWN' WHEN s >= 70 THEN 'RISK_ON' WHEN s <= 35 THEN 'RISK_OFF' ELSE 'NEUTRAL' END AS zone, round(s, 2) AS score, CASE WHEN n >= 3 THEN round(least(0.9::DOUBLE, 0.35::DOUBLE + n / 40), 3) ELSE 0 END::DOUBLE AS confidence, CASE WHEN n >= 3 THEN round(pt, 4) END AS bullish_participation FROM s""")
def market_zone(spark, sf_dir):
    w = ind.series()
    newest = prepared(spark, sf_dir).withColumn("c12", F.lag("close", 12).over(w)).groupBy("symbol").agg(*[F.max_by(c, "open_time").alias(c) for c in ("close", "c12", "bar")])
    rows = newest.select("symbol", (F.col("bar") >= 50).alias("data_ready"), ((F.col("close") / F.nullif(F.col("c12"), F.lit(0.0)) - 1) * 10).alias("score"), F.when(F.col("close") > F.col("c12"), "bullish").otherwise("bearish").alias("trend_direction"))
    return ledger.local_regime(rows)
