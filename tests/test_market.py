"""Literal series with known results, causality, replays and streams."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidebar.functions import indicators as ind
from tidebar.functions.patterns import candlesticks, fair_value_gap, volume_profile, with_structure, with_td9, with_wicks
from tidebar.functions.recursive import Ema, Kama, WilderRsi, recursive
from tidebar.functions.scalars import bounded, direction, erf, fold_text, percentile, trade_economics
from tidebar.operators import joins, labels, ledger, replay, retrieval, stats
from tidebar.plans import conditions, guarded_sql, strategies
from tidebar.sources import market
from tidebar.streaming import market as streams


def candles(spark, opens, highs, lows, closes, volumes=None, step=60_000):
    data = [("X", "1m", i * step, i * step + step - 1, float(o), float(h), float(lo), float(c), float(v), float(v)) for i, (o, h, lo, c, v) in enumerate(zip(opens, highs, lows, closes, volumes or [100] * len(closes)))]
    return spark.createDataFrame(data, market.CANDLE)


def newest(df, *columns):
    return df.orderBy(F.col("open_time").desc()).select(*columns).first()


def test_td9_counts_nine(spark):
    c = list(range(1, 14))
    assert tuple(newest(with_td9(ind.prepare(candles(spark, c, c, c, c))), "td9_up", "td9_exhaustion")) == (9, "uptrend_9")


@pytest.mark.parametrize(("highs", "lows", "closes", "side"), [([10, 11, 13], [8, 9, 12], [9, 10, 12.5], "bullish"), ([10, 11, 10.4], [8, 9, 10.3], [9, 10, 10.35], "none")])
def test_gap(spark, highs, lows, closes, side):
    assert newest(ind.prepare(candles(spark, closes, highs, lows, closes)).withColumns(fair_value_gap(size=F.lit(2.0))), "fvg_side")[0] == side


def test_break_of_structure_needs_a_confirmed_swing(spark):
    highs, lows, closes = [10, 11, 12, 11, 10, 11, 12, 11, 10, 13], [8, 9, 10, 9, 8, 9, 10, 9, 8, 11], [9, 10, 11, 10, 9, 10, 11, 10, 9, 12.5]
    assert newest(with_structure(ind.prepare(candles(spark, closes, highs, lows, closes)), 2), "bos")[0] == "bullish"


def test_wick_rejection_and_profile(spark):
    highs = [10.8 + (i % 2) * 0.1 for i in range(20)] + [15]
    df = ind.prepare(candles(spark, [10] * 21, highs, [9] * 21, [10.2] * 20 + [9.5]))
    assert newest(with_wicks(df), "wick_signal")[0] == "bearish_rejection"
    found = newest(df.withColumn("v", volume_profile(20, 8)), "v.poc", "v.low", "v.high")
    assert found[1] <= found[0] <= found[2]


@pytest.mark.parametrize(("bars", "label"), [([(12, 12.2, 11.8, 12), (11.5, 11.6, 11.2, 11.3), (11, 11.1, 10, 10.2), (10.1, 11.4, 10, 11.2)], "bullish_engulfing"), ([(10, 10.2, 9.8, 10), (10.5, 10.8, 10.4, 10.7), (10.8, 11.9, 10.7, 11.7), (11.8, 11.9, 10.5, 10.6)], "bearish_engulfing")])
def test_engulfing(spark, bars, label):
    assert label in newest(ind.prepare(candles(spark, *zip(*bars))).withColumn("p", candlesticks()), "p")[0]


def test_machines():
    e = Ema(3)
    assert [e(x) for x in (1, 2, 3, 5)] == [None, None, 2.0, 3.5]
    r = WilderRsi(2)
    assert [r(x) for x in (1, 2, 3)] == [None, None, 100.0]
    k = Kama()
    assert [k(float(i)) for i in range(11)][-1][1] == 1.0


def test_no_look_ahead(spark):
    """Cutting the series off never changes what was said before."""
    import numpy as np

    rng = np.random.default_rng(3)
    c = (100 + rng.normal(0, 1, 150).cumsum()).tolist()
    whole = candles(spark, c, [x + 1 for x in c], [x - 1 for x in c], c, rng.integers(50, 150, 150).tolist())
    names = ["open_time", "ema_9", "rsi_wilder", "macd_hist", "crsi", "bos", "td9_up", "confluence", "supertrend", "sar", "ut_signal"]
    a = strategies.features(whole).where(F.col("open_time") <= 120 * 60_000).select(names).orderBy("open_time").collect()
    b = strategies.features(whole.where(F.col("open_time") <= 120 * 60_000)).select(names).orderBy("open_time").collect()
    assert a == b


def test_fast_and_slow_signals_agree(spark):
    closes = [100 + ((i % 17) - 8) * 0.31 + i * 0.012 for i in range(120)]
    df = candles(spark, [c - 0.08 for c in closes], [c + 0.4 for c in closes], [c - 0.5 for c in closes], closes, [100 + (i % 11) * 9 for i in range(120)])
    slow = []
    for i in range(20, 120):
        own, r = closes[i - 20 : i + 1], WilderRsi(13)
        rsi = [r(x) for x in closes[: i + 1]][-1]
        mid = sum(own) / 21
        dev = (sum((x - mid) ** 2 for x in own) / 21) ** 0.5
        tp = [(c + 0.4 + c - 0.5 + c) / 3 for c in closes[: i + 1]]
        flow = [(t, u * v) for t, u, v in zip([b > a for a, b in zip(tp, tp[1:])], tp[1:], [100 + (k % 11) * 9 for k in range(1, i + 1)])][-16:]
        neg = sum(f for up, f in flow if not up)
        mfi = 100 - 100 / (1 + sum(f for up, f in flow if up) / neg) if neg else 100.0
        slow.append("buy" if closes[i] < mid - dev and mfi < 59 else "sell" if closes[i] > mid + dev and rsi > 69 and mfi > 69 else None)
    both = ind.prepare(df).join(recursive(df).select("symbol", "timeframe", "open_time", "rsi_wilder"), ["symbol", "timeframe", "open_time"])
    # The rule's own RSI has 13 bars.
    r13 = WilderRsi(13)
    rsi = spark.createDataFrame([(i * 60_000, r13(x)) for i, x in enumerate(closes)], "open_time long, rsi13 double")
    fast = strategies.bb_mfi(both.join(rsi, "open_time"), std=1.0, rsi="rsi13").orderBy("open_time")
    assert [x["signal"] for x in fast.collect()][20:] == slow


def test_rows_and_duplicates(spark):
    rows = spark.createDataFrame([("X", "1m", ["0", "1", "2", "0.5", "1.5", "10", "59999", "15"]), ("X", "1m", ["0", "1", "2", "0.5", "1.7", "10", "59999", "15"]), ("X", "1m", ["60000", "bad", "2", "1", "1", "1", "119999", "1"])], "symbol string, timeframe string, row array<string>")
    got = market.from_rows(rows)
    assert got.count() == 2
    marked = got.withColumn("arrival", F.col("close"))
    assert [x["close"] for x in market.closed(marked, 60_000).collect()] == [1.7]
    assert [x["close"] for x in market.first_by_close(marked).collect()] == [1.5]
    assert market.closed(marked, 10).count() == 0


def test_order_book(spark):
    df = spark.createDataFrame([([(10.0, 2.0), (9.0, 3.0)], [(11.0, 4.0), (12.0, 5.0)]), ([], [])], "bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    a, b = market.book_top(df).collect()
    assert (a["bid_qty"], a["ask_qty"], a["spread_pct"]) == (5.0, 9.0, pytest.approx(0.1))
    assert b["bid_price"] is None and b["orderflow_imbalance"] is None


def test_walk_forward_reasons(spark):
    verdict = lambda *f: stats.accept_folds(spark.createDataFrame(f, "net_pnl double, total_trades int")).first()
    assert verdict((2.0, 12), (2.0, 12), (-10.0, 12))["reasons"] == ["non_positive_total_net_pnl"]
    assert verdict((2.0, 2), (2.0, 2))["reasons"] == ["insufficient_folds", "insufficient_trades"]
    assert verdict((2.0, 12), (2.0, 12), (2.0, 12))["verdict"] == "PASS"


def test_forecast_report_and_evaluation(spark):
    f = spark.createDataFrame([("a", 5, "evaluated", 1, 70.0, 0.01), ("b", 5, "evaluated", 0, 60.0, -0.01), ("c", 5, "pending", None, 55.0, None), ("d", 60, "evaluated", 1, 65.0, 0.02)], "forecast_id string, horizon_minutes int, status string, direction_correct int, confidence double, outcome_return_pct double")
    five = ledger.forecast_report(f).where("horizon_minutes = 5").first()
    assert (five["evaluated"], five["correct"], five["pending"]) == (2, 1, 1)
    e = labels.evaluate_forecasts(spark.createDataFrame([("up", 100.0, 102.0, 103.0, 99.0, 98.0)], "direction string, entry double, outcome double, high double, low double, invalidation double"), 0.01).first()
    assert e["correct"] and not e["invalidated"] and e["outcome_return"] == pytest.approx(0.02)


def test_replay_fills_next_open_and_stop_wins(spark):
    df = candles(spark, [100, 101, 100, 100], [101, 120, 101, 101], [99, 50, 99, 99], [100, 100, 100, 100]).withColumns({"entry_signal": F.col("open_time") == 0, "exit_signal": F.lit(False)})
    plan = replay.scenarios(spark, [replay.Scenario(stop=0.1, target=0.1, fee=0.0, slip=0.0)])
    t = replay.replay(df, plan).collect()
    assert len(t) == 1 and t[0]["entry"] == 101 and t[0]["reason"] == "stop" and t[0]["exit"] == pytest.approx(90.9)
    held = replay.replay(df, replay.scenarios(spark, [replay.Scenario(stop=None, target=None)])).collect()
    assert [x["reason"] for x in held] == ["open_at_end"]
    late = replay.replay(df, replay.scenarios(spark, [replay.Scenario(start_ms=60_000)]))
    assert late.count() == 0


def test_wallet_identity(spark):
    t = spark.createDataFrame([("s", "A", 0, 10, 100.0, 1.0, 5.0), ("s", "B", 1, 5, 100.0, 1.0, -5.0), ("s", "C", 20, 30, 100.0, 1.0, 1.0)], "name string, symbol string, entry_time long, exit_time long, entry double, quantity double, pnl double")
    out = replay.shared_wallet(t, 150.0, 2).orderBy("entry_time").collect()
    assert [x["taken"] for x in out] == [True, False, True] and out[-1]["cash"] == 150 + 5 - 100


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0)], "close double, crsi double")
    rule = conditions.conditions([{"indicator": "close", "op": "gt", "value": 2}, {"indicator": "crsi", "op": "eq", "value": "2"}])
    assert [x[0] for x in df.select(rule).collect()] == [False, True]
    assert not df.select(conditions.conditions([])).first()[0]
    for bad in ([{"indicator": "nope", "op": "<", "value": 1}], [{"indicator": "close", "op": "<", "value": "x"}], ["close < 1"], [{"indicator": "close", "op": "<", "value": 1}] * 9):
        with pytest.raises(ValueError):
            conditions.conditions(bad)
    with pytest.raises(ValueError):
        conditions.strategy({"exit_policy": {"mode": "never"}})
    with pytest.raises(ValueError, match="trailing_stop_pct"):
        conditions.ExitPolicy.read({"use_trailing_stop": True, "trailing_stop_pct": 2})
    assert conditions.strategy({"entry": [{"indicator": "close", "op": "gt", "value": 2}]})[2] == {"stop": 0.02, "target": 0.03, "trail": None, "max_hold": None}
    policy = {"mode": "conditions_only", "use_trailing_stop": True, "trailing_stop_pct": 0.1, "use_max_hold": True, "max_hold_bars": 5}
    assert conditions.strategy({"exit_policy": policy})[2] == {"stop": None, "target": None, "trail": 0.1, "max_hold": 5}


@pytest.mark.parametrize("text", ["DROP TABLE x", "SELECT 1; SELECT 2", "SELECT * FROM secret", "WITH a AS (SELECT * FROM secret) SELECT * FROM a"])
def test_guard_refuses(spark, text):
    with pytest.raises(ValueError):
        guarded_sql.guarded(spark, text, {"x": spark.range(1)})


def test_guard_limits(spark):
    assert guarded_sql.guarded(spark, "SELECT * FROM x WHERE id >= 0", {"x": spark.range(1000)}, 9999).count() == 500


def test_scalars(spark):
    row = spark.createDataFrame([("One two. Three four five six", " LONG ", [3.0, 1.0, None, 2.0])], "t string, d string, v array<double>").select(bounded(F.col("t"), 12), direction(F.col("d")), percentile(F.col("v"), 0.5), fold_text(F.lit("İŞĞ ı")), erf(F.lit(0.5))).first()
    assert row[0] == "One two." and row[1] == "up" and row[2] == 2.0 and row[3] == "isg i" and row[4] == pytest.approx(0.5204999, abs=2e-7)
    e = spark.range(1).select(*[c.alias(n) for n, c in trade_economics(F.lit(100.0), F.lit(98.0), F.lit(104.0), F.lit(1.0)).items()]).first()
    assert e["reward_to_risk"] == pytest.approx((4 - 0.4) / (2 + 0.4))


def test_cooldown_and_cosine(spark):
    df = spark.createDataFrame([("X", "1m", i, i % 2 == 0) for i in range(10)], "symbol string, timeframe string, open_time long, hit boolean")
    assert sorted(x["open_time"] for x in labels.cooldown(df, 3).collect()) == [0, 4, 8]
    v = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<double>, b array<double>")
    assert [x[0] for x in v.select(retrieval.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, None, None]


def test_asof_keeps_every_left_row(spark):
    a = spark.createDataFrame([("k", 5, 1), ("k", 10, 2), ("q", 1, 3)], "k string, t long, id int")
    b = spark.createDataFrame([("k", 5, "x"), ("k", 7, None)], "k string, t long, v string")
    got = {x["id"]: x["v"] for x in joins.asof(a, b, ["k"], "t", "t", ["v"]).collect()}
    assert got == {1: "x", 2: None, 3: None}
    assert {x["id"]: x["v"] for x in joins.asof(a, b, ["k"], "t", "t", ["v"], strict=True).collect()}[1] is None


def test_cascade_batch_and_stream_agree(spark, tmp_path):
    closes = [108] * 75 + [105] * 19 + [100] * 6 + [138, 140, 140, 145] + [146] * 30
    df = candles(spark, closes, [c + 1 for c in closes], [c - 1 for c in closes], closes).select("symbol", "open_time", "close", "high", "low")
    batch = sorted(map(tuple, streams.cascade_batch(df).collect()))
    assert [x[1] for x in sorted(batch, key=lambda x: x[4])] == ["cascade", "breakout", "outcome"]
    outcome = next(x for x in batch if x[1] == "outcome")
    assert outcome[8] > 0 and outcome[9] >= outcome[8] and outcome[2] == "X-" + str(outcome[3])
    src = str(tmp_path / "c")
    for part in range(3):
        df.where(F.floor(F.col("open_time") / 60_000 / 50) == part).coalesce(1).write.mode("append").parquet(src)
    q = streams.cascade_stream(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)).writeStream.format("memory").queryName("cascade").option("checkpointLocation", str(tmp_path / "k")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cascade").collect())) == batch


def test_candle_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    src = str(tmp_path / "e")
    events.repartitionByRange(3, "ts").write.parquet(src)
    q = streams.candle_stream(streams.tick_stream(spark, src, events.schema), late="30 days").writeStream.format("memory").queryName("bars").option("checkpointLocation", str(tmp_path / "k")).outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    last = {(x["symbol"], x["open_time"]): x for x in spark.table("bars").collect()}
    batch = market.bars(market.ticks(events)).collect()
    assert len(last) >= len(batch)
    best = {}
    for x in spark.table("bars").collect():
        k = (x["symbol"], x["open_time"])
        if k not in best or x["volume"] > best[k]["volume"]:
            best[k] = x
    for x in batch:
        assert tuple(best[x["symbol"], x["open_time"]][c] for c in ("open", "high", "low", "close", "volume")) == tuple(x[c] for c in ("open", "high", "low", "close", "volume"))


def test_alerts_rearm():
    a = streams.Alert()
    got = [a.step(t, v, "gt", 10, 9, 0) for t, v in enumerate([9, 11, 12, 9.5, 11, 8.9, 11])]
    assert got == [False, True, False, False, False, False, True]


def test_sink_goes_on_from_what_is_stored(spark, tmp_path):
    """A stream that starts anew counts its batches from 0 again, and a batch may come twice: no stored row is lost."""
    path, cols = str(tmp_path / "table"), "symbol string, open_time long, close double, fetched_at double"
    write = streams.upsert_sink(path, ["symbol", "open_time"], "fetched_at")
    assert streams.read_latest(spark, path) is None
    first, second = spark.createDataFrame([("X", 1, 1.0, 1.0), ("X", 2, 2.0, 1.0)], cols), spark.createDataFrame([("X", 2, 9.0, 2.0), ("Y", 1, 3.0, 2.0)], cols)
    for epoch, batch in enumerate([first, second, second]):
        write(batch, epoch if epoch < 1 else 0)
    want = {("X", 1): 1.0, ("X", 2): 9.0, ("Y", 1): 3.0}
    assert {(x["symbol"], x["open_time"]): x["close"] for x in streams.read_latest(spark, path).collect()} == want
    (tmp_path / "table" / "v9").mkdir()
    write(first.limit(0), 0)
    assert streams.read_latest(spark, path).count() == 3


def walk(n, seed):
    rng = random.Random(seed)
    closes = [100.0]
    for _ in range(n - 1):
        closes.append(closes[-1] * (1 + rng.gauss(0, 0.02)))
    opens = [closes[0], *closes[:-1]]
    return opens, [max(o, c) * 1.005 for o, c in zip(opens, closes)], [min(o, c) * 0.995 for o, c in zip(opens, closes)], closes


def test_spikes_against_a_plain_walk(spark):
    opens, highs, lows, closes = walk(200, 3)
    horizon, cool, rise, want, allowed = 15, 20, 0.04, [], 0
    for i in range(200):
        ahead = range(i + 1, min(200, i + horizon + 1))
        if i < allowed or not ahead or max(highs[k] for k in ahead) / closes[i] - 1 < rise:
            continue
        peak = max(ahead, key=lambda k: (highs[k], -k))
        crossed = next(k for k in ahead if highs[k] / closes[i] - 1 >= rise)
        onset = min(range(max(0, crossed - horizon), crossed + 1), key=lambda k: lows[k])
        want.append((i, peak, crossed, onset))
        allowed = peak + cool
    got = labels.spikes(candles(spark, opens, highs, lows, closes), rise, horizon * 60_000, cool * 60_000).collect()
    assert sorted((x["open_time"] // 60_000, x["peak_time"] // 60_000, x["crossed_at"] // 60_000, x["onset_at"] // 60_000) for x in got) == want and len(want) > 2


def test_whole_window_stop_against_a_plain_walk(spark):
    opens, highs, lows, closes = walk(90, 4)
    got = {x["bar"]: x["s"] for x in ind.prepare(candles(spark, opens, highs, lows, closes)).select("bar", ind.ut_whole(window=40).alias("s")).collect()}
    for n in range(1, 91):
        want = None
        if n >= 16:
            ranges = [max(highs[k] - lows[k], abs(highs[k] - closes[k - 1]), abs(lows[k] - closes[k - 1])) for k in range(n - 11, n)]
            gap, stop = sum(ranges) / 11, []
            smooth = [(opens[k] + highs[k] + lows[k] + closes[k]) / 4 for k in range(max(0, n - 40), n)]
            for k, x in enumerate(smooth):
                if not k:
                    stop.append(x - gap)
                elif x > stop[-1] and smooth[k - 1] > stop[-1]:
                    stop.append(max(stop[-1], x - gap))
                elif x < stop[-1] and smooth[k - 1] < stop[-1]:
                    stop.append(min(stop[-1], x + gap))
                else:
                    stop.append(x - gap if x > stop[-1] else x + gap)
            want = "buy" if smooth[-1] > stop[-1] and smooth[-2] <= stop[-2] else "sell" if smooth[-1] < stop[-1] and smooth[-2] >= stop[-2] else None
        assert got[n] == want
    assert {"buy", "sell"} <= set(got.values())


def test_alerts_cool_down_and_expire():
    a = streams.Alert()
    assert [a.step(t, v, "lte", 10, None, 3, 20) for t, v in [(0, 9), (1, 9), (2, 9), (4, 9), (5, 12), (9, None), (10, 9), (30, 9)]] == [True, False, False, True, False, False, True, False]


def test_bootstrap_blocks_are_whole_series_of_n(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(50)], "t long, pnl double")
    assert {x["total"] for x in stats.block_bootstrap(df, "pnl", ["t"], 20).collect()} == {50.0}
    assert [x["_at"] for x in stats.numbered(df.union(df), ["t", "pnl"]).orderBy("_at").collect()] == list(range(100))
