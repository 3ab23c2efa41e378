"""Gates fail closed; orders match in order; the paged source reads and filters."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tests.test_market import candles, newest
from tidebar.functions import indicators as ind
from tidebar.operators import gates, orders
from tidebar.sources import klines


def test_liquidity_fails_closed(spark):
    schema = "name string, ticker_ms long, last_price double, kline_ms long, bars int, volume double, mean_volume double, book_ms long, bid_qty double, ask_qty double, spread_pct double, day_ms long, quote_volume double"
    now, good = 10**9, dict(name="good", ticker_ms=10**9, last_price=100.0, kline_ms=10**9, bars=21, volume=10.0, mean_volume=10.0, book_ms=10**9, bid_qty=30.0, ask_qty=25.0, spread_pct=0.1, day_ms=10**9, quote_volume=2e6)
    cases = {
        "good": {}, "nothing": dict.fromkeys(list(good)[1:]), "old book": {"book_ms": now - 5001}, "few bars": {"bars": 20}, "old day": {"day_ms": now - 30_001}, "old ticker": {"ticker_ms": now - 15_001}, "old bars": {"kline_ms": now - 630_001},
        "thin": {"bid_qty": 24.9}, "wide": {"spread_pct": 0.31}, "quiet": {"volume": 2.9}, "quiet but large": {"volume": 2.9, "quote_volume": 3e6}, "small": {"quote_volume": 999_999.0},
    }
    df = spark.createDataFrame([tuple((good | change | {"name": name}).values()) for name, change in cases.items()], schema)
    want = {
        "good": [], "nothing": ["fresh_inputs", "quote_volume", "volume_ratio", "spread", "orderbook_depth"], "old book": ["fresh_inputs"], "few bars": ["fresh_inputs", "volume_ratio"], "old day": ["fresh_inputs"], "old ticker": ["fresh_inputs"], "old bars": ["fresh_inputs"],
        "thin": ["orderbook_depth"], "wide": ["spread"], "quiet": ["volume_ratio"], "quiet but large": [], "small": ["quote_volume"],
    }
    rows = {r["name"]: r for r in gates.liquidity(df, now, 1095.0).collect()}
    assert {n: r["liquidity_reasons"] for n, r in rows.items()} == want and all(r["liquid"] == (not r["liquidity_reasons"]) for r in rows.values())
    assert rows["nothing"]["missing_or_stale"] == ["ticker", "kline", "orderbook", "ticker_24h"] and rows["old book"]["missing_or_stale"] == ["orderbook"]
    # Shortly after the start what is missing is passed over, and only that.
    early = {r["name"]: r["liquidity_reasons"] for r in gates.liquidity(df, now, 1095.0, started_ms=now - 20_000).collect()}
    assert {n for n, found in early.items() if found} == {"thin", "wide", "quiet", "small"}
    assert [r["liquid"] for r in gates.liquidity(df.where("name = 'nothing'"), now, 1095.0, started_ms=now - 20_001).collect()] == [False]


def test_gates(spark):
    one = "struct<alignment:string,radar_bullish:boolean,volume_ratio_20:double,orderflow_proxy_20:double,rsi_14:double,atr_pct:double,bb_width_pct:double,bb_position:double>"
    good, poor = ("bullish", True, 1.5, 0.1, 38.0, 0.01, 0.05, 0.1), ("mixed", False, 0.5, -0.1, 60.0, 0.0001, 0.001, 0.9)
    df = spark.createDataFrame([(dict.fromkeys(gates.FRAMES, good),), (dict.fromkeys(gates.FRAMES, poor),), ({"1h": good},), ({"1h": good, "15m": good},)], f"tf map<string,{one}>")
    want = {"bullish-count": [1, 0, 0, 0], "all-5": [1, 0, 0, 0], "all-5-volume-flow": [1, 0, 0, 0], "acetry-rule": [1, 0, 0, 0], "acetry-rule-relaxed": [1, 0, 0, 0], "high-tf": [1, 0, 1, 1], "score": [1, 0, 1, 1]}
    for mode in gates.MODES:
        assert [int(x[0]) for x in df.select(gates.mtf_gate(mode)).collect()] == want[mode]
    plan = spark.createDataFrame([(100.0, 98.0, 105.0, 1.0, 500.0), (100.0, 101.0, 99.0, 0.0, 50.0)], "entry double, stop double, target double, quantity double, cash double")
    assert [x[0] for x in plan.select(F.size(gates.plan_problems())).collect()] == [0, 3]
    assert [x[0] for x in plan.select(F.round(gates.order_value(F.col("cash") * 1.0015), 6)).collect()] == [250.0, 5.0]


def test_activity(spark):
    flat = candles(spark, [100] * 40, [100] * 40, [100] * 40, [100] * 40)
    got = {x["bar"]: x["activity"] for x in gates.activity(ind.prepare(flat)).collect()}
    assert got[5] == "WARMING" and got[40] == "PASSIVE"
    move = candles(spark, [100] * 40, [103] * 40, [99] * 40, [101] * 40)
    df = gates.activity(ind.prepare(move)).withColumns({"volume_ratio": ind.volume_ratio(20), "atr_pct": ind.atr(14) / F.col("close"), "spread_pct": F.lit(0.0)})
    last = df.select("activity", gates.quality_score().alias("q"), gates.quiet_score().alias("z"), gates.compressed().alias("c")).where("activity = 'ACTIVE'").collect()[-1]
    assert last["q"] > 0 and last["z"] < 0.5 and last["c"] is False
    days = gates.adr_capacity()
    got = newest(ind.prepare(move).withColumns(days), "adr_pct", "range_pct", "utilization", "adr_ok")
    assert got[0] == pytest.approx(4 / 101) and got[1] == pytest.approx(0.01) and got[3] is True
    assert newest(ind.prepare(candles(spark, [100] * 5, [103] * 5, [99] * 5, [101] * 5)).withColumns(days), "adr_pct", "adr_ok") == (None, True)


def test_orders(spark):
    bars = candles(spark, [100, 100, 100, 100], [101, 106, 101, 101], [99, 99, 90, 99], [100] * 4)
    rows = [("X", 0, "m", "MARKET", "BUY", None, None, None, "k1"), ("X", 0, "n", "MARKET", "BUY", None, None, None, "k1"), ("X", 1, "t", "LIMIT", "SELL", 105.0, None, "g", None), ("X", 1, "s", "STOP_MARKET", "SELL", None, 95.0, "g", None), ("X", 1, "l", "STOP_LIMIT", "BUY", 92.0, 104.0, None, None), ("X", 1, "o", "LIMIT", "BUY", 50.0, None, None, None)]
    o = spark.createDataFrame(rows, "symbol string, time long, order_id string, kind string, side string, limit double, stop double, oco string, idempotency_key string")
    got = {x["order_id"]: (x["status"], x["price"]) for x in orders.match_orders(o, bars).collect()}
    assert got == {"m": ("FILLED", 100.0), "n": ("DUPLICATE", None), "t": ("FILLED", 105.0), "s": ("CANCELLED", None), "l": ("FILLED", 92.0), "o": ("OPEN", None)}


def test_guards_and_jobs(spark):
    old = spark.createDataFrame([("A", 1, "x"), ("B", 4, "y")], "symbol string, revision int, note string")
    new = spark.createDataFrame([("B", "z"), ("C", "w")], "symbol string, note string")
    assert {x["symbol"]: (x["revision"], x["note"]) for x in orders.upsert_guard(old, new).collect()} == {"A": (1, "x"), "B": (5, "z"), "C": (1, "w")}
    jobs = spark.createDataFrame([("1", "pending", 0, 0.0, 2.0), ("2", "failed", 1, 0.0, 1.0), ("3", "failed", 3, 0.0, 0.0), ("4", "failed", 1, 95.0, 0.0)], "job_id string, status string, attempts int, updated_at double, created_at double")
    assert [x["job_id"] for x in orders.claim_jobs(jobs, 100.0).collect()] == ["2", "1"]
    t = spark.createDataFrame([("A", 3, -1.0), ("A", 2, -1.0), ("A", 1, 1.0)], "symbol string, exit_time long, pnl double")
    assert orders.leading_losses(t).first()["loss_run"] == 2


def test_kline_source(spark, tmp_path):
    rows = [[i * 60_000, "1", "2", "0.5", "1.5", "10", i * 60_000 + 59_999, "15", 3] for i in range(1500)]
    file = tmp_path / "k.json"
    file.write_text(json.dumps({"code": 0, "data": {"list": rows}}))
    got = klines.read_klines(spark, url=f"file://{file}", symbols="A,B", timeframe="1m", start_ms=0, end_ms=1200 * 60_000)
    assert got.count() == 2400 and got.where("symbol = 'A'").select("open_time").distinct().count() == 1200
    with pytest.raises(ValueError):
        klines.payload(b'{"code": 5}')
    assert klines.delay(0, "7") == 7.0 and 0.25 <= klines.delay(0, None) <= 0.5
    klines.write_report(got.limit(2), str(tmp_path / "r"), "csv")
    assert spark.read.option("header", "true").csv(str(tmp_path / "r")).count() == 2
