"""Linear recurrences and several timeframes at once against plain loops, with hard cases."""

from __future__ import annotations

import random
from contextlib import contextmanager
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from tidebar.functions.linear import NAMES, average, gaussian_trend, linear, run
from tidebar.operators import multiframe
from tidebar.operators.joins import asof
from tidebar.operators.multiframe import alignment_counts, backfill, entry_features, frame_features, ribbon, snapshots
from tidebar.sources.market import CANDLE, MINUTE, resample


@contextmanager
def settings(spark, **values):
    kept = {k: spark.conf.get(k) for k in values}
    try:
        for k, v in values.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


def walk(seed, symbol="A", n=200, timeframe="1m", gaps=(1, 1, 2, 9)):
    rng, rows, x, t = random.Random(seed), [], 100.0, 0
    for _ in range(n):
        o, x, t = x, x * (1 + rng.gauss(0, 0.01)), t + MINUTE * rng.choice(gaps)
        rows.append((symbol, timeframe, t, t + MINUTE - 1, o, max(o, x) * 1.001, min(o, x) * 0.999, x, rng.random() * 10, 1.0))
    return rows


def mean_seeded(xs, n):
    out, v = [], None
    for i, x in enumerate(xs, 1):
        v = sum(xs[:n]) / n if i == n else None if i < n else v + 2 / (n + 1) * (x - v)
        out.append(v)
    return out


def plain(rows):
    """Some of the indicators of one series, by loops."""
    o, h, lo, c = ([r[k] for r in rows] for k in (4, 5, 6, 7))
    fast, slow = mean_seeded(c, 12), mean_seeded(c, 26)
    line = [a - b for a, b in zip(fast[25:], slow[25:])]
    signal = [None] * 25 + mean_seeded(line, 9)
    rsi, up, down = [None] * len(c), 0.0, 0.0
    for i in range(1, len(c)):
        g, d = max(c[i] - c[i - 1], 0), max(c[i - 1] - c[i], 0)
        up, down = (up + g / 14, down + d / 14) if i <= 14 else ((up * 13 + g) / 14, (down * 13 + d) / 14)
        rsi[i] = None if i < 14 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    ha, was = [], None
    for i in range(len(c)):
        was = (o[0] + c[0]) / 2 if was is None else (was + (o[i - 1] + h[i - 1] + lo[i - 1] + c[i - 1]) / 4) / 2
        ha.append(was)
    return {"ema_21_r": mean_seeded(c, 21), "macd_signal": signal, "rsi_wilder": rsi, "ha_open": ha, "bear_power": [None if m is None else x - m for x, m in zip(lo, mean_seeded(c, 13))]}


@pytest.mark.parametrize("fan", [3, 128])
def test_linear(spark, fan):
    rows = walk(1) + walk(2, "B", 30) + walk(3, "C", 1) + walk(4, "A", 40, "5m")
    blank = [(*rows[0][:7], None, *rows[0][8:]), (None, *rows[1][1:])]
    names = ["ema_21_r", "macd_signal", "rsi_wilder", "ha_open", "bear_power"]
    df = spark.createDataFrame(rows + blank, CANDLE)
    got = sorted(tuple(r) for r in linear(df, names, fan).collect())
    want = []
    for key, own in groupby(sorted(rows), key=lambda r: r[:2]):
        own = list(own)
        values = plain(own)
        want += [(*key, r[2], *(values[n][i] if i < len(values[n]) else None for n in names)) for i, r in enumerate(own)]
    assert [r[:3] for r in got] == [r[:3] for r in want]
    for x, y in zip(got, want):
        assert x[3:] == tuple(None if v is None else pytest.approx(v, rel=1e-9, abs=1e-9) for v in y[3:])
    assert linear(df.limit(0), ["dpmo", "tsi"]).count() == 0


def test_gaussian_filter_of_equal_poles(spark):
    """Against the one recurrence of order five that equal poles multiply out to."""
    from math import comb, cos, pi, sqrt

    rows = walk(5, n=90)
    c = [r[7] for r in rows]
    b = (1 - cos(2 * pi / 25)) / (1.414 ** (2 / 5) - 1)
    a = -b + sqrt(b * b + 2 * b)
    out = []
    for i in range(len(c)):
        if not i:
            out.append(None)
            continue
        own = c[max(0, i - 9) : i + 1]
        mean = sum(own) / len(own)
        held = c[i] if len(own) == 10 and abs(c[i] - c[i - 1]) >= (sum((x - mean) ** 2 for x in own) / 9) ** 0.5 else c[i - 1]
        out.append(a**5 * held + sum((-1) ** (r + 1) * comb(5, r) * (1 - a) ** r * (out[i - r] or 0.0) for r in range(1, 6) if i - r >= 0))
    got = gaussian_trend(spark.createDataFrame(rows, CANDLE), fan=7).orderBy("open_time").collect()
    assert [r["gf"] for r in got] == [None if x is None else pytest.approx(x, rel=1e-8) for x in out]
    turns = [i for i in range(3, 90) if out[i] > out[i - 1] and out[i - 1] <= out[i - 2]]
    assert [i for i, r in enumerate(got) if r["gf_long"]] == turns


def test_one_long_series_is_many_tasks_work(spark):
    bars = spark.range(300_000).select(F.lit("A").alias("symbol"), F.lit("1m").alias("timeframe"), (F.col("id") * MINUTE).alias("open_time"), (F.col("id") % 7).cast("double").alias("x"))
    with settings(spark, **{"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        out = run(bars, [average("m", 9, source=lambda row, past: row["x"])], ["x"])
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        last = out.where(F.col("open_time") == 299_999 * MINUTE).first()["m"]
    assert sum(sizes) == 300_000 and len(sizes) == 8 and max(sizes) <= 1.5 * 300_000 / 8
    assert last == pytest.approx(mean_seeded([float(i % 7) for i in range(299_000, 300_000)], 9)[-1])


# As-of of several frames


def stream_of(spark, rows):
    return spark.createDataFrame(rows, "symbol string, timeframe string, close_time long, v double, note string").select("symbol", "timeframe", "close_time", F.struct("v", "note").alias("features"))


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [None, 7, 10_000])
def test_snapshots(spark, strict, bucket):
    rng = random.Random(bucket)
    rows = [(rng.choice(["A", "A", "A", "B", None]), rng.choice(["x", "y", "z"]), rng.randrange(100), float(rng.randrange(50)), rng.choice([None, "n"])) for _ in range(150)]
    left = [(i, rng.choice(["A", "B", "C", None]), rng.choice([None, *range(-5, 120)])) for i in range(80)]
    left += [left[0]]
    got = snapshots(spark.createDataFrame(left, "id int, symbol string, at long"), stream_of(spark, rows), ("x", "y", "w"), "at", strict=strict, bucket_ms=bucket)

    def want(symbol, at):
        out = {}
        for f in ("x", "y"):
            own = [(t, v, note is not None, note) for s, g, t, v, note in rows if s == symbol and g == f and at is not None and (t < at or t == at and not strict)]
            if own:
                out[f] = (max(own)[1], max(own)[3])
        return out

    assert sorted((r["id"], str(sorted((k, tuple(v)) for k, v in r["tf"].items()))) for r in got.collect()) == sorted((i, str(sorted(want(s, t).items()))) for i, s, t in left)


def test_snapshots_deal_rows_once_and_cut_a_hot_key(spark):
    left = spark.range(4000).select(F.lit("A").alias("symbol"), F.col("id").alias("at"))
    stream = spark.range(4000).select(F.lit("A").alias("symbol"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("timeframe"), F.col("id").alias("close_time"), F.struct(F.col("id").cast("double").alias("v")).alias("features"))
    one = snapshots(left, stream, ("x", "y"), "at")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
    many = snapshots(left, stream, ("x", "y"), "at", bucket_ms=50)
    with settings(spark, **{"spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        sizes = [r["count"] for r in many.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.6 * 4000
    key = lambda df: sorted((r["at"], r["tf"]["x"]["v"], (r["tf"].get("y") or {"v": None})["v"]) for r in df.collect())
    assert key(one) == key(many)


def test_entries_look_at_closed_bars_only(spark):
    minutes = spark.createDataFrame(walk(6, n=700, gaps=(1,)), CANDLE)
    candles = minutes.unionByName(resample(minutes, "5m"))
    stream = frame_features(candles)
    signals = minutes.where(F.col("open_time") % (7 * MINUTE) == 0).select("symbol", "close_time", F.col("close").alias("price"))
    whole = entry_features(signals, stream)
    at = 500 * MINUTE
    cut = entry_features(signals.where(F.col("close_time") <= at), frame_features(candles.where(F.col("close_time") <= at)))
    as_rows = lambda df: sorted((r["close_time"], str(sorted(r["tf"].items()))) for r in df.where(F.col("close_time") <= at).collect())
    assert as_rows(whole) == as_rows(cut)
    counts = whole.select("close_time", *[c.alias(k) for k, c in alignment_counts(("1m", "5m")).items()]).orderBy("close_time").collect()
    assert counts[0]["mtf_all_ready"] is False and counts[-1]["mtf_all_ready"] is True
    assert all(r["mtf_bullish_count"] + r["mtf_bearish_count"] + r["mtf_mixed_count"] == 2 for r in counts)
    found = {(r["symbol"], r["timeframe"]): r for r in ribbon(minutes.select("symbol"), stream, at, ("1m", "5m", "1h")).collect()}
    assert found["A", "1h"]["alignment"] == "unknown" and not found["A", "1h"]["data_ready"] and found["A", "5m"]["closed_at_ms"] <= at < found["A", "5m"]["closed_at_ms"] + 5 * MINUTE


def test_backfill_twice_is_backfill_once(spark):
    stream = frame_features(spark.createDataFrame(walk(7, n=120, gaps=(1,)), CANDLE))
    trades = spark.createDataFrame([(1, "A", 90 * MINUTE, 50.0, 1.5), (2, "A", None, 50.0, 2.5), (3, None, 90 * MINUTE, 50.0, 3.5), (4, "A", 10 * MINUTE, 50.0, 4.5)], "id int, symbol string, entry_time long, entry_price double, pnl double")
    once = backfill(trades, stream)
    rows = {r["id"]: r for r in once.collect()}
    assert rows[1]["mtf_version"] == multiframe.VERSION and list(rows[1]["tf"]) == ["1m"] and rows[4]["tf"] == {} and rows[4]["mtf_version"] == multiframe.VERSION
    assert rows[2]["mtf_version"] is None and rows[3]["tf"] is None and [rows[i]["pnl"] for i in (1, 2, 3, 4)] == [1.5, 2.5, 3.5, 4.5]
    empty = stream.limit(0)
    again = {r["id"]: r for r in backfill(once, empty).collect()}
    assert again == rows
    assert {r["id"]: r["tf"] for r in backfill(once, empty, force=True).collect()}[1] == {}
    assert {r["mtf_version"] for r in backfill(once, stream, version="next").collect()} == {"next", None}


def test_names():
    assert {"dpmo", "rsi_ewm", "tsi"} <= NAMES


@pytest.mark.parametrize("forward,strict", [(False, False), (False, True), (True, False)])
def test_asof_in_buckets(spark, forward, strict):
    rng = random.Random(7)
    left = spark.createDataFrame([(i, rng.choice("ab"), rng.randrange(200)) for i in range(60)], "id int, k string, t long")
    right = spark.createDataFrame([(rng.choice("aab"), rng.randrange(200), rng.choice([None, 1.0, 2.0]), i % 3) for i in range(90)], "k string, u long, v double, w int")
    key = lambda df: sorted((r["id"], str(r["r_v"]), str(r["r_w"])) for r in df.collect())
    one, cut = (key(asof(left, right, ["k"], "t", "u", ["v", "w"], strict, forward, "r_", b)) for b in (None, 9))
    assert one == cut and any(x[1] == "None" and x[2] != "None" for x in one)
