"""Streams against the same rows as tables: forecasts, marks, sampled books, and the sink by ranges."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tidebar.streaming import evaluation as ev
from tidebar.streaming.market import _versions

MINUTE = 60_000
FORECASTS, BARS = "forecast_id string, symbol string, created_ms long, due_ms long", "symbol string, close_time long, close double, high double, low double"


def files(spark, path, batches, schema):
    """One file a batch, named in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b={i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"file://{path}")


def drained(query):
    query.processAllAvailable()
    query.stop()


@pytest.fixture
def store(spark):
    key, value = ev.STORE
    spark.conf.set(key, value)
    yield
    spark.conf.unset(key)


def test_due_forecasts(spark, tmp_path, store):
    rng = random.Random(2)
    bars, asked = [], []
    for symbol in ("A", "B"):
        t, x = 0, 100.0
        for _ in range(60):
            t += MINUTE * rng.choice([1, 1, 1, 2, 15])
            x *= 1 + rng.gauss(0, 0.01)
            bars.append((symbol, t, x, x * 1.01, x * 0.99))
        asked += [(f"{symbol}{i}", symbol, at, at + rng.choice([5, 15]) * MINUTE) for i, at in enumerate(rng.sample(range(MINUTE, t), 25))]
    asked += [asked[0], ("late", "A", 5 * MINUTE, 10 * MINUTE), ("open", "B", 10**9, 10**9 + MINUTE)]
    # In order of time but for a minute, in files; what comes an hour late is dropped.
    events = sorted([(r[2] + rng.randrange(MINUTE), 0, r) for r in asked if r[0] != "late"] + [(r[1] + rng.randrange(MINUTE), 1, r) for r in bars])
    cut = [events[i : i + 12] for i in range(0, len(events), 12)]
    late_at = next(i for i, part in enumerate(cut) if part[0][0] > 90 * MINUTE)
    fs = [[r for _, k, r in part if k == 0] for part in cut]
    bs = [[r for _, k, r in part if k == 1] for part in cut]
    fs[late_at].append(asked[-2])
    far = [("A", 10**9 - 1, 1.0, 1.0, 1.0), ("B", 10**9 - 1, 1.0, 1.0, 1.0)]
    forecasts, closed = files(spark, tmp_path / "f", [*fs, [asked[-1]]], FORECASTS), files(spark, tmp_path / "b", [*bs, far], BARS)
    out = ev.due_stream(forecasts, closed, "2 minutes", 10 * MINUTE)
    drained(out.writeStream.format("memory").queryName("due").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    got = {tuple(r) for r in spark.table("due").collect()}
    want = ev.due_batch(spark.createDataFrame([r for r in asked if r[0] != "late"], FORECASTS), spark.createDataFrame(bars + far, BARS), 10 * MINUTE, 10**9 - 3 * MINUTE)
    want = {tuple(r) for r in want.collect()}
    assert {r[1] for r in want} == {"evaluated", "expired"} and len(want) == 50
    assert got == want

    def plain(r):
        end = next((b for b in sorted(bars + far) if b[0] == r[1] and b[1] >= r[3]), None)
        if end[1] > r[3] + 10 * MINUTE:
            return (r[0], "expired", None, None, None, None)
        own = [b for b in bars if b[0] == r[1] and r[2] <= b[1] <= end[1]]
        return (r[0], "evaluated", end[1], end[2], max(b[3] for b in own), min(b[4] for b in own))

    assert want == {plain(r) for r in asked[:50]}


def test_graded(spark):
    df = spark.createDataFrame([("YUKARI", 100.0, 0.01, 102.0, 103.0, 99.0, 98.0), ("aşağı", 100.0, None, 99.0, 101.0, 98.0, 100.5), ("yatay", 100.0, 0.0, 100.1, 101.0, 99.0, None), ("up", 100.0, 0.01, None, None, None, 1.0)], "direction string, entry_price double, min_move_pct double, outcome_price double, max_high double, min_low double, invalidation_price double")
    rows = ev.graded(df).collect()
    assert [(r["outcome_direction"], r["direction_correct"], r["invalidation_hit"]) for r in rows] == [("up", True, False), ("down", True, True), ("range", True, None), (None, None, None)]
    assert rows[0]["outcome_return_pct"] == pytest.approx(0.02) and rows[0]["max_adverse_pct"] == pytest.approx(-0.01)


def at(seconds):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=seconds)


def test_marks(spark, tmp_path):
    rng = random.Random(3)
    positions = [(f"p{i}", rng.choice("AB"), at(rng.randrange(3000)), float(i % 3), 100.0) for i in range(12)]
    prices = [(rng.choice("AB"), at(rng.randrange(4000)), i, 90 + 20 * rng.random()) for i in range(200)] + [("A", at(2000), 900, 1.0), ("A", at(2000), 901, 2.0)]
    a, b = "position_id string, symbol string, opened_at timestamp, quantity double, entry_price double", "symbol string, time timestamp, seq int, price double"
    key = lambda df: sorted((r["position_id"], r["marked_at"], round(r["price"], 9), round(r["value"], 6), round(r["pnl"], 6)) for r in df.collect())
    batch = key(ev.marks(spark.createDataFrame(positions, a), spark.createDataFrame(prices, b), "20 minutes"))
    want = {}
    for name, symbol, opened, n, entry in positions:
        for s, t, seq, price in prices:
            if s == symbol and opened <= t <= opened + timedelta(minutes=20):
                end = int(t.timestamp() // 60 * 60 + 60) * 1000
                want[name, end] = max(want.get((name, end), (t, seq, 0)), (t, seq, price))
    assert [(x[0], x[1], x[2]) for x in batch] == sorted((k[0], k[1], round(v[2], 9)) for k, v in want.items())
    in_order = lambda rows, i: [sorted(rows, key=lambda r: r[i])[j : j + 20] for j in range(0, len(rows), 20)]
    left = files(spark, tmp_path / "p", [*in_order(positions, 2), [("end", "C", at(90_000), 1.0, 1.0)], [("end", "C", at(90_001), 1.0, 1.0)]], a)
    right = files(spark, tmp_path / "t", [*in_order(prices, 1), [("C", at(90_000), 1, 1.0)], [("C", at(90_001), 1, 1.0)]], b)
    drained(ev.marks(left, right, "20 minutes", late="3 hours").writeStream.format("memory").queryName("marks").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    assert key(spark.table("marks").where("position_id <> 'end'")) == batch


def test_sampled_books(spark, tmp_path):
    rng = random.Random(4)
    schema = "symbol string, updated_at timestamp, bid_qty double, ask_qty double, spread_pct double, price double"
    rows = sorted((rng.choice("AB"), at(rng.randrange(100_000) / 1000), float(rng.randrange(5)), 1.0, 0.1, 2.0) for _ in range(40))
    rows = sorted(rows, key=lambda r: r[1]) + [("A", at(500), 0.0, 0.0, 0.1, 0.0)]
    rows += [rows[3]]
    key = lambda df: {(r["symbol"], r["captured_at"]): (r["updated_ms"], r["bid_qty"], r["depth"], r["orderflow_imbalance"]) for r in df.collect()}
    batch = key(ev.sampled_books(spark.createDataFrame(rows, schema)))
    base = int(at(0).timestamp())
    for s in range(0, 130):
        for symbol in "AB":
            own = [r for r in rows if r[0] == symbol and 0 <= base + s - r[1].timestamp() and base + s <= int(r[1].timestamp()) + 10]
            best = max(own, key=lambda r: r[1:], default=None)
            found = batch.get((symbol, base + s))
            assert (found and found[1]) == (best and best[2])
    assert batch["A", base + 505][2] is None and batch["A", base + 505][3] is None
    stream = files(spark, tmp_path / "s", [rows[i : i + 10] for i in range(0, len(rows), 10)] + [[("Z", at(9000), 1.0, 1.0, 0.0, 1.0)], [("Z", at(9001), 1.0, 1.0, 0.0, 1.0)]], schema)
    drained(ev.sampled_books(stream, late="1 hour").writeStream.format("memory").queryName("books").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start())
    assert {k: v for k, v in key(spark.table("books")).items() if k[0] != "Z"} == batch


def test_ranged_sink(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    schema = "symbol string, open_time long, close double, fetched_at long"
    write = ev.ranged_sink(path, ["symbol", "open_time"], "fetched_at", F.concat_ws("/", "symbol", F.floor(F.col("open_time") / 100)), kept=2)
    assert ev.read_ranged(spark, path) is None
    rng, want, seen = random.Random(5), {}, []
    for epoch in range(5):
        rows = [(rng.choice(["A b", "é%", None, ""]), rng.randrange(400), rng.random(), rng.randrange(10)) for _ in range(30)] if epoch else [("A b", i, 0.5, 5) for i in range(400)]
        rows = list({r[:2]: r for r in rows}.values())
        for _ in range(2 if epoch == 2 else 1):
            write(spark.createDataFrame(rows, schema), epoch if epoch != 3 else 0)
        for r in rows:
            if r[:2] not in want or r[3] >= want[r[:2]][3]:
                want[r[:2]] = r
        seen.append({tuple(r) for r in ev.read_ranged(spark, path).collect()})
        assert seen[-1] == set(want.values())
    # A batch of one range writes that range only.
    before = ev._where(spark, path, _versions(spark, f"{path}/lists")[-1])
    write(spark.createDataFrame([("A b", 150, 9.0, 99)], schema), 9)
    after = ev._where(spark, path, _versions(spark, f"{path}/lists")[-1])
    assert {r for r in after if after[r] != before.get(r)} == {"A b/1"} and ev.read_ranged(spark, path).where("close = 9.0").count() == 1
    assert len(_versions(spark, f"{path}/lists")) == 2
    # An attempt that wrote data but no list is as if it had not been.
    spark.createDataFrame([("A b", 150, 7.0, 100, "A b/1")], f"{schema}, _range string").write.partitionBy("_range").parquet(f"{path}/data/v{max(after.values()) + 1}")
    assert ev.read_ranged(spark, path).where("close = 7.0").count() == 0
    write(spark.createDataFrame([("A b", 151, 8.0, 100)], schema), 10)
    assert ev.read_ranged(spark, path).where("close in (7.0, 8.0)").count() == 1
    write(spark.createDataFrame([], schema), 11)


def test_ranged_sink_goes_on_after_a_restart(spark, tmp_path):
    schema = "symbol string, open_time long, close double, fetched_at long"
    batches = [[("A", i % 7, float(b), b) for i in range(b, b + 5)] for b in range(4)]
    path, stopped = f"file://{tmp_path}/t", []
    write = ev.ranged_sink(path, ["symbol", "open_time"], "fetched_at", F.floor(F.col("open_time") / 3))

    def fails_once(batch, epoch):
        write(batch, epoch)
        if epoch == 2 and not stopped:
            stopped.append(1)
            raise RuntimeError("stopped after the rows were written")

    source = files(spark, tmp_path / "s", batches, schema)
    start = lambda: source.writeStream.foreachBatch(fails_once).option("checkpointLocation", str(tmp_path / "c")).start()
    with pytest.raises(Exception, match="stopped"):
        start().processAllAvailable()
    drained(start())
    want = {r[:2]: r for b in batches for r in b}
    assert {tuple(r) for r in ev.read_ranged(spark, path).collect()} == set(want.values())
