"""Running sums in ranges: one value far off, one value or one key that most rows have."""

from __future__ import annotations

import random
import statistics
from contextlib import contextmanager
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from tidebar.operators import joins, ledger, stats
from tidebar.operators.ordered import ranges, running


@contextmanager
def eight(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("values", ["outlier", "one", "spread"])
def test_no_range_is_much_larger_than_the_others(spark, values):
    make = {"outlier": F.when(F.col("id") == 0, 1e12).otherwise(F.col("id") / 1e6), "one": F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")), "spread": F.col("id").cast("double")}[values]
    df = spark.range(40_000).select(F.lit("k").alias("k"), make.alias("v"))
    with eight(spark):
        sizes = [r["count"] for r in ranges(df, ["k"], ["v"]).groupBy("_part").count().collect()]
        placed = stats.numbered(df, ["v"])
        assert len(sizes) == 8 and max(sizes) <= 2 * 40_000 / 8
        assert placed.agg(F.countDistinct("_at"), F.min("_at"), F.max("_at"), F.max("_n")).first() == (40_000, 0, 39_999, 40_000)
        order = [r["v"] for r in placed.orderBy("_at").collect()]
    assert order == sorted(order)


def test_running(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.choice([None, 1, 2, 3, 10**12]), i, rng.choice([None, 1.5, -2.0])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v long, i int, x double")
    with eight(spark):
        got = {r["i"]: (r["s"], r["n"], r["all"]) for r in running(df, ["k"], ["v", "i"], {"s": F.col("x"), "n": F.lit(1)}, {"all": F.lit(1)}).collect()}
        assert running(df.limit(0), [], ["v"], {"s": F.col("x")}).count() == 0
    want = {}
    for k in ("a", "b", None):
        own = sorted((r for r in rows if r[0] == k), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        for n, (r, s) in enumerate(zip(own, accumulate(r[3] or 0.0 for r in own)), 1):
            want[r[2]] = (pytest.approx(s), n, len(own))
    assert got == want


def test_ranks_and_places(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.choice([1.0, 2.0, 2.0, 1e12, None, rng.random()]), rng.random() < 0.4) for _ in range(400)]
    df = spark.createDataFrame(rows, "k string, v double, e boolean")
    with eight(spark):
        ranks = {(r["k"], r["v"]): r["rank"] for r in stats.with_rank(df, ["k"], "v", "rank").collect()}
        places = {r["k"]: (r["low"], r["mid"], r["high"]) for r in stats.ranked_values(df, ["k"], "v", {"low": F.lit(1), "mid": F.ceil(F.col("n") / 2), "high": F.col("n")}).collect()}
        biserial = {r["k"]: r["rank_biserial"] for r in stats.rank_biserial(df, ["k"], "v", "e").collect()}
    for k in "ab":
        own = sorted(v for g, v, _ in rows if g == k and v is not None)
        assert all(ranks[k, v] == sum(x < v for x in own) + (sum(x == v for x in own) + 1) / 2 for v in own) and ranks.get((k, None)) is None
        assert places[k] == (own[0], own[-(-len(own) // 2) - 1], own[-1])
        a, b = ([v for g, v, e in rows if g == k and v is not None and e == flag] for flag in (True, False))
        assert biserial[k] == pytest.approx(sum((x > y) - (x < y) for x in a for y in b) / (len(a) * len(b)))


def test_outcome_profile_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["s", "s", "s", "t", None]), rng.choice([1, 1, rng.randrange(10**6)]), f"id{i:04}", 1.0, rng.choice([None, 0.0, 1.0, -1.0, -3.0, -1.0])) for i in range(500)] + [("u", i, f"u{i}", 1.0, -1.0) for i in range(40)] + [("w", 1, "w", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "symbol string, exit_time long, trade_id string, value double, pnl double")
    with eight(spark):
        got = {r["symbol"]: tuple(r)[1:] for r in ledger.outcome_profile(df).collect()}
    for s in ("s", "t", None, "u", "w"):
        own = [r[4] for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1], r[2]))]
        total = top = fall = run = longest = 0.0
        for x in own:
            total += x or 0.0
            top, run = max(top, total), run + 1 if x is not None and x < 0 else 0
            fall, longest = max(fall, top - total), max(longest, run)
        known = [x for x in own if x is not None]
        assert got[s] == (len(own), pytest.approx(sum(known) / len(known)), pytest.approx(fall), longest, run)


def test_medians_from_counts(spark):
    """Odd and even groups, repeated values, nulls; no task gathers a group's values."""
    rng = random.Random(5)
    rows = [(k, None if rng.random() < 0.1 else float(rng.randint(0, 9 * (k + 1)))) for k in range(5) for _ in range(40 + k)] + [(9, None), (None, 2.0), (None, 5.0)]
    df = spark.createDataFrame(rows, "k int, v double")
    out = stats.medians(df, ["k"], "v")
    assert {r["k"]: r["median"] for r in out.collect()} == {k: statistics.median(v) for k in {k for k, _ in rows} if (v := [x for g, x in rows if g == k and x is not None])}
    trades = df.selectExpr("v AS pnl", "0L AS entry_time", "CAST(v AS LONG) AS exit_time", "v AS max_favorable_pct")
    for found in (ledger.capital_lock(trades, 5, 20.0), stats.compare_features(df.selectExpr("k > 2 AS win", "v"), "win", ["v"])):
        assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString().lower() and "median(" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {r["label"]: (r["trades"], r["median_pnl"]) for r in ledger.capital_lock(trades, 5, 20.0).collect()}
    known = [v for _, v in rows if v is not None and 5 <= int(v) and v <= 20]
    assert got["locked"] == (len(known), statistics.median(known))


def test_more_ranges_for_more_rows(spark, monkeypatch):
    """What a task sorts is bounded by ROWS, not by the table over a fixed number of partitions."""
    from tidebar.operators import ordered

    monkeypatch.setattr(ordered, "ROWS", 500)
    df = spark.range(20_000).select(F.lit("k").alias("k"), F.col("id").cast("double").alias("v"))
    with eight(spark):
        rows = ranges(df, ["k"], ["v"])
        sizes = [r["count"] for r in rows.groupBy("_part").count().collect()]
        assert len(sizes) == 40 and max(sizes) <= 2 * 500 and rows.rdd.getNumPartitions() == 40
        trades = df.selectExpr("k AS symbol", "v AS exit_time", "'t' AS trade_id", "1.0D AS value", "IF(v % 5 < 3, -1.0D, 1.0D) AS pnl")
        assert tuple(ledger.outcome_profile(trades).first()) == ("k", 20_000, -0.2, 4002.0, 3, 0)


@pytest.mark.parametrize("repeated", [False, True])
def test_lone_neighbours(spark, repeated):
    """Against all pairs: crowds at one time, rows at buckets' edges, missing keys and times; a crowd makes no pairs unless ids repeat."""
    rng = random.Random(8)
    times = [rng.randrange(-3000, 6000) for _ in range(400)] + [7000] * 60 + [7990, 8000, 8010, 8020, 9000, 9010, None]
    rows = [(rng.choice(["a", "a", "b", None]), t, i) for i, t in enumerate(times)] + ([("a", 5, 1), ("b", 8000, 2)] if repeated else [])
    df = spark.createDataFrame(rows, "k string, t long, i long")
    want = []
    for i in {r[2] for r in rows}:
        pairs = [(x[0], i, y[2]) for x in rows if x[2] == i and None not in x for y in rows if y[0] == x[0] and y[1] is not None and y[2] != i and abs(x[1] - y[1]) <= 10]
        want += pairs if len(pairs) == 1 else []
    got = joins.lone_neighbours(df, ["k"], "t", "i", 10)
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 40
    assert ("Join" in got._jdf.queryExecution().optimizedPlan().toString()) == repeated
