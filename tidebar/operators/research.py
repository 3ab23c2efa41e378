"""Summaries and samples that research reports are made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .joins import asof
from .stats import ranked_values


def cost_aware(trades: DataFrame, by: list[str]) -> DataFrame:
    """What trades made after costs: sums, wins and losses (zero is neither), their ratio, commission."""
    p = F.coalesce("pnl", F.lit(0.0))
    out = trades.groupBy(*by).agg(F.count("*").alias("trades"), F.sum(p).alias("net_pnl"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(F.greatest(p, F.lit(0.0))).alias("_g"), F.sum(F.least(p, F.lit(0.0))).alias("_l"), F.sum(F.coalesce("commission", F.lit(0.0))).alias("commission"))
    return out.withColumns({"win_rate_pct": F.col("wins") / F.col("trades") * 100, "profit_factor": F.col("_g") / F.nullif(-F.col("_l"), F.lit(0.0))}).drop("_g", "_l")


def rate_compare(df: DataFrame, event: str, flags: list[str]) -> DataFrame:
    """(flag, n_event, rate_event, n_control, rate_control): how often each flag holds in events and in controls; unknown flags don't count."""
    long = df.select(event, F.explode(F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("x")) for f in flags])).alias("f")).select(event, "f.*").where("x is not null")
    rate = lambda side: F.avg(F.when(side, F.col("x").cast("double")))
    e = F.col(event)
    return long.groupBy("flag").agg(F.count_if(e).alias("n_event"), rate(e).alias("rate_event"), F.count_if(~e).alias("n_control"), rate(~e).alias("rate_control"))


def threshold_summary(events: DataFrame, thresholds: list[int], score: str = "score", value: str = "value") -> DataFrame:
    """(threshold, score, n, mean): for each threshold the events of each score at or above it, from counts a score."""
    counts = events.groupBy(score).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return counts.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds]))).where(F.col(score) >= F.col("threshold")).select("threshold", score, "n", "mean")


def horizon_summary(outcomes: DataFrame, horizons: list[str], cost: float = 0.003) -> DataFrame:
    """(horizon, n, median_up, p75_up, median_ret, median_down, hit_rate, net_rate) from columns up_H, ret_H, down_H: values at index floor((n - 1) * q), the share of 1 % moves and of returns above the cost."""
    rows = F.array(*[F.struct(F.lit(h).alias("horizon"), *[F.col(f"{k}_{h}").alias(k) for k in ("up", "ret", "down")]) for h in horizons])
    long = outcomes.select(F.explode(rows).alias("r")).select("r.*").where("up is not null")
    at = lambda q: F.floor((F.col("n") - 1) * F.lit(q)) + 1
    parts = [ranked_values(long, ["horizon"], "up", {"median_up": at(0.5), "p75_up": at(0.75)}), ranked_values(long, ["horizon"], "ret", {"median_ret": at(0.5)}), ranked_values(long, ["horizon"], "down", {"median_down": at(0.5)})]
    out = long.groupBy("horizon").agg(F.count("*").alias("n"), F.avg((F.col("up") >= 0.01).cast("double")).alias("hit_rate"), F.avg((F.col("ret") > cost).cast("double")).alias("net_rate"))
    for p in parts:
        out = out.join(p, "horizon")
    return out


def degradation(windows: DataFrame, order: str, value: str = "net_pnl", by: list[str] | None = None) -> DataFrame:
    """The last window's result in parts of the first's: STABLE from a half on, DEGRADED below or where the first wasn't positive, INSUFFICIENT_WINDOWS with fewer than two."""
    out = windows.groupBy(*(by or [])).agg(F.count("*").alias("windows"), F.min_by(value, order).alias("_a"), F.max_by(value, order).alias("_b"))
    share = F.when((F.col("_a") > 0) & (F.col("windows") >= 2), F.round(F.col("_b") / F.col("_a"), 4))
    return out.withColumn("degradation_ratio", share).withColumn("status", F.when(F.col("windows") < 2, "INSUFFICIENT_WINDOWS").when(F.col("degradation_ratio") >= 0.5, "STABLE").otherwise("DEGRADED")).drop("_a", "_b")


def sample_grid(bars: DataFrame, columns: list[str], step_ms: int, by: str = "symbol", time: str = "open_time") -> DataFrame:
    """Each series every step_ms from its first bar to its last, with the columns of the last bar at or before that time."""
    ends = bars.groupBy(by).agg(F.min(time).alias("_a"), F.max(time).alias("_b"))
    grid = ends.select(by, F.explode(F.sequence(F.col("_a"), F.col("_b"), F.lit(step_ms))).alias("sample_time"))
    return asof(grid, bars, [by], "sample_time", time, columns)


def spaced_sample(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """Of each group k rows at places round(i * (n - 1) / (k - 1)), half to even; all of a group of k or fewer. Deterministic."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    n = F.count("*").over(Window.partitionBy(by))
    # The sample that could fall on a place is one of two neighbours.
    i = F.floor(F.col("_p") * (k - 1) / F.greatest(F.col("_n") - 1, F.lit(1)))
    lands = lambda j: F.bround(j * (F.col("_n") - 1) / F.lit(k - 1)) == F.col("_p")
    rows = df.withColumns({"_p": place, "_n": n}).withColumn("_i", i)
    return rows.where((F.col("_n") <= k) | lands(F.col("_i")) | lands(F.col("_i") + 1)).drop("_p", "_n", "_i")


def day_key(time_ms: Column, zone: str) -> Column:
    """The calendar day of a time in a zone."""
    return F.to_date(F.from_utc_timestamp(F.timestamp_millis(time_ms), zone))


def scoped(df: DataFrame, **values) -> DataFrame:
    """Rows whose columns are the given values or null: what is said for one case and what for all."""
    for name, value in values.items():
        df = df.where(F.col(name).isNull() | (F.col(name) == value))
    return df


def listed(df: DataFrame, json_col: str, value: str) -> DataFrame:
    """Rows whose JSON array of strings holds a value."""
    return df.where(F.array_contains(F.from_json(json_col, "array<string>"), value))


def due(df: DataFrame, now: float, horizon_seconds: Column, created: str = "created_at") -> DataFrame:
    """Rows whose horizon is over."""
    return df.where(F.col(created) + horizon_seconds <= now)
