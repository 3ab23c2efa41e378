"""Reports over a trade ledger: trades (symbol, strategy, entry_time, exit_time, pnl, commission, reason, trade_id, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import ranges, running
from .stats import medians

TIMEOUT = "time|timeout|max_hold|early_failure|stale_position"


def ledger_of(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """The driver's order lines as trades."""
    day = lambda c: F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")
    both = lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.col("o_orderpriority").alias("strategy"), F.least(day("o_orderdate"), day("l_shipdate")).alias("entry_time"), F.greatest(day("o_orderdate"), day("l_shipdate")).alias("exit_time"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("pnl"), (F.col("l_extendedprice") * 0.0015).alias("commission"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("o_orderstatus").alias("reason"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("trade_id"),
    )


def page(df: DataFrame, limit: int = 50, offset: int = 0, order: list | None = None, **equal) -> DataFrame:
    """Rows that match every given column, newest first, a page of 1 to 500."""
    for name, value in equal.items():
        if value is not None:
            df = df.where(F.col(name) == value)
    return df.orderBy(*(order or [F.col("exit_time").desc(), F.col("trade_id")])).offset(max(0, offset)).limit(max(1, min(500, limit)))


def strategy_report(trades: DataFrame, by: tuple[str, ...] = ("strategy",)) -> DataFrame:
    """Counts, wins, net, profit factor (null without losses), mean holding time, exits by timeout."""
    win, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl"))), -F.sum(F.when(F.col("pnl") < 0, F.col("pnl")))
    return trades.groupBy(*by).agg(
        F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net_pnl"), F.avg(F.when(F.col("pnl") > 0, 1.0).otherwise(0.0)).alias("win_rate"), (F.coalesce(win, F.lit(0.0)) / F.nullif(loss, F.lit(0.0))).alias("profit_factor"),
        F.sum("commission").alias("commission"), F.avg(F.col("exit_time") - F.col("entry_time")).alias("mean_hold"), F.count_if(F.lower("reason").rlike(TIMEOUT)).alias("timeouts"),
    )


def top_reasons(trades: DataFrame, by: str = "strategy", k: int = 5) -> DataFrame:
    """The k commonest reasons of each group, by count, then name."""
    counts = trades.groupBy(by, "reason").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "reason"))).where(F.col("place") <= k)


def outcome_profile(trades: DataFrame, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """Expectancy, deepest fall of the running sum, longest and current run of losses, by exit time.

    Ranges of a group's trades are summed up apart (sum, highest and lowest point, deepest fall, losses at its ends and longest in between) and these chained in order, a row a range.
    """
    at = ["exit_time", "trade_id", "value"]
    rows = ranges(trades.select(*by, *at, "pnl"), list(by), at)
    upto = Window.partitionBy("_part", *by).orderBy(*at, "_id").rowsBetween(Window.unboundedPreceding, 0)
    loss = F.coalesce(F.col("pnl") < 0, F.lit(False))
    rows = rows.withColumns({"_sum": F.coalesce(F.sum("pnl").over(upto), F.lit(0.0)), "_run": F.sum(F.when(loss, 0).otherwise(1)).over(upto)})
    streak = F.when(loss, F.sum(F.when(loss, 1).otherwise(0)).over(Window.partitionBy("_part", *by, "_run").orderBy(*at, "_id"))).otherwise(0)
    rows = rows.withColumns({"_top": F.max("_sum").over(upto), "_streak": streak})
    last = F.struct(*at, "_id")
    spans = rows.groupBy(*by, "_part").agg(
        F.count("*").alias("n"), F.count("pnl").alias("known"), F.sum(F.coalesce("pnl", F.lit(0.0))).alias("sum"), F.max("_sum").alias("top"), F.min("_sum").alias("low"), F.max(F.col("_top") - F.col("_sum")).alias("fall"),
        F.count_if(F.col("_run") == 0).alias("first"), F.max_by("_streak", last).alias("last"), F.max("_streak").alias("longest"),
    )
    parts = F.array_sort(F.collect_list(F.struct("_part", "n", "known", "sum", "top", "low", "fall", "first", "last", "longest")))
    zero = F.lit(0.0)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("known"), zero.alias("sum"), zero.alias("top"), zero.alias("fall"), F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("longest"))

    def chain(a: Column, p: Column) -> Column:
        return F.struct(
            (a["n"] + p["n"]).alias("n"), (a["known"] + p["known"]).alias("known"), (a["sum"] + p["sum"]).alias("sum"), F.greatest(a["top"], a["sum"] + p["top"]).alias("top"), F.greatest(a["fall"], p["fall"], a["top"] - a["sum"] - p["low"]).alias("fall"),
            F.when(p["first"] == p["n"], a["last"] + p["n"]).otherwise(p["last"]).alias("last"), F.greatest(a["longest"], p["longest"], a["last"] + p["first"]).alias("longest"),
        )

    whole = spans.groupBy(*by).agg(F.aggregate(parts, start, chain).alias("w"))
    return whole.select(*by, F.col("w.n").alias("trades"), (F.col("w.sum") / F.nullif(F.col("w.known"), F.lit(0))).alias("expectancy"), F.col("w.fall").alias("max_drawdown"), F.col("w.longest").alias("longest_losses"), F.col("w.last").alias("current_losses"))


def capital_lock(trades: DataFrame, hold: float, favourable: float) -> DataFrame:
    """Trades held long that never went far: how many, their sum, against the rest."""
    locked = (F.col("exit_time") - F.col("entry_time") >= hold) & (F.col("max_favorable_pct") <= favourable)
    marked = trades.select(F.when(locked, "locked").otherwise("normal").alias("label"), "pnl")
    sums = marked.groupBy("label").agg(F.count("*").alias("trades"), F.sum("pnl").alias("net_pnl"), F.avg("pnl").alias("mean_pnl"))
    return sums.join(medians(marked, ["label"], "pnl", "median_pnl"), "label", "left")


def solvency(trades: DataFrame, initial: float) -> DataFrame:
    """Money tied up and freed, in order of time (exits first at equal times): the running balance, day by day's lowest. Days are summed apart, then chained."""
    debit = trades.select("entry_time", "value", "trade_id").select(F.col("entry_time").alias("time"), F.lit(1).alias("kind"), (-F.col("value")).alias("amount"), "trade_id")
    credit = trades.select(F.col("exit_time").alias("time"), F.lit(0).alias("kind"), (F.col("value") + F.col("pnl")).alias("amount"), "trade_id")
    moves = debit.unionByName(credit).withColumn("day", F.floor(F.col("time") / 86400))
    inside = Window.partitionBy("day").orderBy("time", "kind", "trade_id", "amount").rowsBetween(Window.unboundedPreceding, 0)
    days = moves.withColumn("_run", F.sum("amount").over(inside)).groupBy("day").agg(F.sum("amount").alias("net"), F.min("_run").alias("_low"))
    chain = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    opening = F.lit(initial) + F.coalesce(F.sum("net").over(chain), F.lit(0.0))
    return days.select("day", opening.alias("opening"), (opening + F.col("_low")).alias("lowest"), (opening + F.col("net")).alias("closing"))


def reconcile(trades: DataFrame, open_positions: DataFrame | None, initial: float, fee: float = 0.0015) -> DataFrame:
    """What the wallet should hold: initial + realised - the cost of what is open, with fees."""
    realised = trades.agg(F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("realised"), F.count("*").alias("trades"))
    if open_positions is None:
        return realised.withColumn("wallet", F.lit(initial) + F.col("realised"))
    cost = open_positions.agg(F.coalesce(F.sum(F.col("entry_price") * F.col("quantity")), F.lit(0.0)).alias("invested"))
    return realised.crossJoin(cost).withColumn("wallet", F.lit(initial) + F.col("realised") - F.col("invested") * (1 + fee))


def forecast_report(forecasts: DataFrame) -> DataFrame:
    """By horizon: how many, evaluated, correct, pending; means of confidence and outcome."""
    done = F.col("status") == "evaluated"
    return forecasts.groupBy("horizon_minutes").agg(F.count("*").alias("total"), F.count_if(done).alias("evaluated"), F.sum(F.when(done, F.col("direction_correct"))).alias("correct"), F.count_if(F.col("status") == "pending").alias("pending"), F.avg("confidence").alias("mean_confidence"), F.avg(F.when(done, F.col("outcome_return_pct"))).alias("mean_return"))


def lessons(forecasts: DataFrame, least: int = 12) -> DataFrame:
    """Evaluated forecasts by (symbol, horizon, regime, direction) and over all symbols: accuracy of the earlier 70 % and of the rest, calibration error, and whether the lesson is
    'active' (the rest right in 0.55 of cases or more and within 0.20 of the earlier part) or a 'candidate'. Groups of fewer than `least`, or with a rest of fewer than a third of that (3 at least), give none."""
    f = forecasts.where("status = 'evaluated' and direction_correct is not null and direction is not null").withColumn("regime", F.coalesce("regime", F.lit("unknown")))
    # Both groupings from one scan: each row counts for its symbol and for all.
    both = f.withColumn("symbol", F.explode(F.array(F.upper("symbol"), F.lit(None).cast("string"))))
    keys = ["symbol", "horizon_minutes", "regime", "direction"]
    placed = running(both, keys, ["created_at", "forecast_id"], {"_at": F.lit(1)}, {"_n": F.lit(1)})
    marked = placed.withColumn("_late", F.col("_at") > F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(0.7))))
    hit = F.col("direction_correct").cast("double")
    out = marked.groupBy(*keys).agg(
        F.count("*").alias("samples"), F.count_if("_late").alias("holdout"), F.avg(F.when(~F.col("_late"), hit)).alias("accuracy"), F.avg(F.when(F.col("_late"), hit)).alias("late_accuracy"),
        F.avg(F.abs(F.coalesce(F.col("confidence"), F.lit(0.0)) / 100 - hit)).alias("calibration_error"),
    ).where((F.col("samples") >= least) & (F.col("holdout") >= max(3, least // 3)))
    active = (F.col("late_accuracy") >= 0.55) & (F.abs(F.col("late_accuracy") - F.col("accuracy")) <= 0.20)
    return out.withColumn("status", F.when(active, "active").otherwise("candidate"))


def local_regime(rows: DataFrame) -> DataFrame:
    """rows (score, data_ready, trend_direction), one a symbol: zone, score and confidence from the share of rising symbols and their mean score; unknown with fewer than three that are ready."""
    some = rows.where("data_ready").agg(F.count("*").alias("sample_size"), F.avg(F.when(F.lower("trend_direction").isin("bullish", "bull", "up"), 1.0).otherwise(0.0)).alias("_p"), F.avg(F.coalesce("score", F.lit(0.0))).alias("_m"))
    held = lambda x, a, b: F.greatest(F.lit(a), F.least(F.lit(b), x))
    score, known = held(50 + F.col("_p") * 35 + held(F.col("_m") * 5, -15.0, 15.0), 0.0, 100.0), F.col("sample_size") >= 3
    out = some.withColumn("_s", F.when(known, score))
    zone = F.when(~known, "UNKNOWN").when(F.col("_s") >= 70, "RISK_ON").when(F.col("_s") <= 35, "RISK_OFF").otherwise("NEUTRAL")
    return out.select("sample_size", zone.alias("zone"), F.round("_s", 2).alias("score"), F.when(known, F.round(F.least(F.lit(0.9), 0.35 + F.col("sample_size") / 40), 3)).otherwise(0.0).alias("confidence"), F.when(known, F.round("_p", 4)).alias("bullish_participation"))


def execution_quality(df: DataFrame, order_value: float = 500.0) -> DataFrame:
    """df (spread_pct in percent, depth, volume_ratio): a score of 1 less what is wrong with the spread, the depth and the volume, and what that is."""
    spread, depth, volume = F.col("spread_pct"), F.col("depth"), F.col("volume_ratio")
    # Deductions.
    faults = [
        ("spread_unknown", spread.isNull(), 0.35), ("spread_high", spread > 0.20, 0.35), ("depth_unknown", F.coalesce(depth, F.lit(0.0)) <= 0, 0.35), ("depth_thin", (depth > 0) & (depth < order_value * 5), 0.2),
        ("volume_unknown", F.coalesce(volume, F.lit(0.0)) == 0, 0.2), ("volume_low", (volume != 0) & (volume < 1.0), 0.1),
    ]
    lost = sum((F.when(F.coalesce(x, F.lit(False)), w).otherwise(0.0) for _, x, w in faults), F.lit(0.0))
    return df.withColumns({"execution_score": F.round(F.greatest(F.lit(0.0), 1 - lost), 3), "execution_reasons": F.array_compact(F.array(*[F.when(x, n) for n, x, _ in faults])), "execution_known": spread.isNotNull() | (F.coalesce(depth, F.lit(0.0)) != 0)})


def pass_rates(evaluations: DataFrame) -> DataFrame:
    """evaluations (case_id, passed): over repeated tries, whether any and whether all passed."""
    p = F.col("passed").cast("int")
    return evaluations.groupBy("case_id").agg(F.count("*").alias("tries"), F.max(p).alias("pass_any"), F.min(p).alias("pass_all"), F.avg(p).alias("rate"))
