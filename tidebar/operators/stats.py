"""Cohort statistics: ranks, correlations, rule scores, walk-forward folds, resampling, Sharpe corrections."""

from __future__ import annotations

from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import normal_cdf
from .ordered import running


def with_rank(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Average ranks: equal values share the mean of their places. Values are counted first, so ranks come from one row a distinct value."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranks = running(sizes, by, [value], {"_upto": F.col("_c")}).withColumn(name, F.col("_upto") - (F.col("_c") - 1) / 2).drop("_c", "_upto")
    return df.join(ranks, [*by, value], "left")


def rank_biserial(df: DataFrame, by: list[str], value: str, event: str) -> DataFrame:
    """P(event > control) - P(event < control), from rank sums over counts a distinct value: no pairs are made and no row is read twice."""
    known = df.where(F.col(event).isNotNull() & F.col(value).isNotNull())
    sizes = known.groupBy(*by, value).agg(F.count_if(F.col(event)).alias("_e"), F.count_if(~F.col(event)).alias("_c"))
    each = F.col("_e") + F.col("_c")
    sizes = running(sizes, by, [value], {"_upto": each})
    rank = F.col("_upto") - (each - 1) / 2
    mean = lambda c: F.sum(F.col(c) * F.col("_r")) / F.nullif(F.sum(c), F.lit(0))
    out = sizes.withColumn("_r", rank).groupBy(*by).agg(F.sum("_e").alias("n_event"), F.sum("_c").alias("n_control"), mean("_e").alias("_a"), mean("_c").alias("_b"))
    return out.select(*by, "n_event", "n_control", (2 * (F.col("_a") - F.col("_b")) / (F.col("n_event") + F.col("n_control"))).alias("rank_biserial"))


def spearman(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = with_rank(with_rank(both, by, x, "_rx"), by, y, "_ry")
    return ranked.groupBy(*by).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))


def medians(df: DataFrame, by: list[str], value: str, name: str = "median") -> DataFrame:
    """(by, name): a row for each group with a value that isn't null. Values are counted first and the counts summed up range by range, so that no task holds a group's values."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    ranked = running(sizes, by, ["_v"], {"_upto": F.col("_c")}, {"_n": F.col("_c")})
    holds = lambda place: F.max(F.when((F.col("_upto") - F.col("_c") < place) & (place <= F.col("_upto")), F.col("_v")))
    low, high = holds(F.floor((F.col("_n") + 1) / 2)), holds(F.floor(F.col("_n") / 2) + 1)
    return ranked.groupBy(*by).agg((low + (high - low) * 0.5).alias(name))


def compare_features(df: DataFrame, event: str, features: list[str]) -> DataFrame:
    """A row a feature: counts, means and medians of events and controls, and the difference of the medians."""
    long = df.unpivot([event], features, "feature", "value").where("value is not null")
    sides = ((True, "event"), (False, "control"))
    pick = lambda flag, c: F.when(F.col(event) == flag, F.col(c))
    out = long.groupBy("feature").agg(*[f(pick(flag, "value")).alias(f"{name}_{side}") for flag, side in sides for name, f in (("n", F.count), ("mean", F.avg))])
    middle = medians(long.where(F.col(event).isNotNull()), ["feature", event], "value").groupBy("feature").agg(*[F.max(pick(flag, "median")).alias(f"median_{side}") for flag, side in sides])
    return out.join(middle, "feature", "left").withColumn("median_delta", F.col("median_event") - F.col("median_control"))


def score_rules(df: DataFrame, label: str, rules: dict[str, Column]) -> DataFrame:
    """A row a rule: the confusion counts, precision, recall, false-positive rate and Youden's J, all rules in one pass."""
    cells = {}
    for name, rule in rules.items():
        hit = F.coalesce(rule, F.lit(False))
        cells[name] = F.struct(*[F.count_if((hit == a) & (F.col(label) == b)).alias(n) for n, a, b in (("tp", True, True), ("fp", True, False), ("fn", False, True), ("tn", False, False))])
    one = df.agg(*[c.alias(n) for n, c in cells.items()])
    rows = one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("c")) for n in rules])).alias("x")).select("x.rule", "x.c.*")
    div = lambda a, b: F.when(b != 0, a / b)
    rows = rows.withColumns({"precision": div(F.col("tp"), F.col("tp") + F.col("fp")), "recall": div(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": div(F.col("fp"), F.col("fp") + F.col("tn"))})
    return rows.withColumn("youden", F.col("recall") - F.col("fpr"))


def select_rule(development: DataFrame, label: str, rules: dict[str, Column], most_fpr: float = 0.3) -> str | None:
    """The rule with the greatest Youden's J of those under the false-positive ceiling; to be frozen for later data."""
    best = score_rules(development, label, rules).where(F.col("fpr") <= most_fpr).orderBy(F.col("youden").desc_nulls_last(), "rule").first()
    return best["rule"] if best else None


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """df with _at, the row's place (from 0) by the columns of order, and _n, the number of rows."""
    return running(df, [], order, {"_at": F.lit(1)}, {"_n": F.lit(1)}).withColumn("_at", F.col("_at") - 1)


def chronological_split(df: DataFrame, time: str, tie: list[str], shares: tuple[float, ...] = (0.6, 0.2, 0.2)) -> DataFrame:
    """part 0, 1, ...: by share of the rows in order of time, then tie."""
    out = numbered(df, [time, *tie]).withColumn("_share", F.col("_at") / F.col("_n"))
    part = F.lit(0)
    for k in range(1, len(shares)):
        part = F.when(F.col("_share") >= round(sum(shares[:k]), 12), k).otherwise(part)
    return out.withColumn("part", part).drop("_share", "_n", "_at")


def ranked_values(df: DataFrame, by: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """A row for each group of by, with the values at some places (from 1) of its order; places are columns of n, the number of the group's values that aren't null."""
    rows = running(df.where(F.col(value).isNotNull()).select(*by, value), by, [value], {"_p": F.lit(1)}, {"n": F.lit(1)})
    return rows.groupBy(*by).agg(*[F.max(F.when(F.col("_p") == p, F.col(value))).alias(name) for name, p in places.items()])


def accept_folds(folds: DataFrame, least_folds: int = 3, least_trades: int = 30) -> DataFrame:
    """folds (net_pnl, total_trades) to one row: sums, whether they pass, and why not."""
    out = folds.agg(F.count("*").alias("folds"), F.coalesce(F.sum("total_trades"), F.lit(0)).alias("trades"), F.coalesce(F.sum("net_pnl"), F.lit(0.0)).alias("net_pnl"), F.count_if(F.col("net_pnl") > 0).alias("positive"))
    reasons = F.array_compact(F.array(F.when(F.col("folds") < least_folds, "insufficient_folds"), F.when(F.col("trades") < least_trades, "insufficient_trades"), F.when(F.col("positive") * 2 <= F.col("folds"), "insufficient_positive_fold_majority"), F.when(F.col("net_pnl") <= 0, "non_positive_total_net_pnl")))
    return out.withColumn("reasons", reasons).withColumn("verdict", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def moments(df: DataFrame, by: list[str], value: str, trials: int = 1) -> DataFrame:
    """n, mean, sample deviation, skewness and kurtosis (moments over n, deviation over n - 1), Sharpe-like ratio and the chance that it is above the most that `trials` tries
    would show by luck, corrected for both. One pass: Spark's moments over n are rescaled."""
    x = F.col(value).cast("double")
    out = df.groupBy(*by).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("dev"), F.skewness(x).alias("_g"), F.kurtosis(x).alias("_k"))
    shrink = (F.col("n") - 1) / F.col("n")
    out = out.withColumns({"skew": F.col("_g") * F.pow(shrink, F.lit(1.5)), "kurtosis": (F.col("_k") + 3) * shrink * shrink, "sharpe": F.col("mean") / F.nullif(F.col("dev"), F.lit(0.0))})
    width = F.sqrt(F.greatest(F.lit(1e-12), (1 - F.col("skew") * F.col("sharpe") + (F.col("kurtosis") - 1) / 4 * F.col("sharpe") * F.col("sharpe")) / F.greatest(F.lit(1), F.col("n") - 1)))
    luck = (2 * log(max(1, trials))) ** 0.5
    return out.withColumn("probability", normal_cdf((F.col("sharpe") - luck) / width)).drop("_g", "_k")


def block_bootstrap(df: DataFrame, value: str, order: list[str], draws: int = 500, seed: int = 42) -> DataFrame:
    """(draw, total): sums of resampled series of n values, made of blocks of max(2, floor(sqrt(n))) neighbours that start anywhere, the last one cut to fit.

    A block's sum is the difference of two running sums, which are made bucket by bucket; draws are dealt out and look theirs up.
    """
    spark, n = df.sparkSession, df.count()
    size = max(2, int(n**0.5))
    rows = numbered(df.select(value, *[c for c in order if c != value]), order).withColumn("_g", F.floor(F.col("_at") / size))
    groups = rows.groupBy("_g").agg(F.sum(value).alias("_s"))
    earlier = F.coalesce(F.sum("_s").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    inside = F.sum(value).over(Window.partitionBy("_g").orderBy("_at"))
    sums = rows.join(groups.select("_g", earlier.alias("_e")), "_g").select((F.col("_at") + 1).alias("place"), (F.col("_e") + inside).alias("sum"))

    def pick(batches):
        for pdf in batches:
            for d in pdf["draw"]:
                starts = np.random.default_rng([seed, int(d)]).integers(0, max(1, n - size + 1), -(-n // size))
                lengths = np.minimum(size, n - size * np.arange(len(starts)))
                ends = np.minimum(n, starts + lengths)
                yield pd.DataFrame({"draw": int(d), "place": np.concatenate([starts, ends]), "sign": np.repeat([-1.0, 1.0], len(starts))})

    if not n:
        return spark.createDataFrame([], "draw long, total double")
    picks = spark.range(draws).withColumnRenamed("id", "draw").mapInPandas(pick, "draw long, place long, sign double")
    return picks.join(sums, "place", "left").groupBy("draw").agg(F.sum(F.coalesce("sum", F.lit(0.0)) * F.col("sign")).alias("total"))


def overfit_share(trials: DataFrame) -> DataFrame:
    """trials (trial, part 'in' or 'out', score): whether the best in-sample trial falls below the out-of-sample median."""
    wide = trials.groupBy("trial").pivot("part", ["in", "out"]).agg(F.avg("score"))
    return wide.agg(F.max_by("out", F.struct(F.col("in"), -F.col("trial"))).alias("best_out"), F.sort_array(F.collect_list("out")).alias("_outs")).withColumn("median_out", F.try_element_at("_outs", (F.floor(F.size("_outs") / 2) + 1).cast("int"))).drop("_outs").withColumn("overfit", F.col("best_out") < F.col("median_out"))
