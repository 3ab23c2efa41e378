"""Joins on time: as-of in both directions, intervals, tolerances."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .multiframe import snapshots


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], strict: bool = False, forward: bool = False, prefix: str = "", bucket_ms: int | None = None) -> DataFrame:
    """left with columns of the right row nearest in time: the last at or before (strict: before) each left row, or the first at or after.

    The sides are put in one stream by key and time and the right values carried along it: one shuffle and one sort, no range join. A null
    value of a column in the matched row stays null; of several right rows at one time the one with the greatest columns counts. With bucket_ms (and times as numbers) keys are cut into buckets of time, so that a
    key with most rows is many tasks' work (see multiframe.snapshots).
    """
    names = [f"{prefix}{c}" for c in columns]
    value = F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)])
    if bucket_ms is not None:
        # Forward is backward with time reversed.
        sign = F.lit(-1 if forward else 1)
        stream = right.select(*by, F.lit("right").alias("_frame_of"), (sign * F.col(right_time)).alias("_at"), value.alias("_value_of"))
        found = snapshots(left.withColumn("_now", sign * F.col(left_time)), stream, ("right",), "_now", tuple(by), "_frame_of", "_at", "_value_of", strict, bucket_ms, "_found")
        return found.select(*left.columns, *[F.col("_found")["right"][n].alias(n) for n in names])
    # At equal times a matching right row has to come first in the direction of travel, one that must not match last.
    side = 1 if strict else 0
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1 - side).alias("_side"), F.lit(True).alias("_left"), F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType).alias("_v"))
    b = right.select(*by, F.col(right_time).alias("_t"), F.lit(side).alias("_side"), F.lit(False).alias("_left"), value.alias("_v"))
    time, edge = (F.col("_t").desc(), F.col("_side").asc()) if forward else (F.col("_t").asc(), F.col("_side").asc())
    w = Window.partitionBy(*by).orderBy(time, edge, "_v").rowsBetween(Window.unboundedPreceding, 0)
    out = a.unionByName(b, allowMissingColumns=True).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_left")
    return out.select(*left.columns, *[F.col("_v")[n].alias(n) for n in names])


def within(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, time: str, bucket_ms: int = 86_400_000) -> DataFrame:
    """Pairs of left rows and the right rows whose time lies in [start, end]: an equi-join on buckets of time, then the exact test."""
    days = F.explode(F.sequence(F.floor(F.col(start) / bucket_ms), F.floor(F.col(end) / bucket_ms)))
    a = left.where(F.col(end) >= F.col(start)).withColumn("_day", days)
    b = right.withColumn("_day", F.floor(F.col(time) / bucket_ms))
    return a.join(b, [*by, "_day"]).where(F.col(time).between(F.col(start), F.col(end))).drop("_day")


def nearest_unique(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, tolerance: int, left_id: str, also: Column | None = None) -> DataFrame:
    """Pairs no further apart than `tolerance` (and for which `also` holds), of left rows that have exactly one: neighbouring buckets meet, so no pair at a bucket's edge is missed."""
    at = F.floor(F.col(left_time) / tolerance)
    a = left.withColumn("_b", F.explode(F.array(at - 1, at, at + 1)))
    b = right.withColumn("_b", F.floor(F.col(right_time) / tolerance))
    pairs = a.join(b, [*by, "_b"]).where(F.abs(F.col(left_time) - F.col(right_time)) <= tolerance).drop("_b")
    pairs = pairs if also is None else pairs.where(also)
    return pairs.withColumn("_n", F.count("*").over(Window.partitionBy(left_id))).where("_n = 1").drop("_n")


def lone_neighbours(df: DataFrame, by: list[str], time: str, row_id: str, tolerance: int, width: int = 10) -> DataFrame:
    """(by, row_id, other): rows of df that have exactly one other row of their key no further than `tolerance` away, and that row.

    No pairs are made: in order of time a row's two neighbours on each side say whether it has one, none or more. Keys are cut into buckets of `width` tolerances; rows nearer than a
    tolerance to an edge go to both sides of it and count for the rows of the other side only. Where ids repeat, pairs are made (see nearest_unique).
    """
    known = df.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*by, time, row_id)])).select(*by, time, row_id)
    if not known.groupBy(row_id).count().where("count > 1").isEmpty():
        other = known.select(*by, F.col(time).alias("_at"), F.col(row_id).alias("other"))
        return nearest_unique(known, other, by, time, "_at", tolerance, row_id, F.col(row_id) != F.col("other")).select(*by, row_id, "other")
    at = lambda move: F.floor((F.col(time) + move) / (width * tolerance))
    rows = known.withColumn("_own", at(0)).withColumn("_b", F.explode(F.array_distinct(F.array(at(-tolerance), at(0), at(tolerance)))))
    w = Window.partitionBy(*by, "_b").orderBy(time, row_id)
    near = lambda k: F.coalesce(F.abs(F.lag(time, k).over(w) - F.col(time)) <= tolerance, F.lit(False))
    rows = rows.withColumns({"_1": near(1), "_2": near(2), "_3": near(-1), "_4": near(-2), "_was": F.lag(row_id).over(w), "_next": F.lead(row_id).over(w)})
    other = F.when(F.expr("_1 and not _2 and not _3"), F.col("_was")).when(F.expr("_3 and not _4 and not _1"), F.col("_next"))
    return rows.where("_own = _b").withColumn("other", other).where("other is not null").select(*by, row_id, "other")


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(1)), right.select(key).distinct().withColumn("_r", F.lit(1))
    return a.join(b, key, "full_outer").where("_l is null or _r is null").select(key, F.when(F.col("_l").isNull(), "right").otherwise("left").alias("only_in"))
