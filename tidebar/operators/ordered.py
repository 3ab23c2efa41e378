"""Running sums over groups of any size: rows are dealt by ranges of their order, and what each range starts from is carried over one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: A range has about this many rows at most, so that what a task sorts doesn't grow with the table.
ROWS = 1 << 19


def ranges(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """df with `_part`, the number of the range of (by, order) that a row is in, ascending, and `_id`, which orders rows that are alike.

    Ranges are cut by a sample of the rows, so that each has about as many, whatever values there are: one far off or one that a third of all rows have makes no large range. The
    table is written, so that the ranges stay as they are. There are as many as shuffle partitions, or more where these would have over ROWS rows; then the table is dealt to as many
    tasks by range.
    """
    many = -(-df.count() // ROWS)
    more = [many] if many > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else []
    dealt = df.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*more, *[F.col(c) for c in (*by, *order, "_id")])
    out = stored(dealt.withColumn("_part", F.spark_partition_id()))
    return out.repartition(many, "_part") if more else out


def running(df: DataFrame, by: list[str], order: list[str], sums: dict[str, Column], totals: dict[str, Column] | None = None) -> DataFrame:
    """df with sums, running over the rows of a group (of by; nulls are a group) in order up to each row, and totals of the whole group. Rows that are alike come in any order; nulls add nothing."""
    totals = totals or {}
    key = F.struct(*by).alias("_key") if by else F.lit(0).alias("_key")
    rows = ranges(df, by, order)
    upto = Window.partitionBy("_part", *by).orderBy(*order, "_id").rowsBetween(Window.unboundedPreceding, 0)
    spans = rows.groupBy("_part", *by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(f"_s{i}") for i, c in enumerate([*sums.values(), *totals.values()])])
    past = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    k = len(sums)
    carried = spans.select(F.col("_part").alias("_p"), key, *[F.coalesce(F.sum(f"_s{i}").over(past), F.lit(0)).alias(f"_c{i}") for i in range(k)], *[F.sum(f"_s{k + j}").over(Window.partitionBy(*by)).alias(name) for j, name in enumerate(totals)])
    inside = rows.select("*", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_i{i}") for i, c in enumerate(sums.values())], key.alias("_own") if by else F.lit(0).alias("_own"))
    out = inside.join(carried, (F.col("_part") == F.col("_p")) & (F.col("_own") == F.col("_key")))
    return out.select(*df.columns, *[(F.col(f"_c{i}") + F.col(f"_i{i}")).alias(name) for i, name in enumerate(sums)], *totals)
