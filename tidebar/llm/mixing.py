"""Mixing sources to target weights by Poisson replication: DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, hinted, unused

#: A Poisson variable of a larger mean is the sum of several of at most this mean, each with its own hash.
PART = 500.0


def uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of SHA-256 over the parts, joined by colons: the same on any engine."""
    digest = F.sha2(F.concat_ws(":", *[F.coalesce(x.cast("string"), F.lit("")) for x in parts]), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def poisson_table(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where a double can't tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("sums"))

    def add(at: Column, k: Column) -> Column:
        p = at["p"] * rate / k
        return F.struct(p.alias("p"), F.concat(at["sums"], F.array(F.element_at(at["sums"], -1) + p)).alias("sums"))

    return F.aggregate(F.sequence(F.lit(1), last), start, add, lambda x: x["sums"])


def replicate(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: int = 1, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """docs with each row repeated a Poisson number of times, its mean set so that sources get their weights; shuffled.

    A source's weight is that in weights (0 if absent), else its number of rows to the power of temperature; the rows that come out are about total (as many
    as go in, unless given) and split in proportion. A row's count inverts the distribution at a uniform hash of
    (seed, id), so it doesn't depend on the partitioning; rows that repeat an id get the same count. All columns stay, and `copy` (0, 1, ...) and
    `shuffle_key` come with them: rows are dealt to partitions by that hash and sorted by it within each, a global shuffle. Null sources
    count as one source of their own, null ids hash as the empty string. Extra columns of these two names are replaced.
    """
    docs = docs.drop("copy", "shuffle_key")
    names = docs.columns
    own, size, many, parts, sums = (unused(x, names) for x in ("own", "size", "many", "parts", "sums"))
    named = F.coalesce(F.col(source_col).cast("string"), F.lit("\0"))
    sizes = cut(docs.groupBy(named.alias(own)).agg(F.count("*").alias(size)))
    if weights is None:
        weight = F.pow(F.col(size).cast("double"), F.lit(temperature))
    else:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col(own)), F.lit(0.0)) if weights else F.lit(0.0)
    whole = sizes.agg(F.sum(weight.cast("double")), F.sum(size)).first()
    share, rows = whole[0] or 1.0, total if total is not None else whole[1] or 0
    rate = weight * F.lit(float(rows)) / F.lit(float(share)) / F.col(size)
    count = F.greatest(F.lit(1), F.ceil(rate / PART)).cast("int")
    rates = cut(sizes.select(own, count.alias(parts), poisson_table(rate / count).alias(sums)))
    joined = docs.withColumn(own, named).join(hinted(rates), own)
    draw = lambda k: F.size(F.filter(sums, lambda c: c < uniform(F.lit(seed), F.col(id_col), k)))
    drawn = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda at, k: at + draw(k))
    out = joined.withColumn(many, drawn).where(F.col(many) > 0).select(*names, F.explode(F.sequence(F.lit(0), F.col(many) - 1)).alias("copy"))
    out = out.withColumn("shuffle_key", F.xxhash64(F.lit(seed), F.col(id_col), F.col("copy")))
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
