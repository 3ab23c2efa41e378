"""Memory retrieval: vectors, words, recency and evidence in one score; links of contradiction; upserts by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .vector_index import exact_top


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a null, zero or differently long vector."""
    x, y = F.transform(a, lambda v: v.cast("double")), F.transform(b, lambda v: v.cast("double"))
    add = lambda s, v: s + v
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda m, n: m * n), F.lit(0.0), add)
    size = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(x, y) / size)


# Outcome words.
GOOD, BAD = ("success", "passed", "profit", "profitable"), ("failure", "failed", "loss", "losing")
def retrieve(documents: DataFrame, queries: DataFrame, now: float = 0.0, limit: int = 10, contradictions: DataFrame | None = None) -> DataFrame:
    """(query_id, document_id, score): for each of queries (query_id, vector, words) the best 1 to 50 documents (document_id, content, embedding, observed_at in seconds, outcome)
    by 0.60 cosine + 0.15 words + 0.15 recency (30 days) + 0.10 for a good outcome (-0.10 for a bad one) - 0.05 a contradiction.

    Blocks of queries meet pieces of documents as products of matrices (exact_top); of a document's words only those travel that some query asks for. Ties go by document_id.
    """
    docs = documents
    if contradictions is not None:
        docs = docs.join(contradictions.where("relation = 'contradicts'").groupBy(F.col("target_id").alias("document_id")).agg(F.count("*").alias("against")), "document_id", "left")
    else:
        docs = docs.withColumn("against", F.lit(0))
    said = F.lower("outcome")
    good = F.when(said.isin(*GOOD), 0.10).when(said.isin(*BAD), -0.10).otherwise(0.0)
    age = F.exp(-F.greatest(F.lit(0.0), (F.lit(now) - F.col("observed_at")) / 86400) / 30)
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce("words", F.lit(""))), r"\s+"), lambda w: w != ""))
    asked = queries.select("query_id", F.col("vector").alias("v"), words.alias("words"))
    known = asked.select(F.explode("words").alias("word")).distinct()
    own = docs.select("document_id", F.explode(F.array_distinct(F.split(F.lower("content"), r"[^\p{L}\p{N}]+"))).alias("word")).join(known, "word", "left_semi")
    docs = docs.join(own.groupBy("document_id").agg(F.collect_set("word").alias("words")), "document_id", "left")
    rows = docs.select(F.col("document_id").alias("row_id"), F.col("embedding").alias("v"), (0.15 * age + good - 0.05 * F.coalesce("against", F.lit(0))).alias("rest"), "words")
    return exact_top(rows, asked, max(1, min(50, limit)), 0.60, 0.15).withColumnRenamed("row_id", "document_id")


def contradictions(documents: DataFrame, fresh: DataFrame, most: int = 20) -> DataFrame:
    """Edges from each fresh document to the newest ones of its symbol and strategy with the opposite outcome. Of a group only its newest most + 1 documents are joined: no fresh
    document is linked to an older one (one of them may be the document itself)."""
    group = ["symbol", "strategy", "outcome"]
    order = Window.partitionBy(*group).orderBy(F.desc("observed_at"), "target_id")
    newest = documents.select(F.col("document_id").alias("target_id"), *group, "observed_at").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most + 1)
    other = F.when(F.col("outcome") == "success", "failure").when(F.col("outcome") == "failure", "success")
    a = fresh.select(F.col("document_id").alias("source_id"), "symbol", "strategy", other.alias("outcome"))
    pairs = a.join(newest, group).where("source_id <> target_id")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("_n"))
    return pairs.withColumn("_k", place).where(F.col("_k") <= most).select("source_id", "target_id", F.lit("contradicts").alias("relation"))


def merge_instincts(events: DataFrame) -> DataFrame:
    """events (key, confidence, success): strongest confidence held to [0, 1], evidence counted; promoted with confidence of 0.8 over three successes."""
    out = events.groupBy("key").agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.max("confidence"))).alias("confidence"), F.count("*").alias("evidence"), F.count_if("success").alias("successes"))
    return out.withColumn("promoted", (F.col("confidence") >= 0.8) & (F.col("successes") >= 3))
