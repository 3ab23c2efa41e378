"""Paper orders: MARKET, LIMIT, STOP_LIMIT, STOP_MARKET and OCO pairs matched against bars, in one ordered pass a symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.recursive import scan

FILL = "order_id string, status string, time long, price double"


class Book:
    """Open orders of a symbol. An order placed before a bar can fill in it; of an OCO pair the first to fill cancels the other."""

    def __init__(self, _key=None):
        self.open: list[dict] = []
        self.seen: set[str] = set()

    def step(self, r) -> list[tuple]:
        if r.kind:  # an order
            if r.idempotency_key in self.seen:
                return [(r.order_id, "DUPLICATE", r.time, None)]
            if r.idempotency_key:
                self.seen.add(r.idempotency_key)
            self.open.append({"id": r.order_id, "kind": r.kind, "side": r.side, "limit": r.limit, "stop": r.stop, "oco": r.oco, "armed": r.kind in ("MARKET", "LIMIT")})
            return []
        out: list[tuple] = []
        for o in list(self.open):
            if o not in self.open:
                continue
            buy = o["side"] == "BUY"
            if not o["armed"] and (r.high >= o["stop"] if buy else r.low <= o["stop"]):
                o["armed"] = True
                if o["kind"] == "STOP_MARKET":
                    out += self.fill(o, r.time, max(r.open, o["stop"]) if buy else min(r.open, o["stop"]))
                    continue
            if o["armed"] and o["kind"] == "MARKET":
                out += self.fill(o, r.time, r.open)
            elif o["armed"] and o["kind"] in ("LIMIT", "STOP_LIMIT") and (r.low <= o["limit"] if buy else r.high >= o["limit"]):
                out += self.fill(o, r.time, min(r.open, o["limit"]) if buy else max(r.open, o["limit"]))
        return out

    def fill(self, o: dict, time: int, price: float) -> list[tuple]:
        self.open.remove(o)
        out = [(o["id"], "FILLED", time, price)]
        for other in [x for x in self.open if o["oco"] and x["oco"] == o["oco"]]:
            self.open.remove(other)
            out.append((other["id"], "CANCELLED", time, None))
        return out

    def finish(self) -> list[tuple]:
        return [(o["id"], "OPEN", -1, None) for o in self.open]


def match_orders(orders: DataFrame, candles: DataFrame) -> DataFrame:
    """orders (symbol, time, order_id, kind, side, limit, stop, oco, idempotency_key) against candles: what became of each."""
    o = orders.withColumns({c: F.lit(None).cast("double") for c in ("open", "high", "low")}).withColumn("_rank", F.lit(0))
    text = {c: F.lit(None).cast("string") for c in ("order_id", "kind", "side", "oco", "idempotency_key")}
    b = candles.select("symbol", F.col("open_time").alias("time"), "open", "high", "low").withColumns(text | {c: F.lit(None).cast("double") for c in ("limit", "stop")}).withColumn("_rank", F.lit(1))
    columns = ["symbol", "time", "order_id", "kind", "side", "limit", "stop", "oco", "idempotency_key", "open", "high", "low", "_rank"]
    return scan(o.select(columns).unionByName(b.select(columns)), Book, columns, FILL, keys=["symbol"], order=("time", "_rank", "order_id"))


def upsert_guard(guards: DataFrame, fresh: DataFrame) -> DataFrame:
    """Symbol guards laid over stored ones; the revision counts up."""
    old = guards.select("symbol", F.col("revision").alias("_old"))
    new = fresh.join(old, "symbol", "left").withColumn("revision", F.coalesce("_old", F.lit(0)) + 1).drop("_old")
    return guards.join(fresh.select("symbol"), "symbol", "left_anti").unionByName(new, allowMissingColumns=True)


def claim_jobs(jobs: DataFrame, now: float, most: int = 100, tries: int = 3, wait: float = 30.0) -> DataFrame:
    """Queue rows to work on next: pending, or failed fewer than `tries` times and long enough ago, oldest first."""
    due = (F.col("status") == "pending") | ((F.col("status") == "failed") & (F.col("attempts") < tries) & (F.lit(now) - F.col("updated_at") >= wait))
    return jobs.where(due).orderBy("created_at", "job_id").limit(most)


def rank_symbols(df: DataFrame, score: str, most: int, keep: list[str] | None = None) -> DataFrame:
    """The best `most` by score and volume, and those to keep whatever their score."""
    best = df.orderBy(F.col(score).desc_nulls_last(), F.col("volume").desc_nulls_last(), "symbol").limit(most)
    return best if not keep else best.unionByName(df.where(F.col("symbol").isin(keep))).dropDuplicates(["symbol"])


def leading_losses(trades: DataFrame, order: str = "exit_time") -> DataFrame:
    """How many of each symbol's newest trades in a row lost."""
    w = Window.partitionBy("symbol").orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("_won", F.sum(F.when(F.col("pnl") >= 0, 1).otherwise(0)).over(w)).groupBy("symbol").agg(F.count_if(F.col("_won") == 0).alias("loss_run"))
