"""Trade replays: signals filled at the next open, exits in a fixed order of precedence, costs on both sides.

A series is replayed in one ordered pass with the open position as its only state; scenarios are columns of a table joined to the series,
so a grid of them runs as so many more series.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.recursive import scan

TRADE = "entry_time long, exit_time long, entry double, exit double, quantity double, pnl double, commission double, reason string, mfe double, mae double"


@dataclass(frozen=True)
class Scenario:
    name: str = "base"
    stop: float | None = 0.02
    target: float | None = 0.03
    trail: float | None = None
    arm: float | None = None  #: profit at which a lock is set, and where
    lock: float | None = None
    max_hold: int | None = None
    order: float = 500.0
    fee: float = 0.0015
    slip: float = 0.0005
    spread: float = 0.0
    start_ms: int = 0
    mark_open: bool = True  #: at the end an open trade is sold at the last close, else dropped


def scenarios(spark: SparkSession, rows: list[Scenario]) -> DataFrame:
    kinds = {"name": "string", "max_hold": "int", "start_ms": "long", "mark_open": "boolean"}
    return spark.createDataFrame([tuple(asdict(r).values()) for r in rows], ", ".join(f"{k} {kinds.get(k, 'double')}" for k in asdict(Scenario())))


class Replay:
    """One series under one scenario. Stop, then target, then trailing stop or lock, then age, then the exit signal; the stop wins within a bar."""

    def __init__(self, _key=None):
        self.trade = self.last = None
        self.armed, self.wait, self.pending, self.bar = True, -1, False, -1

    def close(self, r, price: float, reason: str) -> list[tuple]:
        t, self.trade = self.trade, None
        half = r.spread / 2
        bought, sold = t["entry"] * (1 + half + r.slip), price * max(0.0, 1 - half - r.slip)
        fees = (bought + sold) * t["quantity"] * r.fee
        return [(t["time"], r.open_time, bought, sold, t["quantity"], (sold - bought) * t["quantity"] - fees, fees, reason, t["high"] / t["entry"] - 1, t["low"] / t["entry"] - 1)]

    def step(self, r) -> list[tuple]:
        self.bar += 1
        out: list[tuple] = []
        if self.pending and r.open > 0:
            self.trade = {"entry": r.open, "quantity": r.order / r.open, "time": r.open_time, "bar": self.bar, "high": r.open, "low": r.open, "lock": None}
        self.pending = False
        if t := self.trade:
            t["high"], t["low"] = max(t["high"], r.high), min(t["low"], r.low)
            has = lambda x: x is not None and x == x  # noqa: E731  null comes as NaN
            exit_at = None
            if has(r.stop) and r.low <= t["entry"] * (1 - r.stop):
                exit_at = t["entry"] * (1 - r.stop), "stop"
            elif has(r.target) and r.high >= t["entry"] * (1 + r.target):
                exit_at = t["entry"] * (1 + r.target), "target"
            elif has(r.trail) and r.low <= t["high"] * (1 - r.trail):
                exit_at = t["high"] * (1 - r.trail), "trail"
            elif t["lock"] is not None and r.low <= t["lock"]:
                exit_at = t["lock"], "profit_lock"
            elif has(r.max_hold) and self.bar - t["bar"] >= r.max_hold:
                exit_at = r.close, "max_hold"
            elif r.exit_signal:
                exit_at = r.close, "signal"
            if exit_at:
                out = self.close(r, *exit_at)
                self.wait, self.armed = self.bar + 1, False
            elif has(r.arm) and t["lock"] is None and r.high >= t["entry"] * (1 + r.arm):
                t["lock"] = t["entry"] * (1 + r.lock)
        wanted = bool(r.entry_signal) and r.open_time >= r.start_ms
        if not wanted:
            self.armed = True
        if self.trade is None and self.bar >= self.wait and self.armed and wanted:
            self.pending, self.armed = True, False
        self.last = r
        return out

    def finish(self) -> list[tuple]:
        return self.close(self.last, self.last.close, "open_at_end") if self.trade and self.last.mark_open else []


def replay(signals: DataFrame, plan: DataFrame) -> DataFrame:
    """signals: candles with booleans entry_signal and exit_signal; plan: from scenarios(). Trades of every series under every scenario."""
    each = signals.crossJoin(F.broadcast(plan))
    columns = ["symbol", "timeframe", "name", "open_time", "open", "high", "low", "close", "entry_signal", "exit_signal", *[c for c in plan.columns if c != "name"]]
    return scan(each, Replay, columns, TRADE, keys=["symbol", "timeframe", "name"])


def summary(trades: DataFrame, by: list[str]) -> DataFrame:
    """Trades, wins, net, profit factor (null without losses), costs, deepest fall of the running sum."""
    upto = Window.partitionBy(*by).orderBy("exit_time", "entry_time").rowsBetween(Window.unboundedPreceding, 0)
    rows = trades.withColumn("_s", F.sum("pnl").over(upto)).withColumn("_t", F.greatest(F.lit(0.0), F.max("_s").over(upto)))
    gain, loss = F.sum(F.when(F.col("pnl") > 0, F.col("pnl")).otherwise(0.0)), -F.sum(F.when(F.col("pnl") <= 0, F.col("pnl")).otherwise(0.0))
    return rows.groupBy(*by).agg(F.count("*").alias("trades"), F.count_if(F.col("pnl") > 0).alias("wins"), F.sum("pnl").alias("net_pnl"), (gain / F.nullif(loss, F.lit(0.0))).alias("profit_factor"), F.sum("commission").alias("commission"), F.max(F.col("_t") - F.col("_s")).alias("max_drawdown"))


def exit_reasons(trades: DataFrame, by: list[str]) -> DataFrame:
    return trades.groupBy(*by, "reason").agg(F.count("*").alias("n"))


class Wallet:
    """Closed trades of all series through one wallet, in order of entry: taken while there is cash and room."""

    def __init__(self, cash: float, most: int):
        self.cash, self.most, self.open = cash, most, []

    def step(self, r) -> list[tuple]:
        for t in sorted(x for x in self.open if x[0] <= r.entry_time):
            self.cash += t[1]
            self.open.remove(t)
        cost = r.entry * r.quantity
        taken = len(self.open) < self.most and self.cash >= cost
        if taken:
            self.cash -= cost
            self.open.append((r.exit_time, cost + r.pnl))
        return [(r.symbol, r.entry_time, r.exit_time, r.pnl, taken, self.cash)]

    def finish(self) -> list[tuple]:
        return []


def shared_wallet(trades: DataFrame, cash: float, most: int) -> DataFrame:
    """Which trades one wallet could take, scenario by scenario. Cash couples all symbols, so a scenario is one ordered pass; it carries only the open trades."""
    return scan(trades, lambda _key: Wallet(cash, most), ["name", "symbol", "entry_time", "exit_time", "entry", "quantity", "pnl"], "symbol string, entry_time long, exit_time long, pnl double, taken boolean, cash double", keys=["name"], order=("entry_time", "exit_time", "symbol"))
