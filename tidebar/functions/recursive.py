"""Recursive indicators that aren't linear (see `linear` for those): one pass over each series in order, carrying a small state from batch to batch.

`scan` deals series to partitions, sorts them, and feeds rows to a machine a series as Arrow batches come, so a series of any length needs only its
machine's state in memory; Spark's sort spills.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .linear import NAMES, linear

SERIES = ["symbol", "timeframe"]


def scan(df: DataFrame, make: Callable, columns: list[str], schema: str, keys: list[str] = SERIES, order: tuple[str, ...] = ("open_time",)) -> DataFrame:
    """Rows that machines emit. make(key) gives a machine: step(row) and finish() return lists of tuples, without the keys, that match schema after them."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    names = keys + [part.split()[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, None
        for pdf in batches:
            out: list[tuple] = []
            for row in pdf.itertuples(index=False):
                own = tuple(row[: len(keys)])
                if own != key:
                    if machine is not None:
                        out += [(*key, *x) for x in machine.finish()]
                    key, machine = own, make(own)
                out += [(*own, *x) for x in machine.step(row)]
            yield pd.DataFrame(out, columns=names)
        if machine is not None:
            yield pd.DataFrame([(*key, *x) for x in machine.finish()], columns=names)

    picked = df.select(*keys, *[c for c in columns if c not in keys])
    return picked.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, f"{kinds}, {schema}")


class Ema:
    """alpha = 2 / (n + 1); seeded by the mean of the first n values, or by the first one. None until n values came."""

    def __init__(self, n: int, seed: str = "mean", alpha: float | None = None):
        self.n, self.seed, self.alpha = n, seed, alpha or 2 / (n + 1)
        self.count, self.value, self.total = 0, None, 0.0

    def __call__(self, x: float | None) -> float | None:
        if x is None:
            return None
        self.count += 1
        if self.seed == "first":
            self.value = x if self.value is None else self.alpha * x + (1 - self.alpha) * self.value
        elif self.count <= self.n:
            self.total += x
            if self.count == self.n:
                self.value = self.total / self.n
        else:
            self.value = self.alpha * x + (1 - self.alpha) * self.value
        return self.value if self.count >= self.n else None


class WilderRsi:
    """(average * (n - 1) + new) / n from bar 0; no losses: 100."""

    def __init__(self, n: int = 14):
        self.n, self.past, self.count, self.up, self.down = n, None, 0, 0.0, 0.0

    def __call__(self, x: float) -> float | None:
        past, self.past = self.past, x
        if past is None:
            return None
        gain, loss = max(x - past, 0.0), max(past - x, 0.0)
        self.count += 1
        if self.count <= self.n:
            self.up += gain / self.n
            self.down += loss / self.n
        else:
            self.up, self.down = (self.up * (self.n - 1) + gain) / self.n, (self.down * (self.n - 1) + loss) / self.n
        if self.count < self.n:
            return None
        return 100.0 if self.down == 0 else 100 - 100 / (1 + self.up / self.down)


class Kama:
    """Kaufman's average: the smoothing follows the efficiency ratio of the last n changes. Returns (average, ratio)."""

    def __init__(self, n: int = 10, fast: int = 2, slow: int = 30):
        self.n, self.fast, self.slow, self.past, self.value = n, 2 / (fast + 1), 2 / (slow + 1), deque(maxlen=n + 1), None

    def __call__(self, x: float) -> tuple[float | None, float | None]:
        self.past.append(x)
        if len(self.past) <= self.n:
            return None, None
        own = list(self.past)
        noise = sum(abs(b - a) for a, b in zip(own, own[1:]))
        ratio = abs(own[-1] - own[0]) / noise if noise else 0.0
        pace = (ratio * (self.fast - self.slow) + self.slow) ** 2
        self.value = own[-2] if self.value is None else self.value
        self.value += pace * (x - self.value)
        return self.value, ratio


class Sar:
    """Parabolic stop-and-reverse; (level, 1 rising or -1 falling). The pace starts at `start` after each turn and grows by `step` with each new extreme."""

    def __init__(self, start: float = 0.02, step: float = 0.05, most: float = 0.2):
        self.start, self.step, self.most, self.level, self.trend, self.edge, self.pace = start, step, most, None, 1, None, start
        self.bars: deque = deque(maxlen=2)

    def __call__(self, high: float, low: float) -> tuple[float, int]:
        side = self.trend
        # Seen from the rising side: `ahead` is where the trend goes, `behind` where it may be stopped.
        ahead, behind = (high, low) if side > 0 else (-low, -high)
        if self.level is None:
            self.level, self.edge = low, high
        else:
            level, edge = side * self.level, side * self.edge
            level = min([level + self.pace * (edge - level), *(side * bar[side > 0] for bar in self.bars)])
            if behind < level:
                self.trend, level, edge, self.pace = -side, edge, behind, self.start
            elif ahead > edge:
                edge, self.pace = ahead, min(self.most, self.pace + self.step)
            self.level, self.edge = side * level, side * edge
        self.bars.append((high, low))
        return self.level, self.trend


class MeanRange:
    """ATR as the plain mean of the last n true ranges; the first bar has one (its own range) only if `whole`."""

    def __init__(self, n: int, whole: bool = False):
        self.ranges, self.past, self.whole = deque(maxlen=n), None, whole

    def __call__(self, high: float, low: float, close: float) -> float | None:
        if self.past is not None:
            self.ranges.append(max(high - low, abs(high - self.past), abs(low - self.past)))
        elif self.whole:
            self.ranges.append(high - low)
        self.past = close
        return sum(self.ranges) / len(self.ranges) if len(self.ranges) == self.ranges.maxlen else None


class Supertrend:
    """Bands at factor * ATR around the middle that only tighten until a close passes them; the direction, at first by the close against the middle, turns when a close passes the band it runs along."""

    def __init__(self, n: int = 9, factor: float = 0.35):
        self.range, self.factor, self.upper, self.lower, self.trend, self.past = MeanRange(n, whole=True), factor, None, None, 0, None

    def __call__(self, high: float, low: float, close: float) -> int | None:
        size = self.range(high, low, close)
        past, self.past = self.past, close
        if size is None or past is None:
            return None
        middle = (high + low) / 2
        upper, lower = middle + self.factor * size, middle - self.factor * size
        if not self.trend:
            self.upper, self.lower, self.trend = upper, lower, 1 if close >= middle else -1
            return self.trend
        if upper < self.upper or past > self.upper:
            self.upper = upper
        if lower > self.lower or past < self.lower:
            self.lower = lower
        if close > self.upper if self.trend < 0 else close < self.lower:
            self.trend = -self.trend
        return self.trend


class TrailingStop:
    """A stop at factor * ATR behind the close, which follows and flips; 'buy' or 'sell' where the close crosses it."""

    def __init__(self, n: int = 11, factor: float = 2.0):
        self.range, self.factor, self.stop, self.past = MeanRange(n), factor, None, None

    def __call__(self, high: float, low: float, close: float) -> tuple[float | None, str | None]:
        size = self.range(high, low, close)
        past, self.past = self.past, close
        if size is None:
            return None, None
        gap, old = self.factor * size, self.stop
        if old is None:
            self.stop = close - gap
            return self.stop, None
        if close > old and past > old:
            self.stop = max(old, close - gap)
        elif close < old and past < old:
            self.stop = min(old, close + gap)
        else:
            self.stop = close - gap if close > old else close + gap
        return self.stop, "buy" if past <= old and close > self.stop else "sell" if past >= old and close < self.stop else None


class WilderConnors:
    """Connors RSI from smoothed RSIs of closes and of streaks, and the share of the last `rank` relative changes (this one included) that are smaller than this one."""

    def __init__(self, rsi: int = 3, streak: int = 2, rank: int = 100):
        self.price, self.run, self.changes, self.need = WilderRsi(rsi), WilderRsi(streak), deque(maxlen=rank), rank + rsi + streak + 2
        self.count, self.past, self.streak = 0, None, 0

    def __call__(self, x: float) -> float | None:
        past, self.past = self.past, x
        self.count += 1
        price = self.price(x)
        if past is None:
            return None
        step = (x > past) - (x < past)
        self.streak = step + (self.streak if step * self.streak > 0 else 0)
        run = self.run(self.streak)
        self.changes.append((x - past) / past if past else float("nan"))
        if self.count < self.need or price is None or run is None:
            return None
        return (price + run + 100 * sum(c < self.changes[-1] for c in self.changes) / len(self.changes)) / 3


def _of(machine, *names):
    """A machine fed with these columns of a row, giving a tuple."""
    one = (lambda r: (machine(*(getattr(r, n) for n in names)),)) if not isinstance(machine, (Kama, Sar, TrailingStop)) else (lambda r: machine(*(getattr(r, n) for n in names)))
    return one


#: Fields, and what makes the machine that gives them.
MACHINES: dict[str, Callable] = {
    "crsi_wilder double": lambda: _of(WilderConnors(), "close"), "kama double, efficiency double": lambda: _of(Kama(), "close"), "sar double, sar_trend int": lambda: _of(Sar(), "high", "low"),
    "supertrend int": lambda: _of(Supertrend(), "high", "low", "close"), "ut_stop double, ut_signal string": lambda: _of(TrailingStop(), "high", "low", "close"),
}


class _All:
    def __init__(self, fields: list[str]):
        self.machines = [MACHINES[f]() for f in fields]

    def step(self, r) -> list[tuple]:
        return [(r.open_time, *(x for machine in self.machines for x in machine(r)))]

    def finish(self) -> list[tuple]:
        return []


#: What recursive() gives if it isn't told.
USUAL = ["ema_9_r", "ema_21_r", "ema_50_r", "ewm_21", "rsi_wilder", "rsi_13", "macd_line", "macd_signal", "macd_hist", "ha_open", "ha_high", "ha_low", "ha_close", "tsi", "force", "bull_power", "bear_power"]


def recursive(candles: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(symbol, timeframe, open_time, ...): the recursive indicators of every bar, or those with these names only; null until they have the bars they need.

    Those that are linear go through linear(), which needs no ordered pass a series; the others through scan().
    """
    straight = USUAL if names is None else [n for n in names if n in NAMES]
    fields = [f for f in MACHINES if names is None or {x.split()[0] for x in f.split(", ")} & set(names)]
    scanned = scan(candles, lambda _key: _All(fields), ["symbol", "timeframe", "open_time", "open", "high", "low", "close", "volume"], f"open_time long, {', '.join(fields)}") if fields else None
    out = linear(candles, straight) if straight else scanned
    out = out.join(scanned, [*SERIES, "open_time"]) if straight and fields else out
    return out if names is None else out.select(*SERIES, "open_time", *names)
