"""Linear recurrences without a pass a series: state = A * state + b, with maps of blocks composed level by level, so that many tasks work on one series.

A block's bars act on the state as one affine map. Maps are composed up a tree of blocks, a start state goes down it, and each block is then run from its start: everything
is Spark's grouping, joins and higher-order functions, and no series is in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from math import cos, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.market import MINUTE, TIMEFRAMES

#: Bars of a block, and maps that are composed at a time.
FAN = 128
#: Levels of blocks below a series: FAN ** (LEVELS + 1) bars come together in one map.
LEVELS = 2
SERIES = ("symbol", "timeframe")
Entry = Column | float


@dataclass(frozen=True)
class Recurrence:
    """size numbers of state. step(bar, row, past) gives the rows of A, each up to its diagonal (a state follows itself and those before it), and b; past is the
    row before, with null fields at bar 1. value(bar, row, past, state) gives the columns."""

    size: int
    step: Callable[[Column, Column, Column], tuple[list[list[Entry]], list[Entry]]]
    value: Callable[[Column, Column, Column, list[Column]], dict[str, Column]]


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, terms) if terms else F.lit(0.0)


def _times(a: Entry, x: Column) -> list[Column]:
    return [] if isinstance(a, float) and a == 0 else [x] if isinstance(a, float) and a == 1 else [a * x]


def _after(a: list[list[Entry]], b: list[Entry], m: Column, n: int) -> Column:
    """The map m, then x -> a x + b."""
    rows = [_sum([t for k in range(j, i + 1) for t in _times(a[i][k], m["a"][k * n + j])]) if j <= i else F.lit(0.0) for i in range(n) for j in range(n)]
    return F.struct(F.array(*rows).alias("a"), _applied(a, b, [m["b"][k] for k in range(n)]).alias("b"))


def _applied(a: list[list[Entry]], b: list[Entry], state: list[Column]) -> Column:
    own = [x if isinstance(x, Column) else F.lit(float(x)) for x in b]
    return F.array(*[_sum([t for k in range(i + 1) for t in _times(a[i][k], state[k])] + [own[i]]) for i in range(len(b))])


def _identity(n: int) -> Column:
    return F.struct(F.array(*[F.lit(float(i == j)) for i in range(n) for j in range(n)]).alias("a"), F.array(*[F.lit(0.0)] * n).alias("b"))


def _entries(m: Column, n: int) -> tuple[list[list[Column]], list[Column]]:
    return [[m["a"][i * n + k] for k in range(i + 1)] for i in range(n)], [m["b"][i] for i in range(n)]


def run(rows: DataFrame, recurrences: list[Recurrence], inputs: list[str], keys: tuple[str, ...] = SERIES, time: str = "open_time", width: Column | int = MINUTE, fan: int = FAN) -> DataFrame:
    """(keys, time, the recurrences' columns), a row for each row of rows that has a time, all keys and all inputs.

    Blocks are cut by time, fan * width each, so a series on a grid of that width has at most fan rows a block; another grid gives other blocks and the same
    results up to rounding. Rows of one time are taken in order of their inputs.
    """
    names, sizes = [f"m{i}" for i in range(len(recurrences))], [r.size for r in recurrences]
    known = rows.where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (*keys, time, *inputs)]))
    cell = F.struct(F.col(time).alias("t"), *inputs)
    blocks = known.groupBy(*keys, F.floor(F.col(time) / (F.lit(fan) * width)).alias("at")).agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    # One short row a block is put in order here: how many bars came before, and the last of them.
    order = Window.partitionBy(*keys).orderBy("at")
    facts = blocks.select(*keys, "at", F.size("cells").alias("n"), F.element_at("cells", -1).alias("end"))
    facts = facts.select(*keys, "at", (F.sum("n").over(order) - F.col("n")).alias("before"), F.lag("end").over(order).alias("past"))
    blocks = blocks.join(facts, [*keys, "at"])

    def begun(**fields: Column) -> Column:
        return F.struct(F.col("before").alias("bar"), F.col("past").alias("past"), *[c.alias(k) for k, c in fields.items()])

    def mapped(acc: Column, row: Column) -> Column:
        bar = acc["bar"] + 1
        steps = [r.step(bar, row, acc["past"]) for r in recurrences]
        return F.struct(bar.alias("bar"), row.alias("past"), *[_after(*s, acc[m], n).alias(m) for s, m, n in zip(steps, names, sizes)])

    start = begun(**{m: _identity(n) for m, n in zip(names, sizes)})
    own = F.aggregate("cells", start, mapped, lambda acc: F.struct(*[acc[m].alias(m) for m in names]))
    maps = blocks.select(*keys, "at", own.alias("map"))

    def composed(parts: Column) -> Column:
        first = F.struct(*[_identity(n).alias(m) for m, n in zip(names, sizes)])
        return F.aggregate(parts, first, lambda acc, p: F.struct(*[_after(*_entries(p["map"][m], n), acc[m], n).alias(m) for m, n in zip(names, sizes)]))

    def walked(parts: Column, start: Column) -> Column:
        """For each part its place and the state it starts from."""
        state = lambda acc: F.struct(*[acc["state"][m].alias(m) for m in names])
        none = F.array().cast(f"array<struct<at: bigint, state: struct<{', '.join(f'{m}: array<double>' for m in names)}>>>")
        ahead = lambda acc, p: F.struct(*[_applied(*_entries(p["map"][m], n), [acc["state"][m][k] for k in range(n)]).alias(m) for m, n in zip(names, sizes)])
        step = lambda acc, p: F.struct(ahead(acc, p).alias("state"), F.concat(acc["out"], F.array(F.struct(p["at"].alias("at"), state(acc).alias("state")))).alias("out"))
        return F.aggregate(parts, F.struct(start.alias("state"), none.alias("out")), step, lambda acc: acc["out"])

    parts = F.array_sort(F.collect_list(F.struct("at", "map"))).alias("parts")
    levels = []
    for _ in range(LEVELS):
        levels.append(maps.groupBy(*keys, F.floor(F.col("at") / fan).alias("over")).agg(parts))
        maps = levels[-1].select(*keys, F.col("over").alias("at"), composed(F.col("parts")).alias("map"))
    zero = F.struct(*[F.array(*[F.lit(0.0)] * n).alias(m) for m, n in zip(names, sizes)])
    starts = maps.groupBy(*keys).agg(parts).select(*keys, F.inline(walked(F.col("parts"), zero)))
    for level in reversed(levels):
        starts = level.join(starts.withColumnRenamed("at", "over"), [*keys, "over"]).select(*keys, F.inline(walked(F.col("parts"), F.col("state"))))

    def played(acc: Column, row: Column) -> Column:
        bar = acc["bar"] + 1
        states = [_applied(*r.step(bar, row, acc["past"]), [acc[m][k] for k in range(n)]) for r, m, n in zip(recurrences, names, sizes)]
        return F.struct(bar.alias("bar"), row.alias("past"), *[s.alias(m) for s, m in zip(states, names)], F.concat(acc["out"], F.array(F.struct(row.alias("row"), acc["past"].alias("past"), bar.alias("bar"), *[s.alias(m) for s, m in zip(states, names)]))).alias("out"))

    joined = blocks.join(starts, [*keys, "at"])
    kind = rows.select(cell.alias("c")).schema["c"].dataType.simpleString()
    none = F.array().cast(f"array<struct<row: {kind}, past: {kind}, bar: bigint, {', '.join(f'{m}: array<double>' for m in names)}>>")
    whole = F.aggregate("cells", begun(**{m: F.col("state")[m] for m in names}, out=none), played, lambda acc: acc["out"])
    out = joined.select(*keys, F.inline(whole))
    values = {k: v for r, m, n in zip(recurrences, names, sizes) for k, v in r.value(F.col("bar"), F.col("row"), F.col("past"), [F.col(m)[i] for i in range(n)]).items()}
    return out.select(*keys, F.col("row.t").alias(time), *[v.alias(k) for k, v in values.items()])


def _close(row: Column, past: Column) -> Column:
    return row["close"]


def _change(row: Column, past: Column) -> Column:
    return row["close"] - past["close"]


def _smoothing(k: Column, n: int, x: Entry, seed: str, alpha: float | None = None) -> tuple[Column, Column]:
    """(a, b) of an average's k-th value (none before the first): of n, seeded by the mean of the first n or by the first."""
    alpha = alpha or 2 / (n + 1)
    if seed == "first":
        return F.when(k <= 1, 0.0).otherwise(1 - alpha), F.when(k < 1, 0.0).when(k == 1, x).otherwise(alpha * x)
    return F.when(k <= n, 1.0).otherwise(1 - alpha), F.when(k < 1, 0.0).when(k <= n, x / n).otherwise(alpha * x)


def average(name: str, n: int, seed: str = "mean", alpha: float | None = None, source: Callable = _close, first: int = 1) -> Recurrence:
    """alpha = 2 / (n + 1); null until n values came. The source's first value is that of bar `first`."""

    def step(bar, row, past):
        a, b = _smoothing(bar - (first - 1), n, source(row, past), seed, alpha)
        return [[a]], [b]

    return Recurrence(1, step, lambda bar, row, past, s: {name: F.when(bar >= n + first - 1, s[0])})


def cascade(stages: list[tuple[int, str]], source: Callable, first: int, value: Callable[[Column, Column, Column, list[Column], list[int]], dict[str, Column]]) -> Recurrence:
    """Averages of averages: each stage (n, seed) takes the one before from its n-th value on. value also gets the bars from which the stages are known."""
    begins, known = [first], []
    for n, _ in stages:
        known.append(begins[-1] + n - 1)
        begins.append(known[-1])

    def step(bar, row, past):
        a, b = [], []
        for i, (n, seed) in enumerate(stages):
            k = bar - (begins[i] - 1)
            if i == 0:
                own, add = _smoothing(k, n, source(row, past), seed)
                a.append([own])
                b.append(add)
                continue
            # What a value weighs: of the value itself, which is linear in the states before.
            own, weight = _smoothing(k, n, F.lit(1.0), seed)
            a.append([weight * x for x in a[i - 1]] + [own])
            b.append(weight * b[i - 1])
        return a, b

    return Recurrence(len(stages), step, lambda bar, row, past, s: value(bar, row, past, s, known))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Recurrence:
    """Line, signal and histogram of mean-seeded averages; the signal's seed starts at the line's first value."""

    def step(bar, row, past):
        (a1, b1), (a2, b2) = (_smoothing(bar, n, row["close"], "mean") for n in (fast, slow))
        own, weight = _smoothing(bar - (slow - 1), signal, F.lit(1.0), "mean")
        return [[a1], [0.0, a2], [weight * a1, -weight * a2, own]], [b1, b2, weight * (b1 - b2)]

    def value(bar, row, past, s):
        line, ready = s[0] - s[1], bar >= slow + signal - 1
        return {"macd_line": F.when(ready, line), "macd_signal": F.when(ready, s[2]), "macd_hist": F.when(ready, line - s[2])}

    return Recurrence(3, step, value)


def wilder_rsi(name: str, n: int = 14) -> Recurrence:
    """(average * (n - 1) + new) / n, seeded by the mean of the first n changes; no losses: 100."""

    def step(bar, row, past):
        up, down = (_smoothing(bar - 1, n, F.coalesce(F.greatest(sign * _change(row, past), F.lit(0.0)), F.lit(0.0)), "mean", 1 / n) for sign in (1, -1))
        return [[up[0]], [0.0, down[0]]], [up[1], down[1]]

    return Recurrence(2, step, lambda bar, row, past, s: {name: F.when(bar > n, F.when(s[1] == 0, 100.0).otherwise(100 - 100 / (1 + s[0] / s[1])))})


def ewm_rsi(name: str = "rsi_ewm", n: int = 14) -> Recurrence:
    """With averages that start from the first change, alpha 1 / n; null where there are no losses."""

    def step(bar, row, past):
        up, down = (_smoothing(bar - 1, n, F.coalesce(F.greatest(sign * _change(row, past), F.lit(0.0)), F.lit(0.0)), "first", 1 / n) for sign in (1, -1))
        return [[up[0]], [0.0, down[0]]], [up[1], down[1]]

    return Recurrence(2, step, lambda bar, row, past, s: {name: F.when(bar > n, F.when(s[1] != 0, 100 - 100 / (1 + s[0] / s[1])))})


def heikin_ashi() -> Recurrence:
    """Smoothed candles."""
    mean = lambda r: (r["open"] + r["high"] + r["low"] + r["close"]) / 4

    def step(bar, row, past):
        return [[F.when(bar == 1, 0.0).otherwise(0.5)]], [F.when(bar == 1, (row["open"] + row["close"]) / 2).otherwise(mean(past) / 2)]

    return Recurrence(1, step, lambda bar, row, past, s: {"ha_open": s[0], "ha_high": F.greatest(row["high"], s[0], mean(row)), "ha_low": F.least(row["low"], s[0], mean(row)), "ha_close": mean(row)})


def gaussian(name: str, source: str, n: int = 25, poles: int = 5) -> Recurrence:
    """A filter of several equal poles: single ones in a row, all from zero; column `source`, where it is null the state stays."""
    b = (1 - cos(2 * pi / n)) / (1.414 ** (2 / poles) - 1)
    alpha = -b + sqrt(b * b + 2 * b)

    def step(bar, row, past):
        has = row[source] != float("-inf")
        keep, add = F.when(has, 1 - alpha).otherwise(1.0), F.when(has, alpha).otherwise(0.0)
        a = [[keep]]
        into = [F.when(has, alpha * row[source]).otherwise(0.0)]
        for i in range(1, poles):
            a.append([add * x for x in a[i - 1]] + [keep])
            into.append(add * into[i - 1])
        return a, into

    return Recurrence(poles, step, lambda bar, row, past, s: {name: F.when(row[source] != float("-inf"), s[-1])})


def _force(row: Column, past: Column) -> Column:
    return _change(row, past) * row["volume"]


def _share(up: str) -> Recurrence:
    source = _change if up == "tsi_up" else lambda row, past: F.abs(_change(row, past))
    return cascade([(25, "mean"), (13, "mean")], source, 2, lambda bar, row, past, s, known: {up: F.when(bar >= known[1], s[1])})


def _impulse(row: Column, past: Column) -> Column:
    return row["close"] / past["close"] * 100 - 100


#: What gives each group of columns; columns that begin with _ are for `linear` itself.
RECURRENCES: dict[tuple[str, ...], Callable[[], Recurrence]] = {
    ("ema_9_r",): lambda: average("ema_9_r", 9), ("ema_21_r",): lambda: average("ema_21_r", 21), ("ema_50_r",): lambda: average("ema_50_r", 50), ("ewm_21",): lambda: average("ewm_21", 21, "first"),
    ("rsi_wilder",): lambda: wilder_rsi("rsi_wilder"), ("rsi_13",): lambda: wilder_rsi("rsi_13", 13), ("rsi_ewm",): ewm_rsi, ("macd_line", "macd_signal", "macd_hist"): macd, ("ha_open", "ha_high", "ha_low", "ha_close"): heikin_ashi,
    ("tsi_up",): lambda: _share("tsi_up"), ("tsi_size",): lambda: _share("tsi_size"), ("force",): lambda: average("force", 13, source=_force, first=2), ("ema_13_r",): lambda: average("ema_13_r", 13),
    ("dpmo",): lambda: cascade([(35, "first"), (20, "first"), (10, "first")], _impulse, 2, lambda bar, row, past, s, known: {"dpmo": F.when(bar >= known[2], 10 * (s[1] - s[2]))}),
}
#: Columns worked out from others.
DERIVED: dict[str, tuple[tuple[str, ...], Callable[[], Column]]] = {
    "tsi": (("tsi_up", "tsi_size"), lambda: F.when(F.col("tsi_size") != 0, 100 * F.col("tsi_up") / F.col("tsi_size")).when(F.col("tsi_size") == 0, 0.0)),
    "bull_power": (("ema_13_r",), lambda: F.col("high") - F.col("ema_13_r")), "bear_power": (("ema_13_r",), lambda: F.col("low") - F.col("ema_13_r")),
}
NAMES = {n for group in RECURRENCES for n in group} | set(DERIVED)


def width_of(timeframe: str = "timeframe") -> Column:
    """Milliseconds of a timeframe by name; a minute for others."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in TIMEFRAMES.items() for x in pair]), F.col(timeframe)), F.lit(MINUTE)).cast("long")


def linear(candles: DataFrame, names: list[str], fan: int = FAN) -> DataFrame:
    """(symbol, timeframe, open_time, *names): indicators that are linear recurrences, null until they have the bars they need."""
    need = {x for n in names for x in (DERIVED[n][0] if n in DERIVED else (n,))}
    groups = [make() for group, make in RECURRENCES.items() if need & set(group)]
    inputs = ["open", "high", "low", "close", "volume"]
    carried = Recurrence(1, lambda bar, row, past: ([[0.0]], [0.0]), lambda bar, row, past, s: {"high": row["high"], "low": row["low"]})
    out = run(candles, [*groups, carried] if any(n in DERIVED for n in names) else groups, inputs, width=width_of(), fan=fan)
    return out.select(*SERIES, "open_time", *[DERIVED[n][1]().alias(n) if n in DERIVED else n for n in names])


def gaussian_trend(candles: DataFrame, n: int = 25, poles: int = 5, bars: int = 10, fan: int = FAN) -> DataFrame:
    """(symbol, timeframe, open_time, gf, gf_long): the filter of closes that move by less than a sample deviation of the last `bars` held at the close before, and whether it turns up here."""
    w = Window.partitionBy(*SERIES).orderBy("open_time")
    deviation = F.when(F.count("close").over(w.rowsBetween(1 - bars, 0)) == bars, F.stddev_samp("close").over(w.rowsBetween(1 - bars, 0)))
    past = F.lag("close").over(w)
    # The first bar has nothing to hold: minus infinity stands for a missing value, as inputs aren't null.
    held = candles.select(*SERIES, "open_time", F.coalesce(F.when(F.abs(F.col("close") - past) >= deviation, F.col("close")).otherwise(past), F.lit(float("-inf"))).alias("held"))
    out = run(held, [gaussian("gf", "held", n, poles)], ["held"], width=width_of(), fan=fan)
    was, before = F.lag("gf").over(w), F.lag("gf", 2).over(w)
    return out.select(*SERIES, "open_time", "gf", F.coalesce((F.col("gf") > was) & (was <= before), F.lit(False)).alias("gf_long"))
