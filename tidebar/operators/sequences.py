"""Patterns over ordered rows: steps that follow each other within so many rows, found in one pass over each series; and what is made of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.indicators import SERIES, series


@dataclass(frozen=True)
class Step:
    """A row on which `when` holds, at most `within` rows after the step before. skip: of several, 'next' takes the first, whatever follows it; 'any' the first from which the rest of the pattern
    is found, too."""

    name: str
    when: Column
    within: int = 1
    skip: str = "next"


def sequences(df: DataFrame, steps: list[Step], by: tuple[str, ...] = SERIES, order: str = "open_time") -> DataFrame:
    """The rows of df on which the first step holds and the others follow, with `<name>_at`, the order of each later step's row.

    Compiled from the last step to the first: each row's first follower is the first non-null in a bounded frame ahead of it, so all steps share one shuffle and one sort of a
    series. Conditions that are unknown don't hold. Rows of one place in the order come in any order; they are expected to be single.
    """
    if not steps or any(s.skip not in ("next", "any") or s.within < 1 for s in steps):
        raise ValueError("steps must be given, with skip 'next' or 'any' and within of 1 or more")
    names = [f"_step{i}" for i in range(len(steps))]
    out = df.withColumns({f"_holds{i}": F.coalesce(s.when, F.lit(False)) for i, s in enumerate(steps)})
    w = Window.partitionBy(*by).orderBy(order)
    # A row's _step: null where its step doesn't hold, else whether the rest is found, and where.
    for i in range(len(steps) - 1, -1, -1):
        if i == len(steps) - 1:
            found, ends = F.lit(True), F.array().cast(f"array<{df.schema[order].dataType.simpleString()}>")
        else:
            nxt = steps[i + 1]
            follower = F.when(F.col(names[i + 1]).isNotNull() & (F.lit(nxt.skip == "next") | F.col(names[i + 1])["found"]), F.struct(F.col(order).alias("at"), F.col(names[i + 1]).alias("rest")))
            first = F.first(follower, ignorenulls=True).over(w.rowsBetween(1, nxt.within))
            out = out.withColumn(f"_first{i}", first)
            found = F.coalesce(F.col(f"_first{i}")["rest"]["found"], F.lit(False))
            ends = F.concat(F.array(F.col(f"_first{i}")["at"]), F.col(f"_first{i}")["rest"]["ends"])
        out = out.withColumn(names[i], F.when(F.col(f"_holds{i}"), F.struct(found.alias("found"), F.when(found, ends).alias("ends"))))
    return out.where(F.col("_step0")["found"]).select(*df.columns, *[F.col("_step0")["ends"][i].alias(f"{s.name}_at") for i, s in enumerate(steps[1:])])


def pullbacks(prepared: DataFrame, start: Column, limit: int = 10, average: str = "ema_9_r", vwap: str = "vwap_20") -> DataFrame:
    """Starts followed within `limit` bars by a rising bar that holds above the average and the VWAP (its low within 0.1 % of the lower one) and closes above the bar before; entered on the bar after that."""
    lower = F.least(average, vwap)
    holds = (F.col("low") >= lower * 0.999) & (F.col("close") > F.col(average)) & (F.col("close") > F.col(vwap)) & (F.col("close") > F.col("open")) & (F.col("close") > F.lag("close").over(series()))
    return sequences(prepared, [Step("start", start), Step("pullback", F.col(average).isNotNull() & F.col(vwap).isNotNull() & holds, limit), Step("entry", F.lit(True), 1)])


def context_trigger() -> Column:
    """A close above average and VWAP with strength: needs ema_9_r, vwap_20, rsi_14, mfi_14, plus_di, minus_di, bb_position."""
    known = lambda c: F.coalesce(c, F.lit(0.0))
    return (F.col("close") > F.col("ema_9_r")) & (F.col("close") > F.col("vwap_20")) & (known("rsi_14") >= 60) & (known("mfi_14") >= 50) & (known("plus_di") > known("minus_di")) & (known("bb_position") >= 0.65)


def context_continuation() -> Column:
    return (F.coalesce("plus_di", F.lit(0.0)) > F.coalesce("minus_di", F.lit(0.0))) & (F.coalesce("rsi_14", F.lit(0.0)) >= 60)


def context_reversal() -> Column:
    """RSI and money flow above those of the bar before."""
    was = lambda c: F.lag(c).over(series())
    return (F.col("rsi_14") > was("rsi_14")) & (F.col("mfi_14") > was("mfi_14"))


def divergences(prepared: DataFrame, indicators: dict[str, str], block: int = 10, need: int = 40) -> DataFrame:
    """prepared (with bar) and, for each name: column of indicators, `<name>_bullish_divergence` and `<name>_bearish_divergence`: 1 or 0, null before bar `need`.

    The last `block` bars are held against the `block` that end at the middle of the history: a lower low of the price with a higher low of the indicator is bullish, a higher high with a lower high
    bearish. What the indicator lacks counts as 0. Each bar's block is summed up once; the middle's is looked up by its number.
    """
    w = series().rowsBetween(1 - block, 0)
    value = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    ends = {"_hi": F.max("close").over(w), "_lo": F.min("close").over(w)} | {f"_{side}_{n}": f(value(c)).over(w) for n, c in indicators.items() for side, f in (("hi", F.max), ("lo", F.min))}
    rows = prepared.withColumns(ends)
    middle = rows.select(*SERIES, F.col("bar").alias("_mid"), *[F.col(c).alias(f"_was{c}") for c in ends])
    out = rows.withColumn("_mid", F.floor(F.col("bar") / 2).cast("int")).join(middle.withColumn("_mid", F.col("_mid").cast("int")), [*SERIES, "_mid"], "left")
    flags = {}
    for n in indicators:
        bullish = (F.col("_lo") < F.col("_was_lo")) & (F.col(f"_lo_{n}") > F.col(f"_was_lo_{n}"))
        bearish = (F.col("_hi") > F.col("_was_hi")) & (F.col(f"_hi_{n}") < F.col(f"_was_hi_{n}"))
        flags |= {f"{n}_{kind}_divergence": F.when(F.col("bar") >= need, F.coalesce(c, F.lit(False)).cast("int")) for kind, c in (("bullish", bullish), ("bearish", bearish))}
    return out.withColumns(flags).drop("_mid", *ends, *[f"_was{c}" for c in ends])
