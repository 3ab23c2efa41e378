"""The pattern matcher against plain loops."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidebar.operators.sequences import Step, sequences


def plain(rows, steps):
    """rows of one series in order: {start: [ends]}; steps: (letter, within, skip)."""

    def rest(i, k):
        if k == len(steps):
            return []
        letter, within, skip = steps[k]
        for j in range(i + 1, min(len(rows), i + within + 1)):
            if rows[j][1] is not None and letter in rows[j][1]:
                found = rest(j, k + 1)
                if found is not None:
                    return [rows[j][0], *found]
                if skip == "next":
                    return None
        return None

    return {rows[i][0]: ends for i in range(len(rows)) if rows[i][1] is not None and steps[0][0] in rows[i][1] and (ends := rest(i, 1)) is not None}


@pytest.mark.parametrize("steps", [[("a", 1, "next")], [("a", 1, "next"), ("b", 3, "next")], [("a", 1, "next"), ("b", 4, "next"), ("c", 2, "next")], [("a", 1, "next"), ("b", 4, "any"), ("c", 2, "any"), ("a", 3, "next")]])
def test_sequences(spark, steps):
    rng = random.Random(len(steps))
    data = {k: [(t, rng.choice([None, "", "a", "b", "c", "ab", "abc"])) for t in sorted(rng.sample(range(1000), 80))] for k in ("x", "y")} | {None: [(1, "a"), (2, "b"), (3, "c")]}
    df = spark.createDataFrame([(k, t, s) for k, own in data.items() for t, s in own], "k string, t long, s string")
    asked = [Step(f"s{i}", F.contains(F.col("s"), F.lit(letter)), within, skip) for i, (letter, within, skip) in enumerate(steps)]
    out = sequences(df, asked, ("k",), "t")
    got = {(r["k"], r["t"]): [r[f"s{i}_at"] for i in range(1, len(steps))] for r in out.collect()}
    assert got == {(k, t): ends for k, own in data.items() for t, ends in plain(own, steps).items()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") <= 1 and plan.count("Sort [") <= 1
    assert sequences(df.limit(0), asked, ("k",), "t").count() == 0


def test_steps_are_checked(spark):
    for steps in ([], [Step("a", F.lit(True), 0)], [Step("a", F.lit(True), 1, "last")]):
        with pytest.raises(ValueError):
            sequences(spark.range(1), steps, ("id",), "id")
