"""Scalar helpers as columns: erf, exact percentiles, trade economics, text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def erf(x: Column) -> Column:
    """Rational approximation, absolute error below 1.5e-7."""
    # The coefficients of the approximation.
    p, a = 0.3275911, (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
    t = 1 / (1 + p * F.abs(x))
    poly = t * (a[0] + t * (a[1] + t * (a[2] + t * (a[3] + t * a[4]))))
    return F.signum(x) * (1 - poly * F.exp(-x * x))


def normal_cdf(x: Column) -> Column:
    return 0.5 * (1 + erf(x / F.sqrt(F.lit(2.0))))


def percentile(values: Column, share: float, how: str = "nearest") -> Column:
    """Of an array, without its nulls. nearest: the ceil(share * n)-th; floor: index floor((n - 1) * share); round: the same with half-even rounding."""
    own = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    n = F.size(own)
    at = {"nearest": F.greatest(F.lit(1), F.ceil(n * F.lit(share))), "floor": F.floor((n - 1) * F.lit(share)) + 1, "round": F.bround((n - 1) * F.lit(share)) + 1}[how]
    return F.try_element_at(own, at.cast("int"))


def trade_economics(entry: Column, stop: Column, target: Column, quantity: Column, fee: float = 0.0015, slip: float = 0.0005, spread: float = 0.0) -> dict[str, Column]:
    """Costs and break-even of a planned long trade; ratios are null where the risk is not positive."""
    cost = 2 * (fee + slip) + spread
    risk = (entry - stop) * quantity + entry * quantity * cost
    gain = (target - entry) * quantity - entry * quantity * cost
    return {"cost": entry * quantity * cost, "break_even": entry * (1 + cost), "net_risk": risk, "net_reward": gain, "reward_to_risk": F.when(risk > 0, gain / risk)}


def fold_text(text: Column) -> Column:
    """Lower case with Turkish letters folded to plain ones."""
    return F.translate(F.lower(F.translate(text, "İIĞÜŞÖÇ", "iigusoc")), "ığüşöç", "igusoc")


def symbols_in(text: Column, quote: str = "TRY") -> Column:
    return F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(rf"\b([A-Z0-9]{{2,12}}{quote})\b"), 1))


def bounded(text: Column, limit: int) -> Column:
    """At most `limit` characters, ended at a sentence if one ends in the latter half, else at a word."""
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    head = F.substring(t, 1, limit)
    sentence = F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_replace(head, r"\s+\S*$", "")
    return F.when(F.length(t) <= limit, t).when(F.length(sentence) >= limit // 2, sentence).otherwise(word)


def direction(value: Column) -> Column:
    """up, down or flat; null for anything else."""
    names = {"up": ("up", "long", "bullish", "buy", "yukari"), "down": ("down", "short", "bearish", "sell", "asagi"), "flat": ("flat", "neutral", "sideways", "yatay")}
    v = F.lower(F.trim(value))
    out = F.lit(None).cast("string")
    for name, words in names.items():
        out = F.when(v.isin(*words), name).otherwise(out)
    return out


def flagged(text: Column, markers: list[str]) -> Column:
    """The markers that a text holds, in any case: instructions hidden in retrieved text."""
    low = F.lower(text)
    return F.filter(F.array(*[F.lit(m.lower()) for m in markers]), lambda m: F.contains(low, m))


def content_hash(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in order of name."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))), 256)
