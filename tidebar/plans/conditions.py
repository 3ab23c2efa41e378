"""The declarative strategy language: lists of {indicator, op, value} as boolean columns."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import before, last
from ..functions.patterns import volume_profile
from ..operators.sequences import divergences

# The comparisons and their other names, as definitions write them.
OPS = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: F.abs(a - b) < 1e-9}
ALIASES = {"lt": "<", "lte": "<=", "less_than": "<", "less_than_or_equal": "<=", "gt": ">", "gte": ">=", "greater_than": ">", "greater_than_or_equal": ">=", "eq": "==", "equal": "==", "equals": "=="}
MOST = 8
#: An exit mode, whether exit conditions count in it, and whether stop and target do unless said otherwise.
MODES = {"conditions_only": (True, False), "conditions_plus_protection": (True, True), "protection_only": (False, True)}


def _over(a: str) -> Column:
    return F.when(F.col(a) != 0, F.col("close") / F.col(a) - 1)


def _flag(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit(False)), 1.0).otherwise(0.0)


#: Names a condition may use (fixed values), over a frame from strategies.features().
INDICATORS: dict[str, Column] = {}


def indicators() -> dict[str, Column]:
    if not INDICATORS:
        plain = ("open", "high", "low", "close", "ema_9", "ema_21", "ema_50", "atr_pct", "volume_ratio", "return_21", "chop", "crsi", "williams_r", "td9_up", "td9_down", "poc_distance")
        INDICATORS.update({n: F.col(n).cast("double") for n in plain})
        INDICATORS.update({
            "rsi": F.col("rsi_wilder"), "rsi_14": F.col("rsi_wilder"), "macd_hist": F.col("macd_hist"), "macd_histogram": F.col("macd_hist"), "adx": F.col("dx"), "volume_ratio_20": F.col("volume_ratio"), "orderflow_imbalance": F.col("flow_proxy"),
            "vwap": F.col("vwap_20"), "price_vs_vwap": _over("vwap_20"), "vwap_distance_pct": _over("vwap_20") * 100, "vwap_zone": F.when(_over("vwap_20") > 0.002, 1.0).when(_over("vwap_20") < -0.002, -1.0).when(F.col("vwap_20").isNotNull(), 0.0),
            "price_vs_ema_9": _over("ema_9"), "price_vs_ema_21": _over("ema_21"), "price_vs_ema_50": _over("ema_50"), "return_5": F.col("return_5"), "stochastic_k": F.col("stoch_k"), "bollinger_position": F.col("bb_position"), "mfi": F.col("mfi_14"), "cci": F.col("cci_20"), "cmo": F.col("cmo_9"),
            "confluence_score": F.col("confluence"), "turtle_breakout": F.when(F.col("turtle") == "up_20", 1.0).when(F.col("turtle") == "down_20", -1.0).when(F.col("turtle").isNotNull(), 0.0), "fib_distance_support": F.when(F.col("close") != 0, (F.col("close") - F.col("fib_618")) / F.col("close")), "fib_distance_resistance": F.when(F.col("close") != 0, (F.col("fib_236") - F.col("close")) / F.col("close")),
            "td9_up_count": F.col("td9_up").cast("double"), "td9_down_count": F.col("td9_down").cast("double"), "td9_up_exhaustion": _flag(F.col("td9_up") >= 9), "td9_down_exhaustion": _flag(F.col("td9_down") >= 9), "bos_bullish": _flag(F.col("bos") == "bullish"), "bos_bearish": _flag(F.col("bos") == "bearish"),
            "structure_volume_confirmed": _flag(F.col("structure_volume_confirmed")), "fvg_bullish": _flag(F.col("fvg_side") == "bullish"), "fvg_bearish": _flag(F.col("fvg_side") == "bearish"), "wick_bullish_rejection": _flag(F.col("wick_signal") == "bullish_rejection"), "wick_bearish_rejection": _flag(F.col("wick_signal") == "bearish_rejection"),
            "volume_profile_poc_distance": F.col("poc_distance"), "atr_trailing_stop": F.col("atr_stop"), "atr_trailing_stop_pct": F.when(F.col("close") != 0, (F.col("close") - F.col("atr_stop")) / F.col("close")), "data_ready": _flag(F.col("bar") >= 55), "stale": F.lit(0.0), "spread_pct": F.lit(0.0), "liquidity_fresh": F.lit(0.0),
        })
        INDICATORS.update({n: F.col(n).cast("double") for n in (*SCORES, *PROFILE, *DIVERGENCES)})
    return INDICATORS


#: Names whose columns a frame of strategies.features() lacks: with_needed() adds those that rules name.
DIVERGENCES = tuple(f"{n}_{kind}_divergence" for n in ("rsi", "macd") for kind in ("bullish", "bearish"))
PROFILE = ("vp_poc_distance", "vp_inside_value_area")
SCORES = ("regime_confidence", "mtf_alignment_score", "turtle_breakout_confirmed", "wyckoff_score", "elliott_score")


def _scores() -> dict[str, Column]:
    """Over a features() frame; the methods' scores are 0 before bar 55."""
    known = lambda c: F.when(F.col("bar") >= 55, c).otherwise(0.0)
    strength, ratio = F.coalesce("dx", F.lit(0.0)), F.coalesce("volume_ratio", F.lit(0.0))
    e9, e21, e50 = (F.col(f"ema_{n}_r") for n in (9, 21, 50))
    ups = F.sum(F.when(F.col("change") > 0, 1).otherwise(0)).over(last(8))
    # A high or low that doesn't exist yet breaks nothing.
    high, low = F.max("high").over(before(20)), F.min("low").over(before(20))
    return {
        "regime_confidence": known(F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.35), 0.45 + F.least(strength, F.lit(50.0)) / 100 + F.when(ratio > 1.2, 0.1).otherwise(0.0))), 3)),
        "mtf_alignment_score": F.when((e9 > e21) & (e21 > e50), 1.0).when((e9 < e21) & (e21 < e50), -1.0).otherwise(0.0),
        "turtle_breakout_confirmed": F.when(F.col("bar") > 20, F.when(F.col("close") > high, 1.0).when(F.col("close") < low, -1.0)).otherwise(0.0),
        "wyckoff_score": known(F.when(F.col("wyckoff_event").isin("spring_candidate", "sign_of_strength_candidate"), 0.75).when(F.col("wyckoff_event").isin("upthrust_candidate", "sign_of_weakness_candidate"), 0.25).otherwise(0.5)),
        "elliott_score": known(F.round(F.least(F.lit(0.7), 0.35 + F.abs(2 * ups - 8) * 0.05), 3)),
    }


def with_needed(features: DataFrame, *rules: list | None) -> DataFrame:
    """A features() frame with the columns that the rules name and it doesn't have yet."""
    named = {parsed(rule)[0] for own in rules for rule in own or []}
    out = features.withColumns({n: F.coalesce(c, F.lit(0.0)) for n, c in _scores().items() if n in named})
    if named & set(PROFILE):
        out = out.withColumn("_vp", volume_profile())
        inside = (F.col("close") >= F.col("_vp.low")) & (F.col("close") <= F.col("_vp.high"))
        out = out.withColumns({"vp_poc_distance": F.when(F.col("_vp.poc") != 0, F.col("close") / F.col("_vp.poc") - 1), "vp_inside_value_area": F.when(F.col("_vp").isNotNull(), inside.cast("double"))}).drop("_vp")
    return divergences(out, {"rsi": "rsi_wilder", "macd": "macd_hist"}) if named & set(DIVERGENCES) else out


def number(x) -> float | None:
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def parsed(rule) -> tuple[str, str, float | None]:
    """The indicator, the comparison and the number of a rule, as they are meant; of what isn't a rule, none of them."""
    own = rule if isinstance(rule, dict) else {}
    name, op = (str(own.get(k) or "").strip().lower() for k in ("indicator", "op"))
    return name, ALIASES.get(op, op), number(own.get("value"))


def problems(rules: list) -> list[str]:
    """What keeps a list of rules from being compiled: every fault of every rule."""
    found = [f"at most {MOST} conditions"] if len(rules) > MOST else []
    for k, rule in enumerate(rules, 1):
        name, op, value = parsed(rule)
        faults = {f"indicator '{name}'": name in indicators(), f"comparison '{op}'": op in OPS, f"value {rule.get('value') if isinstance(rule, dict) else rule!r}": value is not None}
        found += [f"condition {k}: unknown {fault}" for fault, fine in faults.items() if not fine]
    return found


def raise_any(found: list[str]) -> None:
    if found:
        raise ValueError("; ".join(found))


def conditions(rules: list | None) -> Column:
    """All of the rules; an unknown value fails its rule, and no rules never hold. Raises ValueError naming all that is wrong with them."""
    rules = rules or []
    raise_any(problems(rules))
    tests = [F.coalesce(OPS[op](indicators()[name], F.lit(value)), F.lit(False)) for name, op, value in map(parsed, rules)]
    return reduce(lambda a, b: a & b, tests, F.lit(bool(tests)))


@dataclass(frozen=True)
class ExitPolicy:
    """How positions end beside the exit conditions. None: not that way."""

    signals: bool = True
    stop: float | None = 0.02
    target: float | None = 0.03
    trail: float | None = None
    max_hold: int | None = None

    #: What each limit has to be.
    LIMITS: ClassVar = {"trail": (lambda x: 0 < x < 1, "trailing_stop_pct must lie between 0 and 1"), "max_hold": (lambda x: x >= 1, "max_hold_bars must be positive")}

    @classmethod
    def read(cls, written: dict) -> ExitPolicy:
        mode = str(written.get("mode", "conditions_plus_protection")).lower()
        raise_any([] if mode in MODES else [f"unknown exit_policy.mode '{mode}'"])
        signals, guarded = MODES[mode]
        out = cls(
            signals, cls.stop if written.get("use_stop_loss", guarded) else None, cls.target if written.get("use_take_profit", guarded) else None,
            number(written.get("trailing_stop_pct")) or 0.0 if written.get("use_trailing_stop") else None, int(number(written.get("max_hold_bars")) or 0) if written.get("use_max_hold") else None,
        )
        raise_any([said for name, (fits, said) in cls.LIMITS.items() if getattr(out, name) is not None and not fits(getattr(out, name))])
        return out


def strategy(definition: dict) -> tuple[Column, Column, dict]:
    """(entry, exit, replay settings) of a definition with entry, exit and exit_policy."""
    policy = ExitPolicy.read(definition.get("exit_policy") or {})
    leave = conditions(definition.get("exit") if policy.signals else [])
    return conditions(definition.get("entry")), leave, {k: v for k, v in asdict(policy).items() if k != "signals"}
