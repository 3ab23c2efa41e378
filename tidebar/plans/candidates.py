"""Research candidates over frames of candles: entries and exits known at a bar's close, acted on at the next bar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.indicators import before, last, prepare, ready, series, volume_ratio
from ..functions.linear import SERIES, average, ewm_rsi, run, width_of
from ..functions.recursive import recursive
from ..functions.variants import adx_frame, atr_frame, dx_frame


def frame(candles: DataFrame) -> DataFrame:
    """prepare() with what the candidates read: averages from the first close on (ewm_9, ewm_21, ewm_50), RSI of such averages, plain ATR and ADX, volume against the mean of the last 20 bars, this one included, Supertrend."""
    averages = run(candles, [*[average(f"ewm_{n}", n, "first") for n in (9, 21, 50)], ewm_rsi()], ["close"], width=width_of())
    df = prepare(candles).join(averages, [*SERIES, "open_time"]).join(recursive(candles, ["supertrend"]), [*SERIES, "open_time"])
    df = df.withColumns({"atr_f": atr_frame(), "dx_frame": dx_frame(), "ratio_f": volume_ratio(20, own=True), "mean_20": ready(20, F.avg("close").over(last(20))), "dev_20": ready(20, F.stddev_samp("close").over(last(20)))})
    return df.withColumn("adx_f", adx_frame())


def candidates() -> dict[str, tuple[Column, Column]]:
    """(entry, exit) of each candidate over a frame(), before they are moved to the next bar. What is unknown holds nothing."""
    c = F.col
    past = lambda x, k=1: F.lag(x, k).over(series())
    mean = lambda n: ready(n, F.avg("close").over(last(n)))
    rising, falling = c("close") > c("open"), c("close") < c("open")
    body, span = F.abs(c("close") - c("open")), F.nullif(c("high") - c("low"), F.lit(0.0))
    of = lambda x, k: F.coalesce(past(x, k), F.lit(False))
    small = past(body, 1) <= past(span, 1) * 0.35
    middle = (past("open", 2) + past("close", 2)) / 2
    star, dusk = of(falling, 2) & rising & small & (c("close") > middle), of(rising, 2) & falling & small & (c("close") < middle)
    row = lambda side, up: side & of(side, 1) & of(side, 2) & (c("close") > past("close") if up else c("close") < past("close")) & (past("close") > past("close", 2) if up else past("close") < past("close", 2)) & (body / span > 0.55)
    fractal = past("low", 2) == ready(5, F.min("low").over(last(5)))
    m20, m50, m100 = mean(20), mean(50), mean(100)
    leads = (m20 > m50) & (m50 > m100) & ((c("close") <= m20) | (c("close") <= m50)) & fractal & (c("close") > m100)
    never = F.lit(False)
    # The candidates' thresholds.
    return {
        "trend_regime": ((c("ewm_9") > c("ewm_21")) & (c("ewm_21") > c("ewm_50")) & (c("adx_f") >= 25) & (c("ratio_f") >= 1.1) & (c("close") > past("close") + c("atr_f") * 0.15), (c("ewm_9") < c("ewm_21")) | (c("adx_f") < 18)),
        "donchian_volume": ((c("close") > ready(21, F.max("high").over(before(20)))) & (c("ratio_f") >= 1.2) & (c("adx_f") >= 20), c("close") < ready(21, F.min("low").over(before(20)))),
        "rsi_bollinger": ((c("close") < c("mean_20") - 2 * c("dev_20")) & (c("rsi_ewm") < 35) & (c("ratio_f") > 0.5), (c("close") > c("mean_20")) | (c("rsi_ewm") > 55)),
        "ess_long": ((c("close") <= c("mean_20") - 2.1 * c("dev_20")) & (c("rsi_ewm") < 20), c("close") >= c("mean_20")),
        "strong_candlestick": ((star | row(rising, True)) & (c("ratio_f") >= 1.1) & (c("adx_f") >= 18), dusk | row(falling, False)),
        "williams_fractal_ma_long": (leads, never), "supertrend_long": ((c("supertrend") > 0) & (past("supertrend") < 0), never),
    }


#: Candidates that enter only where their condition begins to hold.
ONSETS = ("williams_fractal_ma_long",)


def signals(candles: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """(symbol, timeframe, open_time, candidate, entry, exit): what each candidate does at each bar, decided at the close before."""
    rules = {n: r for n, r in candidates().items() if names is None or n in names}
    held = lambda x: F.coalesce(x, F.lit(False))
    df = frame(candles).withColumns({f"{n}_{side}": held(x) for n, pair in rules.items() for side, x in zip(("entry", "exit"), pair)})
    df = df.withColumns({f"{n}_entry": F.col(f"{n}_entry") & ~held(F.lag(f"{n}_entry").over(series())) for n in rules if n in ONSETS})
    moved = df.withColumns({f"{n}_{side}": held(F.lag(f"{n}_{side}").over(series())) for n in rules for side in ("entry", "exit")})
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("candidate"), F.col(f"{n}_entry").alias("entry"), F.col(f"{n}_exit").alias("exit")) for n in rules]))
    return moved.select(*SERIES, "open_time", rows.alias("r")).select(*SERIES, "open_time", "r.*")
