"""Return, rank, trend and beta signals.

Every function takes a ``bars`` frame with one row per symbol and session and reads only
frames that end at the current row, so no signal can see its own future. Signals of one
family share a partition and an order, hence one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantframe.functions import div

SESSIONS_PER_MONTH = 21
SESSIONS_PER_YEAR = 252


def by_symbol() -> WindowSpec:
    """One symbol in session order: at most one row per calendar day."""
    return Window.partitionBy("symbol").orderBy("session")


def trailing(n: int, skip: int = 0):
    """Frame over the last ``n`` rows, ending ``skip`` rows before the current one."""
    return by_symbol().rowsBetween(-(n + skip - 1), -skip)


def simple_returns(bars: DataFrame) -> DataFrame:
    """Close over previous close; the first row and non-positive bases produce nothing."""
    prev = F.lag("close").over(by_symbol())
    return (
        bars.select("symbol", "session", "close", prev.alias("__prev"))
        .filter("__prev > 0")
        .select("symbol", "session", (F.col("close") / F.col("__prev") - 1).alias("ret"))
    )


def log_returns(bars: DataFrame) -> DataFrame:
    return (
        bars.filter("close > 0")
        .select("symbol", "session", F.log("close").alias("__l"))
        .select(
            "symbol", "session", (F.col("__l") - F.lag("__l").over(by_symbol())).alias("ret")
        )
        .filter("ret is not null")
    )


def momentum_column(months: int, skip: int = 1) -> Column:
    end = F.lag("close", SESSIONS_PER_MONTH * skip).over(by_symbol()) if skip else F.col("close")
    start = F.lag("close", SESSIONS_PER_MONTH * (skip + months)).over(by_symbol())
    return F.when(start > 0, end / start - 1)


def momentum(bars: DataFrame, months: Sequence[int] = (3, 6, 12), skip: int = 1) -> DataFrame:
    """Stacked momentum, one row per symbol, session and lookback; null when unmeasurable."""
    wide = bars.select(
        "symbol", "session", *[momentum_column(m, skip).alias(f"m{m}") for m in months]
    )
    pairs = ", ".join(f"{m}, m{m}" for m in months)
    return wide.selectExpr("symbol", "session", f"stack({len(months)}, {pairs}) as (months, mom)")


def average_rank(df: DataFrame, group: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """Ascending rank in which ties share the mean of the places they span.

    Nulls rank lowest: what cannot be measured cannot be preferred.
    """
    ordered = Window.partitionBy(*group).orderBy(F.col(value).asc_nulls_first())
    ties = Window.partitionBy(*group, value)
    return df.withColumn(name, F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def blended_score(ranked: DataFrame) -> DataFrame:
    """Mean rank over lookbacks; sessions with fewer than two symbols have no score."""
    size = Window.partitionBy("session")
    return (
        ranked.groupBy("session", "symbol")
        .agg(F.avg("rank").alias("score"))
        .withColumn("__n", F.count(F.lit(1)).over(size))
        .filter("__n >= 2")
        .drop("__n")
    )


def top_n(df: DataFrame, n: int, group: Sequence[str], value: str = "score") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(F.col(value).desc(), "symbol")
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def trend_filter(bars: DataFrame, window: int = 200) -> DataFrame:
    frame = trailing(window)
    return bars.select(
        "symbol",
        "session",
        "close",
        F.when(F.count("close").over(frame) == window, F.avg("close").over(frame)).alias("sma"),
    ).select("symbol", "session", "sma", (F.col("close") > F.col("sma")).alias("uptrend"))


def required_sessions(
    lookbacks: Sequence[int] = (3, 6, 12), skip: int = 1, trend: int = 200, vol: int = 60
) -> int:
    """History needed before a momentum decision exists."""
    return max((max(lookbacks) + skip) * SESSIONS_PER_MONTH + 1, trend, vol + 1)


def warmup_gate(bars: DataFrame, need: int) -> DataFrame:
    return bars.select(
        "symbol", "session", F.row_number().over(by_symbol()).alias("n")
    ).withColumn("ready", F.col("n") >= need)


def with_market(returns: DataFrame) -> DataFrame:
    """Attach the equal-weight return of all symbols trading that session."""
    market = returns.groupBy("session").agg(F.avg("ret").alias("mkt"))
    return returns.join(market, "session")


def rolling_beta(paired: DataFrame, window: int = SESSIONS_PER_YEAR) -> DataFrame:
    """Covariance over variance of the last ``window`` paired returns."""
    frame = trailing(window)
    return paired.select(
        "symbol",
        "session",
        F.when(
            F.count("ret").over(frame) == window,
            div(F.covar_samp("ret", "mkt").over(frame), F.var_samp("mkt").over(frame)),
        ).alias("beta"),
    )


def sector_score(bars: DataFrame, skip: int = 21, short: int = 126, long: int = 252) -> DataFrame:
    """Six-one plus twelve-one momentum."""
    end = F.lag("close", skip).over(by_symbol())
    six = div(end, F.lag("close", short).over(by_symbol())) - 1
    twelve = div(end, F.lag("close", long).over(by_symbol())) - 1
    return bars.select("symbol", "session", (six + twelve).alias("score"))


def beta_neutral_weights(
    scored: DataFrame,
    *,
    per_side: int = 2,
    gross: float = 1.0,
    max_weight: float = 0.35,
    long_high: bool = True,
    key: str = "session",
) -> DataFrame:
    """Long one end of the ranking, short the other, sized so the two betas cancel.

    Each side's gross is proportional to the other side's mean beta. When a weight exceeds
    the cap both sides shrink together. Dates on which any symbol lacks a positive beta, or
    with too few symbols for two disjoint sides, have no book at all.
    """
    up = Window.partitionBy(key).orderBy("score", "symbol")
    down = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("symbol").desc())
    whole = Window.partitionBy(key)
    sides = (
        scored.withColumn("__up", F.row_number().over(up))
        .withColumn("__down", F.row_number().over(down))
        .withColumn("__n", F.count(F.lit(1)).over(whole))
        .withColumn(
            "__bad",
            F.max(
                F.when((F.col("beta") > 0) & F.col("score").isNotNull(), 0).otherwise(1)
            ).over(whole),
        )
        .filter((F.col("__bad") == 0) & (F.col("__n") >= 2 * per_side))
        .withColumn(
            "__side",
            F.when(F.col("__down") <= per_side, 1 if long_high else -1).when(
                F.col("__up") <= per_side, -1 if long_high else 1
            ),
        )
        .filter("__side is not null")
    )
    long_beta = F.avg(F.when(F.col("__side") == 1, F.col("beta"))).over(whole)
    short_beta = F.avg(F.when(F.col("__side") == -1, F.col("beta"))).over(whole)
    sized = sides.select(
        key, "symbol", "__side", long_beta.alias("__lb"), short_beta.alias("__sb")
    ).select(
        key,
        "symbol",
        "__side",
        (gross * F.col("__sb") / (F.col("__lb") + F.col("__sb")) / per_side).alias("__long"),
        (gross * F.col("__lb") / (F.col("__lb") + F.col("__sb")) / per_side).alias("__short"),
    )
    shrink = F.least(F.lit(1.0), max_weight / F.greatest("__long", "__short"))
    raw = F.when(F.col("__side") == 1, F.col("__long")).otherwise(-F.col("__short")) * shrink
    return sized.select(key, "symbol", (F.floor(raw * 1e6 + 0.5) / 1e6).alias("weight"))


def residual_reversal(
    paired: DataFrame, beta_window: int = 252, vol_window: int = 20, sum_window: int = 5
) -> DataFrame:
    """Last-week residual return in units of its recent deviation, one beta per date.

    The residual under a date's own beta is never materialised: its sum and its variance
    follow from moments of the two return series over the same frame.
    """
    full, recent, week = trailing(beta_window), trailing(vol_window), trailing(sum_window)
    staged = paired.select(
        "symbol",
        "session",
        F.count("ret").over(full).alias("__n"),
        div(F.covar_samp("ret", "mkt").over(full), F.var_samp("mkt").over(full)).alias("beta"),
        F.var_samp("ret").over(recent).alias("__vr"),
        F.var_samp("mkt").over(recent).alias("__vm"),
        F.covar_samp("ret", "mkt").over(recent).alias("__c"),
        F.sum("ret").over(week).alias("__sr"),
        F.sum("mkt").over(week).alias("__sm"),
    ).filter(F.col("__n") == beta_window)
    b = F.col("beta")
    variance = F.col("__vr") - 2 * b * F.col("__c") + b * b * F.col("__vm")
    return staged.select(
        "symbol",
        "session",
        "beta",
        div(F.col("__sr") - b * F.col("__sm"), F.sqrt(F.greatest(variance, F.lit(0.0)))).alias(
            "score"
        ),
    )


def regime(returns: DataFrame, window: int = 20) -> DataFrame:
    """Annualised realised volatility of the market return, in percent.

    The market is one series with one row per session, so its window is calendar-sized.
    """
    market = returns.groupBy("session").agg(F.avg("ret").alias("mkt"))
    w = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(-(window - 1), 0)
    return market.select(
        "session",
        F.when(
            F.count("mkt").over(w) == window,
            F.stddev_samp("mkt").over(w) * (SESSIONS_PER_YEAR**0.5) * 100,
        ).alias("level"),
    )


def reversal_weights(
    scored: DataFrame, regime_level: DataFrame, *, symbols: int, threshold: float = 25.0
) -> DataFrame:
    """Two losers long, two winners short, only in a stressed regime with every symbol."""
    size = Window.partitionBy("session")
    gated = (
        scored.join(regime_level.filter(F.col("level") >= threshold), "session")
        .withColumn("__k", F.count(F.lit(1)).over(size))
        .filter(F.col("__k") == symbols)
    )
    return beta_neutral_weights(
        gated, per_side=2, gross=1.0, max_weight=0.35, long_high=False
    )


def annualised_unit_risk(
    bars: DataFrame, multiplier: float, *, window: int = 63, yield_contract: bool = False
) -> DataFrame:
    """Annualised currency volatility of one contract."""
    prev = F.lag("close").over(by_symbol())
    move = F.col("close") - prev if yield_contract else div("close", prev) - 1
    scale = F.lit(100.0 * multiplier) if yield_contract else F.col("close") * multiplier
    frame = trailing(window)
    return (
        bars.select("symbol", "session", "close", move.alias("__m"))
        .select(
            "symbol",
            "session",
            F.when(
                F.count("__m").over(frame) == window,
                F.stddev_samp("__m").over(frame) * (SESSIONS_PER_YEAR**0.5) * scale,
            ).alias("dollar_vol"),
        )
        .filter("dollar_vol is not null")
    )
