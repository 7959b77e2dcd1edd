"""Pair signals from rolling moments: no residual series, no per-row solver.

Log prices are centred on each pair's first observation before anything is squared, which
keeps the moment algebra accurate; slopes, residuals and the unit-root statistic do not
depend on that shift. A pair has one row per common session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantframe.functions import div


def by_pair() -> WindowSpec:
    return Window.partitionBy("pair").orderBy("session")


def pair_panel(bars: DataFrame, pairs: DataFrame) -> DataFrame:
    """Both legs' prices on the sessions they share, in one aggregate and no self-join."""
    members = pairs.select(
        "pair",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("side"), F.col("left_symbol").alias("symbol")),
                F.struct(F.lit(1).alias("side"), F.col("right_symbol").alias("symbol")),
            )
        ).alias("m"),
    ).select("pair", "m.*")
    leg = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return (
        bars.join(members, "symbol")
        .groupBy("pair", "session")
        .agg(
            leg(0, "close").alias("left_close"),
            leg(1, "close").alias("right_close"),
            leg(0, "open").alias("left_open"),
            leg(1, "open").alias("right_open"),
        )
        .filter("left_close > 0 and right_close > 0")
    )


def pair_signals(panel: DataFrame, lookback: int = 252) -> DataFrame:
    """Hedge ratio, half-sample ratios, z-score and unit-root t statistic per session.

    Everything is fitted on the ``lookback`` rows before the current one and scored on it.
    """
    half = lookback // 2
    since_start = by_pair().rowsBetween(Window.unboundedPreceding, 0)

    logs = panel.select(
        "pair",
        "session",
        (F.log("left_close") - F.first(F.log("left_close")).over(since_start)).alias("l"),
        (F.log("right_close") - F.first(F.log("right_close")).over(since_start)).alias("r"),
    ).select(
        "*",
        F.lag("l", 1, 0.0).over(by_pair()).alias("l1"),
        F.lag("r", 1, 0.0).over(by_pair()).alias("r1"),
    ).select(
        "*", (F.col("l") - F.col("l1")).alias("dl"), (F.col("r") - F.col("r1")).alias("dr")
    )
    # Cumulative sums once; every rolling moment below is a difference of two of them, so the
    # cost per row does not depend on the lookback.
    level = ["l", "r"]
    names = ["l", "r", "l1", "r1", "dl", "dr"]
    products = {
        f"{x}*{y}": F.col(x) * F.col(y) for i, x in enumerate(names) for y in names[i:]
    }
    sums = {**{x: F.col(x) for x in names}, **products}
    running = logs.select(
        "pair",
        "session",
        *level,
        F.row_number().over(by_pair()).alias("__n"),
        *[F.sum(expr).over(since_start).alias(f"S[{k}]") for k, expr in sums.items()],
    )

    def total(key: str, back: int, skip: int) -> Column:
        """Sum over the rows ``-back .. -skip`` relative to the current one."""
        upto = F.lag(f"`S[{key}]`", skip, 0.0).over(by_pair())
        return upto - F.lag(f"`S[{key}]`", back + 1, 0.0).over(by_pair())

    def moment(x: str, y: str, back: int, skip: int = 1) -> Column:
        """Centred sum of products over a frame, divided by its row count."""
        n = back - skip + 1
        key = f"{x}*{y}" if f"{x}*{y}" in products else f"{y}*{x}"
        return (total(key, back, skip) - total(x, back, skip) * total(y, back, skip) / n) / n

    def slope(back: int, skip: int) -> Column:
        return div(moment("l", "r", back, skip), moment("r", "r", back, skip))

    scale = lookback / (lookback - 1)
    short = lookback - 1
    fitted = running.select(
        "pair",
        "session",
        "l",
        "r",
        F.least(F.col("__n") - 1, F.lit(lookback)).alias("n"),
        slope(lookback, 1).alias("beta"),
        (total("l", lookback, 1) / lookback).alias("ml"),
        (total("r", lookback, 1) / lookback).alias("mr"),
        slope(lookback, lookback - half + 1).alias("first_beta"),
        slope(half, 1).alias("second_beta"),
        (moment("l", "l", lookback) * scale).alias("vl"),
        (moment("r", "r", lookback) * scale).alias("vr"),
        (moment("l", "r", lookback) * scale).alias("clr"),
        moment("dl", "l1", short).alias("c1"),
        moment("dl", "r1", short).alias("c2"),
        moment("dr", "l1", short).alias("c3"),
        moment("dr", "r1", short).alias("c4"),
        moment("l1", "l1", short).alias("v1"),
        moment("r1", "r1", short).alias("v2"),
        moment("l1", "r1", short).alias("v3"),
        moment("dl", "dl", short).alias("w1"),
        moment("dr", "dr", short).alias("w2"),
        moment("dl", "dr", short).alias("w3"),
    )
    c, b, m = F.col, F.col("beta"), lookback - 1
    full = F.col("n") == lookback
    spread = F.sqrt(F.greatest(c("vl") - 2 * b * c("clr") + b * b * c("vr"), F.lit(0.0)))
    residual = c("l") - c("ml") - b * (c("r") - c("mr"))
    sxy = c("c1") - b * c("c2") - b * c("c3") + b * b * c("c4")
    sxx = c("v1") - 2 * b * c("v3") + b * b * c("v2")
    syy = c("w1") - 2 * b * c("w3") + b * b * c("w2")
    error = F.sqrt(F.greatest((syy - div(sxy * sxy, sxx)) / (m - 2), F.lit(0.0)) / F.nullif(sxx, F.lit(0.0)))
    return fitted.select(
        "pair",
        "session",
        "n",
        F.when(full, b).alias("beta"),
        F.when(full, c("ml") - b * c("mr")).alias("intercept"),
        F.when(full, c("first_beta")).alias("first_beta"),
        F.when(full, c("second_beta")).alias("second_beta"),
        F.when(full, F.coalesce(div(residual, spread), F.lit(0.0))).alias("zscore"),
        F.when(full, div(div(sxy, sxx), error)).alias("adf_t"),
    )


def eligibility(
    signals: DataFrame, *, max_change: float = 0.25, stationarity_t: float = -3.34
) -> DataFrame:
    """Why a pair may not be entered on a session, or ``eligible``."""
    c = F.col
    change = div(
        F.abs(c("second_beta") - c("first_beta")),
        F.greatest(F.abs(c("first_beta")), F.abs(c("second_beta"))),
    )
    reason = (
        F.when(c("beta").isNull(), "insufficient history")
        .when(F.least("beta", "first_beta", "second_beta") <= 0, "non-positive hedge ratio")
        .when(change > max_change, "unstable hedge ratio")
        .when(c("adf_t").isNull() | (c("adf_t") > stationarity_t), "residual is not stationary")
        .otherwise("eligible")
    )
    return signals.withColumn("reason", reason).withColumn("eligible", c("reason") == "eligible")


def entry_weights(judged: DataFrame, *, entry_z: float = 2.0, pair_gross: float = 0.20) -> DataFrame:
    """Beta-hedged legs against the spread, for eligible pairs stretched past ``entry_z``."""
    side = -F.signum("zscore")
    left = pair_gross / (1 + F.col("beta"))
    six = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    return judged.filter(F.col("eligible") & (F.abs("zscore") >= entry_z)).select(
        "pair",
        "session",
        "zscore",
        six(side * left).alias("left_weight"),
        six(-side * (pair_gross - left)).alias("right_weight"),
    )


def exit_reason(
    eligible: Column,
    zscore: Column,
    held: Column,
    *,
    exit_z: float = 0.5,
    stop_z: float = 4.0,
    max_held: int = 42,
) -> Column:
    """Why an open pair should close at the next open, or null to keep holding."""
    return (
        F.when(~eligible, "invalidated")
        .when(F.abs(zscore) <= exit_z, "converged")
        .when(F.abs(zscore) >= stop_z, "stop")
        .when(held >= max_held, "timeout")
    )


def exit_signals(judged: DataFrame, *, entry_z: float = 2.0) -> DataFrame:
    """Exit reason on each session, counting sessions since the latest entry signal."""
    numbered = judged.withColumn("__n", F.row_number().over(by_pair()))
    entered = F.when(F.col("eligible") & (F.abs("zscore") >= entry_z), F.col("__n"))
    before = by_pair().rowsBetween(Window.unboundedPreceding, -1)
    return (
        numbered.withColumn("__e", entered)
        .withColumn("held", F.col("__n") - F.last("__e", ignorenulls=True).over(before))
        .filter("held is not null")
        .select(
            "pair",
            "session",
            "held",
            exit_reason(F.col("eligible"), F.col("zscore"), F.col("held")).alias("exit_reason"),
        )
    )
