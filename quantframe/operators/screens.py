"""Significance, factor diagnostics, liquidity screens and gate tables."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, literal_grid
from quantframe.functions.normal import normal_cdf, normal_ppf

ROOT = 252**0.5
EULER_GAMMA = 0.5772156649015329


def moments(returns: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per-session Sharpe, skew and raw kurtosis standardised by the sample deviation."""
    n = F.count("ret").cast("double")
    shrink = (n - 1) / n
    return returns.groupBy(*keys).agg(
        F.count("ret").alias("observations"),
        div(F.avg("ret"), F.stddev_samp("ret")).alias("per_session"),
        (F.skewness("ret") * F.pow(shrink, 1.5)).alias("skew"),
        ((F.kurtosis("ret") + 3) * shrink * shrink).alias("kurtosis"),
    )


def deflated_sharpe(
    shape: DataFrame, trials: Sequence[int], spread: Column | None = None
) -> DataFrame:
    """Probability that a Sharpe ratio beats the best of ``trials`` skill-free ones.

    ``shape`` comes from ``moments``. ``spread`` is the deviation of per-session Sharpe across
    trials; half the observed ratio stands in when it is not given.
    """
    if any(t < 1 for t in trials):
        raise ValueError(f"trial counts start at 1, got {min(trials)}")
    rows = (
        literal_grid(shape, [{"trials": int(t)} for t in trials], "trials int")
        .filter("observations >= 3")
        .withColumn("__p", 1 - 1 / F.col("trials").cast("double"))
        .withColumn("__q", 1 - 1 / (F.col("trials").cast("double") * math.e))
    )
    width = spread if spread is not None else F.col("per_session") / 2
    best = width * (
        (1 - EULER_GAMMA) * normal_ppf("__p") + EULER_GAMMA * normal_ppf("__q")
    )
    s = F.col("per_session")
    variance = 1 - F.col("skew") * s + (F.col("kurtosis") - 1) / 4 * s * s
    return (
        rows.withColumn("expected_maximum", best)
        .withColumn("__var", variance)
        .withColumn(
            "__z",
            F.when(
                F.col("__var") > 0,
                (s - F.col("expected_maximum"))
                * F.sqrt(F.col("observations") - 1)
                / F.sqrt(F.nullif(F.greatest("__var", F.lit(0.0)), F.lit(0.0))),
            ),
        )
        .withColumn("probability", normal_cdf("__z"))
        .withColumn("observed", s * ROOT)
        .withColumn("expected_maximum", F.col("expected_maximum") * ROOT)
        .drop("__var", "__z", "__p", "__q")
    )


def sharpe_spread(metrics: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Deviation of per-session Sharpe across trials; zero with fewer than two."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"),
        F.coalesce(F.stddev_samp(F.col("sharpe") / ROOT), F.lit(0.0)).alias("spread"),
    )


def timing_luck(metrics: DataFrame, offset: str, keys: Sequence[str] = ()) -> DataFrame:
    """How much of a result is the rebalance date: range, mean and deviation over offsets."""
    return metrics.groupBy(*keys).agg(
        (F.max("cagr") - F.min("cagr")).alias("cagr_range"),
        (F.max("sharpe") - F.min("sharpe")).alias("sharpe_range"),
        F.avg("cagr").alias("mean_cagr"),
        F.stddev_pop("cagr").alias("cagr_stdev"),
        F.max_by(offset, "cagr").alias("luckiest"),
        F.min_by(offset, "cagr").alias("unluckiest"),
    )


def gate_checks(
    metrics: DataFrame, keys: Sequence[str], criteria: Sequence[Mapping[str, object]]
) -> DataFrame:
    """Named criteria against a metrics table: one row per check.

    Each criterion is ``{"check", "metric", "op", "limit"}`` with op ``ge`` or ``le``.
    """
    names = sorted({str(c["metric"]) for c in criteria})
    long = metrics.select(*keys, *[F.col(m).cast("double") for m in names]).unpivot(
        list(keys), names, "metric", "value"
    )
    rules = literal_grid(
        long,
        [
            {"check": c["check"], "on": c["metric"], "op": c["op"], "limit": float(c["limit"])}
            for c in criteria
        ],
        "check string, on string, op string, limit double",
    ).filter(F.col("metric") == F.col("on"))
    met = F.when(F.col("op") == "ge", F.col("value") >= F.col("limit")).otherwise(
        F.col("value") <= F.col("limit")
    )
    return rules.select(
        *keys, "check", "value", "limit", F.coalesce(met, F.lit(False)).alias("passed")
    )


def gate_summary(checks: DataFrame, keys: Sequence[str]) -> DataFrame:
    return checks.groupBy(*keys).agg(
        F.bool_and("passed").alias("accepted"),
        F.sum((~F.col("passed")).cast("int")).alias("failed"),
    )


def liquidity_screen(bars: DataFrame, recent: int = 20) -> DataFrame:
    """Observations, median of the newest volumes and share of untraded sessions."""
    w = Window.partitionBy("symbol").orderBy(F.col("session").desc())
    ranked = bars.withColumn("__r", F.row_number().over(w))
    return ranked.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("observations"),
        F.min("session").alias("first_session"),
        F.max("session").alias("last_session"),
        F.median(F.when(F.col("__r") <= recent, F.col("volume"))).alias("median_volume"),
        F.avg((F.col("volume") == 0).cast("double")).alias("zero_fraction"),
    )


def held_out(curves: DataFrame, boundary: str, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Each curve twice: up to the boundary and from it on. The boundary day is in both."""
    b = F.lit(boundary).cast("date")
    tags = F.array_compact(
        F.array(
            F.when(F.col("session") <= b, "train"),
            F.when(F.col("session") >= b, "test"),
        )
    )
    return curves.select(*keys, "session", "nav", F.explode(tags).alias("window"))


def held_out_gap(metrics: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Test Sharpe minus train Sharpe."""
    side = lambda w: F.max(F.when(F.col("window") == w, F.col("sharpe")))
    return metrics.groupBy(*keys).agg(
        side("train").alias("train"), side("test").alias("test"), (side("test") - side("train")).alias("gap")
    )


# ---------------------------------------------------------------- paired and factor tables


def pair_curves(
    excess: DataFrame, core: str, key: str = "portfolio"
) -> DataFrame:
    """Every other curve beside the core curve on shared sessions."""
    a = excess.filter(F.col(key) == core).select(
        "session", F.col("ret").alias("ret_a"), F.col("excess").alias("ex_a")
    )
    b = excess.filter(F.col(key) != core).select(
        key, "session", F.col("ret").alias("ret_b"), F.col("excess").alias("ex_b")
    )
    return b.join(a, "session")


def paired_diagnostics(paired: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Sharpe improvement in full and per half, correlation, and the core's worst decile."""
    w = Window.partitionBy(*keys).orderBy("session")
    whole = Window.partitionBy(*keys)
    rows = (
        paired.withColumn("__i", F.row_number().over(w))
        .withColumn("__n", F.count(F.lit(1)).over(whole))
        .withColumn("__q", F.percentile("ex_a", 0.1).over(whole))
    )
    # Both halves share the middle NAV, so returns split after row n div 2.
    early = F.col("__i") <= F.floor(F.col("__n") / 2)

    def gain(rows_in: Column) -> Column:
        keep = lambda c: F.when(rows_in, F.col(c))
        ratio = lambda s: div(F.avg(keep(f"ex_{s}")), F.stddev_samp(keep(f"ret_{s}"))) * ROOT
        return ratio("b") - ratio("a")

    tail = F.col("ex_a") <= F.col("__q")
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("sessions"),
        gain(F.lit(True)).alias("improvement"),
        gain(early).alias("first_half"),
        gain(~early).alias("second_half"),
        F.corr("ex_a", "ex_b").alias("correlation"),
        F.sum(tail.cast("int")).alias("tail_sessions"),
        F.avg(F.when(tail, F.col("ex_a"))).alias("core_tail_mean"),
        F.avg(F.when(tail, F.col("ex_b"))).alias("candidate_tail_mean"),
    )


def factor_rows(panel: DataFrame, names: Sequence[str]) -> DataFrame:
    """The wide factor panel with the studied factors stacked beside core and market."""
    return panel.unpivot(["month", "core_excess", "market"], list(names), "factor", "ret")


def factor_diagnostics(rows: DataFrame) -> DataFrame:
    """Beta, premium, co-movement, half-sample stability and tail behaviour per factor.

    The correlation of residuals on the market is the partial correlation, in closed form.
    """
    w = Window.partitionBy("factor").orderBy("month")
    whole = Window.partitionBy("factor")
    ready = rows.withColumn("__h", F.ntile(2).over(w)).withColumn(
        "__q", F.percentile("core_excess", 0.1).over(whole)
    )
    half = lambda k, c: F.when(F.col("__h") == k, F.col(c))
    tail = F.col("core_excess") <= F.col("__q")
    g = ready.groupBy("factor").agg(
        F.count(F.lit(1)).alias("months"),
        div(F.covar_samp("ret", "market"), F.var_samp("market")).alias("market_beta"),
        F.avg("ret").alias("mean_monthly"),
        (div(F.avg("ret"), F.stddev_samp("ret")) * 12**0.5).alias("mean_over_vol"),
        (F.stddev_samp("ret") * 12**0.5).alias("annual_vol"),
        F.corr("core_excess", "ret").alias("core_correlation"),
        F.covar_samp("core_excess", "ret").alias("monthly_covariance"),
        F.corr(half(1, "core_excess"), half(1, "ret")).alias("first_half_correlation"),
        F.corr(half(2, "core_excess"), half(2, "ret")).alias("second_half_correlation"),
        F.avg(half(1, "ret")).alias("first_half_mean"),
        F.avg(half(2, "ret")).alias("second_half_mean"),
        F.corr("core_excess", "market").alias("__cm"),
        F.corr("ret", "market").alias("__fm"),
        F.sum(tail.cast("int")).alias("tail_months"),
        F.avg(F.when(tail, F.col("ret"))).alias("tail_mean"),
        F.avg(F.when(tail, (F.col("ret") < 0).cast("double"))).alias("tail_negative_share"),
    )
    partial = div(
        F.col("core_correlation") - F.col("__cm") * F.col("__fm"),
        F.sqrt((1 - F.col("__cm") ** 2) * (1 - F.col("__fm") ** 2)),
    )
    return g.withColumn("residual_correlation", partial).drop("__cm", "__fm")


def crisis_windows(rows: DataFrame, windows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Months, factor mean and joint losses inside named date windows."""
    import datetime as dt

    day = dt.date.fromisoformat
    grid = literal_grid(
        rows,
        [{"window": n, "a": day(a), "z": day(z)} for n, a, z in windows],
        "window string, a date, z date",
    ).filter("month between a and z")
    both = (F.col("core_excess") < 0) & (F.col("ret") < 0)
    return grid.groupBy("factor", "window").agg(
        F.count(F.lit(1)).alias("months"),
        F.avg("ret").alias("factor_mean"),
        F.sum(both.cast("int")).alias("both_negative"),
    )
