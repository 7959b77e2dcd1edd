"""Performance statistics of many equity curves at once.

Curves are keyed by ``portfolio`` (or any key list) with one row per session, so a curve is
bounded by the calendar and all of its windows share one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, safe_div
from quantframe.operators.asof import rate_on

SESSIONS_PER_YEAR = 252
DAYS_PER_YEAR = 365.25
ROOT = SESSIONS_PER_YEAR**0.5


def _by(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("session")


def returns(nav: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Session returns; the first session has none and is absent, not zero."""
    prev = F.lag("nav").over(_by(keys))
    return nav.select(*keys, "session", "nav", (div("nav", prev) - 1).alias("ret")).filter(
        "ret is not null"
    )


def excess_returns(
    nav: DataFrame, rates: DataFrame | float, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Returns over the rate known that day, scalar or dated (carried forward only)."""
    base = returns(nav, keys)
    if isinstance(rates, DataFrame):
        rated = rate_on(base, rates, "session")
        return rated.withColumn("excess", F.col("ret") - F.col("rate") / SESSIONS_PER_YEAR)
    return base.withColumn("excess", F.col("ret") - float(rates) / SESSIONS_PER_YEAR)


def sleeve_correlation(excess: DataFrame) -> DataFrame:
    """Correlation matrix of sleeve excess returns on shared sessions.

    The matrix is the result: sleeves are a handful of strategies, not a fact table.
    """
    a = excess.select("session", F.col("portfolio").alias("sleeve_a"), F.col("excess").alias("xa"))
    b = excess.select("session", F.col("portfolio").alias("sleeve_b"), F.col("excess").alias("xb"))
    return (
        a.join(b, "session")
        .filter("sleeve_a <= sleeve_b")
        .groupBy("sleeve_a", "sleeve_b")
        .agg(F.corr("xa", "xb").alias("correlation"), F.count(F.lit(1)).alias("sessions"))
    )


# ---------------------------------------------------------------- curve columns


def enriched(nav: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Everything per session that the statistics need, from one sort per curve.

    Adds ``ret``, ``peak`` (running high), ``dd``, ``at_peak``, ``peak_before`` (latest
    earlier high-water date), ``month_end`` and ``month_ret``. The first month is measured
    from the opening NAV.
    """
    w = _by(keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    nxt = F.lead("session").over(w)
    staged = nav.select(
        *keys,
        "session",
        "nav",
        (div("nav", F.lag("nav").over(w)) - 1).alias("ret"),
        F.max("nav").over(upto).alias("peak"),
        F.first("nav").over(upto).alias("opening"),
        (nxt.isNull() | (F.trunc(nxt, "MM") != F.trunc("session", "MM"))).alias("month_end"),
    ).withColumn("at_peak", F.col("nav") >= F.col("peak"))
    month_base = F.coalesce(
        F.last(F.when(F.col("month_end"), F.col("nav")), ignorenulls=True).over(earlier),
        F.col("opening"),
    )
    return staged.select(
        "*",
        (F.col("nav") / F.col("peak") - 1).alias("dd"),
        F.last(F.when(F.col("at_peak"), F.col("session")), ignorenulls=True)
        .over(earlier)
        .alias("peak_before"),
        F.lag("at_peak").over(w).alias("was_at_peak"),
        F.when(F.col("month_end"), div("nav", month_base) - 1).alias("month_ret"),
    )


def _years() -> Column:
    return F.datediff(F.max("session"), F.min("session")) / DAYS_PER_YEAR


def performance(
    nav: DataFrame, rates: DataFrame | float = 0.0, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """The whole statistics table: one window pass and one aggregate per curve.

    Sharpe divides the mean excess return by the deviation of total returns; Sortino divides
    by all observations, not only the losses. Curves with fewer than two rows are left out.
    """
    rows = enriched(nav, keys)
    if isinstance(rates, DataFrame):
        rows = rate_on(rows, rates, "session")
        excess = F.col("ret") - F.col("rate") / SESSIONS_PER_YEAR
    else:
        excess = F.col("ret") - float(rates) / SESSIONS_PER_YEAR
    rows = rows.withColumn("ex", excess)
    first, last = F.min_by("nav", "session"), F.max_by("nav", "session")
    under = (~F.col("at_peak")) | (~F.coalesce("was_at_peak", F.lit(True)))
    base = rows.groupBy(*keys).agg(
        F.min("session").alias("start"),
        F.max("session").alias("end"),
        F.count(F.lit(1)).alias("sessions"),
        _years().alias("years"),
        first.alias("initial_nav"),
        last.alias("final_nav"),
        F.avg("ret").alias("__mean"),
        F.stddev_samp("ret").alias("__sd"),
        F.avg("ex").alias("__xmean"),
        F.sqrt(F.sum(F.least(F.col("ex"), F.lit(0.0)) ** 2) / F.count("ex")).alias("__down"),
        F.min("dd").alias("max_drawdown"),
        F.avg((F.col("dd") < 0).cast("double")).alias("time_underwater"),
        F.coalesce(
            F.max(F.when(under, F.datediff("session", "peak_before"))), F.lit(0)
        ).alias("longest_drawdown_days"),
        F.max("month_ret").alias("best_month"),
        F.min("month_ret").alias("worst_month"),
        F.avg(F.when(F.col("month_ret").isNotNull(), (F.col("month_ret") > 0).cast("double"))).alias(
            "positive_months"
        ),
        F.max("ret").alias("best_day"),
        F.min("ret").alias("worst_day"),
    ).filter("sessions >= 2")
    growth = F.col("final_nav") / F.col("initial_nav")
    cagr = F.when(
        (F.col("years") > 0) & (growth > 0), F.pow(growth, 1 / F.nullif("years", F.lit(0.0))) - 1
    ).otherwise(0.0)
    return (
        base.withColumn("total_return", growth - 1)
        .withColumn("cagr", cagr)
        .withColumn("volatility", F.col("__sd") * ROOT)
        .withColumn("raw_sharpe", F.coalesce(div("__mean", "__sd") * ROOT, F.lit(0.0)))
        .withColumn("sharpe", F.coalesce(div("__xmean", "__sd") * ROOT, F.lit(0.0)))
        .withColumn("sortino", F.coalesce(div("__xmean", "__down") * ROOT, F.lit(0.0)))
        .withColumn("calmar", F.coalesce(div("cagr", F.abs("max_drawdown")), F.lit(0.0)))
        .drop("__mean", "__sd", "__xmean", "__down")
    )


def by_calendar_year(
    nav: DataFrame, rates: DataFrame | float = 0.0, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """The same table per calendar year; years with one row are left out."""
    return performance(nav.withColumn("year", F.year("session")), rates, [*keys, "year"])


def drawdown_episodes(
    nav: DataFrame, limit: int | None = 5, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Peak-to-recovery episodes: islands between successive running highs.

    The peak is the latest of equal highs, the trough the first minimum. An episode still
    open at the end has no recovery and is measured to the last session.
    """
    island = Window.partitionBy(*keys).orderBy("session").rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = enriched(nav, keys).withColumn(
        "__g", F.sum(F.col("at_peak").cast("int")).over(island)
    )
    grouped = rows.groupBy(*keys, "__g").agg(
        F.min("session").alias("peak"),
        F.max("session").alias("__last"),
        F.max("nav").alias("__high"),
        F.min("nav").alias("__low"),
        F.min_by("session", F.struct("nav", "session")).alias("trough"),
        F.count(F.lit(1)).alias("__n"),
    )
    w = Window.partitionBy(*keys).orderBy("peak")
    episodes = (
        grouped.withColumn("recovery", F.lead("peak").over(w))
        .filter("__n > 1")
        .withColumn("__end", F.coalesce("recovery", "__last"))
        .select(
            *keys,
            "peak",
            "trough",
            "recovery",
            (F.col("__low") / F.col("__high") - 1).alias("depth"),
            F.datediff("trough", "peak").alias("days_to_trough"),
            F.datediff("__end", "trough").alias("recovery_days"),
            F.datediff("__end", "peak").alias("total_days"),
            F.col("recovery").isNull().alias("open"),
        )
    )
    if limit is None:
        return episodes
    deepest = Window.partitionBy(*keys).orderBy("depth", "peak")
    return (
        episodes.withColumn("place", F.row_number().over(deepest))
        .filter(F.col("place") <= limit)
    )


def monthly_returns(nav: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    return enriched(nav, keys).filter("month_end").select(
        *keys, F.trunc("session", "MM").alias("month"), F.col("month_ret").alias("ret")
    )


def strict_monthly_returns(
    nav: DataFrame, start: str, end: str, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Month-end ratios that insist on every month and on the month before the first.

    Every month of the span appears; ``ok`` is false where the month or its predecessor has
    no NAV, so a gap is a violation instead of a silently longer return.
    """
    ends = nav.groupBy(*keys, F.trunc("session", "MM").alias("month")).agg(
        F.max_by("nav", "session").alias("nav")
    )
    spine = nav.select(*keys).distinct().select(
        *keys,
        F.explode(
            F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr("interval 1 month"))
        ).alias("month"),
    )
    before = ends.select(*keys, F.add_months("month", 1).alias("month"), F.col("nav").alias("__prev"))
    return (
        spine.join(ends, [*keys, "month"], "left")
        .join(before, [*keys, "month"], "left")
        .select(
            *keys,
            "month",
            (div("nav", "__prev") - 1).alias("ret"),
            (F.col("nav").isNotNull() & F.col("__prev").isNotNull()).alias("ok"),
        )
    )


def monthly_table(nav: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Year by month grid."""
    wide = (
        monthly_returns(nav, keys)
        .withColumn("year", F.year("month"))
        .withColumn("__m", F.month("month"))
        .groupBy(*keys, "year")
        .pivot("__m", list(range(1, 13)))
        .agg(F.first("ret"))
    )
    return wide.toDF(*keys, "year", *[f"m{m:02d}" for m in range(1, 13)])


def trading_stats(
    marks: DataFrame,
    fills: DataFrame,
    rejections: DataFrame,
    financing: DataFrame,
) -> DataFrame:
    """Counts, turnover, cost drag, financing return and exposure per portfolio.

    Each fact is aggregated to one row per portfolio before the joins.
    """
    from quantframe.operators.costs import cost_totals

    curve = marks.groupBy("portfolio").agg(
        F.avg("nav").alias("__nav"),
        _years().alias("__years"),
        F.avg("gross_exposure").alias("average_exposure"),
    )
    refused = rejections.groupBy("portfolio").agg(F.count(F.lit(1)).alias("rejections"))
    yearly = lambda c: F.when(
        (F.col("__nav") > 0) & (F.col("__years") > 0),
        F.col(c) / F.nullif("__nav", F.lit(0.0)) / F.nullif("__years", F.lit(0.0)),
    ).otherwise(0.0)
    return (
        curve.join(cost_totals(fills, financing), "portfolio", "left")
        .join(refused, "portfolio", "left")
        .fillna(0, ["fills", "rejections"])
        .fillna(0.0, ["traded_notional", "total_costs", "net_financing"])
        .select(
            "portfolio",
            "fills",
            "rejections",
            yearly("traded_notional").alias("annual_turnover"),
            yearly("total_costs").alias("cost_drag"),
            yearly("net_financing").alias("financing_return"),
            "average_exposure",
        )
    )


def rolling_sharpe(
    nav: DataFrame, years: int = 3, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    window = years * SESSIONS_PER_YEAR
    w = _by(keys).rowsBetween(-(window - 1), 0)
    return (
        returns(nav, keys)
        .select(
            *keys,
            "session",
            F.when(
                F.count("ret").over(w) == window,
                div(F.avg("ret").over(w), F.stddev_samp("ret").over(w)) * ROOT,
            ).alias("sharpe"),
        )
        .filter("sharpe is not null")
    )


def growth_and_rolling(
    nav: DataFrame, window: int = SESSIONS_PER_YEAR, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Growth of one hundred and the trailing return over ``window`` sessions."""
    w = _by(keys)
    opening = F.first("nav").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return nav.select(
        *keys,
        "session",
        (100 * F.col("nav") / opening).alias("growth"),
        (div("nav", F.lag("nav", window).over(w)) - 1).alias("rolling_return"),
    )


def allocation_topk(weights: DataFrame, marks: DataFrame, k: int = 7) -> DataFrame:
    """Weights per session with everything past the ``k`` largest mean weights folded.

    Means run over every marked session, so a symbol held rarely ranks low.
    """
    sessions = marks.groupBy("portfolio").agg(F.count(F.lit(1)).alias("__n"))
    mean = (
        weights.groupBy("portfolio", "symbol")
        .agg(F.sum("weight").alias("__w"))
        .join(sessions, "portfolio")
        .withColumn("mean", F.col("__w") / F.col("__n"))
    )
    w = Window.partitionBy("portfolio").orderBy(F.col("mean").desc(), "symbol")
    label = mean.select(
        "portfolio",
        "symbol",
        F.when(F.row_number().over(w) <= k, F.col("symbol")).otherwise("other").alias("line"),
    )
    return (
        weights.join(label, ["portfolio", "symbol"])
        .groupBy("portfolio", "session", "line")
        .agg(F.sum("weight").alias("weight"))
    )


def two_factor_regression(
    rows: DataFrame, y: str, x1: str, x2: str, keys: Sequence[str] = ("portfolio",)
) -> DataFrame:
    """Betas, fit and annualised intercept from grouped covariances, no design matrix."""
    g = rows.groupBy(*keys).agg(
        F.var_samp(x1).alias("s11"),
        F.var_samp(x2).alias("s22"),
        F.covar_samp(x1, x2).alias("s12"),
        F.covar_samp(x1, y).alias("s1y"),
        F.covar_samp(x2, y).alias("s2y"),
        F.var_samp(y).alias("syy"),
        F.avg(x1).alias("m1"),
        F.avg(x2).alias("m2"),
        F.avg(y).alias("my"),
        F.count(F.lit(1)).alias("n"),
    )
    c = F.col
    det = c("s11") * c("s22") - c("s12") ** 2
    b1 = div(c("s22") * c("s1y") - c("s12") * c("s2y"), det)
    b2 = div(c("s11") * c("s2y") - c("s12") * c("s1y"), det)
    return (
        g.withColumn("beta1", b1)
        .withColumn("beta2", b2)
        .select(
            *keys,
            "n",
            "beta1",
            "beta2",
            div(c("beta1") * c("s1y") + c("beta2") * c("s2y"), c("syy")).alias("r_squared"),
            ((c("my") - c("beta1") * c("m1") - c("beta2") * c("m2")) * SESSIONS_PER_YEAR).alias(
                "intercept"
            ),
        )
    )


def half_period_pnl(nav: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    """P&L of both halves, split at row ``n div 2``, which both halves share."""
    w = _by(keys)
    whole = Window.partitionBy(*keys)
    rows = nav.select(
        *keys,
        "nav",
        (F.row_number().over(w) - 1).alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"),
    )
    at = lambda i: F.max(F.when(F.col("i") == i, F.col("nav")))
    mid = F.floor(F.col("n") / 2)
    return rows.groupBy(*keys).agg(
        (at(mid) - at(F.lit(0))).alias("first_half"),
        (at(F.col("n") - 1) - at(mid)).alias("second_half"),
    )


def weekly_summary(
    marks: DataFrame, orders: DataFrame, fills: DataFrame, rejections: DataFrame, initial: float
) -> DataFrame:
    """Latest mark against the one five sessions earlier, since launch, and row counts."""
    w = Window.partitionBy("portfolio").orderBy(F.col("session").desc())
    recent = marks.withColumn("__r", F.row_number().over(w)).filter("__r <= 6")
    count = lambda df, name: df.groupBy("portfolio").agg(
        F.count(F.lit(1)).alias(name)
    )
    return (
        recent.groupBy("portfolio")
        .agg(
            F.max("session").alias("session"),
            F.max_by("nav", "session").alias("nav"),
            F.min_by("nav", "session").alias("__then"),
            F.max_by("cash", "session").alias("cash"),
            F.max_by("gross_exposure", "session").alias("gross_exposure"),
            F.max_by("holdings", "session").alias("holdings"),
        )
        .withColumn("week", F.coalesce(div("nav", "__then") - 1, F.lit(0.0)))
        .withColumn("since_launch", F.col("nav") / initial - 1)
        .join(count(orders, "orders"), "portfolio", "left")
        .join(count(fills, "fills"), "portfolio", "left")
        .join(count(rejections, "rejections"), "portfolio", "left")
        .fillna(0, ["orders", "fills", "rejections"])
        .drop("__then")
    )


def status_rollup(
    marks: DataFrame, pending: DataFrame, counts: DataFrame, staleness: DataFrame
) -> DataFrame:
    """One status row per portfolio: NAV, high-water mark, drawdown, books and freshness."""
    base = marks.groupBy("portfolio").agg(
        F.max("session").alias("last_session"),
        F.count(F.lit(1)).alias("sessions_recorded"),
        F.max_by("nav", "session").alias("nav"),
        F.max_by("cash", "session").alias("cash"),
        F.max("nav").alias("high_water_mark"),
        F.max_by("holdings", "session").alias("positions"),
    )
    waiting = pending.groupBy("portfolio").agg(F.count(F.lit(1)).alias("pending"))
    behind = staleness.select("behind")
    return (
        base.withColumn(
            "drawdown",
            F.greatest(
                F.coalesce(div(F.col("high_water_mark") - F.col("nav"), "high_water_mark"), F.lit(0.0)),
                F.lit(0.0),
            ),
        )
        .join(waiting, "portfolio", "left")
        .join(counts, "portfolio", "left")
        .join(behind, F.lit(True))
        .fillna(0, ["pending"])
    )
