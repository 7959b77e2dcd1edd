"""Portfolio sizing: inverse volatility, shrunk covariance, volatility target, caps.

Book risk is computed without a covariance matrix. With ``r`` the member returns, the
variance of a book is the variance of its weighted return series; the average correlation is
``(var(sum of standardised returns) - k) / (k (k - 1))``; and shrinking every correlation
toward that average is a linear blend of the two. Work and shuffle are therefore linear in
the number of members, not quadratic, whatever the size of the universe.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, round_at

SESSIONS_PER_YEAR = 252
DEFAULT_SHRINKAGE = 0.25


def realised_vol(returns: DataFrame, lookback: int = 60, minimum: int = 40) -> DataFrame:
    """Sample deviation of the last ``lookback`` returns, given at least ``minimum``."""
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(-(lookback - 1), 0)
    return returns.select(
        "symbol",
        "session",
        F.when(F.count("ret").over(w) >= minimum, F.stddev_samp("ret").over(w)).alias("vol"),
    ).filter("vol is not null")


def inverse_vol_weights(vols: DataFrame, group: Sequence[str], vol: str = "vol") -> DataFrame:
    """Weights proportional to 1/vol within each group; flat series are dropped."""
    share = Window.partitionBy(*group)
    return (
        vols.filter(F.col(vol) > 0)
        .withColumn("__inv", 1 / F.col(vol))
        .withColumn("weight", round_at(F.col("__inv") / F.sum("__inv").over(share), 6))
        .drop("__inv")
    )


def numbered_returns(bars: DataFrame) -> DataFrame:
    """Returns with the position of their bar, so a history tail is an equality join."""
    w = Window.partitionBy("symbol").orderBy("session")
    return bars.select(
        "symbol",
        "session",
        F.row_number().over(w).alias("n"),
        (div("close", F.lag("close").over(w)) - 1).alias("ret"),
    )


def return_tails(members: DataFrame, returns: DataFrame) -> DataFrame:
    """For each distinct ``(symbol, n)`` the last ``length`` returns, newest first.

    ``length`` is a parameter-bounded number of sessions, never a data-sized one.
    """
    ends = members.groupBy("symbol", "n").agg(F.max("length").alias("length"))
    wanted = ends.select(
        "symbol", F.col("n").alias("__end"), F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("__k")
    ).withColumn("n", F.col("__end") - F.col("__k"))
    return (
        wanted.join(returns.select("symbol", "n", "ret"), ["symbol", "n"])
        .filter("ret is not null")
        .groupBy("symbol", "__end")
        .agg(F.array_sort(F.collect_list(F.struct("__k", "ret"))).alias("__t"))
        .select("symbol", F.col("__end").alias("n"), F.col("__t.ret").alias("tail"))
    )


def member_lines(members: DataFrame, returns: DataFrame, book: Sequence[str]) -> DataFrame:
    """One row per book, member and recency position ``pos`` with that day's return ``r``.

    The history of a member is an equality join on ``(symbol, n)``; ``length`` is a parameter.
    """
    wanted = members.select(
        *book,
        "symbol",
        "weight",
        F.col("n").alias("__end"),
        F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("pos"),
    ).withColumn("n", F.col("__end") - F.col("pos"))
    return (
        wanted.join(returns.select("symbol", "n", F.col("ret").alias("r")), ["symbol", "n"])
        .filter("r is not null")
        .select(*book, "symbol", "weight", "pos", "r")
    )


def book_risk(
    members: DataFrame,
    returns: DataFrame,
    book: Sequence[str],
    *,
    shrinkage: float = DEFAULT_SHRINKAGE,
) -> DataFrame:
    """Annualised volatility and diversification of each book.

    ``members`` carries the book keys, ``symbol``, ``n`` (position of the last visible bar),
    ``length`` (returns to use) and ``weight``. Histories align on recency. One chain: join
    the histories, deviate per member, sum per position, take variances per book.
    """
    by_member = Window.partitionBy(*book, "symbol")
    lines = member_lines(members, returns, book).withColumn(
        "sd", F.stddev_samp("r").over(by_member)
    )
    ws = F.col("weight") * F.col("sd")
    moments = (
        lines.groupBy(*book, "pos")
        .agg(
            F.sum(F.col("weight") * F.col("r")).alias("__p"),
            F.sum(F.when(F.col("sd") > 0, F.col("r") / F.col("sd"))).alias("__z"),
            F.sum(ws).alias("__ws"),
            F.sum(ws * ws).alias("__ws2"),
            F.sum(F.when(F.col("sd") > 0, 1).otherwise(0)).alias("__k"),
        )
        .groupBy(*book)
        .agg(
            F.var_samp("__p").alias("__raw"),
            F.var_samp("__z").alias("__zvar"),
            *[F.max_by(c, F.struct("__k", -F.col("pos"))).alias(c) for c in ("__ws", "__ws2")],
            F.max("__k").alias("__k"),
        )
    )
    k = F.col("__k")
    rho = div(F.col("__zvar") - k, (k * (k - 1)).cast("double"))
    target = rho * (F.col("__ws") ** 2 - F.col("__ws2")) + F.col("__ws2")
    variance = F.when(
        (k >= 2) & F.lit(shrinkage > 0), (1 - shrinkage) * F.col("__raw") + shrinkage * target
    ).otherwise(F.col("__raw"))
    vol = F.sqrt(F.greatest(variance, F.lit(0.0)) * SESSIONS_PER_YEAR)
    return moments.select(
        *book,
        vol.alias("volatility"),
        rho.alias("mean_correlation"),
        F.coalesce(div(F.col("__ws") * SESSIONS_PER_YEAR**0.5, vol), F.lit(0.0)).alias(
            "diversification"
        ),
    )


def shrunk_covariance(
    members: DataFrame,
    returns: DataFrame,
    book: Sequence[str],
    *,
    shrinkage: float = DEFAULT_SHRINKAGE,
) -> DataFrame:
    """The covariance matrix itself, long, both triangles, for books of bounded size.

    The output is the matrix, so its size is the square of the book's; callers pass selected
    members (a top-n), never a universe.
    """
    lines = member_lines(members, returns, book)
    keys = [*book, "pos"]
    left = lines.select(*keys, F.col("symbol").alias("sym_a"), F.col("r").alias("ra"))
    right = lines.select(*keys, F.col("symbol").alias("sym_b"), F.col("r").alias("rb"))
    raw = (
        left.join(right, keys)
        .groupBy(*book, "sym_a", "sym_b")
        .agg(
            F.covar_samp("ra", "rb").alias("__c"),
            F.stddev_samp("ra").alias("__sa"),
            F.stddev_samp("rb").alias("__sb"),
        )
    )
    off = F.col("sym_a") != F.col("sym_b")
    corr = div("__c", F.col("__sa") * F.col("__sb"))
    mean = F.avg(F.when(off, corr)).over(Window.partitionBy(*book))
    blended = ((1 - shrinkage) * corr + shrinkage * mean) * F.col("__sa") * F.col("__sb")
    return raw.select(
        *book,
        "sym_a",
        "sym_b",
        F.when(~off | mean.isNull(), F.col("__c"))
        .otherwise(F.coalesce(blended, F.lit(0.0)))
        .alias("cov"),
    )


def vol_target(risk: DataFrame, target: Column | float = 0.10, max_scale: float = 1.0) -> DataFrame:
    """Scale toward the target, never past ``max_scale``; a book that does not move is taken
    at face value and counted as capped."""
    goal = target if isinstance(target, Column) else F.lit(target)
    wanted = div(goal, "volatility")
    return risk.withColumn(
        "scale", F.coalesce(F.least(wanted, F.lit(max_scale)), F.lit(max_scale))
    ).withColumn("capped", F.coalesce(wanted > max_scale, F.lit(True)))


def cap_and_cash(
    sized: DataFrame, book: Sequence[str], cash_symbol: str, max_weight: Column | float = 0.35
) -> DataFrame:
    """Drop members that fail the trend, trim to the cap, and park the rest in cash.

    ``sized`` carries ``weight`` and ``passing``. What is dropped or trimmed is never shared
    out among the survivors. One aggregate per book adds the cash row.
    """
    cap = max_weight if isinstance(max_weight, Column) else F.lit(max_weight)
    kept = sized.withColumn(
        "weight", F.when(F.col("passing"), F.least("weight", cap)).otherwise(0.0)
    )
    cash = 1 - F.sum("weight")
    lines = kept.groupBy(*book).agg(
        F.concat(
            F.collect_list(F.when(F.col("passing"), F.struct("symbol", "weight"))),
            F.array(F.struct(F.lit(cash_symbol).alias("symbol"), cash.alias("weight"))),
        ).alias("__lines")
    )
    return (
        lines.select(*book, F.inline("__lines"))
        .filter((F.col("symbol") != cash_symbol) | (F.col("weight") > 5e-7))
    )
