"""Time-series trend following: horizon votes, decayed risk, whole-book scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, round_at
from quantframe.operators.decisions import at_decisions
from quantframe.operators.signals import SESSIONS_PER_YEAR, by_symbol, trailing
from quantframe.operators.sizing import return_tails

LOOKBACKS = (63, 126, 252)


def horizon_return(window: int, skip: int = 5) -> Column:
    """Compounded return over ``window`` rows ending ``skip`` rows ago; null when short."""
    frame = trailing(window, skip)
    grown = F.exp(F.sum(F.log1p("ret")).over(frame)) - 1
    return F.when(F.count("ret").over(frame) == window, grown)


def trend_vote(horizons: Sequence[str]) -> Column:
    return F.signum(sum((F.signum(F.col(h)) for h in horizons), F.lit(0.0)))


def trend_features(
    returns: DataFrame, lookbacks: Sequence[int] = LOOKBACKS, skip: int = 5
) -> DataFrame:
    names = [f"h{w}" for w in lookbacks]
    return returns.select(
        "symbol",
        "session",
        "ret",
        F.row_number().over(by_symbol()).alias("n"),
        *[horizon_return(w, skip).alias(h) for w, h in zip(lookbacks, names, strict=True)],
    ).withColumn("direction", trend_vote(names))


def decay_weight(position: Column, length: int, span: int) -> Column:
    """Normalised weight of the ``position``-th newest of ``length`` observations."""
    keep = 1 - 2.0 / (span + 1.0)
    total = sum(keep**k for k in range(length))
    return F.pow(F.lit(keep), position) / total


def ewma_lines(at_dates: DataFrame, returns: DataFrame, span: int = 63) -> DataFrame:
    """The last ``span`` returns per date and symbol with their decay weights."""
    tails = return_tails(
        at_dates.select("symbol", "n", F.lit(span).alias("length")),
        returns.select("symbol", F.row_number().over(by_symbol()).alias("n"), "ret"),
    )
    return (
        at_dates.join(tails, ["symbol", "n"])
        .filter(F.size("tail") == span)
        .select("*", F.posexplode("tail").alias("pos", "x"))
        .drop("tail")
        .withColumn("w", decay_weight(F.col("pos"), span, span))
    )


def ewma_vol(lines: DataFrame, floor: float = 0.05) -> DataFrame:
    """Annualised decayed deviation with a floor."""
    mean = F.sum(F.col("w") * F.col("x"))
    second = F.sum(F.col("w") * F.col("x") * F.col("x"))
    variance = F.greatest(second - mean * mean, F.lit(0.0))
    return lines.groupBy("as_of", "symbol").agg(
        F.greatest(F.sqrt(variance * SESSIONS_PER_YEAR), F.lit(floor)).alias("vol")
    )


def ewma_cov(lines: DataFrame) -> DataFrame:
    """Pairwise decayed covariance. The matrix is the output; callers pass a market list of
    fixed size, aligned on recency."""
    a = lines.select("as_of", "pos", "w", F.col("symbol").alias("sym_a"), F.col("x").alias("xa"))
    b = lines.select("as_of", "pos", F.col("symbol").alias("sym_b"), F.col("x").alias("xb"))
    cross = F.sum(F.col("w") * F.col("xa") * F.col("xb"))
    return (
        a.join(b, ["as_of", "pos"])
        .filter("sym_a <= sym_b")
        .groupBy("as_of", "sym_a", "sym_b")
        .agg(
            (
                cross
                - F.sum(F.col("w") * F.col("xa")) * F.sum(F.col("w") * F.col("xb"))
            ).alias("cov")
        )
    )


def trend_targets(
    returns: DataFrame,
    decisions: DataFrame,
    *,
    lookbacks: Sequence[int] = LOOKBACKS,
    skip: int = 5,
    span: int = 63,
    floor: float = 0.05,
    target_vol: float = 0.10,
    max_gross: float = 2.0,
) -> DataFrame:
    """Signed weights per decision date.

    Every active market gets the same standalone risk; one scalar, from the decayed variance
    of the preliminary book's own return series, sets the total. The gross cap bounds it.
    """
    need = max(max(lookbacks) + skip, span)
    seen = at_decisions(trend_features(returns, lookbacks, skip), decisions)
    usable = seen.filter(F.col("n") >= need)
    lines = ewma_lines(usable.select("as_of", "symbol", "n", "direction"), returns, span)
    vols = ewma_vol(lines, floor)
    by_date = Window.partitionBy("as_of")
    book = (
        usable.filter("direction <> 0")
        .join(vols, ["as_of", "symbol"])
        .withColumn("__k", F.count(F.lit(1)).over(by_date))
        .withColumn("prelim", F.col("direction") / (F.col("__k") * F.col("vol")))
        .select("as_of", "symbol", "direction", "vol", "prelim")
    )
    path = (
        lines.select("as_of", "symbol", "pos", "x", "w")
        .join(book.select("as_of", "symbol", "prelim"), ["as_of", "symbol"])
        .groupBy("as_of", "pos", "w")
        .agg(F.sum(F.col("prelim") * F.col("x")).alias("p"))
        .groupBy("as_of")
        .agg(
            F.sum(F.col("w") * F.col("p")).alias("__m"),
            F.sum(F.col("w") * F.col("p") * F.col("p")).alias("__s"),
        )
        .select(
            "as_of",
            F.sqrt(
                F.greatest(F.col("__s") - F.col("__m") ** 2, F.lit(0.0)) * SESSIONS_PER_YEAR
            ).alias("__vol"),
        )
    )
    gross = book.groupBy("as_of").agg(F.sum(F.abs("prelim")).alias("__gross"))
    wanted = div(F.lit(target_vol), F.col("__vol"))
    limit = max_gross / F.col("__gross")
    scale = path.join(gross, "as_of").select(
        "as_of",
        F.least(wanted, limit).alias("scale"),
        F.coalesce(limit < wanted, F.lit(True)).alias("capped"),
        (F.col("__vol") * F.least(wanted, limit)).alias("forecast_vol"),
    )
    return book.join(scale, "as_of").select(
        "as_of",
        "symbol",
        "direction",
        "vol",
        round_at(F.col("prelim") * F.col("scale"), 6).alias("weight"),
        "scale",
        "capped",
        "forecast_vol",
    )


def unavailable(
    returns: DataFrame, decisions: DataFrame, need: int = 257
) -> DataFrame:
    """Markets seen on a decision date without enough history to be used."""
    numbered = returns.select("symbol", "session", F.row_number().over(by_symbol()).alias("n"))
    return at_decisions(numbered, decisions).filter(F.col("n") < need)
