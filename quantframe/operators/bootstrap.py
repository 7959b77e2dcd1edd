"""Block bootstraps by prefix sums.

A resampled mean, variance or correlation only needs sums over blocks, and the sum over any
block is a difference of two prefix sums. Each draw therefore touches one row per block, not
one per observation: a 21-session block costs 1/21 of the textbook expansion, and draws
aggregate map-side. Start positions come from a hash of (seed, draw, block), so a retried task
draws the same blocks and another engine can reproduce them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div

ROOT = 252**0.5


def start_position(seed: int, draw: Column, block: Column, choices: Column) -> Column:
    """A reproducible start in ``[0, choices)``."""
    text = F.concat_ws("-", F.lit(str(seed)), draw.cast("string"), block.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % choices


def resampled_sums(
    rows: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    *,
    order: str = "session",
    block: int,
    draws: int,
    seed: int,
    circular: bool,
) -> DataFrame:
    """Sums of ``columns`` over each resampled series, trimmed to the original length.

    Returns ``keys, draw, n`` and one sum per column. A series is one curve, bounded by the
    calendar; ``draws`` is spread over the cluster.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(order)
    whole = Window.partitionBy(*keys)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    base = rows.select(
        *keys,
        (F.row_number().over(w) - 1).cast("bigint").alias("i"),
        F.count(F.lit(1)).over(whole).alias("n"),
        *columns,
        *[F.sum(c).over(upto).alias(f"__p_{c}") for c in columns],
        *[F.sum(c).over(whole).alias(f"__t_{c}") for c in columns],
    )
    per_draw = F.ceil(F.col("n") / block)
    tail = F.col("n") - (per_draw - 1) * block
    prefix = [f"__p_{c}" for c in columns]
    ends = base.select(*keys, F.col("i").alias("__j"), *[F.col(p).alias(f"__e{p}") for p in prefix])

    def spans(length: Column, tag: str) -> DataFrame:
        stop = F.col("i") + length - 1
        at = F.pmod(stop, F.col("n")) if circular else stop
        joined = base.withColumn("__stop", stop).withColumn("__j", at).join(ends, [*keys, "__j"])
        wrapped = F.when(F.col("__stop") >= F.col("n"), 1.0).otherwise(0.0)
        return joined.select(
            *keys,
            "i",
            F.lit(tag).alias("__kind"),
            *[
                (
                    F.col(f"__e__p_{c}")
                    - F.col(f"__p_{c}")
                    + F.col(c)
                    + wrapped * F.col(f"__t_{c}")
                ).alias(c)
                for c in columns
            ],
        )

    pieces = spans(F.lit(block), "full").unionByName(spans(tail, "tail"))
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = (
        base.filter("i = 0")
        .select(*keys, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
        .repartition(partitions, *keys, "draw")
        .select("*", F.explode(F.sequence(F.lit(0), (per_draw - 1).cast("int"))).alias("__b"))
    )
    choices = F.col("n") if circular else F.col("n") - block + 1
    drawn = picks.select(
        *keys,
        "n",
        "draw",
        start_position(seed, F.col("draw"), F.col("__b"), choices).alias("i"),
        F.when(F.col("__b") == per_draw - 1, "tail").otherwise("full").alias("__kind"),
    )
    return (
        drawn.join(pieces, [*keys, "i", "__kind"])
        .groupBy(*keys, "draw", "n")
        .agg(*[F.sum(c).alias(c) for c in columns])
    )


def centred(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Each column minus its own mean (kept as ``{column}_mean``): squares stay accurate."""
    whole = Window.partitionBy(*keys)
    means = rows.select("*", *[F.avg(c).over(whole).alias(f"{c}_mean") for c in columns])
    return means.select(
        *[c for c in means.columns if c not in columns],
        *[(F.col(c) - F.col(f"{c}_mean")).alias(c) for c in columns],
    )


def sharpe_draws(
    returns: DataFrame,
    keys: Sequence[str] = ("portfolio",),
    *,
    block: int = 21,
    draws: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Annualised Sharpe of every draw; ``returns`` carries ``session, ret``.

    Curves shorter than two blocks are left out.
    """
    keys = list(keys)
    size = Window.partitionBy(*keys)
    long_enough = returns.withColumn("__n", F.count(F.lit(1)).over(size)).filter(
        F.col("__n") >= 2 * block
    )
    base = centred(long_enough.select(*keys, "session", "ret"), keys, ["ret"]).withColumn(
        "sq", F.col("ret") * F.col("ret")
    )
    means = long_enough.groupBy(*keys).agg(F.avg("ret").alias("__mu"))
    sums = resampled_sums(
        base, keys, ["ret", "sq"], block=block, draws=draws, seed=seed, circular=False
    )
    n = F.col("n")
    variance = F.greatest((F.col("sq") - F.col("ret") ** 2 / n) / (n - 1), F.lit(0.0))
    mean = F.col("ret") / n + F.col("__mu")
    return sums.join(means, keys).select(
        *keys, "draw", F.coalesce(div(mean * ROOT, F.sqrt(variance)), F.lit(0.0)).alias("sharpe")
    )


def sharpe_interval(
    returns: DataFrame,
    keys: Sequence[str] = ("portfolio",),
    *,
    block: int = 21,
    draws: int = 2000,
    seed: int = 0,
    confidence: float = 0.95,
) -> DataFrame:
    """Point estimate and percentile interval of the Sharpe ratio per curve."""
    keys = list(keys)
    tail = (1 - confidence) / 2
    point = returns.groupBy(*keys).agg(
        (div(F.avg("ret"), F.stddev_samp("ret")) * ROOT).alias("point")
    )
    spread = (
        sharpe_draws(returns, keys, block=block, draws=draws, seed=seed)
        .groupBy(*keys)
        .agg(
            F.percentile("sharpe", tail).alias("low"),
            F.percentile("sharpe", 1 - tail).alias("high"),
            F.count(F.lit(1)).alias("draws"),
        )
    )
    return point.join(spread, keys)


def histogram(draws: DataFrame, keys: Sequence[str], bins: int = 60) -> DataFrame:
    """Equal-width bins of the draws between their extremes, empty bins omitted."""
    keys = list(keys)
    edges = draws.groupBy(*keys).agg(F.min("sharpe").alias("lo"), F.max("sharpe").alias("hi"))
    place = F.floor((F.col("sharpe") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins)
    return (
        draws.join(edges, keys)
        .withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.lit(bins - 1)))
        .groupBy(*keys, "bin")
        .agg(F.count(F.lit(1)).alias("draws"))
    )


def paired_sharpe_interval(
    paired: DataFrame,
    keys: Sequence[str],
    *,
    block: int = 252,
    draws: int = 2000,
    seed: int = 1102026,
) -> DataFrame:
    """Interval of the Sharpe difference when both series reuse the same circular blocks.

    ``paired`` carries ``session`` and, per series, total and excess returns:
    ``ret_a, ex_a, ret_b, ex_b``.
    """
    keys = list(keys)
    base = (
        centred(paired, keys, ["ret_a", "ret_b"])
        .withColumn("sq_a", F.col("ret_a") ** 2)
        .withColumn("sq_b", F.col("ret_b") ** 2)
    )
    columns = ["ret_a", "ret_b", "ex_a", "ex_b", "sq_a", "sq_b"]
    sums = resampled_sums(
        base, keys, columns, block=block, draws=draws, seed=seed, circular=True
    )
    n = F.col("n")

    def sharpe(side: str) -> Column:
        var = (F.col(f"sq_{side}") - F.col(f"ret_{side}") ** 2 / n) / (n - 1)
        return div(F.col(f"ex_{side}") / n * ROOT, F.sqrt(F.greatest(var, F.lit(0.0))))

    return (
        sums.withColumn("diff", sharpe("b") - sharpe("a"))
        .groupBy(*keys)
        .agg(
            F.percentile("diff", 0.025).alias("low"),
            F.percentile("diff", 0.975).alias("high"),
        )
    )


def correlation_interval(
    paired: DataFrame,
    keys: Sequence[str],
    x: str,
    y: str,
    *,
    order: str = "month",
    block: int = 12,
    draws: int = 2000,
    seed: int = 0,
) -> DataFrame:
    """Interval of a correlation under circular block resampling."""
    keys = list(keys)
    base = centred(paired.select(*keys, order, x, y), keys, [x, y]).select(
        *keys,
        order,
        F.col(x).alias("sx"),
        F.col(y).alias("sy"),
        (F.col(x) ** 2).alias("sxx"),
        (F.col(y) ** 2).alias("syy"),
        (F.col(x) * F.col(y)).alias("sxy"),
    )
    sums = resampled_sums(
        base,
        keys,
        ["sx", "sy", "sxx", "syy", "sxy"],
        order=order,
        block=block,
        draws=draws,
        seed=seed,
        circular=True,
    )
    c, n = F.col, F.col("n")
    cov = c("sxy") - c("sx") * c("sy") / n
    vx, vy = c("sxx") - c("sx") ** 2 / n, c("syy") - c("sy") ** 2 / n
    return (
        sums.withColumn("corr", div(cov, F.sqrt(F.greatest(vx * vy, F.lit(0.0)))))
        .groupBy(*keys)
        .agg(
            F.percentile("corr", 0.025).alias("low"), F.percentile("corr", 0.975).alias("high")
        )
    )
