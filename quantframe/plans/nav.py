"""NAV of target-weight histories: segments between rebalances, chained.

Re-aim of an event-by-event replay for many variants at once. Units are fixed at the open
of the session after a decision and held until the next one; holdings are fractional and
there is no no-trade band. ``operators.allocation.rebalance_orders`` gives the exact one-step
rebalance with lots and bands for a real book.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators.bars import filled_panel
from quantframe.session import shared


def segments(targets: DataFrame, calendar: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key and decision: first session held and the session of the next execution."""
    following = calendar.select(
        F.col("session").alias("as_of"),
        (F.col("seq") + 1).alias("start_seq"),
        F.max("seq").over(Window.partitionBy(F.lit(0))).alias("__last"),
    )
    w = Window.partitionBy(*keys).orderBy("as_of")
    return (
        targets.select(*keys, "as_of")
        .distinct()
        .join(following, "as_of")
        .withColumn("end_seq", F.lead("start_seq").over(w))
        .filter("start_seq <= __last")
        .withColumn("stop_seq", F.coalesce(F.col("end_seq") - 1, F.col("__last")))
        .drop("__last")
    )


def segment_nav(
    targets: DataFrame,
    bars: DataFrame,
    calendar: DataFrame,
    *,
    keys: Sequence[str] = ("variant",),
    initial: float = 100000.0,
    cost_rate: Column | float = 0.0,
) -> DataFrame:
    """NAV, exposure and turnover per key and session.

    Within a segment the book is ``cash weight + sum(w * P(t) / P(t0))``; segments multiply.
    ``cost_rate`` (a number, or an expression over the keys) is charged on the turnover of each
    rebalance, measured against the drifted weights of the previous segment. Weights that do not sum to one leave cash.
    """
    keys = list(keys)
    rate = cost_rate if isinstance(cost_rate, Column) else F.lit(float(cost_rate))
    seq = calendar.select("session", "seq")
    panel = filled_panel(bars, calendar).join(seq, "session").select("symbol", "seq", "open", "close")
    targets = shared(targets)
    spans = shared(segments(targets, calendar, keys))

    # Entry and exit opens of every line: one lookup for both ends of its segment.
    ends = (
        targets.join(spans, [*keys, "as_of"])
        .select(
            *keys,
            "as_of",
            "symbol",
            "weight",
            "start_seq",
            "end_seq",
            "stop_seq",
            F.explode(F.array("start_seq", "end_seq")).alias("seq"),
        )
        .join(panel.select("symbol", "seq", "open"), ["symbol", "seq"])
    )
    lots = shared(
        ends.groupBy(*keys, "as_of", "symbol", "weight", "start_seq", "end_seq", "stop_seq")
        .agg(
            F.max(F.when(F.col("seq") == F.col("start_seq"), F.col("open"))).alias("__p0"),
            F.max(F.when(F.col("seq") == F.col("end_seq"), F.col("open"))).alias("__p1"),
        )
        .filter("__p0 is not null")
    )
    moved = F.col("weight") * F.col("__p1") / F.col("__p0")
    closing = (
        lots.filter("end_seq is not null")
        .groupBy(*keys, "as_of")
        .agg((1 - F.sum("weight") + F.sum(moved)).alias("__end"))
    )

    # Turnover at each execution: new weights against the drifted old ones.
    new = lots.select(*keys, F.col("start_seq").alias("seq"), "symbol", "weight")
    old = (
        lots.filter("end_seq is not null")
        .join(closing, [*keys, "as_of"])
        .select(*keys, F.col("end_seq").alias("seq"), "symbol", (-moved / F.col("__end")).alias("weight"))
    )
    turnover = (
        new.unionByName(old)
        .groupBy(*keys, "seq", "symbol")
        .agg(F.sum("weight").alias("__d"))
        .groupBy(*keys, F.col("seq").alias("start_seq"))
        .agg(F.sum(F.abs("__d")).alias("turnover"))
    )
    w = Window.partitionBy(*keys).orderBy("start_seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    chain = (
        spans.select(*keys, "as_of", "start_seq")
        .join(turnover, [*keys, "start_seq"], "left")
        .join(closing, [*keys, "as_of"], "left")
        .withColumn("__prev", F.lag("__end").over(w))
        .withColumn(
            "__step",
            F.coalesce("__prev", F.lit(1.0))
            * (1 - rate * F.coalesce("turnover", F.lit(0.0))),
        )
        .withColumn("__base", initial * F.exp(F.sum(F.log("__step")).over(upto)))
        .select(*keys, "as_of", "__base", "turnover")
    )

    # The only large step: one row per line and session held, summed at once.
    walked = (
        lots.withColumn("seq", F.explode(F.sequence("start_seq", "stop_seq")))
        .join(panel.select("symbol", "seq", "close"), ["symbol", "seq"])
        .groupBy(*keys, "as_of", "start_seq", "seq")
        .agg(
            F.sum(F.col("weight") * F.col("close") / F.col("__p0")).alias("__value"),
            F.sum("weight").alias("__w"),
        )
        .withColumn("__g", 1 - F.col("__w") + F.col("__value"))
    )
    return (
        walked.join(chain, [*keys, "as_of"])
        .join(seq, "seq")
        .select(
            *keys,
            "session",
            (F.col("__base") * F.col("__g")).alias("nav"),
            (F.col("__value") / F.col("__g")).alias("exposure"),
            F.when(F.col("seq") == F.col("start_seq"), F.col("turnover"))
            .otherwise(0.0)
            .alias("turnover"),
        )
    )
