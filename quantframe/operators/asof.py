"""Point-in-time joins: a value stamped ``ts`` is visible iff ``ts <= as_of``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_ts: str,
    right_ts: str,
    values: Sequence[str],
    *,
    grain: str = "month",
    allow_exact: bool = True,
) -> DataFrame:
    """Attach to each left row the last right row at or before its instant.

    Both sides are tagged, unioned and read by one window per ``(key, time bucket)``. A key
    that holds a third of all rows is therefore spread over its buckets, and the only rows
    that cross a bucket border are one carried value per bucket. ``allow_exact=False`` asks
    for strictly earlier rows. Left rows without a match keep nulls.
    """
    keys = list(on)
    packed = F.struct(*[F.col(v) for v in values])
    bucket = lambda ts: F.date_trunc(grain, F.col(ts).cast("timestamp"))
    probes = left.select(
        F.struct(*[F.col(c) for c in left.columns]).alias("__left"),
        *keys,
        F.col(left_ts).cast("timestamp").alias("__ts"),
        bucket(left_ts).alias("__bucket"),
        F.lit(1).alias("__rank"),
    )
    known = right.select(
        *keys,
        F.col(right_ts).cast("timestamp").alias("__ts"),
        bucket(right_ts).alias("__bucket"),
        packed.alias("__value"),
        F.lit(0 if allow_exact else 2).alias("__rank"),
    )
    marks = (
        probes.select(*keys, "__bucket")
        .distinct()
        .unionByName(
            known.groupBy(*keys, "__bucket").agg(F.max_by("__value", "__ts").alias("__value")),
            allowMissingColumns=True,
        )
        .groupBy(*keys, "__bucket")
        .agg(F.max("__value").alias("__value"))
    )
    earlier = (
        Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = marks.select(
        *keys,
        "__bucket",
        F.lit(None).cast("timestamp").alias("__ts"),
        F.last("__value", ignorenulls=True).over(earlier).alias("__value"),
        F.lit(-1).alias("__rank"),
    )
    merged = probes.unionByName(known, allowMissingColumns=True).unionByName(
        carry, allowMissingColumns=True
    )
    inside = (
        Window.partitionBy(*keys, "__bucket")
        .orderBy(F.col("__ts").asc_nulls_first(), "__rank")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        merged.withColumn("__hit", F.last("__value", ignorenulls=True).over(inside))
        .filter(F.col("__left").isNotNull())
        .select("__left.*", *[F.col(f"__hit.{v}").alias(v) for v in values])
    )


def rate_on(
    facts: DataFrame,
    rates: DataFrame,
    date_col: str,
    *,
    rate_date: str = "date",
    rate: str = "annual_rate",
    name: str = "rate",
) -> DataFrame:
    """The rate known on each fact's date, carried forward and never backward.

    Only the distinct dates take part in the as-of read; facts then pick the rate up by
    equality. The date table is bounded by the calendar, so the optimiser can see its size
    at run time and broadcast it, or hash-join it when it is not small.
    """
    days = facts.select(F.col(date_col).alias("__day")).distinct()
    dated = asof_join(
        days,
        rates.select(F.col(rate_date).alias("__from"), F.col(rate).alias(name)),
        [],
        "__day",
        "__from",
        [name],
        grain="year",
    )
    return facts.join(dated, facts[date_col] == dated["__day"], "left").drop("__day")


def unknown_rates(facts: DataFrame, rates: DataFrame, date_col: str) -> DataFrame:
    """Violations: fact dates that precede every observation of the curve."""
    return (
        rate_on(facts, rates, date_col, name="__rate")
        .filter("__rate is null")
        .select(F.col(date_col).alias("session"))
        .distinct()
    )
