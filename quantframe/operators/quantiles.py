"""Exact quantiles of groups too large for one task.

Values fall into fixed, ordered buckets (a function of the value alone). Bucket counts find
the bucket that holds the wanted ranks; only that bucket's distinct values are then ranked.
Nothing is sampled and ties collapse into counts before they move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket(value: Column, per_octave: int = 64) -> Column:
    """Monotone bucket number of a double: logarithmic on both sides of zero."""
    size = F.floor(F.log2(F.abs(value)) * per_octave) + 2000 * per_octave
    return F.when(value == 0, F.lit(0)).when(value > 0, size).otherwise(-size).cast("bigint")


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, p: float, name: str = "quantile"
) -> DataFrame:
    """Linear-interpolated quantile per key, exact at any group size."""
    keys = list(keys)
    rows = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        .withColumn("__b", bucket(F.col("__v")))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    counts = rows.groupBy(*keys, "__b").agg(F.sum("__c").alias("__bc"))
    position = p * (F.col("__n") - 1)
    hit = (
        counts.withColumn("__n", F.sum("__bc").over(group))
        .withColumn("__before", F.sum("__bc").over(upto) - F.col("__bc"))
        .withColumn("__lo", F.floor(position))
        .withColumn("__hi", F.ceil(position))
        .withColumn("__f", position - F.floor(position))
        .filter(
            F.col("__lo").between(F.col("__before"), F.col("__before") + F.col("__bc") - 1)
            | F.col("__hi").between(F.col("__before"), F.col("__before") + F.col("__bc") - 1)
        )
        .select(*keys, "__b", "__before", "__lo", "__hi", "__f")
    )
    inside = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, 0
    )
    ranked = (
        rows.join(hit, [*keys, "__b"])
        .withColumn("__end", F.col("__before") + F.sum("__c").over(inside))
        .withColumn("__start", F.col("__end") - F.col("__c"))
    )
    at = lambda r: F.max(
        F.when((F.col(r) >= F.col("__start")) & (F.col(r) < F.col("__end")), F.col("__v"))
    )
    return (
        ranked.groupBy(*keys)
        .agg(at("__lo").alias("__a"), at("__hi").alias("__z"), F.max("__f").alias("__f"))
        .select(*keys, (F.col("__a") + F.col("__f") * (F.col("__z") - F.col("__a"))).alias(name))
    )
