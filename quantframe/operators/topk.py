"""Top rows per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    tie: Sequence[str],
    k: int,
    *,
    salts: int = 64,
) -> DataFrame:
    """The ``k`` largest rows per key, ties broken by ``tie`` ascending.

    Rows are first cut to ``k`` per (key, salt), where the salt hashes the row itself, then
    to ``k`` per key. A key with a third of all rows is ranked by many tasks, and at most
    ``k * salts`` of its rows meet in one.
    """
    order = [F.col(value).desc(), *tie]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(value, *tie), F.lit(salts)))
    local = Window.partitionBy(*keys, "__salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    return (
        salted.withColumn("__r", F.row_number().over(local))
        .filter(F.col("__r") <= k)
        .withColumn("__r", F.row_number().over(whole))
        .filter(F.col("__r") <= k)
        .drop("__r", "__salt")
    )
