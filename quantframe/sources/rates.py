"""Dated rate curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RATE_SCHEMA = "date date, annual_rate double"
MARGIN_SPREAD = 0.015


def load_rates(spark: SparkSession, path: str) -> DataFrame:
    """Read ``date,annual_rate`` rows; a missing column or unparseable cell fails the read."""
    rows = (
        spark.read.schema(RATE_SCHEMA)
        .option("header", True)
        .option("enforceSchema", False)
        .option("mode", "FAILFAST")
        .csv(path)
    )
    return rows.withColumn(
        "annual_rate",
        F.when(F.col("annual_rate").isNull(), F.raise_error(F.lit("missing annual_rate")))
        .otherwise(F.col("annual_rate"))
        .cast("double"),
    )


def rate_violations(rates: DataFrame) -> DataFrame:
    """Duplicate dates and negative rates; an empty frame means the curve is usable."""
    duplicates = (
        rates.groupBy("date").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(
            "date", F.lit("duplicate date").alias("reason")
        )
    )
    negative = rates.filter("annual_rate < 0").select("date", F.lit("negative rate").alias("reason"))
    return duplicates.unionByName(negative)


def observations(raw: DataFrame, value: str = "value", day: str = "observation_date") -> DataFrame:
    """Published percentages to decimals; missing markers are dropped."""
    return raw.filter(~F.trim(value).isin("", ".")).select(
        F.col(day).cast("date").alias("date"),
        (F.col(value).cast("double") / 100).alias("annual_rate"),
    )


def margin_curve(benchmark: DataFrame, spread: float = MARGIN_SPREAD) -> DataFrame:
    """What borrowing costs: the benchmark, floored at zero, plus a spread."""
    return benchmark.select(
        "date", (F.greatest(F.col("annual_rate"), F.lit(0.0)) + spread).alias("annual_rate")
    )
