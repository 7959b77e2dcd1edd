"""Instrument and universe dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INSTRUMENT_SCHEMA = (
    "symbol string, asset_class string, currency string, lot_size double,"
    " trades_continuously boolean, available_from date"
)

# The named universes, the cash proxy and the admission dates.
CORE_ETFS = (
    "SPY", "QQQ", "IWM", "EFA", "EEM", "TLT", "IEF", "LQD", "HYG", "GLD", "DBC", "VNQ",
)
CASH_PROXY = "BIL"
CRYPTO_AVAILABLE_FROM = {"BTC-USD": "2021-01-01", "ETH-USD": "2022-01-01"}
SECTOR_ETFS = ("XLB", "XLE", "XLF", "XLI", "XLK", "XLP", "XLU", "XLV", "XLY")
ETF_LOT, CRYPTO_LOT = 1.0, 0.00000001
HALF_SPREAD_BPS = {
    "SPY": 0.3, "QQQ": 0.4, "IWM": 0.6, "EFA": 1.0, "EEM": 1.5, "TLT": 0.6, "IEF": 0.8,
    "LQD": 1.0, "HYG": 1.2, "GLD": 0.5, "DBC": 4.0, "VNQ": 1.2, "BIL": 1.0,
    "BTC-USD": 5.0, "ETH-USD": 8.0,
}


def instruments(spark: SparkSession) -> DataFrame:
    """The named instruments as a dimension."""
    etfs = [(s, "etf", "USD", ETF_LOT, False, None) for s in (*CORE_ETFS, CASH_PROXY, *SECTOR_ETFS)]
    coins = [
        (s, "crypto", "USD", CRYPTO_LOT, True, d) for s, d in CRYPTO_AVAILABLE_FROM.items()
    ]
    raw = spark.createDataFrame(
        etfs + coins, INSTRUMENT_SCHEMA.replace("available_from date", "available_from string")
    )
    return raw.withColumn("available_from", F.col("available_from").cast("date"))


def universes(spark: SparkSession) -> DataFrame:
    """Bridge table ``(universe, symbol)``."""
    core = [("core", s) for s in CORE_ETFS]
    plus = [("core+crypto", s) for s in (*CORE_ETFS, *CRYPTO_AVAILABLE_FROM)]
    sectors = [("sectors", s) for s in SECTOR_ETFS]
    return spark.createDataFrame(core + plus + sectors, "universe string, symbol string")


def half_spreads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(HALF_SPREAD_BPS.items()), "symbol string, half_spread_bps double"
    )


def universe_members(dims: DataFrame) -> DataFrame:
    """Universe membership by asset class: the core excludes round-the-clock instruments."""
    core = dims.filter("not trades_continuously").select(
        F.lit("core").alias("universe"), "symbol", "available_from"
    )
    every = dims.select(F.lit("core+crypto").alias("universe"), "symbol", "available_from")
    return core.unionByName(every)


def instrument_violations(dims: DataFrame) -> DataFrame:
    """Duplicate symbols, unknown asset classes and non-positive lots."""
    copies = dims.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return copies.select("symbol", F.lit("duplicate symbol").alias("reason")).unionByName(
        dims.filter("asset_class not in ('etf', 'equity', 'crypto', 'future', 'cash')").select(
            "symbol", F.lit("unknown asset class").alias("reason")
        )
    ).unionByName(
        dims.filter("lot_size <= 0").select("symbol", F.lit("non-positive lot").alias("reason"))
    )
