"""Bar store and journal sinks on partitioned Parquet.

Layout: bars are partitioned by year, so a date range prunes directories and a re-sync of the
last week rewrites one partition. Symbols are sorted inside files, which keeps row-group
statistics selective. Journals are append-only; idempotency is an anti join on the key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators.bars import upsert_bars

BAR_SCHEMA = (
    "symbol string, session date, open double, high double, low double, close double,"
    " volume double, year int"
)
JOURNAL_SCHEMAS = {
    "orders": "order_id string, portfolio string, created_at timestamp, symbol string,"
    " quantity decimal(28,8), reason string",
    "fills": "execution_id decimal(38,0), order_id string, portfolio string, ts timestamp,"
    " symbol string, quantity decimal(28,8), price decimal(28,8), commission decimal(18,2),"
    " slippage decimal(28,8)",
    "fill_amendments": "execution_id decimal(38,0), version int, ts timestamp, price decimal(28,8),"
    " commission decimal(18,2), slippage decimal(28,8), source_sha256 string, source_row int",
    "statement_recoveries": "source_sha256 string, confirmation_sha256 string,"
    " created_at timestamp, audit string",
    "rejections": "order_id string, portfolio string, ts timestamp, symbol string,"
    " quantity decimal(28,8), reason string",
    "nav": "portfolio string, session date, ts timestamp, nav decimal(38,10),"
    " cash decimal(18,2), gross_exposure double, holdings int, weights map<string,double>",
    "meta": "portfolio string, key string, value string",
}
JOURNAL_KEYS = {
    "orders": ("order_id",),
    "fills": ("execution_id",),
    "fill_amendments": ("execution_id", "source_sha256", "source_row"),
    "statement_recoveries": ("source_sha256",),
    "nav": ("portfolio", "session"),
    "meta": ("portfolio", "key"),
}


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BAR_SCHEMA).parquet(path).drop("year")


def write_bars(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write bars by year, overwriting only the years present in ``bars``."""
    (
        bars.withColumn("year", F.year("session"))
        .repartition("year", "symbol")
        .sortWithinPartitions("symbol", "session")
        .write.mode(mode)
        .option("compression", "zstd")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("year")
        .parquet(path)
    )


def merge_into_store(spark: SparkSession, path: str, new: DataFrame, staging: str) -> None:
    """Newest-wins merge of ``new`` into the store, touching only the years it covers.

    The merged years are staged in a shared folder first: a path cannot be read and
    overwritten by one job, and a lost executor must find its inputs intact.
    """
    span = new.select(F.min("session").alias("a"), F.max("session").alias("z")).first()
    if span is None or span["a"] is None:
        return
    touched = read_store(spark, path).filter(
        F.year("session").between(span["a"].year, span["z"].year)
    )
    upsert_bars(touched, new).write.mode("overwrite").parquet(staging)
    write_bars(spark.read.parquet(staging), path)


def ignore_known(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``new`` whose key the journal does not hold yet, one per key."""
    return new.join(existing.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys))


def replace_known(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The journal after a re-mark: new rows replace old ones with the same key."""
    kept = existing.join(new.select(*keys), list(keys), "left_anti")
    return kept.unionByName(new)


def append_journal(spark: SparkSession, root: str, table: str, rows: DataFrame) -> None:
    """Append to a journal table, skipping keys it already holds."""
    path = f"{root}/{table}"
    keys = JOURNAL_KEYS.get(table)
    typed = rows.select(
        *[
            F.col(f.name).cast(f.dataType).alias(f.name)
            for f in spark.createDataFrame([], JOURNAL_SCHEMAS[table]).schema
        ]
    )
    if keys is not None:
        existing = read_journal(spark, root, table)
        typed = ignore_known(existing, typed, keys)
    typed.write.mode("append").option("compression", "zstd").parquet(path)


def read_journal(spark: SparkSession, root: str, table: str) -> DataFrame:
    schema = JOURNAL_SCHEMAS[table]
    try:
        return spark.read.schema(schema).parquet(f"{root}/{table}")
    except Exception as exc:  # noqa: BLE001 - an absent table is an empty one
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        return spark.createDataFrame([], schema)
