"""Bar store whose manifest knows the key range of every file.

Files are sorted by year, symbol and session, so each covers a narrow range. The manifest of a
version lists the files that make it up with their ranges; a read opens only files whose range
meets what is asked, and a merge rewrites only those that hold a key of a changed row. Files are
never changed: a merge writes new ones and a new manifest, and readers of an older version go on
undisturbed until :meth:`RangedStore.vacuum`. Every row carries the version that last changed
it, which makes the store a feed of changes as well (see ``provider``).

A store has one writer at a time. A job that dies leaves files that no manifest names; the next
one of the same version overwrites them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators.bars import upsert_bars
from quantframe.session import shared_at
from quantframe.sources.folders import children, complete, remove

COLUMNS = ("symbol", "session", "open", "high", "low", "close", "volume")
BARS = (
    "symbol string, session date, open double, high double, low double, close double, volume double"
)
STORED = f"{BARS}, changed int"
FILES = (
    "file string, year int, first_symbol string, last_symbol string, first_session date,"
    " last_session date, newest int, rows bigint"
)
ROWS_PER_FILE = 4_000_000


class RangedStore:
    def __init__(self, spark: SparkSession, path: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.path, self.rows_per_file = spark, path.rstrip("/"), rows_per_file

    def version(self) -> int:
        """The newest complete version, 0 for an empty store."""
        held = [n for n in children(self.spark, f"{self.path}/manifest") if n.startswith("v=")]
        for name in reversed(held):
            if complete(self.spark, f"{self.path}/manifest/{name}"):
                return int(name[2:])
        return 0

    def files(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if version == 0:
            return self.spark.createDataFrame([], FILES)
        return self.spark.read.schema(FILES).parquet(f"{self.path}/manifest/v={version:08d}")

    def read(
        self,
        *,
        symbols: Sequence[str] | None = None,
        first: date | None = None,
        last: date | None = None,
        version: int | None = None,
    ) -> DataFrame:
        """Bars of a version, from the files whose range meets the bounds."""
        listed, bounds = self.files(version), F.lit(True)
        if symbols is not None:
            listed = listed.filter(F.col("first_symbol") <= max(symbols, default=""))
            listed = listed.filter(F.col("last_symbol") >= min(symbols, default=""))
            bounds &= F.col("symbol").isin(*symbols)
        if first is not None:
            listed = listed.filter(F.col("last_session") >= F.lit(first))
            bounds &= F.col("session") >= F.lit(first)
        if last is not None:
            listed = listed.filter(F.col("first_session") <= F.lit(last))
            bounds &= F.col("session") <= F.lit(last)
        return self._rows([r["file"] for r in listed.collect()]).filter(bounds).select(*COLUMNS)

    def _rows(self, files: Sequence[str]) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*files)

    def _holding(self, rows: DataFrame, listed: DataFrame) -> list[str]:
        """The files in whose range a key of ``rows`` lies."""
        keys = rows.select("symbol", "session", F.year("session").alias("year")).distinct()
        inside = F.col("symbol").between(F.col("first_symbol"), F.col("last_symbol")) & F.col(
            "session"
        ).between(F.col("first_session"), F.col("last_session"))
        found = keys.join(listed, "year").filter(inside).select("file").distinct()
        return [r["file"] for r in found.collect()]

    def _write(self, rows: DataFrame, version: int) -> DataFrame:
        """Write a version's new files and return their ranges."""
        order = ["year", "symbol", "session"]
        folder = f"{self.path}/data/v={version:08d}"
        (
            rows.withColumn("year", F.year("session"))
            .repartitionByRange(*order)
            .sortWithinPartitions(*order)
            .write.mode("overwrite")
            .option("compression", "zstd")
            .option("maxRecordsPerFile", self.rows_per_file)
            .partitionBy("year")
            .parquet(folder)
        )
        return (
            self.spark.read.schema(f"{STORED}, year int")
            .parquet(folder)
            .groupBy(F.col("_metadata.file_path").alias("file"), "year")
            .agg(
                F.min("symbol").alias("first_symbol"),
                F.max("symbol").alias("last_symbol"),
                F.min("session").alias("first_session"),
                F.max("session").alias("last_session"),
                F.max("changed").alias("newest"),
                F.count("*").alias("rows"),
            )
        )

    def upsert(self, new: DataFrame) -> list[str]:
        """Merge rows by (symbol, session), the new one winning; the files that were rewritten.

        Rows that the store holds as they are change nothing: a re-sync of an unchanged week
        makes no version. ``new`` is read once.
        """
        version = self.version() + 1
        listed = self.files(version - 1)
        came, discard_came = shared_at(new.select(*COLUMNS), "bars-new")
        same = F.expr(" and ".join(f"n.{c} <=> s.{c}" for c in COLUMNS))
        stored = self._rows(self._holding(came, listed))
        changed, discard = shared_at(
            came.alias("n")
            .join(stored.alias("s"), (F.col("n.symbol") == F.col("s.symbol")) & same, "left_anti")
            .withColumn("changed", F.lit(version)),
            "bars-changed",
        )
        discard_came()
        touched: list[str] = []
        if not changed.isEmpty():
            touched = self._holding(changed, listed)
            written = self._write(upsert_bars(self._rows(touched), changed), version)
            kept = listed.filter(~F.col("file").isin(*touched)) if touched else listed
            kept.unionByName(written).select(*[c.split()[0] for c in FILES.split(", ")]).coalesce(
                1
            ).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version:08d}")
        discard()
        return touched

    def vacuum(self) -> None:
        """Remove what the newest version does not need: older manifests and unnamed files."""
        version = self.version()
        named = self.files(version).select("file").collect()
        live = {tuple(r["file"].rsplit("/", 3)[1:]) for r in named}
        for name in children(self.spark, f"{self.path}/manifest"):
            if name != f"v={version:08d}":
                remove(self.spark, f"{self.path}/manifest/{name}")
        for generation in children(self.spark, f"{self.path}/data"):
            for year in children(self.spark, f"{self.path}/data/{generation}"):
                folder = f"{self.path}/data/{generation}/{year}"
                for name in children(self.spark, folder) if year.startswith("year=") else ():
                    if (generation, year, name) not in live:
                        remove(self.spark, f"{folder}/{name}")
