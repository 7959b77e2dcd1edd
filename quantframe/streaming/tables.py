"""Durable tables for micro-batch jobs, merged in levels.

A micro-batch writes one segment. When ``fanout`` segments of a level lie side by side they are
merged into one of the next level, so after n batches a reader opens at most
``(fanout - 1) * log(n)`` segments, and a row is rewritten once a level. How rows merge is the
table's own: sums add up, the newest version of a key stays, distinct rows stay once.

Everything is idempotent. A segment is named by the batches it covers and overwritten when one
of them is replayed. What a merge made superfluous stays until a later batch begins, as only
then the merging one is known to be committed.

A table may be bucketed by an expression over its columns: a reader that knows the buckets it
needs opens only their files. Paths come from the folder that the caller names; on a cluster
that is the shared folder of the session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.session import scratch_folder  # noqa: F401 - re-exported for jobs
from quantframe.sources.folders import children, complete, remove

FANOUT, BUCKETS = 8, 16
#: Tasks that may share the writing of one bucket; adaptive execution joins small ones.
WRITERS = 16
Merge = Callable[[DataFrame], DataFrame]


def newest(*keys: str) -> Merge:
    """The version of the latest batch of each key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        version = F.struct("batch", *rest)
        return (
            rows.groupBy(*keys)
            .agg(F.max_by(version, "batch").alias("__v"))
            .select(*keys, *[F.col(f"__v.{c}").alias(c) for c in (*rest, "batch")])
        )

    return merge


def summed(*keys: str) -> Merge:
    """All other columns added up by key."""

    def merge(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in (*keys, "batch")]
        return rows.groupBy(*keys).agg(
            *[F.sum(c).alias(c) for c in rest], F.max("batch").alias("batch")
        )

    return merge


def distinct(rows: DataFrame) -> DataFrame:
    """Equal rows once, as of the first batch they came in."""
    rest = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*rest).agg(F.min("batch").alias("batch"))


def together(rows: DataFrame) -> DataFrame:
    """Every row, as it came."""
    return rows


def hash_bucket(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


class LevelledTable:
    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: str,
        merge: Merge,
        *,
        bucket: Column | None = None,
        fanout: int = FANOUT,
    ):
        self.spark, self.path, self.merge, self.fanout = spark, path.rstrip("/"), merge, fanout
        self.bucketed, self.bucket = bucket is not None, F.lit(0) if bucket is None else bucket
        self.columns = spark.createDataFrame([], schema).columns
        self.schema = f"{schema}, batch bigint, bucket int"

    # ------------------------------------------------------------ segments

    def _name(self, first: int, last: int) -> str:
        return f"{self.path}/{first:012d}-{last:012d}"

    def _segments(self) -> dict[int, list[int]]:
        """By first batch, the last batches of the complete segments that begin there."""
        found: dict[int, list[int]] = {}
        for name in children(self.spark, self.path):
            if complete(self.spark, f"{self.path}/{name}"):
                first, last = map(int, name.split("-"))
                found.setdefault(first, []).append(last)
        return found

    def cover(self, before: int | None = None) -> list[tuple[int, int]]:
        """The fewest segments that hold the batches, in order."""
        found = self._segments()
        out: list[tuple[int, int]] = []
        for first in sorted(found):
            ends = [e for e in found[first] if before is None or e < before]
            if ends and (not out or first > out[-1][1]):
                out.append((first, max(ends)))
        return out

    def _write(self, rows: DataFrame, first: int, last: int) -> None:
        held = rows.select(*self.columns, "batch", self.bucket.alias("bucket"))
        if self.bucketed:
            # Rows of a bucket come together, but no bucket is one task's.
            part = F.pmod(F.xxhash64(*self.columns), F.lit(WRITERS))
            held = held.repartition("bucket", part)
        held.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(
            self._name(first, last)
        )

    def _read(self, parts: Iterable[tuple[int, int]], buckets: Sequence[int] | None) -> DataFrame:
        paths = [self._name(*p) for p in parts]
        if not paths:
            return self.spark.createDataFrame([], self.schema).drop("bucket")
        rows = self.spark.read.schema(self.schema).parquet(paths[0])
        for path in paths[1:]:
            rows = rows.unionByName(self.spark.read.schema(self.schema).parquet(path))
        if buckets is not None:
            rows = rows.filter(F.col("bucket").isin(*buckets))
        return rows.drop("bucket")

    # ------------------------------------------------------------ use

    def write(self, df: DataFrame, batch_id: int) -> None:
        """Store a batch's rows and merge the levels that it fills."""
        live = set(self.cover(batch_id))
        for name in children(self.spark, self.path):
            first, last = map(int, name.split("-"))
            if last < batch_id and (first, last) not in live:
                remove(self.spark, f"{self.path}/{name}")
        self._write(df.withColumn("batch", F.lit(batch_id).cast("bigint")), batch_id, batch_id)
        size = self.fanout
        while (batch_id + 1) % size == 0:
            first = batch_id + 1 - size
            parts = [p for p in self.cover(batch_id + 1) if p[0] >= first]
            if len(parts) > 1:
                self._write(self.merge(self._read(parts, None)), first, batch_id)
            size *= self.fanout

    def rows(self, before: int | None = None, buckets: Sequence[int] | None = None) -> DataFrame:
        """Merged rows with the batch they stem from, optionally only of earlier batches and of
        some buckets."""
        return self.merge(self._read(self.cover(before), buckets))

    def rows_of(self, keys: DataFrame, before: int) -> DataFrame:
        """Merged rows that share the keys, from the files of their buckets. The table's bucket
        must be an expression over the key columns."""
        names = keys.columns
        asked = keys.distinct()
        buckets = [r[0] for r in asked.select(self.bucket).distinct().collect()]
        same = F.expr(" and ".join(f"r.{c} <=> k.{c}" for c in names))
        held = self._read(self.cover(before), buckets).alias("r")
        return self.merge(held.join(asked.alias("k"), same, "left_semi"))

    def of_batch(self, batch_id: int) -> DataFrame:
        """The rows that a batch wrote, before it is merged away."""
        return self._read([(batch_id, batch_id)], None)


def run_available(writer, checkpoint: str) -> None:
    """Process everything that has arrived since the checkpoint, then stop."""
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
