"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.session import shared, shared_at

__all__ = ["documents", "free_name", "meets", "read", "shared", "text_words", "whole_files", "written"]

#: Rows of whole texts that a Python worker gets at once.
_ROWS = 2_500


def written(df: DataFrame, name: str) -> tuple[DataFrame, Callable[[], None]]:
    """:func:`shared_at`; the write's shuffle files go at its end, as the table takes their place,
    and not when the driver happens to collect its garbage. Its Python workers get fewer rows at
    once."""
    conf = df.sparkSession.conf
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    most = int(conf.get(rows))
    own = {
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
        rows: str(min(most, _ROWS) if most > 0 else _ROWS),
    }
    before = {k: conf.get(k, None) for k in own}
    try:
        for k, v in own.items():
            conf.set(k, v)
        return shared_at(df, name)
    finally:
        for k, v in before.items():
            if v is None:
                conf.unset(k)
            else:
                conf.set(k, v)


def whole_files(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most so many small rows in as many parts as they fill, for a table that is
    written again and again."""
    return df.coalesce(rows // 200_000 + 1)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """What the per-text queries read: the whole table, two columns."""
    return read(spark, folder, "documents").select(F.col("doc_id").cast("bigint"), "text")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column has that name (case ignored)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def text_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes split on exactly those six characters."""
    return (text or "").encode().split()


def meets(spans: Iterable[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch (start, end) shares a character with any of ``spans``: a search among
    their starts, whatever their number and order."""
    spans = sorted(spans)
    starts, reach = [s for s, _ in spans], list(accumulate((e for _, e in spans), max))

    def test(start: int, end: int) -> bool:
        before = bisect_left(starts, end)
        return before > 0 and reach[before - 1] > start

    return test
