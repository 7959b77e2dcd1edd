"""Price providers as a Spark data source.

A provider says which splits can hold the bars asked for and fetches one split as Arrow batches.
:class:`BarSource` puts any provider behind ``spark.read`` and ``spark.readStream``: each split
is one task, bounds on symbol and session go to the provider instead of a filter above the scan,
a column list limits what is fetched, and a stream hands on the bars that changed since the
version it last saw, restated ones included.

Spark keeps what it pushed to a Python source with the loaded frame: a second use of the frame
with other bounds would be read with the first ones and lose rows. Bounds are therefore pushed
only where :func:`provider_bars` is given them. It loads anew for each call and puts a step on
top that lets no later filter through; a frame loaded without bounds takes none.

:class:`StoreProvider` reads a ``RangedStore``: its manifest rules out files by key range before
a task starts. It opens files in the tasks' Python, so the store must lie where Arrow can reach
it (local and shared folders, HDFS, S3, GCS); through other file systems read the store itself.
"""

from __future__ import annotations

import importlib
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace
from datetime import date, timedelta
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import StructType

from quantframe.sources.ranged import BARS

NAME = "quantframe_bars"


@dataclass(frozen=True)
class Ask:
    """What is wanted of a provider: symbols (all if None), sessions from first to last, and
    only what changed after one version and up to another."""

    symbols: frozenset[str] | None = None
    first: date | None = None
    last: date | None = None
    after: int = 0
    through: int | None = None

    def narrowed(self, f: Filter) -> Ask | None:
        """This with a filter's bound; None if a provider cannot be asked for it."""
        column = getattr(f, "attribute", None)
        if column == ("symbol",) and isinstance(f, (EqualTo, In)):
            named = frozenset(f.value if isinstance(f, In) else [f.value])
            return replace(self, symbols=named if self.symbols is None else self.symbols & named)
        value = getattr(f, "value", None)
        if column != ("session",) or not isinstance(value, date):
            return None
        day = timedelta(days=1)
        first = {EqualTo: value, GreaterThanOrEqual: value, GreaterThan: value + day}.get(type(f))
        last = {EqualTo: value, LessThanOrEqual: value, LessThan: value - day}.get(type(f))
        if first is None and last is None:
            return None
        starts = [d for d in (self.first, first) if d is not None]
        ends = [d for d in (self.last, last) if d is not None]
        return replace(self, first=max(starts, default=None), last=min(ends, default=None))


class PriceProvider(Protocol):
    def version(self) -> int:
        """Of the newest data; it grows whenever a bar is added or restated."""

    def splits(self, ask: Ask) -> Sequence[str]:
        """Names of the parts that may hold what is asked, each to be fetched by one task."""

    def fetch(self, split: str, ask: Ask, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
        """The bars of a part that are asked for, exactly."""


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


class StoreProvider:
    """The bars of a ``RangedStore``."""

    def __init__(self, options: dict[str, str]):
        self.path = options["path"].rstrip("/")

    def version(self) -> int:
        from pyarrow import fs

        system, at = _file_system(self.path)
        found = system.get_file_info(fs.FileSelector(f"{at}/manifest", allow_not_found=True))
        for name in sorted((f.base_name for f in found if f.base_name.startswith("v=")), reverse=True):
            if system.get_file_info(f"{at}/manifest/{name}/_SUCCESS").type != fs.FileType.NotFound:
                return int(name[2:])
        return 0

    def splits(self, ask: Ask) -> list[str]:
        import pyarrow.dataset as ds

        version = ask.through if ask.through is not None else self.version()
        if version == 0:
            return []
        system, at = _file_system(self.path)
        held = ds.dataset(f"{at}/manifest/v={version:08d}", filesystem=system, format="parquet")
        meets = ds.field("newest") > ask.after
        if ask.first is not None:
            meets &= ds.field("last_session") >= ask.first
        if ask.last is not None:
            meets &= ds.field("first_session") <= ask.last
        rows = held.to_table(filter=meets).to_pylist()
        return [
            r["file"]
            for r in rows
            if ask.symbols is None
            or any(r["first_symbol"] <= s <= r["last_symbol"] for s in ask.symbols if s is not None)
        ]

    def fetch(self, split: str, ask: Ask, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        system, at = _file_system(split)
        wanted = ds.field("changed") > ask.after
        if ask.symbols is not None:
            wanted &= ds.field("symbol").isin([s for s in ask.symbols if s is not None])
        if ask.first is not None:
            wanted &= ds.field("session") >= ask.first
        if ask.last is not None:
            wanted &= ds.field("session") <= ask.last
        yield from ds.dataset(at, filesystem=system, format="parquet").to_batches(
            columns=list(columns), filter=wanted
        )


def _provider(options: dict[str, str]) -> PriceProvider:
    """The provider named by the option ``provider`` as ``module:class``, else a store's."""
    named = options.get("provider")
    if named is None:
        return StoreProvider(options)
    module, _, kind = named.partition(":")
    return getattr(importlib.import_module(module), kind)(options)


@dataclass
class Split(InputPartition):
    name: str
    ask: Ask


class _Fetching:
    """What reading in batch and as a stream have in common."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.options, self.columns = dict(options), list(schema.names)

    def read(self, partition: Split | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark asks for where there are no splits
            return
        yield from _provider(self.options).fetch(partition.name, partition.ask, self.columns)

    def _splits(self, ask: Ask) -> list[Split]:
        return [Split(name, ask) for name in _provider(self.options).splits(ask)]


class BarReader(_Fetching, DataSourceReader):
    """Reads everything; filters stay above the scan."""

    def __init__(self, options: dict[str, str], schema: StructType):
        super().__init__(options, schema)
        self.ask = Ask()

    def partitions(self) -> list[Split]:
        return self._splits(self.ask)


class BoundedReader(BarReader):
    """Takes bounds on symbol and session."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            narrowed = self.ask.narrowed(f)
            if narrowed is None:
                yield f
            else:
                self.ask = narrowed


class BarStreamReader(_Fetching, DataSourceStreamReader):
    """Offsets are provider versions."""

    def initialOffset(self) -> dict:
        return {"version": 0}

    def latestOffset(self) -> dict:
        return {"version": _provider(self.options).version()}

    def partitions(self, start: dict, end: dict) -> list[Split]:
        if start["version"] >= end["version"]:
            return []
        return self._splits(Ask(after=start["version"], through=end["version"]))


class BarSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return BARS

    def reader(self, schema: StructType) -> BarReader:
        kind = BoundedReader if self.options.get("bounded") == "true" else BarReader
        return kind(self.options, schema)

    def streamReader(self, schema: StructType) -> BarStreamReader:
        return BarStreamReader(self.options, schema)


def _registered(spark: SparkSession) -> None:
    spark.dataSource.register(BarSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _schema(columns: Sequence[str] | None) -> str:
    held = {c.split()[0]: c for c in BARS.split(", ")}
    return ", ".join(held[c] for c in columns or held)


def provider_bars(
    spark: SparkSession,
    columns: Sequence[str] | None = None,
    where: Column | str | None = None,
    **options: str,
) -> DataFrame:
    """Bars of a provider, those of a condition if there is one.

    The condition's bounds on symbol and session go to the provider. A data source is not told
    which columns a plan uses: name them.
    """
    _registered(spark)
    source = spark.read.format(NAME).schema(_schema(columns)).options(**options)
    if where is None:
        return source.load()
    # Filters do not pass an observation, as they would change what it counts.
    bounded = source.option("bounded", "true").load().filter(where)
    return bounded.observe(f"bars-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))


def provider_stream(spark: SparkSession, columns: Sequence[str] | None = None, **options: str) -> DataFrame:
    """Bars as they are added or restated."""
    _registered(spark)
    return spark.readStream.format(NAME).schema(_schema(columns)).options(**options).load()
