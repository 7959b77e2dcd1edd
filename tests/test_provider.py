"""The ranged store, price providers behind Spark, and the restricted feeds."""

import datetime as dt
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quantframe.sources import provider
from quantframe.sources.feeds import ExecutionFeed, HistoricalFeed
from quantframe.sources.ranged import RangedStore
from quantframe.streaming import jobs

DAY = dt.date(2019, 12, 2)
SCHEMA = "symbol string, session date, open double, high double, low double, close double, volume double"


def bars(spark, symbols, days, close=10.0):
    rows = [
        (s, DAY + dt.timedelta(days=d), close - 1, close + 2, close - 2, close + d, 100.0 + d)
        for s in symbols
        for d in days
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    kept = RangedStore(spark, str(tmp_path / "store"), rows_per_file=20)
    kept.upsert(bars(spark, "ABCD", range(60)))
    return kept


def seen(df, *columns):
    return sorted(map(tuple, df.select(*(columns or df.columns)).collect()), key=str)


def test_a_read_opens_only_files_whose_range_meets_it(spark, store):
    assert store.files().count() == 12  # 30 days of each year, four symbols, 20 rows a file
    one = store.read(symbols=["B"], first=dt.date(2020, 1, 10))
    assert len(one.inputFiles()) < 4
    want = bars(spark, "B", range(60)).filter(F.col("session") >= F.lit(dt.date(2020, 1, 10)))
    assert seen(one) == seen(want)
    assert store.read(symbols=[]).count() == 0
    assert store.read(symbols=["Z"]).count() == 0
    assert seen(store.read()) == seen(bars(spark, "ABCD", range(60)))


def test_a_week_re_synced_rewrites_only_the_files_it_touches(spark, store):
    before = {r["file"] for r in store.files().collect()}
    week = range(40, 47)
    touched = store.upsert(bars(spark, "B", week, close=50.0))
    assert touched and all("year=2020" in f for f in touched) and len(touched) <= 2
    assert before - {r["file"] for r in store.files().collect()} == set(touched)
    want = bars(spark, "ACD", range(60)).union(
        bars(spark, "B", [d for d in range(60) if d not in week])
    ).union(bars(spark, "B", week, close=50.0))
    assert seen(store.read()) == seen(want)
    # The older version still reads as it was, until it is cleared away.
    assert seen(store.read(version=1)) == seen(bars(spark, "ABCD", range(60)))
    store.vacuum()
    assert seen(store.read()) == seen(want)
    assert not any(os.path.exists(f.removeprefix("file:")) for f in touched)


def test_an_unchanged_re_sync_makes_no_version(spark, store):
    assert store.upsert(bars(spark, "AB", range(5, 12))) == []
    assert store.version() == 1
    store.upsert(bars(spark, "E", range(3)))  # a new symbol touches nothing
    assert store.version() == 2 and store.read(symbols=["E"]).count() == 3


def test_a_write_that_died_is_overwritten(spark, store):
    bars(spark, "A", [1]).write.parquet(f"{store.path}/data/v=00000002/year=2019")
    os.makedirs(f"{store.path}/manifest/v=00000002")
    assert store.version() == 1
    store.upsert(bars(spark, "A", [1], close=7.0))
    assert store.version() == 2 and store.read().count() == 240


def test_bounds_go_to_the_provider_and_rule_out_partitions(spark, store):
    where = "symbol = 'C' and session >= date'2020-01-01' and session < date'2020-01-15' and volume > 133"
    asked = provider.provider_bars(spark, where=where, path=store.path)
    explain = spark._jvm.PythonSQLUtils.explainString
    plan = explain(asked._jdf.queryExecution(), "formatted")
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(symbol,C)" in pushed and "LessThan(session,2020-01-15)" in pushed
    assert "volume" not in pushed
    whole = provider.provider_bars(spark, path=store.path)
    assert whole.rdd.getNumPartitions() == 12
    assert asked.rdd.getNumPartitions() <= 2
    assert seen(asked) == seen(bars(spark, "ABCD", range(60)).filter(where))
    few = provider.provider_bars(spark, ["session", "close"], path=store.path)
    assert few.columns == ["session", "close"] and few.count() == 240


@pytest.mark.parametrize(
    "condition",
    [
        "symbol in ('A', 'D')", "symbol in ('A', null)", "symbol = 'A' and symbol = 'B'", "session = '2019-12-05'",
        "session > '2020-01-20'", "session <= '2019-12-03'", "symbol <=> 'A'", "symbol = 'A' or session = '2019-12-05'",
        "session <> '2019-12-05'", "symbol is null", "session between '2020-02-01' and '2020-01-01'", "close > 60",
    ],
)
def test_filters_select_the_same_rows_as_spark(spark, store, condition):
    want = seen(bars(spark, "ABCD", range(60)).filter(condition))
    assert seen(provider.provider_bars(spark, where=condition, path=store.path)) == want
    assert seen(provider.provider_bars(spark, path=store.path).filter(condition)) == want


@pytest.mark.parametrize("where", [None, "symbol in ('A', 'B', 'C', 'D')"])
def test_one_frame_serves_several_filters(spark, store, where):
    whole, want = provider.provider_bars(spark, where=where, path=store.path), bars(spark, "ABCD", range(60))
    first, second = "symbol = 'A' and session < '2020-01-01'", "symbol = 'C'"
    assert seen(whole.filter(first)) == seen(want.filter(first))
    assert seen(whole.filter(second)) == seen(want.filter(second))
    assert seen(whole) == seen(want)
    both = whole.filter(first).unionByName(whole.filter(second))
    assert seen(both) == seen(want.filter(first).unionByName(want.filter(second)))


def test_the_stream_brings_additions_and_restatements_once(spark, store, tmp_path):
    out = str(tmp_path / "out")

    def run():
        stream = provider.provider_stream(spark, path=store.path)
        return jobs.run_bars(stream, out)

    assert run().count() == 240
    store.upsert(bars(spark, "B", range(40, 47), close=50.0))
    store.upsert(bars(spark, "E", range(2)))
    changed = provider.BarStreamReader({"path": store.path}, spark.createDataFrame([], SCHEMA).schema)
    rows = [
        b.num_rows
        for split in changed.partitions({"version": 1}, {"version": 3})
        for b in changed.read(split)
    ]
    assert sum(rows) == 7 + 2
    assert changed.partitions({"version": 3}, {"version": 3}) == []
    assert seen(run()) == seen(store.read())
    assert seen(run()) == seen(store.read())


def test_an_empty_store_is_an_empty_table(spark, tmp_path):
    empty = RangedStore(spark, str(tmp_path / "none"))
    assert empty.read().count() == 0 and empty.upsert(bars(spark, "", [])) == []
    assert provider.provider_bars(spark, path=empty.path).count() == 0


class TwoPages:
    """A provider that is no store: what an outside vendor would be."""

    def __init__(self, options):
        self.base = float(options["base"])

    def version(self):
        return 1

    def splits(self, ask):
        return [s for s in ("X", "Y") if ask.symbols is None or s in ask.symbols]

    def fetch(self, split, ask, columns):
        row = {"symbol": split, "session": DAY, "close": self.base, "open": 1.0, "high": 1.0, "low": 1.0, "volume": 0.0}
        schema = pa.schema([("session", pa.date32())])
        yield pa.RecordBatch.from_arrays(
            [pa.array([row[c]], schema.field(c).type if c in schema.names else None) for c in columns], list(columns)
        )


def test_any_provider_can_stand_behind_the_source(spark):
    options = {"provider": "tests.test_provider:TwoPages", "base": "5"}
    df = provider.provider_bars(spark, ["symbol", "session", "close"], **options)
    assert seen(df) == [("X", DAY, 5.0), ("Y", DAY, 5.0)]
    one = provider.provider_bars(spark, ["symbol", "session", "close"], "symbol = 'Y'", **options)
    assert seen(one) == [("Y", DAY, 5.0)] and one.rdd.getNumPartitions() == 1


def test_feeds_show_only_what_their_reader_may_know(spark):
    known = bars(spark, "AB", range(10))
    feed, venue = HistoricalFeed(known), ExecutionFeed(known)
    cut = DAY + dt.timedelta(days=4)
    assert max(r.session for r in feed.history(as_of=cut).collect()) == cut
    assert feed.history(as_of=cut, count=2, symbols=["A"]).count() == 2
    assert seen(feed.closes(["A"], as_of=cut), "symbol", "close") == [("A", 14.0)]
    assert seen(feed.latest(as_of=cut), "symbol", "session") == [("A", cut), ("B", cut)]
    with pytest.raises(TypeError):
        feed.history()
    orders = spark.createDataFrame([("A", cut), ("A", DAY - dt.timedelta(days=1))], "symbol string, session date")
    assert seen(venue.open_price(orders), "open") == [(9.0,), (None,)]
    assert seen(venue.average_volume(orders, 2), "adv") == [(102.5,), (None,)]
    assert not any("close" in m for m in dir(venue) if not m.startswith("__"))
    assert not hasattr(feed, "bars") and not hasattr(venue, "bars")
