"""Streams over several files: restarts, late data, repeats and conflicts."""

import datetime as dt
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quantframe.operators import ledger, live
from quantframe.streaming import jobs, tables

SCHEMA = (
    "portfolio string, symbol string, ts timestamp, session date, quantity double, price double,"
    " commission double, slippage double, order_id string, execution_id bigint"
)


def fills(spark, ids, *, price=0.0):
    rows = []
    for i in ids:
        ts = dt.datetime(2020, 1, 1) + dt.timedelta(hours=7 * i)
        q = float((i % 5 + 1) * (-1 if i % 3 == 0 else 1))
        rows.append((f"p{i % 2}", "ab"[i % 2], ts, ts.date(), q, 50.0 + i % 11 + price, 0.5, 0.1, f"o{i}", i))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def feed(spark, tmp_path):
    folder = str(tmp_path / "in")

    def drop(df):
        df.coalesce(1).write.mode("append").parquet(folder)

    def stream():
        return jobs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)

    return drop, stream, str(tmp_path / "out")


def test_positions_survive_a_restart(spark, feed, rows):
    drop, stream, out = feed
    drop(fills(spark, range(0, 30)))
    jobs.run_positions(stream(), out)
    drop(fills(spark, range(30, 45)))
    drop(fills(spark, range(45, 60)))
    got = jobs.run_positions(stream(), out)
    want = ledger.positions(fills(spark, range(60)))
    cols = ("portfolio", "symbol", "quantity", "avg_cost", "realized", "commission", "fills")
    assert rows(got, *cols) == rows(want, *cols)
    assert rows(jobs.run_positions(stream(), out), *cols) == rows(want, *cols)


def test_a_late_fill_re_marks_its_session(spark, feed, rows):
    drop, stream, out = feed
    drop(fills(spark, [0, 1, 2, 40, 41]))
    jobs.run_session_marks(stream(), out)
    drop(fills(spark, [3, 42]))
    got = jobs.run_session_marks(stream(), out)
    value = F.col("quantity") * F.col("price")
    want = fills(spark, [0, 1, 2, 3, 40, 41, 42]).groupBy("portfolio", "session").agg(
        F.count(F.lit(1)).alias("fills"), F.sum(F.abs(value)).alias("traded")
    )
    cols = ("portfolio", "session", "fills", "traded")
    assert rows(got, *cols) == rows(want, *cols)


@pytest.mark.parametrize("cut", [True, False])
def test_repeats_are_ignored_and_conflicts_set_aside(spark, feed, cut):
    drop, stream, out = feed
    parts = [fills(spark, range(10)), fills(spark, [3, 4]), fills(spark, [5], price=1.0)]
    if cut:
        drop(parts[0])
        jobs.run_ingest(stream(), out)
        drop(parts[1])
        drop(parts[2])
    else:
        drop(parts[0].union(parts[1]).union(parts[2]))
    archived, conflicts = jobs.run_ingest(stream(), out)
    assert sorted(int(r.execution_id) for r in archived.collect()) == [0, 1, 2, 3, 4, 6, 7, 8, 9]
    got = sorted((int(r.execution_id), r.price, r.slippage) for r in conflicts.collect())
    assert got == [(5, 55.0, 0.1), (5, 56.0, 0.1)]


def test_collapse_over_files_equals_the_batch(spark, feed, rows):
    drop, stream, out = feed
    drop(fills(spark, range(0, 12)))
    drop(fills(spark, range(12, 24)))
    got = jobs.run_collapse(stream(), out)
    want = live.collapse_fills(fills(spark, range(24)), ["portfolio"])
    cols = ("portfolio", "session", "symbol", "buying", "quantity", "price", "pieces")
    assert rows(got, *cols) == rows(want, *cols)


def test_streak_state_crosses_batches(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "user_id long, ts timestamp, event_id long, bad boolean"
    flags = [1, 1, 1, 1, 0, 1, 1, 1]

    def drop(span):
        data = [(1, dt.datetime(2020, 1, 1, i), i, bool(flags[i])) for i in span]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(folder)

    def run():
        events = jobs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema)
        return jobs.run_streaks(events, F.col("bad"), out)

    drop(range(0, 2))
    run()
    drop(range(2, 8))
    got = [r.event for r in run().orderBy("event_id").collect()]
    assert got == ["ok", "ok", "alert", "ok", "recovered", "ok", "ok", "alert"]


@pytest.mark.parametrize("cuts", [(12, 24), (5, 9, 24)])
def test_collapse_counts_late_fills_at_any_cut(spark, feed, rows, cuts):
    drop, stream, out = feed
    late, rest = range(0, 3), range(3, 24)
    start = 3
    for end in cuts:
        drop(fills(spark, range(start, end)))
        start = end
    drop(fills(spark, range(200, 210)))
    jobs.run_collapse(stream(), out)
    drop(fills(spark, late))
    got = jobs.run_collapse(stream(), out)
    want = live.collapse_fills(fills(spark, [*late, *rest, *range(200, 210)]), ["portfolio"])
    columns = ["portfolio", "session", "symbol", "quantity", "price", "commission"]
    assert rows(got, *columns) == rows(want, *columns)


SIDES = {
    "order": "symbol string, quantity double, order_id string, created_at timestamp",
    "trade": "symbol string, quantity double, trade_id bigint, ts timestamp",
}


def day(n):
    return None if n is None else dt.datetime(2020, 1, 1) + dt.timedelta(days=n)


def matcher(spark, tmp_path, per_batch=1):
    """(drop rows of a side into its folder, run the job over what has come)."""

    def stream(side):
        return jobs.file_stream(
            spark, str(tmp_path / side), "*.parquet", spark.createDataFrame([], SIDES[side]).schema,
            files_per_batch=per_batch,
        )

    def drop(side, rows):
        spark.createDataFrame(rows, SIDES[side]).coalesce(1).write.mode("append").parquet(
            str(tmp_path / side)
        )

    return drop, lambda: jobs.run_match(stream("order"), stream("trade"), str(tmp_path / "out"))


@pytest.mark.parametrize("per_batch", [1, 100])
def test_matches_do_not_depend_on_lateness_or_cuts(spark, tmp_path, per_batch):
    drop, run = matcher(spark, tmp_path, per_batch)
    # Days of the orders and trades that arrive in turn; the last ones are weeks late.
    arrivals = [([0], [1]), ([40], [41]), ([5, 20], []), ([], [8]), ([10], [13.5, 14])]
    for orders, trades in arrivals:
        drop("order", [("a", 1.0, f"o{d}", day(d)) for d in orders])
        drop("trade", [("a", 1.0, int(d * 10), day(d)) for d in trades])
        if per_batch == 1:
            run()
    trades, orders = run()
    got = sorted((r.order_id, r.trade_id, r.status) for r in orders.collect())
    assert got == [
        ("o0", 10, "matched"), ("o10", 135, "matched"), ("o20", None, "unmatched"),
        ("o40", 410, "matched"), ("o5", 80, "matched"),
    ]
    assert sorted((r.trade_id, r.status) for r in trades.collect()) == [
        (10, "matched"), (80, "matched"), (135, "matched"), (140, "unmatched"), (410, "matched"),
    ]


@pytest.mark.parametrize("cuts", [[80], [30, 55, 80]])
def test_the_stream_of_matches_equals_the_batch(spark, tmp_path, cuts):
    rnd = random.Random(7)
    pick = lambda: (rnd.choice([*"ab", None]), rnd.choice([1.0, 2.0]))
    orders = [(*pick(), f"o{i}", day(rnd.uniform(0, 90))) for i in range(79)] + [("a", 1.0, "o79", None)]
    trades = [(*pick(), i, day(rnd.uniform(0, 90))) for i in range(79)] + [("a", 1.0, 79, None)]
    rnd.shuffle(orders)
    rnd.shuffle(trades)
    drop, run = matcher(spark, tmp_path)
    start = 0
    for end in cuts:
        drop("order", orders[start:end])
        drop("trade", trades[start:end])
        trades_now, _ = run()
        start = end
        want = live.match_orders_to_trades(
            spark.createDataFrame(orders[:end], SIDES["order"]),
            spark.createDataFrame(trades[:end], SIDES["trade"]),
        )
        columns = ["trade_id", "order_id", "candidates", "status"]
        expected = {tuple(r) for r in want.select(*columns).collect()}
        assert {tuple(r) for r in trades_now.select(*columns).collect()} == expected
    assert {s for *_, s in expected} == {"matched", "ambiguous", "unmatched"}


def test_a_second_order_makes_an_old_match_ambiguous(spark, tmp_path):
    drop, run = matcher(spark, tmp_path)
    drop("order", [("a", 1.0, "o1", day(1))])
    drop("trade", [("a", 1.0, 1, day(3))])
    assert [r.status for r in run()[0].collect()] == ["matched"]
    drop("order", [("a", 1.0, "o2", day(2)), ("b", 1.0, "o3", day(2))])
    drop("trade", [])
    trades, orders = run()
    assert [(r.status, r.candidates) for r in trades.collect()] == [("ambiguous", 2)]
    assert sorted((r.order_id, r.status) for r in orders.collect()) == [
        ("o1", "ambiguous"), ("o2", "ambiguous"), ("o3", "unmatched"),
    ]


def test_no_job_caches_a_batch(spark, feed, tmp_path, monkeypatch):
    """A cached batch has one partition for a file of one row group, which one task reads."""
    kind = type(spark.range(0))
    held, persist = [], kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, *a: held.append(df.columns) or persist(df, *a))
    drop, run = matcher(spark, tmp_path / "match")
    drop("order", [("a", 1.0, "o1", day(1))])
    drop("trade", [("a", 1.0, 1, day(3))])
    assert [r.status for r in run()[0].collect()] == ["matched"]
    drop, stream, out = feed
    drop(fills(spark, range(10)))
    jobs.run_positions(stream(), f"{out}/positions").collect()
    events = stream().selectExpr("execution_id as user_id", "ts", "execution_id as event_id")
    jobs.run_streaks(events, F.col("event_id") > 0, f"{out}/streaks").collect()
    made = {"block", "candidates", "streak"}
    assert held and all(made & set(columns) for columns in held)


# Streaks of many users


@pytest.mark.parametrize("cuts", [[600], [250, 251, 600]])
def test_streaks_equal_the_batch_though_one_user_has_a_third(spark, tmp_path, cuts):
    rnd = random.Random(3)
    schema = "user_id long, ts timestamp, event_id long, bad boolean"
    rows = [
        (0 if i % 3 == 0 else rnd.randint(1, 40), day(i / 200), i, rnd.random() < 0.7) for i in range(600)
    ]
    folder, start = str(tmp_path / "in"), 0
    for end in cuts:
        spark.createDataFrame(rows[start:end], schema).coalesce(1).write.mode("append").parquet(folder)
        start = end
        events = jobs.file_stream(spark, folder, "*.parquet", spark.createDataFrame([], schema).schema)
        got = jobs.run_streaks(events, F.col("bad"), str(tmp_path / "out"))
    want = live.failure_streaks(
        spark.createDataFrame(rows, schema), "user_id", "ts", F.col("bad"), "event_id"
    )
    columns = ["user_id", "event_id", "failed", "streak", "event"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(
        map(tuple, want.select(*columns).collect())
    )
    assert {r.event for r in got.collect()} == {"ok", "alert", "recovered"}
    assert "Pandas" not in want._jdf.queryExecution().toString()


@pytest.mark.parametrize("cuts", [(60,), (1, 2, 31, 60)])
def test_positions_equal_the_fold_at_any_cut(spark, feed, rows, cuts):
    drop, stream, out = feed
    start = 0
    for end in cuts:
        drop(fills(spark, range(start, end)))
        start = end
        got = jobs.run_positions(stream(), out)
    cols = ("portfolio", "symbol", "quantity", "avg_cost", "realized", "commission", "fills")
    assert rows(got, *cols) == rows(ledger.positions(fills(spark, range(60))), *cols)


# Levelled tables


def opened(table):
    return len(table.cover())


def test_files_read_stay_logarithmic_in_batches(spark, tmp_path):
    table = tables.LevelledTable(spark, str(tmp_path / "t"), "k int, n bigint", tables.summed("k"), fanout=4)
    one = spark.createDataFrame([(1, 1)], "k int, n bigint").coalesce(1).persist()
    most = 0
    for batch in range(200):
        table.write(one, batch)
        if batch % 20 == 19 or batch in (62, 63, 64):
            most = max(most, opened(table))
            assert [(r.k, r.n, r.batch) for r in table.rows().collect()] == [(1, batch + 1, batch)]
    assert most <= 3 * 4  # three of each of the levels 1, 4, 16 and 64
    assert len(os.listdir(tmp_path / "t")) <= 3 * 4 + 5


@pytest.mark.parametrize("batch", [6, 7, 8])
def test_a_replayed_batch_changes_nothing(spark, tmp_path, batch):
    def write(table, n):
        table.write(spark.createDataFrame([(n % 3, n), (3, n)], "k int, n bigint"), n)

    table = tables.LevelledTable(
        spark, str(tmp_path / "t"), "k int, n bigint", tables.newest("k"),
        bucket=tables.hash_bucket("k", buckets=2), fanout=2,
    )
    for n in range(batch + 1):
        write(table, n)
    want = sorted(map(tuple, table.rows().collect()))
    assert want == sorted([(n % 3, n, n) for n in range(batch - 2, batch + 1)] + [(3, batch, batch)])
    before = sorted(map(tuple, table.rows(batch).collect()))
    write(table, batch)
    assert sorted(map(tuple, table.rows().collect())) == want
    assert sorted(map(tuple, table.rows(batch).collect())) == before
    # A merge that died leaves a folder without its mark of success; the replay makes it anew.
    for name in os.listdir(tmp_path / "t"):
        if name.endswith(f"-{batch:012d}"):
            os.remove(tmp_path / "t" / name / "_SUCCESS")
    assert sorted(map(tuple, table.rows().collect())) == before
    write(table, batch)
    assert sorted(map(tuple, table.rows().collect())) == want


def test_only_the_buckets_of_the_keys_are_read(spark, tmp_path):
    table = tables.LevelledTable(
        spark, str(tmp_path / "t"), "k int, n bigint", tables.newest("k"),
        bucket=tables.hash_bucket("k", buckets=8),
    )
    table.write(spark.range(200).selectExpr("cast(id as int) as k", "id as n"), 0)
    held = table.rows_of(spark.createDataFrame([(5,), (None,)], "k int"), 1)
    assert [(r.k, r.n) for r in held.collect()] == [(5, 5)]
    plan = table._read([(0, 0)], [3])._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[isnotnull\(bucket#\d+\), \(bucket#\d+ = 3\)\]", plan)


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("bucket", [None, "k % 2"])
def test_no_bucket_is_written_by_one_task(spark, tmp_path, bucket, adaptive):
    table = tables.LevelledTable(
        spark, str(tmp_path / "t"), "k bigint, n bigint", tables.together,
        bucket=None if bucket is None else F.expr(f"cast({bucket} as int)"),
    )
    held = {
        "spark.sql.adaptive.enabled": adaptive,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k",
    }
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        table.write(spark.range(40_000).selectExpr("id as k", "id * 7 as n").repartition(4), 0)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    for name in os.listdir(tmp_path / "t" / f"{0:012d}-{0:012d}"):
        if name.startswith("bucket="):
            files = os.listdir(tmp_path / "t" / f"{0:012d}-{0:012d}" / name)
            assert len([f for f in files if f.endswith(".parquet")]) > 1
    assert table.rows().count() == 40_000
