"""Hand-made edge cases, one operator at a time."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from quantframe.functions import quantize_cash, round_to_lot, safe_div
from quantframe.operators import allocation, bootstrap, costs, ledger, live, metrics, quality
from quantframe.operators import calendars as cal
from quantframe.operators import bars as bar_ops
from quantframe.operators import futures, pairs, screens, signals, sizing
from quantframe.operators.asof import asof_join, unknown_rates
from quantframe.operators.quantiles import exact_quantile
from quantframe.operators.scan import block_scan
from quantframe.sources import dimensions, gates, rates, statement, store

D = dt.date


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def test_money_rounds_half_even_and_lots_toward_zero(spark, rows):
    df = spark.createDataFrame(
        [("0.125", 7.9, 0.0), ("0.135", -7.9, 2.0), ("-0.125", 0.4, 4.0)], "x string, q double, d double"
    )
    out = df.select(
        quantize_cash(F.col("x").cast("decimal(18,4)")).cast("string").alias("c"),
        round_to_lot("q").alias("l"),
        safe_div(F.lit(8.0), "d", -1.0).alias("r"),
    )
    assert [tuple(r) for r in out.collect()] == [
        ("0.12", 7.0, -1.0),
        ("0.14", -7.0, 4.0),
        ("-0.12", 0.0, 2.0),
    ]


def test_tied_scores_share_the_mean_rank(spark, rows):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 1.0), (1, "c", 2.0), (1, "d", None)], "g int, symbol string, v double"
    )
    ranked = signals.average_rank(df, ["g"], "v")
    assert rows(ranked, "symbol", "rank") == [("a", 2.5), ("b", 2.5), ("c", 4.0), ("d", 1.0)]


def test_one_symbol_has_no_score(spark):
    df = spark.createDataFrame([(D(2020, 1, 2), "a", 3, 1.0)], "session date, symbol string, months int, rank double")
    assert signals.blended_score(df).count() == 0


def test_flat_series_takes_no_inverse_vol_weight(spark, rows):
    df = spark.createDataFrame([(1, "a", 0.1), (1, "b", 0.3), (1, "c", 0.0)], "g int, symbol string, vol double")
    assert rows(sizing.inverse_vol_weights(df, ["g"]), "symbol", "weight") == [("a", 0.75), ("b", 0.25)]


def test_book_risk_equals_the_full_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    r = rng.normal(0, 0.01, (60, 4)) + rng.normal(0, 0.008, (60, 1))
    weights = np.array([0.4, 0.3, 0.2, 0.1])
    history = [(f"s{j}", i + 2, float(r[i, j])) for i in range(60) for j in range(4)]
    returns = spark.createDataFrame(history, "symbol string, n int, ret double")
    members = spark.createDataFrame(
        [("b", f"s{j}", 61, 60, float(weights[j])) for j in range(4)],
        "book string, symbol string, n int, length int, weight double",
    )
    got = sizing.book_risk(members, returns, ["book"]).first()
    cov = np.cov(r.T)
    sd = np.sqrt(np.diag(cov))
    corr = cov / np.outer(sd, sd)
    mean = corr[~np.eye(4, dtype=bool)].mean()
    blend = 0.75 * corr + 0.25 * mean
    np.fill_diagonal(blend, 1.0)
    shrunk = blend * np.outer(sd, sd)
    vol = np.sqrt(weights @ shrunk @ weights * 252)
    assert got["volatility"] == pytest.approx(vol, rel=1e-9)
    assert got["mean_correlation"] == pytest.approx(mean, rel=1e-9)
    assert got["diversification"] == pytest.approx((weights * sd).sum() * np.sqrt(252) / vol, rel=1e-9)


def test_all_cash_differs_from_no_opinion(spark, rows):
    sized = spark.createDataFrame(
        [("x", "a", 0.5, False), ("x", "b", 0.5, False), ("y", "a", 0.6, True)],
        "book string, symbol string, weight double, passing boolean",
    )
    out = sizing.cap_and_cash(sized, ["book"], "CASH")
    assert rows(out, "book", "symbol", "weight") == [
        ("x", "CASH", 1.0),
        ("y", "CASH", 0.65),
        ("y", "a", 0.35),
    ]


def test_asof_sees_the_exact_instant_unless_told_otherwise(spark):
    left = spark.createDataFrame([("a", D(2020, 1, 5)), ("a", D(2020, 3, 1)), ("b", D(2020, 1, 1))], "k string, d date")
    right = spark.createDataFrame([("a", D(2020, 1, 5), 1.0), ("a", D(2020, 2, 1), 2.0)], "k string, at date, v double")
    exact = {(r.k, r.d): r.v for r in asof_join(left, right, ["k"], "d", "at", ["v"]).collect()}
    before = {
        (r.k, r.d): r.v
        for r in asof_join(left, right, ["k"], "d", "at", ["v"], allow_exact=False).collect()
    }
    assert exact == {("a", D(2020, 1, 5)): 1.0, ("a", D(2020, 3, 1)): 2.0, ("b", D(2020, 1, 1)): None}
    assert before[("a", D(2020, 1, 5))] is None and before[("a", D(2020, 3, 1))] == 2.0


def test_a_rate_published_later_cannot_price_an_earlier_day(spark):
    nav = spark.createDataFrame([(D(2020, 1, 1),), (D(2020, 2, 1),)], "session date")
    curve = spark.createDataFrame([(D(2020, 1, 15), 0.02)], "date date, annual_rate double")
    assert [r.session for r in unknown_rates(nav, curve, "session").collect()] == [D(2020, 1, 1)]
    with pytest.raises(ValueError):
        gates.assert_clean(unknown_rates(nav, curve, "session"), "rates")


def test_duplicate_rate_dates_are_reported(spark):
    curve = spark.createDataFrame([(D(2020, 1, 1), 0.01), (D(2020, 1, 1), 0.02)], "date date, annual_rate double")
    assert rates.rate_violations(curve).count() == 1


def test_rates_file_fails_fast(spark, tmp_path):
    good, bad = tmp_path / "good.csv", tmp_path / "bad.csv"
    good.write_text("date,annual_rate\n2020-01-01,0.01\n")
    bad.write_text("date,annual_rate\n2020-01-01,abc\n")
    assert rates.load_rates(spark, str(good)).count() == 1
    with pytest.raises(Exception):  # noqa: B017
        rates.load_rates(spark, str(bad)).collect()


def test_block_scan_equals_one_window(spark):
    from pyspark.sql import Window

    df = spark.range(5000).selectExpr(
        "id % 3 as k", "date_add(date'2020-01-01', cast(id / 100 as int)) as day", "id",
        "case when id % 7 = 0 then id end as v",
    )
    got = block_scan(df, ["k"], "day", ["id"], {"s": ("sum", F.col("v")), "l": ("last", F.col("v")), "m": ("max", F.col("v"))})
    w = Window.partitionBy("k").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("k", "day", "id", "v", F.sum("v").over(w).alias("s"), F.last("v", True).over(w).alias("l"), F.max("v").over(w).alias("m"))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


@pytest.mark.parametrize("p", [0.0, 0.1, 0.5, 0.975, 1.0])
def test_exact_quantile_matches_numpy(spark, p):
    import numpy as np

    values = np.concatenate([np.random.default_rng(1).normal(0, 5, 999), np.zeros(40), [1e-9, -1e9]])
    df = spark.createDataFrame([(float(v),) for v in values], "x double").withColumn("g", F.lit(1))
    got = exact_quantile(df, ["g"], "x", p).first()["quantile"]
    assert got == pytest.approx(np.quantile(values, p), rel=1e-12, abs=1e-12)


# ---------------------------------------------------------------- ledger


def fill_frame(spark, trades):
    rows = [
        ("p", "a", dt.datetime(2020, 1, 1) + dt.timedelta(hours=i), D(2020, 1, 1) + dt.timedelta(days=i // 24), float(q), float(px), float(c), i)
        for i, (q, px, c) in enumerate(trades)
    ]
    return spark.createDataFrame(
        rows,
        "portfolio string, symbol string, ts timestamp, session date, quantity double,"
        " price double, commission double, execution_id long",
    )


def walk(trades):
    """Average cost one fill at a time."""
    q = avg = realized = paid = 0.0
    for dq, px, c in trades:
        paid += c
        if q == 0 or (q > 0) == (dq > 0):
            avg = (abs(q) * avg + abs(dq) * px) / (abs(q) + abs(dq))
        else:
            closed = min(abs(dq), abs(q))
            realized += closed * (px - avg) * (1 if q > 0 else -1)
            if abs(dq) > abs(q):
                avg = px
        q += dq
        if q == 0:
            avg = 0.0
    return q, avg, realized, paid


def test_flip_through_zero(spark):
    trades = [(10, 100, 1), (10, 110, 1), (-5, 120, 1), (-25, 90, 1)]
    got = ledger.positions(fill_frame(spark, trades)).first()
    assert (got.quantity, got.avg_cost, got.realized, got.commission) == (-10, 90, -150, 4)


def test_positions_match_a_walk_on_random_books(spark):
    import random

    rng = random.Random(5)
    books = []
    for k in range(12):
        n = rng.randint(1, 60)
        books.append(
            [
                (rng.choice([-1, 1]) * rng.randint(1, 500), round(rng.uniform(1, 5000), 2), round(rng.uniform(0, 10), 2))
                for _ in range(n)
            ]
        )
    frames = None
    for k, trades in enumerate(books):
        one = fill_frame(spark, trades).withColumn("portfolio", F.lit(f"p{k:02d}"))
        frames = one if frames is None else frames.unionByName(one)
    got = {r.portfolio: r for r in ledger.positions(frames).collect()}
    for k, trades in enumerate(books):
        q, avg, realized, paid = walk(trades)
        r = got[f"p{k:02d}"]
        assert r.quantity == q
        assert r.avg_cost == pytest.approx(avg, rel=1e-9)
        assert r.realized == pytest.approx(realized, rel=1e-9, abs=1e-6)
        assert r.commission == pytest.approx(paid)
        # NAV identity at the last price: cash plus holdings equals the P&L split.
        last = trades[-1][1]
        cash = sum(-dq * px for dq, px, _ in trades)
        assert cash + q * last == pytest.approx(realized + q * (last - avg), rel=1e-9, abs=1e-5)


def test_small_chunks_compose(spark, monkeypatch):
    monkeypatch.setattr(ledger, "CHUNK", 4)
    trades = [((-1) ** (i // 5) * (i % 7 + 1), 50 + i % 11, 0.5) for i in range(200)]
    got = ledger.positions(fill_frame(spark, trades)).first()
    q, avg, realized, paid = walk(trades)
    assert got.quantity == q and got.fills == 200
    assert got.avg_cost == pytest.approx(avg) and got.realized == pytest.approx(realized)


# ---------------------------------------------------------------- metrics


def curve(spark, values, start=D(2020, 1, 1)):
    return spark.createDataFrame(
        [("p", d, float(v)) for d, v in zip(days(start, len(values)), values, strict=True)],
        "portfolio string, session date, nav double",
    )


def test_equal_highs_restart_the_peak_and_open_drawdowns_run_to_the_end(spark):
    nav = curve(spark, [100, 90, 100, 100, 80, 85])
    got = [(r.peak, r.trough, r.recovery, r.open) for r in metrics.drawdown_episodes(nav).orderBy("peak").collect()]
    d = days(D(2020, 1, 1), 6)
    assert got == [(d[0], d[1], d[2], False), (d[3], d[4], None, True)]
    assert metrics.performance(nav).first()["longest_drawdown_days"] == 2


def test_one_session_years_are_left_out(spark):
    nav = curve(spark, [100, 101, 102], D(2020, 12, 30)).unionByName(curve(spark, [103], D(2022, 1, 3)))
    assert [r.year for r in metrics.by_calendar_year(nav).collect()] == [2020]


def test_flat_curve_has_zero_ratios(spark):
    r = metrics.performance(curve(spark, [100, 100, 100])).first()
    assert (r.sharpe, r.sortino, r.calmar, r.max_drawdown) == (0.0, 0.0, 0.0, 0.0)


def test_drawdown_halt_and_non_positive_nav(spark, rows):
    marks = curve(spark, [100, 76, 74, -1])
    assert [r.halted for r in allocation.drawdown_halt(marks).orderBy("session").collect()] == [False, False, True, True]


# ---------------------------------------------------------------- rebalancing


def rebalance(spark, targets, held, price=100.0, nav=10000.0):
    t = spark.createDataFrame([("p", D(2020, 1, 1), s, w) for s, w in targets], "portfolio string, as_of date, symbol string, weight double")
    h = spark.createDataFrame([("p", D(2020, 1, 1), s, q) for s, q in held], "portfolio string, as_of date, symbol string, quantity double")
    m = spark.createDataFrame([("p", D(2020, 1, 1), nav)], "portfolio string, as_of date, nav double")
    px = spark.createDataFrame([(D(2020, 1, 1), s, price) for s in "abc"], "as_of date, symbol string, close double")
    i = spark.createDataFrame([(s, 1.0) for s in "abc"], "symbol string, lot_size double")
    return {r.symbol: r.delta for r in allocation.rebalance_orders(t, h, m, px, i).collect()}


def test_inside_the_band_nothing_trades_and_a_breach_moves_everything(spark):
    assert rebalance(spark, [("a", 0.5), ("b", 0.5)], [("a", 55.0), ("b", 45.0)]) == {}
    assert rebalance(spark, [("a", 0.5), ("b", 0.4)], [("a", 55.0), ("b", 30.0)]) == {"a": -5.0, "b": 10.0}


def test_abandoned_positions_always_close(spark):
    assert rebalance(spark, [("a", 0.5)], [("a", 50.0), ("c", 0.5)], price=100.0) == {}
    assert rebalance(spark, [("a", 0.5)], [("a", 50.0), ("c", 3.0)]) == {"c": -3.0}


def test_small_notional_is_skipped(spark):
    assert rebalance(spark, [("a", 0.009)], [("b", 1.0)], price=95.0) == {"b": -1.0}


def test_limits_apply_to_the_book_left_by_predecessors(spark):
    key = ("p", D(2020, 1, 1))
    orders = spark.createDataFrame(
        [(*key, i, s, q, 100.0) for i, (s, q) in enumerate([("a", 30.0), ("b", 30.0), ("a", 10.0), ("c", 45.0), ("b", -20.0)])],
        "portfolio string, as_of date, seq int, symbol string, quantity double, price double",
    )
    held = spark.createDataFrame([(*key, "z", 10.0, 100.0)], "portfolio string, as_of date, symbol string, quantity double, price double")
    marks = spark.createDataFrame([(*key, 10000.0)], "portfolio string, as_of date, nav double")
    out = allocation.limit_filter(orders, held, marks, max_weight=0.35, max_gross=1.0).orderBy("seq")
    assert [(r.seq, r.reason) for r in out.collect()] == [
        (0, None), (1, None), (2, "weight cap"), (3, "weight cap"), (4, None),
    ]


def test_gross_budget_skips_and_continues(spark):
    df = spark.createDataFrame(
        [(D(2020, 1, 1), "a", 3.0, 0.4), (D(2020, 1, 1), "b", 2.0, 0.3), (D(2020, 1, 1), "c", 1.0, 0.2)],
        "session date, pair string, strength double, gross double",
    )
    got = {r.pair: r.admitted for r in allocation.gross_budget(df, budget=0.6).collect()}
    assert got == {"a": True, "b": False, "c": True}


# ---------------------------------------------------------------- futures, live, quality, sources


def chain_rows(volumes, last=(D(2020, 1, 15), D(2020, 2, 14))):
    out = []
    for i, (front, nxt) in enumerate(volumes):
        d = D(2020, 1, 6) + dt.timedelta(days=i)
        for name, v, lt, px in (("F1", front, last[0], -10.0), ("F2", nxt, last[1], 200.0)):
            out.append(("m", name, d, px, px + 1, px - 1, px, float(v), lt, 50.0))
    return out


CHAIN = (
    "market string, contract string, session date, open double, high double, low double,"
    " close double, volume double, last_trade date, multiplier double"
)


def test_volume_roll_acts_next_session(spark):
    chain = spark.createDataFrame(chain_rows([(9, 1), (5, 6), (9, 1)], (D(2020, 3, 15), D(2020, 6, 15))), CHAIN)
    got = [(r.contract, r.roll_reason) for r in futures.roll_map(chain).orderBy("session").collect()]
    assert got == [("F1", "initial"), ("F1", "hold"), ("F2", "volume")]


def test_expiry_roll_acts_at_the_cutoff(spark):
    chain = spark.createDataFrame(chain_rows([(9, 1), (9, 1), (9, 1), (9, 1)]), CHAIN)
    got = [(r.contract, r.roll_reason) for r in futures.roll_map(chain).orderBy("session").collect()]
    assert got == [("F1", "initial"), ("F1", "hold"), ("F2", "expiry"), ("F2", "hold")]


def test_negative_futures_prices_are_legal_but_bad_ranges_are_not(spark):
    rows_ = chain_rows([(9, 1)])
    assert gates.chain_violations(spark.createDataFrame(rows_, CHAIN)).count() == 0
    broken = [list(rows_[0]), list(rows_[1])]
    broken[0][5] = 5.0
    kinds = {r.kind for r in gates.chain_violations(spark.createDataFrame([tuple(b) for b in broken], CHAIN)).collect()}
    assert "low above high" in kinds


def test_interval_match_needs_uniqueness_both_ways(spark):
    t0 = dt.datetime(2020, 1, 10)
    h = dt.timedelta(hours=1)
    orders = spark.createDataFrame(
        [("o1", "a", 1.0, t0), ("o2", "b", 1.0, t0), ("o3", "b", 1.0, t0 + h), ("o4", "c", 2.0, t0), ("o5", "d", 1.0, t0)],
        "order_id string, symbol string, quantity double, created_at timestamp",
    )
    trades = spark.createDataFrame(
        [(1, "a", 1.0, t0 + 5 * h), (2, "b", 1.0, t0 + 5 * h), (3, "c", 2.0, t0), (4, "d", 1.0, t0 + 96 * h), (5, "a", 1.0, t0 + 200 * h)],
        "trade_id long, symbol string, quantity double, ts timestamp",
    )
    got = {r.trade_id: (r.status, r.order_id) for r in live.match_orders_to_trades(orders, trades).collect()}
    assert got == {
        1: ("matched", "o1"), 2: ("ambiguous", None), 3: ("unmatched", None),
        4: ("unmatched", None), 5: ("unmatched", None),
    }


def test_interval_match_counts_instants_and_leaves_rows_without_key_or_instant(spark):
    t0 = dt.datetime(2020, 1, 10)
    h = dt.timedelta(hours=1)
    orders = spark.createDataFrame(
        [(f"o{i}", "a", 1.0, t0) for i in range(50)] + [("n", None, 1.0, t0), ("m", "b", 1.0, None), ("c", "c", 1.0, t0)],
        "order_id string, symbol string, quantity double, created_at timestamp",
    )
    trades = spark.createDataFrame(
        [(i, "a", 1.0, t0 + h) for i in range(40)] + [(90, None, 1.0, t0 + h), (91, "b", 1.0, None), (92, "c", 1.0, t0 + h)],
        "trade_id long, symbol string, quantity double, ts timestamp",
    )
    counts = live.interval_counts(orders, trades)
    assert counts.count() == 4  # a row a side and instant, however many rows fall on it
    got = sorted(tuple(r) for r in live.match_orders_to_trades(orders, trades).collect())
    assert got[:40] == [(i, None, 50, "ambiguous") for i in range(40)]
    assert got[40:] == [(90, None, 0, "unmatched"), (91, None, 0, "unmatched"), (92, "c", 1, "matched")]


def test_streak_alerts_once_per_outage(spark):
    flags = [1, 1, 1, 1, 0, 0, 1, 1, 0, 1, 1, 1]
    runs = spark.createDataFrame(
        [("u", dt.datetime(2020, 1, 1) + dt.timedelta(hours=9 * i), i, bool(f)) for i, f in enumerate(flags)],
        "user string, ts timestamp, id int, bad boolean",
    )
    got = [r.event for r in live.failure_streaks(runs, "user", "ts", F.col("bad"), "id").orderBy("id").collect()]
    assert got == ["ok", "ok", "alert", "ok", "recovered", "ok", "ok", "ok", "ok", "ok", "ok", "alert"]


def test_redaction(spark):
    text = "acct DU123456 mail a.b@x.org https://hc-ping.com/ab-1/fail ghp_abcdefghijklmnop password= hunter2, ok"
    got = spark.createDataFrame([(text,)], "t string").select(live.redact_text("t", ["ok"]).alias("r")).first().r
    assert got == "acct [ACCOUNT] mail [EMAIL] [HEALTHCHECK_URL] [TOKEN] password= [REDACTED], [REDACTED]"


def test_flat_run_of_five(spark):
    closes = [1, 2, 2, 2, 2, 2, 2, 3]
    bars = spark.createDataFrame([("a", d, float(c)) for d, c in zip(days(D(2020, 1, 1), 8), closes, strict=True)], "symbol string, session date, close double")
    assert quality.flatlines(bars).first()["longest"] == 5


def test_business_days(spark):
    df = spark.createDataFrame([(D(2020, 1, 12),), (D(2020, 1, 13),), (D(2020, 1, 17),)], "d date")
    assert [r[0] for r in df.select(cal.business_days_before("d", 1)).collect()] == [D(2020, 1, 10), D(2020, 1, 10), D(2020, 1, 16)]
    assert df.select(cal.business_days_before("d", 7)).collect()[0][0] == D(2020, 1, 2)


def test_weekly_holiday_falls_back_to_the_session_before(spark):
    cal_days = [d for d in days(D(2020, 1, 6), 14) if d.weekday() < 5 and d != D(2020, 1, 10)]
    df = spark.createDataFrame([(d,) for d in cal_days], "session date")
    got = sorted(r.session for r in cal.weekly(cal.number_sessions(df), 4).collect())
    assert got == [D(2020, 1, 9), D(2020, 1, 17)]


def test_statement_reads_sections_in_parallel_lines(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text(
        "Statement,Header,Field Name,Field Value\n"
        'Statement,Data,Period,"January 1, 2024 - January 31, 2024"\n'
        "Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee\n"
        'Trades,Data,Order,Stocks,USD,AAA,"2024-01-16, 09:30:00","1,200",10.5,-12600,-1.25\n'
        "Cash Report,Header,Currency Summary,Currency,Total\n"
        'Cash Report,Data,Starting Cash,USD,"1,000.50"\n'
        "Open Positions,Header,DataDiscriminator,Asset Category,Currency,Symbol,Quantity\n"
        "Open Positions,Data,Summary,Stocks,USD,AAA,1200\n"
    )
    found = statement.sectioned(statement.read_lines(spark, str(path)))
    trade = statement.trades(found).first()
    assert (trade.symbol, trade.quantity, trade.price, trade.commission) == ("AAA", 1200.0, 10.5, 1.25)
    assert trade.ts == dt.datetime(2024, 1, 16, 14, 30)
    assert statement.trade_violations(statement.trades(found)).count() == 0
    assert statement.cash_report(found).first().amount == 1000.5
    assert statement.open_positions(found).first().quantity == 1200.0
    assert statement.period_end(found).first().coverage_end == D(2024, 1, 31)


def test_store_merges_only_touched_years(spark, tmp_path):
    path, staging = str(tmp_path / "bars"), str(tmp_path / "staging")
    make = lambda items: spark.createDataFrame(
        [("a", d, c, c, c, c, 1.0) for d, c in items],
        "symbol string, session date, open double, high double, low double, close double, volume double",
    )
    store.write_bars(make([(D(2019, 12, 31), 1.0), (D(2020, 1, 2), 2.0)]), path)
    store.merge_into_store(spark, path, make([(D(2020, 1, 2), 9.0), (D(2020, 1, 3), 3.0)]), staging)
    got = sorted((r.session, r.close) for r in store.read_store(spark, path).collect())
    assert got == [(D(2019, 12, 31), 1.0), (D(2020, 1, 2), 9.0), (D(2020, 1, 3), 3.0)]


def test_journal_append_is_idempotent(spark, tmp_path):
    rows_ = spark.createDataFrame([("o1", "p", dt.datetime(2020, 1, 1), "a", 1.0, "")], "order_id string, portfolio string, created_at timestamp, symbol string, quantity double, reason string")
    for _ in range(2):
        store.append_journal(spark, str(tmp_path), "orders", rows_)
    assert store.read_journal(spark, str(tmp_path), "orders").count() == 1


def test_named_dimensions(spark):
    assert gates.assert_clean(dimensions.instrument_violations(dimensions.instruments(spark)), "dims") is None
    per = {r.universe: r["count"] for r in dimensions.universes(spark).groupBy("universe").count().collect()}
    assert per == {"core": 12, "core+crypto": 14, "sectors": 9}


# ---------------------------------------------------------------- statistics


def test_bootstrap_is_reproducible_and_brackets_the_point(spark):
    import numpy as np

    r = np.random.default_rng(7).normal(0.0006, 0.01, 400)
    df = spark.createDataFrame([("p", d, float(x)) for d, x in zip(days(D(2020, 1, 1), 400), r, strict=True)], "portfolio string, session date, ret double")
    a = bootstrap.sharpe_interval(df, draws=300).first()
    assert a == bootstrap.sharpe_interval(df, draws=300).first()
    assert a.low < a.point < a.high
    assert a.point == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5)


def test_more_trials_raise_the_bar(spark):
    from statistics import NormalDist

    import numpy as np

    r = np.random.default_rng(2).normal(0.001, 0.01, 500)
    df = spark.createDataFrame([("p", float(x)) for x in r], "portfolio string, ret double")
    out = screens.deflated_sharpe(screens.moments(df, ["portfolio"]), (2, 100, 1000), F.lit(0.02)).orderBy("trials").collect()
    assert [x.expected_maximum for x in out] == sorted(x.expected_maximum for x in out)
    assert [x.probability for x in out] == sorted((x.probability for x in out), reverse=True)
    s = r.mean() / r.std(ddof=1)
    z = (r - r.mean()) / r.std(ddof=1)
    g = 0.5772156649015329
    n = NormalDist()
    top = 0.02 * ((1 - g) * n.inv_cdf(1 - 1 / 100) + g * n.inv_cdf(1 - 1 / (100 * np.e)))
    var = 1 - (z**3).mean() * s + ((z**4).mean() - 1) / 4 * s * s
    want = n.cdf((s - top) * np.sqrt(len(r) - 1) / np.sqrt(var))
    assert out[1].probability == pytest.approx(want, rel=1e-9)


def test_pair_statistics_match_least_squares(spark):
    import numpy as np

    rng = np.random.default_rng(11)
    right = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 300)))
    left = 5 * right**0.8 * np.exp(rng.normal(0, 0.01, 300))
    panel = spark.createDataFrame(
        [("x", d, float(a), float(b)) for d, a, b in zip(days(D(2020, 1, 1), 300), left, right, strict=True)],
        "pair string, session date, left_close double, right_close double",
    )
    got = pairs.pair_signals(panel).orderBy(F.col("session").desc()).first()
    l, r = np.log(left), np.log(right)
    tl, tr = l[-253:-1], r[-253:-1]
    beta, alpha = np.polyfit(tr, tl, 1)
    e = tl - alpha - beta * tr
    assert got.beta == pytest.approx(beta, rel=1e-8)
    assert got.zscore == pytest.approx((l[-1] - alpha - beta * r[-1]) / e.std(ddof=1), rel=1e-6)
    x, y = e[:-1], np.diff(e)
    g, c = np.polyfit(x, y, 1)
    res = y - c - g * x
    se = np.sqrt(res @ res / (len(y) - 2) / ((x - x.mean()) @ (x - x.mean())))
    assert got.adf_t == pytest.approx(g / se, rel=1e-6)


def test_cost_floor_and_adverse_prices(spark):
    df = spark.createDataFrame([(10.0, 100.0), (-1000.0, 100.0), (0.0, 100.0)], "q double, px double")
    out = df.select(costs.commission("q", "px").cast("double").alias("c"), costs.fill_price("px", "q", F.lit(10.0)).alias("f")).collect()
    assert [r.c for r in out] == [0.35, 3.5, 0.0]
    assert out[0].f > 100 > out[1].f


def test_bar_reasons_ignore_float_noise(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 1.0, 1.0, 1.0 + 1e-14, 1.0), ("b", 1.0, 0.9, 1.0, 1.0, 1.0), ("c", 1.0, 1.0, -1.0, 1.0, 1.0)],
        "symbol string, open double, high double, low double, close double, volume double",
    )
    good, bad = bar_ops.validate_bar_rows(df)
    assert [r.symbol for r in good.collect()] == ["a"] and bad.count() == 2


# --- keys and widths at scale -----------------------------------------------------------------


def test_row_keys_stay_ordered_and_distinct_for_large_tables(spark):
    from quantframe.sources.testdata import ROW_KEY

    rows = [(10**9, 7, 5, 1), (10**9, 7, 5, 2), (10**9, 8, 1, 1), (10**14, 10**10, 10**10, 7), (1, 10**10, 1, 1)]
    lines = spark.createDataFrame(
        rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"
    ).selectExpr("*", f"{ROW_KEY} as k")
    ordered = [tuple(r)[:4] for r in lines.orderBy("k").collect()]
    assert ordered == sorted(rows)
    assert lines.select("k").distinct().count() == len(rows)


def test_fingerprint_sums_beyond_bigint(spark):
    from quantframe.sources.gates import fingerprint

    one = fingerprint(spark.createDataFrame([("a", 1)], "g string, x int"), [F.col("x").cast("string")], ["g"])
    assert dict(one.dtypes)["fingerprint"].startswith("decimal(38")


def test_statement_lines_are_split_once(spark):
    from quantframe.sources import statement

    rows = [
        ("f", 0, "Trades,Header,DataDiscriminator,Symbol,Quantity"),
        ("f", 1, 'Trades,Data,Order,"S ""1"", x","1,200"'),
        ("f", 2, "Trades,Data,Order,S2"),
        ("f", 3, "Trades,Header,DataDiscriminator,Quantity,Symbol,Symbol"),
        ("f", 4, "Trades,Data,Order,5,S4"),
    ]
    lines = spark.createDataFrame(rows, "file string, pos long, line string")
    found = statement.trades(statement.sectioned(lines)).select("pos", "symbol", "quantity")
    assert sorted(map(tuple, found.collect())) == [(1, 'S "1", x', 1200.0), (2, "S2", None), (4, "S4", 5.0)]
    # Once for data rows; headers are split where the newest is found and where it stands.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Generate explode\(array\(transform\(regexp_extract_all", plan)) == 1
    assert not re.search(r"Filter.*regexp_extract_all", plan)


def test_statement_rows_of_any_width(spark):
    from quantframe.sources.statement import sectioned

    names = [f"N{i}" for i in range(60)]
    lines = [
        ("f", 0, "Trades,Header," + ",".join(names)),
        ("f", 1, "Trades,Data," + ",".join(f'"v, ""{i}"""' if i % 2 else str(i) for i in range(60))),
        ("f", 2, "Trades,Data," + "," * 58 + "last"),
    ]
    out = sectioned(spark.createDataFrame(lines, "file string, pos long, line string")).orderBy("pos").collect()
    assert out[0]["values"]["N59"] == 'v, "59"' and out[0]["values"]["N58"] == "58"
    assert out[1]["values"] == {"N58": "last"}


def test_upsert_ties_do_not_depend_on_order(spark):
    from quantframe.operators.bars import upsert_bars

    schema = "symbol string, session date, open double, close double"
    import datetime as dt

    day = dt.date(2020, 1, 2)
    old = spark.createDataFrame([("S", day, 9.0, 9.0)], schema)
    new = [("S", day, 1.0, 2.0), ("S", day, 1.0, 3.0)]
    for rows in (new, new[::-1]):
        got = upsert_bars(old, spark.createDataFrame(rows, schema)).collect()
        assert [tuple(r) for r in got] == [("S", day, 1.0, 3.0)]


def test_session_gate_by_key(spark):
    from quantframe.sources.gates import session_violations

    bars = spark.createDataFrame(
        [("A", 1, 1.0, 1.0), ("A", 2, 1.0, 1.0), ("B", 1, 1.0, None), ("B", 9, 1.0, 1.0)],
        "symbol string, session int, open double, close double",
    )
    days = spark.createDataFrame([(1,), (2,)], "session int")
    got = {tuple(r) for r in session_violations(bars, days, keys=("symbol",)).collect()}
    assert got == {("B", 2, "missing session"), ("B", 9, "extra session"), ("B", 1, "missing price")}


def test_normal_functions_match_the_standard_library(spark):
    from statistics import NormalDist

    from quantframe.functions.normal import normal_cdf, normal_ppf

    xs = [-40.0, -8.5, -7.2, -3.0, -1e-9, 0.0, 0.3, 2.0, 7.0, 7.5, 40.0]
    ps = [1e-300, 1e-20, 1e-9, 0.01, 0.074, 0.3, 0.5, 0.926, 0.99, 1 - 1e-12]
    out = spark.createDataFrame([(x,) for x in xs], "x double").select("x", normal_cdf("x").alias("y")).collect()
    assert all(r["y"] == pytest.approx(NormalDist().cdf(r["x"]), rel=1e-9, abs=1e-14) for r in out)
    out = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_ppf("p").alias("y")).collect()
    assert all(r["y"] == pytest.approx(NormalDist().inv_cdf(r["p"]), rel=1e-12) for r in out)
    edges = spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(normal_ppf("p").alias("y"))
    assert [r["y"] for r in edges.collect()] == [None] * 3


def roll_by_walking(chain, cutoff_days=5):
    """The roll map of one market, session by session."""
    order = sorted({(c["last_trade"], c["contract"]) for c in chain})
    cutoffs = []
    for last, _ in order:
        day, left = last, cutoff_days
        while day.weekday() > 4:
            day -= dt.timedelta(days=1)
            left = left if day.weekday() > 4 else left - 1
        while left:
            day -= dt.timedelta(days=1)
            left -= day.weekday() < 5
        cutoffs.append(day)
    volume = {(c["session"], c["contract"]): c["volume"] for c in chain}
    days = sorted({c["session"] for c in chain})
    i, wait, out = sum(last < days[0] for last, _ in order), False, []
    for n, day in enumerate(days):
        rolled = wait and i + 1 < len(order)
        i += rolled
        expired = day >= cutoffs[i] and i + 1 < len(order)
        i += expired
        wait = wait and not rolled and not expired
        here = volume.get((day, order[i][1]))
        after = volume.get((day, order[i + 1][1])) if i + 1 < len(order) else None
        if here is not None and after is not None:
            wait = after > here
        reason = "initial" if n == 0 else "expiry" if expired else "volume" if rolled else "hold"
        out.append((day, order[i][1], reason))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_roll_map_by_composed_years_equals_the_walk(spark, seed):
    import random

    from quantframe.operators import futures

    rnd = random.Random(seed)
    rows = []
    for market in "MN":
        lasts = sorted({dt.date(2018, 1, 10) + dt.timedelta(days=rnd.randint(0, 1500)) for _ in range(14)})
        for k in range(0, 1500, rnd.choice([1, 3, 40])):
            day = dt.date(2018, 1, 1) + dt.timedelta(days=k)
            for j, last in enumerate(lasts):
                if rnd.random() < 0.5:
                    rows.append((market, f"{market}{j:02d}", day, last, float(rnd.randint(1, 9)), 50.0))
    chain = spark.createDataFrame(
        rows, "market string, contract string, session date, last_trade date, volume double, multiplier double"
    )
    got = futures.roll_map(chain).collect()
    for market in "MN":
        mine = sorted((r.session, r.contract, r.roll_reason) for r in got if r.market == market)
        own = [r.asDict() for r in chain.filter(F.col("market") == market).collect()]
        assert mine == roll_by_walking(own)


def test_missing_sessions_name_five_and_count_the_rest(spark):
    from quantframe.operators import quality

    days = [("A", dt.date(2020, 1, d)) for d in range(1, 9)] + [("B", dt.date(2020, 1, 1))]
    got = {r.symbol: r for r in quality.missing_issues(spark.createDataFrame(days, "symbol string, session date")).collect()}
    assert got["A"].detail.endswith("2020-01-05 (+3 more)") and got["A"].severity == "error"
    assert got["B"].detail == "1 absent: 2020-01-01" and got["B"].severity == "warn"


def test_a_candidate_that_does_not_fit_is_skipped(spark):
    from quantframe.operators import allocation

    rows = [(1, "a", 3.0, 0.3), (1, "b", 2.0, 0.2), (1, "c", 1.0, 0.1), (2, "a", 1.0, 0.5)]
    df = spark.createDataFrame(rows, "session int, pair string, strength double, gross double")
    got = {(r.session, r.pair): r.admitted for r in allocation.gross_budget(df, budget=0.4).collect()}
    assert got == {(1, "a"): True, (1, "b"): False, (1, "c"): True, (2, "a"): False}


def test_stale_up_to_the_calendars_last_session(spark):
    from quantframe.operators import calendars

    days = spark.createDataFrame([(dt.date(2020, 1, d),) for d in (2, 3, 6, 7, 8)], "session date")
    newest = days.filter("session <= '2020-01-03'")
    assert [(r.behind, r.fresh) for r in calendars.staleness(newest, days, tolerance=2).collect()] == [(3, False)]
    assert [r.behind for r in calendars.staleness(newest, days, F.lit("2020-01-06").cast("date")).collect()] == [1]
