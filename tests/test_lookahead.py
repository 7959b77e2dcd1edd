"""Change the future; the past must not move."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quantframe.operators import bars as bar_ops
from quantframe.operators import metrics, pairs, signals, sizing, trend
from quantframe.plans.momentum import dual_momentum
from quantframe.sources.testdata import Tables

FOLDER = "/root/testdata/sf0.001"
CUT = dt.date(2000, 1, 1)


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, FOLDER)


@pytest.fixture(scope="module")
def history(tables):
    return tables.daily


@pytest.fixture(scope="module")
def altered(history):
    late = F.col("session") > F.lit(CUT)
    return history.select(
        "symbol",
        "session",
        *[F.when(late, F.col(c) * 1.7).otherwise(F.col(c)).alias(c) for c in ("open", "high", "low", "close")],
        "volume",
    )


def same_past(build, a, b):
    left = build(a).filter(F.col("session") <= F.lit(CUT))
    right = build(b).filter(F.col("session") <= F.lit(CUT))
    assert left.count() > 0
    assert left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


PAIR = "select 'x' as pair, 'S00' as left_symbol, 'S01' as right_symbol"

CASES = {
    "momentum": lambda b: signals.momentum(b, (1, 3)),
    "trend": lambda b: signals.trend_filter(b, 50),
    "beta": lambda b: signals.rolling_beta(signals.with_market(signals.log_returns(b)), 60),
    "reversal": lambda b: signals.residual_reversal(signals.with_market(signals.log_returns(b)), 60),
    "horizon": lambda b: trend.trend_features(signals.simple_returns(b), (20, 40)),
    "vol": lambda b: sizing.realised_vol(signals.simple_returns(b)),
    "volume": lambda b: bar_ops.average_volume(b),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_signals_do_not_see_the_future(history, altered, name):
    same_past(CASES[name], history, altered)


def test_pairs_do_not_see_the_future(spark, history, altered):
    build = lambda b: pairs.pair_signals(pairs.pair_panel(b, spark.sql(PAIR)), 60)
    same_past(build, history, altered)


def test_targets_do_not_see_the_future(tables, history, altered):
    from quantframe.operators.calendars import month_ends

    dates = month_ends(tables.sessions).select(F.col("session").alias("as_of"))
    build = lambda b: dual_momentum(b, dates, tables.instruments).withColumnRenamed("as_of", "session")
    same_past(build, history, altered)


def test_curve_columns_do_not_see_the_future(tables):
    nav = tables.nav
    moved = nav.withColumn("nav", F.when(F.col("session") > F.lit(CUT), F.col("nav") * 3).otherwise(F.col("nav")))
    build = lambda n: metrics.enriched(n).select("portfolio", "session", "ret", "peak", "dd", "peak_before")
    same_past(build, nav, moved)
