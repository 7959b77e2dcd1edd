"""Streaming queries: the given tables arrive as file streams and run to completion."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.joins import INTERVAL_MATCH
from quantframe.catalog.ledger_sql import BOOK, POSITIONS
from quantframe.catalog.registry import query
from quantframe.sources.testdata import PORTFOLIOS, RAW_PRICE, ROW_KEY, SYMBOL
from quantframe.streaming import jobs
from quantframe.streaming.tables import scratch_folder


def stream_of(t, table: str):
    return jobs.file_stream(t.spark, t.folder, f"{table}.parquet", t.raw(table).schema)


def fill_stream(t):
    """Line items as fills, in the shape of the batch ledger."""
    return stream_of(t, "lineitem").selectExpr(
        f"concat('P', cast(l_orderkey % {PORTFOLIOS} as string)) as portfolio",
        f"{SYMBOL} as symbol",
        "cast(l_shipdate as timestamp) as ts",
        "cast(l_shipdate as date) as session",
        "case when l_returnflag = 'R' then -l_quantity else l_quantity end as quantity",
        f"floor(({RAW_PRICE}) * 10000 + 0.5D) / 10000 as price",
        "greatest(0.35D, floor(0.35D * l_quantity + 0.5D) / 100) as commission",
        "floor(l_quantity * 100 * l_tax + 0.5D) / 100 as slippage",
        "concat('O', cast(l_orderkey as string)) as order_id",
        f"{ROW_KEY} as execution_id",
        "l_tax as tax",
    )


@query(
    "L01_stream_collapse",
    "portfolio:s session:d symbol:s buying:b quantity:f price:f commission:m pieces:l",
    """select portfolio, session, symbol, quantity > 0 as buying, sum(quantity) as quantity,
         sum(abs(quantity) * price) / sum(abs(quantity)) as price, sum(commission) as commission,
         count(*) as pieces from fills group by 1, 2, 3, 4""",
)
def _(t):
    return jobs.run_collapse(fill_stream(t), scratch_folder(t.spark, "collapse"))


@query(
    "L03_stream_executions",
    "execution_id:s verdict:s",
    """select execution_id, case when max(conflict) = 1 then 'conflict' else 'archived' end as verdict
       from (select execution_id, case when tax = 0.02 then 1 else 0 end as conflict from fills) t
       group by 1""",
)
def _(t):
    feed = fill_stream(t).drop("tax")
    changed = fill_stream(t).filter("tax = 0.02").withColumn("price", F.col("price") + 0.5)
    again = fill_stream(t).filter("tax = 0.0")
    both = feed.unionByName(changed.drop("tax")).unionByName(again.drop("tax"))
    archived, conflicts = jobs.run_ingest(both, scratch_folder(t.spark, "ingest"))
    return archived.select("execution_id", F.lit("archived").alias("verdict")).unionByName(
        conflicts.select("execution_id", "verdict").distinct()
    )


@query(
    "L04_stream_positions",
    "portfolio:s symbol:s quantity:f avg_cost:f realized:m commission:m fills:l",
    POSITIONS,
    BOOK,
)
def _(t):
    return jobs.run_positions(fill_stream(t), scratch_folder(t.spark, "positions"))


@query(
    "L06_stream_session_marks",
    "portfolio:s session:d fills:l traded:m net_cash:m",
    """select portfolio, session, count(*) as fills, sum(abs(quantity * price)) as traded,
              sum(-quantity * price - commission) as net_cash from fills group by 1, 2""",
)
def _(t):
    return jobs.run_session_marks(fill_stream(t), scratch_folder(t.spark, "marks"))


@query(
    "L07_stream_interval_join",
    "trade_id:s order_id:s candidates:l status:s",
    INTERVAL_MATCH,
)
def _(t):
    orders = fill_stream(t).selectExpr(
        "concat('I', cast(execution_id as string)) as order_id",
        "symbol",
        "quantity",
        """case when execution_id % 2 = 0 then ts - interval 20 hours
                else ts - interval 5 days end as created_at""",
    )
    trades = fill_stream(t).selectExpr("execution_id as trade_id", "symbol", "quantity", "ts")
    return jobs.run_match(orders, trades, scratch_folder(t.spark, "match"))[0]


@query(
    "L10_stream_failure_streak",
    "user_id:l event_id:l failed:b streak:l event:s",
    """select user_id, event_id, failed, case when failed then run else 0 end as streak,
         case when failed and run = 3 then 'alert'
              when not failed and coalesce(prev, 0) >= 3 then 'recovered' else 'ok' end as event
       from (select *, lag(case when failed then run else 0 end) over
               (partition by user_id order by ts, event_id) as prev
             from (select *, row_number() over (partition by user_id, island, failed
                       order by ts, event_id) as run
                   from (select user_id, ts, event_id, event_type = 'error' as failed,
                           sum(case when event_type = 'error' then 0 else 1 end) over
                             (partition by user_id order by ts, event_id) as island
                         from events) a) b) c""",
)
def _(t):
    events = stream_of(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jobs.run_streaks(
        events, F.col("event_type") == "error", scratch_folder(t.spark, "streaks")
    )
