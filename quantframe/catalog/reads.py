"""Point-in-time read, projection and filter queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.catalog.signals import SHARED, month_decisions
from quantframe.functions import quantize, quantize_cash, round_to_lot, safe_div
from quantframe.operators import bars as ops
from quantframe.operators.decisions import at_decisions
from quantframe.sources.feeds import ExecutionFeed, HistoricalFeed

AS_OF = dt.date(1999, 6, 30)


@query(
    "C01_history",
    "symbol:s session:d close:f",
    """select symbol, session, close from bars where session <= date '1999-06-30'
       qualify row_number() over (partition by symbol order by session desc) <= 60""",
)
def _(t):
    return ops.history(t.bars, AS_OF, 60)


@query(
    "C02_latest_closes",
    "symbol:s session:d close:f",
    """select symbol, max(session) as session, max_by(close, session) as close
       from bars where session <= date '1999-06-30' group by 1""",
)
def _(t):
    return ops.latest_closes(t.bars, AS_OF)


@query(
    "C02_closes_as_of",
    "as_of:d symbol:s session:d close:f",
    """select g.as_of, b.symbol, b.session, b.close from grid g
       asof join bars b on b.symbol = g.symbol and g.as_of >= b.session""",
    SHARED,
)
def _(t):
    return at_decisions(t.bars.select("symbol", "session", "close"), month_decisions(t))


@query(
    "C03_first_sessions",
    "symbol:s first_session:d ready_session:d",
    """select symbol, min(session) as first_session,
              min(case when n >= 260 then session end) as ready_session
       from (select symbol, session, row_number() over (partition by symbol order by session) as n
             from bars) t group by 1""",
)
def _(t):
    return ops.first_sessions(t.bars, 260)


@query(
    "C04_open_price",
    "order_id:s symbol:s session:d open:f",
    """select o.order_id, o.symbol, cast(o.created_at as date) as session, b.open
       from order_book o left join bars b
         on b.symbol = o.symbol and b.session = cast(o.created_at as date)""",
)
def _(t):
    orders = t.order_book.select(
        "order_id", "symbol", F.to_date("created_at").alias("session")
    )
    return orders.join(t.bars.select("symbol", "session", "open"), ["symbol", "session"], "left")


@query(
    "C04_execution_feed",
    "order_id:s symbol:s session:d open:f adv:f",
    """select o.order_id, o.symbol, cast(o.created_at as date) as session, b.open, b.adv
       from order_book o left join (
         select symbol, session, open, avg(volume) over (partition by symbol order by session
                  rows between 20 preceding and 1 preceding) as adv from bars) b
         on b.symbol = o.symbol and b.session = cast(o.created_at as date)""",
)
def _(t):
    orders = t.order_book.select(
        "order_id", "symbol", F.to_date("created_at").alias("session")
    )
    venue = ExecutionFeed(t.bars)
    return venue.average_volume(venue.open_price(orders))


@query(
    "C01_feed_history",
    "symbol:s session:d close:f kind:s",
    """select symbol, session, close, 'history' as kind from bars where session <= date '1999-06-30'
       qualify row_number() over (partition by symbol order by session desc) <= 5
       union all
       select symbol, max(session), max_by(close, session), 'latest' from bars
       where session <= date '1999-06-30' group by 1""",
)
def _(t):
    feed = HistoricalFeed(t.bars)
    columns = ["symbol", "session", "close"]
    known = feed.history(as_of=AS_OF, count=5).select(*columns, F.lit("history").alias("kind"))
    return known.unionByName(feed.latest(as_of=AS_OF).select(*columns, F.lit("latest").alias("kind")))


@query(
    "C05_average_volume",
    "symbol:s session:d adv:f",
    """select symbol, session, avg(volume) over (partition by symbol order by session
              rows between 20 preceding and 1 preceding) as adv from bars""",
)
def _(t):
    return ops.average_volume(t.bars)


@query(
    "C06_typical_price",
    "symbol:s session:d typical:f",
    "select symbol, session, (high + low + close) / 3 as typical from bars",
)
def _(t):
    return t.bars.withColumn("typical", ops.typical_price())


@query(
    "C07_round_to_lot",
    "execution_id:s lots:f",
    """select execution_id, sign(q) * floor(abs(q) / lot_size) * lot_size as lots
       from (select execution_id, symbol, quantity * 1.37e0 as q from fills) f
       join instruments using (symbol)""",
)
def _(t):
    return (
        t.fills.select("execution_id", "symbol", (F.col("quantity") * 1.37).alias("q"))
        .join(t.instruments.select("symbol", "lot_size"), "symbol")
        .withColumn("lots", round_to_lot("q", F.col("lot_size")))
    )


@query(
    "C08_money_rounding",
    "execution_id:s cash:m price8:f unit_cost:f",
    """select execution_id,
         (case when v - 100 * cast(floor(v / 100e0) as bigint) > 50
                 or (v - 100 * cast(floor(v / 100e0) as bigint) = 50
                     and cast(floor(v / 100e0) as bigint) % 2 <> 0)
               then 1 else 0 end + cast(floor(v / 100e0) as bigint)) / 100e0 as cash,
         price as price8,
         case when slippage = 0 then -1 else commission / slippage end as unit_cost
       from (select *, cast(round(quantity * price * 10000) as bigint) as v from fills) t""",
)
def _(t):
    exact = F.col("quantity").cast("decimal(18,8)") * F.col("price").cast("decimal(18,8)")
    return t.fills.select(
        "execution_id",
        quantize_cash(exact).alias("cash"),
        quantize("price", 8).alias("price8"),
        safe_div("commission", "slippage", -1.0).alias("unit_cost"),
    )


@query(
    "C09_nav_window",
    "portfolio:s session:d nav:f",
    """select n.portfolio, n.session, n.nav from nav n join (
         select portfolio, coalesce(max(case when session < date '1997-03-01' then session end),
                                    date '1997-03-01') as lo from nav group by 1) b using (portfolio)
       where n.session >= b.lo and n.session <= date '1998-12-31'""",
)
def _(t):
    start, end = F.lit(dt.date(1997, 3, 1)), F.lit(dt.date(1998, 12, 31))
    low = t.nav.groupBy("portfolio").agg(
        F.coalesce(F.max(F.when(F.col("session") < start, F.col("session"))), start).alias("__lo")
    )
    return t.nav.join(low, "portfolio").filter(
        (F.col("session") >= F.col("__lo")) & (F.col("session") <= end)
    )


@query(
    "C10_recent_fills",
    "portfolio:s execution_id:s symbol:s session:d",
    """select portfolio, execution_id, symbol, session from fills
       where session >= date '2001-01-01'
       order by session desc, execution_id desc limit 100""",
)
def _(t):
    return (
        t.fills.filter(F.col("session") >= F.lit(dt.date(2001, 1, 1)))
        .orderBy(F.col("session").desc(), F.col("execution_id").desc())
        .limit(100)
    )


@query(
    "C11_predicates",
    "symbol:s session:d close:f flag:s",
    """select symbol, session, close, case when close between 97 and 99 then 'band'
              when symbol in ('S01', 'S02') and (volume > 80 or close > 101) then 'member'
              else 'rest' end as flag
       from bars where close is not null and isfinite(close)
         and not (symbol = 'S00' and volume < 5)""",
)
def _(t):
    c = F.col
    return t.bars.filter(
        c("close").isNotNull()
        & ~F.isnan("close")
        & (F.abs("close") < float("inf"))
        & ~((c("symbol") == "S00") & (c("volume") < 5))
    ).withColumn(
        "flag",
        F.when(c("close").between(97, 99), "band")
        .when(c("symbol").isin("S01", "S02") & ((c("volume") > 80) | (c("close") > 101)), "member")
        .otherwise("rest"),
    )
