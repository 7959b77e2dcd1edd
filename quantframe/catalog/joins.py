"""Join queries: as-of, interval, reconciling, semi, anti and corroborating."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.live import EFFECTIVE, POSITIONS_BOTH, SIDES, both_positions, two_sides
from quantframe.catalog.registry import query
from quantframe.catalog.signals import SHARED, pair_list
from quantframe.functions import literal_grid
from quantframe.operators import live, pairs
from quantframe.operators.asof import asof_join, rate_on


@query(
    "D02_asof_rate",
    "portfolio:s session:d nav:f rate:f",
    """select n.portfolio, n.session, n.nav, r.annual_rate as rate
       from nav n asof left join rates r on n.session >= r.date""",
)
def _(t):
    return rate_on(t.nav, t.rates, "session")


@query(
    "D02_asof_close",
    "execution_id:s symbol:s session:d last_close:f last_session:d",
    """select f.execution_id, f.symbol, f.session, b.close as last_close, b.session as last_session
       from fills f asof left join bars b on b.symbol = f.symbol and f.session > b.session""",
)
def _(t):
    closes = t.bars.select(
        "symbol",
        F.col("session").alias("last_session"),
        F.col("close").alias("last_close"),
    )
    probes = t.fills.select("execution_id", "symbol", "session")
    return asof_join(
        probes,
        closes,
        ["symbol"],
        "session",
        "last_session",
        ["last_close", "last_session"],
        allow_exact=False,
    )


@query(
    "D03_full_outer_reconcile",
    "portfolio:s symbol:s expected:f actual:f difference:f agrees:b",
    POSITIONS_BOTH,
)
def _(t):
    return both_positions(t)


@query(
    "D04_unmatched_sides",
    "side:s session:d symbol:s buying:b",
    """select 'simulated' as side, f.session, f.symbol, f.buying from col_f f
       where not exists (select 1 from col_o o where o.session = f.session
             and o.symbol = f.symbol and o.buying = f.buying)
       union all
       select 'actual', o.session, o.symbol, o.buying from col_o o
       where not exists (select 1 from col_f f where o.session = f.session
             and o.symbol = f.symbol and o.buying = f.buying)""",
    SIDES,
)
def _(t):
    return live.unmatched(*two_sides(t))


@query(
    "D04_paired_intentions",
    "session:d symbol:s buying:b sim_price:f act_price:f divergence_bps:f commission_bps:f",
    "select * from both_sides",
    SIDES,
)
def _(t):
    return live.paired_intentions(*two_sides(t))


@query(
    "D05_latest_amendment",
    "execution_id:s ts:t price:f commission:m slippage:m import_id:s amended:b",
    f"select * from ({EFFECTIVE}) e",
)
def _(t):
    return live.effective_fills(t.fills, t.amendments)


@query(
    "D06_missing_sessions_anti",
    "symbol:s session:d",
    """select c.symbol, s.session from (select symbol, min(session) as a, max(session) as z
         from bars group by 1) c join sessions s on s.session between c.a and c.z
       left join bars b on b.symbol = c.symbol and b.session = s.session
       where b.session is null""",
)
def _(t):
    from quantframe.operators.quality import missing_sessions

    return missing_sessions(t.bars, t.sessions)


@query(
    "D07_known_instruments_semi",
    "execution_id:s symbol:s",
    """select execution_id, symbol from fills f where exists (
         select 1 from instruments i where i.symbol = f.symbol and not i.trades_continuously)""",
)
def _(t):
    known = t.instruments.filter("not trades_continuously").select("symbol")
    return t.fills.join(known, "symbol", "left_semi")


@query(
    "D07_new_executions_anti",
    "execution_id:s order_id:s",
    """select execution_id, order_id from fills f where not exists (
         select 1 from fills g where g.execution_id = f.execution_id and g.venue = 'F')""",
)
def _(t):
    imported = t.fills.filter("venue = 'F'").select("execution_id")
    return t.fills.join(imported, "execution_id", "left_anti")


CANDIDATES = """select t.execution_id as trade_id, o.order_id
  from fills t join order_book o on o.symbol = t.symbol and o.quantity = t.quantity
    and o.created_at < t.ts and t.ts < o.created_at + interval 4 day"""


INTERVAL_MATCH = f"""with c as ({CANDIDATES}),
        by_t as (select trade_id, count(*) as n, max(order_id) as order_id from c group by 1),
        by_o as (select order_id, count(*) as n from c group by 1)
        select f.execution_id as trade_id,
          case when b.n = 1 and o.n = 1 then b.order_id end as order_id,
          coalesce(b.n, 0) as candidates,
          case when b.n is null then 'unmatched' when b.n = 1 and o.n = 1 then 'matched'
               else 'ambiguous' end as status
        from fills f left join by_t b on b.trade_id = f.execution_id
        left join by_o o on o.order_id = b.order_id"""


@query("D08_interval_match", "trade_id:s order_id:s candidates:l status:s", INTERVAL_MATCH)
def _(t):
    trades = t.fills.select(F.col("execution_id").alias("trade_id"), "symbol", "quantity", "ts")
    return live.match_orders_to_trades(t.order_book, trades)


@query(
    "D09_corroboration",
    "symbol:s session:d quantity:f price:f trades:l confirmations:l verdict:s",
    """with t as (select symbol, session, quantity, price, count(*) as trades,
              min(commission) as t0, max(commission) as t1 from fills where tax <> 0.05 group by all),
            c as (select symbol, session, quantity, price, count(*) as confirmations,
              min(k) as c0, max(k) as c1 from (
                select symbol, session, quantity, price,
                  commission + case when tax = 0.03 then 1 else 0 end as k
                from fills where tax <> 0.01) x group by all)
       select symbol, session, quantity, price, coalesce(trades, 0) as trades,
         coalesce(confirmations, 0) as confirmations,
         case when trades is null then 'extra confirmation'
              when confirmations is null then 'no confirmation'
              when confirmations <> 1 or trades <> 1 then 'not unique'
              when floor(t0 * 100 + 0.5) <> floor(c0 * 100 + 0.5) then 'commission differs'
              else 'corroborated' end as verdict
       from t full outer join c using (symbol, session, quantity, price)""",
)
def _(t):
    trades = t.fills.filter("tax <> 0.05")
    confirmed = t.fills.filter("tax <> 0.01").withColumn(
        "commission",
        F.col("commission") + F.when(F.col("tax") == 0.03, 1.0).otherwise(0.0),
    )
    return live.corroborate(trades, confirmed).withColumn("session", F.to_date("ts"))


@query(
    "D10_pair_self_join",
    "pair:s sessions:l covariance:f correlation:f",
    """with r as (select p.pair, a.session, a.close / lag(a.close) over w - 1 as x,
                    b.close / lag(b.close) over w - 1 as y
                  from pair_list p join bars a on a.symbol = p.left_symbol
                  join bars b on b.symbol = p.right_symbol and b.session = a.session
                  window w as (partition by p.pair order by a.session))
       select pair, count(x) as sessions, covar_samp(x, y) * 1e4 as covariance, corr(x, y) as correlation
       from r group by 1""",
    SHARED,
)
def _(t):
    panel = pairs.pair_panel(t.bars, pair_list(t))
    ret = lambda c: F.col(c) / F.lag(c).over(pairs.by_pair()) - 1
    moves = panel.select("pair", ret("left_close").alias("x"), ret("right_close").alias("y"))
    return moves.groupBy("pair").agg(
        F.count("x").alias("sessions"),
        (F.covar_samp("x", "y") * 1e4).alias("covariance"),
        F.corr("x", "y").alias("correlation"),
    )


@query(
    "D11_grid_by_window",
    "portfolio:s window:s top:l sessions:l total_return:f",
    """select n.portfolio, w.name as window, g.top, count(*) as sessions,
              max_by(nav, session) / min_by(nav, session) - 1 as total_return
       from nav n cross join (values (1), (2), (3)) g(top)
       join (values ('early', date '1995-01-01', date '1997-12-31'),
                    ('late', date '1998-01-01', date '2000-12-31')) w(name, a, z)
         on n.session between w.a and w.z
       group by 1, 2, 3""",
)
def _(t):
    import datetime as dt

    rows = [
        {"window": n, "a": a, "z": z, "top": k}
        for n, a, z in (
            ("early", dt.date(1995, 1, 1), dt.date(1997, 12, 31)),
            ("late", dt.date(1998, 1, 1), dt.date(2000, 12, 31)),
        )
        for k in (1, 2, 3)
    ]
    grid = literal_grid(t.nav, rows, "window string, a date, z date, top int")
    return (
        grid.filter("session between a and z")
        .groupBy("portfolio", "window", "top")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            (F.max_by("nav", "session") / F.min_by("nav", "session") - 1).alias("total_return"),
        )
    )


@query(
    "D12_session_intersection",
    "session:d",
    "select session from bars group by 1 having count(distinct symbol) = 12",
)
def _(t):
    per = t.bars.groupBy("session").agg(F.count_distinct("symbol").alias("n"))
    size = t.instruments.agg(F.count_distinct("symbol").alias("n"))
    return per.join(size, "n").select("session")
