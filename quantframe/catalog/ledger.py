"""Ledger, valuation, cost and financing queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.ledger_sql import BOOK, IMPACT, PNL, POSITIONS, segment_ctes
from quantframe.catalog.registry import query
from quantframe.catalog.signals import month_decisions
from quantframe.catalog.sizing import BASE
from quantframe.sources.testdata import INITIAL_CASH
from quantframe.functions import literal_grid
from quantframe.operators import costs, ledger
from quantframe.plans import momentum as mom
from quantframe.plans.nav import segment_nav
from quantframe.sources.rates import margin_curve


def margin_of(t):
    return margin_curve(t.rates)


def last_closes(t):
    return t.daily.groupBy("symbol").agg(F.max_by("close", "session").alias("close"))


def pnl_of(t):
    return ledger.position_pnl(ledger.positions(t.fills), last_closes(t))


@query(
    "G01_positions",
    "portfolio:s symbol:s quantity:f avg_cost:f realized:m commission:m fills:l",
    POSITIONS,
    BOOK,
)
def _(t):
    return ledger.positions(t.fills)


@query(
    "G02_cash_ledger",
    "portfolio:s session:d entry:s impact:m cash:m",
    f"""with rows_ as (
          select portfolio, session, ts, execution_id as entry, {IMPACT} as cents from fills
          union all
          select portfolio, session, session, -1, cast(round(amount * 100) as bigint)
          from (select portfolio, session, floor(count(*) * 0.25e0 * 100 + 0.5e0) / 100 as amount
                from fills group by 1, 2) m)
        select portfolio, session, entry, cents / 100e0 as impact,
               100000000e0 + sum(cents) over (partition by portfolio order by ts, entry
                 rows between unbounded preceding and current row) / 100e0 as cash
        from rows_""",
    BOOK,
)
def _(t):
    movements = t.fills.groupBy("portfolio", "session").agg(
        (F.floor(F.count(F.lit(1)) * 0.25 * 100 + 0.5) / 100).alias("amount")
    ).withColumn("ts", F.col("session").cast("timestamp"))
    return ledger.cash_ledger(t.fills, INITIAL_CASH, movements)


@query("G03_holdings", "portfolio:s symbol:s session:d quantity:f", "select * from held", BOOK)
def _(t):
    return ledger.holdings(t.fills, t.sessions)


@query(
    "G04_mark_book",
    "portfolio:s session:d nav:m cash:m gross_exposure:f holdings:l",
    "select * from marks",
    BOOK,
)
def _(t):
    return t.marks


@query(
    "G04_weights",
    "portfolio:s session:d symbol:s weight:f",
    """select l.portfolio, l.session, l.symbol, l.value / m.nav as weight
       from mlines l join marks m using (portfolio, session) where m.nav > 0 and l.value <> 0""",
    BOOK,
)
def _(t):
    return ledger.weight_lines(t.lines, t.marks)


@query(
    "G05_position_pnl",
    "portfolio:s symbol:s cost_basis:m unrealized:m net_realized:m",
    "select * from pnl",
    PNL,
)
def _(t):
    return pnl_of(t)


@query(
    "G06_attribution",
    "portfolio:s symbol:s realized:m unrealized:m commission:m average_weight:f"
    " sessions_held:l time_held:f net:m",
    """select * from attrib
       union all
       select m.portfolio, 'CASH', 1234.5e0, 0, 0, 0, count(*), 1, 1234.5e0
       from marks m group by 1""",
    PNL,
)
def _(t):
    cash = t.flows.select("portfolio").distinct().withColumn("amount", F.lit(1234.5))
    return ledger.attribution(pnl_of(t), ledger.weight_lines(t.lines, t.marks), t.marks, cash)


@query(
    "G07_concentration",
    "portfolio:s concentration:f",
    """select portfolio, coalesce(max(case when net > 0 then net end)
         / sum(case when net > 0 then net end), 0) as concentration from attrib group by 1""",
    PNL,
)
def _(t):
    weights = ledger.weight_lines(t.lines, t.marks)
    return ledger.concentration(ledger.attribution(pnl_of(t), weights, t.marks))


@query(
    "G08_pnl_decomposition",
    "portfolio:s symbol:s session:d overnight:m intraday:m",
    """select h.portfolio, h.symbol, h.session,
         lag(h.quantity, 1, 0) over (partition by h.portfolio, h.symbol order by h.session)
           * (p.open - coalesce(p.prev, p.open)) as overnight,
         h.quantity * (p.close - p.open) as intraday
       from held h join (select *, lag(close) over (partition by symbol order by session) as prev
                         from panel) p on p.symbol = h.symbol and p.session = h.session""",
    BOOK,
)
def _(t):
    return ledger.pnl_decomposition(t.held, t.panel)


def calendar_days(t):
    bounds = t.sessions.agg(F.min("session").alias("a"), F.max("session").alias("b"))
    return bounds.select(F.explode(F.sequence("a", "b")).alias("session"))


@query(
    "G09_interest_accrual",
    "portfolio:s session:d until:d cash:m interest:m",
    """with days as (select cast(unnest(generate_series(
                cast((select min(session) from sessions) as timestamp),
                cast((select max(session) from sessions) as timestamp), interval 1 day)) as date)
                as day),
       c as (select d.day, r.annual_rate as r from days d asof join rates r on d.day >= r.date),
       m as (select d.day, r.annual_rate as r from days d asof join margin r on d.day >= r.date)
       select g.portfolio, g.session, g.until, g.cash,
              round_even(g.cash * (exp(sum(ln(1 + case when g.cash > 0 then c.r else m.r end
                    / 365))) - 1), 2) as interest
       from gaps g join c on c.day >= g.session and c.day < g.until join m on m.day = c.day
       where g.until is not null group by 1, 2, 3, 4""",
    BOOK,
)
def _(t):
    balances = ledger.cash_at_sessions(t.flows, t.sessions, INITIAL_CASH)
    return ledger.interest_accrual(balances, calendar_days(t), t.rates, margin_of(t))


@query(
    "G10_carry_costs",
    "portfolio:s session:d days:l borrow_fee:m debit_interest:m credit_interest:m",
    """select g.portfolio, g.session, datediff('day', g.session, g.until) as days,
         coalesce(s.shorts, 0) * 0.01 * datediff('day', g.session, g.until) / 365e0 as borrow_fee,
         greatest(coalesce(s.longs, 0) - g.nav, 0) * m.annual_rate
           * datediff('day', g.session, g.until) / 365e0 as debit_interest,
         greatest(g.nav - coalesce(s.longs, 0), 0) * r.annual_rate
           * datediff('day', g.session, g.until) / 365e0 as credit_interest
       from gaps g left join (select portfolio, session, sum(greatest(value, 0)) as longs,
                                sum(greatest(-value, 0)) as shorts from mlines group by 1, 2) s
         on s.portfolio = g.portfolio and s.session = g.session
       asof join rates r on g.session >= r.date
       asof join margin m on g.session >= m.date
       where g.until is not null""",
    BOOK,
)
def _(t):
    return ledger.carry_costs(t.lines, t.marks, t.rates, margin_of(t))


@query(
    "G11_segment_nav",
    "session:d nav:m exposure:f turnover:f",
    "select session, nav, exposure, turnover from g_nav",
    {**BASE, **segment_ctes("g_", "select * from m_targets", cost=0.0005)},
)
def _(t):
    targets = mom.dual_momentum(t.daily, month_decisions(t), t.instruments)
    return segment_nav(targets, t.daily, t.sessions, cost_rate=0.0005)


# ---------------------------------------------------------------- costs

ADV = """select symbol, session, open, avg(volume) over (partition by symbol order by session
           rows between 20 preceding and 1 preceding) as adv from bars"""
COSTED = {
    "advs": ADV,
    "priced": """select f.portfolio, f.symbol, f.session, f.execution_id, f.quantity, a.open, a.adv,
                   coalesce(i.half_spread_bps, 2) as half_spread_bps
                 from fills f left join advs a using (symbol, session)
                 left join instruments i using (symbol)""",
}


def executed_sql(source: str, scale: str) -> str:
    return f"""
select *, abs(fill_price - open) * abs(quantity) as slippage_cash,
       case when abs(quantity) > 0 then
         cast(round_even(cast(greatest(abs(quantity) * 0.0035e0 * {scale}, 0.35e0 * {scale})
              as decimal(20, 12)), 2) as double) else 0 end as commission
from (select *, floor(open * (1 + case when quantity > 0 then 1 else -1 end
               * (half_spread_bps * {scale} + impact) / 10000) * 1e8 + 0.5e0) / 1e8 as fill_price
      from (select *, case when adv > 0 then 30 * {scale} * sqrt(least(abs(quantity) / adv, 1))
                           else 0 end as impact from ({source}) p) q) r"""


def priced_fills(t):
    orders = t.fills.select("portfolio", "symbol", "session", "execution_id", "quantity")
    return costs.priced_orders(orders, t.daily, t.instruments)


@query(
    "G12_commission",
    "execution_id:s commission:m",
    """select execution_id, case when cents - 100 * (cents // 100) > 50
              or (cents - 100 * (cents // 100) = 50 and (cents // 100) % 2 <> 0)
           then cents // 100 + 1 else cents // 100 end / 100e0 as commission
       from (select execution_id, cast(round(greatest(abs(quantity) * 0.035e0, 0.35e0) * 10000)
               as bigint) as cents from fills) t""",
)
def _(t):
    return t.fills.select(
        "execution_id",
        costs.commission(F.col("quantity") * 10, "price").alias("commission"),
    )


@query(
    "G13_half_spread",
    "execution_id:s symbol:s half_spread_bps:f",
    """select execution_id, symbol, coalesce(half_spread_bps, 2) as half_spread_bps
       from fills left join instruments using (symbol)""",
)
def _(t):
    return costs.half_spread(t.fills.select("execution_id", "symbol"), t.instruments)


@query(
    "G14_impact_bps",
    "execution_id:s impact:f",
    """select execution_id, case when adv > 0 then 30 * sqrt(least(abs(quantity) / adv, 1))
              else 0 end as impact from priced""",
    COSTED,
)
def _(t):
    return priced_fills(t).withColumn("impact", costs.impact_bps("quantity", "adv"))


@query(
    "G15_fill_price_slippage",
    "execution_id:s fill_price:f slippage_cash:f",
    executed_sql("select * from priced", "1"),
    COSTED,
)
def _(t):
    return costs.executed(priced_fills(t))


@query(
    "G16_scaled_costs",
    "portfolio:s cost_scale:f slippage:m commission:m",
    f"""select portfolio, cost_scale, sum(slippage_cash) as slippage, sum(commission) as commission
        from ({executed_sql('''select p.*, k.cost_scale from priced p
                cross join (values (0e0), (1e0), (2e0), (3e0), (5e0)) k(cost_scale)''',
                'cost_scale')}) x group by 1, 2""",
    COSTED,
)
def _(t):
    swept = costs.cost_scale_sweep(priced_fills(t), (0, 1, 2, 3, 5))
    return swept.groupBy("portfolio", "cost_scale").agg(
        F.sum("slippage_cash").alias("slippage"), F.sum("commission").alias("commission")
    )


@query(
    "G17_execution_feasibility",
    "portfolio:s symbol:s session:d outcome:s executable:f",
    """select portfolio, symbol, session,
         case when open is null then 'no open price' when q = 0 then 'nothing held to sell'
              when over and lim = 0 then 'order exceeds volume limit'
              when fin = 0 then 'rounds to zero at this lot size'
              when fin <> quantity then 'trimmed' else 'accepted' end as outcome,
         case when open is null then 0 else fin end as executable
       from (select *, sign(lim) * floor(abs(lim) / lot_size) * lot_size as fin
         from (select *, coalesce(abs(q) > cap, false) as over,
                 case when coalesce(abs(q) > cap, false)
                      then sign(q) * sign(cap) * floor(abs(cap) / lot_size) * lot_size
                      else q end as lim
           from (select o.*, a.open, i.lot_size,
                   case when a.adv > 0 then a.adv * 0.1e0 end as cap,
                   case when o.quantity < 0 and -o.quantity > greatest(coalesce(h.held, 0), 0)
                        then -greatest(coalesce(h.held, 0), 0) else o.quantity end as q
                 from (select portfolio, symbol, session, sum(quantity) * 0.5e0 as quantity
                       from fills group by 1, 2, 3) o
                 left join advs a using (symbol, session)
                 left join instruments i using (symbol)
                 left join (select portfolio, symbol, session, lag(quantity) over
                              (partition by portfolio, symbol order by session) as held
                            from held_run) h using (portfolio, symbol, session)) x) y) z""",
    {**BOOK, **COSTED},
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("portfolio", "symbol").orderBy("session")
    net = t.fills.groupBy("portfolio", "symbol", "session").agg(F.sum("quantity").alias("d"))
    orders = net.select(
        "portfolio", "symbol", "session", (F.col("d") * 0.5).alias("quantity")
    )
    before = net.select(
        "portfolio",
        "symbol",
        "session",
        F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("held"),
    )
    return costs.feasibility(orders, t.daily, before, t.instruments)


@query(
    "G18_round_trip_budget",
    "portfolio:s allocation:f sleeve_capital:m leg_dollars:m round_trip_dollars:m"
    " break_even_bps:f shares_per_leg:l",
    """select portfolio, allocation, sleeve as sleeve_capital, sleeve / 4 as leg_dollars,
         8 + sleeve * 4 / 10000e0 + sleeve * 0.5 * 0.01 * 2 / 365e0 as round_trip_dollars,
         (8 + sleeve * 4 / 10000e0 + sleeve * 0.5 * 0.01 * 2 / 365e0) / sleeve * 10000
           as break_even_bps, floor(sleeve / 4 / 100) as shares_per_leg
       from (select portfolio, allocation, capital * allocation as sleeve
             from (select portfolio, max_by(nav, session) as capital from nav group by 1) n
             cross join (values (0.05e0), (0.1e0), (0.2e0)) a(allocation)) t""",
)
def _(t):
    capital = t.nav.groupBy("portfolio").agg(F.max_by("nav", "session").alias("capital"))
    grid = literal_grid(
        capital, [{"allocation": a} for a in (0.05, 0.1, 0.2)], "allocation double"
    )
    return costs.round_trip_budget(grid)


@query(
    "G19_cost_totals",
    "portfolio:s fills:l commission:m slippage:m traded_notional:m net_financing:m total_costs:m",
    """select portfolio, f.fills, f.commission, f.slippage, f.traded_notional,
              coalesce(n.net, 0) as net_financing,
              f.commission + f.slippage + greatest(-coalesce(n.net, 0), 0) as total_costs
       from (select portfolio, count(*) as fills, sum(commission) as commission,
               sum(slippage) as slippage, sum(abs(quantity) * price) as traded_notional
             from fills group by 1) f
       left join (select portfolio, sum(-commission * 0.5e0) as net from fills group by 1) n
         using (portfolio)""",
)
def _(t):
    financing = t.fills.select("portfolio", (-F.col("commission") * 0.5).alias("interest"))
    return costs.cost_totals(t.fills, financing)
