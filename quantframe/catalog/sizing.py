"""Sizing, momentum targets, blends, rebalances and limit queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantframe.catalog.ledger_sql import BOOK
from quantframe.catalog.momentum_sql import covariance, momentum_ctes
from quantframe.catalog.registry import query
from quantframe.catalog.signals import SHARED, month_decisions, pair_eligibility
from quantframe.operators import allocation, ledger, pairs, signals, sizing
from quantframe.operators import calendars as cal
from quantframe.plans import momentum as mom
from quantframe.plans import strategies
from quantframe.session import shared

MONTHS = "select as_of from ends"
BASE = {**SHARED, **momentum_ctes("m_", MONTHS, [{}])}
OFFSETS = """select s.session as as_of, cast(o.k as varchar) as sleeve from ends
  cross join (values (0), (5), (10), (15)) o(k) join sessions s on s.seq = ends.seq - o.k"""
TRANCHED = {
    **SHARED,
    "offset_dates": OFFSETS,
    **momentum_ctes("t_", "select as_of, sleeve from offset_dates", [{}]),
    "t_sleeves": """select d.sleeve, t.as_of, t.symbol, t.weight from t_targets t
                    join offset_dates d using (as_of)""",
}


def blend_sql(source: str, share: str) -> str:
    """Latest decision per sleeve on every date any sleeve decided."""
    return f"""
select as_of, symbol, weight from (
  select l.as_of, w.symbol, round_even(sum(round(w.weight * 1e6) * {share}), 0) / 1e6 as weight
  from (select d.as_of, s.sleeve, max(s.as_of) as decided
        from (select distinct as_of from {source}) d
        join (select distinct sleeve, as_of from {source}) s on s.as_of <= d.as_of
        group by 1, 2) l
  join {source} w on w.sleeve = l.sleeve and w.as_of = l.decided
  group by l.as_of, w.symbol) z where weight > 0"""


def picks_of(t):
    rows = [mom.complete({})]
    features = mom.signal_features(t.daily, rows)
    seen = mom.eligible_at(features, month_decisions(t), t.instruments, "S00", days=t.ticks)
    return shared(mom.selected(mom.scored(seen, rows)))


def relative_of(t):
    return sizing.inverse_vol_weights(picks_of(t), ["variant", "as_of"])


@query(
    "F01_realised_vol",
    "symbol:s session:d vol:f",
    """select symbol, session, vol from (
         select symbol, session, case when count(ret) over w >= 40
                then stddev_samp(ret) over w end as vol from sret
         window w as (partition by symbol order by session
                      rows between 59 preceding and current row)) t where vol is not null""",
    SHARED,
)
def _(t):
    return sizing.realised_vol(signals.simple_returns(t.daily))


@query(
    "F02_inverse_vol_weights",
    "as_of:d symbol:s weight:f",
    "select as_of, symbol, weight from m_rel",
    BASE,
)
def _(t):
    return relative_of(t)


@query(
    "F03_shrunk_covariance",
    "as_of:d sym_a:s sym_b:s cov1e4:f",
    "select as_of, sym_a, sym_b, cov * 1e4 as cov1e4 from m_cov",
    BASE,
)
def _(t):
    return sizing.shrunk_covariance(
        relative_of(t), sizing.numbered_returns(t.daily), ["variant", "as_of"]
    ).withColumn("cov1e4", F.col("cov") * 1e4)


@query(
    "F04_portfolio_vol",
    "as_of:d volatility:f mean_correlation:f",
    "select as_of, volatility, mean_correlation from m_risk",
    BASE,
)
def _(t):
    return sizing.book_risk(
        relative_of(t), sizing.numbered_returns(t.daily), ["variant", "as_of"]
    )


F05 = {
    **BASE,
    "m_held": "select variant, as_of, symbol, n, need - 1 as length, weight from m_kept",
    **covariance("m_dcov", "select * from m_held", "variant, as_of"),
}


@query(
    "F05_diversification_ratio",
    "as_of:d volatility:f diversification:f",
    """select a.as_of, sqrt(greatest(sum(a.weight * b.weight * c.cov), 0) * 252) as volatility,
         coalesce((select sum(h.weight * sqrt(d.cov * 252)) from m_held h join m_dcov d
            on d.as_of = h.as_of and d.sym_a = h.symbol and d.sym_b = h.symbol
            where h.as_of = a.as_of)
           / nullif(sqrt(greatest(sum(a.weight * b.weight * c.cov), 0) * 252), 0), 0)
           as diversification
       from m_held a join m_held b on a.as_of = b.as_of
       join m_dcov c on c.as_of = a.as_of and c.sym_a = a.symbol and c.sym_b = b.symbol
       group by a.as_of""",
    F05,
)
def _(t):
    returns = sizing.numbered_returns(t.daily)
    weights, _ = mom.sized(picks_of(t), returns)
    kept = (
        weights.filter("passing")
        .withColumn("weight", F.least("weight", "max_weight"))
        .withColumn("length", F.col("need") - 1)
    )
    return sizing.book_risk(kept, returns, ["variant", "as_of"])


@query(
    "F06_vol_target",
    "as_of:d volatility:f scale:f capped:b",
    "select as_of, volatility, scale, capped from m_scaled",
    BASE,
)
def _(t):
    _, risk = mom.sized(picks_of(t), sizing.numbered_returns(t.daily))
    return sizing.vol_target(risk, 0.10)


@query(
    "F07_cap_and_cash",
    "as_of:d symbol:s weight:f",
    """select as_of, symbol, least(weight, 0.15) as weight from m_sized where passing
       union all select as_of, 'S00', 1 - sum(case when passing then least(weight, 0.15)
                   else 0 end) from m_sized group by as_of
       having 1 - sum(case when passing then least(weight, 0.15) else 0 end) > 5e-7""",
    BASE,
)
def _(t):
    weights, _ = mom.sized(picks_of(t), sizing.numbered_returns(t.daily))
    return sizing.cap_and_cash(weights, ["as_of"], "S00", 0.15)


@query(
    "F08_dual_momentum", "as_of:d symbol:s weight:f", "select * from m_targets", BASE
)
def flagship(t):
    return mom.dual_momentum(t.daily, month_decisions(t), t.instruments)


@query(
    "F08_decision_diagnostics",
    "as_of:d symbol:s score:f place:l passing:b",
    "select as_of, symbol, score, place, passing from m_picked",
    BASE,
)
def _(t):
    return picks_of(t)


@query(
    "F09_static_weights",
    "strategy:s as_of:d symbol:s weight:f",
    """with table_(strategy, symbol, weight) as (
         select * from (values ('sixty_forty', 'S01', 0.6e0), ('sixty_forty', 'S02', 0.4e0)) v
         union all select 'equal_weight', symbol, floor(1e8 / count(*) over ()) / 1e8
         from instruments),
       ready as (select t.strategy, max(b.first) as ready from table_ t
                 join (select symbol, min(session) as first from bars group by 1) b using (symbol)
                 group by 1)
       select t.strategy, e.as_of, t.symbol, t.weight from table_ t join ready r using (strategy)
       join ends e on e.as_of >= r.ready
       union all
       select 'buy_and_hold', min(s.session), 'S01', 1e0 from sessions s
       where s.session >= (select min(session) from bars where symbol = 'S01')""",
    SHARED,
)
def _(t):
    table = allocation.named_weights(
        t.instruments, {"sixty_forty": {"S01": 0.6, "S02": 0.4}}
    ).unionByName(allocation.equal_weight(t.instruments))
    hold = allocation.named_weights(t.instruments, {"buy_and_hold": {"S01": 1.0}})
    every = t.sessions.select(F.col("session").alias("as_of"))
    return allocation.static_weights(month_decisions(t), t.daily, table).unionByName(
        allocation.static_weights(every, t.daily, hold, once=True)
    )


@query(
    "F10_blend",
    "as_of:d symbol:s weight:f",
    blend_sql("both_sleeves", "0.5e0"),
    {
        **BASE,
        "fixed_dates": """select s.session as as_of from ends
                          join sessions s on s.seq = ends.seq - 10""",
        "both_sleeves": """select 'momentum' as sleeve, as_of, symbol, weight from m_targets
            union all select 'fixed', d.as_of, v.symbol, v.weight from fixed_dates d
            cross join (values ('S01', 0.6e0), ('S02', 0.4e0)) v(symbol, weight)
            where d.as_of >= (select max(f) from (select min(session) as f from bars
                              where symbol in ('S01', 'S02') group by symbol))""",
    },
)
def _(t):
    lead = mom.dual_momentum(t.daily, month_decisions(t), t.instruments).select(
        F.lit("momentum").alias("sleeve"), "as_of", "symbol", "weight"
    )
    dates = cal.monthly_offset(t.sessions, 10).select(F.col("session").alias("as_of"))
    table = allocation.named_weights(t.instruments, {"fixed": {"S01": 0.6, "S02": 0.4}})
    fixed = allocation.static_weights(dates, t.daily, table).withColumnRenamed("strategy", "sleeve")
    return allocation.blend(
        lead.unionByName(fixed),
        [{"sleeve": "momentum", "share": 0.5}, {"sleeve": "fixed", "share": 0.5}],
    )


@query("F11_tranche", "as_of:d symbol:s weight:f", blend_sql("t_sleeves", "0.25e0"), TRANCHED)
def _(t):
    return strategies.tranched(t.daily, t.sessions, t.instruments)


@query(
    "F12_strategy_registry",
    "strategy:s decisions:l mean_gross:f",
    f"""with every as (
          select 'momentum' as strategy, as_of, weight from ({blend_sql("t_sleeves", "0.25e0")}) a
          union all select 'momentum-single', as_of, weight from m_targets
          union all select 'equal-weight', e.as_of, floor(1e8 / count(*) over (partition by e.as_of))
              / 1e8 from ends e cross join instruments
              where e.as_of >= (select max(f) from (select min(session) as f from bars
                                group by symbol))
          union all select '60-40', e.as_of, v.w from ends e cross join (values (0.6e0), (0.4e0)) v(w)
              where e.as_of >= (select max(f) from (select min(session) as f from bars
                                where symbol in ('S01', 'S02') group by symbol))
          union all select v.name, min(s.session), 1 from sessions s
              cross join (values ('buy-and-hold'), ('spy')) v(name)
              where s.session >= (select min(session) from bars where symbol = 'S01') group by 1
          union all select 'balanced', as_of, weight from ({blend_sql("halves", "0.5e0")}) c)
        select strategy, count(distinct as_of) as decisions,
               sum(weight) / count(distinct as_of) as mean_gross from every group by 1""",
    {
        **BASE,
        **TRANCHED,
        "halves": f"""select 'momentum' as sleeve, as_of, symbol, weight
                        from ({blend_sql("t_sleeves", "0.25e0")}) m
                      union all select 'sixty_forty', e.as_of, v.symbol, v.w from ends e
                        cross join (values ('S01', 0.6e0), ('S02', 0.4e0)) v(symbol, w)
                        where e.as_of >= (select max(f) from (select min(session) as f from bars
                                          where symbol in ('S01', 'S02') group by symbol))""",
    },
)
def _(t):
    out = None
    for name in strategies.STRATEGIES:
        made = strategies.build(name, t.daily, t.sessions, t.instruments)
        row = made.groupBy(F.lit(name).alias("strategy")).agg(
            F.countDistinct("as_of").alias("decisions"),
            (F.sum("weight") / F.countDistinct("as_of")).alias("mean_gross"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def books(t):
    """Holdings, marks and prices on month-end sessions, keyed by as_of."""
    ends = month_decisions(t)
    on = lambda df: df.withColumnRenamed("session", "as_of").join(
        ends, "as_of", "left_semi"
    )
    return on(t.held), on(t.marks), on(t.panel)


ORDERS_SQL = """
select portfolio, as_of, symbol, current, target, delta, price, closing from (
  select *, bool_or(trigger) over (partition by portfolio, as_of) as fire from (
    select *, closing or abs(current - target) / abs(target) > 0.2 as trigger from (
      select portfolio, as_of, symbol, target, price, lot_size,
             quantity * price / nav as current, target = 0 as closing,
             sign(desired - quantity) * floor(abs(desired - quantity) / lot_size) * lot_size as delta
      from (select *, sign(target * nav / price) * floor(abs(target * nav / price) / lot_size)
                      * lot_size as desired
            from (select coalesce(w.portfolio, h.portfolio) as portfolio,
                         coalesce(w.as_of, h.as_of) as as_of, coalesce(w.symbol, h.symbol) as symbol,
                         coalesce(w.target, 0) as target, coalesce(h.quantity, 0) as quantity
                  from (select p.portfolio, t.as_of, t.symbol, t.weight as target
                        from m_targets t cross join (select distinct portfolio from fills) p) w
                  full outer join (select h.portfolio, h.session as as_of, h.symbol, h.quantity
                                   from held h join ends e on e.as_of = h.session) h
                    on h.portfolio = w.portfolio and h.as_of = w.as_of and h.symbol = w.symbol) l
            join (select portfolio as mp, session as ms, nav from marks where nav > 0) m
              on m.mp = l.portfolio and m.ms = l.as_of
            join (select symbol as ps, session as pd, close as price from panel) q
              on q.ps = l.symbol and q.pd = l.as_of
            join (select symbol as isym, lot_size from instruments) i on i.isym = l.symbol
            where price > 0 and (target <> 0 or quantity <> 0)) d) e
    where delta <> 0 and (closing or abs(delta) * price >= 100)) f) g
where fire"""


def orders_of(t):
    held, marks, panel = books(t)
    # Which portfolio follows which strategy; targets fan out along this key.
    follows = t.flows.select("portfolio").distinct().withColumn("variant", F.lit("base"))
    targets = mom.dual_momentum(t.daily, month_decisions(t), t.instruments)
    each = targets.join(follows, "variant").drop("variant")
    return each, held, marks, panel


@query(
    "F13_rebalance_orders",
    "portfolio:s as_of:d symbol:s current:f target:f delta:f closing:b",
    ORDERS_SQL,
    {**BASE, **BOOK},
)
def _(t):
    targets, held, marks, panel = orders_of(t)
    return allocation.rebalance_orders(targets, held, marks, panel, t.instruments)


@query(
    "F14_drawdown_halt",
    "portfolio:s session:d high_water:f drawdown:f halted:b",
    """select portfolio, session, high_water, greatest((high_water - nav) / high_water, 0) as drawdown,
              nav <= 0 or (high_water - nav) / high_water > 0.25 as halted
       from (select *, max(nav) over (partition by portfolio order by session) as high_water
             from nav) t""",
)
def _(t):
    return allocation.drawdown_halt(t.nav)


@query(
    "F15_limit_filter",
    "portfolio:s as_of:d seq:l symbol:s allowed:b reason:s",
    f"""with recursive queue as (
         select *, row_number() over (partition by portfolio, as_of order by symbol) as seq
         from ({ORDERS_SQL}) o),
       first_gross as (
         select h.portfolio, h.session as as_of, sum(abs(h.quantity * q.close)) as gross
         from held h join panel q on q.symbol = h.symbol and q.session = h.session
         where h.quantity <> 0 group by 1, 2),
       judged as (
         select o.portfolio, o.as_of, o.seq, o.symbol, m.nav,
           abs(coalesce(h.quantity, 0) + o.delta) * o.price / m.nav > 0.3e0 as heavy,
           (abs(coalesce(h.quantity, 0) + o.delta) - abs(coalesce(h.quantity, 0))) * o.price as step,
           coalesce(g.gross, 0) as gross
         from queue o join marks m on m.portfolio = o.portfolio and m.session = o.as_of
         left join held h on h.portfolio = o.portfolio and h.session = o.as_of
           and h.symbol = o.symbol
         left join first_gross g on g.portfolio = o.portfolio and g.as_of = o.as_of
         where m.nav > 0),
       walk as (
         select portfolio, as_of, 0::bigint as seq, cast(null as varchar) as symbol,
           cast(null as varchar) as reason, gross from judged where seq = 1
         union all
         select portfolio, as_of, seq, symbol, reason,
           case when reason is null then gross + step else gross end
         from (select j.portfolio, j.as_of, j.seq, j.symbol, w.gross, j.step,
                 case when j.heavy then 'weight cap'
                      when (w.gross + j.step) / j.nav > 0.6e0 then 'gross cap' end as reason
               from walk w join judged j on j.portfolio = w.portfolio and j.as_of = w.as_of
                 and j.seq = w.seq + 1) n)
       select portfolio, as_of, seq, symbol, reason is null as allowed, reason
       from walk where seq > 0""",
    {**BASE, **BOOK},
)
def _(t):
    targets, held, marks, panel = orders_of(t)
    orders = allocation.rebalance_orders(targets, held, marks, panel, t.instruments)
    w = Window.partitionBy("portfolio", "as_of").orderBy("symbol")
    queue = orders.select(
        "portfolio",
        "as_of",
        (F.row_number().over(w)).alias("seq"),
        "symbol",
        F.col("delta").alias("quantity"),
        "price",
    )
    priced = held.join(panel.select("as_of", "symbol", F.col("close").alias("price")), ["as_of", "symbol"])
    return allocation.limit_filter(queue, priced, marks, max_weight=0.30, max_gross=0.60)


@query(
    "F15_independent_limits",
    "portfolio:s as_of:d symbol:s after:f allowed:b",
    f"""select o.portfolio, o.as_of, o.symbol, coalesce(h.quantity, 0) + o.delta as after,
          abs(coalesce(h.quantity, 0) + o.delta) * o.price / m.nav <= 0.3 as allowed
        from ({ORDERS_SQL}) o
        left join held h on h.portfolio = o.portfolio and h.session = o.as_of
          and h.symbol = o.symbol
        join marks m on m.portfolio = o.portfolio and m.session = o.as_of and m.nav > 0""",
    {**BASE, **BOOK},
)
def _(t):
    targets, held, marks, panel = orders_of(t)
    orders = allocation.rebalance_orders(targets, held, marks, panel, t.instruments)
    return allocation.independent_limits(
        orders.withColumnRenamed("delta", "quantity"), held, marks, max_weight=0.30
    )


TREND_UNITS = """select t.as_of, t.symbol, t.weight, q.close as price,
         case when abs(q.close * 50) > 0
              then sign(t.weight) * floor(abs(t.weight * 1000000 / abs(q.close * 50))) else 0 end
           as units
       from m_targets t join panel q on q.symbol = t.symbol and q.session = t.as_of"""


def units_of(t):
    panel = t.panel.withColumnRenamed("session", "as_of")
    made = mom.dual_momentum(t.daily, month_decisions(t), t.instruments)
    return made.join(panel, ["as_of", "symbol"]).withColumn(
        "units", allocation.whole_units(F.col("weight"), F.lit(1e6), F.col("close"), 50.0)
    )


@query(
    "F16_whole_unit_targets",
    "as_of:d symbol:s units:l",
    TREND_UNITS,
    {**BASE, **BOOK},
)
def _(t):
    return units_of(t)


@query(
    "F17_margin_gate",
    "as_of:d margin_fraction:f admitted:b",
    f"""select as_of, sum(abs(units) * 2500) / 1000000 as margin_fraction,
               sum(abs(units) * 2500) / 1000000 <= 0.35 as admitted
        from ({TREND_UNITS}) u group by 1""",
    {**BASE, **BOOK},
)
def _(t):
    targets = units_of(t).select(
        F.lit("fund").alias("portfolio"), "as_of", "symbol", "units", F.lit(2500.0).alias("margin")
    )
    marks = month_decisions(t).select(
        F.lit("fund").alias("portfolio"), "as_of", F.lit(1e6).alias("nav")
    )
    return allocation.margin_gate(targets, marks)


#: What an entry takes of the budget, by strength: a large one that does not fit is skipped, and
#: a smaller one behind it may still enter.
PAIR_GROSS = "case when abs(zscore) >= 1.5 then 0.15e0 when abs(zscore) >= 0.9 then 0.3e0 else 0.1e0 end"


@query(
    "F17_gross_budget",
    "session:d pair:s admitted:b",
    f"""with recursive queue as (
         select session, pair, {PAIR_GROSS} as gross,
           row_number() over (partition by session order by abs(zscore) desc, pair) as n
         from pair_ok where eligible and abs(zscore) >= 0.5),
       walk as (
         select session, pair, n, gross <= 0.40e0 + 1e-12 as admitted,
           case when gross <= 0.40e0 + 1e-12 then gross else 0e0 end as used
         from queue where n = 1
         union all
         select q.session, q.pair, q.n, w.used + q.gross <= 0.40e0 + 1e-12,
           case when w.used + q.gross <= 0.40e0 + 1e-12 then w.used + q.gross else w.used end
         from walk w join queue q on q.session = w.session and q.n = w.n + 1)
       select session, pair, admitted from walk""",
    SHARED,
)
def _(t):
    entries = pairs.entry_weights(pair_eligibility(t), entry_z=0.5)
    return allocation.gross_budget(
        entries.select(
            "session",
            "pair",
            F.abs("zscore").alias("strength"),
            F.expr(PAIR_GROSS).alias("gross"),
        ),
        budget=0.40,
    )
