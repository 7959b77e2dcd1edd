"""Futures queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.operators import calendars as cal
from quantframe.operators import futures

ROLLS = {
    "weekdays": """select day, row_number() over (order by day) as k from (
        select cast(unnest(generate_series(timestamp '1994-01-01', timestamp '2003-12-31',
          interval 1 day)) as date) as day) d where isodow(day) <= 5""",
    "contracts": """select c.*, w.day as cutoff from (
          select market, contract, last_trade, row_number() over
            (partition by market order by last_trade, contract) - 1 as idx,
            (select max(k) from weekdays where day < last_trade) - 4 as wk
          from (select distinct market, contract, last_trade from chain) t) c
        join weekdays w on w.k = c.wk""",
    "msess": """select market, session, row_number() over (partition by market order by session) as rn
        from (select distinct market, session from chain) t""",
    "cvol": """select c.market, c.session, k.idx, c.volume, c.close, c.contract,
          lag(c.close) over (partition by c.market, c.contract order by c.session) as previous_close
        from chain c join contracts k on k.market = c.market and k.contract = c.contract""",
    "rolls": """with recursive st(market, rn, session, i, p, wait, reason) as (
          select m.market, cast(0 as bigint), cast(null as date),
            (select min(idx) from contracts c where c.market = m.market
               and c.last_trade >= m.session), cast(null as bigint), false, cast(null as varchar)
          from msess m where m.rn = 1
          union all
          select z.market, z.rn, z.session, z.i,
            case when z.rn = 1 then null else z.old end as p,
            case when front.volume is not null and nxt.volume is not null
                 then nxt.volume > front.volume else z.wait end,
            case when z.rn = 1 then 'initial' else z.reason end
          from (
            select y.market, y.rn, y.session, y.old,
              case when y.session >= k.cutoff and y.i + 1 < y.n then y.i + 1 else y.i end as i,
              case when y.session >= k.cutoff and y.i + 1 < y.n then false else y.wait end as wait,
              case when y.session >= k.cutoff and y.i + 1 < y.n then 'expiry' else y.reason end
                as reason
            from (
              select s.market, m.rn, m.session, s.i as old, n.n,
                case when s.wait and s.i + 1 < n.n then s.i + 1 else s.i end as i,
                case when s.wait and s.i + 1 < n.n then false else s.wait end as wait,
                case when s.wait and s.i + 1 < n.n then 'volume' else 'hold' end as reason
              from st s join msess m on m.market = s.market and m.rn = s.rn + 1
              join (select market, count(*) as n from contracts group by 1) n
                on n.market = s.market) y
            join contracts k on k.market = y.market and k.idx = y.i) z
          left join cvol front on front.market = z.market and front.session = z.session
            and front.idx = z.i
          left join cvol nxt on nxt.market = z.market and nxt.session = z.session
            and nxt.idx = z.i + 1)
        select s.market, s.session, c.contract, p.contract as previous_contract, s.reason
          as roll_reason, s.i
        from st s join contracts c on c.market = s.market and c.idx = s.i
        left join contracts p on p.market = s.market and p.idx = s.p
        where s.rn > 0""",
}

STITCHED = """select r.market, r.session, r.contract, r.roll_reason,
    (v.close / v.previous_close - 1) * case when r.market = 'M2' then -1 else 1 end as ret
  from rolls r left join cvol v on v.market = r.market and v.session = r.session
    and v.contract = r.contract"""


@query(
    "K01_roll_map",
    "market:s session:d contract:s previous_contract:s roll_reason:s",
    "select * from rolls",
    ROLLS,
)
def _(t):
    return futures.roll_map(t.chain)


@query(
    "K02_stitched_returns",
    "market:s session:d contract:s roll_reason:s ret:f",
    STITCHED,
    ROLLS,
)
def _(t):
    return futures.stitched_returns(t.chain, futures.roll_map(t.chain), {"M2": -1})


@query(
    "K03_roll_costs",
    "market:s session:d leg:s contract:s quantity:l commission:f spread_cost:f",
    """select r.market, r.session, l.leg, case l.leg when 'roll-close' then r.previous_contract
              else r.contract end as contract,
              case l.leg when 'roll-close' then -q.quantity else q.quantity end as quantity,
              abs(q.quantity) * 2.5 as commission, abs(q.quantity) * 0.25 * 50 as spread_cost
       from rolls r join (select market, count(distinct contract) as quantity from chain
                          group by 1) q on q.market = r.market
       cross join (values ('roll-close'), ('roll-open')) l(leg)
       where r.previous_contract is not null and r.contract <> r.previous_contract""",
    ROLLS,
)
def _(t):
    held = t.chain.groupBy("market").agg(F.count_distinct("contract").alias("quantity"))
    return futures.roll_costs(futures.roll_map(t.chain), t.chain, held)


@query(
    "K04_business_days_before",
    "session:d five_before:d seven_before:d",
    """select b.session, f.day as five_before, s.day as seven_before
       from (select session, (select max(k) from weekdays where day < session) as k
             from (select distinct session from bars) d) b
       join weekdays f on f.k = b.k - 4 join weekdays s on s.k = b.k - 6""",
    ROLLS,
)
def _(t):
    days = t.ticks.select("session").distinct()
    return days.select(
        "session",
        cal.business_days_before("session", 5).alias("five_before"),
        cal.business_days_before("session", 7).alias("seven_before"),
    )


@query(
    "D01_roll_closes",
    "market:s session:d contract:s close:f previous_close:f",
    """select r.market, r.session, r.contract, v.close, v.previous_close
       from rolls r left join cvol v on v.market = r.market and v.session = r.session
         and v.contract = r.contract""",
    ROLLS,
)
def _(t):
    return futures.rolled_closes(t.chain, futures.roll_map(t.chain))
