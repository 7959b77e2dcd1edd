"""SQL twins of the book: cash, holdings, filled prices and marks."""

from __future__ import annotations

_V = "cast(round((-quantity * price - commission) * 10000) as bigint)"
# Half-even rounding to the cent of an exact number of hundredths of a cent.
IMPACT = f"""((case when ({_V}) - 100 * cast(floor(({_V}) / 100e0) as bigint) > 50
  or (({_V}) - 100 * cast(floor(({_V}) / 100e0) as bigint) = 50
      and cast(floor(({_V}) / 100e0) as bigint) % 2 <> 0) then 1 else 0 end)
  + cast(floor(({_V}) / 100e0) as bigint))"""

BOOK = {
    "panel": """select s.session, s.seq, x.symbol, b.close,
                  case when b.session = s.session then b.open else b.close end as open
                from (select distinct symbol from bars) x cross join sessions s
                asof join bars b on b.symbol = x.symbol and s.session >= b.session""",
    "held_run": """select portfolio, symbol, session, sum(d) over
                     (partition by portfolio, symbol order by session) as quantity
                   from (select portfolio, symbol, session, sum(quantity) as d
                         from fills group by 1, 2, 3) t""",
    "held": """select k.portfolio, k.symbol, s.session, h.quantity
               from (select distinct portfolio, symbol from fills) k cross join sessions s
               asof join held_run h on h.portfolio = k.portfolio and h.symbol = k.symbol
                 and s.session >= h.session""",
    "cash_run": f"""select portfolio, session, 100000000e0 + sum(i) over
                      (partition by portfolio order by session) / 100e0 as cash
                    from (select portfolio, session, sum({IMPACT}) as i from fills
                          group by 1, 2) t""",
    "cash_at": """select k.portfolio, s.session, c.cash
                  from (select distinct portfolio from fills) k cross join sessions s
                  asof join cash_run c on c.portfolio = k.portfolio and s.session >= c.session""",
    "mlines": """select h.portfolio, h.symbol, h.session, h.quantity, p.close,
                   h.quantity * p.close as value
                 from held h left join panel p using (symbol, session) where h.quantity <> 0""",
    "marks": """select c.portfolio, c.session, c.cash, c.cash + coalesce(l.mv, 0) as nav,
                  coalesce(l.gross / (c.cash + coalesce(l.mv, 0)), 0) as gross_exposure,
                  coalesce(l.k, 0) as holdings
                from cash_at c left join (
                  select portfolio, session, sum(value) as mv, sum(abs(value)) as gross,
                         count(*) as k from mlines group by 1, 2) l using (portfolio, session)""",
    "fold_rows": """select *, row_number() over (partition by portfolio, symbol
                      order by ts, execution_id) as rn from fills""",
    "margin": "select date, greatest(annual_rate, 0) + 0.015e0 as annual_rate from rates",
    "gaps": """select portfolio, session, nav, cash, lead(session) over
                 (partition by portfolio order by session) as until from marks""",
}

POSITIONS = """
with recursive st(portfolio, symbol, rn, q, avg_cost, realized) as (
  select distinct portfolio, symbol, cast(0 as bigint), 0e0, 0e0, 0e0 from fills
  union all
  select s.portfolio, s.symbol, f.rn, s.q + f.quantity,
    case when s.q + f.quantity = 0 then 0
         when s.q = 0 or sign(s.q) = sign(f.quantity)
           then (abs(s.q) * s.avg_cost + abs(f.quantity) * f.price) / abs(s.q + f.quantity)
         when abs(f.quantity) <= abs(s.q) then s.avg_cost else f.price end,
    s.realized + case when s.q = 0 or sign(s.q) = sign(f.quantity) then 0
         else least(abs(f.quantity), abs(s.q)) * (f.price - s.avg_cost) * sign(s.q) end
  from st s join fold_rows f on f.portfolio = s.portfolio and f.symbol = s.symbol
    and f.rn = s.rn + 1)
select s.portfolio, s.symbol, s.q as quantity, s.avg_cost, s.realized, c.commission, c.fills
from st s join (select portfolio, symbol, count(*) as fills, sum(commission) as commission
                from fills group by 1, 2) c
  on c.portfolio = s.portfolio and c.symbol = s.symbol and c.fills = s.rn"""

PNL = {
    **BOOK,
    "pos": POSITIONS,
    "last_close": "select symbol, max_by(close, session) as close from bars group by 1",
    "pnl": """select p.portfolio, p.symbol, p.quantity, abs(p.quantity) * p.avg_cost as cost_basis,
                case when p.quantity <> 0 then p.quantity * (l.close - p.avg_cost) else 0 end
                  as unrealized, p.realized - p.commission as net_realized, p.realized, p.commission
              from pos p left join last_close l using (symbol)""",
    "attrib": """select coalesce(p.portfolio, w.portfolio) as portfolio,
                   coalesce(p.symbol, w.symbol) as symbol,
                   coalesce(p.realized, 0) as realized, coalesce(p.unrealized, 0) as unrealized,
                   coalesce(p.commission, 0) as commission,
                   coalesce(w.w / n.sessions, 0) as average_weight,
                   coalesce(w.k, 0) as sessions_held, coalesce(w.k / n.sessions, 0) as time_held,
                   coalesce(p.realized, 0) + coalesce(p.unrealized, 0) - coalesce(p.commission, 0)
                     as net
                 from pnl p full outer join (
                   select l.portfolio, l.symbol, sum(l.value / m.nav) as w, count(*) as k
                   from mlines l join marks m using (portfolio, session)
                   where m.nav > 0 and l.value <> 0 group by 1, 2) w
                   on p.portfolio = w.portfolio and p.symbol = w.symbol
                 join (select portfolio, count(*) as sessions from marks group by 1) n
                   on n.portfolio = coalesce(p.portfolio, w.portfolio)""",
}


def segment_ctes(p: str, targets: str, cost: float | str = 0.0, initial: float = 100000.0) -> dict[str, str]:
    """CTEs ending in ``{p}nav(variant, session, nav, exposure, turnover)``."""
    return {
        **BOOK,
        f"{p}tg": targets,
        f"{p}span": f"""select variant, as_of, start_seq, end_seq,
              coalesce(end_seq - 1, last_seq) as stop_seq
            from (select t.variant, t.as_of, s.seq + 1 as start_seq,
                    lead(s.seq + 1) over (partition by t.variant order by t.as_of) as end_seq,
                    (select max(seq) from sessions) as last_seq
                  from (select distinct variant, as_of from {p}tg) t
                  join sessions s on s.session = t.as_of) q
            where start_seq <= last_seq""",
        f"{p}lot": f"""select t.*, s.start_seq, s.end_seq, s.stop_seq, q.open as p0
            from {p}tg t join {p}span s on s.variant = t.variant and s.as_of = t.as_of
            join panel q on q.symbol = t.symbol and q.seq = s.start_seq""",
        f"{p}day": f"""select l.variant, l.as_of, q.session, q.seq, l.start_seq,
              1 - sum(l.weight) + sum(l.weight * q.close / l.p0) as g,
              sum(l.weight * q.close / l.p0) as v
            from {p}lot l join panel q on q.symbol = l.symbol
              and q.seq between l.start_seq and l.stop_seq
            group by all""",
        f"{p}end": f"""select l.variant, l.as_of, l.end_seq,
              1 - sum(l.weight) + sum(l.weight * q.open / l.p0) as g
            from {p}lot l join panel q on q.symbol = l.symbol and q.seq = l.end_seq
            group by all""",
        f"{p}turn": f"""select variant, seq, sum(abs(d)) as turnover from (
              select variant, seq, symbol, sum(w) as d from (
                select variant, start_seq as seq, symbol, weight as w from {p}lot
                union all
                select l.variant, l.end_seq, l.symbol, -(l.weight * q.open / l.p0) / e.g
                from {p}lot l join panel q on q.symbol = l.symbol and q.seq = l.end_seq
                join {p}end e on e.variant = l.variant and e.as_of = l.as_of) u
              group by 1, 2, 3) v group by 1, 2""",
        f"{p}base": f"""select variant, as_of, start_seq, turnover, {initial}
                * exp(sum(ln(coalesce(prev, 1) * (1 - {cost} * coalesce(turnover, 0))))
                      over (partition by variant order by start_seq)) as base
            from (select s.variant, s.as_of, s.start_seq, t.turnover,
                    lag(e.g) over (partition by s.variant order by s.start_seq) as prev
                  from {p}span s left join {p}end e on e.variant = s.variant and e.as_of = s.as_of
                  left join {p}turn t on t.variant = s.variant and t.seq = s.start_seq) q""",
        f"{p}nav": f"""select d.variant, d.session, b.base * d.g as nav, d.v / d.g as exposure,
              case when d.seq = d.start_seq then b.turnover else 0 end as turnover
            from {p}day d join {p}base b on b.variant = d.variant and b.as_of = d.as_of""",
    }
