"""DuckDB spellings of the derived inputs, assembled into CTEs on demand."""

from __future__ import annotations

import re

_PX = "95 + (l_extendedprice / l_quantity) / 400"
_KEY = (
    "cast(l_orderkey as hugeint) * 100000000000000000000000"
    " + cast(l_partkey as hugeint) * 1000000000000 + l_suppkey * 10 + l_linenumber"
)
_SYM = "concat('S', lpad(cast(l_suppkey % 12 as varchar), 2, '0'))"

CTES: dict[str, str] = {
    "bars": f"""
select symbol, session, min_by(px, k) as open, max(px) as high, min(px) as low,
       max_by(px, k) as close, sum(l_quantity) as volume
from (select {_SYM} as symbol, cast(l_shipdate as date) as session, l_quantity,
             ({_PX}) * (1 + ((l_suppkey % 12) - 5.5e0) * 0.00002e0
               * datediff('day', date '1995-01-01', cast(l_shipdate as date))) as px,
             {_KEY} as k
      from lineitem) t
group by symbol, session""",
    "sessions": """
select session, row_number() over (order by session) - 1 as seq
from (select distinct session from bars where isodow(session) <= 5) t""",
    "instruments": """
select symbol,
       case when idx >= 10 then 'crypto' else 'etf' end as asset_class,
       case when idx >= 10 then 0.01e0 else 1e0 end as lot_size,
       idx >= 10 as trades_continuously,
       case idx when 10 then date '1997-01-01' when 11 then date '1999-01-01' end
         as available_from,
       case when idx < 10 then 0.3e0 + 0.2e0 * idx end as half_spread_bps
from (select distinct symbol, cast(substr(symbol, 2) as int) as idx from bars) t""",
    "fills": f"""
select concat('P', cast(l_orderkey % 8 as varchar)) as portfolio, {_SYM} as symbol,
       l_shipdate as ts, cast(l_shipdate as date) as session,
       case when l_returnflag = 'R' then -l_quantity else l_quantity end as quantity,
       floor(({_PX}) * 10000 + 0.5e0) / 10000 as price,
       greatest(0.35e0, floor(0.35e0 * l_quantity + 0.5e0) / 100) as commission,
       floor(l_quantity * 100 * l_tax + 0.5e0) / 100 as slippage,
       concat('O', cast(l_orderkey as varchar)) as order_id,
       {_KEY} as execution_id, l_linestatus as venue, l_tax as tax
from lineitem""",
    "order_book": """
select concat('I', cast(execution_id as varchar)) as order_id, portfolio, symbol, quantity,
       case when execution_id % 2 = 0 then ts - interval 20 hour
            else ts - interval 5 day end as created_at
from fills""",
    "amendments": """
select execution_id, 1 as version, ts, price + 0.01 as price, commission,
       slippage + 0.5e0 as slippage, 'first import' as import_id
from fills where tax >= 0.08
union all
select execution_id, 2, ts + interval 1 hour, price + 0.02, null, null, 'second import'
from fills where tax >= 0.08""",
    "nav": """
select portfolio, session,
       floor(100000 * exp(sum(ln(1 + r)) over (partition by portfolio order by session))
             * 1e6 + 0.5e0) / 1e6 as nav
from (select concat('P', cast(o_custkey % 8 as varchar)) as portfolio,
             cast(o_orderdate as date) as session,
             0.0003e0 + 0.02e0 * (avg(o_totalprice) / 250000e0 - 1) as r
      from orders group by 1, 2) t""",
    "rates": """
select cast(date_trunc('month', o_orderdate) as date) as date,
       floor((0.01e0 + 0.03e0 * avg(case when o_orderstatus = 'F' then 1e0 else 0e0 end))
             * 1e6 + 0.5e0) / 1e6 as annual_rate
from orders group by 1""",
    "factors": """
select month, factor, ret from (
  select month,
         case region when 'EUROPE' then 'core_excess' when 'AMERICA' then 'market'
              when 'ASIA' then 'value' when 'AFRICA' then 'quality' else 'composite' end as factor,
         0.1e0 * (level / lag(level) over (partition by region order by month) - 1) as ret
  from (select cast(date_trunc('month', o_orderdate) as date) as month, r_name as region,
               avg(o_totalprice) as level
        from orders join customer on o_custkey = c_custkey
             join nation on c_nationkey = n_nationkey
             join region on n_regionkey = r_regionkey
        group by 1, 2) a) b
where ret is not null""",
    "chain": f"""
select market,
       concat(market, '-', cast(year(quarter) as varchar), 'Q',
              cast(quarter(quarter) as varchar)) as contract,
       session, cast(quarter + interval 3 month - interval 1 day as date) as last_trade,
       min_by(px, k) as open, max(px) as high, min(px) as low, max_by(px, k) as close,
       sum(volume) as volume, 50e0 as multiplier
from (
  select market, session, k, cast(q0 as date) as quarter, px,
         l_quantity * datediff('day', session, cast(q0 + interval 3 month as date)) as volume
  from ticks
  union all
  select market, session, k, cast(q0 + interval 3 month as date), px * 1.01e0 + 1e0,
         l_quantity * (0.5e0 + 10e0 * l_tax)
           * (92 - datediff('day', session, cast(q0 + interval 3 month as date)))
  from ticks) u
group by market, quarter, session""",
    "ticks": f"""
select concat('M', cast(l_suppkey % 4 as varchar)) as market,
       cast(l_shipdate as date) as session, l_quantity, l_tax, {_PX} as px, {_KEY} as k,
       date_trunc('quarter', l_shipdate) as q0
from lineitem""",
}


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """The CTE prefix holding every derived input ``sql`` mentions, dependencies first."""
    pool = {**CTES, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str, own: str | None) -> None:
        for name in pool:
            if name != own and name not in ordered and re.search(rf"\b{name}\b", text):
                visit(pool[name], name)
                if name not in ordered:
                    ordered.append(name)

    visit(sql, None)
    if not ordered:
        return ""
    return "with " + ",\n".join(f"{n} as materialized ({pool[n]})" for n in ordered) + "\n"
