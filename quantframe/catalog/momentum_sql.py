"""SQL twin of the momentum plan: one pass per variant, full covariance matrix."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from quantframe.plans.momentum import complete


def covariance(name: str, members: str, keys: str, shrink: float = 0.25) -> dict[str, str]:
    """CTEs ``{name}_lines`` and ``{name}`` for members carrying n and length."""
    on = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    mk = ", ".join(f"m.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return {
        f"{name}_ret": """select symbol, session, row_number() over w as n,
              close / lag(close) over w - 1 as ret
            from bars window w as (partition by symbol order by session)""",
        f"{name}_lines": f"""select {mk}, m.symbol, m.n - r.n as pos, r.ret as r
            from ({members}) m join {name}_ret r
              on r.symbol = m.symbol and r.n between m.n - m.length + 1 and m.n
            where r.ret is not null""",
        f"{name}_raw": f"""select {ak}, a.symbol as sym_a, b.symbol as sym_b,
              covar_samp(a.r, b.r) as c, stddev_samp(a.r) as sa, stddev_samp(b.r) as sb
            from {name}_lines a join {name}_lines b on {on} and a.pos = b.pos
            group by all""",
        name: f"""select {keys}, sym_a, sym_b,
              case when sym_a = sym_b or mean is null then c
                   else coalesce((({1 - shrink} * c / nullif(sa * sb, 0) + {shrink} * mean)
                                  * sa * sb), 0) end as cov, mean
            from (select *, avg(case when sym_a <> sym_b then c / nullif(sa * sb, 0) end)
                    over (partition by {keys}) as mean from {name}_raw) t""",
    }


def momentum_ctes(
    p: str, dates: str, variants: Sequence[Mapping[str, Any]], cash: str = "S00"
) -> dict[str, str]:
    """CTEs ending in ``{p}targets(variant, as_of, symbol, weight)``; ``dates`` yields as_of."""
    rows = [complete(v) for v in variants]
    months = sorted({m for r in rows for m in r["lookbacks"]})
    trends = sorted({r["trend_window"] for r in rows})
    vols = sorted({r["vol_lookback"] for r in rows})
    over = "over (partition by symbol order by session"
    mom = ", ".join(f"lag(close, 21) {over}) / lag(close, {21 + 21 * m}) {over}) - 1 as m{m}" for m in months)
    sma = ", ".join(
        f"avg(close) {over} rows between {w - 1} preceding and current row) as a{w}" for w in trends
    )
    vol = ", ".join(
        f"stddev_samp(ret) {over} rows between {v - 1} preceding and current row) as v{v}" for v in vols
    )
    pick = lambda prefix, col, values: (
        f"case {col} " + " ".join(f"when {v} then {prefix}{v}" for v in values) + " end"
    )
    knobs = ", ".join(
        f"('{r['variant']}', {r['top_n']}, {r['trend_window']}, {r['target_vol']}e0,"
        f" {r['vol_lookback']}, {r['max_weight']}e0, {r['need']})"
        for r in rows
    )
    legs = ", ".join(f"('{r['variant']}', {m})" for r in rows for m in r["lookbacks"])
    out = {
        f"{p}dates": dates,
        f"{p}feat": f"""select *, {vol} from (
            select symbol, session, close, row_number() {over}) as n,
              close / lag(close) {over}) - 1 as ret, {mom}, {sma} from bars) t""",
        f"{p}seen": f"""select g.as_of, f.* from (
              select d.as_of, s.symbol from (select distinct as_of from {p}dates) d
              join instruments s on s.symbol <> '{cash}'
                and (s.available_from is null or d.as_of >= s.available_from)) g
            asof join {p}feat f on g.symbol = f.symbol and g.as_of >= f.session""",
        f"{p}knobs": f"""select * from (values {knobs}) k(variant, top_n, trend_window,
            target_vol, vol_lookback, max_weight, need)""",
        f"{p}ranks": f"""select variant, as_of, symbol,
              rank() over (partition by variant, months, as_of order by value asc nulls first)
              + (count(*) over (partition by variant, months, as_of, value) - 1) / 2e0 as rnk
            from (select k.variant, s.as_of, s.symbol, l.months,
                    {pick("s.m", "l.months", months)} as value
                  from {p}seen s cross join {p}knobs k
                  join (values {legs}) l(variant, months) on l.variant = k.variant
                  where s.n >= k.need) t""",
        f"{p}picked": f"""select k.variant, s.as_of, s.symbol, s.n, q.score, q.place,
              s.close > {pick("s.a", "k.trend_window", trends)} as passing,
              {pick("s.v", "k.vol_lookback", vols)} as vol, k.vol_lookback as length,
              k.target_vol, k.max_weight, k.need
            from (select *, row_number() over (partition by variant, as_of
                            order by score desc, symbol) as place,
                         count(*) over (partition by variant, as_of) as cnt
                  from (select variant, as_of, symbol, avg(rnk) as score
                        from {p}ranks group by 1, 2, 3) a) q
            join {p}knobs k on k.variant = q.variant
            join {p}seen s on s.as_of = q.as_of and s.symbol = q.symbol
            where q.place <= k.top_n and q.cnt >= 2""",
        f"{p}rel": f"""select *, floor((1 / vol) / sum(1 / vol) over (partition by variant, as_of)
              * 1e6 + 0.5e0) / 1e6 as weight from {p}picked where vol > 0""",
        **covariance(f"{p}cov", f"select * from {p}rel", "variant, as_of"),
        f"{p}risk": f"""select a.variant, a.as_of, any_value(a.target_vol) as target_vol,
              sqrt(greatest(sum(a.weight * b.weight * c.cov), 0) * 252) as volatility,
              any_value(c.mean) as mean_correlation
            from {p}rel a join {p}rel b on a.variant = b.variant and a.as_of = b.as_of
            join {p}cov c on c.variant = a.variant and c.as_of = a.as_of
              and c.sym_a = a.symbol and c.sym_b = b.symbol
            group by 1, 2""",
        f"{p}scaled": f"""select *, coalesce(least(target_vol / nullif(volatility, 0), 1e0), 1e0)
              as scale, coalesce(target_vol / nullif(volatility, 0) > 1, true) as capped
            from {p}risk""",
        f"{p}sized": f"""select r.variant, r.as_of, r.symbol, r.passing, r.max_weight, r.n, r.need,
              floor(r.weight * s.scale * 1e6 + 0.5e0) / 1e6 as weight
            from {p}rel r join {p}scaled s using (variant, as_of)""",
        f"{p}kept": f"""select variant, as_of, symbol, n, need,
              least(weight, max_weight) as weight from {p}sized where passing""",
        f"{p}targets": f"""select variant, as_of, symbol, weight from {p}kept
            union all
            select variant, as_of, '{cash}', 1 - coalesce(held, 0) from (
              select distinct p.variant, p.as_of, (select sum(weight) from {p}kept k
                where k.variant = p.variant and k.as_of = p.as_of) as held
              from {p}picked p) c where 1 - coalesce(held, 0) > 5e-7""",
    }
    return out
