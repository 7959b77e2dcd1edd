"""Return, rank, trend, pair and trend-following queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.operators import calendars as cal
from quantframe.operators import metrics, pairs, signals, trend

W = "over (partition by symbol order by session)"
ENDS = """
select session as as_of, seq from (
  select session, seq, lead(session) over (order by session) as nxt from sessions) t
where date_trunc('month', nxt) <> date_trunc('month', session)"""

SHARED = {
    "ends": ENDS,
    "grid": "select as_of, symbol from ends cross join (select distinct symbol from bars) s",
    "weeks": """select max(session) as as_of from sessions where isodow(session) <= 5
                group by date_trunc('week', session)""",
    "week_grid": "select as_of, symbol from weeks cross join (select distinct symbol from bars) s",
    "sret": f"""select symbol, session, ret from (
                  select symbol, session, close / lag(close) {W} - 1 as ret from bars) t
                where ret is not null""",
    "lret": f"""select symbol, session, ret from (
                  select symbol, session, ln(close) - lag(ln(close)) {W} as ret from bars) t
                where ret is not null""",
    "mret": """select l.symbol, l.session, l.ret, m.mkt from lret l join (
                 select session, avg(ret) as mkt from lret group by session) m using (session)""",
    "mom": f"""select symbol, session, m.months,
                 case m.months when 3 then c3 when 6 then c6 else c12 end as mom
               from (select symbol, session,
                       lag(close, 21) {W} / lag(close, 84) {W} - 1 as c3,
                       lag(close, 21) {W} / lag(close, 147) {W} - 1 as c6,
                       lag(close, 21) {W} / lag(close, 273) {W} - 1 as c12 from bars) t
               cross join (values (3), (6), (12)) m(months)""",
    "ranked": """select symbol, session, months, mom,
                   rank() over (partition by session, months order by mom asc nulls first)
                   + (count(*) over (partition by session, months, mom) - 1) / 2e0 as rnk
                 from mom""",
    "scored": """select session, symbol, score from (
                   select session, symbol, avg(rnk) as score,
                          count(*) over (partition by session) as k
                   from ranked group by session, symbol) t where k >= 2""",
    "betas": """select symbol, session, case when n = 252 then c / nullif(v, 0) end as beta
                from (select symbol, session, count(ret) over w as n,
                        covar_samp(ret, mkt) over w as c, var_samp(mkt) over w as v from mret
                      window w as (partition by symbol order by session
                                   rows between 251 preceding and current row)) t""",
    "sector": f"""select symbol, session,
                    lag(close, 21) {W} / lag(close, 126) {W} - 1
                    + lag(close, 21) {W} / lag(close, 252) {W} - 1 as score from bars""",
    "pair_list": """select concat('PAIR', cast(k as varchar)) as pair,
                      concat('S', lpad(cast(2 * k as varchar), 2, '0')) as left_symbol,
                      concat('S', lpad(cast(2 * k + 1 as varchar), 2, '0')) as right_symbol
                    from (select distinct cast(substr(symbol, 2) as int) // 2 as k from instruments) t
                    where concat('S', lpad(cast(2 * k as varchar), 2, '0')) in (select symbol from instruments)
                      and concat('S', lpad(cast(2 * k + 1 as varchar), 2, '0')) in (select symbol from instruments)""",
    "pair_rows": """select p.pair, a.session, ln(a.close) as l, ln(b.close) as r
                    from pair_list p join bars a on a.symbol = p.left_symbol
                    join bars b on b.symbol = p.right_symbol and b.session = a.session""",
    "pair_lags": """select *, l - l1 as dl, r - r1 as dr from (
                      select pair, session, l - first_value(l) over u as l,
                             r - first_value(r) over u as r,
                             lag(l) over u - first_value(l) over u as l1,
                             lag(r) over u - first_value(r) over u as r1
                      from pair_rows window u as (partition by pair order by session)) t""",
    "pair_fit": """select pair, session, l, r, count(l) over t as n, regr_slope(l, r) over t as b,
                     avg(l) over t as ml, avg(r) over t as mr,
                     regr_slope(l, r) over e as b1, regr_slope(l, r) over z as b2,
                     var_samp(l) over t as vl, var_samp(r) over t as vr,
                     covar_samp(l, r) over t as clr,
                     covar_pop(dl, l1) over g as c1, covar_pop(dl, r1) over g as c2,
                     covar_pop(dr, l1) over g as c3, covar_pop(dr, r1) over g as c4,
                     var_pop(l1) over g as v1, var_pop(r1) over g as v2,
                     covar_pop(l1, r1) over g as v3, var_pop(dl) over g as w1,
                     var_pop(dr) over g as w2, covar_pop(dl, dr) over g as w3
                   from pair_lags
                   window t as (partition by pair order by session
                                rows between 252 preceding and 1 preceding),
                          e as (partition by pair order by session
                                rows between 252 preceding and 127 preceding),
                          z as (partition by pair order by session
                                rows between 126 preceding and 1 preceding),
                          g as (partition by pair order by session
                                rows between 251 preceding and 1 preceding)""",
    "pair_sig": """select pair, session, n, case when n = 252 then b end as beta,
                     case when n = 252 then ml - b * mr end as intercept,
                     case when n = 252 then b1 end as first_beta,
                     case when n = 252 then b2 end as second_beta,
                     case when n = 252 then coalesce((l - ml - b * (r - mr))
                       / nullif(sqrt(greatest(vl - 2 * b * clr + b * b * vr, 0)), 0), 0) end as zscore,
                     case when n = 252 then (sxy / sxx)
                       / sqrt((syy - sxy * sxy / sxx) / 249 / sxx) end as adf_t
                   from (select *, c1 - b * c2 - b * c3 + b * b * c4 as sxy,
                           v1 - 2 * b * v3 + b * b * v2 as sxx,
                           w1 - 2 * b * w3 + b * b * w2 as syy from pair_fit) t""",
    "pair_ok": """select *, reason = 'eligible' as eligible from (
                    select *, case when beta is null then 'insufficient history'
                      when least(beta, first_beta, second_beta) <= 0
                        then 'non-positive hedge ratio'
                      when abs(second_beta - first_beta)
                           / greatest(abs(first_beta), abs(second_beta)) > 0.25
                        then 'unstable hedge ratio'
                      when adf_t is null or adf_t > -3.34 then 'residual is not stationary'
                      else 'eligible' end as reason from pair_sig) t""",
    "trend_rows": """select symbol, session, ret, row_number() over s as n,
                       case when count(ret) over a = 63
                            then exp(sum(ln(1 + ret)) over a) - 1 end as h63,
                       case when count(ret) over b = 126
                            then exp(sum(ln(1 + ret)) over b) - 1 end as h126,
                       case when count(ret) over c = 252
                            then exp(sum(ln(1 + ret)) over c) - 1 end as h252
                     from sret
                     window s as (partition by symbol order by session),
                            a as (partition by symbol order by session
                                  rows between 67 preceding and 5 preceding),
                            b as (partition by symbol order by session
                                  rows between 130 preceding and 5 preceding),
                            c as (partition by symbol order by session
                                  rows between 256 preceding and 5 preceding)""",
    "trend_at": """select g.as_of, h.*, sign(sign(h63) + sign(h126) + sign(h252)) as direction
                   from week_grid g asof join trend_rows h
                     on g.symbol = h.symbol and g.as_of >= h.session""",
    "trend_lines": """select a.as_of, a.symbol, a.direction, a.n - h.n as pos, h.ret as x,
                        pow(1 - 2e0 / 64, a.n - h.n)
                          / (select sum(pow(1 - 2e0 / 64, k)) from range(0, 63) q(k)) as w
                      from trend_at a join trend_rows h
                        on h.symbol = a.symbol and h.n between a.n - 62 and a.n
                      where a.n >= 257""",
    "trend_vol": """select as_of, symbol, any_value(direction) as direction,
                      greatest(sqrt(greatest(sum(w * x * x) - pow(sum(w * x), 2), 0) * 252), 0.05)
                        as vol
                    from trend_lines group by as_of, symbol""",
    "trend_cov": """select a.as_of, a.symbol as sym_a, b.symbol as sym_b,
                      sum(a.w * a.x * b.x) - sum(a.w * a.x) * sum(a.w * b.x) as cov
                    from trend_lines a join trend_lines b
                      on a.as_of = b.as_of and a.pos = b.pos
                    group by 1, 2, 3""",
    "trend_book": """select as_of, symbol, direction, vol,
                       direction / (count(*) over (partition by as_of) * vol) as prelim
                     from trend_vol where direction <> 0""",
}


def sql_query(name, columns, sql=None):
    return query(name, columns, sql, SHARED)


def month_decisions(t):
    return cal.month_ends(t.sessions).select(F.col("session").alias("as_of"))


def week_decisions(t):
    return cal.iso_week_last(t.sessions, 4).select(F.col("session").alias("as_of"))


def pair_list(t):
    """Adjacent symbols of the instrument dimension, two by two."""
    numbered = t.instruments.selectExpr("symbol", "cast(substr(symbol, 2) as int) as k")
    left = numbered.filter("k % 2 = 0")
    right = numbered.selectExpr("symbol as right_symbol", "k - 1 as k")
    return left.join(right, "k").selectExpr(
        "concat('PAIR', cast(cast(k / 2 as int) as string)) as pair",
        "symbol as left_symbol",
        "right_symbol",
    )


def pair_eligibility(t):
    return pairs.eligibility(pairs.pair_signals(pairs.pair_panel(t.bars, pair_list(t))))


@sql_query("E01_simple_returns", "symbol:s session:d ret:f", "select * from sret")
def _(t):
    return signals.simple_returns(t.bars)


@sql_query("E02_log_returns", "symbol:s session:d ret:f", "select * from lret")
def _(t):
    return signals.log_returns(t.bars)


@sql_query("E03_momentum", "symbol:s session:d months:l mom:f", "select * from mom")
def _(t):
    return signals.momentum(t.bars)


@sql_query(
    "E04_average_rank",
    "symbol:s session:d months:l rank:f",
    "select symbol, session, months, rnk as rank from ranked",
)
def _(t):
    return signals.average_rank(signals.momentum(t.bars), ["session", "months"], "mom")


@sql_query("E05_blended_score", "session:d symbol:s score:f", "select * from scored")
def _(t):
    ranked = signals.average_rank(signals.momentum(t.bars), ["session", "months"], "mom")
    return signals.blended_score(ranked)


@sql_query(
    "E06_top_n",
    "session:d symbol:s place:l",
    """select session, symbol, place from (select session, symbol, row_number() over
         (partition by session order by floor(score * 1e6 + 0.5) desc, symbol) as place
         from scored) t where place <= 5""",
)
def _(t):
    ranked = signals.average_rank(signals.momentum(t.bars), ["session", "months"], "mom")
    score = signals.blended_score(ranked).withColumn("score", F.floor(F.col("score") * 1e6 + 0.5))
    return signals.top_n(score, 5, ["session"])


@sql_query(
    "E07_trend_filter",
    "symbol:s session:d sma:f uptrend:b",
    """select symbol, session, sma, close > sma as uptrend from (
         select symbol, session, close, case when count(close) over w = 200
                then avg(close) over w end as sma
         from bars window w as (partition by symbol order by session
                                rows between 199 preceding and current row)) t""",
)
def _(t):
    return signals.trend_filter(t.bars)


@sql_query(
    "E08_warmup_gate",
    "symbol:s session:d n:l ready:b",
    f"""select symbol, session, n, n >= greatest((12 + 1) * 21 + 1, 200, 60 + 1) as ready
        from (select symbol, session, row_number() {W} as n from bars) t""",
)
def _(t):
    return signals.warmup_gate(t.bars, signals.required_sessions())


@sql_query("E09_rolling_beta", "symbol:s session:d beta:f", "select * from betas")
def _(t):
    return signals.rolling_beta(signals.with_market(signals.log_returns(t.bars)))


@sql_query("E10_sector_score", "symbol:s session:d score:f", "select * from sector")
def _(t):
    return signals.sector_score(t.bars)


BETA_NEUTRAL = """
select {key}, symbol, floor(case when side = 1 then lw else -sw end
         * least(1e0, {cap} / greatest(lw, sw)) * 1e6 + 0.5e0) / 1e6 as weight
from (select *, {gross} * sb / (lb + sb) / {k} as lw, {gross} * lb / (lb + sb) / {k} as sw
      from (select *, avg(case when side = 1 then beta end) over (partition by {key}) as lb,
                   avg(case when side = -1 then beta end) over (partition by {key}) as sb
            from (select *, case when dn <= {k} then {hi} when up <= {k} then -({hi}) end as side
                  from (select *, row_number() over (partition by {key} order by score, symbol) as up,
                               row_number() over (partition by {key}
                                                  order by score desc, symbol desc) as dn,
                               count(*) over (partition by {key}) as cnt,
                               max(case when beta > 0 and score is not null then 0 else 1 end)
                                 over (partition by {key}) as bad
                        from ({source}) src) a
                  where bad = 0 and cnt >= 2 * {k}) b
            where side is not null) c) d"""


@sql_query(
    "E11_beta_neutral_weights",
    "as_of:d symbol:s weight:f",
    BETA_NEUTRAL.format(
        key="as_of", k=2, gross="1e0", cap="0.35e0", hi=1,
        source="""select g.as_of, g.symbol, b.beta, s.score from grid g
                  asof join (select x.symbol, x.session, x.score, y.beta from sector x
                             left join betas y using (symbol, session)) s
                    on g.symbol = s.symbol and g.as_of >= s.session
                  left join betas b on b.symbol = s.symbol and b.session = s.session""",
    ),
)
def _(t):
    from quantframe.operators.decisions import at_decisions

    beta = signals.rolling_beta(signals.with_market(signals.log_returns(t.daily)))
    both = signals.sector_score(t.daily).join(beta, ["symbol", "session"], "left")
    seen = at_decisions(both, month_decisions(t)).drop("session")
    return signals.beta_neutral_weights(seen, key="as_of")


RESIDUAL = """
select symbol, session, beta, (sr - beta * sm)
         / nullif(sqrt(greatest(vr - 2 * beta * c + beta * beta * vm, 0)), 0) as score
from (select symbol, session, count(ret) over f as n,
             covar_samp(ret, mkt) over f / nullif(var_samp(mkt) over f, 0) as beta,
             var_samp(ret) over r as vr, var_samp(mkt) over r as vm,
             covar_samp(ret, mkt) over r as c, sum(ret) over s as sr, sum(mkt) over s as sm
      from mret
      window f as (partition by symbol order by session rows between 251 preceding and current row),
             r as (partition by symbol order by session rows between 19 preceding and current row),
             s as (partition by symbol order by session rows between 4 preceding and current row)) t
where n = 252"""


@sql_query("E12_residual_reversal", "symbol:s session:d beta:f score:f", RESIDUAL)
def _(t):
    return signals.residual_reversal(signals.with_market(signals.log_returns(t.bars)))


@sql_query(
    "E13_reversal_weights",
    "session:d symbol:s weight:f",
    BETA_NEUTRAL.format(
        key="session", k=2, gross="1e0", cap="0.35e0", hi=-1,
        source=f"""select * from (select z.*, count(*) over (partition by session) as m
            from ({RESIDUAL}) z join (
              select session, stddev_samp(mkt) over v * sqrt(252e0) * 100 as level,
                     count(mkt) over v as k
              from (select session, avg(ret) as mkt from lret group by session) q
              window v as (order by session rows between 19 preceding and current row)) g
              using (session) where g.k = 20 and g.level >= 9e0) y where m = 12""",
    ),
)
def _(t):
    returns = signals.log_returns(t.daily)
    score = signals.residual_reversal(signals.with_market(returns))
    return signals.reversal_weights(score, signals.regime(returns), symbols=12, threshold=9.0)


@sql_query(
    "E14_rolling_ols_pair",
    "pair:s session:d beta:f intercept:f first_beta:f second_beta:f",
    "select * from pair_sig where n = 252",
)
def _(t):
    return pairs.pair_signals(pairs.pair_panel(t.bars, pair_list(t))).filter("n = 252")


@sql_query(
    "E15_spread_zscore", "pair:s session:d zscore:f", "select * from pair_sig where n = 252"
)
def _(t):
    return pairs.pair_signals(pairs.pair_panel(t.bars, pair_list(t))).filter("n = 252")


@sql_query(
    "E16_adf0_tstat", "pair:s session:d adf_t:f", "select * from pair_sig where n = 252"
)
def _(t):
    return pairs.pair_signals(pairs.pair_panel(t.bars, pair_list(t))).filter("n = 252")


@sql_query(
    "E17_pair_eligibility", "pair:s session:d reason:s eligible:b", "select * from pair_ok"
)
def _(t):
    return pair_eligibility(t)


@sql_query(
    "E18_pair_entry_weights",
    "pair:s session:d left_weight:f right_weight:f",
    """select pair, session, floor(-sign(zscore) * 0.2e0 / (1 + beta) * 1e6 + 0.5e0) / 1e6
              as left_weight,
              floor(sign(zscore) * (0.2e0 - 0.2e0 / (1 + beta)) * 1e6 + 0.5e0) / 1e6
              as right_weight
       from pair_ok where eligible and abs(zscore) >= 1.0""",
)
def _(t):
    return pairs.entry_weights(pair_eligibility(t), entry_z=1.0)


@sql_query(
    "E19_exit_reason",
    "pair:s session:d held:l exit_reason:s",
    """select pair, session, held, case when not eligible then 'invalidated'
              when abs(zscore) <= 0.5 then 'converged' when abs(zscore) >= 4 then 'stop'
              when held >= 42 then 'timeout' end as exit_reason
       from (select *, n - last_value(e ignore nulls) over (partition by pair order by session
                rows between unbounded preceding and 1 preceding) as held
             from (select *, case when eligible and abs(zscore) >= 1.0 then n end as e
                   from (select * exclude (n), row_number() over (partition by pair order by session)
                           as n from pair_ok) a) b) c
       where held is not null""",
)
def _(t):
    return pairs.exit_signals(pair_eligibility(t), entry_z=1.0)


@sql_query(
    "E20_horizon_return",
    "symbol:s session:d h63:f h126:f h252:f",
    "select symbol, session, h63, h126, h252 from trend_rows",
)
def _(t):
    return trend.trend_features(signals.simple_returns(t.bars))


@sql_query(
    "E21_trend_vote",
    "symbol:s session:d direction:l",
    """select symbol, session, sign(sign(h63) + sign(h126) + sign(h252)) as direction
       from trend_rows""",
)
def _(t):
    return trend.trend_features(signals.simple_returns(t.bars))


def _lines(t):
    from quantframe.operators.decisions import at_decisions

    returns = signals.simple_returns(t.daily)
    seen = at_decisions(trend.trend_features(returns), week_decisions(t)).filter("n >= 257")
    return trend.ewma_lines(seen.select("as_of", "symbol", "n", "direction"), returns)


@sql_query("E22_ewma_vol", "as_of:d symbol:s vol:f", "select as_of, symbol, vol from trend_vol")
def _(t):
    return trend.ewma_vol(_lines(t))


@sql_query(
    "E23_ewma_cov",
    "as_of:d sym_a:s sym_b:s cov1e4:f",
    "select as_of, sym_a, sym_b, cov * 1e4 as cov1e4 from trend_cov where sym_a <= sym_b",
)
def _(t):
    return trend.ewma_cov(_lines(t)).withColumn("cov1e4", F.col("cov") * 1e4)


@sql_query(
    "E24_trend_targets",
    "as_of:d symbol:s direction:l weight:f scale:f capped:b forecast_vol:f",
    """select b.as_of, b.symbol, b.direction,
              floor(b.prelim * s.scale * 1e6 + 0.5e0) / 1e6 as weight, s.scale, s.capped,
              s.vol * s.scale as forecast_vol
       from trend_book b join (
         select as_of, vol, least(0.1e0 / nullif(vol, 0), 2e0 / gross) as scale,
                coalesce(2e0 / gross < 0.1e0 / nullif(vol, 0), true) as capped
         from (select x.as_of, sqrt(greatest(sum(x.prelim * y.prelim * c.cov), 0) * 252) as vol,
                      (select sum(abs(prelim)) from trend_book q where q.as_of = x.as_of) as gross
               from trend_book x join trend_book y using (as_of)
               join trend_cov c on c.as_of = x.as_of and c.sym_a = x.symbol and c.sym_b = y.symbol
               group by x.as_of) v) s using (as_of)""",
)
def _(t):
    return trend.trend_targets(signals.simple_returns(t.daily), week_decisions(t))


@sql_query(
    "E24_trend_unavailable",
    "as_of:d symbol:s n:l",
    "select as_of, symbol, n from trend_at where n < 257",
)
def _(t):
    return trend.unavailable(signals.simple_returns(t.daily), week_decisions(t))


@sql_query(
    "E25_unit_risk",
    "symbol:s session:d dollar_vol:m nav_fraction:f",
    f"""select symbol, session, dollar_vol, dollar_vol / 100000e0 as nav_fraction from (
          select symbol, session, case when count(m) over w = 63
                 then stddev_samp(m) over w * sqrt(252e0) * close * 50 end as dollar_vol
          from (select symbol, session, close, close / lag(close) {W} - 1 as m from bars) t
          window w as (partition by symbol order by session
                       rows between 62 preceding and current row)) q
        where dollar_vol is not null""",
)
def _(t):
    return signals.annualised_unit_risk(t.bars, 50.0).withColumn(
        "nav_fraction", F.col("dollar_vol") / 100000.0
    )


@sql_query(
    "E26_cross_sleeve_correlation",
    "sleeve_a:s sleeve_b:s correlation:f sessions:l",
    """with r as (select portfolio, session, nav / lag(nav) over
                    (partition by portfolio order by session) - 1 as ret from nav),
        x as (select portfolio, session, ret - annual_rate / 252 as ex
              from r asof join rates on r.session >= rates.date where ret is not null)
       select a.portfolio as sleeve_a, b.portfolio as sleeve_b, corr(a.ex, b.ex) as correlation,
              count(*) as sessions
       from x a join x b on a.session = b.session and a.portfolio <= b.portfolio
       group by 1, 2""",
)
def _(t):
    return metrics.sleeve_correlation(metrics.excess_returns(t.nav, t.rates))
