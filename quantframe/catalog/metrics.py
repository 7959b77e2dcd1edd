"""Performance queries over equity curves and books."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.ledger import ADV
from quantframe.catalog.ledger_sql import BOOK
from quantframe.catalog.registry import query
from quantframe.catalog.signals import SHARED
from quantframe.sources.testdata import INITIAL_CASH
from quantframe.operators import calendars as cal
from quantframe.operators import metrics, signals

CURVE = {
    "curve": """select *, nav / peak - 1 as dd, nav >= peak as at_peak,
                  case when month_end then nav / coalesce(last_value(case when month_end then nav end
                    ignore nulls) over (partition by portfolio order by session
                      rows between unbounded preceding and 1 preceding), opening) - 1 end as month_ret,
                  ret - annual_rate / 252 as ex
                from (select n.*, r.annual_rate from (
                  select portfolio, session, nav, nav / lag(nav) over w - 1 as ret,
                    max(nav) over w as peak, first_value(nav) over w as opening,
                    coalesce(date_trunc('month', lead(session) over w)
                      <> date_trunc('month', session), true) as month_end
                  from nav window w as (partition by portfolio order by session)) n
                  asof join rates r on n.session >= r.date) t""",
}


def perf_sql(keys: str, source: str) -> str:
    """Statistics per key from first principles; ``source`` has the keys, session, nav, rate."""
    k = ", ".join(f"c.{x}" for x in keys.split(", "))
    return f"""
with c0 as (select {keys}, session, nav, annual_rate,
        nav / lag(nav) over w - 1 as ret, max(nav) over w as peak,
        first_value(nav) over w as opening,
        coalesce(date_trunc('month', lead(session) over w) <> date_trunc('month', session), true)
          as month_end
      from ({source}) s window w as (partition by {keys} order by session)),
 c as (select *, nav / peak - 1 as dd, ret - annual_rate / 252 as ex,
        case when month_end then nav / coalesce(last_value(case when month_end then nav end
          ignore nulls) over (partition by {keys} order by session
          rows between unbounded preceding and 1 preceding), opening) - 1 end as month_ret,
        last_value(case when nav >= peak then session end ignore nulls) over
          (partition by {keys} order by session rows between unbounded preceding and 1 preceding)
          as peak_before,
        lag(nav >= peak) over (partition by {keys} order by session) as was_at_peak
      from c0)
select *, growth - 1 as total_return, power(growth, 1 / years) - 1 as cagr,
   coalesce(mean / nullif(sd, 0) * sqrt(252e0), 0) as raw_sharpe,
   coalesce(xmean / nullif(sd, 0) * sqrt(252e0), 0) as sharpe,
   coalesce(xmean / nullif(down, 0) * sqrt(252e0), 0) as sortino, sd * sqrt(252e0) as volatility,
   coalesce((power(growth, 1 / years) - 1) / nullif(abs(max_drawdown), 0), 0) as calmar
from (select {k}, min(session) as start, max(session) as "end", count(*) as sessions,
   datediff('day', min(session), max(session)) / 365.25e0 as years,
   min_by(nav, session) as initial_nav, max_by(nav, session) as final_nav,
   max_by(nav, session) / min_by(nav, session) as growth,
   avg(ret) as mean, stddev_samp(ret) as sd, avg(ex) as xmean,
   sqrt(sum(power(least(ex, 0), 2)) / count(ex)) as down, min(dd) as max_drawdown,
   avg(case when dd < 0 then 1e0 else 0 end) as time_underwater,
   coalesce(max(case when nav < peak or not coalesce(was_at_peak, true)
       then datediff('day', peak_before, session) end), 0) as longest_drawdown_days,
   max(month_ret) as best_month, min(month_ret) as worst_month,
   avg(case when month_ret is not null then case when month_ret > 0 then 1e0 else 0 end end)
     as positive_months,
   max(ret) as best_day, min(ret) as worst_day
   from c group by {keys}) z where sessions >= 2"""


RATED = """select n.portfolio, n.session, n.nav, r.annual_rate, year(n.session) as yr
           from nav n asof join rates r on n.session >= r.date"""
PERF = perf_sql("portfolio", RATED)
PERF_COLUMNS = (
    "start:d end:d sessions:l years:f initial_nav:m final_nav:m total_return:f cagr:f"
    " volatility:f raw_sharpe:f sharpe:f sortino:f max_drawdown:f calmar:f"
    " longest_drawdown_days:l time_underwater:f best_month:f worst_month:f positive_months:f"
    " best_day:f worst_day:f"
)


def pick(name: str, columns: str):
    """Register a slice of the statistics table under its own inventory entry."""

    @query(name, f"portfolio:s {columns}", PERF)
    def _(t):
        return metrics.performance(t.nav, t.rates)


pick("H01_total_return_cagr", "total_return:f years:f cagr:f")
pick("H02_volatility_sharpe", "volatility:f raw_sharpe:f sharpe:f")
pick("H03_sortino", "sortino:f")
pick("H07_longest_drawdown_days", "longest_drawdown_days:l")
pick("H11_best_worst", "best_month:f worst_month:f positive_months:f best_day:f worst_day:f")
pick("H14_performance", PERF_COLUMNS)


@query(
    "H04_excess_returns",
    "portfolio:s session:d ret:f excess:f",
    "select portfolio, session, ret, ex as excess from curve where ret is not null",
    CURVE,
)
def _(t):
    return metrics.excess_returns(t.nav, t.rates)


@query(
    "H04_excess_returns_scalar",
    "portfolio:s session:d excess:f",
    "select portfolio, session, ret - 0.03e0 / 252 as excess from curve where ret is not null",
    CURVE,
)
def _(t):
    return metrics.excess_returns(t.nav, 0.03)


@query(
    "H05_drawdown_series",
    "portfolio:s session:d dd:f",
    "select portfolio, session, dd from curve",
    CURVE,
)
def _(t):
    return metrics.enriched(t.nav)


@query(
    "H06_drawdown_episodes",
    "portfolio:s place:l peak:d trough:d recovery:d depth:f days_to_trough:l recovery_days:l"
    " total_days:l open:b",
    """select *, row_number() over (partition by portfolio order by depth, peak) as place from (
         select portfolio, peak, trough, recovery, low / high - 1 as depth,
           datediff('day', peak, trough) as days_to_trough,
           datediff('day', trough, coalesce(recovery, last)) as recovery_days,
           datediff('day', peak, coalesce(recovery, last)) as total_days,
           recovery is null as open
         from (select portfolio, g, min(session) as peak, max(session) as last, max(nav) as high,
                 min(nav) as low, arg_min(session, nav) as trough, count(*) as n,
                 lead(min(session)) over (partition by portfolio order by g) as recovery
               from (select *, sum(case when at_peak then 1 else 0 end) over
                       (partition by portfolio order by session) as g from curve) a
               group by portfolio, g) b where n > 1) c
       qualify row_number() over (partition by portfolio order by depth, peak) <= 5""",
    CURVE,
)
def _(t):
    return metrics.drawdown_episodes(t.nav)


@query(
    "H08_monthly_returns",
    "portfolio:s month:d ret:f",
    """select portfolio, date_trunc('month', session) as month, month_ret as ret
       from curve where month_end""",
    CURVE,
)
def _(t):
    return metrics.monthly_returns(t.nav)


@query(
    "H09_strict_monthly_returns",
    "portfolio:s month:d ret:f ok:b",
    """with e as (select portfolio, cast(date_trunc('month', session) as date) as month,
                         max_by(nav, session) as nav from nav group by 1, 2),
        spine as (select p.portfolio, cast(m.month as date) as month
                  from (select distinct portfolio from nav) p
                  cross join (select unnest(generate_series(timestamp '1995-01-01',
                     timestamp '2000-12-01', interval 1 month)) as month) m)
       select s.portfolio, s.month, a.nav / b.nav - 1 as ret,
              a.nav is not null and b.nav is not null as ok
       from spine s left join e a on a.portfolio = s.portfolio and a.month = s.month
       left join e b on b.portfolio = s.portfolio and b.month = s.month - interval 1 month""",
)
def _(t):
    return metrics.strict_monthly_returns(t.nav, "1995-01-01", "2000-12-01")


@query(
    "H10_monthly_table",
    "portfolio:s year:l " + " ".join(f"m{m:02d}:f" for m in range(1, 13)),
    "select portfolio, year(session) as year, "
    + ", ".join(
        f"max(case when month(session) = {m} then month_ret end) as m{m:02d}" for m in range(1, 13)
    )
    + " from curve where month_end group by 1, 2",
    CURVE,
)
def _(t):
    return metrics.monthly_table(t.nav)


@query(
    "H12_by_calendar_year",
    "portfolio:s year:l " + PERF_COLUMNS,
    "select *, yr as year from (" + perf_sql("portfolio, yr", RATED) + ") q",
)
def _(t):
    return metrics.by_calendar_year(t.nav, t.rates)


REFUSED = "select * from fills where slippage = 0"
TRADING = {**BOOK, "advs": ADV}


@query(
    "H13_trading_stats",
    "portfolio:s fills:l rejections:l annual_turnover:f cost_drag:f financing_return:f"
    " average_exposure:f",
    """select portfolio, f.fills, coalesce(x.n, 0) as rejections,
         f.notional / m.nav / m.years as annual_turnover,
         (f.commission + f.slippage + greatest(-f.net, 0)) / m.nav / m.years as cost_drag,
         f.net / m.nav / m.years as financing_return, m.average_exposure
       from (select portfolio, avg(nav) as nav, avg(gross_exposure) as average_exposure,
               datediff('day', min(session), max(session)) / 365.25e0 as years
             from marks group by 1) m
       join (select portfolio, count(*) as fills, sum(commission) as commission,
               sum(slippage) as slippage, sum(abs(quantity) * price) as notional,
               sum(-commission * 0.5e0) as net from fills group by 1) f using (portfolio)
       left join (select portfolio, count(*) as n from fills where slippage = 0 group by 1) x
         using (portfolio)""",
    BOOK,
)
def _(t):
    marks = t.marks
    financing = t.fills.select("portfolio", (-F.col("commission") * 0.5).alias("interest"))
    return metrics.trading_stats(marks, t.fills, t.fills.filter("slippage = 0"), financing)


@query(
    "H15_rolling_sharpe",
    "portfolio:s session:d sharpe:f",
    """select * from (select portfolio, session, case when count(ret) over w = 252
           then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) * sqrt(252e0) end as sharpe
         from curve where ret is not null
         window w as (partition by portfolio order by session
                      rows between 251 preceding and current row)) t where sharpe is not null""",
    CURVE,
)
def _(t):
    return metrics.rolling_sharpe(t.nav, years=1)


@query(
    "H15_rolling_sharpe_3y",
    "portfolio:s session:d sharpe:f",
    """select * from (select portfolio, session, case when count(ret) over w = 756
           then avg(ret) over w / nullif(stddev_samp(ret) over w, 0) * sqrt(252e0) end as sharpe
         from curve where ret is not null
         window w as (partition by portfolio order by session
                      rows between 755 preceding and current row)) t where sharpe is not null""",
    CURVE,
)
def _(t):
    return metrics.rolling_sharpe(t.nav)


@query(
    "H16_rolling_return_growth",
    "portfolio:s session:d growth:f rolling_return:f",
    """select portfolio, session, 100 * nav / first_value(nav) over w as growth,
              nav / lag(nav, 252) over w - 1 as rolling_return
       from nav window w as (partition by portfolio order by session)""",
)
def _(t):
    return metrics.growth_and_rolling(t.nav)


@query(
    "H16_exposure_series",
    "portfolio:s session:d gross_exposure:f",
    "select portfolio, session, gross_exposure from marks",
    BOOK,
)
def _(t):
    return t.marks


@query(
    "H17_allocation_topk",
    "portfolio:s session:d line:s weight:f",
    """with w as (select l.portfolio, l.session, l.symbol, l.value / m.nav as weight
                  from mlines l join marks m using (portfolio, session)
                  where m.nav > 0 and l.value <> 0),
        k as (select portfolio, symbol, case when row_number() over (partition by portfolio
                order by sum(weight) desc, symbol) <= 7 then symbol else 'other' end as line
              from w group by 1, 2)
       select w.portfolio, w.session, k.line, sum(w.weight) as weight
       from w join k on k.portfolio = w.portfolio and k.symbol = w.symbol group by 1, 2, 3""",
    BOOK,
)
def _(t):
    from quantframe.operators.ledger import weight_lines

    return metrics.allocation_topk(weight_lines(t.lines, t.marks), t.marks)


@query(
    "H18_factor_regression",
    "portfolio:s n:l beta1:f beta2:f r_squared:f intercept:f",
    """with p as (select session, max(case when symbol = 'S01' then ret end) as a,
                         max(case when symbol = 'S02' then ret end) as b
                  from sret group by 1),
        j as (select c.portfolio, c.ex as y, p.a - c.annual_rate / 252 as x1,
                     p.b - c.annual_rate / 252 as x2
              from curve c join p on p.session = c.session
              where c.ret is not null and p.a is not null and p.b is not null)
       select portfolio, count(*) as n,
         (var_samp(x2) * covar_samp(x1, y) - covar_samp(x1, x2) * covar_samp(x2, y))
           / (var_samp(x1) * var_samp(x2) - power(covar_samp(x1, x2), 2)) as beta1,
         (var_samp(x1) * covar_samp(x2, y) - covar_samp(x1, x2) * covar_samp(x1, y))
           / (var_samp(x1) * var_samp(x2) - power(covar_samp(x1, x2), 2)) as beta2,
         ((var_samp(x2) * covar_samp(x1, y) - covar_samp(x1, x2) * covar_samp(x2, y))
             * covar_samp(x1, y)
           + (var_samp(x1) * covar_samp(x2, y) - covar_samp(x1, x2) * covar_samp(x1, y))
             * covar_samp(x2, y))
           / (var_samp(x1) * var_samp(x2) - power(covar_samp(x1, x2), 2)) / var_samp(y) as r_squared,
         (avg(y) - avg(x1) * (var_samp(x2) * covar_samp(x1, y) - covar_samp(x1, x2)
              * covar_samp(x2, y)) / (var_samp(x1) * var_samp(x2) - power(covar_samp(x1, x2), 2))
           - avg(x2) * (var_samp(x1) * covar_samp(x2, y) - covar_samp(x1, x2) * covar_samp(x1, y))
             / (var_samp(x1) * var_samp(x2) - power(covar_samp(x1, x2), 2))) * 252 as intercept
       from j group by 1""",
    {**SHARED, **CURVE},
)
def _(t):
    legs = signals.simple_returns(t.bars.filter("symbol in ('S01', 'S02')"))
    pair = legs.groupBy("session").agg(
        F.max(F.when(F.col("symbol") == "S01", F.col("ret"))).alias("a"),
        F.max(F.when(F.col("symbol") == "S02", F.col("ret"))).alias("b"),
    ).filter("a is not null and b is not null")
    rows = (
        metrics.excess_returns(t.nav, t.rates)
        .join(pair, "session")
        .withColumn("x1", F.col("a") - F.col("rate") / 252)
        .withColumn("x2", F.col("b") - F.col("rate") / 252)
    )
    return metrics.two_factor_regression(rows, "excess", "x1", "x2")


@query(
    "H19_half_period_pnl",
    "portfolio:s first_half:m second_half:m",
    """select portfolio,
         max(case when i = n // 2 then nav end) - max(case when i = 0 then nav end) as first_half,
         max(case when i = n - 1 then nav end) - max(case when i = n // 2 then nav end)
           as second_half
       from (select portfolio, nav, row_number() over (partition by portfolio order by session) - 1
               as i, count(*) over (partition by portfolio) as n from nav) t group by 1""",
)
def _(t):
    return metrics.half_period_pnl(t.nav)


@query(
    "H20_weekly_summary",
    "portfolio:s session:d nav:m week:f since_launch:f cash:m gross_exposure:f holdings:l"
    " orders:l fills:l rejections:l",
    """select portfolio, m.session, m.nav, m.nav / m.prior - 1 as week,
              m.nav / 100000000e0 - 1 as since_launch, m.cash, m.gross_exposure, m.holdings,
              o.n as orders, o.n as fills, coalesce(x.n, 0) as rejections
       from (select portfolio, max(session) as session, max_by(nav, session) as nav,
               min_by(nav, session) as prior, max_by(cash, session) as cash,
               max_by(gross_exposure, session) as gross_exposure,
               max_by(holdings, session) as holdings
             from (select *, row_number() over (partition by portfolio order by session desc) as r
                   from marks) q where r <= 6 group by 1) m
       left join (select portfolio, count(*) as n from fills group by 1) o using (portfolio)
       left join (select portfolio, count(*) as n from fills where slippage = 0 group by 1) x
         using (portfolio)""",
    BOOK,
)
def _(t):
    marks = t.marks
    return metrics.weekly_summary(
        marks, t.order_book, t.fills, t.fills.filter("slippage = 0"), INITIAL_CASH
    )


@query(
    "H21_status_rollup",
    "portfolio:s last_session:d sessions_recorded:l nav:m cash:m high_water_mark:m drawdown:f"
    " positions:l pending:l fills:l behind:l",
    """select m.*, greatest((m.high_water_mark - m.nav) / m.high_water_mark, 0) as drawdown,
              coalesce(p.n, 0) as pending, f.n as fills,
              greatest((select count(*) from sessions where session >=
                (select max(cast(o_orderdate as date)) from orders)) - 1, 0) as behind
       from (select portfolio, max(session) as last_session, count(*) as sessions_recorded,
               max_by(nav, session) as nav, max_by(cash, session) as cash,
               max(nav) as high_water_mark, max_by(holdings, session) as positions
             from marks group by 1) m
       left join (select portfolio, count(*) as n from fills where venue <> 'F' group by 1) p
         on p.portfolio = m.portfolio
       left join (select portfolio, count(*) as n from fills group by 1) f
         on f.portfolio = m.portfolio""",
    BOOK,
)
def _(t):
    marks = t.marks
    pending = t.fills.filter("venue <> 'F'")  # not yet on a statement
    counts = t.fills.groupBy("portfolio").agg(F.count(F.lit(1)).alias("fills"))
    ordered = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("session"))
    late = cal.staleness(ordered, t.sessions)
    return metrics.status_rollup(marks, pending, counts, late)
