"""Sweep, bootstrap, significance and screen queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.ledger_sql import segment_ctes
from quantframe.catalog.metrics import CURVE, PERF, perf_sql
from quantframe.catalog.momentum_sql import momentum_ctes
from quantframe.catalog.calendars import START_GRID, start_grid
from quantframe.catalog.registry import query
from quantframe.catalog.signals import SHARED
from quantframe.catalog.sizing import OFFSETS
from quantframe.functions.normal import normal_cdf_sql, normal_ppf_sql
from quantframe.operators import bootstrap, metrics, screens
from quantframe.operators import calendars as cal
from quantframe.plans import sweep
from quantframe.plans.momentum import complete, dual_momentum
from quantframe.plans.nav import segment_nav
from quantframe.sources.gates import factor_panel

VARIANTS = sweep.battery()
AXES = {
    v["variant"]: v
    for v in [
        sweep.with_knobs({}),
        *sweep.one_at_a_time(sweep.SENSITIVITY_AXES),
        *sweep.one_at_a_time({"cost_scale": sweep.COST_SCALES}),
    ]
}
AXES = list(AXES.values())
GRID_X, GRID_Y = sweep.GRID_AXES
GRID = sweep.two_way(GRID_X, GRID_Y)
TOP_NS = GRID_X[1]


def sweep_sql_ctes(p: str, variants, dates="select as_of from ends") -> dict[str, str]:
    rates = " ".join(
        f"when '{v['variant']}' then {sweep.BASE_COST_RATE * float(v['cost_scale'])}e0"
        for v in variants
        if "cost_scale" in v
    )
    cost = f"case variant {rates} else {sweep.BASE_COST_RATE} end" if rates else str(sweep.BASE_COST_RATE)
    return {
        **SHARED,
        **momentum_ctes(f"{p}m_", dates, variants),
        **segment_ctes(f"{p}s_", f"select * from {p}m_targets", cost=f"({cost})"),
    }


def sweep_perf(p: str) -> str:
    return perf_sql("variant", f"select variant, session, nav, 0e0 as annual_rate from {p}s_nav")


def trial_sql(p: str) -> str:
    return f"""select z.*, t.annual_turnover from ({sweep_perf(p)}) z join (
        select variant, sum(turnover) / (datediff('day', min(session), max(session)) / 365.25e0)
          as annual_turnover from {p}s_nav group by 1) t using (variant)"""


@query(
    "I01_variant_grid",
    "variant:s need:l symbols:l first_ready:d",
    "select v.variant, v.need, count(*) as symbols, min(b.session) as first_ready from (values "
    + ", ".join(f"('{v['variant']}', {complete(v)['need']})" for v in sweep.battery())
    + """) v(variant, need) join (select symbol, session, row_number() over
           (partition by symbol order by session) as n from bars) b on b.n = v.need
       group by 1, 2""",
)
def _(t):
    return sweep.readiness(t.daily, sweep.battery())


@query(
    "I02_run_sweep",
    "variant:s sessions:l cagr:f volatility:f sharpe:f max_drawdown:f annual_turnover:f",
    trial_sql("w"),
    sweep_sql_ctes("w", VARIANTS),
)
def _(t):
    return sweep.run_sweep(t.daily, t.sessions, t.instruments, VARIANTS)


STARTS = {
    **SHARED,
    **momentum_ctes("d_", "select as_of from ends", [{}]),
    "starts": START_GRID,
    "begun": """select concat('start=', cast(g.session as varchar)) as variant, t.as_of, t.symbol,
                  t.weight from d_targets t join starts g on t.as_of >= g.session""",
    **segment_ctes("ds_", "select * from begun", cost=f"({sweep.BASE_COST_RATE})"),
}


@query(
    "I02_start_dates",
    "variant:s sessions:l cagr:f volatility:f sharpe:f max_drawdown:f",
    perf_sql("variant", "select variant, session, nav, 0e0 as annual_rate from ds_nav"),
    STARTS,
)
def _(t):
    return sweep.start_date_sweep(t.daily, t.sessions, t.instruments, start_grid(t))


HELD = perf_sql(
    "portfolio, win",
    """select n.portfolio, n.session, n.nav, 0e0 as annual_rate, w.win from nav n
       join (values ('train'), ('test')) w(win)
         on (w.win = 'train' and n.session <= date '1998-06-30')
         or (w.win = 'test' and n.session >= date '1998-06-30')""",
)


@query(
    "I03_held_out_split",
    "portfolio:s train:f test:f gap:f",
    f"""select portfolio, max(case when win = 'train' then sharpe end) as train,
          max(case when win = 'test' then sharpe end) as test,
          max(case when win = 'test' then sharpe end) - max(case when win = 'train' then sharpe end)
            as gap from ({HELD}) h group by 1""",
)
def _(t):
    split = screens.held_out(t.nav, "1998-06-30")
    return screens.held_out_gap(metrics.performance(split, 0.0, ["portfolio", "window"]))


def draw_sql(seed: int, draw: str, block: str, choices: str) -> str:
    return (
        f"cast('0x' || substr(md5(concat_ws('-', '{seed}', cast({draw} as varchar),"
        f" cast({block} as varchar))), 1, 8) as bigint) % ({choices})"
    )


BOOT = {
    **CURVE,
    "bret": """select portfolio, ret, row_number() over (partition by portfolio order by session) - 1
                 as i, count(*) over (partition by portfolio) as n from curve where ret is not null""",
    "bdraw": f"""select s.portfolio, d.draw, b.blk * 21 + k.k as pos,
          {draw_sql(0, 'd.draw', 'b.blk', 's.n - 20')} + k.k as i, s.n
        from (select distinct portfolio, n from bret) s cross join range(0, 2000) d(draw)
        join range(0, 200) b(blk) on b.blk < ceil(s.n / 21e0)
        cross join range(0, 21) k(k) where b.blk * 21 + k.k < s.n""",
    "bsharpe": """select d.portfolio, d.draw, coalesce(avg(r.ret) / nullif(stddev_samp(r.ret), 0)
          * sqrt(252e0), 0) as sharpe
        from bdraw d join bret r on r.portfolio = d.portfolio and r.i = d.i group by 1, 2""",
}


@query(
    "I04_block_bootstrap",
    "portfolio:s point:f low:f high:f draws:l",
    """select b.portfolio, any_value(p.point) as point, quantile_cont(b.sharpe, 0.025) as low,
              quantile_cont(b.sharpe, 0.975) as high, count(*) as draws
       from bsharpe b join (select portfolio, avg(ret) / stddev_samp(ret) * sqrt(252e0) as point
                            from bret group by 1) p using (portfolio) group by 1""",
    BOOT,
)
def _(t):
    return bootstrap.sharpe_interval(metrics.returns(t.nav))


PAIRED = {
    **CURVE,
    "pairs_": """select b.portfolio, b.session, a.nav as nav_a, b.nav as nav_b
        from (select session, nav from nav where portfolio = 'P0') a
        join (select * from nav where portfolio <> 'P0') b using (session)""",
    "prets": """select *, row_number() over (partition by portfolio order by session) - 1 as i,
          count(*) over (partition by portfolio) as n,
          quantile_cont(ex_a, 0.1) over (partition by portfolio) as q
        from (select p.portfolio, p.session, ra as ret_a, rb as ret_b,
                ra - r.annual_rate / 252 as ex_a, rb - r.annual_rate / 252 as ex_b
              from (select portfolio, session,
                      nav_a / lag(nav_a) over (partition by portfolio order by session) - 1 as ra,
                      nav_b / lag(nav_b) over (partition by portfolio order by session) - 1 as rb
                    from pairs_) p asof join rates r on p.session >= r.date
              where ra is not null) z""",
}


def paired_of(t):
    """Curves cut to the sessions they share with P0, then turned into returns."""
    from pyspark.sql import Window

    from quantframe.operators.asof import rate_on

    a = t.nav.filter("portfolio = 'P0'").select("session", F.col("nav").alias("nav_a"))
    both = t.nav.filter("portfolio <> 'P0'").join(a, "session")
    w = Window.partitionBy("portfolio").orderBy("session")
    moves = both.select(
        "portfolio",
        "session",
        (F.col("nav_a") / F.lag("nav_a").over(w) - 1).alias("ret_a"),
        (F.col("nav") / F.lag("nav").over(w) - 1).alias("ret_b"),
    ).filter("ret_a is not null")
    rated = rate_on(moves, t.rates, "session")
    return rated.select(
        "portfolio",
        "session",
        "ret_a",
        "ret_b",
        (F.col("ret_a") - F.col("rate") / 252).alias("ex_a"),
        (F.col("ret_b") - F.col("rate") / 252).alias("ex_b"),
    )


@query(
    "I05_paired_bootstrap",
    "portfolio:s low:f high:f",
    f"""with d as (select s.portfolio, d.draw,
            ({draw_sql(1102026, 'd.draw', 'b.blk', 's.n')} + k.k) % s.n as i
          from (select distinct portfolio, n from prets) s cross join range(0, 2000) d(draw)
          join range(0, 40) b(blk) on b.blk < ceil(s.n / 252e0)
          cross join range(0, 252) k(k) where b.blk * 252 + k.k < s.n),
        s as (select d.portfolio, d.draw, avg(r.ex_b) / stddev_samp(r.ret_b) * sqrt(252e0)
                - avg(r.ex_a) / stddev_samp(r.ret_a) * sqrt(252e0) as diff
              from d join prets r on r.portfolio = d.portfolio and r.i = d.i group by 1, 2)
        select portfolio, quantile_cont(diff, 0.025) as low, quantile_cont(diff, 0.975) as high
        from s group by 1""",
    PAIRED,
)
def _(t):
    return bootstrap.paired_sharpe_interval(paired_of(t), ["portfolio"], block=252, draws=2000)


@query(
    "I05_paired_diagnostics",
    "portfolio:s sessions:l improvement:f first_half:f second_half:f correlation:f"
    " tail_sessions:l core_tail_mean:f candidate_tail_mean:f",
    """select portfolio, count(*) as sessions,
         (avg(ex_b) / stddev_samp(ret_b) - avg(ex_a) / stddev_samp(ret_a)) * sqrt(252e0)
           as improvement,
         (avg(ex_b) filter (where i < n // 2) / stddev_samp(ret_b) filter (where i < n // 2)
          - avg(ex_a) filter (where i < n // 2) / stddev_samp(ret_a) filter (where i < n // 2))
           * sqrt(252e0) as first_half,
         (avg(ex_b) filter (where i >= n // 2) / stddev_samp(ret_b) filter (where i >= n // 2)
          - avg(ex_a) filter (where i >= n // 2) / stddev_samp(ret_a) filter (where i >= n // 2))
           * sqrt(252e0) as second_half,
         corr(ex_a, ex_b) as correlation, count(*) filter (where ex_a <= q) as tail_sessions,
         avg(ex_a) filter (where ex_a <= q) as core_tail_mean,
         avg(ex_b) filter (where ex_a <= q) as candidate_tail_mean
       from prets group by 1""",
    PAIRED,
)
def _(t):
    return screens.paired_diagnostics(paired_of(t))


NAMES = ("value", "quality", "composite")
FACTOR = {
    "wide": "select month, "
    + ", ".join(
        f"max(case when factor = '{f}' then ret end) as {f}"
        for f in ("core_excess", "market", *NAMES)
    )
    + " from factors group by 1 having count(*) = 5",
    "frows": """select *, ntile(2) over (partition by factor order by month) as h,
          quantile_cont(core_excess, 0.1) over (partition by factor) as q,
          row_number() over (partition by factor order by month) - 1 as i,
          count(*) over (partition by factor) as n
        from ("""
    + " union all ".join(
        f"select month, core_excess, market, '{f}' as factor, {f} as ret from wide" for f in NAMES
    )
    + ") z",
}


def factor_rows_of(t):
    wide = factor_panel(t.factors, ["core_excess", "market", *NAMES])
    return screens.factor_rows(wide, NAMES)


@query(
    "I06_factor_diagnostics",
    "factor:s months:l market_beta:f mean_monthly:f mean_over_vol:f annual_vol:f"
    " core_correlation:f monthly_covariance:f first_half_correlation:f second_half_correlation:f"
    " first_half_mean:f second_half_mean:f residual_correlation:f tail_months:l tail_mean:f"
    " tail_negative_share:f",
    """select factor, count(*) as months, covar_samp(ret, market) / var_samp(market) as market_beta,
         avg(ret) as mean_monthly, avg(ret) / stddev_samp(ret) * sqrt(12e0) as mean_over_vol,
         stddev_samp(ret) * sqrt(12e0) as annual_vol, corr(core_excess, ret) as core_correlation,
         covar_samp(core_excess, ret) as monthly_covariance,
         corr(core_excess, ret) filter (where h = 1) as first_half_correlation,
         corr(core_excess, ret) filter (where h = 2) as second_half_correlation,
         avg(ret) filter (where h = 1) as first_half_mean,
         avg(ret) filter (where h = 2) as second_half_mean,
         (corr(core_excess, ret) - corr(core_excess, market) * corr(ret, market))
           / sqrt((1 - power(corr(core_excess, market), 2)) * (1 - power(corr(ret, market), 2)))
           as residual_correlation,
         count(*) filter (where core_excess <= q) as tail_months,
         avg(ret) filter (where core_excess <= q) as tail_mean,
         avg(case when ret < 0 then 1e0 else 0 end) filter (where core_excess <= q)
           as tail_negative_share
       from frows group by 1""",
    FACTOR,
)
def _(t):
    return screens.factor_diagnostics(factor_rows_of(t))


@query(
    "I06_factor_correlation_interval",
    "factor:s low:f high:f",
    f"""with d as (select s.factor, d.draw,
            ({draw_sql(7, 'd.draw', 'b.blk', 's.n')} + k.k) % s.n as i
          from (select distinct factor, n from frows) s cross join range(0, 2000) d(draw)
          join range(0, 40) b(blk) on b.blk < ceil(s.n / 12e0)
          cross join range(0, 12) k(k) where b.blk * 12 + k.k < s.n),
        c as (select d.factor, d.draw, corr(r.core_excess, r.ret) as x
              from d join frows r on r.factor = d.factor and r.i = d.i group by 1, 2)
        select factor, quantile_cont(x, 0.025) as low, quantile_cont(x, 0.975) as high
        from c group by 1""",
    FACTOR,
)
def _(t):
    return bootstrap.correlation_interval(
        factor_rows_of(t), ["factor"], "core_excess", "ret", draws=2000, seed=7
    )


WINDOWS = (("early", "1996-01-01", "1997-12-31"), ("late", "2000-01-01", "2000-12-31"))


@query(
    "I06_crisis_windows",
    "factor:s window:s months:l factor_mean:f both_negative:l",
    """select f.factor, w.name as window, count(*) as months, avg(f.ret) as factor_mean,
         sum(case when f.core_excess < 0 and f.ret < 0 then 1 else 0 end) as both_negative
       from frows f join (values """
    + ", ".join(f"('{n}', date '{a}', date '{z}')" for n, a, z in WINDOWS)
    + ") w(name, a, z) on f.month between w.a and w.z group by 1, 2",
    FACTOR,
)
def _(t):
    return screens.crisis_windows(factor_rows_of(t), WINDOWS)


TRIALS = (1 + len(VARIANTS), 100, 1000)
MOMENTS = """select portfolio, count(*) as observations, any_value(mu) / any_value(sd) as per_session,
         avg(power((ret - mu) / sd, 3)) as skew, avg(power((ret - mu) / sd, 4)) as kurtosis
       from (select portfolio, ret, avg(ret) over (partition by portfolio) as mu,
               stddev_samp(ret) over (partition by portfolio) as sd
             from curve where ret is not null) t group by 1"""


@query(
    "I07_deflated_sharpe",
    "portfolio:s trials:l observed:f expected_maximum:f probability:f",
    f"""with m as ({MOMENTS}),
       t as (select *, 1e0 - 1e0 / trials as p, 1e0 - 1e0 / (trials * exp(1e0)) as q
             from m cross join (values {", ".join(f"({n})" for n in TRIALS)}) v(trials)
             where observations >= 3),
       e as (select *, 0.02e0 * ((1 - {screens.EULER_GAMMA}e0) * {normal_ppf_sql("p")}
               + {screens.EULER_GAMMA}e0 * {normal_ppf_sql("q")}) as best,
               1 - skew * per_session + (kurtosis - 1) / 4 * per_session * per_session as var from t),
       z as (select *, case when var > 0 then (per_session - best) * sqrt(observations - 1)
               / sqrt(var) end as z from e)
       select portfolio, trials, per_session * sqrt(252e0) as observed,
         best * sqrt(252e0) as expected_maximum, {normal_cdf_sql("z")} as probability from z""",
    CURVE,
)
def _(t):
    shape = screens.moments(metrics.returns(t.nav), ["portfolio"])
    return screens.deflated_sharpe(shape, TRIALS, F.lit(0.02))


@query(
    "I07_return_moments",
    "portfolio:s observations:l per_session:f skew:f kurtosis:f",
    MOMENTS,
    CURVE,
)
def _(t):
    return screens.moments(metrics.returns(t.nav), ["portfolio"])


@query(
    "I08_sharpe_spread",
    "trials:l spread:f",
    f"""select count(*) as trials, coalesce(stddev_samp(sharpe / sqrt(252e0)), 0) as spread
        from ({PERF}) p""",
)
def _(t):
    return screens.sharpe_spread(metrics.performance(t.nav, t.rates))


TIMING = {
    **SHARED,
    "offset_dates": OFFSETS,
    **momentum_ctes("o_", "select as_of, sleeve from offset_dates", [{}]),
    **segment_ctes(
        "os_",
        """select d.sleeve as variant, t.as_of, t.symbol, t.weight from o_targets t
           join offset_dates d using (as_of)""",
    ),
}


@query(
    "I09_timing_luck",
    "cagr_range:f sharpe_range:f mean_cagr:f cagr_stdev:f luckiest:s unluckiest:s",
    "select max(cagr) - min(cagr) as cagr_range, max(sharpe) - min(sharpe) as sharpe_range,"
    " avg(cagr) as mean_cagr, stddev_pop(cagr) as cagr_stdev, arg_max(variant, cagr) as luckiest,"
    " arg_min(variant, cagr) as unluckiest from ("
    + perf_sql("variant", "select variant, session, nav, 0e0 as annual_rate from os_nav")
    + ") p",
    TIMING,
)
def _(t):
    tagged = cal.monthly_offsets(t.sessions, (0, 5, 10, 15)).select(
        F.col("offset").cast("string").alias("offset"), F.col("session").alias("as_of")
    )
    targets = dual_momentum(t.daily, tagged, t.instruments).drop("variant").join(tagged, "as_of")
    curves = segment_nav(targets, t.daily, t.sessions, keys=["offset"])
    return screens.timing_luck(metrics.performance(curves, 0.0, ["offset"]), "offset")


CRITERIA = (
    {"check": "return", "metric": "cagr", "op": "ge", "limit": 0.05},
    {"check": "depth", "metric": "max_drawdown", "op": "ge", "limit": -0.20},
    {"check": "length", "metric": "longest_drawdown_days", "op": "le", "limit": 400},
    {"check": "sharpe", "metric": "sharpe", "op": "ge", "limit": 0.4},
)
CHECKS = f"""select p.portfolio, c.name as "check", c.lim as "limit",
    case c.name when 'return' then p.cagr when 'depth' then p.max_drawdown
         when 'length' then p.longest_drawdown_days else p.sharpe end as value,
    case c.name when 'return' then p.cagr >= 0.05 when 'depth' then p.max_drawdown >= -0.20
         when 'length' then p.longest_drawdown_days <= 400 else p.sharpe >= 0.4 end as passed
  from ({PERF}) p cross join (values ('return', 0.05e0), ('depth', -0.2e0), ('length', 400e0),
    ('sharpe', 0.4e0)) c(name, lim)"""


@query(
    "I10_gate_checks",
    "portfolio:s check:s value:f limit:f passed:b",
    CHECKS,
)
def _(t):
    return screens.gate_checks(metrics.performance(t.nav, t.rates), ["portfolio"], CRITERIA)


@query(
    "I10_gate_summary",
    "portfolio:s accepted:b failed:l",
    f"""select portfolio, bool_and(passed) as accepted,
               sum(case when passed then 0 else 1 end) as failed from ({CHECKS}) c group by 1""",
)
def _(t):
    checks = screens.gate_checks(metrics.performance(t.nav, t.rates), ["portfolio"], CRITERIA)
    return screens.gate_summary(checks, ["portfolio"])


@query(
    "I11_liquidity_screen",
    "symbol:s observations:l first_session:d last_session:d median_volume:f zero_fraction:f",
    """select symbol, count(*) as observations, min(session) as first_session,
         max(session) as last_session, median(case when r <= 20 then volume end) as median_volume,
         avg(case when volume = 0 then 1e0 else 0 end) as zero_fraction
       from (select *, row_number() over (partition by symbol order by session desc) as r
             from (select symbol, session, case when volume <= 5 then 0 else volume end as volume
                   from bars) b) t group by 1""",
)
def _(t):
    thin = t.daily.withColumn(
        "volume", F.when(F.col("volume") <= 5, 0.0).otherwise(F.col("volume"))
    )
    return screens.liquidity_screen(thin)


@query(
    "I12_bootstrap_histogram",
    "portfolio:s bin:l draws:l",
    """select portfolio, least(cast(floor((sharpe - lo) / (hi - lo) * 60) as bigint), 59) as bin,
              count(*) as draws
       from bsharpe join (select portfolio, min(sharpe) as lo, max(sharpe) as hi from bsharpe
                          group by 1) e using (portfolio) group by 1, 2""",
    BOOT,
)
def _(t):
    return bootstrap.histogram(bootstrap.sharpe_draws(metrics.returns(t.nav)), ["portfolio"])


@query(
    "I13_sensitivity_table",
    "knob:s value:s sharpe:f cagr:f max_drawdown:f",
    f"""select split_part(variant, '=', 1) as knob, split_part(variant, '=', 2) as value, sharpe,
               cagr, max_drawdown from ({sweep_perf("w")}) p where variant <> 'base'""",
    sweep_sql_ctes("w", AXES),
)
def _(t):
    return sweep.sensitivity_table(
        sweep.run_sweep(t.daily, t.sessions, t.instruments, AXES)
    )


@query(
    "I13_grid_table",
    "trend_window:s " + " ".join(f"top_n_{n}:f" for n in TOP_NS),
    "select regexp_extract(variant, 'trend_window=([0-9]+)', 1) as trend_window, "
    + ", ".join(
        f"max(case when variant like '%top_n={n}' then sharpe end) as top_n_{n}" for n in TOP_NS
    )
    + f"""
        from ({sweep_perf("g")}) p group by 1""",
    sweep_sql_ctes("g", GRID),
)
def _(t):
    trials = sweep.run_sweep(t.daily, t.sessions, t.instruments, GRID)
    return sweep.grid_table(trials, GRID_X, GRID_Y[0])


POLICIES = {
    "never": {"S10": "2100-01-01", "S11": "2100-01-01"},
    "early": {"S10": "1995-01-01", "S11": "1995-01-01"},
    "late": {"S10": "1999-01-01", "S11": "2000-01-01"},
}


def policy_ctes() -> dict[str, str]:
    out = dict(SHARED)
    for name, dates in POLICIES.items():
        dims = (
            "select symbol, case symbol "
            + " ".join(f"when '{s}' then date '{d}'" for s, d in dates.items())
            + " else available_from end as available_from from instruments"
        )
        out[f"dims_{name}"] = dims
        for key, text in momentum_ctes(f"{name}_", "select as_of from ends", [{}]).items():
            out[key] = text.replace("join instruments s on", f"join dims_{name} s on")
    union = " union all ".join(
        f"select 'base@{n}' as variant, as_of, symbol, weight from {n}_targets" for n in POLICIES
    )
    return {**out, **segment_ctes("as_", union, cost=f"{sweep.BASE_COST_RATE}")}


@query(
    "I14_admission_sweep",
    "variant:s sessions:l cagr:f sharpe:f max_drawdown:f",
    perf_sql("variant", "select variant, session, nav, 0e0 as annual_rate from as_nav"),
    policy_ctes(),
)
def _(t):
    return sweep.admission_sweep(t.daily, t.sessions, t.instruments, POLICIES)

