"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.operators import quality

MISSING = {
    "expected": """select c.symbol, d.day as session from (
          select symbol, min(session) as a, max(session) as z from bars group by 1) c
        join instruments i using (symbol)
        join (select cast(unnest(generate_series(
                (select cast(min(session) as timestamp) from bars),
                (select cast(max(session) as timestamp) from bars), interval 1 day)) as date)
                as day) d on d.day between c.a and c.z
        left join sessions s on s.session = d.day
        where i.trades_continuously or s.session is not null""",
    "absent": """select e.symbol, e.session from expected e
        left join bars b on b.symbol = e.symbol and b.session = e.session
        where b.session is null""",
    "jump_rows": """select symbol, session, m from (
          select symbol, session, close / lag(close) over (partition by symbol order by session) - 1
            as m from bars) t where abs(m) > 0.02""",
    "flat_rows": """select symbol, island, sum(case when same then 1 else 0 end) as run from (
          select *, sum(case when same then 0 else 1 end) over
            (partition by symbol order by session) as island
          from (select symbol, session, coalesce(floor(close / 10) = lag(floor(close / 10)) over
                  (partition by symbol order by session), false) as same from bars) a) b
        group by 1, 2""",
    "zero_rows": """select symbol, sum(case when volume <= 3 then 1 else 0 end) as zeros,
          count(*) as n from bars group by 1""",
}


def coarse(t):
    """Bars as a lazy feed would deliver them: coarse closes, thin volume as none."""
    return t.bars.withColumn("close", F.floor(F.col("close") / 10).cast("double") * 10).withColumn(
        "volume", F.when(F.col("volume") <= 3, 0.0).otherwise(F.col("volume"))
    )


@query(
    "J01_history_issues",
    "symbol:s severity:s kind:s detail:s",
    """select symbol, case when n = 0 then 'error' else 'warn' end as severity,
              case when n = 0 then 'empty' else 'short-history' end as kind,
              concat(n, ' sessions') as detail
       from (select i.symbol, count(b.session) as n
             from (select symbol from instruments union all select 'S99') i
             left join bars b on b.symbol = i.symbol group by 1) t where n < 3000""",
)
def _(t):
    listed = t.instruments.select("symbol").union(t.spark.range(1).selectExpr("'S99'"))
    return quality.history_issues(listed, t.bars, 3000)


@query(
    "J02_missing_sessions",
    "symbol:s severity:s detail:s missing:l",
    """select symbol, case when count(*) > 5 then 'error' else 'warn' end as severity,
              concat(count(*), ' absent: ', string_agg(case when r <= 5 then cast(session as varchar)
                end, ', ' order by session),
                case when count(*) > 5 then concat(' (+', count(*) - 5, ' more)') else '' end) as detail, count(*) as missing
       from (select *, row_number() over (partition by symbol order by session) as r from absent) t
       group by 1""",
    MISSING,
)
def _(t):
    return quality.missing_issues(quality.missing_sessions(t.bars, t.sessions, t.instruments))


@query(
    "J03_price_jumps",
    "symbol:s moves:l largest:f session:d",
    """select symbol, count(*) as moves, arg_max(m, abs(m)) as largest,
              arg_max(session, abs(m)) as session from jump_rows group by 1""",
    MISSING,
)
def _(t):
    return quality.price_jumps(t.bars, 0.02)


@query(
    "J04_flatlines",
    "symbol:s longest:l",
    "select symbol, max(run) as longest from flat_rows group by 1 having max(run) >= 5",
    MISSING,
)
def _(t):
    return quality.flatlines(coarse(t))


@query(
    "J05_zero_volume",
    "symbol:s severity:s zeros:l",
    """select symbol, case when zeros > n * 0.01 then 'warn' else 'info' end as severity, zeros
       from zero_rows where zeros > 0""",
    MISSING,
)
def _(t):
    return quality.zero_volume(coarse(t))


@query(
    "J06_summarise",
    "severity:s issues:l",
    """select s.severity, count(i.symbol) as issues
       from (values ('info'), ('warn'), ('error')) s(severity)
       left join (
         select symbol, case when count(*) > 5 then 'error' else 'warn' end as severity
           from absent group by 1
         union all select symbol, 'warn' from (
           select symbol, max(abs(floor(close / 10) * 10 / prev - 1)) as m from (
             select symbol, close, lag(floor(close / 10) * 10) over (partition by symbol order by session)
               as prev from bars) q group by 1) j where m > 0.25
         union all select symbol, 'warn' from flat_rows group by 1 having max(run) >= 5
         union all select symbol, case when zeros > n * 0.01 then 'warn' else 'info' end
           from zero_rows where zeros > 0) i on i.severity = s.severity
       group by 1""",
    MISSING,
)
def _(t):
    return quality.summarise(quality.check_bars(t.instruments, coarse(t), t.sessions))


@query(
    "J07_research_coverage",
    "symbol:s expected:l missing:l invalid:l",
    """select i.symbol, (select count(*) from sessions) as expected,
              (select count(*) from sessions) - count(s.session) as missing, 0 as invalid
       from instruments i left join bars b on b.symbol = i.symbol
       left join sessions s on s.session = b.session group by 1""",
)
def _(t):
    return quality.research_coverage(t.bars, t.sessions, t.instruments)
