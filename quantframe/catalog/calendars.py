"""Calendar and schedule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.operators import calendars as cal

_MONTH_END = """
select session, seq from (
  select session, seq, lead(session) over (order by session) as nxt from sessions) t
where date_trunc('month', nxt) <> date_trunc('month', session)"""


@query(
    "B01_exchange_sessions",
    "session:d seq:l open_ts:t close_ts:t",
    """select session, seq, session + interval 14 hour as open_ts,
              session + interval 21 hour as close_ts from sessions""",
)
def _(t):
    return cal.exchange_sessions(t.ticks)


@query(
    "B02_continuous_sessions",
    "session:d open_ts:t close_ts:t",
    """select cast(day as date) as session, day as open_ts,
              day + interval 24 hour - interval 1 second as close_ts
       from (select unnest(generate_series(cast(min(session) as timestamp),
               cast(max(session) as timestamp), interval 1 day)) as day from bars) t""",
)
def _(t):
    return cal.continuous_sessions(
        t.ticks.agg(F.min("session").alias("first"), F.max("session").alias("last"))
    )


@query(
    "B03_neighbour_sessions",
    "session:d previous_session:d next_session:d",
    """select session, lag(session) over (order by session) as previous_session,
              lead(session) over (order by session) as next_session from sessions""",
)
def _(t):
    return cal.neighbours(t.sessions)


@query(
    "B03_is_session",
    "day:d is_session:b",
    """select d.day, s.session is not null as is_session
       from (select distinct session as day from bars) d left join sessions s on s.session = d.day""",
)
def _(t):
    days = t.ticks.select(F.col("session").alias("day")).distinct()
    return cal.is_session(days, t.sessions)


@query("B04_month_end_sessions", "session:d seq:l", _MONTH_END)
def _(t):
    return cal.month_ends(t.sessions)


@query(
    "B05_monthly_offset",
    "offset:l session:d",
    f"""with ends as ({_MONTH_END})
        select o.k as "offset", s.session from ends
        cross join (values (0), (5), (10), (15)) o(k)
        join sessions s on s.seq = ends.seq - o.k""",
)
def _(t):
    return cal.monthly_offsets(t.sessions, (0, 5, 10, 15))


@query(
    "B06_weekly",
    "session:d",
    """select session from (select session, lead(session) over (order by session) as nxt
                            from sessions) t
       where isodow(session) = 5
          or exists (select 1 from range(1, 40) r(k)
                     where session + k * interval 1 day < nxt
                       and isodow(session + k * interval 1 day) = 5)""",
)
def _(t):
    return cal.weekly(t.sessions, 4)


@query(
    "B07_iso_week_last",
    "week:d session:d",
    """select date_trunc('week', session) as week, max(session) as session
       from sessions where isodow(session) <= 3 group by 1""",
)
def _(t):
    return cal.iso_week_last(t.sessions, 2)


@query(
    "B08_schedule_combinators",
    "kind:s session:d",
    f"""with ends as ({_MONTH_END}),
        ready as (select session from (select session, row_number() over
                    (partition by symbol order by session) as n from bars) where n >= 260)
        select 'daily' as kind, session from sessions
        union all select 'once', min(session) from ready
        union all select 'any_of', session from (
          select session from ends
          union select s.session from ends join sessions s on s.seq = ends.seq - 10) u""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("session")
    ready = t.bars.select("session", F.row_number().over(w).alias("n")).filter("n >= 260")
    parts = {
        "daily": cal.daily(t.sessions),
        "once": cal.once(ready),
        "any_of": cal.any_of(cal.month_ends(t.sessions), cal.monthly_offset(t.sessions, 10)),
    }
    out = None
    for kind, df in parts.items():
        tagged = df.select(F.lit(kind).alias("kind"), "session")
        out = tagged if out is None else out.unionByName(tagged)
    return out


@query(
    "B09_stamp_at_session_close",
    "symbol:s session:d close:f ts:t",
    """select b.symbol, b.session, b.close,
              case when i.trades_continuously then b.session + interval 24 hour - interval 1 second
                   else b.session + interval 21 hour end as ts
       from bars b join instruments i using (symbol) left join sessions s using (session)
       where i.trades_continuously or s.session is not null""",
)
def _(t):
    bounds = t.ticks.agg(F.min("session").alias("first"), F.max("session").alias("last"))
    return cal.stamp_at_session_close(
        t.bars.select("symbol", "session", "close"),
        t.instruments,
        cal.exchange_sessions(t.ticks),
        cal.continuous_sessions(bounds),
    )


@query(
    "B10_staleness",
    "newest:d today:d behind:l fresh:b",
    """select newest, today, greatest(n - 1, 0) as behind, greatest(n - 1, 0) <= 3 as fresh
       from (select (select max(cast(o_orderdate as date)) from orders) as newest,
               (select max(session) from sessions) as today,
               (select count(*) from sessions where session >=
                  (select max(cast(o_orderdate as date)) from orders)) as n) t""",
)
def _(t):
    ordered = t.raw("orders").select(F.col("o_orderdate").cast("date").alias("session"))
    return cal.staleness(ordered, t.sessions)


def start_grid(t):
    return cal.start_date_grid(
        t.ticks.agg(F.min("session").alias("first"), F.max("session").alias("last"))
    )


START_GRID = """with b as (select min(session) as first, max(session) as last from bars),
        g as (select first, last, n,
                     cast(date_trunc('month', first) + n * 18 * interval 1 month
                       + (least(day(first), 28) - 1) * interval 1 day as date) as session
              from b, range(1, 8) r(n))
       select 0 as n, first as session from b
       union all
       select n, session from g
       where session <= least(
         cast(date_trunc('month', first) + interval 120 month
           + (least(day(first), 28) - 1) * interval 1 day as date),
         cast(date_trunc('month', last) - interval 36 month
           + (least(day(last), 28) - 1) * interval 1 day as date))"""


@query(
    "B11_start_date_grid",
    "n:l session:d",
    START_GRID,
)
def _(t):
    return start_grid(t)


@query(
    "B12_exchange_local_to_utc",
    "session:d utc:s",
    """select session,
         strftime((cast(session as timestamp) + interval '9 hours 30 minutes')
             + case when session >= dst_start and session < dst_end
                    then interval 4 hour else interval 5 hour end, '%Y-%m-%d %H:%M:%S') as utc
       from (select session,
           case when year(session) < 2007
             then make_date(year(session), 4, 1)
               + cast((7 - isodow(make_date(year(session), 4, 1))) as integer)
           end as dst_start,
           make_date(year(session), 10, 31)
             - cast(isodow(make_date(year(session), 10, 31)) % 7 as integer) as dst_end
         from sessions) t""",
)
def _(t):
    stamped = t.sessions.select(
        "session", F.concat(F.col("session").cast("string"), F.lit(", 09:30:00")).alias("text")
    )
    return stamped.select(
        "session",
        F.date_format(cal.exchange_local_to_utc("text"), "yyyy-MM-dd HH:mm:ss").alias("utc"),
    )


@query(
    "B13_investable",
    "session:d symbol:s",
    f"""with ends as ({_MONTH_END})
        select e.session, i.symbol from ends e join instruments i
          on i.available_from is null or e.session >= i.available_from""",
)
def _(t):
    return cal.investable(t.instruments, cal.month_ends(t.sessions))
