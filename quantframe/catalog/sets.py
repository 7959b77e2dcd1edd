"""Sort, limit and set-operation queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantframe.catalog.registry import query


@query(
    "M01_ordered_rows",
    "symbol:s session:d close:f place:l",
    """select symbol, session, close, row_number() over
         (partition by session order by close desc, symbol) as place from bars""",
)
def _(t):
    w = Window.partitionBy("session").orderBy(F.col("close").desc(), "symbol")
    return t.bars.withColumn("place", F.row_number().over(w)).orderBy("session", "place")


@query(
    "M02_topk_per_group",
    "portfolio:s execution_id:s value:m",
    """select portfolio, execution_id, value from (
         select portfolio, execution_id, quantity * price as value, row_number() over
           (partition by portfolio order by quantity * price desc, execution_id) as r from fills) t
       where r <= 10""",
)
def _(t):
    from quantframe.operators.topk import top_per_group

    rows = t.fills.select(
        "portfolio", "execution_id", (F.col("quantity") * F.col("price")).alias("value")
    )
    return top_per_group(rows, ["portfolio"], "value", ["execution_id"], 10)


@query(
    "M03_union_of_dates",
    "session:d",
    "select session from bars union select session from nav",
)
def _(t):
    return t.ticks.select("session").unionByName(t.nav.select("session")).distinct()


@query(
    "M04_intersection",
    "session:d",
    "select session from sessions intersect select session from nav",
)
def _(t):
    return t.sessions.select("session").intersect(t.nav.select("session"))


@query(
    "M05_difference",
    "session:d",
    "select session from sessions except select session from nav",
)
def _(t):
    return t.sessions.select("session").subtract(t.nav.select("session"))


@query(
    "M06_duplicates",
    "symbol:s session:d first_id:s last_id:s copies:l",
    """select symbol, session, min(execution_id) as first_id, max(execution_id) as last_id,
              count(*) as copies from fills group by 1, 2 having count(*) > 1""",
)
def _(t):
    return (
        t.fills.groupBy("symbol", "session")
        .agg(
            F.min("execution_id").alias("first_id"),
            F.max("execution_id").alias("last_id"),
            F.count(F.lit(1)).alias("copies"),
        )
        .filter("copies > 1")
    )


@query(
    "M07_pivot_unpivot",
    "session:d field:s value:f",
    """select session, 'close' as field, avg(close) as value from bars group by 1
       union all select session, 'open', avg(open) from bars group by 1
       union all select session, 'volume', sum(volume) from bars group by 1""",
)
def _(t):
    wide = t.bars.groupBy("session").agg(
        F.avg("open").alias("open"), F.avg("close").alias("close"), F.sum("volume").alias("volume")
    )
    return wide.unpivot("session", ["open", "close", "volume"], "field", "value")


@query(
    "M08_forward_fill",
    "symbol:s session:d filled:f",
    """select symbol, session, last_value(case when volume > 40 then close end ignore nulls)
         over (partition by symbol order by session) as filled from bars""",
)
def _(t):
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(Window.unboundedPreceding, 0)
    seen = F.when(F.col("volume") > 40, F.col("close"))
    return t.bars.withColumn("filled", F.last(seen, ignorenulls=True).over(w))


@query(
    "M09_halves",
    "portfolio:s half:l sessions:l first:d last:d",
    """select portfolio, half, count(*) as sessions, min(session) as first, max(session) as last
       from (select portfolio, session, ntile(2) over (partition by portfolio order by session)
               as half from nav) t group by 1, 2""",
)
def _(t):
    w = Window.partitionBy("portfolio").orderBy("session")
    return (
        t.nav.withColumn("half", F.ntile(2).over(w))
        .groupBy("portfolio", "half")
        .agg(
            F.count(F.lit(1)).alias("sessions"),
            F.min("session").alias("first"),
            F.max("session").alias("last"),
        )
    )
