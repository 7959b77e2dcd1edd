"""Scan, source and sink queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from quantframe.catalog.registry import query
from quantframe.operators import bars as ops
from quantframe.session import scratch_folder
from quantframe.sources import dimensions, gates, provider, rates, statement, store
from quantframe.sources.ranged import RangedStore
from quantframe.streaming.jobs import run_bars

AS_OF = dt.date(1999, 6, 30)
SYMBOLS = [f"S{i:02d}" for i in range(12)]


@query(
    "A01_read_bars",
    "symbol:s session:d open:f high:f low:f close:f volume:f",
    """select * from bars where symbol = 'S03' and session >= date '1997-01-01'
       and session <= date '2000-12-31' and session <= date '1999-06-30'""",
)
def _(t):
    return ops.read_bars(
        t.bars, symbol="S03", start=dt.date(1997, 1, 1), end=dt.date(2000, 12, 31), as_of=AS_OF
    )


@query(
    "A01_read_bars_as_of",
    "symbol:s session:d close:f",
    "select symbol, session, close from bars where session <= date '1999-06-30'",
)
def _(t):
    return ops.read_bars(t.bars, as_of=AS_OF)


def stored_bars(t) -> RangedStore:
    """The bars as a store of their own, which providers can read."""
    kept = RangedStore(t.spark, f"{scratch_folder(t.spark, 'bars')}/store")
    kept.upsert(t.bars)
    return kept


@query(
    "A01_provider_bars",
    "symbol:s session:d open:f high:f low:f close:f volume:f",
    """select * from bars where symbol = 'S03' and session >= date '1997-01-01'
       and session <= date '2000-12-31' and session <= date '1999-06-30'""",
)
def _(t):
    return provider.provider_bars(
        t.spark,
        where="symbol = 'S03' and session between date'1997-01-01' and date'2000-12-31'"
        " and session <= date'1999-06-30'",
        path=stored_bars(t).path,
    )


RESTATED = """select symbol, session, open, high, low,
         case when session between date '2000-06-23' and date '2000-06-30' then close * 1.001
              else close end as close, volume
       from bars"""


def restated_store(t) -> RangedStore:
    """The store after a re-sync of one week with corrected closes."""
    kept = stored_bars(t)
    week = F.col("session").between(F.lit(dt.date(2000, 6, 23)), F.lit(dt.date(2000, 6, 30)))
    kept.upsert(t.bars.filter(week).withColumn("close", F.col("close") * 1.001))
    return kept


@query(
    "A01_stream_bars",
    "symbol:s session:d open:f high:f low:f close:f volume:f",
    RESTATED,
)
def _(t):
    folder = scratch_folder(t.spark, "bar-stream")
    stream = provider.provider_stream(t.spark, path=restated_store(t).path)
    return run_bars(stream, folder)


@query("A02_store_upsert", "symbol:s session:d close:f volume:f", RESTATED)
def _(t):
    return restated_store(t).read()


@query(
    "A02_upsert_bars",
    "symbol:s session:d close:f volume:f",
    """select symbol, session, case when session >= date '2000-06-23' then close * 1.001
                                    else close end as close, volume
       from bars""",
)
def _(t):
    stored = t.bars.filter(F.col("session") <= F.lit(dt.date(2000, 6, 30)))
    restated = t.bars.filter(F.col("session") >= F.lit(dt.date(2000, 6, 23))).withColumn(
        "close", F.col("close") * 1.001
    )
    return ops.upsert_bars(stored, restated)


def raw_bars(t):
    """Ticks presented as if each were a daily bar: duplicates abound."""
    return t.ticks.select(
        "symbol",
        "session",
        *[F.col("px").alias(c) for c in ("open", "high", "low", "close")],
        "volume",
        "k",
    )


TICK_BARS = {
    "tick_bars": """select concat('S', lpad(cast(l_suppkey % 12 as varchar), 2, '0')) as symbol,
          cast(l_shipdate as date) as session, l_quantity as volume,
          (95 + (l_extendedprice / l_quantity) / 400) * (1 + ((l_suppkey % 12) - 5.5e0) * 0.00002e0
            * datediff('day', date '1995-01-01', cast(l_shipdate as date))) as px,
          l_orderkey * 1000000000000 + l_partkey * 1000000 + l_suppkey * 10 + l_linenumber as k
        from lineitem"""
}


@query(
    "A03_schema_violations",
    "symbol:s session:d copies:l",
    """select symbol, session, count(*) as copies from tick_bars group by 1, 2
       having count(*) > 1""",
    TICK_BARS,
)
def _(t):
    return ops.schema_violations(raw_bars(t))


BROKEN = """select symbol, session, open, high,
              case when volume > 150 then high + 1 else low end as low,
              case when volume < 3 then -close else close end as close,
              volume from bars"""


@query(
    "A04_validate_bar_rows",
    "symbol:s session:d reason:s",
    f"""select symbol, session, case
           when least(round(open, 8), round(high, 8), round(low, 8), round(close, 8)) <= 0
             then 'non-positive price'
           when low > high then 'low above high'
           when round(open, 8) < round(low, 8) or round(open, 8) > round(high, 8)
             then 'open outside range'
           when round(close, 8) < round(low, 8) or round(close, 8) > round(high, 8)
             then 'close outside range' end as reason
        from ({BROKEN}) b
        where volume > 150 or volume < 3""",
)
def _(t):
    bad = t.bars.select(
        "symbol",
        "session",
        "open",
        "high",
        F.when(F.col("volume") > 150, F.col("high") + 1).otherwise(F.col("low")).alias("low"),
        F.when(F.col("volume") < 3, -F.col("close")).otherwise(F.col("close")).alias("close"),
        "volume",
    )
    return ops.validate_bar_rows(bad)[1]


@query(
    "A05_coverage",
    "symbol:s first:d last:d rows:l span_years:f",
    """select symbol, min(session) as first, max(session) as last, count(*) as rows,
              datediff('day', min(session), max(session)) / 365.25e0 as span_years
       from bars group by 1""",
)
def _(t):
    return ops.coverage(t.bars)


@query(
    "A06_inventory",
    "symbol:s rows:l has_rows:b",
    """select symbol, count(b.session) as rows, count(b.session) > 0 as has_rows
       from instruments left join bars b using (symbol) group by 1""",
)
def _(t):
    counts = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return (
        t.instruments.select("symbol")
        .join(counts, "symbol", "left")
        .fillna(0, ["rows"])
        .withColumn("has_rows", F.col("rows") > 0)
    )


@query(
    "A07_close_panel",
    "session:d " + " ".join(f"{s}:f" for s in SYMBOLS),
    "select session, "
    + ", ".join(f"max(case when symbol = '{s}' then close end) as {s}" for s in SYMBOLS)
    + " from bars where session <= date '1999-06-30' group by 1",
)
def _(t):
    return ops.close_panel(t.bars, SYMBOLS, AS_OF)


def vendor_rows(t):
    raw = t.ticks.select(
        F.col("symbol"),
        F.col("session"),
        F.when(F.col("volume") == 50, None).otherwise(F.col("px")).alias("Open"),
        F.col("px").alias("High"),
        F.col("px").alias("Low"),
        F.when(F.col("volume") == 1, -F.col("px")).otherwise(F.col("px")).alias("Close"),
        F.col("volume").alias("Volume"),
        F.col("k").alias("K"),
    )
    return ops.normalise_vendor_bars(raw, "K")


VENDOR = """select symbol, session, close, volume, close > 0 as accepted from (
    select symbol, session, arg_max(case when volume = 1 then -px else px end, k) as close,
           max_by(volume, k) as volume from tick_bars group by 1, 2) q where volume <> 50"""


@query(
    "A08_normalise_vendor_bars",
    "symbol:s session:d close:f volume:f accepted:b",
    VENDOR,
    TICK_BARS,
)
def _(t):
    good, bad = vendor_rows(t)
    pick = ["symbol", "session", "close", "volume"]
    return (
        good.select(*pick)
        .withColumn("accepted", F.lit(True))
        .unionByName(bad.select(*pick).withColumn("accepted", F.lit(False)))
    )


@query(
    "A09_incremental_window",
    "symbol:s last:d fetch_start:d",
    """select i.symbol, b.last, coalesce(greatest(date '1995-03-01', b.last - 7),
              date '1995-03-01') as fetch_start
       from instruments i left join (
         select symbol, max(session) as last from bars group by 1) b
         using (symbol)""",
)
def _(t):
    return ops.incremental_window(
        t.instruments, t.bars, dt.date(1995, 3, 1)
    )


@query("A10_rate_curve", "date:d annual_rate:f", "select * from rates")
def _(t):
    text = t.rates.select(
        F.concat_ws(",", F.col("date").cast("string"), F.col("annual_rate").cast("string")).alias("line")
    )
    return text.select(
        F.from_csv("line", rates.RATE_SCHEMA, {"mode": "FAILFAST"}).alias("r")
    ).select("r.*")


@query(
    "A11_margin_curve",
    "date:d annual_rate:f",
    """select date, greatest(annual_rate, 0) + 0.015 as annual_rate from (
         select date, (annual_rate * 100 - 1.5) / 100 as annual_rate from rates
         where annual_rate <= 0.02) t""",
)
def _(t):
    published = t.rates.select(
        F.col("date").cast("string").alias("observation_date"),
        F.when(F.col("annual_rate") > 0.02, ".")
        .otherwise((F.col("annual_rate") * 100 - 1.5).cast("string"))
        .alias("value"),
    )
    return rates.margin_curve(rates.observations(published))


FACTORS = ["composite", "core_excess", "market", "quality", "value"]


@query(
    "A12_factor_panel",
    "month:d " + " ".join(f"{f}:f" for f in FACTORS),
    "select month, "
    + ", ".join(f"max(case when factor = '{f}' then ret end) as {f}" for f in FACTORS)
    + " from factors group by 1 having count(*) = 5",
)
def _(t):
    return gates.factor_panel(t.factors, FACTORS)


@query(
    "A12_factor_violations",
    "factor:s month:d kind:s",
    """select f.factor, cast(m.month as date) as month, 'missing month' as kind
       from (select distinct factor from factors) f
       cross join (select unnest(generate_series(timestamp '1995-01-01',
             timestamp '2001-12-01', interval 1 month)) as month) m
       left join factors x on x.factor = f.factor and x.month = m.month
       where x.month is null""",
)
def _(t):
    return gates.factor_violations(t.factors, "1995-01-01", "2001-12-01")


def statement_lines(t):
    """One statement per portfolio, written from its fills."""
    heads = t.fills.select("portfolio").distinct().select(
        F.col("portfolio").alias("file"),
        F.inline(
            F.array(
                F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("Statement,Header,Field Name,Field Value").alias("line")),
                F.struct(F.lit(1).cast("bigint").alias("pos"), F.lit('Statement,Data,Period,"January 1, 1995 - December 31, 2001"').alias("line")),
                F.struct(F.lit(2).cast("bigint").alias("pos"), F.lit("Trades,Header,DataDiscriminator,Asset Category,Currency,Symbol,Date/Time,Quantity,T. Price,Proceeds,Comm/Fee").alias("line")),
            )
        ),
    )
    data = t.fills.select(
        F.col("portfolio").alias("file"),
        F.col("execution_id").alias("pos"),
        F.concat_ws(
            ",",
            F.lit("Trades,Data,Order,Stocks,USD"),
            "symbol",
            F.concat(F.lit('"'), F.col("session").cast("string"), F.lit(', 16:20:00"')),
            F.concat(F.lit('"'), F.format_number("quantity", 0), F.lit('"')),
            F.col("price").cast("decimal(18,4)").cast("string"),
            (-F.col("quantity") * F.col("price")).cast("decimal(18,4)").cast("string"),
            (-F.col("commission")).cast("decimal(18,4)").cast("string"),
        ).alias("line"),
    )
    width = F.lit(str(10**26)).cast("decimal(38,0)")
    return heads.unionByName(data).withColumn("block", F.floor(F.col("pos") / width))


@query(
    "A13_statement_trades",
    "file:s symbol:s session:d quantity:f price:f commission:f",
    """select portfolio as file, symbol, session, quantity, price, commission from fills""",
)
def _(t):
    found = statement.trades(statement.sectioned(statement_lines(t)))
    return found.withColumn("session", F.to_date("ts"))


@query(
    "A13_statement_period",
    "file:s coverage_end:d",
    "select distinct portfolio as file, date '2001-12-31' as coverage_end from fills",
)
def _(t):
    return statement.period_end(statement.sectioned(statement_lines(t)))


@query(
    "A14_chain_violations",
    "market:s contract:s session:d kind:s",
    """with c as (select market, contract, session, open, high, close, last_trade,
                   case when volume > 20000 then high + 1 else low end as low,
                   case when volume < 50 then -volume else volume end as volume,
                   case when volume > 25000 then 0 else multiplier end as multiplier from chain)
       select market, contract, session, 'low above high' as kind from c where low > high
       union all select market, contract, session, 'open outside range' from c
         where open < low or open > high
       union all select market, contract, session, 'close outside range' from c
         where close < low or close > high
       union all select market, contract, session, 'negative volume' from c where volume < 0
       union all select market, contract, session, 'non-positive multiplier' from c
         where multiplier <= 0
       union all select market, contract, session, 'bar after last trade' from c
         where session > last_trade
       union all select market, contract, null, 'metadata changes' from c
         group by 1, 2 having count(distinct multiplier) > 1 or count(distinct last_trade) > 1""",
)
def _(t):
    v = F.col("volume")
    broken = (
        t.chain.withColumn("low", F.when(v > 20000, F.col("high") + 1).otherwise(F.col("low")))
        .withColumn("multiplier", F.when(v > 25000, 0.0).otherwise(F.col("multiplier")))
        .withColumn("volume", F.when(v < 50, -v).otherwise(v))
    )
    return gates.chain_violations(broken)


@query(
    "A15_session_gate",
    "symbol:s session:d kind:s",
    """select w.symbol, w.session, 'missing session' as kind
       from (select i.symbol, s.session from instruments i cross join sessions s) w
       left join bars b using (symbol, session) where b.session is null
       union all
       select b.symbol, b.session, 'extra session' from bars b left join sessions s using (session)
       where s.session is null""",
)
def _(t):
    return gates.session_violations(t.bars, t.sessions, keys=("symbol",))


@query(
    "A16_journal_append_once",
    "order_id:s symbol:s quantity:f",
    "select order_id, symbol, quantity from order_book",
)
def _(t):
    cutoff = F.lit("2000-01-01").cast("timestamp")
    overlap = F.lit("1999-06-01").cast("timestamp")
    existing = t.order_book.filter(F.col("created_at") < cutoff)
    again = t.order_book.filter(F.col("created_at") >= overlap)
    return existing.unionByName(store.ignore_known(existing, again, ["order_id"]))


@query(
    "A16_journal_replace_mark",
    "portfolio:s session:d nav:f",
    """select portfolio, session, case when session >= date '2000-06-01' then nav + 1 else nav end
              as nav from nav""",
)
def _(t):
    existing = t.nav.filter("session < date'2000-07-01'")
    marks = t.nav.filter("session >= date'2000-06-01'").withColumn("nav", F.col("nav") + 1)
    return store.replace_known(existing, marks, ["portfolio", "session"])


HASHED = """concat_ws('|', cast(execution_id as varchar), symbol, cast(cast(quantity as bigint)
   as varchar), cast(cast(round(price * 10000) as bigint) as varchar))"""


def fill_fingerprint(t, fills):
    columns = [
        F.col("execution_id").cast("string"),
        F.col("symbol"),
        F.col("quantity").cast("bigint").cast("string"),
        F.round(F.col("price") * 10000).cast("bigint").cast("string"),
    ]
    return gates.fingerprint(fills, columns, ["portfolio"])


@query(
    "A17_table_fingerprint",
    "portfolio:s rows:l fingerprint:s",
    f"""select portfolio, count(*) as rows,
               sum(cast('0x' || substr(sha256({HASHED}), 1, 9) as bigint)) as fingerprint
        from fills group by 1""",
)
def _(t):
    return fill_fingerprint(t, t.fills)


@query(
    "A17_manifest_drift",
    "portfolio:s drift:s",
    """select portfolio, 'changed' as drift from fills where tax = 0.07 and symbol = 'S05'
         and portfolio <> 'P7' group by 1
       union all select 'P7', 'removed'""",
)
def _(t):
    then = fill_fingerprint(t, t.fills)
    now = fill_fingerprint(
        t, t.fills.filter("portfolio <> 'P7' and not (tax = 0.07 and symbol = 'S05')")
    )
    return gates.manifest_drift(then, now, ["portfolio"])


@query(
    "A18_universe_members",
    "universe:s symbol:s available_from:d bars:l",
    """select u.universe, i.symbol, i.available_from, count(b.session) as bars
       from (values ('core'), ('core+crypto')) u(universe)
       join instruments i on u.universe = 'core+crypto' or not i.trades_continuously
       left join bars b on b.symbol = i.symbol group by 1, 2, 3""",
)
def _(t):
    counts = t.bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
    return dimensions.universe_members(t.instruments).join(counts, "symbol", "left").fillna(
        0, ["bars"]
    )
