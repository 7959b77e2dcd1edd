"""Market, ledger and rate tables derived from the given parquet tables.

Every frame below is a declarative query over whole input tables, so the work of each
registered operator grows with its inputs. Column pruning reaches the parquet scans because
the derivations only name the columns they use.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.session import shared

SYMBOLS = 12
PORTFOLIOS = 8
INITIAL_CASH = 100_000_000.0

#: A row's place among all rows, and its id: order, part, supplier and line number side by side
#: in 38 digits, with room for 10^15 orders and 10^11 parts and suppliers.
ROW_KEY = (
    "cast(cast(l_orderkey as decimal(38,0)) * 100000000000000000000000BD"
    " + cast(l_partkey as decimal(38,0)) * 1000000000000BD"
    " + cast(l_suppkey as decimal(38,0)) * 10BD + l_linenumber as decimal(38,0))"
)
RAW_PRICE = "95 + (l_extendedprice / l_quantity) / 400"
SYMBOL = f"concat('S', lpad(cast(l_suppkey % {SYMBOLS} as string), 2, '0'))"


class Tables:
    """Lazily derived inputs over one scale-factor folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    # ------------------------------------------------------------------ market

    @cached_property
    def ticks(self) -> DataFrame:
        """One priced row per line item: symbol, session, price, volume, order key."""
        return self.raw("lineitem").selectExpr(
            f"{SYMBOL} as symbol",
            "cast(l_shipdate as date) as session",
            "l_quantity as volume",
            f"""({RAW_PRICE}) * (1 + ((l_suppkey % {SYMBOLS}) - 5.5D) * 0.00002D
                * datediff(cast(l_shipdate as date), date'1995-01-01')) as px""",
            f"{ROW_KEY} as k",
        )

    @cached_property
    def bars(self) -> DataFrame:
        return self.ticks.groupBy("symbol", "session").agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("volume").alias("volume"),
        )

    @cached_property
    def daily(self) -> DataFrame:
        """The same bars, kept after their first derivation: for plans that read them in
        several branches, as they would read a stored table."""
        return shared(self.bars)

    @cached_property
    def sessions(self) -> DataFrame:
        """Exchange calendar: traded weekdays, numbered in order."""
        from quantframe.operators.calendars import number_sessions

        # Bars that are stored already list the same days.
        traded = (
            self.daily.select("session")
            if "daily" in self.__dict__
            else self.raw("lineitem").selectExpr("cast(l_shipdate as date) as session")
        )
        days = traded.distinct().filter("weekday(session) < 5")
        return shared(number_sessions(days))

    @cached_property
    def instruments(self) -> DataFrame:
        """One row per traded symbol; S10 and S11 trade around the clock and join late."""
        idx = "cast(substr(symbol, 2) as int)"
        traded = (
            self.daily.select("symbol")
            if "daily" in self.__dict__
            else self.raw("lineitem").selectExpr(f"{SYMBOL} as symbol")
        )
        return (
            traded.distinct()
            .selectExpr(
                "symbol",
                f"case when {idx} >= 10 then 'crypto' else 'etf' end as asset_class",
                f"case when {idx} >= 10 then 0.01D else 1D end as lot_size",
                f"{idx} >= 10 as trades_continuously",
                f"""case {idx} when 10 then date'1997-01-01' when 11 then date'1999-01-01'
                    end as available_from""",
                f"case when {idx} < 10 then 0.3D + 0.2D * {idx} end as half_spread_bps",
            )
        )

    # ------------------------------------------------------------------ ledger

    @cached_property
    def fills(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            f"concat('P', cast(l_orderkey % {PORTFOLIOS} as string)) as portfolio",
            f"{SYMBOL} as symbol",
            "cast(l_shipdate as timestamp) as ts",
            "cast(l_shipdate as date) as session",
            "case when l_returnflag = 'R' then -l_quantity else l_quantity end as quantity",
            f"floor(({RAW_PRICE}) * 10000 + 0.5D) / 10000 as price",
            "greatest(0.35D, floor(0.35D * l_quantity + 0.5D) / 100) as commission",
            "floor(l_quantity * 100 * l_tax + 0.5D) / 100 as slippage",
            "concat('O', cast(l_orderkey as string)) as order_id",
            f"{ROW_KEY} as execution_id",
            "l_linestatus as venue",
            "l_tax as tax",
        )

    @cached_property
    def flows(self) -> DataFrame:
        """The fills per position and session, kept after their first derivation. Whoever reads
        them reads bars or sessions too, so the bars are derived beside them."""
        from quantframe.operators.ledger import session_flows

        with ThreadPoolExecutor(1) as beside:
            bars = beside.submit(lambda: self.daily)
            out = shared(session_flows(self.fills), "flows")
            bars.result()
        return out

    @cached_property
    def panel(self) -> DataFrame:
        """Last-known prices of every symbol and session."""
        from quantframe.operators.bars import filled_panel

        return filled_panel(self.daily, self.sessions)

    @cached_property
    def held(self) -> DataFrame:
        """What every portfolio holds at every session."""
        from quantframe.operators.ledger import holdings

        return holdings(self.flows, self.sessions)

    @cached_property
    def lines(self) -> DataFrame:
        """The market value of what is held."""
        from quantframe.operators.ledger import marked_lines

        return marked_lines(self.held, self.panel)

    @cached_property
    def marks(self) -> DataFrame:
        """NAV, cash and exposure of every portfolio and session."""
        from quantframe.operators.ledger import cash_at_sessions, mark_book

        cash = cash_at_sessions(self.flows, self.sessions, INITIAL_CASH)
        return mark_book(self.lines, cash)

    @cached_property
    def order_book(self) -> DataFrame:
        """Intentions to match to trades: 20 hours before even executions, else 5 days."""
        return self.fills.selectExpr(
            "concat('I', cast(execution_id as string)) as order_id",
            "portfolio",
            "symbol",
            "quantity",
            """case when execution_id % 2 = 0 then ts - interval 20 hours
                    else ts - interval 5 days end as created_at""",
        )

    @cached_property
    def amendments(self) -> DataFrame:
        """Two successive corrections for every fill at the top tax band; the second leaves
        the commission and the slippage as they were."""
        hit = self.fills.filter("tax >= 0.08")
        return hit.select(
            "execution_id",
            F.explode(
                F.array(
                    F.struct(
                        F.lit(1).alias("version"),
                        F.col("ts").alias("ts"),
                        (F.col("price") + 0.01).alias("price"),
                        F.col("commission").alias("commission"),
                        (F.col("slippage") + 0.5).alias("slippage"),
                        F.lit("first import").alias("import_id"),
                    ),
                    F.struct(
                        F.lit(2).alias("version"),
                        F.expr("ts + interval 1 hour").alias("ts"),
                        (F.col("price") + 0.02).alias("price"),
                        F.lit(None).cast("double").alias("commission"),
                        F.lit(None).cast("double").alias("slippage"),
                        F.lit("second import").alias("import_id"),
                    ),
                )
            ).alias("a"),
        ).select("execution_id", "a.*")

    # ------------------------------------------------------------------ curves

    @cached_property
    def nav(self) -> DataFrame:
        """Eight equity curves, one per portfolio."""
        from pyspark.sql import Window

        daily = (
            self.raw("orders")
            .selectExpr(
                f"concat('P', cast(o_custkey % {PORTFOLIOS} as string)) as portfolio",
                "cast(o_orderdate as date) as session",
                "o_totalprice",
            )
            .groupBy("portfolio", "session")
            .agg(
                (0.0003 + F.lit(0.02) * (F.avg("o_totalprice") / 250000.0 - 1)).alias("r")
            )
        )
        w = Window.partitionBy("portfolio").orderBy("session")
        grown = 100000 * F.exp(F.sum(F.log(1 + F.col("r"))).over(w))
        return daily.select(
            "portfolio",
            "session",
            (F.floor(grown * 1e6 + 0.5) / 1e6).alias("nav"),
        )

    @cached_property
    def rates(self) -> DataFrame:
        return (
            self.raw("orders")
            .groupBy(F.expr("cast(date_trunc('month', o_orderdate) as date)").alias("date"))
            .agg(
                F.expr(
                    """floor((0.01D + 0.03D * avg(case when o_orderstatus = 'F'
                       then 1D else 0D end)) * 1e6 + 0.5D) / 1e6"""
                ).alias("annual_rate")
            )
        )

    @cached_property
    def factors(self) -> DataFrame:
        """Monthly factor panel: growth of average order value by customer region."""
        from pyspark.sql import Window

        region = (
            self.raw("nation")
            .join(self.raw("region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select("n_nationkey", F.col("r_name").alias("region"))
        )
        monthly = (
            self.raw("orders")
            .select("o_custkey", "o_orderdate", "o_totalprice")
            .join(
                self.raw("customer").select("c_custkey", "c_nationkey"),
                F.col("o_custkey") == F.col("c_custkey"),
            )
            .join(region, F.col("c_nationkey") == F.col("n_nationkey"))
            .groupBy(
                F.expr("cast(date_trunc('month', o_orderdate) as date)").alias("month"), "region"
            )
            .agg(F.avg("o_totalprice").alias("level"))
        )
        w = Window.partitionBy("region").orderBy("month")
        return monthly.select(
            "month",
            F.expr(
                """case region when 'EUROPE' then 'core_excess' when 'AMERICA' then 'market'
                   when 'ASIA' then 'value' when 'AFRICA' then 'quality'
                   else 'composite' end"""
            ).alias("factor"),
            (0.1 * (F.col("level") / F.lag("level").over(w) - 1)).alias("ret"),
        ).filter("ret is not null")

    # ------------------------------------------------------------------ futures

    @cached_property
    def chain(self) -> DataFrame:
        """Four markets, quarterly contracts; the next quarter trades beside the front."""
        tick = self.raw("lineitem").selectExpr(
            "concat('M', cast(l_suppkey % 4 as string)) as market",
            "cast(l_shipdate as date) as session",
            "l_quantity",
            "l_tax",
            f"{RAW_PRICE} as px",
            f"{ROW_KEY} as k",
            "date_trunc('quarter', l_shipdate) as q0",
        )
        legs = tick.selectExpr(
            "market",
            "session",
            "k",
            """explode(array(
                 named_struct('step', 0, 'px', px,
                   'volume', l_quantity * datediff(cast(q0 + interval 3 months as date), session)),
                 named_struct('step', 1, 'px', px * 1.01D + 1D,
                   'volume', l_quantity * (0.5D + 10D * l_tax)
                     * (92 - datediff(cast(q0 + interval 3 months as date), session)))
               )) as leg""",
            "q0",
        ).selectExpr(
            "market",
            "session",
            "k",
            "leg.px as px",
            "leg.volume as volume",
            "cast(q0 + make_interval(0, 3 * leg.step) as date) as quarter",
        )
        return legs.groupBy(
            "market",
            F.expr(
                "concat(market, '-', cast(year(quarter) as string), 'Q',"
                " cast(quarter(quarter) as string))"
            ).alias("contract"),
            "session",
            F.expr("date_sub(add_months(quarter, 3), 1)").alias("last_trade"),
        ).agg(
            F.min_by("px", "k").alias("open"),
            F.max("px").alias("high"),
            F.min("px").alias("low"),
            F.max_by("px", "k").alias("close"),
            F.sum("volume").alias("volume"),
            F.lit(50.0).alias("multiplier"),
        )


_KNOWN: dict[tuple[str, int, str], Tables] = {}


def tables_for(spark: SparkSession, folder: str) -> Tables:
    """The tables of one folder, derived once per session: queries of a session share the
    written bar and session tables the way they would share a store."""
    key = (spark.sparkContext.applicationId, id(spark), folder)
    if key not in _KNOWN:
        _KNOWN[key] = Tables(spark, folder)
    return _KNOWN[key]
