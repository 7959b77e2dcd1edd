"""Incremental versions of the live-record operators.

Every job reads a file stream, keeps a checkpointed cursor and runs with ``availableNow``, so a
late restart picks up exactly where the last run stopped. State lives in levelled tables (see
``tables``): a micro-batch writes what it adds and reads only the state of the keys or days that
it touches. No watermark closes anything, so late rows count like any other.

A batch is never cached: its partitions are as large as the source's files make them, and a task
reads a cached partition whole. What is read more than once is read back from written files.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quantframe.operators import ledger, live
from quantframe.session import shared_at
from quantframe.streaming.tables import (
    LevelledTable,
    distinct,
    hash_bucket,
    newest,
    run_available,
    summed,
    together,
)


def file_stream(
    spark: SparkSession, folder: str, name: str, schema: Any, *, files_per_batch: int = 100
) -> DataFrame:
    """Parquet files called ``name`` arriving in ``folder``."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


# ---------------------------------------------------------------- bars


BAR_SCHEMA = (
    "symbol string, session date, open double, high double, low double, close double, volume double"
)


def run_bars(bars: DataFrame, folder: str) -> DataFrame:
    """The newest version of every bar that a stream of additions and restatements brought."""
    keys = ["symbol", "session"]
    table = LevelledTable(bars.sparkSession, f"{folder}/bars", BAR_SCHEMA, newest(*keys))
    run_available(bars.writeStream.foreachBatch(table.write), f"{folder}/checkpoint")
    return table.rows().drop("batch")


# ---------------------------------------------------------------- collapse


PART_SCHEMA = (
    "portfolio string, session date, symbol string, buying boolean, quantity double,"
    " size double, value double, commission double, pieces bigint"
)
INTENTION = ("portfolio", "session", "symbol", "buying")


def collapse_parts(fills: DataFrame) -> DataFrame:
    """Sums of one micro-batch per day, symbol and direction; parts of a day add up."""
    size = F.abs("quantity")
    return (
        fills.withColumn("buying", F.col("quantity") > 0)
        .groupBy("portfolio", F.to_date("ts").alias("session"), "symbol", "buying")
        .agg(
            F.sum("quantity").alias("quantity"),
            F.sum(size).alias("size"),
            F.sum(size * F.col("price")).alias("value"),
            F.sum("commission").alias("commission"),
            F.count(F.lit(1)).alias("pieces"),
        )
    )


def run_collapse(fills: DataFrame, folder: str) -> DataFrame:
    """One intention per day, symbol and direction, whenever its fills arrive.

    The stored parts are the state and add up, so a fill that comes weeks late adds its part
    like any other, no batch reads what others stored, and the result does not depend on where
    batches are cut.
    """
    table = LevelledTable(
        fills.sparkSession, f"{folder}/intentions", PART_SCHEMA, summed(*INTENTION)
    )
    writer = fills.writeStream.foreachBatch(
        lambda df, batch: table.write(collapse_parts(df), batch)
    )
    run_available(writer, f"{folder}/checkpoint")
    return table.rows().select(
        *INTENTION,
        "quantity",
        (F.col("value") / F.col("size")).alias("price"),
        "commission",
        "pieces",
    )


# ---------------------------------------------------------------- executions


EXECUTION_SCHEMA = (
    "execution_id decimal(38,0), order_id string, symbol string, ts timestamp, quantity double,"
    " price double, commission double, slippage double"
)
PAYLOAD = ("order_id", "symbol", "ts", "quantity", "price", "commission", "slippage")


def run_ingest(executions: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(executions archived once, every payload of the ids that came with more than one).

    A repeat with the same payload changes nothing. An id with two payloads leaves the archive
    and all its payloads stand in the second table, for a person to settle. Both follow from
    the set of rows that ever came, and sets unite: a batch stores its distinct rows, repeats
    across batches go when levels merge, and none joins the archive.
    """
    archive = LevelledTable(executions.sparkSession, f"{folder}/archive", EXECUTION_SCHEMA, distinct)
    columns = ["execution_id", *PAYLOAD]

    def ingest(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select(F.col("execution_id").cast("decimal(38,0)"), *PAYLOAD)
        archive.write(arrived.distinct(), batch_id)

    run_available(executions.writeStream.foreachBatch(ingest), f"{folder}/checkpoint")
    kept = archive.rows().select(*columns)
    payloads = kept.groupBy("execution_id").agg(F.count(F.lit(1)).alias("payloads"))
    disputed = payloads.filter("payloads > 1")
    return (
        kept.join(disputed, "execution_id", "left_anti"),
        kept.join(disputed, "execution_id").withColumn("verdict", F.lit("conflict")),
    )


# ---------------------------------------------------------------- positions


POSITION_SCHEMA = (
    "portfolio string, symbol string, quantity double, avg_cost double, realized double,"
    " commission double, fills bigint"
)


def advance_positions(state: DataFrame, fills: DataFrame) -> DataFrame:
    """Positions after a batch of fills.

    The stored position enters as an opening fill at its average cost ahead of the batch, so
    the distributed average-cost fold does the rest and no key is walked in one task.
    """
    batch = fills.select(
        "portfolio", "symbol", "session", "ts", "execution_id", "quantity", "price", "commission"
    )
    touched = state.join(fills.select("portfolio", "symbol"), ["portfolio", "symbol"], "left_semi")
    start = F.lit("0001-01-01")
    opening = touched.filter("quantity <> 0").select(
        "portfolio",
        "symbol",
        start.cast("date").alias("session"),
        start.cast("timestamp").alias("ts"),
        F.lit(-1).cast("decimal(38,0)").alias("execution_id"),
        "quantity",
        F.col("avg_cost").alias("price"),
        F.lit(0.0).alias("commission"),
    )
    moved = ledger.positions(opening.unionByName(batch))
    before = touched.select(
        "portfolio",
        "symbol",
        F.col("realized").alias("__r"),
        F.col("commission").alias("__c"),
        F.col("fills").alias("__f"),
        (F.col("quantity") != 0).cast("int").alias("__o"),
    )
    zero = F.lit(0)
    return moved.join(before, ["portfolio", "symbol"], "left").select(
        "portfolio",
        "symbol",
        "quantity",
        "avg_cost",
        (F.col("realized") + F.coalesce("__r", zero)).alias("realized"),
        (F.col("commission") + F.coalesce("__c", zero)).alias("commission"),
        (F.col("fills") + F.coalesce("__f", zero) - F.coalesce("__o", zero)).alias("fills"),
    )


def run_positions(fills: DataFrame, folder: str) -> DataFrame:
    """Positions kept current as fills arrive in their order.

    The state is one row a position, found by its bucket. A batch's fills compose with it as
    maps of the cost basis (see ``ledger.positions``), so a hot position spreads over tasks.
    """
    keys = ["portfolio", "symbol"]
    table = LevelledTable(
        fills.sparkSession,
        f"{folder}/positions",
        POSITION_SCHEMA,
        newest(*keys),
        bucket=hash_bucket(*keys),
    )

    def advance(batch: DataFrame, batch_id: int) -> None:
        came, discard = shared_at(batch, "batch")
        state = table.rows_of(came.select(*keys), batch_id)
        table.write(advance_positions(state, came), batch_id)
        discard()

    run_available(fills.writeStream.foreachBatch(advance), f"{folder}/checkpoint")
    return table.rows()


# ---------------------------------------------------------------- session marks


MARK_SCHEMA = "portfolio string, session date, fills bigint, traded double, net_cash double"


def run_session_marks(fills: DataFrame, folder: str) -> DataFrame:
    """Per-session totals kept current as fills arrive.

    Totals add up, so a late fill adds to its old session and no mark is read to be changed.
    """
    keys = ["portfolio", "session"]
    table = LevelledTable(fills.sparkSession, f"{folder}/marks", MARK_SCHEMA, summed(*keys))

    def mark(batch: DataFrame, batch_id: int) -> None:
        value = F.col("quantity") * F.col("price")
        table.write(
            batch.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("fills"),
                F.sum(F.abs(value)).alias("traded"),
                F.sum(-value - F.col("commission")).alias("net_cash"),
            ),
            batch_id,
        )

    run_available(fills.writeStream.foreachBatch(mark), f"{folder}/checkpoint")
    return table.rows()


# ---------------------------------------------------------------- matching


ORDER_SCHEMA = "symbol string, quantity double, order_id string, created_at timestamp, block int"
TRADE_SCHEMA = "symbol string, quantity double, trade_id {kind}, ts timestamp, block int"
#: Days of a match, and of a block; a block reaches over two matches. Files hold several blocks.
MATCH_DAYS, BLOCK_DAYS, FILE_BLOCKS = 4, 16, 4
#: The day of a row without an instant; it matches nothing and is kept.
NO_DAY = -1_000_000


def _block(day: Column) -> Column:
    return F.floor(day / BLOCK_DAYS).cast("int")


def _file(block: Column) -> Column:
    return F.floor(block / FILE_BLOCKS).cast("int")


def _day(when: Column) -> Column:
    return F.coalesce(F.unix_date(F.to_date(when)), F.lit(NO_DAY))


def _around(when: str) -> Column:
    """The blocks within a match of an instant."""
    day = _day(F.col(when))
    return F.array_distinct(F.array(_block(day - MATCH_DAYS), _block(day), _block(day + MATCH_DAYS)))


def _at(rows: DataFrame, places: DataFrame) -> DataFrame:
    same = F.expr("r.symbol <=> p.symbol and r.quantity <=> p.quantity and r.block = p.block")
    return rows.alias("r").join(places.alias("p"), same, "left_semi")


def run_match(orders: DataFrame, trades: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders matched to trades, unique both ways, whenever either side arrives.

    Returns (one row per trade, one row per order), both with ``trade_id, order_id, candidates,
    status``, as the batch operator has them for all rows that ever came.

    Whether a row matches depends on rows of its symbol and quantity within the window and on
    their windows. A batch therefore stores its rows and judges anew the blocks of days within
    a window of them: a sweep over those blocks and their neighbours - counts only, no pairs -
    replaces the verdicts there. Neither late rows nor the place of a cut change the result.
    """
    spark = orders.sparkSession
    kind = trades.schema["trade_id"].dataType.simpleString()
    at = _file(F.col("block"))
    stored = {
        "order": LevelledTable(spark, f"{folder}/orders", ORDER_SCHEMA, together, bucket=at),
        "trade": LevelledTable(
            spark, f"{folder}/trades", TRADE_SCHEMA.format(kind=kind), together, bucket=at
        ),
    }
    verdict = "candidates bigint, status string"
    results = {
        "order": LevelledTable(
            spark, f"{folder}/order-verdicts", f"order_id string, trade_id {kind}, {verdict}", newest("order_id")
        ),
        "trade": LevelledTable(
            spark, f"{folder}/trade-verdicts", f"trade_id {kind}, order_id string, {verdict}", newest("trade_id")
        ),
    }
    none = F.lit(None)
    both = orders.select(
        "symbol", F.col("quantity").cast("double"), F.col("order_id").cast("string"), "created_at",
        none.cast(kind).alias("trade_id"), none.cast("timestamp").alias("ts"),
        F.lit("order").alias("side"),
    ).unionByName(
        trades.select(
            "symbol", F.col("quantity").cast("double"), none.cast("string").alias("order_id"),
            none.cast("timestamp").alias("created_at"), "trade_id", "ts",
            F.lit("trade").alias("side"),
        )
    )
    day = _day(F.coalesce("created_at", "ts"))

    def match(batch: DataFrame, batch_id: int) -> None:
        # Each side is read once and dealt out; what came is read back from its segment.
        for side, table in stored.items():
            own = batch.filter(F.col("side") == side).withColumn("block", _block(day))
            table.write(own, batch_id)
        came = [
            stored[side]
            .of_batch(batch_id)
            .select("symbol", "quantity", F.explode(_around(when)).alias("block"))
            for side, when in (("order", "created_at"), ("trade", "ts"))
        ]
        stale = came[0].unionByName(came[1]).distinct().persist()
        beside = F.explode(F.sequence(F.col("block") - 1, F.col("block") + 1))
        near = stale.select("symbol", "quantity", beside.alias("block")).distinct().persist()
        files = [r[0] for r in near.select(at).distinct().collect()]
        o, t = (_at(stored[s].rows(batch_id + 1, files), near) for s in ("order", "trade"))
        counts = live.interval_counts(o, t, window=f"{MATCH_DAYS} days").persist()
        results["trade"].write(live.matched_trades(counts, o, _at(t, stale)), batch_id)
        results["order"].write(live.matched_orders(counts, _at(o, stale), t), batch_id)
        for held in (counts, near, stale):
            held.unpersist()

    run_available(both.writeStream.foreachBatch(match), f"{folder}/checkpoint")
    return results["trade"].rows().drop("batch"), results["order"].rows().drop("batch")


# ---------------------------------------------------------------- failure watch


STREAK_SCHEMA = "user_id bigint, event_id bigint, failed boolean, streak bigint, event string"
CARRY_SCHEMA = "user_id bigint, streak bigint"


def run_streaks(events: DataFrame, failed: Column, folder: str, *, threshold: int = 3) -> DataFrame:
    """Alert on the third consecutive failure, once per outage, and on recovery.

    Events arrive in their order. The state is one number a user: how many failures the
    latest run has so far. A batch is scanned in hour blocks, so a user with a third of all events
    spreads over tasks, and the stored run counts until the first success in the batch.
    """
    spark = events.sparkSession
    out = LevelledTable(spark, f"{folder}/streaks", STREAK_SCHEMA, together)
    carry = LevelledTable(
        spark, f"{folder}/carry", CARRY_SCHEMA, newest("user_id"), bucket=hash_bucket("user_id")
    )
    watched = events.select("user_id", "ts", "event_id", failed.alias("failed"))

    def watch(batch: DataFrame, batch_id: int) -> None:
        came, discard = shared_at(batch, "batch")
        held = carry.rows_of(came.select("user_id"), batch_id).select("user_id", "streak")
        judged = live.failure_streaks(
            came, "user_id", "ts", F.col("failed"), "event_id",
            threshold=threshold, block=F.date_trunc("hour", "ts"), carried=held,
        ).persist()
        out.write(judged, batch_id)
        last = F.max_by("streak", F.struct("ts", "event_id")).alias("streak")
        carry.write(judged.groupBy("user_id").agg(last), batch_id)
        judged.unpersist()
        discard()

    run_available(watched.writeStream.foreachBatch(watch), f"{folder}/checkpoint")
    return out.rows().drop("batch")
