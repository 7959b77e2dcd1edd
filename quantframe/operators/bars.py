"""Bar-store operators: validated point-in-time scans, merges and coverage.

A symbol has at most one bar per session, so per-symbol windows are bounded by the calendar.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.operators.decisions import at_decisions

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def close_instant(session: Column | str, hour: int = 21) -> Column:
    s = F.col(session) if isinstance(session, str) else session
    return s.cast("timestamp") + F.make_interval(hours=F.lit(hour))


def read_bars(
    bars: DataFrame,
    *,
    symbol: str | None = None,
    start: date | None = None,
    end: date | None = None,
    as_of: date | datetime | None = None,
) -> DataFrame:
    """Bounded scan. A bare date as ``as_of`` means the end of that day.

    All bounds are literal predicates on stored columns, so they reach the file scan.
    """
    out = bars
    if symbol is not None:
        out = out.filter(F.col("symbol") == symbol)
    if start is not None:
        out = out.filter(F.col("session") >= F.lit(start))
    if end is not None:
        out = out.filter(F.col("session") <= F.lit(end))
    if isinstance(as_of, datetime):
        out = out.filter(F.col("ts") <= F.lit(as_of))
    elif as_of is not None:
        out = out.filter(F.col("session") <= F.lit(as_of))
    return out


def upsert_bars(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Merge two histories; the new row wins on ``(symbol, session)``, among equally new rows
    the one that sorts last by its columns.

    One hash aggregate keyed by row identity: a hot symbol spreads over its sessions.
    """
    cols = [c for c in stored.columns if c not in ("symbol", "session")]
    tagged = stored.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return (
        tagged.groupBy("symbol", "session")
        .agg(F.max(F.struct("__batch", *cols)).alias("__bar"))
        .select("symbol", "session", *[F.col(f"__bar.{c}").alias(c) for c in cols])
    )


def schema_violations(bars: DataFrame) -> DataFrame:
    """Missing columns (checked against the schema) and duplicate keys (checked on rows)."""
    missing = [c for c in ("symbol", "session", *BAR_COLUMNS) if c not in bars.columns]
    if missing:
        raise ValueError(f"bars are missing columns {missing}")
    return (
        bars.groupBy("symbol", "session")
        .agg(F.count("*").alias("copies"))
        .filter("copies > 1")
    )


def bar_reason(precision: int = 8) -> Column:
    """Why a bar is impossible, or null. Prices are compared after rounding, so float noise
    from price adjustment does not count as a violation."""
    o, h, low, c = (F.round(F.col(x), precision) for x in ("open", "high", "low", "close"))
    return (
        F.when(F.least(o, h, low, c) <= 0, "non-positive price")
        .when(low > h, "low above high")
        .when((o < low) | (o > h), "open outside range")
        .when((c < low) | (c > h), "close outside range")
        .when(F.col("volume") < 0, "negative volume")
    )


def validate_bar_rows(bars: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted bars and the quarantine with its reason."""
    judged = bars.withColumn("reason", bar_reason())
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def coverage(bars: DataFrame) -> DataFrame:
    return bars.groupBy("symbol").agg(
        F.min("session").alias("first"),
        F.max("session").alias("last"),
        F.count("*").alias("rows"),
        (F.datediff(F.max("session"), F.min("session")) / 365.25).alias("span_years"),
    )


def close_panel(bars: DataFrame, symbols: list[str], as_of: date | None = None) -> DataFrame:
    """Wide closes on the union of dates; days without a print stay null."""
    return (
        read_bars(bars, as_of=as_of)
        .groupBy("session")
        .pivot("symbol", symbols)
        .agg(F.first("close"))
    )


def normalise_vendor_bars(raw: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Lower-case names, keep the last duplicate, drop rows without prices, and split off
    rows with a non-positive price."""
    low = raw.toDF(*[c.lower() for c in raw.columns])
    order = order.lower()
    keys = ("symbol", "session")
    packed = [c for c in low.columns if c not in (*keys, order)]
    last = (
        low.groupBy(*keys)
        .agg(F.max_by(F.struct(*packed), order).alias("__row"))
        .select(*keys, "__row.*")
        .dropna(subset=["open", "high", "low", "close"])
    )
    positive = F.least("open", "high", "low", "close") > 0
    return last.filter(positive), last.filter(~positive)


def incremental_window(
    dimension: DataFrame, stored: DataFrame, start: date, overlap: int = 7
) -> DataFrame:
    """Where each symbol's refetch begins. Symbols without history start at ``start``."""
    last = stored.groupBy("symbol").agg(F.max("session").alias("last"))
    return dimension.select("symbol").join(last, "symbol", "left").select(
        "symbol",
        "last",
        F.greatest(F.lit(start), F.date_sub("last", overlap)).alias("fetch_start"),
    )


def history(bars: DataFrame, as_of: date, count: int) -> DataFrame:
    """The last ``count`` bars of every symbol at or before the cutoff."""
    w = Window.partitionBy("symbol").orderBy(F.col("session").desc())
    return (
        bars.filter(F.col("session") <= F.lit(as_of))
        .withColumn("__n", F.row_number().over(w))
        .filter(F.col("__n") <= count)
        .drop("__n")
    )


def latest_closes(bars: DataFrame, as_of: date) -> DataFrame:
    """Last known close per symbol; symbols without history are absent."""
    return (
        bars.filter(F.col("session") <= F.lit(as_of))
        .groupBy("symbol")
        .agg(F.max("session").alias("session"), F.max_by("close", "session").alias("close"))
    )


def first_sessions(bars: DataFrame, need: int) -> DataFrame:
    """First session and the first session with ``need`` bars of history."""
    w = Window.partitionBy("symbol").orderBy("session")
    numbered = bars.select("symbol", "session", F.row_number().over(w).alias("n"))
    return numbered.groupBy("symbol").agg(
        F.min("session").alias("first_session"),
        F.min(F.when(F.col("n") >= need, F.col("session"))).alias("ready_session"),
    )


def average_volume(bars: DataFrame, window: int = 20) -> DataFrame:
    """Mean volume over the sessions strictly before each bar."""
    w = Window.partitionBy("symbol").orderBy("session").rowsBetween(-window, -1)
    return bars.withColumn("adv", F.avg("volume").over(w))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def filled_panel(bars: DataFrame, calendar: DataFrame) -> DataFrame:
    """One row per symbol and session from its first bar on, with last-known prices.

    ``open`` is the session's own open where the symbol traded, otherwise the last close.
    """
    known = at_decisions(
        bars.select("symbol", "session", "open", "close"),
        calendar.select(F.col("session").alias("as_of")),
        days=bars,
    )
    return known.select(
        "symbol",
        F.col("as_of").alias("session"),
        "close",
        F.when(F.col("session") == F.col("as_of"), F.col("open"))
        .otherwise(F.col("close"))
        .alias("open"),
    )
