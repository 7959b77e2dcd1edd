"""Trading calendars and decision schedules.

A calendar is a dimension with one row per session and a dense ``seq``; its size is bounded
by the number of days in history, so the unpartitioned windows below stay tiny at any scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from quantframe.operators.decisions import at_decisions


def _one() -> WindowSpec:
    """The calendar is one group by construction; the constant key keeps that explicit."""
    return Window.partitionBy(F.lit(0))


def number_sessions(days: DataFrame) -> DataFrame:
    """Dense zero-based numbering of distinct session dates."""
    return days.select(
        "session", (F.row_number().over(_one().orderBy("session")) - 1).alias("seq")
    )


def exchange_sessions(
    traded: DataFrame, holidays: DataFrame | None = None, *, open_hour: int = 14, close_hour: int = 21
) -> DataFrame:
    """Weekday sessions with open and close instants, minus an optional holiday table."""
    days = traded.select("session").distinct().filter("weekday(session) < 5")
    if holidays is not None:
        days = days.join(holidays.select("session"), "session", "left_anti")
    stamp = F.col("session").cast("timestamp")
    return number_sessions(days).select(
        "session",
        "seq",
        (stamp + F.make_interval(hours=F.lit(open_hour))).alias("open_ts"),
        (stamp + F.make_interval(hours=F.lit(close_hour))).alias("close_ts"),
    )


def continuous_sessions(bounds: DataFrame, first: str = "first", last: str = "last") -> DataFrame:
    """Every calendar day between the bounds; each closes a microsecond before midnight."""
    days = bounds.select(F.explode(F.sequence(F.col(first), F.col(last))).alias("session"))
    stamp = F.col("session").cast("timestamp")
    return days.select(
        "session",
        stamp.alias("open_ts"),
        (
            stamp + F.expr("interval 23 hours 59 minutes 59.999999 seconds")
        ).alias("close_ts"),
    )


def neighbours(calendar: DataFrame) -> DataFrame:
    """Each session with the sessions on either side of it."""
    w = _one().orderBy("session")
    return calendar.select(
        "session",
        F.lag("session").over(w).alias("previous_session"),
        F.lead("session").over(w).alias("next_session"),
    )


def is_session(days: DataFrame, calendar: DataFrame, day: str = "day") -> DataFrame:
    marks = calendar.select(F.col("session").alias(day), F.lit(True).alias("__open"))
    return days.join(marks, day, "left").select(
        day, F.coalesce("__open", F.lit(False)).alias("is_session")
    )


def month_ends(calendar: DataFrame) -> DataFrame:
    """Last session of each completed month; the newest, still open month is left out."""
    following = F.lead("session").over(_one().orderBy("session"))
    flagged = calendar.select("session", "seq", following.alias("__next"))
    return flagged.filter(F.trunc("__next", "MM") != F.trunc("session", "MM")).select(
        "session", "seq"
    )


def monthly_offset(calendar: DataFrame, offset: int = 0) -> DataFrame:
    """The session ``offset`` sessions before each month end."""
    if offset < 0:
        raise ValueError("offset must not be negative")
    if offset == 0:
        return month_ends(calendar)
    wanted = month_ends(calendar).select((F.col("seq") - offset).alias("seq"))
    return calendar.select("session", "seq").join(wanted, "seq", "left_semi").select(
        "session", "seq"
    )


def monthly_offsets(calendar: DataFrame, offsets: Sequence[int]) -> DataFrame:
    """Several monthly schedules at once, tagged with their offset."""
    shifted = month_ends(calendar).select(
        F.explode(F.array(*[F.lit(o) for o in offsets])).alias("offset"), "seq"
    ).select("offset", (F.col("seq") - F.col("offset")).alias("seq"))
    return shifted.join(calendar.select("session", "seq"), "seq").select(
        "offset", "session", "seq"
    )


def weekly(calendar: DataFrame, weekday: int = 4) -> DataFrame:
    """The chosen weekday (Monday is 0), or the last session before it when it is closed.

    A session fires when the weekday falls in ``[session, next_session)``. The newest
    session has no known successor and fires only on the weekday itself.
    """
    nxt = F.lead("session").over(_one().orderBy("session"))
    wait = F.pmod(F.lit(weekday) - F.weekday("session"), F.lit(7))
    hit = F.date_add("session", wait)
    return (
        calendar.select("session", nxt.alias("__next"), hit.alias("__hit"))
        .filter((F.col("__hit") == F.col("session")) | (F.col("__hit") < F.col("__next")))
        .select("session")
    )


def iso_week_last(calendar: DataFrame, weekday: int = 4) -> DataFrame:
    """Last session of each ISO week that falls on or before the weekday."""
    return (
        calendar.filter(F.weekday("session") <= weekday)
        .groupBy(F.date_trunc("week", "session").cast("date").alias("week"))
        .agg(F.max("session").alias("session"))
    )


def daily(calendar: DataFrame) -> DataFrame:
    return calendar.select("session")


def once(decidable: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """First session on which a decision exists; warm-up sessions do not spend the firing."""
    return decidable.groupBy(*keys).agg(F.min("session").alias("session"))


def any_of(*schedules: DataFrame) -> DataFrame:
    """Union of decision dates."""
    out = schedules[0].select("session")
    for other in schedules[1:]:
        out = out.unionByName(other.select("session"))
    return out.distinct()


def stamp_at_session_close(
    bars: DataFrame, instruments: DataFrame, exchange: DataFrame, continuous: DataFrame
) -> DataFrame:
    """Restamp bars to the instant their session closes; bars on non-sessions drop out."""
    closes = exchange.select(
        F.lit(False).alias("trades_continuously"), "session", "close_ts"
    ).unionByName(
        continuous.select(F.lit(True).alias("trades_continuously"), "session", "close_ts")
    )
    kind = instruments.select("symbol", "trades_continuously")
    return (
        bars.join(kind, "symbol")
        .join(closes, ["trades_continuously", "session"])
        .select(*bars.columns, F.col("close_ts").alias("ts"))
    )


def staleness(
    newest: DataFrame, calendar: DataFrame, now: Column | None = None, tolerance: int = 3
) -> DataFrame:
    """Sessions between the newest stored row and ``now`` (the calendar's last session if not
    given), and whether that is acceptable. One row meets the calendar."""
    today = calendar.agg(F.max("session").alias("today")) if now is None else None
    late = newest.agg(F.max("session").alias("newest"))
    late = late.withColumn("today", now) if today is None else late.crossJoin(today)
    return (
        late.join(
            calendar.select("session"),
            F.col("session").between(F.col("newest"), F.col("today")),
            "left",
        )
        .groupBy("newest", "today")
        .agg(F.greatest(F.count("session") - 1, F.lit(0)).alias("behind"))
        .withColumn("fresh", F.col("behind") <= tolerance)
    )


def shift_months(day: Column, months: Column | int) -> Column:
    """Move by whole months with the day clamped to the 28th."""
    first = F.add_months(F.trunc(day, "MM"), months)
    return F.date_add(first, F.least(F.dayofmonth(day), F.lit(28)) - 1)


def start_date_grid(bounds: DataFrame, step: int = 18) -> DataFrame:
    """Start dates every ``step`` months, each leaving at least three years and at most ten
    years after the first one. ``bounds`` carries ``first`` and ``last``."""
    horizon = F.least(shift_months(F.col("first"), 120), shift_months(F.col("last"), -36))
    later = (
        bounds.select("first", horizon.alias("__h"), F.explode(F.sequence(F.lit(1), F.lit(120 // step + 1))).alias("n"))
        .select("first", "__h", "n", shift_months(F.col("first"), F.col("n") * step).alias("session"))
        .filter("session <= __h")
        .select("n", "session")
    )
    return bounds.select(F.lit(0).alias("n"), F.col("first").alias("session")).unionByName(later)


def exchange_local_to_utc(
    text: Column | str, pattern: str = "yyyy-MM-dd, HH:mm:ss", zone: str = "America/New_York"
) -> Column:
    """Parse an exchange-local wall-clock stamp and return the UTC wall clock."""
    local = F.to_timestamp_ntz(F.col(text) if isinstance(text, str) else text, F.lit(pattern))
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local)


def investable(instruments: DataFrame, days: DataFrame, day: str = "session") -> DataFrame:
    """Instruments admitted by each day: the admission date is unset or already reached."""
    listed = days.select(F.col(day).alias("as_of")).distinct()
    admitted = instruments.select("symbol", F.coalesce("available_from", F.lit("0001-01-01").cast("date")).alias("__from"))
    return at_decisions(admitted, listed, day="__from").select(F.col("as_of").alias(day), "symbol")


def business_days_before(day: Column | str, n: int | Column) -> Column:
    """``n`` weekdays before ``day``; a weekend day first steps back to Friday, as one step."""
    d = F.col(day) if isinstance(day, str) else day
    count = n if isinstance(n, Column) else F.lit(n)
    wd = F.weekday(d)
    base = F.when(wd > 4, F.date_sub(d, wd - 4)).otherwise(d)
    left = F.when(wd > 4, F.greatest(count - 1, F.lit(0))).otherwise(count)
    bd = F.least(wd, F.lit(4))
    rem = left % 5
    days = F.floor(left / 5).cast("int") * 7 + rem + F.when(rem > bd, 2).otherwise(0)
    return F.date_sub(base, days.cast("int"))
