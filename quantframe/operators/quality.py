"""Data-quality checks: each returns issue rows ``symbol, severity, kind, detail``."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MIN_SESSIONS = 260
JUMP = 0.25
SEVERITIES = ("info", "warn", "error")


def by_symbol() -> WindowSpec:
    return Window.partitionBy("symbol").orderBy("session")


def history_issues(dims: DataFrame, bars: DataFrame, need: int = MIN_SESSIONS) -> DataFrame:
    """Symbols without bars, and symbols with too few for a twelve-month signal."""
    counts = bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"))
    return (
        dims.select("symbol")
        .join(counts, "symbol", "left")
        .fillna(0, ["rows"])
        .filter(F.col("rows") < need)
        .select(
            "symbol",
            F.when(F.col("rows") == 0, "error").otherwise("warn").alias("severity"),
            F.when(F.col("rows") == 0, "empty").otherwise("short-history").alias("kind"),
            F.concat(F.col("rows").cast("string"), F.lit(" sessions")).alias("detail"),
        )
    )


def missing_sessions(
    bars: DataFrame, calendar: DataFrame, dims: DataFrame | None = None
) -> DataFrame:
    """Expected sessions between a symbol's first and last bar that have no bar.

    Round-the-clock symbols are held to every calendar day. The expectation is expanded from
    each symbol's own span, so no universe-by-calendar product is formed.
    """
    span = bars.groupBy("symbol").agg(F.min("session").alias("a"), F.max("session").alias("z"))
    if dims is not None:
        span = span.join(dims.select("symbol", "trades_continuously"), "symbol")
    else:
        span = span.withColumn("trades_continuously", F.lit(False))
    days = span.select(
        "symbol", "trades_continuously", F.explode(F.sequence("a", "z")).alias("session")
    )
    marks = calendar.select("session", F.lit(True).alias("__open"))
    expected = days.join(marks, "session", "left").filter("trades_continuously or __open")
    return expected.join(bars.select("symbol", "session"), ["symbol", "session"], "left_anti").select(
        "symbol", "session"
    )


def missing_issues(missing: DataFrame) -> DataFrame:
    """Count and first five missing sessions; more than five is an error."""
    w = Window.partitionBy("symbol").orderBy("session")
    ranked = missing.withColumn("__r", F.row_number().over(w))
    shown = F.array_sort(F.collect_list(F.when(F.col("__r") <= 5, F.col("session").cast("string"))))
    n = F.count(F.lit(1))
    more = F.when(n > 5, F.concat(F.lit(" (+"), (n - 5).cast("string"), F.lit(" more)"))).otherwise("")
    return ranked.groupBy("symbol").agg(
        F.when(n > 5, "error").otherwise("warn").alias("severity"),
        F.lit("missing-sessions").alias("kind"),
        F.concat(n.cast("string"), F.lit(" absent: "), F.array_join(shown, ", "), more).alias("detail"),
        n.alias("missing"),
    )


def price_jumps(bars: DataFrame, threshold: float = JUMP) -> DataFrame:
    """Moves beyond the threshold, the largest one and the first day it happened."""
    move = F.col("close") / F.nullif(F.lag("close").over(by_symbol()), F.lit(0.0)) - 1
    big = bars.select("symbol", "session", move.alias("m")).filter(F.abs("m") > threshold)
    worst = F.max(F.struct(F.abs("m").alias("k"), (-F.unix_date("session")).alias("d"), "m", "session"))
    return big.groupBy("symbol").agg(F.count(F.lit(1)).alias("moves"), worst.alias("w")).select(
        "symbol",
        F.lit("warn").alias("severity"),
        F.lit("price-jump").alias("kind"),
        F.concat(F.col("moves").cast("string"), F.lit(" moves, largest on "), F.col("w.session").cast("string")).alias("detail"),
        "moves",
        F.col("w.m").alias("largest"),
        F.col("w.session").alias("session"),
    )


def flatlines(bars: DataFrame, longest: int = 5) -> DataFrame:
    """Longest run of unchanged closes, when it reaches ``longest``."""
    same = F.col("close") == F.lag("close").over(by_symbol())
    upto = by_symbol().rowsBetween(Window.unboundedPreceding, 0)
    runs = (
        bars.select("symbol", "session", F.coalesce(same, F.lit(False)).alias("same"))
        .withColumn("island", F.sum((~F.col("same")).cast("int")).over(upto))
        .groupBy("symbol", "island")
        .agg(F.sum(F.col("same").cast("int")).alias("run"))
    )
    return (
        runs.groupBy("symbol")
        .agg(F.max("run").alias("longest"))
        .filter(F.col("longest") >= longest)
        .select(
            "symbol",
            F.lit("warn").alias("severity"),
            F.lit("flatline").alias("kind"),
            F.concat(F.col("longest").cast("string"), F.lit(" unchanged closes")).alias("detail"),
            "longest",
        )
    )


def zero_volume(bars: DataFrame, share: float = 0.01) -> DataFrame:
    """Sessions that could not be traded; more than one percent of them is a warning."""
    zeros = F.sum((F.col("volume") == 0).cast("int"))
    return (
        bars.groupBy("symbol")
        .agg(zeros.alias("zeros"), F.count(F.lit(1)).alias("n"))
        .filter("zeros > 0")
        .select(
            "symbol",
            F.when(F.col("zeros") > F.col("n") * share, "warn").otherwise("info").alias("severity"),
            F.lit("zero-volume").alias("kind"),
            F.concat(F.col("zeros").cast("string"), F.lit(" sessions without volume")).alias("detail"),
            "zeros",
        )
    )


def check_bars(
    dims: DataFrame, bars: DataFrame, calendar: DataFrame, *, jump: float = JUMP
) -> DataFrame:
    """All checks as one issue table."""
    cols = ["symbol", "severity", "kind", "detail"]
    return (
        history_issues(dims, bars)
        .select(*cols)
        .unionByName(missing_issues(missing_sessions(bars, calendar, dims)).select(*cols))
        .unionByName(price_jumps(bars, jump).select(*cols))
        .unionByName(flatlines(bars).select(*cols))
        .unionByName(zero_volume(bars).select(*cols))
    )


def summarise(issues: DataFrame) -> DataFrame:
    """Issue counts per severity, zeros included, in one aggregate."""
    return issues.agg(
        *[F.count(F.when(F.col("severity") == s, 1)).alias(s) for s in SEVERITIES]
    ).unpivot([], list(SEVERITIES), "severity", "issues")


def research_coverage(bars: DataFrame, calendar: DataFrame, dims: DataFrame) -> DataFrame:
    """Expected, missing and invalid closes per symbol over the whole calendar."""
    have = (
        bars.join(calendar.select("session"), "session", "left_semi")
        .groupBy("symbol")
        .agg(
            F.count("close").alias("present"),
            F.sum((F.col("close") <= 0).cast("int")).alias("invalid"),
        )
    )
    total = calendar.agg(F.count(F.lit(1)).alias("expected"))
    return (
        dims.select("symbol")
        .join(have, "symbol", "left")
        .fillna(0, ["present", "invalid"])
        .join(total, F.lit(True))
        .select("symbol", "expected", (F.col("expected") - F.col("present")).alias("missing"), "invalid")
    )
