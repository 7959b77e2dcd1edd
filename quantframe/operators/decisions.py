"""Reading per-symbol features as of decision dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def at_decisions(
    features: DataFrame,
    decisions: DataFrame,
    *,
    day: str = "session",
    keys: Sequence[str] = ("symbol",),
    days: DataFrame | None = None,
) -> DataFrame:
    """Each key's last feature row at or before every decision date (column ``as_of``).

    A feature row stays current until the key's next one, so it answers a contiguous run
    of decision dates. Both ends of the run come from the calendar, the run is exploded in
    place, and nothing is joined between the universe and the decision list. Rows that cover
    no decision date disappear before anything else happens to them. ``days`` may name the
    dates ``features`` can carry when they are cheaper to list from its source.
    """
    one = Window.partitionBy(F.lit(0))
    numbered = decisions.select("as_of").distinct().select(
        "as_of", F.row_number().over(one.orderBy("as_of")).alias("__j")
    )
    listed = features if days is None else days
    days = listed.select(F.col(day).alias("__day")).distinct()
    first_open = (
        days.select("__day", F.lit(None).cast("int").alias("__j"), F.lit(True).alias("__feature"))
        .unionByName(
            numbered.select(F.col("as_of").alias("__day"), "__j", F.lit(False).alias("__feature"))
        )
        .groupBy("__day")
        .agg(F.max("__j").alias("__j"), F.max("__feature").alias("__feature"))
        .select(
            "__day",
            "__feature",
            F.last("__j", ignorenulls=True)
            .over(one.orderBy(F.col("__day").desc()).rowsBetween(Window.unboundedPreceding, 0))
            .alias("__lo"),
            F.max("__j").over(one).alias("__max"),
        )
        .filter("__feature")
        .drop("__feature")
    )
    w = Window.partitionBy(*keys).orderBy(day)
    placed = features.join(first_open, features[day] == first_open["__day"]).withColumn(
        "__hi", F.coalesce(F.lead("__lo").over(w), F.col("__max") + 1)
    )
    covered = placed.filter("__lo < __hi").withColumn(
        "__j", F.explode(F.sequence(F.col("__lo"), F.col("__hi") - 1))
    )
    return covered.join(numbered, "__j").select("as_of", *features.columns)
