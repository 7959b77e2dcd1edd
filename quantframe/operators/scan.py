"""Running aggregates over keys of any size.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. That is fine when a key
is bounded (a symbol has at most one row per session), and wrong for facts such as fills or
events, where one portfolio or user may hold a third of all rows. ``block_scan`` splits each
key by a deterministic ``block`` column (a day or an hour), carries one summary row per block
forward, and evaluates the running aggregate inside ``(key, block)`` groups:

1. summarise each (key, block) -- partial aggregation, map side first;
2. accumulate the summaries in block order -- one row per block, bounded by the calendar;
3. add each block's carry as its first row and run the window inside the block.

The block is a function of the data, so a retried task rebuilds the same groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SUM, _MAX, _MIN, _LAST = "sum", "max", "min", "last"


def _window_agg(kind: str, col: str) -> Column:
    if kind == _SUM:
        return F.sum(col)
    if kind == _MAX:
        return F.max(col)
    if kind == _MIN:
        return F.min(col)
    return F.last(col, ignorenulls=True)


def _block_agg(kind: str, col: str, order: Sequence[str]) -> Column:
    if kind == _LAST:
        stamp = F.when(F.col(col).isNotNull(), F.struct(*order))
        return F.max_by(F.col(col), stamp)
    return _window_agg(kind, col)


def block_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: str,
    order: Sequence[str],
    outputs: Mapping[str, tuple[str, Column]],
    *,
    exclusive: bool = False,
) -> DataFrame:
    """Append running aggregates to ``df``.

    ``outputs`` maps a new column to ``(kind, value)`` with kind one of sum, max, min, last.
    ``block`` must be non-decreasing along ``order``. With ``exclusive`` the current row is
    left out of its own frame.
    """
    values = {f"__v_{name}": expr for name, (_, expr) in outputs.items()}
    rows = df.select("*", *[expr.alias(v) for v, expr in values.items()])

    totals = rows.groupBy(*keys, block).agg(
        *[
            _block_agg(kind, f"__v_{name}", order).alias(f"__v_{name}")
            for name, (kind, _) in outputs.items()
        ]
    )
    before = (
        Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        block,
        *[
            _window_agg(kind, f"__v_{name}").over(before).alias(f"__v_{name}")
            for name, (kind, _) in outputs.items()
        ],
        F.lit(0).alias("__row"),
    )
    merged = rows.withColumn("__row", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    inside = (
        Window.partitionBy(*keys, block)
        .orderBy("__row", *order)
        .rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    )
    scanned = merged.select(
        *df.columns,
        "__row",
        *[
            _window_agg(kind, f"__v_{name}").over(inside).alias(name)
            for name, (kind, _) in outputs.items()
        ],
    )
    return scanned.filter("__row = 1").drop("__row")
