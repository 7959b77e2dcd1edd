"""Native column expressions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(value: Column | str | float | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def div(num: Column | str, den: Column | str | float) -> Column:
    """Division that yields null on a zero denominator (ANSI mode would raise)."""
    return _col(num) / F.nullif(_col(den), F.lit(0.0))


def safe_div(num: Column | str, den: Column | str, default: float = 0.0) -> Column:
    """Division with an explicit answer for a zero denominator."""
    return F.when(_col(den) == 0, F.lit(default)).otherwise(div(num, den))


def round_at(value: Column | str, places: int = 6) -> Column:
    """Round a double half-up through ``floor`` so both engines agree on every value."""
    scale = float(10**places)
    return F.floor(_col(value) * scale + 0.5) / scale


def clean_double(value: Column | str) -> Column:
    """Map NaN and infinities to null: a missing price stays missing, never a number."""
    x = _col(value).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def quantize(value: Column | str, places: int, precision: int = 28) -> Column:
    """Half-even decimal rounding of a money, quantity or price column."""
    exact = _col(value).cast("decimal(38,12)")
    return F.bround(exact, places).cast(f"decimal({precision},{places})")


def quantize_cash(value: Column | str) -> Column:
    return quantize(value, 2, 18)


def round_to_lot(quantity: Column | str, lot: Column | str | float = 1.0) -> Column:
    """Largest whole number of lots not exceeding the quantity, toward zero."""
    q, size = _col(quantity), _col(lot)
    return F.signum(q) * F.floor(F.abs(q) / size) * size


def literal_grid(df: DataFrame, rows: Iterable[Mapping[str, Any]], ddl: str) -> DataFrame:
    """Attach every row of a small, fixed parameter table to every input row.

    The grid travels inside the plan as one array literal and is exploded in place, so a
    sweep costs a ``Generate`` node instead of a join. ``ddl`` is a struct DDL such as
    ``"variant string, top_n int"``; only plan-time parameters belong here, never data.
    """
    names = [part.strip().split(" ")[0].split(":")[0] for part in _split_ddl(ddl)]
    structs = [
        F.struct(*[_literal(row[name]).alias(name) for name in names]) for row in rows
    ]
    grid = F.array(*structs).cast(f"array<struct<{_struct_ddl(ddl)}>>")
    return df.withColumn("__grid", F.explode(grid)).select(
        *[F.col(c) for c in df.columns], F.col("__grid.*")
    )


def _literal(value: Any) -> Column:
    if isinstance(value, (list, tuple)):
        return F.array(*[F.lit(v) for v in value])
    return F.lit(value)


def _split_ddl(ddl: str) -> list[str]:
    parts, depth, current = [], 0, ""
    for ch in ddl:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            parts.append(current)
            current = ""
        else:
            current += ch
    return [p.strip() for p in [*parts, current] if p.strip()]


def _struct_ddl(ddl: str) -> str:
    return ",".join(":".join(part.split(" ", 1)) for part in _split_ddl(ddl))
