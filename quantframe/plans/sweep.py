"""Parameter sweeps: every variant of the momentum strategy in one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.operators import calendars as cal
from quantframe.operators import metrics
from quantframe.plans.momentum import complete, dual_momentum
from quantframe.plans.nav import segment_nav
from quantframe.plans.strategies import tranched as tranched_targets

KNOBS = ("lookbacks", "top_n", "trend_window", "target_vol", "vol_lookback", "band", "cost_scale")
BASE_COST_RATE = 0.0002

# The ranges swept around each default.
SENSITIVITY_AXES: dict[str, tuple] = {
    "top_n": (3, 4, 5, 6, 8, 10),
    "trend_window": (100, 150, 200, 250, 300),
    "target_vol": (0.06, 0.08, 0.10, 0.12, 0.15),
    "vol_lookback": (20, 40, 60, 90, 120),
    "band": (0.05, 0.10, 0.20, 0.30, 0.50),
    "lookbacks": ((12,), (6, 12), (3, 6, 12), (1, 3, 6, 12), (3, 6, 9, 12)),
}
GRID_AXES = (("top_n", (3, 4, 5, 6, 8)), ("trend_window", (100, 150, 200, 250, 300)))
COST_SCALES = (0.0, 1.0, 2.0, 3.0, 5.0)


def label(knob: str, value: Any) -> str:
    text = "-".join(map(str, value)) if isinstance(value, (tuple, list)) else str(value)
    return f"{knob}={text}"


def one_at_a_time(axes: Mapping[str, Sequence[Any]]) -> list[dict[str, Any]]:
    """Variants that move one knob and hold the rest at their defaults."""
    return [with_knobs({knob: v}) for knob, values in axes.items() for v in values]


def two_way(x: tuple[str, Sequence[Any]], y: tuple[str, Sequence[Any]]) -> list[dict[str, Any]]:
    return [with_knobs({y[0]: b, x[0]: a}) for b in y[1] for a in x[1]]


def with_knobs(changes: Mapping[str, Any]) -> dict[str, Any]:
    unknown = set(changes) - set(KNOBS)
    if unknown:
        raise KeyError(f"no such knob: {', '.join(sorted(unknown))}")
    return {"variant": " ".join(label(k, v) for k, v in changes.items()) or "base", **changes}


def battery() -> list[dict[str, Any]]:
    """The full set: baseline, every axis, the grid and the cost scales, each name once."""
    rows = [
        with_knobs({}),
        *one_at_a_time(SENSITIVITY_AXES),
        *two_way(*GRID_AXES),
        *one_at_a_time({"cost_scale": COST_SCALES}),
    ]
    return list({r["variant"]: r for r in rows}.values())


def readiness(bars: DataFrame, variants: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Per variant, how many symbols have the history it asks for and since when."""
    from pyspark.sql import Window

    from quantframe.functions import literal_grid

    need = [{"variant": v["variant"], "need": complete(v)["need"]} for v in variants]
    w = Window.partitionBy("symbol").orderBy("session")
    numbered = bars.select("symbol", "session", F.row_number().over(w).alias("n"))
    grid = literal_grid(numbered, need, "variant string, need int").filter("n = need")
    return grid.groupBy("variant", "need").agg(
        F.count(F.lit(1)).alias("symbols"), F.min("session").alias("first_ready")
    )


def cost_rate(variants: Sequence[Mapping[str, Any]], base: float = BASE_COST_RATE) -> Column:
    """Per-variant turnover charge as an expression over the ``variant`` column."""
    rate: Column = F.lit(base)
    for v in variants:
        scale = float(v.get("cost_scale", 1.0))
        if scale < 0:
            raise ValueError(f"negative cost multiple {scale}")
        if scale != 1.0:
            rate = F.when(F.col("variant") == v["variant"], base * scale).otherwise(rate)
    return rate


def sweep_curves(
    bars: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    variants: Sequence[Mapping[str, Any]],
    *,
    tranches: bool = False,
    cash_symbol: str = "S00",
) -> DataFrame:
    """NAV per variant and session.

    Decision signals are shared across variants; a variant adds rows only on decision dates.
    The no-trade band has no effect on fractional segment books and is carried as a label.
    """
    if tranches:
        targets = tranched_targets(
            bars, calendar, instruments, variants=variants, cash_symbol=cash_symbol
        )
    else:
        dates = cal.month_ends(calendar).select(F.col("session").alias("as_of"))
        targets = dual_momentum(
            bars, dates, instruments, variants=variants, cash_symbol=cash_symbol
        )
    return segment_nav(targets, bars, calendar, cost_rate=cost_rate(variants))


def run_sweep(
    bars: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    variants: Sequence[Mapping[str, Any]],
    *,
    rates: DataFrame | float = 0.0,
    tranches: bool = False,
    cash_symbol: str = "S00",
) -> DataFrame:
    """Statistics and annual turnover of every variant: the trial table."""
    curves = sweep_curves(
        bars, calendar, instruments, variants, tranches=tranches, cash_symbol=cash_symbol
    )
    stats = metrics.performance(curves, rates, ["variant"])
    traded = curves.groupBy("variant").agg(
        (
            F.sum("turnover")
            / F.nullif(F.datediff(F.max("session"), F.min("session")) / 365.25, F.lit(0.0))
        ).alias("annual_turnover")
    )
    return stats.join(traded, "variant")


def sensitivity_table(trials: DataFrame) -> DataFrame:
    """One row per knob, one column per value position, Sharpe in the cells."""
    parts = F.split("variant", "=")
    return trials.filter(F.size(parts) == 2).select(
        parts[0].alias("knob"), parts[1].alias("value"), "sharpe", "cagr", "max_drawdown"
    )


def grid_table(trials: DataFrame, x: tuple[str, Sequence[Any]], y: str) -> DataFrame:
    """Sharpe of a two-way grid with the ``x`` knob across."""
    names = [str(v) for v in x[1]]
    wide = (
        trials.withColumn("__x", F.regexp_extract("variant", rf"{x[0]}=(\S+)", 1))
        .withColumn(y, F.regexp_extract("variant", rf"{y}=(\S+)", 1))
        .filter(F.col("__x").isin(names) & (F.col(y) != ""))
        .groupBy(y)
        .pivot("__x", names)
        .agg(F.first("sharpe"))
    )
    return wide.toDF(y, *[f"{x[0]}_{n}" for n in names])


def admission_policies(instruments: DataFrame, policies: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """Instruments repeated per policy, with that policy's admission dates."""
    out = None
    for name, dates in policies.items():
        day = F.col("available_from")
        for symbol, value in dates.items():
            day = F.when(F.col("symbol") == symbol, F.lit(value).cast("date")).otherwise(day)
        one = instruments.withColumn("available_from", day).withColumn("admission", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def admission_sweep(
    bars: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    policies: Mapping[str, Mapping[str, str]],
    *,
    rates: DataFrame | float = 0.0,
    cash_symbol: str = "S00",
) -> DataFrame:
    """The same strategy under different admission dates, all ranked in one plan."""
    dims = admission_policies(instruments, policies)
    dates = cal.month_ends(calendar).select(F.col("session").alias("as_of"))
    targets = dual_momentum(bars, dates, dims, variants=[{}], cash_symbol=cash_symbol)
    curves = segment_nav(targets, bars, calendar, cost_rate=BASE_COST_RATE)
    return metrics.performance(curves, rates, ["variant"])


def start_date_sweep(
    bars: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    starts: DataFrame,
    *,
    rates: DataFrame | float = 0.0,
    cash_symbol: str = "S00",
) -> DataFrame:
    """The base strategy begun at each date of ``starts`` (column ``session``), in one plan.

    Signals are computed once; a start adds the decision rows from its date on. ``starts`` is a
    start-date grid, a handful of rows at any size of the history.
    """
    dates = cal.month_ends(calendar).select(F.col("session").alias("as_of"))
    targets = dual_momentum(bars, dates, instruments, variants=[{}], cash_symbol=cash_symbol)
    begun = starts.select(F.col("session").alias("__start"))
    each = (
        targets.drop("variant")
        .join(begun, F.col("as_of") >= F.col("__start"))
        .withColumn("variant", F.concat(F.lit("start="), F.col("__start").cast("string")))
        .drop("__start")
    )
    curves = segment_nav(each, bars, calendar, cost_rate=BASE_COST_RATE)
    return metrics.performance(curves, rates, ["variant"])
