"""Named strategies: frames in, target weights out.

A strategy is ``f(bars, calendar, instruments, **knobs) -> DataFrame`` with columns
``as_of, symbol, weight``. Schedules are functions from a calendar to decision dates.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantframe.operators import allocation
from quantframe.operators import calendars as cal
from quantframe.plans.momentum import dual_momentum

DEFAULT_OFFSETS = (0, 5, 10, 15)


def _month_ends(calendar: DataFrame) -> DataFrame:
    return cal.month_ends(calendar).select(F.col("session").alias("as_of"))


def momentum(bars, calendar, instruments, *, cash_symbol="S00", **knobs) -> DataFrame:
    return dual_momentum(
        bars, _month_ends(calendar), instruments, variants=[knobs], cash_symbol=cash_symbol
    ).drop("variant")


def tranched(
    bars: DataFrame,
    calendar: DataFrame,
    instruments: DataFrame,
    *,
    offsets: Sequence[int] = DEFAULT_OFFSETS,
    variants: Sequence[Mapping] = ({},),
    cash_symbol: str = "S00",
) -> DataFrame:
    """Staggered copies of the momentum strategy, each with an equal share of capital.

    All offsets' dates go through the momentum plan once; the schedule tag then assigns each
    date's targets to its tranche. Returns ``variant, as_of, symbol, weight``.
    """
    if len(set(offsets)) != len(offsets) or not offsets:
        raise ValueError("tranche offsets must be distinct and non-empty")
    tagged = cal.monthly_offsets(calendar, offsets).select(
        F.col("offset").cast("string").alias("sleeve"), F.col("session").alias("as_of")
    )
    made = dual_momentum(
        bars, tagged, instruments, variants=variants, cash_symbol=cash_symbol
    )
    shares = [{"sleeve": str(o), "share": 1.0 / len(offsets)} for o in offsets]
    return allocation.blend(made.join(tagged, "as_of"), shares, by=["variant"])


def fixed(weights: Mapping[str, float], *, once: bool = False) -> Callable[..., DataFrame]:
    def build(bars, calendar, instruments, **_):
        table = allocation.named_weights(instruments, {"fixed": weights})
        dates = (
            calendar.select(F.col("session").alias("as_of")) if once else _month_ends(calendar)
        )
        return allocation.static_weights(dates, bars, table, once=once).drop("strategy")

    return build


def equal(bars, calendar, instruments, **_) -> DataFrame:
    table = allocation.equal_weight(instruments, "equal")
    return allocation.static_weights(_month_ends(calendar), bars, table).drop("strategy")


def balanced(bars, calendar, instruments, *, equity="S01", bonds="S02", cash_symbol="S00"):
    """Half momentum in four tranches, half 60/40."""
    core = tranched(bars, calendar, instruments, cash_symbol=cash_symbol).select(
        F.lit("momentum").alias("sleeve"), "as_of", "symbol", "weight"
    )
    mix = fixed({equity: 0.6, bonds: 0.4})(bars, calendar, instruments).select(
        F.lit("sixty_forty").alias("sleeve"), "as_of", "symbol", "weight"
    )
    return allocation.blend(
        core.unionByName(mix),
        [{"sleeve": "momentum", "share": 0.5}, {"sleeve": "sixty_forty", "share": 0.5}],
    )


STRATEGIES: dict[str, Callable[..., DataFrame]] = {
    "momentum": lambda *a, **k: tranched(*a, **k).drop("variant"),
    "momentum-single": momentum,
    "60-40": fixed({"S01": 0.6, "S02": 0.4}),
    "buy-and-hold": fixed({"S01": 1.0}, once=True),
    "spy": fixed({"S01": 1.0}, once=True),
    "equal-weight": equal,
    "balanced": balanced,
}


def build(name: str, bars: DataFrame, calendar: DataFrame, instruments: DataFrame, **knobs):
    if name not in STRATEGIES:
        raise KeyError(f"no strategy named {name!r} among {', '.join(STRATEGIES)}")
    return STRATEGIES[name](bars, calendar, instruments, **knobs)
