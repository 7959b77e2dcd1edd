"""Positions, cash, holdings, marks, attribution and financing.

Fills are unbounded facts: one portfolio may hold a third of them. Everything here either
aggregates fills to one row per key and session first (then windows are calendar-sized), or
runs through ``block_scan``, or folds chunks of proven size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, quantize_cash
from quantframe.operators.asof import rate_on
from quantframe.operators.decisions import at_decisions
from quantframe.operators.scan import block_scan

POSITION = ("portfolio", "symbol")
CHUNK = 4096


# ---------------------------------------------------------------- average cost


def _fold(maps: Column) -> Column:
    """Compose an ordered array of position maps.

    A fill acts on the cost basis ``C`` as ``C -> a C + b`` and realises ``r0 + r1 C``. Both
    forms are closed under composition, so an ordered run of fills is one such map.
    """
    zero = F.struct(
        F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("r0"), F.lit(0.0).alias("r1")
    )
    return F.aggregate(
        maps,
        zero,
        lambda s, x: F.struct(
            (x.a * s.a).alias("a"),
            (x.a * s.b + x.b).alias("b"),
            (s.r0 + x.r0 + x.r1 * s.b).alias("r0"),
            (s.r1 + x.r1 * s.a).alias("r1"),
        ),
    )


def fill_maps(fills: DataFrame) -> DataFrame:
    """Each fill with the quantity before it and its effect on basis and realised P&L."""
    running = block_scan(
        fills,
        POSITION,
        "session",
        ["ts", "execution_id"],
        {"__q": ("sum", F.col("quantity")), "__rn": ("sum", F.lit(1))},
    )
    q1 = F.round("__q", 8)
    q0 = F.round(F.col("__q") - F.col("quantity"), 8)
    dq, px = F.col("quantity"), F.col("price")
    opening = (q0 == 0) | (F.signum(q0) == F.signum(dq))
    reducing = F.abs(dq) <= F.abs(q0)
    side, held = F.signum(q0), F.nullif(F.abs(q0), F.lit(0.0))
    zero = F.lit(0.0)
    return running.select(
        *fills.columns,
        q0.alias("held_before"),
        F.floor(F.col("__rn") / CHUNK).alias("chunk"),
        F.when(opening, 1.0).when(reducing, F.abs(q1) / held).otherwise(zero).alias("a"),
        F.when(opening, F.abs(dq) * px)
        .when(reducing, zero)
        .otherwise(F.abs(q1) * px)
        .alias("b"),
        F.when(opening, zero).otherwise(F.least(F.abs(dq), F.abs(q0)) * px * side).alias("r0"),
        F.when(opening, zero)
        .otherwise(-F.least(F.abs(dq), F.abs(q0)) / held * side)
        .alias("r1"),
    )


def positions(fills: DataFrame) -> DataFrame:
    """Average-cost positions: quantity, average cost, realised P&L, commission paid.

    The fold is sequential by nature, yet no task ever sees a whole key: fills compose in
    chunks of at most ``CHUNK`` rows, chunks compose within a session, and sessions compose
    within a key (at most one entry per calendar day).
    """
    ordered = lambda *by: F.array_sort(
        F.collect_list(F.struct(*by, F.struct("a", "b", "r0", "r1").alias("m")))
    )
    maps = fill_maps(fills)
    chunks = (
        maps.groupBy(*POSITION, "session", "chunk")
        .agg(
            ordered("ts", "execution_id").alias("f"),
            F.sum("quantity").alias("quantity"),
            F.sum("commission").alias("commission"),
            F.count(F.lit(1)).alias("fills"),
        )
        .select(*POSITION, "session", "chunk", _fold(F.col("f.m")).alias("m"), "quantity", "commission", "fills")
        .select(*POSITION, "session", "chunk", "m.*", "quantity", "commission", "fills")
    )
    days = _compose(chunks, [*POSITION, "session"], "chunk")
    return _compose(days, list(POSITION), "session").select(
        *POSITION,
        F.round("quantity", 8).alias("quantity"),
        F.when(F.round("quantity", 8) != 0, F.col("b") / F.abs("quantity"))
        .otherwise(0.0)
        .alias("avg_cost"),
        F.col("r0").alias("realized"),
        "commission",
        "fills",
    )


def _compose(parts: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    packed = F.array_sort(
        F.collect_list(F.struct(F.col(order), F.struct("a", "b", "r0", "r1").alias("m")))
    )
    return (
        parts.groupBy(*keys)
        .agg(
            packed.alias("f"),
            F.sum("quantity").alias("quantity"),
            F.sum("commission").alias("commission"),
            F.sum("fills").alias("fills"),
        )
        .select(*keys, _fold(F.col("f.m")).alias("m"), "quantity", "commission", "fills")
        .select(*keys, "m.*", "quantity", "commission", "fills")
    )


def position_pnl(book: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost basis, unrealised and net realised P&L at the given prices."""
    return book.join(prices.select("symbol", "close"), "symbol", "left").select(
        *POSITION,
        "quantity",
        (F.abs("quantity") * F.col("avg_cost")).alias("cost_basis"),
        F.when(F.col("quantity") != 0, F.col("quantity") * (F.col("close") - F.col("avg_cost")))
        .otherwise(0.0)
        .alias("unrealized"),
        (F.col("realized") - F.col("commission")).alias("net_realized"),
        "realized",
        "commission",
    )


# ---------------------------------------------------------------- cash and holdings


def cash_impact() -> Column:
    """Signed change to cash of one fill, costs included, to the cent."""
    exact = (
        -F.col("quantity").cast("decimal(18,8)") * F.col("price").cast("decimal(18,8)")
    ).cast("decimal(38,10)") - F.col("commission").cast("decimal(18,8)")
    return quantize_cash(exact)


def cash_ledger(
    fills: DataFrame, initial: float, movements: DataFrame | None = None
) -> DataFrame:
    """Running cash after every fill and every external movement.

    ``movements`` has ``portfolio, session, ts, amount`` and is rounded to the cent per row.
    """
    rows = fills.select(
        "portfolio", "session", "ts", F.col("execution_id").alias("entry"), cash_impact().alias("impact")
    )
    if movements is not None:
        rows = rows.unionByName(
            movements.select(
                "portfolio",
                "session",
                "ts",
                F.lit(-1).cast("bigint").alias("entry"),
                quantize_cash("amount").alias("impact"),
            )
        )
    return block_scan(
        rows, ["portfolio"], "session", ["ts", "entry"], {"__c": ("sum", F.col("impact"))}
    ).select(
        "portfolio",
        "session",
        "entry",
        "impact",
        (F.col("__c") + F.lit(initial).cast("decimal(18,2)")).alias("cash"),
    )


def session_flows(fills: DataFrame) -> DataFrame:
    """Fills added up per position and session: quantity and change to cash.

    Both add up further, so :func:`holdings` and :func:`cash_at_sessions` take these rows in the
    place of fills; written once, they spare every later reader the fills.
    """
    return fills.groupBy(*POSITION, "session").agg(
        F.sum("quantity").alias("quantity"), F.sum(cash_impact()).alias("impact")
    )


def cash_at_sessions(fills: DataFrame, calendar: DataFrame, initial: float) -> DataFrame:
    """Cash of each portfolio at every session from its first fill (or session flow) on."""
    impact = F.col("impact") if "impact" in fills.columns else cash_impact()
    w = Window.partitionBy("portfolio").orderBy("session").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = (
        fills.groupBy("portfolio", "session")
        .agg(F.sum(impact).alias("__i"))
        .select(
            "portfolio",
            "session",
            (F.sum("__i").over(w) + F.lit(initial).cast("decimal(18,2)"))
            .cast("double")
            .alias("cash"),
        )
    )
    return at_decisions(
        running, calendar.select(F.col("session").alias("as_of")), keys=("portfolio",), days=fills
    ).select("portfolio", F.col("as_of").alias("session"), "cash")


def holdings(fills: DataFrame, calendar: DataFrame) -> DataFrame:
    """Quantity per portfolio and symbol at every session from its first fill on.

    Fills collapse to one row per key and session before any window runs.
    """
    w = Window.partitionBy(*POSITION).orderBy("session").rowsBetween(
        Window.unboundedPreceding, 0
    )
    running = (
        fills.groupBy(*POSITION, "session")
        .agg(F.sum("quantity").alias("__d"))
        .select(*POSITION, "session", F.round(F.sum("__d").over(w), 8).alias("quantity"))
    )
    return at_decisions(
        running, calendar.select(F.col("session").alias("as_of")), keys=POSITION, days=fills
    ).select(*POSITION, F.col("as_of").alias("session"), "quantity")


def marked_lines(held: DataFrame, panel: DataFrame) -> DataFrame:
    """Market value of every non-flat holding at last-known closes."""
    return (
        held.filter("quantity <> 0")
        .join(panel.select("symbol", "session", "close"), ["symbol", "session"], "left")
        .withColumn("value", F.col("quantity") * F.col("close"))
    )


def unpriced(lines: DataFrame) -> DataFrame:
    """Violations: held symbols without any known price. A book with one has no NAV."""
    return lines.filter("close is null").select("portfolio", "session", "symbol")


def mark_book(lines: DataFrame, cash: DataFrame) -> DataFrame:
    """NAV, cash, gross exposure and holdings count per portfolio and session."""
    totals = lines.groupBy("portfolio", "session").agg(
        F.sum("value").alias("__mv"),
        F.sum(F.abs("value")).alias("__gross"),
        F.count(F.lit(1)).alias("holdings"),
        F.max(F.col("close").isNull()).alias("__missing"),
    )
    nav = F.when(
        ~F.coalesce("__missing", F.lit(False)),
        F.col("cash") + F.coalesce("__mv", F.lit(0.0)),
    )
    return (
        cash.join(totals, ["portfolio", "session"], "left")
        .withColumn("nav", nav)
        .select(
            "portfolio",
            "session",
            "nav",
            "cash",
            F.coalesce(div("__gross", "nav"), F.lit(0.0)).alias("gross_exposure"),
            F.coalesce("holdings", F.lit(0)).alias("holdings"),
        )
    )


def weight_lines(lines: DataFrame, marks: DataFrame) -> DataFrame:
    """Weight of every line that is worth something in a book with a positive NAV."""
    worth = marks.filter("nav > 0").select("portfolio", "session", "nav")
    return (
        lines.filter("value <> 0")
        .join(worth, ["portfolio", "session"])
        .select("portfolio", "session", "symbol", (F.col("value") / F.col("nav")).alias("weight"))
    )


# ---------------------------------------------------------------- attribution


def attribution(
    pnl: DataFrame, weights: DataFrame, marks: DataFrame, cash_pnl: DataFrame | None = None
) -> DataFrame:
    """Per-symbol profit and capital use. Means run over all sessions, held or not."""
    sessions = marks.groupBy("portfolio").agg(F.count(F.lit(1)).alias("sessions"))
    use = weights.groupBy(*POSITION).agg(
        F.sum("weight").alias("__w"), F.count(F.lit(1)).alias("sessions_held")
    )
    zero = F.lit(0.0)
    rows = (
        pnl.select(*POSITION, "realized", "unrealized", "commission")
        .join(use, list(POSITION), "full_outer")
        .join(sessions, "portfolio")
        .select(
            *POSITION,
            F.coalesce("realized", zero).alias("realized"),
            F.coalesce("unrealized", zero).alias("unrealized"),
            F.coalesce("commission", zero).alias("commission"),
            F.coalesce(F.col("__w") / F.col("sessions"), zero).alias("average_weight"),
            F.coalesce("sessions_held", F.lit(0)).alias("sessions_held"),
            F.coalesce(F.col("sessions_held") / F.col("sessions"), zero).alias("time_held"),
        )
    )
    if cash_pnl is not None:
        cash = cash_pnl.filter("amount <> 0").join(sessions, "portfolio").select(
            "portfolio",
            F.lit("CASH").alias("symbol"),
            F.col("amount").alias("realized"),
            zero.alias("unrealized"),
            zero.alias("commission"),
            zero.alias("average_weight"),
            F.col("sessions").alias("sessions_held"),
            F.lit(1.0).alias("time_held"),
        )
        rows = rows.unionByName(cash)
    return rows.withColumn(
        "net", F.col("realized") + F.col("unrealized") - F.col("commission")
    )


def concentration(contributions: DataFrame) -> DataFrame:
    """Share of all gains that came from the single best line."""
    gain = F.when(F.col("net") > 0, F.col("net"))
    return contributions.groupBy("portfolio").agg(
        F.coalesce(div(F.max(gain), F.sum(gain)), F.lit(0.0)).alias("concentration")
    )


def pnl_decomposition(held: DataFrame, panel: DataFrame, multiplier: float = 1.0) -> DataFrame:
    """Overnight and intraday P&L per line: the earlier quantity earns the gap to the open,
    the quantity after the open earns the session."""
    by_line = Window.partitionBy(*POSITION).orderBy("session")
    by_symbol = Window.partitionBy("symbol").orderBy("session")
    prices = panel.select(
        "symbol", "session", "open", "close", F.lag("close").over(by_symbol).alias("__prev")
    )
    before = held.withColumn("__q0", F.lag("quantity", 1, 0.0).over(by_line))
    gap = F.col("__q0") * (F.col("open") - F.coalesce("__prev", F.col("open"))) * multiplier
    return before.join(prices, ["symbol", "session"]).select(
        *POSITION,
        "session",
        gap.alias("overnight"),
        (F.col("quantity") * (F.col("close") - F.col("open")) * multiplier).alias("intraday"),
    )


# ---------------------------------------------------------------- financing


def growth_index(days: DataFrame, rates: DataFrame, name: str) -> DataFrame:
    """Log growth of one unit from the first day up to each day, compounding daily."""
    w = Window.partitionBy(F.lit(0)).orderBy("session").rowsBetween(
        Window.unboundedPreceding, -1
    )
    rated = rate_on(days, rates, "session", name="__r")
    return rated.select(
        "session", F.coalesce(F.sum(F.log1p(F.col("__r") / 365)).over(w), F.lit(0.0)).alias(name)
    )


def interest_accrual(
    balances: DataFrame, days: DataFrame, cash_rates: DataFrame, margin_rates: DataFrame
) -> DataFrame:
    """Interest on each balance between its session and the next one.

    Positive cash earns the cash curve, negative cash pays the margin curve; a balance never
    changes sign by compounding, so a gap of any length is a difference of two log-growth
    readings and no day is looped over.
    """
    index = growth_index(days, cash_rates, "__cash").join(
        growth_index(days, margin_rates, "__margin"), "session"
    )
    w = Window.partitionBy("portfolio").orderBy("session")
    spans = balances.withColumn("until", F.lead("session").over(w)).filter("until is not null")
    later = index.select(
        F.col("session").alias("until"),
        F.col("__cash").alias("__cash1"),
        F.col("__margin").alias("__margin1"),
    )
    earned = F.when(
        F.col("cash") > 0, F.expm1(F.col("__cash1") - F.col("__cash"))
    ).otherwise(F.expm1(F.col("__margin1") - F.col("__margin")))
    return (
        spans.join(index, "session")
        .join(later, "until")
        .select(
            "portfolio",
            "session",
            "until",
            "cash",
            quantize_cash(F.col("cash") * earned).alias("interest"),
        )
    )


def carry_costs(
    lines: DataFrame,
    marks: DataFrame,
    cash_rates: DataFrame,
    margin_rates: DataFrame,
    *,
    borrow_rate: float = 0.01,
) -> DataFrame:
    """Borrow fee on shorts, debit interest on longs beyond NAV, credit on NAV not in longs.

    All three accrue over the calendar days to the next session at the rate known at the
    start of the gap.
    """
    w = Window.partitionBy("portfolio").orderBy("session")
    sides = lines.groupBy("portfolio", "session").agg(
        F.sum(F.greatest(F.col("value"), F.lit(0.0))).alias("longs"),
        F.sum(F.greatest(-F.col("value"), F.lit(0.0))).alias("shorts"),
    )
    spans = (
        marks.select("portfolio", "session", "nav")
        .join(sides, ["portfolio", "session"], "left")
        .fillna(0.0, ["longs", "shorts"])
        .withColumn("days", F.datediff(F.lead("session").over(w), "session"))
        .filter("days is not null")
    )
    rated = rate_on(
        rate_on(spans, cash_rates, "session", name="__cash"),
        margin_rates,
        "session",
        name="__margin",
    )
    share = F.col("days") / 365.0
    return rated.select(
        "portfolio",
        "session",
        "days",
        (F.col("shorts") * borrow_rate * share).alias("borrow_fee"),
        (F.greatest(F.col("longs") - F.col("nav"), F.lit(0.0)) * F.col("__margin") * share).alias(
            "debit_interest"
        ),
        (F.greatest(F.col("nav") - F.col("longs"), F.lit(0.0)) * F.col("__cash") * share).alias(
            "credit_interest"
        ),
    )
