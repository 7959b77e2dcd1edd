"""From weights to orders: fixed allocations, blends, rebalances and risk limits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import div, literal_grid, round_to_lot
from quantframe.operators.decisions import at_decisions
from quantframe.session import shared


# ---------------------------------------------------------------- fixed weights


def ready_dates(decisions: DataFrame, bars: DataFrame, weights: DataFrame) -> DataFrame:
    """Decision dates on which every symbol of a fixed allocation has a price.

    ``weights`` has ``strategy, symbol, weight``. Waiting for the whole set keeps the early
    history from quietly being a different strategy.
    """
    starts = bars.groupBy("symbol").agg(F.min("session").alias("first"))
    ready = (
        weights.join(starts, "symbol", "left")
        .groupBy("strategy")
        .agg(
            F.max("first").alias("ready"),
            F.max(F.col("first").isNull()).alias("__absent"),
        )
        .filter("not __absent")
    )
    return decisions.join(ready, F.col("as_of") >= F.col("ready")).select("strategy", "as_of")


def static_weights(
    decisions: DataFrame, bars: DataFrame, weights: DataFrame, *, once: bool = False
) -> DataFrame:
    """Restore fixed weights on every decision date, or buy them once and hold."""
    dates = ready_dates(decisions, bars, weights)
    if once:
        dates = dates.groupBy("strategy").agg(F.min("as_of").alias("as_of"))
    return dates.join(weights, "strategy").select("strategy", "as_of", "symbol", "weight")


def named_weights(
    instruments: DataFrame, table: Mapping[str, Mapping[str, float]]
) -> DataFrame:
    """Fixed allocations as rows; the weights are plan-time parameters."""
    rows = [
        {"strategy": name, "held": symbol, "weight": float(w)}
        for name, book in table.items()
        for symbol, w in book.items()
    ]
    for name, book in table.items():
        total = sum(book.values())
        if total > 1 + 1e-12 or min(book.values()) < 0:
            raise ValueError(f"{name}: weights must be non-negative and sum to at most one")
    grid = literal_grid(
        instruments.select("symbol"), rows, "strategy string, held string, weight double"
    )
    return grid.filter("symbol = held").select("strategy", "symbol", "weight")


def equal_weight(instruments: DataFrame, name: str = "equal_weight") -> DataFrame:
    """Equal shares truncated to eight places; the dust stays in cash."""
    every = Window.partitionBy(F.lit(0))  # an instrument dimension, not facts
    return (
        instruments.select("symbol")
        .distinct()
        .select(
            F.lit(name).alias("strategy"),
            "symbol",
            (F.floor(1e8 / F.count(F.lit(1)).over(every)) / 1e8).alias("weight"),
        )
    )


# ---------------------------------------------------------------- blends


def blend(
    targets: DataFrame,
    shares: Sequence[Mapping[str, object]],
    *,
    sleeve: str = "sleeve",
    by: Sequence[str] = (),
    schedule: DataFrame | None = None,
) -> DataFrame:
    """Combine sleeves, each at its latest decision, on the union of their decision dates.

    ``shares`` lists ``{"sleeve": name, "share": fraction}``. A sleeve that has not decided
    yet is uninvested. ``by`` adds outer keys (a variant); every key blends on its own dates.
    """
    total = sum(float(s["share"]) for s in shares)
    if total > 1.000001 or any(float(s["share"]) < 0 for s in shares):
        raise ValueError("sleeve shares must be non-negative and sum to at most one")
    targets = shared(targets)
    made = targets.select(*by, sleeve, "as_of").distinct()
    dates = schedule if schedule is not None else targets.select("as_of").distinct()
    latest = at_decisions(
        made.withColumnRenamed("as_of", "decided"), dates, day="decided", keys=[*by, sleeve]
    )
    if by and schedule is None:
        # Only dates on which one of this key's own sleeves decided.
        own = targets.select(*by, "as_of").distinct()
        latest = latest.join(own, [*by, "as_of"], "left_semi")
    weighted = literal_grid(
        targets.withColumnRenamed("as_of", "decided"),
        [{"__sleeve": s["sleeve"], "share": float(s["share"])} for s in shares],
        "__sleeve string, share double",
    ).filter(F.col("__sleeve") == F.col(sleeve))
    return (
        latest.join(weighted.drop("__sleeve"), [*by, sleeve, "decided"])
        .groupBy(*by, "as_of", "symbol")
        .agg(F.sum(F.round(F.col("weight") * 1e6) * F.col("share")).alias("__micro"))
        # Shares of six-place weights land on exact halves, so the tie rule is explicit.
        .select(*by, "as_of", "symbol", (F.bround("__micro", 0) / 1e6).alias("weight"))
        .filter("weight > 0")
    )


# ---------------------------------------------------------------- rebalancing


def rebalance_orders(
    targets: DataFrame,
    held: DataFrame,
    marks: DataFrame,
    prices: DataFrame,
    instruments: DataFrame,
    *,
    band: float = 0.20,
    min_notional: float = 100.0,
) -> DataFrame:
    """Orders that move each book to its targets, for all books and dates at once.

    Keys are ``portfolio, as_of``. A whole book trades when any leg closes or drifts past
    the band, so every trade set funds itself; otherwise the book is left alone.
    """
    book = ["portfolio", "as_of"]
    legs = (
        targets.select(*book, "symbol", F.col("weight").alias("target"))
        .join(held.select(*book, "symbol", "quantity"), [*book, "symbol"], "full_outer")
        .fillna(0.0, ["target", "quantity"])
        .join(marks.filter("nav > 0").select(*book, "nav"), book)
        .join(prices.select("as_of", "symbol", F.col("close").alias("price")), ["as_of", "symbol"])
        .join(instruments.select("symbol", "lot_size"), "symbol")
        .filter("price > 0 and (target <> 0 or quantity <> 0)")
    )
    current = F.col("quantity") * F.col("price") / F.col("nav")
    desired = round_to_lot(F.col("target") * F.col("nav") / F.col("price"), F.col("lot_size"))
    delta = round_to_lot(F.col("__desired") - F.col("quantity"), F.col("lot_size"))
    closing = F.col("target") == 0
    drift = F.coalesce(
        div(F.abs(F.col("current") - F.col("target")), F.abs("target")), F.lit(1.0)
    )
    judged = (
        legs.withColumn("current", current)
        .withColumn("__desired", desired)
        .withColumn("delta", delta)
        .filter("delta <> 0")
        .filter(closing | (F.abs("delta") * F.col("price") >= min_notional))
        .withColumn("closing", closing)
        .withColumn("__trigger", closing | (drift > band))
    )
    fired = judged.groupBy(*book).agg(F.bool_or("__trigger").alias("__fire")).filter("__fire")
    return judged.join(fired, book, "left_semi").select(
        *book, "symbol", "current", "target", "delta", "price", "closing"
    )


# ---------------------------------------------------------------- limits


def drawdown_halt(marks: DataFrame, limit: float = 0.25) -> DataFrame:
    """Trading halts while NAV is not positive or too far below its running high."""
    w = Window.partitionBy("portfolio").orderBy("session").rowsBetween(
        Window.unboundedPreceding, 0
    )
    high = F.max("nav").over(w)
    depth = F.greatest(F.coalesce(div(high - F.col("nav"), high), F.lit(0.0)), F.lit(0.0))
    return marks.select("portfolio", "session", "nav", high.alias("high_water"), depth.alias("drawdown")).withColumn(
        "halted", (F.col("nav") <= 0) | (F.col("drawdown") > limit)
    )


def limit_filter(
    orders: DataFrame,
    held: DataFrame,
    marks: DataFrame,
    *,
    max_weight: float = 1.0,
    max_gross: float = 1.05,
) -> DataFrame:
    """Accept or reject orders in sequence, each against the book its predecessors left.

    One batch is one rebalance of one portfolio, so its order list is bounded by the number
    of instruments. The fold is a native higher-order ``aggregate`` over that list; batches
    are independent and spread over the cluster. ``orders`` has ``portfolio, as_of, seq,
    symbol, quantity, price``; ``held`` has ``portfolio, as_of, symbol, quantity, price``.
    """
    book = ["portfolio", "as_of"]
    queue = orders.groupBy(*book).agg(
        F.array_sort(
            F.collect_list(F.struct("seq", "symbol", "quantity", "price"))
        ).alias("queue")
    )
    start = held.filter("quantity <> 0").groupBy(*book).agg(
        F.map_from_entries(F.collect_list(F.struct("symbol", "quantity"))).alias("book"),
        F.sum(F.abs(F.col("quantity") * F.col("price"))).alias("gross"),
    )
    ready = (
        queue.join(start, book, "left")
        .join(marks.filter("nav > 0").select(*book, "nav"), book)
        .withColumn("book", F.coalesce("book", F.expr("cast(map() as map<string,double>)")))
        .fillna(0.0, ["gross"])
    )
    judged = F.expr(
        f"""
        aggregate(
          queue,
          named_struct('book', book, 'gross', gross, 'out',
            cast(array() as array<struct<seq:bigint,symbol:string,quantity:double,reason:string>>)),
          (s, o) -> transform(array(named_struct(
              'was', coalesce(s.book[o.symbol], 0D),
              'after', coalesce(s.book[o.symbol], 0D) + o.quantity)),
            p -> transform(array(named_struct(
                'after', p.after,
                'gross', s.gross + (abs(p.after) - abs(p.was)) * o.price,
                'reason', case
                  when o.price is null or o.price <= 0 then 'no price'
                  when abs(p.after) * o.price / nav > {max_weight}D then 'weight cap'
                  when (s.gross + (abs(p.after) - abs(p.was)) * o.price) / nav > {max_gross}D
                    then 'gross cap' end)),
              q -> named_struct(
                'book', if(q.reason is null,
                  map_concat(map_filter(s.book, (k, v) -> k <> o.symbol), map(o.symbol, q.after)),
                  s.book),
                'gross', if(q.reason is null, q.gross, s.gross),
                'out', concat(s.out, array(named_struct('seq', cast(o.seq as bigint),
                  'symbol', o.symbol, 'quantity', o.quantity, 'reason', q.reason)))))[0])[0],
          s -> s.out)
        """
    )
    return ready.select(*book, F.explode(judged).alias("o")).select(
        *book,
        "o.seq",
        "o.symbol",
        "o.quantity",
        F.col("o.reason").isNull().alias("allowed"),
        "o.reason",
    )


def independent_limits(
    orders: DataFrame, held: DataFrame, marks: DataFrame, *, max_weight: float = 1.0
) -> DataFrame:
    """Each order against the current book alone: the plain, order-free weight check."""
    book = ["portfolio", "as_of"]
    return (
        orders.join(
            held.select(*book, "symbol", F.col("quantity").alias("held")), [*book, "symbol"], "left"
        )
        .join(marks.filter("nav > 0").select(*book, "nav"), book)
        .withColumn("after", F.coalesce("held", F.lit(0.0)) + F.col("quantity"))
        .withColumn("allowed", F.abs("after") * F.col("price") / F.col("nav") <= max_weight)
        .select(*book, "symbol", "after", "allowed")
    )


def whole_units(
    weight: Column, nav: Column, price: Column, multiplier: Column | float = 1.0
) -> Column:
    """Whole contracts or shares for a weight, toward zero; zero when a unit has no value."""
    unit = F.abs(price * multiplier)
    raw = div(weight * nav, unit)
    return F.coalesce(F.signum(raw) * F.floor(F.abs(raw)), F.lit(0.0))


def margin_gate(targets: DataFrame, marks: DataFrame, max_fraction: float = 0.35) -> DataFrame:
    """Whether a batch's initial margin fits: all of it trades or none of it does.

    ``targets`` has ``portfolio, as_of, symbol, units, margin``.
    """
    book = ["portfolio", "as_of"]
    need = targets.groupBy(*book).agg(
        F.sum(F.abs("units") * F.col("margin")).alias("__m")
    )
    return need.join(marks.select(*book, "nav"), book).select(
        *book,
        F.when(F.col("nav") > 0, F.col("__m") / F.col("nav")).alias("margin_fraction"),
        F.coalesce(
            (F.col("nav") > 0) & (F.col("__m") / F.nullif("nav", F.lit(0.0)) <= max_fraction),
            F.lit(False),
        ).alias("admitted"),
    )


def gross_budget(
    candidates: DataFrame, key: str = "session", *, budget: float = 0.60
) -> DataFrame:
    """Admit the strongest candidates first while their gross fits; a candidate that does
    not fit is skipped and smaller ones behind it may still enter.

    ``candidates`` has ``key, pair, strength, gross`` and optionally ``reserved``. A group is
    one date's candidate pairs, bounded by the pair list.
    """
    frame = candidates
    if "reserved" not in frame.columns:
        frame = frame.withColumn("reserved", F.lit(0.0))
    ordered = frame.groupBy(key).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("strength")).alias("k"), "pair", "gross"))
        ).alias("queue"),
        F.max("reserved").alias("reserved"),
    )
    walked = F.expr(
        f"""
        aggregate(queue,
          named_struct('used', reserved,
            'out', cast(array() as array<struct<pair:string,admitted:boolean,used:double>>)),
          (s, c) -> named_struct(
            'used', if(s.used + c.gross <= {budget}D + 1e-12D, s.used + c.gross, s.used),
            'out', concat(s.out, array(named_struct('pair', c.pair,
              'admitted', s.used + c.gross <= {budget}D + 1e-12D,
              'used', if(s.used + c.gross <= {budget}D + 1e-12D, s.used + c.gross, s.used))))),
          s -> s.out)
        """
    )
    return ordered.select(key, F.explode(walked).alias("c")).select(key, "c.*")
