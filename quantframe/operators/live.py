"""Live-record operators: collapse, compare, dedupe, reconcile, match and watch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantframe.functions import div
from quantframe.operators.quantiles import exact_quantile
from quantframe.operators.scan import block_scan
from quantframe.session import shared

INTENTION = ("session", "symbol", "buying")


def collapse_fills(fills: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """One intention per session, symbol and direction at a volume-weighted price."""
    size = F.abs("quantity")
    return (
        fills.withColumn("buying", F.col("quantity") > 0)
        .groupBy(*keys, *INTENTION)
        .agg(
            F.sum("quantity").alias("quantity"),
            div(F.sum(size * F.col("price")), F.sum(size)).alias("price"),
            F.sum("commission").alias("commission"),
            F.count(F.lit(1)).alias("pieces"),
        )
    )


def paired_intentions(simulated: DataFrame, actual: DataFrame) -> DataFrame:
    """Shared intentions of two books with their divergence in basis points.

    Positive means the real fill was worse for the trader than the simulated one.
    """
    a = simulated.select(
        *INTENTION, F.col("price").alias("sim_price"), F.col("commission").alias("sim_commission")
    )
    b = actual.select(
        *INTENTION,
        F.col("price").alias("act_price"),
        F.col("commission").alias("act_commission"),
        F.col("quantity").alias("act_quantity"),
    )
    side = F.when(F.col("buying"), 1.0).otherwise(-1.0)
    notional = F.abs("act_quantity") * F.col("act_price")
    return a.join(b, list(INTENTION)).select(
        *INTENTION,
        "sim_price",
        "act_price",
        F.coalesce(
            div(F.col("act_price") - F.col("sim_price"), "sim_price") * 10000 * side, F.lit(0.0)
        ).alias("divergence_bps"),
        F.coalesce(
            div(F.col("act_commission") - F.col("sim_commission"), notional) * 10000, F.lit(0.0)
        ).alias("commission_bps"),
    )


def unmatched(simulated: DataFrame, actual: DataFrame) -> DataFrame:
    """Intentions only one side has, tagged with that side."""
    keys = list(INTENTION)
    only = lambda x, y, tag: x.join(y.select(*keys), keys, "left_anti").select(
        *keys, F.lit(tag).alias("side")
    )
    return only(simulated, actual, "simulated").unionByName(only(actual, simulated, "actual"))


def divergence_summary(
    pairs: DataFrame,
    missing: DataFrame,
    spreads: DataFrame,
    *,
    default_bps: float = 2.0,
    enough: int = 30,
) -> DataFrame:
    """How optimistic the simulator was: median, mean and worst gap, and the corrected scale.

    The median is exact without gathering the pairs in one task.
    """
    rated = pairs.join(spreads.select("symbol", "half_spread_bps"), "symbol", "left").withColumn(
        "__m", F.coalesce("half_spread_bps", F.lit(default_bps))
    )
    one = F.lit(1).alias("__one")
    stats = rated.groupBy(one).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.avg("divergence_bps").alias("mean_bps"),
        F.max("divergence_bps").alias("worst_bps"),
        F.sum((F.col("divergence_bps") < 0).cast("int")).alias("improved"),
        F.avg("commission_bps").alias("commission_bps"),
        F.avg("__m").alias("modelled_bps"),
    )
    median = exact_quantile(
        pairs.withColumn("__one", F.lit(1)), ["__one"], "divergence_bps", 0.5, "median_bps"
    )
    sides = missing.groupBy(one).agg(
        F.sum((F.col("side") == "simulated").cast("int")).alias("unmatched_simulated"),
        F.sum((F.col("side") == "actual").cast("int")).alias("unmatched_actual"),
    )
    optimism = F.when(
        F.col("modelled_bps") > 0,
        F.greatest(F.col("median_bps"), F.lit(0.0)) / F.nullif("modelled_bps", F.lit(0.0)),
    ).otherwise(1.0)
    return (
        stats.join(median, "__one")
        .join(sides, "__one", "left")
        .fillna(0, ["unmatched_simulated", "unmatched_actual"])
        .withColumn("optimism", optimism)
        .withColumn("corrected_scale", F.floor(F.col("optimism") * 1e4 + 0.5) / 1e4)
        .withColumn("trustworthy", F.col("pairs") >= enough)
        .drop("__one")
    )


def execution_verdicts(executions: DataFrame, payload: Sequence[str]) -> DataFrame:
    """Per execution id: recorded once, an identical repeat, or a conflict.

    Payloads are compared by hash inside one aggregate, so repeated ids never gather rows.
    """
    digest = F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in payload]), 256)
    return (
        executions.withColumn("__h", digest)
        .groupBy("execution_id")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            (F.min("__h") != F.max("__h")).alias("conflict"),
        )
        .withColumn(
            "verdict",
            F.when(F.col("conflict"), "conflict")
            .when(F.col("copies") > 1, "repeat")
            .otherwise("new"),
        )
        .drop("conflict")
    )


def correction_review(ids: DataFrame, column: str = "execution_id") -> DataFrame:
    """Ids that share everything before the last dot: corrections a person must look at."""
    prefix = F.regexp_extract(column, r"^(.*)\.[^.]*$", 1)
    tagged = ids.select(column).distinct().withColumn("prefix", prefix).filter("prefix <> ''")
    return (
        tagged.groupBy("prefix")
        .agg(F.count(F.lit(1)).alias("versions"))
        .filter("versions > 1")
    )


def invalid_executions(executions: DataFrame) -> DataFrame:
    """Execution evidence that cannot be accepted, with the reason."""
    c = F.col
    reason = (
        F.when(c("execution_id").isNull() | c("order_id").isNull(), "missing identifier")
        .when(c("quantity").isNull() | (c("quantity") == 0), "zero quantity")
        .when(c("price").isNull() | (c("price") <= 0), "non-positive price")
        .when(c("commission").isNull() | (c("commission") < 0), "negative commission")
        .when(c("ts").isNull(), "missing instant")
    )
    return executions.withColumn("reason", reason).filter("reason is not null")


def order_completion(orders: DataFrame, executions: DataFrame) -> DataFrame:
    """Executed quantity per order: complete, partial or none."""
    done = executions.groupBy("order_id").agg(F.sum("quantity").alias("executed"))
    return (
        orders.join(done, "order_id", "left")
        .fillna(0.0, ["executed"])
        .withColumn(
            "status",
            F.when(F.col("executed") == F.col("quantity"), "complete")
            .when(F.col("executed") != 0, "partial")
            .otherwise("none"),
        )
    )


def effective_fills(fills: DataFrame, amendments: DataFrame) -> DataFrame:
    """Fills with their newest amendment laid over them, column by column.

    Whatever the amendment leaves null stays as filled. Columns of the amendment that a fill has
    not, such as the import it came from, are added.
    """
    corrected = [c for c in amendments.columns if c not in ("execution_id", "version")]
    latest = amendments.groupBy("execution_id").agg(
        F.max_by(F.struct(*corrected), "version").alias("__a")
    )
    laid = [
        F.coalesce(F.col(f"__a.{c}"), F.col(c)).alias(c) if c in corrected else F.col(c)
        for c in fills.columns
    ]
    added = [F.col(f"__a.{c}").alias(c) for c in corrected if c not in fills.columns]
    return fills.join(latest, "execution_id", "left").select(
        *laid, *added, F.col("__a").isNotNull().alias("amended")
    )


def reconcile(
    expected: DataFrame,
    actual: DataFrame,
    keys: Sequence[str] = ("portfolio", "symbol"),
    *,
    tolerance: float = 1e-8,
) -> DataFrame:
    """Both sides' quantities and whether they agree; either side may hold extra keys."""
    a = expected.select(*keys, F.col("quantity").alias("expected"))
    b = actual.select(*keys, F.col("quantity").alias("actual"))
    return (
        a.join(b, list(keys), "full_outer")
        .fillna(0.0, ["expected", "actual"])
        .withColumn("difference", F.col("actual") - F.col("expected"))
        .withColumn("agrees", F.abs("difference") <= tolerance)
    )


def reconciliation_summary(lines: DataFrame, keys: Sequence[str] = ("portfolio",)) -> DataFrame:
    return lines.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("checked"),
        F.sum((~F.col("agrees")).cast("int")).alias("discrepancies"),
        F.bool_and("agrees").alias("agreed"),
    )


def ledger_vs_statement(
    trades: DataFrame, reported: DataFrame, *, tolerance: float = 0.01
) -> DataFrame:
    """Whether trades explain a statement's cash movement.

    ``reported`` has ``portfolio, starting_cash, ending_cash``.
    """
    moved = trades.groupBy("portfolio").agg(
        F.sum(-F.col("quantity") * F.col("price") - F.col("commission")).alias("calculated")
    )
    return (
        reported.join(moved, "portfolio", "left")
        .fillna(0.0, ["calculated"])
        .withColumn("movement", F.col("ending_cash") - F.col("starting_cash"))
        .withColumn("explained", F.abs(F.col("calculated") - F.col("movement")) <= tolerance)
    )


def match_orders_to_trades(
    orders: DataFrame,
    trades: DataFrame,
    *,
    window: str = "4 days",
    keys: Sequence[str] = ("symbol", "quantity"),
) -> DataFrame:
    """Interval match, unique both ways: same keys, ``created < ts < created + window``.

    ``orders`` has ``order_id, created_at``; ``trades`` has ``trade_id, ts``. The result has
    one row per trade. See :func:`interval_counts` for how it scales.
    """
    counts = shared(interval_counts(orders, trades, window=window, keys=keys), "instants")
    return matched_trades(counts, orders, trades, keys).select(
        "trade_id", "order_id", "candidates", "status"
    )


def interval_counts(
    orders: DataFrame,
    trades: DataFrame,
    *,
    window: str = "4 days",
    keys: Sequence[str] = ("symbol", "quantity"),
) -> DataFrame:
    """Per side and instant its running number, its candidates, and the only one's number.

    Candidate pairs are never listed. What falls on one instant has the same candidates, so
    both sides are first counted by key and instant; ids stay out. The instants and the far
    ends of their intervals are laid on one time line per key and swept once: a running count
    of trades read at an order's start and end gives its number of candidates, and when that is
    one, the count at the end is the partner's running number. The same sweep answers for
    trades. A key with millions of rows costs the same per row as a quiet one, and spreads
    over its days. Rows without a key or an instant match nothing and are not counted.
    """
    keys = list(keys)
    span = F.expr(f"interval {window}")

    def marks(df: DataFrame, when: str, is_order: bool, *points: tuple[Column, int]) -> DataFrame:
        """Each instant of a side at both ends of its interval."""
        at = F.col(when).cast("timestamp")
        ends = F.array(
            *[F.struct(p.alias("__point"), F.lit(rank).alias("__rank")) for p, rank in points]
        )
        return (
            df.select(*keys, at.alias("__at"))
            .dropna()
            .groupBy(*keys, "__at")
            .agg(F.count(F.lit(1)).alias("__n"))
            .select(*keys, F.lit(is_order).alias("__is_order"), "__at", "__n", F.inline(ends))
        )

    # The rank settles equal instants: interval ends read before events, starts after them.
    at, rank = F.col("__at"), F.col("__rank")
    line = (
        marks(orders, "created_at", True, (at + span, 0), (at, 2))
        .unionByName(marks(trades, "ts", False, (at, 1), (at - span, 3)))
        .withColumn("__day", F.to_date("__point"))
    )
    swept = block_scan(
        line,
        keys,
        "__day",
        ["__point", "__rank"],
        {
            "__trades": ("sum", F.when(rank == 1, F.col("__n")).otherwise(0)),
            "__orders": ("sum", F.when(rank == 2, F.col("__n")).otherwise(0)),
        },
    )
    # Per instant: its own running number, and the other side's counts at its interval's ends.
    # The count at the far end is also the running number of the last candidate.
    sides = swept.groupBy(*keys, "__is_order", "__at").agg(
        F.max(F.when(rank == 2, F.col("__orders")).when(rank == 1, F.col("__trades"))).alias("own"),
        F.max(F.when(rank == 0, F.col("__trades")).when(rank == 1, F.col("__orders"))).alias("hi"),
        F.max(F.when(rank == 2, F.col("__trades")).when(rank == 3, F.col("__orders"))).alias("lo"),
    ).withColumn("candidates", F.col("hi") - F.col("lo"))
    return sides.withColumn("wants", F.when(F.col("candidates") == 1, F.col("hi")))


def matched_trades(
    counts: DataFrame,
    orders: DataFrame,
    trades: DataFrame,
    keys: Sequence[str] = ("symbol", "quantity"),
) -> DataFrame:
    """One row per trade with its order, if each is the other's only candidate. ``trades`` may be
    some of those counted; ``orders`` are all."""
    return _matched(counts, False, trades, orders, keys)


def matched_orders(
    counts: DataFrame,
    orders: DataFrame,
    trades: DataFrame,
    keys: Sequence[str] = ("symbol", "quantity"),
) -> DataFrame:
    """The same, one row per order."""
    return _matched(counts, True, orders, trades, keys)


def _matched(
    counts: DataFrame, is_order: bool, own: DataFrame, other: DataFrame, keys: Sequence[str]
) -> DataFrame:
    order, trade = ("order_id", "created_at"), ("trade_id", "ts")
    (ident, when), (partner, there) = (order, trade) if is_order else (trade, order)
    mine = counts.filter(F.col("__is_order") == is_order)
    # Who is alone in the other's interval is alone at that instant.
    theirs = counts.filter((F.col("__is_order") != is_order) & F.col("wants").isNotNull()).select(
        *keys,
        F.col("own").alias("__no"),
        F.col("wants").alias("__back"),
        F.col("__at").alias("__there"),
    )
    met = mine.withColumn("__no", F.col("wants")).join(theirs, [*keys, "__no"])
    ids = other.select(
        *keys, F.col(there).cast("timestamp").alias("__there"), F.col(partner).alias("__partner")
    )
    partners = (
        met.filter("__back = own")
        .select(*keys, "__at", "__there")
        .join(ids, [*keys, "__there"])
        .select(*keys, "__at", "__partner", F.lit(True).alias("__met"))
    )
    seen = mine.filter("candidates > 0").select(*keys, "__at", "candidates")
    seen = seen.join(partners, [*keys, "__at"], "left")
    rows = own.withColumn("__at", F.col(when).cast("timestamp"))
    return rows.join(seen, [*keys, "__at"], "left").select(
        ident,
        F.col("__partner").alias(partner),
        F.coalesce("candidates", F.lit(0)).alias("candidates"),
        F.when(F.col("__met"), "matched")
        .when(F.col("candidates") > 0, "ambiguous")
        .otherwise("unmatched")
        .alias("status"),
    )


def corroborate(trades: DataFrame, confirmations: DataFrame) -> DataFrame:
    """Statement trades against confirmations on symbol, instant, quantity and price.

    Exactly one confirmation must exist and its commission must agree to the cent. Both
    sides are counted per key first, so repeated keys never multiply.
    """
    keys = ["symbol", "ts", "quantity", "price"]
    cents = F.floor(F.col("commission") * 100 + 0.5)
    mine = trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"), F.min(cents).alias("__t0"), F.max(cents).alias("__t1")
    )
    theirs = confirmations.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("confirmations"),
        F.min(cents).alias("__c0"),
        F.max(cents).alias("__c1"),
    )
    same = (
        (F.col("__t0") == F.col("__c0"))
        & (F.col("__t1") == F.col("__c1"))
        & (F.col("__t0") == F.col("__t1"))
    )
    return (
        mine.join(theirs, keys, "full_outer")
        .fillna(0, ["trades", "confirmations"])
        .select(
            *keys,
            "trades",
            "confirmations",
            F.when(F.col("trades") == 0, "extra confirmation")
            .when(F.col("confirmations") == 0, "no confirmation")
            .when((F.col("confirmations") != 1) | (F.col("trades") != 1), "not unique")
            .when(~same, "commission differs")
            .otherwise("corroborated")
            .alias("verdict"),
        )
    )


def failure_streaks(
    runs: DataFrame,
    key: str,
    ts: str,
    failed: Column,
    tie: str,
    *,
    threshold: int = 3,
    block: Column | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Length of the current failure run, one alert per outage, and the recovery after it.

    Runs are unbounded per key, so positions come from block scans (of a day, or of ``block``)
    instead of one window. ``carried`` has a ``streak`` a key: the failures up to the first row.
    """
    block = F.to_date(F.col(ts)) if block is None else block
    rows = runs.select(key, ts, tie, failed.alias("failed")).withColumn("__day", block)
    numbered = block_scan(
        rows, [key], "__day", [ts, tie], {"__n": ("sum", F.lit(1).cast("bigint"))}
    )
    ok = F.when(~F.col("failed"), F.col("__n"))
    tracked = block_scan(
        numbered, [key], "__day", [ts, tie], {"__ok": ("max", ok)}, exclusive=True
    )
    start = F.lit(0)
    if carried is not None:
        tracked = tracked.join(carried.select(key, F.col("streak").alias("__c")), key, "left")
        start = -F.coalesce("__c", F.lit(0))
    before = F.col("__n") - 1 - F.coalesce("__ok", start)
    return tracked.select(
        key,
        ts,
        tie,
        "failed",
        F.when(F.col("failed"), before + 1).otherwise(0).alias("streak"),
        F.when(F.col("failed") & (before + 1 == threshold), "alert")
        .when(~F.col("failed") & (before >= threshold), "recovered")
        .otherwise("ok")
        .alias("event"),
    )


def stalled(orders: DataFrame, fills: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs that placed orders and saw none filled."""
    placed = orders.groupBy(*keys).agg(F.count(F.lit(1)).alias("orders"))
    done = fills.groupBy(*keys).agg(F.count(F.lit(1)).alias("fills"))
    return (
        placed.join(done, list(keys), "full_outer")
        .fillna(0, ["orders", "fills"])
        .withColumn("stalled", (F.col("orders") > 0) & (F.col("fills") == 0))
    )


def latest_pending(pending: DataFrame, explained: DataFrame) -> DataFrame:
    """Each portfolio's newest pending set, and which of its orders a statement explains.

    ``pending`` has ``portfolio, saved_at, order_id``; a later save replaces the whole set.
    """
    newest = pending.groupBy("portfolio").agg(F.max("saved_at").alias("saved_at"))
    marks = explained.select("order_id").distinct().withColumn("explained", F.lit(True))
    return (
        pending.join(newest, ["portfolio", "saved_at"], "left_semi")
        .join(marks, "order_id", "left")
        .fillna(False, ["explained"])
    )


# What must never leave the machine in a report.
REDACTIONS = (
    (r"(?i)\b(?:DU[T]?|U)\d+\b", "[ACCOUNT]"),
    (r"[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"https://hc-ping\.com/[\w-]+(?:/\w+)?", "[HEALTHCHECK_URL]"),
    (r"\b(?:re|gh[pousr]|github_pat)_[A-Za-z0-9_\-]{12,}\b", "[TOKEN]"),
    (
        r"(?im)(\b(?:jxBrowserKey|TWS_USERID|password|api_key|token|restart|IbLoginId"
        r"|FIXLoginId)\s*[=:]\s*)[^\s,;]+",
        "$1[REDACTED]",
    ),
)


def redact_text(text: Column | str, secrets: Sequence[str] = ()) -> Column:
    """Replace known secrets, account numbers, addresses, tokens and key=value secrets."""
    out = F.col(text) if isinstance(text, str) else text
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("[REDACTED]"))
    for pattern, replacement in REDACTIONS:
        out = F.regexp_replace(out, pattern, replacement)
    return out
