"""Dual momentum over every decision date and every variant in one plan.

Signals are computed once per symbol for the *distinct* lookbacks, trend windows and
volatility windows of all variants. Variants are attached afterwards as exploded literals,
so a sweep adds rows on decision dates only and never repeats a signal window.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantframe.functions import literal_grid, round_at
from quantframe.operators import signals, sizing
from quantframe.operators.decisions import at_decisions
from quantframe.session import shared

VARIANT_DDL = (
    "variant string, lookbacks array<int>, top_n int, trend_window int, target_vol double,"
    " vol_lookback int, max_weight double, need int"
)

DEFAULTS: dict[str, Any] = {
    "lookbacks": (3, 6, 12),
    "top_n": 5,
    "trend_window": 200,
    "target_vol": 0.10,
    "vol_lookback": 60,
    "max_weight": 0.35,
}


def complete(variant: Mapping[str, Any]) -> dict[str, Any]:
    """Fill a variant's unset knobs with the defaults and reject unknown ones."""
    unknown = set(variant) - {*DEFAULTS, "variant", "cost_scale", "band", "cost_rate"}
    if unknown:
        raise KeyError(f"unknown parameter {sorted(unknown)}; known: {sorted(DEFAULTS)}")
    row = {**DEFAULTS, "variant": "base", **variant}
    row["need"] = signals.required_sessions(
        row["lookbacks"], 1, row["trend_window"], row["vol_lookback"]
    )
    return row


def signal_features(bars: DataFrame, variants: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Per-symbol features for the union of all variants' windows: one shuffle, one sort."""
    by = signals.by_symbol()
    months = sorted({m for v in variants for m in v["lookbacks"]})
    trends = sorted({v["trend_window"] for v in variants})
    vols = sorted({v["vol_lookback"] for v in variants})
    base = bars.select(
        "symbol",
        "session",
        "close",
        F.row_number().over(by).alias("n"),
        (F.col("close") / F.lag("close").over(by) - 1).alias("ret"),
        *[signals.momentum_column(m).alias(f"m{m}") for m in months],
        *[F.avg("close").over(signals.trailing(w)).alias(f"a{w}") for w in trends],
    )
    with_vol = base.select(
        "*", *[F.stddev_samp("ret").over(signals.trailing(v)).alias(f"v{v}") for v in vols]
    )
    to_map = lambda prefix, keys: F.create_map(
        *[x for k in keys for x in (F.lit(k), F.col(f"{prefix}{k}"))]
    )
    return with_vol.select(
        "symbol",
        "session",
        "close",
        "n",
        to_map("m", months).alias("mom"),
        to_map("a", trends).alias("sma"),
        to_map("v", vols).alias("vol"),
    )


def eligible_at(
    features: DataFrame,
    decisions: DataFrame,
    instruments: DataFrame,
    cash_symbol: str,
    days: DataFrame | None = None,
) -> DataFrame:
    """Features visible on each decision date for admitted, risky symbols.

    ``instruments`` may carry several admission policies, one row per ``admission`` and symbol;
    each policy is then ranked on its own.
    """
    dims = instruments.select(
        "symbol",
        "available_from",
        (F.col("admission") if "admission" in instruments.columns else F.lit("")).alias("admission"),
    )
    return (
        at_decisions(features, decisions, days=days)
        .filter(F.col("symbol") != cash_symbol)
        .join(dims, "symbol")
        .filter("available_from is null or as_of >= available_from")
        .drop("available_from")
    )


def scored(seen: DataFrame, variants: Sequence[Mapping[str, Any]]) -> DataFrame:
    """Blended average ranks per variant, date and symbol.

    Ranks depend on a variant only through its warm-up and its lookbacks, so they are made
    once per distinct pair and then looked up by every variant. One chain, no self-join.
    """
    pairs = sorted({(v["need"], m) for v in variants for m in v["lookbacks"]})
    per_pair = literal_grid(
        seen.select("admission", "as_of", "symbol", "n", "close", "mom", "sma", "vol"),
        [{"pair_need": a, "months": b} for a, b in pairs],
        "pair_need int, months int",
    ).filter("n >= pair_need")
    ranked = signals.average_rank(
        per_pair.withColumn("value", F.col("mom")[F.col("months")]).drop("mom"),
        ["admission", "pair_need", "months", "as_of"],
        "value",
    )
    same = ("n", "close", "sma", "vol")  # equal on every row of the group
    ranks = ranked.groupBy("admission", "pair_need", "as_of", "symbol").agg(
        F.map_from_entries(F.collect_list(F.struct("months", "rank"))).alias("ranks"),
        *[F.first(c).alias(c) for c in same],
    )
    each = literal_grid(ranks, variants, VARIANT_DDL).filter("need = pair_need").withColumn(
        "variant",
        F.when(F.col("admission") == "", F.col("variant")).otherwise(
            F.concat_ws("@", "variant", "admission")
        ),
    )
    size = Window.partitionBy("variant", "as_of")
    score = F.aggregate(
        "lookbacks", F.lit(0.0), lambda acc, m: acc + F.col("ranks")[m]
    ) / F.size("lookbacks")
    return (
        each.withColumn("score", score)
        .withColumn("__k", F.count(F.lit(1)).over(size))
        .filter("__k >= 2")
        .drop("__k", "ranks", "lookbacks", "pair_need", "admission")
    )


def selected(scores: DataFrame) -> DataFrame:
    """The leading symbols of each variant and date, with their trend verdict and vol."""
    w = Window.partitionBy("variant", "as_of").orderBy(F.col("score").desc(), "symbol")
    return (
        scores.withColumn("place", F.row_number().over(w))
        .filter("place <= top_n")
        .select(
            "variant",
            "as_of",
            "symbol",
            "n",
            "score",
            "place",
            (F.col("close") > F.col("sma")[F.col("trend_window")]).alias("passing"),
            F.col("vol")[F.col("vol_lookback")].alias("vol"),
            F.col("vol_lookback").alias("length"),
            "target_vol",
            "max_weight",
            "need",
        )
    )


def sized(picks: DataFrame, returns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inverse-vol weights scaled to the volatility target, and each book's risk.

    A selected symbol without measurable volatility stays in the frame at zero and failing,
    so a book made of nothing else still reports itself as all cash.
    """
    book = ["variant", "as_of"]
    inverse = F.when(F.col("vol") > 0, 1 / F.col("vol"))
    share = inverse / F.sum(inverse).over(Window.partitionBy(*book))
    relative = picks.withColumn("weight", round_at(share, 6))
    risk = sizing.book_risk(relative.filter("weight is not null"), returns, book)
    scaled = sizing.vol_target(relative.join(risk, book, "left"), F.col("target_vol"))
    weights = scaled.withColumn(
        "passing", F.col("passing") & F.col("weight").isNotNull()
    ).withColumn("weight", round_at(F.coalesce("weight", F.lit(0.0)) * F.col("scale"), 6))
    return weights, risk


def dual_momentum(
    bars: DataFrame,
    decisions: DataFrame,
    instruments: DataFrame,
    *,
    variants: Sequence[Mapping[str, Any]] = ({},),
    cash_symbol: str = "S00",
) -> DataFrame:
    """Target weights ``(variant, as_of, symbol, weight)`` for every decision date.

    A date without enough history has no rows (no opinion); a date on which everything fails
    the trend has one cash row (all cash). The two stay distinct.
    """
    rows = [complete(v) for v in variants]
    features = signal_features(bars, rows)
    seen = eligible_at(features, decisions, instruments, cash_symbol, days=bars)
    picks = shared(selected(scored(seen, rows)))
    weights, _ = sized(picks, sizing.numbered_returns(bars))
    return sizing.cap_and_cash(
        weights, ["variant", "as_of"], cash_symbol, F.col("max_weight")
    )
