"""Headline benchmark: seconds per query on the full tables, one JSON line.

Each query runs to completion through the ``noop`` sink, so every row is computed and none is
collected. Caches are dropped between queries; a first small run pays for JVM warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quantframe.catalog import load_all  # noqa: E402
from quantframe.session import build_session  # noqa: E402

HEADLINES = (
    "A02_upsert_bars",
    "B09_stamp_at_session_close",
    "C02_closes_as_of",
    "D02_asof_close",
    "D08_interval_match",
    "E09_rolling_beta",
    "E16_adf0_tstat",
    "E24_trend_targets",
    "F03_shrunk_covariance",
    "F08_dual_momentum",
    "F11_tranche",
    "F13_rebalance_orders",
    "F15_limit_filter",
    "G01_positions",
    "G02_cash_ledger",
    "G04_mark_book",
    "G09_interest_accrual",
    "G11_segment_nav",
    "G16_scaled_costs",
    "H06_drawdown_episodes",
    "H12_by_calendar_year",
    "H14_performance",
    "I02_run_sweep",
    "I04_block_bootstrap",
    "I05_paired_bootstrap",
    "J02_missing_sessions",
    "K01_roll_map",
    "L02_fill_divergence",
    "L03_dedupe_executions",
    "L10_failure_streak",
    "L13_redact_documents",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    catalog = load_all()
    warm = folder if not os.path.isdir("/root/testdata/sf0.001") else "/root/testdata/sf0.001"
    catalog["H14_performance"].run_fresh(spark, warm).write.format("noop").mode("overwrite").save()

    wanted = sys.argv[1:] or HEADLINES
    seconds: dict[str, float] = {}
    for name in wanted:
        spark.catalog.clearCache()
        begin = time.perf_counter()
        catalog[name].run_fresh(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
