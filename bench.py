"""Headline queries on the driver tables; prints one JSON line.

``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8), ``BENCH_RUNS`` (default 1; the fastest counts). One query runs before the clock starts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark import get_session  # noqa: E402
from tidemark.catalog import all_queries  # noqa: E402

HEADLINES = [
    "asset_performance", "pct_change", "ffill", "quality_summary", "winsorize", "zscore", "rolling_kurt", "ewm_std", "macd", "rsi_wilder", "enhanced_features", "cross_sectional_rank_pct",
    "correlation", "var_historical", "ratios", "tail_exceedances", "risk_decomposition", "vol_regime", "transition_matrix", "regime_runs", "fuse_entropy", "generate_signals",
    "generate_signals_ridge", "size_proportional", "size_risk_parity", "backtest_metrics", "walk_forward_metrics", "bootstrap_poisson", "block_bootstrap", "scenario_risk",
    "stream_bars", "long_series_features", "regimes_per_asset",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            # small tables with heavy rows: keep partitions apart instead of merging them by bytes
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    qs, times = all_queries(), {}
    qs["asset_performance"](spark, sf).write.format("noop").mode("overwrite").save()
    for n in HEADLINES:
        best = None
        for _ in range(runs):
            t = time.time()
            qs[n](spark, sf).write.format("noop").mode("overwrite").save()
            best = min(time.time() - t, best or 1e9)
        times[n] = round(best, 3)
        print(f"{n}: {times[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))


if __name__ == "__main__":
    main()
