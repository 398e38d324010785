"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up the JVM and its plan cache, then is timed writing to the noop sink,
so the whole result is computed and nothing travels to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gatekit.catalog import SPARK  # noqa: E402
from gatekit.session import local_session  # noqa: E402

HEADLINE = (
    "action_summary", "observe", "gate_simple", "gate_full", "gate_metrics", "cost_metrics", "policy_metrics", "observer_metrics",
    "semantic_disagreement", "compose_pair", "certify_paths", "compose_chain", "drift_path", "tabular_route", "audit_decisions",
    "attribution_conflict", "objective_metrics", "level_summary", "ablation_modes", "calibrate_gate", "set_agreement",
    "series_stats", "classification_metrics", "rule_importance_lofo", "rule_importance_bootstrap", "bootstrap_ci",
    "counterevidence_counts", "action_rates", "triage_summary", "quality_conflict_gate", "rupture_gates", "impute", "mcnemar",
    "calibrate_by_objective", "calibrate_simplex", "compose_chain_fold", "skyline_candidates", "align_from_table", "action_rates_stream",
)


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    SPARK[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    n_lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(timed(spark, name, sf_dir), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    gate = seconds.get("gate_simple")
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
                "gate_cases_per_second": round(n_lines / gate) if gate else None,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
