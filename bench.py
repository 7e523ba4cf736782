"""Time the headline queries: BENCH_SF_DIR (default sf0.1) on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "A1_assemble_tasks", "A1_assemble_chained", "A3_core_metrics_by_model", "A3_core_metrics_levels",
    "A10_waste_total", "A13_leaderboard", "A38_receipt", "A14_output_contract", "A17_edge_cases",
    "A20_tool_order", "W3_golden_set", "C2_density_clusters", "A24_gap_report", "A25_window_stats",
    "A29_detect_drift", "W8_budget_prefix", "W12_stall_verdicts", "P20_inspect_documents", "S4_normalize",
    "W14_normalise_turns", "A36_bench_metrics",
)


def main() -> None:
    from winledger.queries import load
    from winledger.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = set(sys.argv[1:])
    spark = build_session("bench", master=f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    catalogue = load()

    def run(name: str) -> float:
        start = time.perf_counter()
        catalogue[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("A4_wilson")  # warm the session before anything is timed
    times = {n: round(run(n), 3) for n in HEADLINE if not only or n in only}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
