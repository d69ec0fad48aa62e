"""Time the headline queries and print one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query is run to the last row; nothing is kept
between queries but the tables the engine stores itself, and those are timed under `store_*` when they are built.
"""

import json
import os
import sys
import time

from wearline import catalog
from wearline.plans.site import STORED, open_site
from wearline.session import build_session

HEADLINE = (
    "risk_scores", "window_features", "station_health_current", "training_features", "kpi_maintenance",
    "work_orders_current", "delivery_exposure", "kpi_risk", "model_metrics", "lead_time", "score_spread_sample",
    "assign_technician", "create_work_orders", "what_if", "latency_hops", "duplicate_audit", "dq_rollup",
    "scorecard_kpis", "value_sensitivity", "grouped_recurrence", "silver_stream", "risk_scores_stream", "score_gbt",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cores}]", "wearline-bench", **{
        "spark.sql.shuffle.partitions": cores, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, action) -> None:
        began = time.time()
        action()
        seconds[name] = round(time.time() - began, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    site = open_site(spark, sf_dir)
    runs = catalog.queries()
    # Start-up of the JVM and its compiler is not part of any query: the first plans run once on the smallest data.
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    warm = os.path.isdir(small)
    for name in HEADLINE[:4] if warm else ():
        runs[name](spark, small).write.format("noop").mode("overwrite").save()
    for name in HEADLINE[:4]:
        timed(name, lambda: runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    for name in STORED:
        timed(f"store_{name}", lambda: site.table(name))
    for name in HEADLINE[4:]:
        timed(name, lambda: runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    readings = site.raw("sensor_readings").count()
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
        "readings": readings, "jvm_warmed_up": warm,
        "readings_per_sec_to_risk_score": round(readings / seconds["risk_scores"]),
        "readings_per_sec_streamed_to_silver": round(readings / seconds["silver_stream"]),
    }))


if __name__ == "__main__":
    main()
