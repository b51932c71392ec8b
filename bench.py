"""Times the headline queries; prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lotwise.plans import load_all  # noqa: E402
from lotwise.plans.registry import runner  # noqa: E402
from lotwise.session import build_session  # noqa: E402

HEADLINE = [
    "lot_verdict", "lot_pooled", "wilson_by_group", "photo_outcome", "outcome_tally", "touching_rule", "component_filter", "call_pair",
    "auroc", "spearman_by_grade", "operating_point", "coverage_curve", "pick_pair", "fit_temperature", "exact_dedupe", "keep_first",
    "near_dup_keep", "cross_source_nn", "knn_loo", "iou_pairs", "nearest_point", "stratified_split", "cap_per_group", "calibration_draw",
    "unusual_flags", "tray_sweep", "proto_fit", "batch_score", "last_n", "window_verdict", "session_lots", "otsu_by_group",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    reg = load_all()
    names = sys.argv[1:] or HEADLINE
    runner(reg["label_map"])(spark, folder).write.format("noop").mode("overwrite").save()  # start the JVM paths once
    times = {}
    for n in names:
        t0 = time.perf_counter()
        runner(reg[n])(spark, folder).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
