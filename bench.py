"""Time the headline queries: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS; prints one JSON line.

Each query is run BENCH_RUNS times to a no-op sink and its fastest run counts, so JVM warm-up
is not measured. `rates` relates runs to the packets or windows they process.
"""
import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from floodlens.plans.catalogue import QUERIES  # noqa: E402
from floodlens.session import build_session  # noqa: E402

HEADLINE = [
    "detection_by_attack_rule", "late_flag", "peer_windows", "peer_windows_late", "flow_view", "sequence_view",
    "count_windows", "labelled_windows", "labelled_flows", "packet_decode", "capture_windows", "host_slice",
    "sdn_flows", "undersample", "stratified_cap_lines", "verbatim_overlap_lines", "duplicate_share",
    "classification_report", "roc_auc", "detector_report", "knn_classify", "novelty_score", "pseudo_label",
    "block_decisions", "mitigation_summary", "totals", "stream_windows",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
    packets = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    rates = {f"{q}_packets_per_s": round(packets / times[q])
             for q in ("peer_windows", "flow_view", "sequence_view", "packet_decode", "capture_windows", "stream_windows") if q in times}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "rates": rates}))


if __name__ == "__main__":
    main()
