"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]: one JSON line.

Each query runs once to warm up and compile, then once measured; results go to Spark's no-op sink.
Also reported: turns built per second and core.
"""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
sys.path.insert(0, ROOT)

HEADLINE = [
    "turn_segment", "turn_sentence", "row_assembly", "whisper_parse", "gap_percentiles", "gap_kde_valley", "span_label_profile",
    "causal_expand", "marker_expand", "query_time_grid", "varlen_packing", "wave_vad_end", "wave_resample", "sustained_speech",
    "metrics_by_language", "policy_sweep", "archive_join", "split_50_25_25",
]
# Timed as well, but not in the total, which stays comparable over the rounds.
MORE = ["asof_events", "filter_lowpass", "channel_trace", "exact_shards", "token_budget_packing", "external_scan"]


def main() -> None:
    from pyspark.sql import SparkSession

    from cadenza import plans

    data, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = plans.queries(), {}
    for name in HEADLINE + MORE:
        for _ in range(2):
            began = time.time()
            queries[name](spark, data).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - began, 3)
    more = {name: took.pop(name) for name in MORE}
    turns = queries["turn_sentence"](spark, data).count()
    rate = round(turns / took["row_assembly"] / int(cpus))
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "more": more, "sf": os.path.basename(data.rstrip("/")), "turns": turns, "turn_rows_per_second_and_core": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
