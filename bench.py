"""Times the headline queries:  BENCH_SF_DIR, BENCH_CPUS -> one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("peak_events min_spacing match_events detection_metrics asof_scene_mode background_activity overlap_flags "
            "scene_groups scene_fanout decode_tracks assign_directions direction_metrics calibrate_activity uncertainty_table "
            "grouped_split leakage_check content_duplicates corpus_audit classify_path stft onset_features ema trailing_mean "
            "onset_targets extract_windows threshold_grid scene_cutoff balanced_order stratified_pick score_windows "
            "recent_events stream_generations window_tensors stream_events policy_driven_events scan_recordings calibrate_thresholds").split()


def main():
    from soundlake.plans import registry
    from soundlake.session import build_session
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", cpus, {"spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    # start the JVM's and the Python workers' code paths once, outside the timings
    queries["peak_events"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in wanted:
        started = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
