"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
One unrecorded query warms the JVM; then every query runs once, into the noop sink.
"""

from __future__ import annotations

import json
import os
import time

from notewise.plans import QUERIES
from notewise.session import local_session

HEADLINE = (
    "note_view", "trim_empty_bars", "seq_windows", "export_stats_rollup", "token_counts",
    "ngrams", "postings_idf", "bm25_topm", "bm25_recall_mrr", "bm25_pool_lse", "word_bm25_topm",
    "backbone_eval", "hierarchy_eval", "lifts", "pitch_class_js", "rhythm_closure",
    "suffix_mapping", "transpose", "span_mask", "ornament_pairs", "merge_delete",
    "uniform_time", "exact_k_path", "align_pairs",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, cpus, "notewise-bench")
    times = {}
    for name in (HEADLINE[0], *HEADLINE):
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    notes = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
        "cores": cpus, "shuffle_partitions": cpus, "notes": notes, "notes_per_sec_view": round(notes / times["note_view"]),
    }))


if __name__ == "__main__":
    main()
