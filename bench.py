"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores; names on
the command line replace the default selection, `--all` takes every registered query. The given tables are one file with one row
group each, which one core reads; before timing they are written once in BENCH_FILES files (default 16, 0: read as given), as tables
of any size lie on a cluster.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from veil.plans.derived import BASE
from veil.plans.registry import callable_for, load
from veil.session import build_session

HEADLINE = [
    "privacy_utility_by_setting", "correct_counts_by_axis", "location_resolution", "accuracy_and_certainty",
    "switch_statistics", "utility_backfill", "guess_correctness", "eval_table", "attack_match_classes",
    "sample_privacy_scores", "early_stop_rounds", "final_rounds", "metric_trends", "score_histogram",
    "round_robin_configs", "sentence_bleu", "rouge_1", "rouge_l", "set_bleu_and_rouge", "text_statistics",
    "entity_spans", "masked_asterisks", "generalised_text", "masked_contacts", "typed_answer_blocks",
    "quality_scores", "change_lists", "line_changes", "aligned_comments", "profile_comments", "profile_predictions",
    "log_records", "usage_report", "excess_calls", "coupled_skills", "execution_quality", "inference_prompts",
    "vector_similarity",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="veil-bench-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = load()
    label, files = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), int(os.environ.get("BENCH_FILES", "16"))
    if files:
        folder = tempfile.mkdtemp(prefix="veil-bench-tables-")
        for table in BASE:
            spark.read.parquet(f"{sf_dir}/{table}.parquet").repartition(files).write.parquet(f"{folder}/{table}.parquet")
        sf_dir = folder
    names = sys.argv[1:] or HEADLINE
    if names == ["--all"]:
        names = list(entries)
    callable_for(entries["privacy_utility_by_setting"])(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.perf_counter()
        callable_for(entries[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    out = {
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": label,
    }
    print(json.dumps(out), flush=True)


if __name__ == "__main__":
    main()
