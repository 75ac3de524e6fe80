"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpuslab.catalog import load
from corpuslab.session import get_session

HEADLINE = (
    "corpus_by_language", "character_budget", "corpus_union", "byte_level_word_counts",
    "char_encoded", "token_split", "stream_windows", "sampled_windows", "continuation_scores",
    "ending_accuracy", "numeric_accuracy_cued", "accuracy_by_language", "language_sweep",
    "running_means", "smoothed_series", "nucleus_filter", "softmax_weights",
    "top_values_with_ties", "best_choice", "document_vectors", "pair_evaluation",
    "similarity_correlation", "family_chart", "bpe_merges", "wordpiece_merges",
    "bpe_token_shards", "wordpiece_encoded", "sampled_loss",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    # the JVM and the Python workers start before the clock does
    queries["corpus_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
