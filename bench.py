"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from checks.queries import queries  # noqa: E402

HEADLINE = (
    "mask_mentions", "token_count", "pack_paragraphs", "pack_sentences", "first_label_word", "prompt_few_shot",
    "prompt_roles", "running_totals", "dialogue_number", "speaker_number", "utterance_rows", "rebuild_conversation",
    "quota_walk", "sampled_segments", "shuffle_rank", "stratified_split", "bootstrap", "classification_report",
    "report_all_runs", "leaderboard", "fleiss_kappa", "describe_length", "batch_score", "predict_combined",
)


def run(df: DataFrame) -> float:
    start = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = os.environ.get("BENCH_QUERIES")
    names = wanted.split(",") if wanted else HEADLINE
    times = {}
    for name in names:
        taken = []
        for _ in range(repeats):
            start = time.perf_counter()
            run(queries()[name](spark, folder))
            taken.append(time.perf_counter() - start)
        # The first run warms up code generation and the file cache.
        times[name] = round(statistics.median(taken[1:] or taken), 4)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times,
        "sf": Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
