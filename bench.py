"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from auditspark.session import build_session  # noqa: E402
from checks import all_queries  # noqa: E402

HEADLINE = [
    "c24_parse_answers",
    "p6_parse_table",
    "t1_welch_per_model",
    "a2_raw_output_qc",
    "a4_prediction_vectors",
    "a6_model_summary",
    "a8_block_contrasts",
    "a9_model_block_contrasts",
    "a10_pooled_cohorts",
    "b5_row_averages",
    "j1_scores_by_job_key",
    "m2_quota_race",
    "m4_sample_within_blocks",
    "m7_balanced_sample",
    "p2_batch_scoring",
    "p10_token_summary",
    "t6_t7_block_contrast_summary",
    "t9_t10_confidence_correlation",
    "t11_permutation",
    "t14_paired_models",
    "t15_shapiro_wilk",
    "t17_ols_hc3_controls",
    "t18_absorbed_hc3",
    "k2_write_fifteen_tables",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark_sql_shuffle_partitions=cpus,
        spark_driver_memory=os.environ.get("BENCH_MEMORY", "16g"),
        spark_ui_showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    only = sys.argv[1:]
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
