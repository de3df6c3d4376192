"""Time the headline queries; prints one JSON line.

Every result is written to the no-op sink, so all columns of all rows are
computed and none are collected.  ``BENCH_QUERIES`` picks other queries.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from quillmark.plans import catalog

HEADLINE = [
    "feature_means", "feat_base9", "feat_layout47", "feat_style19", "feat_tokens", "feat_bigrams", "feat_char_entropy",
    "feat_comment_text_ratio", "dist_generator_top10", "describe_length", "hist2d_length_label", "density_length",
    "undersample_group", "downsample_language", "stratified_folds", "shuffle_order", "class_report", "roc_auc",
    "multi_model_sweep", "topn_labels", "quantile_grid", "quantile_transform", "qda_score", "decision_surface",
    "head_tail_tokens", "logreg_balanced", "gbt_depth3", "iforest_pair",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("quillmark-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One small query first: JVM and Python workers start outside the clock.
    catalog.QUERIES["softmax_pair"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
