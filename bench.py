"""Times the headline queries on the given tables and prints one JSON line.

BENCH_SF_DIR   folder of the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_QUERIES  comma-separated subset
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from basketry.operators.splits import kfold  # noqa: E402
from basketry.plans.model import cross_validate, param_grid  # noqa: E402
from basketry.session import RECOMMENDED_CONF, stage_scope  # noqa: E402
from workload import QUERIES  # noqa: E402
from workload.als import train_and_valid  # noqa: E402

HEADLINE = [
    "o045_market_preferences",
    "o045_preferences",
    "o057_chrono_split",
    "o007_dense_ids",
    "o026_attach_ids",
    "o030_dense_grid",
    "o033_merge_outer",
    "o038_sparsity",
    "o044_describe",
    "o048_basket_matrix",
    "o051_top_k",
    "o053_avg_rank_pct",
    "o072_ranking_metrics",
    "o075_mean_average_precision",
    "o080_auc",
    "o083_roem",
    "o085_diversity_metrics",
    "o091_item_similarity",
    "o092_bought_together",
    "o093_similar_by_attributes",
    "o094_similar_by_vector",
    "o097_revenue_per_order",
    "o061_fit_als",
    "o090_personalize",
]
BASELINE_GRID = {"rank": [10], "max_iter": [10], "reg": [0.05], "alpha": [50.0]}


def cv_baseline_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the baseline grid; only the held-out pairs are ranked, as in the baseline."""
    train, _ = train_and_valid(spark, sf_dir)
    return cross_validate(kfold(train), param_grid(BASELINE_GRID), candidates="observed")


def session(cpus: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("basketry-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="stages-"))
    )
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, run) -> float:
    with stage_scope(spark):
        started = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    runs = {name: QUERIES[name] for name in HEADLINE}
    runs["cv_baseline_grid"] = cv_baseline_grid
    wanted = os.environ.get("BENCH_QUERIES")
    if wanted:
        runs = {name: runs[name] for name in wanted.split(",")}
    spark.range(1000).write.format("noop").mode("overwrite").save()  # start-up is not measured
    times = {name: seconds(spark, lambda fn=fn: fn(spark, sf_dir)) for name, fn in runs.items()}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
