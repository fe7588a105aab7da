"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the number of local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hearthline.plans.catalog import QUERIES  # noqa: E402
from hearthline.session import build_session, drop_staged  # noqa: E402

HEADLINES = [
    "repeat_sale_pairs",
    "validated_pairs",
    "half_pairs_by_tract_year",
    "area_index_monthly",
    "area_index_huber",
    "supertracts_by_year",
    "weights_all_types",
    "hierarchy_index",
    "quality_scores",
    "outlier_regression_statistics",
    "sensitivity_impact",
    "index_cbsa_value",
    "index_national_value",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
            "spark.ui.enabled": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One run starts the Python workers and warms the code cache.
    QUERIES["area_index_monthly"](spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in HEADLINES:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
        drop_staged(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
