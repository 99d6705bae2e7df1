"""Headline timings: one JSON line with seconds per query.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores. Results go to Spark's noop
sink, so that every output column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import REGISTRY
from foreunc.operators import evaluate
from foreunc.operators.design import spread
from foreunc.plans import ar_forecast
from foreunc.session import build_session

HEADLINE = [
    "daily_drivers_wide",
    "regular_time_grid",
    "design_matrix_b",
    "process_noise",
    "autoregressive_forecast",
    "memoryless_forecast",
    "forecast_scores",
    "site_scores",
    "one_at_a_time_autoregressive",
    "sobol_autoregressive",
    "sobol_memoryless",
    "sobol_by_date_linear",
    "series_autoregression",
    "series_sobol",
    "series_order_choice",
    "price_quantiles",
    "forest_ensemble_forecast",
]


SAMPLES, LEADS = 100_000, 36


def full_size_sobol(spark, folder):
    """Sobol indices of the recursion at the published size: 100,000 samples, 36 leads."""
    ids = spread(spark.range(1, SAMPLES + 1).withColumnRenamed("id", "sample_id"))
    spec = fx.spec(spark, folder)
    return ar_forecast.sobol_of_ar_model(
        ids, spec, fx.DRAWS, fx.region_drivers(spark, folder), fx.USED, LEADS
    )


def full_size_scores(spark, folder):
    """All scores of 100,000 members at 37 leads."""
    ensemble = spark.range(SAMPLES * (LEADS + 1)).select(
        (F.col("id") % (LEADS + 1)).cast("int").alias("lead"), fx.DRAWS.normal("y", "id").alias("y")
    )
    observed = spark.range(LEADS + 1).select(
        F.col("id").cast("int").alias("lead"), fx.DRAWS.normal("obs", "id").alias("obs")
    )
    return evaluate.scores(ensemble, observed)


FULL_SIZE = {"full_size_sobol": full_size_sobol, "full_size_scores": full_size_scores}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g"
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).mapInPandas(lambda frames: frames, "id bigint").count()
    seconds = {}
    for name in [*HEADLINE, *FULL_SIZE]:
        run = FULL_SIZE.get(name) or REGISTRY[name]
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else folder,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
