"""Times the headline queries once warm and prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from joinloom.plans.strategy import tune
from joinloom.queries import QUERIES


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    if not os.environ.get("BENCH_DEFAULTS"):  # else Spark's own settings
        tune(spark)
    took = {}
    for name in sorted(QUERIES):
        times = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(sorted(times)[1], 4)
    print(json.dumps({"metric": "join queries, median of 3, noop sink", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir}))


if __name__ == "__main__":
    main()
