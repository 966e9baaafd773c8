"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS], as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from tipoff.plans import registry

NAMES = ("season_efficiency", "schedule_strength", "adjusted_efficiency", "season_scores", "program_rankings", "coach_careers", "head_to_head", "seed_record", "coverage", "rate_limited")


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    queries, seconds = registry.queries(), {}
    queries[NAMES[0]](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    for name in NAMES:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
