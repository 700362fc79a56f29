"""Seconds of each query of the engine, as one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from leafmill import catalog

d, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
spark.sparkContext.setLogLevel("ERROR")
spark.range(1).count()
took = {}
for name, query in catalog.QUERIES.items():
    began = time.time()
    query(spark, d).write.format("noop").mode("overwrite").save()
    took[name] = round(time.time() - began, 3)
print(json.dumps({"metric": "total query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")).removeprefix("sf")}))
