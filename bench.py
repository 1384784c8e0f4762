"""Times the headline queries and prints one JSON line.

Each query runs once to warm up and then ``RUNS`` times; the median counts.
``naive_*`` are the plain plans (nested loop, ranking of all pairs) that the
others are held against, as there are no published numbers.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from boxwright import queries as q
from boxwright.functions.geometry import box, distance_sq, point
from boxwright.operators import join, knn, range_query
from boxwright.plans import layout

RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    boxes = {n: q.fixture(spark, sf_dir, n).cache() for n in ("parcels", "zones", "windows", "probes", "stops")}
    for df in boxes.values():
        df.count()
    parcels, zones, windows, probes, stops = boxes.values()
    probes = probes.where("qid % 10 = 0")  # the naive ranking of all pairs would take minutes
    index = layout.build_index(parcels, 512)
    index = layout.Index(index.data.cache(), index.leaves.cache())
    index.data.count()

    def naive_knn():
        met = probes.join(F.broadcast(parcels)).withColumn("d", distance_sq(box(), point()))
        return met.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d", "id"))).where("rank <= 5")

    runs = {
        "build": lambda: layout.build_index(zones, 4096).data,
        "range_batch": lambda: range_query.range_pairs(parcels, windows),
        "range_points": lambda: range_query.range_pairs(stops, windows),
        "range_indexed": lambda: layout.index_range(index, windows),
        "range_single": lambda: range_query.range_single(parcels, (100, 100, 300, 300)),
        "knn_batch": lambda: knn.knn(parcels, probes, 5),
        "knn_indexed": lambda: knn.index_knn(index, probes, 5),
        "join": lambda: join.join_pairs(parcels, zones),
        "join_self": lambda: join.self_join(zones),
        "naive_knn": naive_knn,
        "naive_join": lambda: join.join_pairs(parcels, zones, strategy="nested"),
        "naive_range": lambda: range_query.range_pairs(parcels, windows, strategy="nested"),
        "naive_range_points": lambda: range_query.range_pairs(stops, windows, strategy="nested"),
    }
    took: dict[str, float] = {}
    for name, run in runs.items():
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            run().write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)
    asked = {"range_batch": windows, "range_points": windows, "range_indexed": windows, "knn_batch": probes, "knn_indexed": probes}
    each = {name: took[name] / max(1, df.count()) for name, df in asked.items()}
    total = sum(v for k, v in took.items() if not k.startswith("naive"))
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(total, 3), "unit": "sec", "queries": took, "seconds_per_query": {k: round(v, 7) for k, v in each.items()}, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
