"""Times the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from checks.catalog import QUERIES
from checks.fixtures import Data
from trafficloom import build_session
from trafficloom.operators import rollup
from trafficloom.operators.parse import parse_access_log
from trafficloom.session import scratch_dir
from trafficloom.sources.access_log import read_lines

HEADLINE = (
    "parse_events",
    "minute_totals",
    "domain_minute",
    "client_minute",
    "client_category_minute",
    "rollup_tables",
    "hourly_rollup",
    "summary",
    "cache_efficiency",
    "timeseries_minute",
    "top_domains",
    "usage_by_category",
    "client_list",
    "client_summary",
    "domain_clients",
    "time_spent",
    "event_page",
    "period_comparison",
    "new_blocked_domain",
    "traffic_spike",
    "page_categories",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/events.parquet").count()
    # The events as log files of three branches, as the ingest would find them.
    logs = scratch_dir(spark, "bench-logs")
    Data(spark, folder).lines().repartition(int(cpus)).write.partitionBy("branch").text(logs)

    def parse_log_files(session, _folder):
        return parse_access_log(read_lines(session, logs))[0]

    runs = {"parse_log_files": parse_log_files, **{name: QUERIES[name] for name in HEADLINE}}
    seconds = {}
    for name, run in runs.items():
        best = float("inf")
        for _ in range(2):
            start = time.perf_counter()
            run(spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    slope = {}
    base = Data(spark, folder)
    rows = base.events.count()
    for times in (1, 10):
        # The same events under ten times the branches: ten times the rows and the keys.
        copies = F.explode(F.sequence(F.lit(1), F.lit(times)))
        events = base.events.withColumn("copy", copies).withColumn("branch", F.concat("branch", F.col("copy").cast("string")))
        lines = read_lines(spark, logs).withColumn("copy", copies).drop("copy")
        work = {
            "parse": [parse_access_log(lines)[0]],
            # All stored tables, four with sums and two of first visits, as a flush makes them.
            "rollups": [rollup.all_rollups(events, base.rules)],
        }
        for name, frames in work.items():
            start = time.perf_counter()
            for frame in frames:
                frame.write.format("noop").mode("overwrite").save()
            taken = time.perf_counter() - start
            slope[f"{name}_{times}x"] = {"sec": round(taken, 3), "rows_per_sec": round(rows * times / taken)}
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "slope": slope, "sf": scale}))


if __name__ == "__main__":
    main()
