"""Benchmark: prints one JSON line with the seconds of each headline query.

Queries run over whole tables and write to Spark's no-op sink, so every row and column is
computed. The copy runs move a table of as many rows as `events` has through staging, gate,
upsert and publish; their source tables are prepared outside the clock.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tableferry import ColumnMapping, TaskSpec  # noqa: E402
from tableferry.operators import numbering  # noqa: E402
from tableferry.plans.copy_run import CopyPlan, run_copy  # noqa: E402
from tableferry.sources.publish import FolderTarget  # noqa: E402
from workload.jobs import JOBS  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "copy_orders_mapped",
    "spec_audit_parts",
    "mapping_issues",
    "target_ddl",
    "range_audit_lineitem",
    "canon_values",
    "target_rejects",
    "profile_numeric",
    "profile_text",
    "upsert_orders",
    "upsert_effect",
    "key_guard",
    "key_latest",
    "batch_contiguity",
    "table_digest",
    "reconcile_orders",
    "snapshot_diff",
    "page_rows",
    "batch_limits",
    "batch_payload",
    "payload_parse",
    "run_history",
    "run_measures",
    "batch_intake_stream",
    "live_runs_stream",
)
WIDE_TEXTS = 68


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tableferry-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return round(time.perf_counter() - start, 3)


def run_to_end(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def copy_sources(spark, root: str):
    """Narrow (3 columns) and wide (70 columns, 48 characters each) tables, written beforehand."""
    events = spark.read.parquet(f"{SF_DIR}/events.parquet")
    row_id = F.col("event_id").cast("decimal(8,0)").alias("row_id")
    narrow = events.select(row_id, F.col("props").alias("v_text"), F.col("ts").alias("d_biz"))
    texts = [
        F.substring(F.sha2(F.concat("props", F.lit(str(i)), F.col("event_id").cast("string")), 256), 1, 48).alias(f"c{i:02d}")
        for i in range(1, WIDE_TEXTS + 1)
    ]
    wide = events.select(row_id, F.col("ts").alias("d_biz"), *texts)
    for name, df in (("narrow", narrow), ("wide", wide)):
        df.repartition(int(CPUS)).write.parquet(f"{root}/{name}")
    return {name: spark.read.parquet(f"{root}/{name}") for name in ("narrow", "wide")}


def copy_plan(df, root: str, name: str) -> CopyPlan:
    columns = tuple(ColumnMapping(c, c.upper()) for c in df.columns)
    spec = TaskSpec("APP", name.upper(), name.upper(), ("ROW_ID",), columns)
    target = T.StructType([T.StructField(f.name.upper(), f.dataType) for f in df.schema.fields])
    return CopyPlan(spec, FolderTarget(f"{root}/target_{name}", target), f"{root}/staging_{name}")


def main() -> None:
    spark = session()
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.read.parquet(f"{SF_DIR}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in HEADLINE:
        seconds[name] = timed(lambda: run_to_end(JOBS[name](spark, SF_DIR)))
    for name, df in copy_sources(spark, root).items():
        plan = copy_plan(df, root, name)
        order = [F.col("row_id")]
        seconds[f"batches_{name}"] = timed(lambda: run_to_end(numbering.assign_batches(df, order, unique=True)))
        seconds[f"copy_{name}"] = timed(lambda: run_copy(spark, plan, df))
        seconds[f"upsert_{name}"] = timed(lambda: run_copy(spark, plan, df))
    line = {
        "metric": "total time of the headline queries and copy runs",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
        "copy_rows": spark.read.parquet(f"{SF_DIR}/events.parquet").count(),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
