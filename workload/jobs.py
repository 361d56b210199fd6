"""The registered Spark jobs: every callable takes (spark, sf_dir) and reads whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry import ColumnMapping, Condition, OrderTerm, TaskSpec, apply_spec
from tableferry.functions import canon, runs, shapes
from tableferry.operators import batching, ddl, ddl_reader, digest_tree, mapping_audit, numbering, profile, range_audit, spec_audit, upsert, verify
from tableferry.plans import history
from tableferry.plans.copy_run import CopyPlan, CopyRefused, run_copy
from tableferry.scratch import scratch_path
from tableferry.sources import payload, runlog, staging, tables
from tableferry.sources.manifest import ManifestTarget
from tableferry.sources.publish import FolderTarget
from tableferry.streaming import intake, live, sequence
from tableferry.streaming.commit import CommitRefused as DiscardedRun
from tableferry.streaming.commit import IntakeCommit, RunStates
from workload.fixtures import fixture

JOBS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def job(function):
    JOBS[function.__name__] = function
    return function


# --- a copy task over one table ---------------------------------------------------------------

ORDERS_TASK = TaskSpec(
    owner="SALES",
    table="ORDERS",
    target_table="ORDER_COPY",
    primary_key=("ORDER_ID",),
    columns=(
        ColumnMapping("o_orderkey", "ORDER_ID"),
        ColumnMapping("o_custkey", "CUSTOMER_ID"),
        ColumnMapping("o_totalprice", "AMOUNT"),
        ColumnMapping("o_orderdate", "ORDERED_AT"),
    ),
    conditions=(
        Condition("o_orderstatus", "eq", "text", "STATUS", "constant", "F"),
        Condition("o_totalprice", "gt", "number", "FLOOR_PRICE", "runtime"),
        Condition("o_orderdate", "lt", "date", "BEFORE_DAY", "runtime"),
    ),
    order_by=(OrderTerm("o_totalprice", "desc"), OrderTerm("o_orderkey")),
)
ORDERS_PARAMS = {"FLOOR_PRICE": "1000.50", "BEFORE_DAY": "1999-07-01"}


@job
def copy_orders_mapped(spark, sf):
    return apply_spec(fixture(spark, sf, "orders_base"), ORDERS_TASK, ORDERS_PARAMS)


@job
def copy_run_orders(spark, sf):
    """A whole run: audit of values, numbered staging, gates, upsert and publish into a target."""
    root = scratch_path(spark, "copy-run")
    start = fixture(spark, sf, "orders_target")
    target = FolderTarget(f"{root}/target", start.schema)
    target.publish(start, "20231231000000_000000")
    names = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    spec = TaskSpec(
        owner="SALES", table="ORDERS", target_table="ORDER_COPY", primary_key=("o_orderkey",),
        columns=tuple(ColumnMapping(n, n) for n in names),
        conditions=ORDERS_TASK.conditions, order_by=ORDERS_TASK.order_by,
    )
    plan = CopyPlan(
        spec, target, f"{root}/staging", checks=[range_audit.RangeCheck("o_totalprice", 10, 2)],
        defaults={"o_note": "new"}, numbered=True, log_folder=f"{root}/log",
    )
    run_copy(spark, plan, fixture(spark, sf, "orders_base"), ORDERS_PARAMS, run_id="20240102030405_0a1b2c")
    return target.read(spark)


@job
def copy_run_log(spark, sf):
    """The batches that a numbered copy of all orders logs about itself."""
    root = scratch_path(spark, "copy-log")
    orders = fixture(spark, sf, "orders_base")
    spec = TaskSpec("SALES", "ORDERS", "ORDER_COPY", ("o_orderkey",), tuple(ColumnMapping(n, n) for n in orders.columns))
    plan = CopyPlan(spec, FolderTarget(f"{root}/target", orders.schema), f"{root}/staging", numbered=True, log_folder=f"{root}/log")
    run_copy(spark, plan, orders, run_id="20240102030405_0a1b2c")
    lines = runlog.read_log(spark, f"{root}/log/*/*", runlog.RECORD_FOLDER)
    states = history.combine_states(history.fold_states(lines))
    return states.select(
        "run_record_id", "run_id", "outcome", "target_table_effect", "stage", "staging_table", "source_rows", "staged_rows", "rows_pushed",
        (F.col("seq") == lines.agg(F.max("seq")).first()[0]).alias("last_is_largest"),
    )


@job
def copy_run_guarded(spark, sf):
    """Every cell that a copy of all orders refuses because its target would round it; nothing is published."""
    root = scratch_path(spark, "copy-guarded")
    orders = fixture(spark, sf, "orders_base").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    target = FolderTarget(f"{root}/target", T.StructType().add("ORDER_ID", orders.schema["o_orderkey"].dataType).add("AMOUNT", "decimal(12,1)"))
    # The mapping spells the target's columns in another case.
    spec = TaskSpec("SALES", "ORDERS", "ORDER_COPY", ("order_id",), (ColumnMapping("o_orderkey", "order_id"), ColumnMapping("o_totalprice", "Amount")))
    try:
        run_copy(spark, CopyPlan(spec, target, f"{root}/staging"), orders, run_id="20240102030405_0a1b2c")
    except CopyRefused as refused:
        assert target.current(spark) is None
        return spark.read.parquet(refused.path)
    raise AssertionError("the copy would have changed values")


@job
def publish_touched_buckets(spark, sf):
    """The target after a whole copy and a second run of changed and new orders, with the files' own word on
    which rows lie in buckets that the second run wrote."""
    root = scratch_path(spark, "touched")
    orders = fixture(spark, sf, "orders_base").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("o_totalprice"))
    target = ManifestTarget(f"{root}/target", orders.schema, ("o_orderkey",), buckets=64)
    spec = TaskSpec("SALES", "ORDERS", "ORDER_COPY", ("o_orderkey",), tuple(ColumnMapping(n, n) for n in orders.columns))
    plan = CopyPlan(spec, target, f"{root}/staging")
    later = "20240103030405_0a1b2c"
    run_copy(spark, plan, orders.filter("o_orderkey % 10 <> 3"), run_id="20240102030405_0a1b2c")
    few = orders.filter("o_orderkey % 1000 IN (3, 8)").withColumn("o_totalprice", (F.col("o_totalprice") + 1).cast("decimal(12,2)"))
    run_copy(spark, plan, few, run_id=later)
    return target.read(spark).select("*", F.col("_metadata.file_path").contains(f"run={later}").alias("rewritten"))


@job
def copy_run_gate_failed(spark, sf):
    """History of a run that the gate stopped: customers repeat among the orders, so they are no key."""
    root = scratch_path(spark, "copy-gate")
    orders = fixture(spark, sf, "orders_base").select("o_custkey", "o_orderkey")
    spec = TaskSpec("SALES", "ORDERS", "ORDER_COPY", ("o_custkey",), tuple(ColumnMapping(n, n) for n in orders.columns))
    plan = CopyPlan(spec, FolderTarget(f"{root}/target", orders.schema), f"{root}/staging", log_folder=f"{root}/log")
    repeated = spark.range(1).select(F.lit(0).cast("bigint").alias("repeated"))
    try:
        run_copy(spark, plan, orders, run_id="20240102030405_0a1b2c")
    except CopyRefused as refused:
        repeated = spark.read.parquet(refused.path).agg(F.count("*").alias("repeated"))
    states = history.combine_states(history.fold_states(runlog.read_log(spark, f"{root}/log/*/*", runlog.RECORD_FOLDER)))
    return states.select("outcome", "target_table_effect", "stage", "failure_kind", "sink_code").crossJoin(repeated)  # one row each


@job
def staging_replay(spark, sf):
    """Batches staged, then some of them sent again: each is there once, in its later form."""
    path = scratch_path(spark, "staging-replay")
    rows = _numbered_batches(spark, sf).select(
        F.lit("20240102030405_0a1b2c").alias("run_id"), "batch_no", "o_orderkey", F.lit("first").alias("sent")
    )
    staging.replace_batches(rows, path)
    late = rows.join(rows.groupBy("run_id").agg(F.max("batch_no").alias("batch_no")), ["run_id", "batch_no"])
    staging.replace_batches(late.select("run_id", "batch_no", "o_orderkey", F.lit("again").alias("sent")), path)
    return spark.read.parquet(path).select("run_id", F.col("batch_no").cast("bigint"), "o_orderkey", "sent")


@job
def staged_counts(spark, sf):
    """Rows and batches per run, counted in one pass over the staged rows."""
    rows = _numbered_batches(spark, sf).select(F.col("o_orderstatus").alias("run_id"), "batch_no")
    per_batch = rows.groupBy("run_id", "batch_no").agg(F.count("*").alias("rows"))
    return per_batch.groupBy("run_id").agg(F.sum("rows").alias("staged_rows"), F.count("*").alias("received_batches"))


@job
def spec_audit_parts(spark, sf):
    return spec_audit.audit_specs(_specs(spark, sf))


def _specs(spark, sf) -> DataFrame:
    rows = fixture(spark, sf, "spec_rows")

    def mapping(i):
        return F.struct(F.col(f"column_{i}").alias("source"), F.col(f"target_{i}").alias("target"))

    def condition(i):
        return F.struct(
            F.lit("P_SIZE").alias("column"),
            F.col(f"parameter_{i}").alias("parameter"),
            F.col("value_source_1").alias("value_source"),
            F.col("constant_1").alias("constant"),
        )

    return rows.select(
        "spec_id", "owner", "table_name", "dblink", "target_table",
        F.array_compact(F.array("key_1", "key_2")).alias("primary_key"),
        F.array(*[mapping(i) for i in (1, 2, 3, 4)]).alias("columns"),
        F.array(condition(1), condition(2)).alias("conditions"),
        F.array(F.struct(F.col("column_3").alias("column"))).alias("order_by"),
    )


@job
def run_params_audit(spark, sf):
    rows = fixture(spark, sf, "spec_rows").select(
        F.col("spec_id").alias("run_id"),
        F.array_distinct(F.array("parameter_1", "parameter_2")).alias("declared"),
        F.create_map(F.lit("DAY"), F.col("constant_1"), F.upper("table_name"), F.col("constant_1")).alias("params"),
    )
    return spec_audit.audit_run_params(rows)


# --- metadata ----------------------------------------------------------------------------------


def _tasks(spark, sf) -> DataFrame:
    return fixture(spark, sf, "task_keys").select(
        "task", "target_table", F.array_compact(F.array("key_1", "key_2")).alias("key_columns")
    )


def _source_columns(spark, sf) -> DataFrame:
    return fixture(spark, sf, "source_columns").drop("brand", "p_size")


def _unique_keys(spark, sf) -> DataFrame:
    rows = fixture(spark, sf, "unique_key_rows")
    index_columns = rows.select("task", "key_name", F.posexplode(F.array_compact(F.array("key_1", "key_2"))).alias("seq", "column_name"))
    return tables.unique_keys(index_columns.withColumn("non_unique", F.lit(0)))


@job
def derive_shapes(spark, sf):
    shape = F.col("shape")
    return shapes.with_shape(_source_columns(spark, sf)).select(
        "task", "ordinal", "column_name", F.col("source").alias("source_text"),
        shape["family"].alias("family"), shape["rejection"].alias("rejection"),
        shapes.shape_text().alias("shape_text"),
    )


@job
def support_tier(spark, sf):
    return (
        shapes.with_shape(_source_columns(spark, sf))
        .withColumn("by_date", shapes.may_filter_by_date(F.col("type_name"), F.col("fsp")))
        .groupBy("task", F.col("shape.support").alias("support"))
        .agg(F.count("*").alias("columns"), F.count_if("by_date").alias("date_filter_columns"))
    )


@job
def reject_reasons(spark, sf):
    rejection = F.col("shape.rejection")
    return (
        shapes.with_shape(_source_columns(spark, sf))
        .filter(rejection.isNotNull())
        .groupBy(rejection.alias("rejection"))
        .agg(F.count("*").alias("columns"))
        .withColumn("suggestion", F.expr(shapes.lookup("rejection", 2)))
    )


@job
def dictionary_source(spark, sf):
    """Source metadata from a dictionary view, with TIMESTAMP(n) spelled the dictionary's way."""
    rows = fixture(spark, sf, "source_columns")
    kind, fsp = F.upper("type_name"), F.col("fsp")
    spelled = F.when((kind == "TIMESTAMP") & fsp.isNotNull(), F.concat(F.lit("TIMESTAMP("), fsp.cast("string"), F.lit(")")))
    dictionary = rows.select(
        F.lit("APP").alias("owner"), F.col("task").alias("table_name"), F.col("ordinal").alias("column_id"), "column_name",
        F.coalesce(spelled, kind).alias("data_type"), F.col("precision").alias("data_precision"),
        F.when(kind == "TIMESTAMP", fsp).otherwise(F.col("scale")).alias("data_scale"),
        F.col("length").alias("char_length"), F.lit("Y").alias("nullable"),
    )
    return tables.dictionary_columns(dictionary)


@job
def dictionary_target(spark, sf):
    """Target metadata from INFORMATION_SCHEMA.COLUMNS."""
    c = F.col
    schema = fixture(spark, sf, "target_columns").select(
        F.lit("shop").alias("table_schema"), c("task").alias("table_name"), c("ordinal").alias("ordinal_position"), "column_name",
        "column_type", "data_type", c("precision").alias("numeric_precision"), c("scale").alias("numeric_scale"),
        c("length").alias("character_maximum_length"), "datetime_precision",
        F.when(c("nullable"), "YES").otherwise("NO").alias("is_nullable"), c("character_set").alias("character_set_name"),
        c("default_value").alias("column_default"), F.nullif(c("extra"), F.lit("")).alias("extra"),
    )
    return tables.dictionary_target_columns(schema)


@job
def column_alignment(spark, sf):
    aligned = mapping_audit.align_columns(_source_columns(spark, sf), fixture(spark, sf, "target_columns"))
    return aligned.select("task", "ordinal", "column_name", F.col("t.column_type").alias("target_type"))


@job
def unmapped_targets(spark, sf):
    return mapping_audit.unmapped_targets(
        _source_columns(spark, sf), fixture(spark, sf, "target_columns")
    ).select("task", "column_name", "column_type")


@job
def unique_key_columns(spark, sf):
    return _unique_keys(spark, sf).select("task", "key_name", F.array_join("key_columns", ",").alias("key_columns"))


@job
def mapping_issues(spark, sf):
    return mapping_audit.mapping_issues(
        _tasks(spark, sf), _source_columns(spark, sf), fixture(spark, sf, "target_columns"), _unique_keys(spark, sf)
    )


@job
def target_ddl(spark, sf):
    columns = fixture(spark, sf, "source_columns").select(
        "task", "ordinal", "column_name", "type_name", "precision", "scale", "length", "fsp",
        F.when(F.col("brand") > 12, F.col("p_size") + 20).alias("hint_precision"),
        F.when(F.col("brand") > 12, F.lit(4).cast("bigint")).alias("hint_scale"),
    )
    return ddl.target_ddl(_tasks(spark, sf), columns)


@job
def target_ddl_accepted(spark, sf):
    """DDL of the columns that have a target shape or wait for a declared one."""
    columns = _source_columns(spark, sf)
    accepted = shapes.with_shape(columns).filter(F.col("shape.rejection").isNull()).select(*columns.columns)
    tasks = _tasks(spark, sf).withColumn("key_columns", F.array(F.lit("C1")))
    return ddl.target_ddl(tasks, accepted)


@job
def ddl_round_trip(spark, sf):
    """DDL made from source columns, read back and audited against them: as made, and with three things changed."""
    columns = fixture(spark, sf, "source_columns").select(
        "task", "ordinal", "column_name", "type_name", "precision", "scale", "length", "fsp",
        F.lit(20).cast("bigint").alias("hint_precision"), F.lit(4).cast("bigint").alias("hint_scale"),
    )
    # The first column of a name that has a target shape or gets a declared one.
    place = Window.partitionBy("task", F.upper("column_name")).orderBy("ordinal")
    fitting = shapes.with_shape(columns).filter(F.col("shape.rejection").isNull())
    columns = fitting.withColumn("nth", F.row_number().over(place)).filter("nth = 1").select(*columns.columns)
    variant = F.explode(F.array(F.lit("made"), F.lit("changed"))).alias("variant")
    columns = columns.select("*", variant).withColumn("task", F.concat_ws("/", "task", "variant")).drop("variant")
    tasks = fixture(spark, sf, "task_keys").select("task", variant).select(
        F.concat_ws("/", "task", "variant").alias("task"), F.concat(F.lit("T_"), "task").alias("target_table"), F.array(F.lit("C1")).alias("key_columns")
    )
    changed = F.expr(
        "replace(replace(regexp_replace(ddl, ',\\\\s*PRIMARY KEY[^)]*[)]', ''), 'DATETIME(6)', 'DATETIME(3)'), 'utf8mb4', 'latin1')"
    )
    texts = ddl.target_ddl(tasks, columns).filter("ddl IS NOT NULL").select(
        "task", F.when(F.col("task").endswith("/changed"), changed).otherwise(F.col("ddl")).alias("ddl")
    )
    path = scratch_path(spark, "ddl-texts")
    texts.write.parquet(path)
    texts = spark.read.parquet(path)
    read = ddl_reader.read_columns(texts)
    known = texts.select("task")
    issues = mapping_audit.mapping_issues(
        tasks.join(known, "task", "left_semi"), columns.join(known, "task", "left_semi"), read, ddl_reader.read_keys(texts)
    )
    rules = issues.groupBy("task", "rule").agg(F.count("*").alias("n")).groupBy("task").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "rule", F.col("n").cast("string")))), ",").alias("rules")
    )
    counted = read.groupBy("task").agg(F.count("*").alias("columns"))
    return counted.join(rules, "task", "left").select(
        F.split_part("task", F.lit("/"), F.lit(1)).alias("task"), F.split_part("task", F.lit("/"), F.lit(2)).alias("variant"),
        "columns", F.coalesce("rules", F.lit("")).alias("rules"),
    )


@job
def staging_ddl(spark, sf):
    run_id = F.lit("20240102030405_0a1b2c")
    return ddl.staging_ddl(fixture(spark, sf, "target_columns"), run_id, F.concat(F.lit("T_"), F.col("task")))


@job
def range_check_plan(spark, sf):
    return mapping_audit.range_check_plan(_source_columns(spark, sf), fixture(spark, sf, "target_columns"))


@job
def range_verdict(spark, sf):
    planned = range_check_plan(spark, sf)
    # Results of a scan as a sink would get them: one per column, some missing, some for other columns.
    measured = fixture(spark, sf, "source_columns").filter("type_name = 'number' OR brand = 25").select(
        "task", "column_name", F.when(F.col("p_size") > 30, F.col("p_size")).otherwise(0).alias("invalid_rows")
    )
    return mapping_audit.range_verdict(planned, measured)


@job
def type_census(spark, sf):
    return profile.type_census(_source_columns(spark, sf))


@job
def unsupported_types(spark, sf):
    return profile.unsupported_types(_source_columns(spark, sf))


@job
def orphan_staging(spark, sf):
    names = fixture(spark, sf, "events").select(
        F.when(F.col("event_type") == "view", F.concat(F.lit("plain_"), F.col("event_id").cast("string")))
        .otherwise(runs.staging_name(F.upper("event_type"), _event_run_id()))
        .alias("table_name")
    )
    live_runs = fixture(spark, sf, "events").filter("event_type = 'click'").select(_event_run_id().alias("run_id"))
    return tables.orphan_staging(names, live_runs)


def _event_run_id():
    stamp = F.regexp_replace(canon.date_text(F.col("ts")), "[^0-9]", "")
    return F.concat(stamp, F.lit("_"), F.lower(F.lpad(F.hex(F.col("event_id")), 6, "0")))


# --- values ------------------------------------------------------------------------------------

LINEITEM_CHECKS = (
    range_audit.RangeCheck("l_quantity", 3, 1),
    range_audit.RangeCheck("l_extendedprice", 7, 1),
    range_audit.RangeCheck("l_discount", 3, 2),
    range_audit.RangeCheck("l_tax", 38, 4),
    range_audit.RangeCheck("l_orderkey", 4, 0),
    range_audit.RangeCheck("price_text", 6, 2),
)


@job
def range_audit_lineitem(spark, sf):
    rows = fixture(spark, sf, "lineitem_base").withColumn("price_text", canon.number_text(F.col("l_extendedprice")))
    return range_audit.range_audit(rows, LINEITEM_CHECKS)


@job
def canon_values(spark, sf):
    text = canon.number_text(F.col("o_totalprice"))
    return fixture(spark, sf, "orders_base").select(
        "o_orderkey",
        text.alias("price_text"),
        canon.date_text(F.col("o_orderdate")).alias("day_text"),
        canon.canon_number(text).isNotNull().alias("canonical"),
        canon.integer_digits(text).cast("bigint").alias("integer_digits"),
        canon.fraction_digits(text).cast("bigint").alias("fraction_digits"),
        canon.fits_decimal(text, 7, 1).alias("fits"),
    )


@job
def canon_timestamps(spark, sf):
    ts, k = F.col("ts"), F.col("event_id")
    parts = [F.year(ts), F.month(ts), (k % 33).cast("int"), F.hour(ts), F.minute(ts), (k % 62).cast("int")]
    return fixture(spark, sf, "events").select(
        "event_id",
        canon.timestamp_text(ts).alias("as_is"),
        canon.canon_date(*parts).alias("as_date"),
        canon.canon_timestamp(*parts, (k * 500).cast("bigint")).alias("as_timestamp"),
    )


@job
def canon_rejects(spark, sf):
    # Prices as a drifting source session might spell them.
    fixed = F.col("o_totalprice").cast("string")
    spelled = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("+"), fixed))
        .when(F.col("o_orderpriority") == "2-HIGH", fixed)
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.replace(fixed, F.lit("."), F.lit(",")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(canon.number_text(F.col("o_totalprice")), F.lit("\n")))
        .otherwise(canon.number_text(F.col("o_totalprice")))
    )
    rows = fixture(spark, sf, "orders_base").select("o_orderkey", spelled.alias("price"))
    return range_audit.reject_rows(rows, ["o_orderkey"], range_audit.canonical_rules(rows, ["price"]))


@job
def target_rejects(spark, sf):
    rows = fixture(spark, sf, "events").select(
        "event_id",
        canon.number_text(F.col("value").cast("decimal(18,2)")).alias("amount"),
        F.when(F.col("event_type") == "view", F.regexp_replace(canon.date_text(F.col("ts")), "-01 ", "-32 "))
        .otherwise(canon.date_text(F.col("ts"))).alias("moment"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("event_id").cast("string")).alias("number"),
        F.col("props").alias("note"),
    )
    rules = [
        range_audit.decimal_target_rule("amount", 4, 2),
        range_audit.decimal_target_rule("number", 5, 0),
        range_audit.datetime_target_rule("moment"),
        range_audit.varchar_target_rule("note", 8),
    ]
    found = range_audit.reject_rows(rows, ["event_id"], rules)
    return found.withColumn("code", range_audit.target_code(F.col("reason")))


@job
def silent_rounding(spark, sf):
    rows = fixture(spark, sf, "lineitem_base").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", canon.number_text(F.col("l_discount")).alias("discount")
    )
    rules = [range_audit.decimal_target_rule("discount", 2, 1)]
    return range_audit.reject_rows(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], rules)


@job
def profile_numeric(spark, sf):
    return profile.profile_numeric(
        fixture(spark, sf, "lineitem_base"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )


@job
def profile_time(spark, sf):
    one = profile.profile_time(fixture(spark, sf, "events"), ["ts"])
    return one.unionByName(profile.profile_time(fixture(spark, sf, "lineitem"), ["l_shipdate"]))


@job
def profile_text(spark, sf):
    one = profile.profile_text(fixture(spark, sf, "documents"), ["text", "lang", "source"])
    return one.unionByName(profile.profile_text(fixture(spark, sf, "customer"), ["c_name", "c_mktsegment"]))


# --- upsert and checks -------------------------------------------------------------------------


def _staged_orders(spark, sf) -> DataFrame:
    return fixture(spark, sf, "orders_base")


def _merged_orders(spark, sf) -> DataFrame:
    return upsert.upsert(fixture(spark, sf, "orders_target"), _staged_orders(spark, sf), ["o_orderkey"], {"o_note": "new"})


@job
def upsert_orders(spark, sf):
    return _merged_orders(spark, sf).withColumnRenamed("_effect", "effect")


@job
def upsert_effect(spark, sf):
    return upsert.effect_counts(_merged_orders(spark, sf))


@job
def upsert_allkeys(spark, sf):
    keys = ["o_custkey", "o_orderkey"]
    target = fixture(spark, sf, "orders_target").select(*keys)
    return upsert.insert_new(target, _staged_orders(spark, sf).select(*keys), keys)


@job
def key_guard(spark, sf):
    return upsert.key_report(fixture(spark, sf, "lineitem_base"), ["l_orderkey", "l_linenumber"])


@job
def duplicate_keys(spark, sf):
    return upsert.duplicate_keys(fixture(spark, sf, "lineitem_base"), ["l_orderkey", "l_linenumber"])


@job
def key_latest(spark, sf):
    order = [OrderTerm("l_shipdate"), OrderTerm("l_extendedprice", "desc")]
    return upsert.keep_latest(fixture(spark, sf, "lineitem_base"), ["l_orderkey", "l_linenumber"], order)


@job
def order_statistic_bytes(spark, sf):
    rows = fixture(spark, sf, "lineitem_base").select("l_returnflag", (F.col("l_extendedprice") * 100).cast("bigint").alias("cents"))
    return history.order_statistic(rows, ["l_returnflag"], "cents", "middle")


def _numbered_batches(spark, sf) -> DataFrame:
    return numbering.number_batches(fixture(spark, sf, "orders_base"), [F.col("o_orderkey")], unique=True)


@job
def verify_gate(spark, sf):
    counts = fixture(spark, sf, "log_lines").filter("event = 'run_finished'").select(
        F.concat("run_record_id", F.lit("/"), F.col("pos").cast("string")).alias("run_id"), "source_rows", "source_batches",
        F.when(F.col("value").isNull(), F.col("staged_rows")).otherwise(F.col("source_rows")).alias("staged_rows"),
        F.col("source_rows").alias("sink_reported_rows"),
        F.when(F.col("source_batches") == 99, F.lit(98)).otherwise(F.col("received_batches")).cast("bigint").alias("received_batches"),
    )
    return verify.verify_gate(counts)


@job
def batch_contiguity(spark, sf):
    rows = fixture(spark, sf, "lineitem_base").select(
        F.concat("l_returnflag", F.lit("-"), "l_linestatus", F.lit("-"), F.col("l_suppkey").cast("string")).alias("run_id"),
        F.col("l_linenumber").alias("batch_no"),
    )
    expected = rows.select("run_id").distinct().withColumn("source_batches", F.lit(7).cast("bigint"))
    return verify.batch_contiguity(rows, expected)


@job
def sequence_gaps(spark, sf):
    rows = fixture(spark, sf, "log_lines").filter("event = 'batch_pushed'")
    return numbering.sequence_gaps(rows.select(F.col("run_record_id").alias("run_id"), F.col("seq").alias("batch_no")))


DIGEST_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@job
def table_digest(spark, sf):
    return verify.table_digest(fixture(spark, sf, "orders_base"), DIGEST_COLUMNS)


@job
def rerun_digest(spark, sf):
    """The digest after one copy and after the same copy again."""
    once = _merged_orders(spark, sf).drop("_effect")
    twice = upsert.upsert(once, _staged_orders(spark, sf), ["o_orderkey"], {"o_note": "new"}).drop("_effect")
    one = verify.table_digest(once, DIGEST_COLUMNS).withColumn("copy", F.lit(1))
    return one.unionByName(verify.table_digest(twice, DIGEST_COLUMNS).withColumn("copy", F.lit(2)))


@job
def reconcile_orders(spark, sf):
    return verify.reconcile(_staged_orders(spark, sf), fixture(spark, sf, "orders_target"), ["o_orderkey"])


@job
def reconcile_tree(spark, sf):
    """The comparison of reconcile_orders by digests of key ranges; rows are joined only where these differ."""
    return digest_tree.reconcile_tree(_staged_orders(spark, sf), fixture(spark, sf, "orders_target"), ["o_orderkey"])


@job
def differing_ranges(spark, sf):
    source = _staged_orders(spark, sf)
    # A target in which only the largest orders changed: most ranges agree.
    target = source.withColumn("o_orderpriority", F.when(F.col("o_totalprice") < 450000, F.col("o_orderpriority")))
    return digest_tree.differing_ranges(source, target, ["o_orderkey"])


@job
def snapshot_diff(spark, sf):
    columns = ["o_orderkey", "o_totalprice"]
    return verify.snapshot_diff(
        _staged_orders(spark, sf).select(*columns), fixture(spark, sf, "orders_target").select(*columns)
    )


# --- numbering and payloads --------------------------------------------------------------------


@job
def page_rows(spark, sf):
    numbered = numbering.number_rows(fixture(spark, sf, "orders_base"), [F.col("o_orderdate"), F.col("o_orderkey")], unique=True)
    return numbered.select("o_orderkey", "rn", (F.floor((F.col("rn") - 1) / 5000).cast("bigint") + 1).alias("page_no"))


@job
def batch_assign(spark, sf):
    return _numbered_batches(spark, sf).select("o_orderkey", "batch_no", "row_no")


@job
def batch_running(spark, sf):
    pushed = fixture(spark, sf, "log_lines").filter("event = 'batch_pushed'").select("run_record_id", "seq", "rows")
    return numbering.running_total(pushed, ["run_record_id"], "seq", "rows", "source_rows")


@job
def batch_limits(spark, sf):
    """Byte-limited batches of the documents, checked against the payload texts themselves."""
    budget = 64 * 1024
    docs = fixture(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    batched = numbering.assign_batches(docs, [F.col("doc_id")], byte_budget=budget, unique=True)
    cells = numbering.canonical_cells(docs)
    sent = payload.write_payloads(batched.select("batch_no", "row_no", cells.alias("cells")), F.col("cells"))
    return sent.agg(
        F.sum("rows").alias("rows"),
        (F.max("batch_no") == F.count("*")).alias("no_gap"),
        (F.max("rows") <= numbering.ROW_LIMIT).alias("within_rows"),
        (F.count_if((F.col("bytes") > budget) & (F.col("rows") > 1)) == 0).alias("within_bytes"),
    )


@job
def batch_bytes(spark, sf):
    """The exact greedy cut of all documents, by rows and by payload bytes."""
    docs = fixture(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")
    cut = batching.greedy_batches(docs, [F.col("doc_id")], row_limit=40, byte_budget=64 * 1024, unique=True)
    return cut.select("doc_id", "row_bytes", "batch_no", "row_no")


def _order_payloads(spark, sf) -> DataFrame:
    rows = _numbered_batches(spark, sf)
    cells = numbering.canonical_cells(rows, ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"])
    return payload.write_payloads(rows, cells)


@job
def batch_payload(spark, sf):
    return _order_payloads(spark, sf).select("batch_no", "rows", "bytes", F.sha2("payload", 256).alias("digest"))


def _event_payloads(spark, sf) -> DataFrame:
    """One payload line per event, with the faults an intake must refuse."""
    good = F.to_json(
        F.struct(
            F.col("event_id").alias("seq"),
            F.array(F.array("event_type", F.col("user_id").cast("string"), "props")).alias("rows"),
        )
    )
    k = F.col("k")
    value = (
        F.when(k < 5, F.replace(good, F.lit('"seq"'), F.lit('"seqno"')))
        .when(k < 10, F.replace(good, F.lit('"rows"'), F.lit('"extra":1,"rows"')))
        .when(k < 15, F.regexp_replace(good, '"([0-9]+)"', "$1"))
        .when(k < 20, F.substring(good, 1, 20))
        .when(k < 25, F.regexp_replace(good, '"([0-9]+)"', "null"))
        .when(k < 30, F.replace(good, F.lit("]]"), F.lit(',"more"]]')))
        .otherwise(good)
    )
    return fixture(spark, sf, "log_base").select("event_id", value.alias("value"))


@job
def payload_parse(spark, sf):
    parsed = payload.parse_payloads(_event_payloads(spark, sf), 3)
    return parsed.select("event_id", "seq", "reason", F.col("rows")[0][0].alias("first_cell"), F.col("rows")[0][1].alias("second_cell"))


# --- run log and history -----------------------------------------------------------------------


def _log(spark, sf) -> DataFrame:
    return fixture(spark, sf, "log_lines").withColumnRenamed("column_name", "column")


def _accepted(spark, sf) -> DataFrame:
    return fixture(spark, sf, "accepted_runs").select(
        "run_record_id", "task_id", F.create_map(F.lit("segment"), F.col("segment")).alias("run_params"),
        "source_text", "accepted_at",
    )


def _history(spark, sf) -> DataFrame:
    return history.run_history(_log(spark, sf), _accepted(spark, sf))


def _shown(rows: DataFrame) -> DataFrame:
    return rows.drop("run_params")


@job
def run_history(spark, sf):
    return _shown(_history(spark, sf))


@job
def mapping_issue_lines(spark, sf):
    return history.mapping_issue_lines(_log(spark, sf))


@job
def sealed_runs(spark, sf):
    sealed = history.seal_open_runs(_history(spark, sf), "SERVICE_RESTARTED", "2024-06-01T00:00:00.000Z")
    return sealed.select(
        "run_record_id", "outcome", "target_table_effect", "finished_at", "message", "unknown_reason", "failure_kind", "sink_code"
    )


@job
def history_retention(spark, sf):
    return history.retain(_history(spark, sf), "2024-01-20 00:00:00", 15).select("run_record_id", "started_at")


@job
def history_list(spark, sf):
    return history.newest_first(_history(spark, sf)).select("run_record_id", "task_id", "started_at", "outcome")


@job
def run_states(spark, sf):
    return history.with_run_state(_history(spark, sf)).select("run_record_id", "run_state", "run_view", "shown_effect")


@job
def rerun_candidates(spark, sf):
    return _shown(history.rerun_candidates(_history(spark, sf), fixture(spark, sf, "live_tasks")))


@job
def runs_with_task(spark, sf):
    return history.with_task(_history(spark, sf), fixture(spark, sf, "live_tasks")).select(
        "run_record_id", "task_id", "task_name", "task_deleted"
    )


@job
def live_totals(spark, sf):
    return history.live_totals(_history(spark, sf))


@job
def overlapping_runs(spark, sf):
    return history.overlapping_runs(_history(spark, sf))


@job
def run_measures(spark, sf):
    return history.run_measures(_log(spark, sf))


@job
def payload_accounting(spark, sf):
    return history.payload_accounting(_log(spark, sf))


@job
def failure_kinds(spark, sf):
    codes = [*runs.SINK_FAILURE_KINDS, "SOMETHING_NEW"]
    picked = F.element_at(F.array(*[F.lit(c) for c in codes]), (F.col("k") % len(codes) + 1).cast("int"))
    remote = F.element_at(F.array(*[F.lit(c) for c in (*runs.REMOTE_LINK_CODES, 1555)]), (F.col("k") % 9 + 1).cast("int"))
    rows = fixture(spark, sf, "log_base").select(
        picked.alias("sink_code"), remote.alias("source_code"), (F.col("event_type") == "signup").alias("connecting")
    )
    return (
        rows.withColumn("sink_kind", runs.sink_failure_kind(F.col("sink_code")))
        .withColumn("source_kind", runs.source_failure_kind(F.col("source_code"), F.col("connecting")))
        .groupBy("sink_code", "sink_kind", "source_kind")
        .agg(F.count("*").alias("events"))
    )


@job
def log_lines_written(spark, sf):
    """Log lines written as JSON Lines and read back with their types."""
    path = scratch_path(spark, "log-lines")
    runlog.write_log(_log(spark, sf).withColumns({"level": F.lit("info"), "task": F.lit("t")}), path)
    texts = spark.read.text(path).select(
        "value",
        F.get_json_object("value", "$.run_record_id").alias("run_record_id"),
        F.get_json_object("value", "$.pos").cast("bigint").alias("pos"),
    )
    return runlog.parse_log(texts).select(
        "run_record_id", "pos", "ts", "level", "event", "run_id", "stage", "seq", "rows", "bytes", "source_rows"
    )


# --- streaming ---------------------------------------------------------------------------------

STREAM_COLUMNS = ["order_id", "status", "priority"]


def _status_run_id():
    code = F.when(F.col("o_orderstatus") == "F", "00000f").when(F.col("o_orderstatus") == "O", "0000aa").otherwise("0000bb")
    return F.concat(F.lit("20240102030405_"), code)


@job
def batch_intake_stream(spark, sf):
    """Orders as payload files of one run per status, sent twice over, one run already sealed."""
    root = scratch_path(spark, "intake-stream")
    orders = fixture(spark, sf, "orders_base")
    cells = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), F.col("o_orderpriority"))
    lines = orders.select(
        _status_run_id().alias("run_id"),
        F.to_json(F.struct((F.col("o_orderkey") + 1).alias("seq"), F.array(cells).alias("rows"))).alias("value"),
    )
    for name in ("first", "again"):
        (
            lines.repartition("run_id").write.mode("append").partitionBy("run_id")
            .option("compression", "none").text(f"{root}/{name}")
        )
    for name in ("first", "again"):
        _as_incoming(spark, f"{root}/{name}", f"{root}/incoming", name)

    def states(session):
        return orders.select(_status_run_id().alias("run_id"), (F.col("o_orderstatus") == "P").alias("sealed")).distinct()

    staged = f"{root}/staging"
    query = intake.start_intake(spark, f"{root}/incoming", staged, states, STREAM_COLUMNS, f"{root}/checkpoint", max_files=4)
    query.awaitTermination()
    return intake.read_staged(spark, staged, STREAM_COLUMNS)


@job
def intake_commit(spark, sf):
    """Three runs of orders, one per status, and an unknown one. F is sent with an older copy of every third batch and
    committed; O is aborted; P is committed with a batch too few and then sent more. What is in the target, what was
    refused, and how each run ended."""
    root = scratch_path(spark, "intake-commit")
    runs_of = {"F": "20240102030405_00000f", "O": "20240102030405_0000aa", "P": "20240102030405_0000bb"}
    orders = fixture(spark, sf, "orders_base").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    numbered = numbering.number_rows(orders, [F.col("o_orderstatus"), F.col("o_orderkey")], "n", unique=True)
    first = numbered.groupBy("o_orderstatus").agg(F.min("n").alias("first"))
    placed = numbered.join(F.broadcast(first), "o_orderstatus").withColumn("batch_no", F.expr("(n - first) div 50 + 1"))  # three statuses
    placed = placed.withColumn("row_no", F.expr("(n - first) % 50 + 1")).withColumn("run_id", _status_run_id())

    def send(rows, name, priority, shift=0, run_id=F.col("run_id")):
        cells = F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus"), priority)
        lists = rows.groupBy(run_id.alias("run_id"), "batch_no").agg(F.array_sort(F.collect_list(F.struct("row_no", cells.alias("cells")))).alias("rows"))
        line = F.to_json(F.struct((F.col("batch_no") + shift).alias("seq"), F.transform("rows", lambda r: r["cells"]).alias("rows")))
        lists.select("run_id", line.alias("value")).write.partitionBy("run_id").option("compression", "none").text(f"{root}/{name}")
        _as_incoming(spark, f"{root}/{name}", f"{root}/incoming", name)

    states, columns = RunStates(spark, f"{root}/states"), ["order_id", "status", "priority"]
    schema = T.StructType().add("order_id", T.LongType()).add("status", T.StringType()).add("priority", T.StringType())
    target = ManifestTarget(f"{root}/target", schema, ("order_id",), buckets=16)
    work = IntakeCommit(spark, states, f"{root}/staging", target, columns, ["order_id"])

    def take():
        intake.start_intake(spark, f"{root}/incoming", f"{root}/staging", states.table, columns, f"{root}/checkpoint").awaitTermination()

    for run_id in runs_of.values():
        states.open(run_id)
    send(placed, "first", F.when((F.col("o_orderstatus") == "F") & (F.col("batch_no") % 3 == 0), "older").otherwise(F.col("o_orderpriority")))
    send(placed.filter("o_orderstatus = 'P' AND batch_no = 1"), "unknown", F.col("o_orderpriority"), run_id=F.lit("20240102030405_0000ff"))
    take()
    size = {r[0]: (r[1], r[2]) for r in placed.groupBy("o_orderstatus").agg(F.count("*"), F.max("batch_no")).collect()}
    try:
        work.commit(runs_of["P"], size["P"][0], size["P"][1] + 1)
    except DiscardedRun as refused:
        assert refused.kind == "VERIFY_FAILED"
    send(placed.filter("o_orderstatus = 'F' AND batch_no % 3 = 0 OR o_orderstatus = 'P' AND batch_no % 2 = 0"), "again", F.col("o_orderpriority"))
    take()
    work.abort(runs_of["O"])
    work.commit(runs_of["F"], *size["F"])

    rows = target.read(spark).selectExpr("'row' kind", "CAST(order_id AS STRING) a", "status b", "priority c", "1L n")
    refused = intake.read_quarantine(spark, f"{root}/staging").groupBy("run_id", "reason").count()
    ended = spark.createDataFrame(
        [(run_id, d["state"], d.get("cause"), d.get("received_batches")) for run_id in runs_of.values() for d in [states.last(run_id)[1]]],
        "run_id string, state string, cause string, received bigint",
    )
    return rows.unionByName(refused.selectExpr("'refused' kind", "run_id a", "reason b", "NULL c", "count n")).unionByName(
        ended.selectExpr("'state' kind", "run_id a", "state b", "cause c", "received n")
    )


@job
def sequence_gate_stream(spark, sf):
    """Batch numbers of one run per status with two kinds of gaps, one of which is filled by a second delivery."""
    root = scratch_path(spark, "sequence-gate")
    batches = fixture(spark, sf, "orders_base").select(_status_run_id().alias("run_id"), (F.col("o_orderkey") + 1).alias("batch_no"))
    for part in ("batch_no % 7 NOT IN (3, 5)", "batch_no % 7 = 5 OR batch_no % 14 = 1"):
        batches.filter(part).write.mode("append").parquet(f"{root}/sent")
        stream = spark.readStream.schema(batches.schema).parquet(f"{root}/sent")
        sequence.start_gate(stream, f"{root}/gate", f"{root}/checkpoint").awaitTermination()
    return sequence.gate_state(spark, f"{root}/gate")


def _as_incoming(spark, written: str, incoming: str, mark: str) -> None:
    """Move written text files to ``<incoming>/<run_id>/<mark>-<n>.json``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(written).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for folder in fs.globStatus(hadoop.Path(f"{written}/run_id=*")):
        run_id = folder.getPath().getName().split("=", 1)[1]
        fs.mkdirs(hadoop.Path(f"{incoming}/{run_id}"))
        for i, part in enumerate(fs.globStatus(hadoop.Path(f"{folder.getPath()}/part-*"))):
            fs.rename(part.getPath(), hadoop.Path(f"{incoming}/{run_id}/{mark}-{i:05d}.json"))


@job
def live_runs_stream(spark, sf):
    root = scratch_path(spark, "live-runs")
    log = _log(spark, sf)
    log.write.json(f"{root}/log")
    lines = live.log_stream(spark, f"{root}/log", log.schema)
    live.start_live_runs(lines, f"{root}/states", f"{root}/checkpoint").awaitTermination()
    return _shown(live.live_runs(spark, f"{root}/states", _accepted(spark, sf)))


@job
def live_runs_folded(spark, sf):
    """Lines of each run dealt over twelve micro-batches, out of order; the written states are merged three at a time."""
    root = scratch_path(spark, "live-folded")
    log = _log(spark, sf)
    log.repartition(12, "pos").write.json(f"{root}/log")
    lines = live.log_stream(spark, f"{root}/log", log.schema, max_files=1)
    live.start_live_runs(lines, f"{root}/states", f"{root}/checkpoint", fan=3).awaitTermination()
    return _shown(live.live_runs(spark, f"{root}/states", _accepted(spark, sf)))
