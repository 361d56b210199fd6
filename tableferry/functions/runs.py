"""Run ids, staging names and failure kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The run id and staging name rules.
RUN_ID_GRAMMAR = r"[0-9]{14}_[0-9a-f]{6}"
STAGING_MARK = "__stg_"

# Sink error codes and the failure kind each one means.
SINK_FAILURE_KINDS = {
    "PRECHECK_FAILED": "MAPPING_PRECHECK",
    "VERIFY_FAILED": "VERIFY_FAILED",
    "SWAP_TARGET_BUSY": "TARGET_BUSY",
    "DATA_REJECTED": "DATA_REJECTED",
    "SINK_ENVIRONMENT": "SINK_ENVIRONMENT",
    "STAGING_CREATE_FAILED": "SINK_WRITE",
    "BATCH_WRITE_FAILED": "SINK_WRITE",
    "SWAP_FAILED": "SINK_WRITE",
    "SEQ_MISMATCH": "DEFECT",
    "RUN_SEALED": "DEFECT",
    "RUN_UNKNOWN": "DEFECT",
    "PAYLOAD_TOO_LARGE": "DEFECT",
    "BAD_REQUEST": "DEFECT",
    "INTERNAL_PRECHECK_ESCAPE": "DEFECT",
    "INTERNAL_ASSERTION_FAILED": "DEFECT",
}
# Source database codes that point at the remote side once a session is open.
REMOTE_LINK_CODES = (2019, 2020, 2068, 12154, 12170, 12203, 12514, 12541)


def is_run_id(text: Column) -> Column:
    return text.rlike("^" + RUN_ID_GRAMMAR + r"\z")


def run_id_time(run_id: Column) -> Column:
    """The UTC time a run id starts with, NULL when the digits are no moment."""
    spelled = F.regexp_replace(
        F.substring(run_id, 1, 14), r"^(\d{4})(\d\d)(\d\d)(\d\d)(\d\d)(\d\d)$", "$1-$2-$3 $4:$5:$6"
    )
    return spelled.try_cast("timestamp_ntz")


def staging_name(target_table: Column, run_id: Column) -> Column:
    return F.concat(target_table, F.lit(STAGING_MARK), run_id)


def sink_failure_kind(code: Column) -> Column:
    """Failure kind of a sink error code; a code outside the list is a defect itself."""
    pairs = [F.lit(part) for pair in SINK_FAILURE_KINDS.items() for part in pair]
    return F.when(
        code.isNotNull(), F.coalesce(F.element_at(F.create_map(*pairs), code), F.lit("DEFECT"))
    )


def source_failure_kind(code: Column, connecting: Column) -> Column:
    """Failure kind of a source error: what a code means depends on the step that met it."""
    return (
        F.when(connecting, "SOURCE_CONNECT")
        .when(code.isin(*REMOTE_LINK_CODES), "SOURCE_DBLINK")
        .otherwise("SOURCE_QUERY")
    )
