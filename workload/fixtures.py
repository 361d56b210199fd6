"""Inputs of the registered queries, derived from whole driver tables.

Each fixture is one SELECT in the part of SQL that Spark and DuckDB share, so both sides start
from the same rows. The order below is the order in which fixtures build on each other.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

SQL = {
    "orders_base": """
        SELECT o_orderkey, o_custkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice,
               o_orderdate, o_orderpriority
          FROM orders""",
    # The target before the copy: open orders are not there yet, urgent ones changed since, and
    # some rows exist only in the target.
    "orders_target": """
        SELECT o_orderkey, o_custkey, o_orderstatus,
               CAST(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END
                    AS DECIMAL(18,2)) AS o_totalprice,
               o_orderdate, o_orderpriority, 'old' AS o_note
          FROM orders_base WHERE o_orderstatus <> 'P'
        UNION ALL
        SELECT -1 - o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 'target only'
          FROM orders_base WHERE o_orderstatus = 'F' AND o_orderpriority = '5-LOW'""",
    "lineitem_base": """
        SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_suppkey,
               CAST(l_quantity AS DECIMAL(18,2)) AS l_quantity,
               CAST(l_extendedprice AS DECIMAL(18,2)) AS l_extendedprice,
               CAST(l_discount AS DECIMAL(18,4)) AS l_discount, CAST(l_tax AS DECIMAL(18,4)) AS l_tax,
               l_returnflag, l_linestatus, l_shipdate
          FROM lineitem""",
    # One source column per part: fifty to a task, all nine shapes and the refused ones.
    "part_columns": """
        SELECT 'task' || CAST(CAST(FLOOR(p_partkey / 50) AS BIGINT) AS STRING) AS task,
               p_partkey % 50 + 1 AS ordinal,
               CASE WHEN p_size > 45 THEN 'c' || CAST(p_partkey % 50 AS STRING)
                    WHEN p_size < 4 THEN 'C1'
                    ELSE 'C' || CAST(p_partkey % 50 AS STRING) END AS column_name,
               p_partkey % 12 AS kind, CAST(p_size AS BIGINT) AS p_size, p_partkey,
               CAST(SUBSTR(p_brand, 7) AS BIGINT) AS brand, p_type
          FROM part""",
    "source_columns": """
        SELECT task, ordinal, column_name,
               CASE kind WHEN 1 THEN 'VARCHAR2' WHEN 2 THEN 'NVARCHAR2' WHEN 3 THEN 'CHAR' WHEN 4 THEN 'nchar'
                         WHEN 5 THEN 'DATE' WHEN 6 THEN 'TIMESTAMP' WHEN 7 THEN 'number' WHEN 8 THEN 'CLOB'
                         WHEN 10 THEN 'TIMESTAMP' ELSE 'NUMBER' END AS type_name,
               CASE WHEN kind IN (0, 9, 11) THEN 1 + p_partkey % 38 END AS precision,
               CASE WHEN kind IN (0, 11) THEN p_size - 12 END AS scale,
               CASE WHEN kind IN (1, 2, 3, 4) AND p_size <> 20 THEN 1 + p_partkey % 200 END AS length,
               CASE WHEN kind IN (6, 10) AND p_size <> 21 THEN p_partkey % 10 END AS fsp,
               brand, p_size
          FROM part_columns""",
    "shape_parts": """
        SELECT *, UPPER(type_name) AS t, UPPER(column_name) AS name_key,
               CASE WHEN scale < 0 THEN precision - scale WHEN scale > precision THEN scale ELSE precision END AS dp,
               CASE WHEN scale < 0 THEN 0 ELSE scale END AS ds
          FROM source_columns""",
    "shapes": """
        SELECT *,
               CASE WHEN t = 'NUMBER' AND precision IS NULL AND scale IS NULL THEN NULL
                    WHEN t = 'NUMBER' AND (precision IS NULL OR scale IS NULL) THEN 'NUMBER_HALF_DECLARED'
                    WHEN t = 'NUMBER' AND NOT (dp BETWEEN 1 AND 65 AND ds BETWEEN 0 AND 30 AND ds <= dp)
                         THEN 'DECIMAL_UNREPRESENTABLE'
                    WHEN t = 'NUMBER' THEN NULL
                    WHEN t IN ('VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR') AND length IS NULL THEN 'LENGTH_MISSING'
                    WHEN t IN ('VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR', 'DATE') THEN NULL
                    WHEN t = 'TIMESTAMP' AND fsp IS NULL THEN 'FSP_MISSING'
                    WHEN t = 'TIMESTAMP' AND fsp > 6 THEN 'FSP_TOO_PRECISE'
                    WHEN t = 'TIMESTAMP' THEN NULL
                    ELSE 'TYPE_NOT_LISTED' END AS rejection,
               CASE WHEN t = 'NUMBER' AND precision IS NULL AND scale IS NULL THEN TRUE ELSE FALSE END AS bare
          FROM shape_parts""",
    "shape_texts": """
        SELECT *,
               CASE WHEN rejection IS NOT NULL OR bare THEN NULL
                    WHEN t = 'NUMBER' THEN 'decimal' WHEN t IN ('DATE', 'TIMESTAMP') THEN 'datetime'
                    ELSE 'varchar' END AS family,
               CASE WHEN rejection IS NOT NULL OR bare THEN NULL
                    WHEN t = 'NUMBER' THEN 'DECIMAL(' || CAST(dp AS STRING) || ',' || CAST(ds AS STRING) || ')'
                    WHEN t = 'DATE' THEN 'DATETIME(0)' WHEN t = 'TIMESTAMP' THEN 'DATETIME(6)'
                    ELSE 'VARCHAR(' || CAST(length AS STRING) || ')' END AS shape_text,
               CASE WHEN t = 'NUMBER' AND precision IS NOT NULL AND scale IS NOT NULL
                    THEN 'NUMBER(' || CAST(precision AS STRING) || ',' || CAST(scale AS STRING) || ')'
                    WHEN t = 'NUMBER' THEN 'NUMBER(?,?)'
                    WHEN t IN ('VARCHAR2', 'NVARCHAR2', 'CHAR', 'NCHAR')
                    THEN t || '(' || COALESCE(CAST(length AS STRING), '?') || ')'
                    WHEN t = 'DATE' THEN 'DATE'
                    WHEN t = 'TIMESTAMP' THEN t || '(' || COALESCE(CAST(fsp AS STRING), '?') || ')'
                    ELSE type_name END AS source_text
          FROM shapes""",
    # Target columns: the derived shape with one rule broken by the part's brand.
    "target_shapes": """
        SELECT task, ordinal, column_name, brand, name_key,
               CASE WHEN brand = 3 THEN 'int' WHEN family IS NOT NULL THEN family
                    WHEN t = 'NUMBER' THEN 'decimal' ELSE 'varchar' END AS data_type,
               CASE WHEN brand = 8 THEN NULL
                    WHEN family = 'decimal' AND brand IN (4, 13) AND dp > ds THEN dp - 1
                    WHEN family = 'decimal' AND brand = 12 AND ds > 0 THEN dp
                    WHEN family = 'decimal' THEN dp
                    WHEN bare AND brand = 14 THEN 70 WHEN bare THEN 20
                    WHEN t = 'NUMBER' THEN 38 END AS precision,
               CASE WHEN family = 'decimal' AND brand IN (4, 12) AND ds > 0 THEN ds - 1
                    WHEN family = 'decimal' THEN ds WHEN bare THEN 4
                    WHEN t = 'NUMBER' THEN 0 END AS scale,
               CASE WHEN family = 'varchar' AND brand = 5 THEN length - 1 WHEN family = 'varchar' THEN length
                    WHEN t NOT IN ('NUMBER', 'DATE', 'TIMESTAMP') THEN 255 END AS length,
               CASE WHEN family = 'datetime' AND brand = 7 THEN 3 WHEN family = 'datetime' AND t = 'DATE' THEN 0
                    WHEN family = 'datetime' THEN 6 END AS datetime_precision,
               CASE WHEN family = 'varchar' AND brand = 6 THEN 'latin1' WHEN family = 'varchar' THEN 'utf8mb4' END AS character_set
          FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY task, name_key ORDER BY ordinal) AS nth FROM shape_texts) s
         WHERE nth = 1 AND brand <> 1""",
    "target_columns": """
        SELECT task, ordinal, UPPER(column_name) AS column_name,
               data_type || CASE WHEN precision IS NOT NULL THEN '(' || CAST(precision AS STRING) || ',' || CAST(scale AS STRING) || ')'
                                 WHEN length IS NOT NULL THEN '(' || CAST(length AS STRING) || ')'
                                 WHEN datetime_precision IS NOT NULL THEN '(' || CAST(datetime_precision AS STRING) || ')'
                                 ELSE '' END AS column_type,
               data_type, precision, scale, length, datetime_precision,
               CASE WHEN UPPER(column_name) IN ('C1', 'C2') THEN brand > 18 ELSE brand <> 2 END AS nullable,
               character_set, CAST(NULL AS STRING) AS default_value, '' AS extra
          FROM target_shapes
        UNION ALL
        SELECT task, ordinal + 50, 'X' || CAST(ordinal AS STRING), 'int', 'int', CAST(NULL AS BIGINT), CAST(NULL AS BIGINT),
               CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), brand = 11, CAST(NULL AS STRING),
               CASE WHEN brand = 10 THEN '0' END, CASE WHEN brand = 15 THEN 'AUTO_INCREMENT' ELSE '' END
          FROM target_shapes WHERE brand IN (9, 10, 11, 15)""",
    "task_keys": """
        SELECT task, 'TARGET_' || task || CASE WHEN MAX(p_size) >= 49 THEN REPEAT('X', 30) ELSE '' END AS target_table,
               'C1' AS key_1,
               CASE WHEN MIN(p_size) <= 1 THEN 'c2' WHEN MAX(p_size) >= 50 THEN 'NOPE' END AS key_2
          FROM part_columns GROUP BY task""",
    "unique_key_rows": """
        SELECT task, 'PRIMARY' AS key_name, 'c1' AS key_1, CASE WHEN key_2 = 'c2' THEN 'C2' END AS key_2 FROM task_keys
        UNION ALL
        SELECT task, 'uk_three', 'C3', CAST(NULL AS STRING) FROM task_keys WHERE key_2 IS NULL OR key_2 <> 'c2'""",
    # Task specs, one per part.
    "spec_rows": """
        SELECT p_partkey AS spec_id, p_brand AS owner, p_type AS table_name,
               CASE WHEN p_size > 48 THEN '9link' WHEN p_size > 40 THEN 'FA' END AS dblink,
               CASE WHEN p_size = 7 THEN '  ' ELSE p_type END AS target_table,
               p_type AS column_1, 'P_SIZE' AS column_2, p_name AS column_3, 'p_size' AS column_4,
               p_type AS target_1, 'P_SIZE' AS target_2,
               CASE WHEN p_size > 30 THEN LOWER(p_type) ELSE 'P_NAME' END AS target_3, 'P_SIZE2' AS target_4,
               CASE WHEN p_size > 12 THEN p_type ELSE 'P_KEY' END AS key_1,
               CASE WHEN p_size > 44 THEN LOWER(p_type) WHEN p_size > 10 THEN 'p_size' END AS key_2,
               'DAY' AS parameter_1, CASE WHEN p_size < 20 THEN 'day' ELSE 'P2' END AS parameter_2,
               CASE WHEN p_size < 25 THEN 'constant' ELSE 'runtime' END AS value_source_1,
               CASE WHEN p_size < 5 OR p_size > 35 THEN '' ELSE p_brand END AS constant_1,
               p_size
          FROM part""",
    # Log lines of one run per user.
    "log_base": """
        SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
               SUBSTR(CAST(ts AS STRING), 1, 10) || 'T' || SUBSTR(CAST(ts AS STRING), 12, 8) || '.000Z' AS ts_text
          FROM events""",
    "log_events": """
        SELECT *,
               CASE event_type WHEN 'signup' THEN 'source_started' WHEN 'view' THEN 'stage_changed'
                    WHEN 'click' THEN 'batch_pushed'
                    WHEN 'error' THEN CASE WHEN k < 40 THEN 'mapping_precheck_failed' WHEN k < 60 THEN 'run_opened'
                                           WHEN k < 63 THEN 'commit_diagnosed' WHEN k < 66 THEN 'task_config_failed'
                                           ELSE 'range_check_executed' END
                    ELSE CASE WHEN k >= 97 THEN 'run_finished' ELSE 'abort_failed' END END AS event
          FROM log_base""",
    "log_lines": """
        SELECT 'rec-' || CAST(user_id AS STRING) AS run_record_id, event_id AS pos,
               CASE WHEN k = 50 THEN NULL ELSE ts_text END AS ts, event,
               CASE WHEN event = 'source_started' AND k < 80 THEN NULL
                    WHEN k % 17 = 3 THEN 'run-' || CAST(user_id AS STRING) || '-b'
                    ELSE 'run-' || CAST(user_id AS STRING) END AS run_id,
               CASE WHEN event = 'stage_changed' THEN CASE WHEN value < 10 THEN 'PREPARING' WHEN value < 60 THEN 'STREAMING' ELSE 'COMMITTING' END
                    WHEN event = 'run_finished' THEN CASE WHEN value < 40 THEN 'COMMITTING' ELSE 'SUCCEEDED' END END AS stage,
               CASE WHEN event = 'run_opened' THEN 'TGT__stg_' || CAST(event_id AS STRING) END AS staging_table,
               CASE WHEN event = 'run_finished' THEN CASE WHEN value < 40 THEN 'FAILED' ELSE 'SUCCEEDED' END
                    WHEN event = 'commit_diagnosed' THEN CASE WHEN value < 20 THEN 'SWAPPED' WHEN value < 60 THEN 'DISCARDED' END END AS terminal,
               CASE WHEN event IN ('run_finished', 'task_config_failed', 'mapping_precheck_failed') THEN 'm' || CAST(k AS STRING) END AS message,
               CASE WHEN event IN ('run_finished', 'task_config_failed') AND k % 2 = 0 THEN 'v' || CAST(k AS STRING) END AS value,
               CASE WHEN event IN ('run_finished', 'mapping_precheck_failed') THEN 'COL' || CAST(k AS STRING) END AS column_name,
               CASE WHEN event = 'mapping_precheck_failed' THEN 'DATE' END AS source,
               CASE WHEN event = 'mapping_precheck_failed' THEN 'VARCHAR(30)' END AS target,
               CASE WHEN event = 'mapping_precheck_failed' THEN 'TIME_TARGET_NOT_DATETIME' END AS rule,
               CASE WHEN event = 'mapping_precheck_failed' THEN 'change to DATETIME(0)' END AS suggestion,
               CASE WHEN event = 'run_finished' AND value < 40 THEN 'SINK_WRITE' WHEN event = 'task_config_failed' THEN 'CONFIG' END AS failure_kind,
               CAST(NULL AS STRING) AS source_code,
               CASE WHEN event = 'run_finished' AND value < 15 THEN 'VERIFY_FAILED'
                    WHEN event = 'run_finished' AND value < 25 THEN 'PRECHECK_FAILED' END AS sink_code,
               CASE WHEN event = 'batch_pushed' THEN event_id END AS seq,
               CASE WHEN event = 'batch_pushed' THEN event_id % 5000 END AS rows,
               CASE WHEN event = 'batch_pushed' THEN CAST(CAST(CAST(value AS DECIMAL(18,2)) * 1000 AS DECIMAL(18,0)) AS BIGINT) END AS bytes,
               CASE WHEN event = 'batch_pushed' THEN k END AS ms,
               CASE WHEN event = 'run_finished' THEN event_id END AS source_rows,
               CASE WHEN event = 'run_finished' THEN event_id - 1 END AS staged_rows,
               CASE WHEN event = 'run_finished' THEN event_id + 1 END AS sink_reported_rows,
               CASE WHEN event = 'run_finished' THEN CAST(0 AS BIGINT) END AS purged_rows,
               CASE WHEN event = 'run_finished' THEN k END AS source_batches,
               CASE WHEN event = 'run_finished' THEN k END AS received_batches,
               CASE WHEN event = 'run_finished' THEN k + 1 END AS fetch_ms,
               CASE WHEN event = 'run_finished' THEN k * 3 END AS push_ms,
               CASE WHEN event = 'run_finished' THEN k + 2 END AS commit_ms,
               CASE WHEN event = 'run_finished' THEN k + 3 END AS count_ms,
               CASE WHEN event = 'run_finished' THEN k * 7 END AS cursor_ms
          FROM log_events""",
    "accepted_runs": """
        SELECT 'rec-' || CAST(c_custkey AS STRING) AS run_record_id, 't' || CAST(c_nationkey AS STRING) AS task_id,
               c_mktsegment AS segment, 'FROM ' || c_name AS source_text, '2023-12-31T00:00:00.000Z' AS accepted_at
          FROM customer""",
    # Tasks that still exist: those of one region were deleted.
    "live_tasks": """
        SELECT 't' || CAST(n_nationkey AS STRING) AS task_id, n_name AS task_name FROM nation WHERE n_regionkey <> 4""",
}


def needed(*names: str) -> list[str]:
    """The fixtures a query needs, in build order."""
    wanted, pending = set(), list(names)
    while pending:
        name = pending.pop()
        if name in SQL and name not in wanted:
            wanted.add(name)
            pending += [other for other in SQL if re.search(rf"\b{other}\b", SQL[name])]
    return [name for name in SQL if name in wanted]


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture (or a driver table) as a DataFrame over the files of `sf_dir`."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = with_fixtures(f"SELECT * FROM {name}")
    inputs = {}
    for table in TABLES:
        text, uses = re.subn(rf"\b(FROM|JOIN)\s+{table}\b", rf"\1 {{{table}}}", text)
        if uses:
            inputs[table] = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(text, **inputs)


def with_fixtures(select: str) -> str:
    """DuckDB text of a query over fixtures: the ones it uses become CTEs."""
    used = [name for name in SQL if re.search(rf"\b{name}\b", select)]
    parts = [f"{name} AS ({SQL[name]})" for name in needed(*used)]
    select = select.strip()
    if select.upper().startswith("WITH "):
        return f"WITH {', '.join(parts)}, {select[5:]}" if parts else select
    return f"WITH {', '.join(parts)} {select}" if parts else select
