"""Oracle SQL of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from workload.fixtures import with_fixtures

ORACLE: dict[str, str] = {}


def oracle(name: str, select: str) -> None:
    ORACLE[name] = with_fixtures(select)


# Canonical text of a decimal column.
def number_text(value: str) -> str:
    return f"regexp_replace(CAST({value} AS STRING), '\\.0*$|(\\.[0-9]*[1-9])0+$', '\\1')"


NUMBER = "0|-?[1-9][0-9]*(\\.[0-9]*[1-9])?|-?0\\.[0-9]*[1-9]"


def fraction(text: str) -> str:
    return f"LENGTH(regexp_extract({text}, '\\.([0-9]+)$', 1))"


def whole(text: str) -> str:
    digits = f"regexp_extract({text}, '^-?([0-9]+)', 1)"
    return f"(CASE WHEN {digits} = '0' THEN 0 ELSE LENGTH({digits}) END)"


oracle(
    "copy_orders_mapped",
    """SELECT o_orderkey AS "ORDER_ID", o_custkey AS "CUSTOMER_ID", o_totalprice AS "AMOUNT", o_orderdate AS "ORDERED_AT"
         FROM orders_base
        WHERE o_orderstatus = 'F' AND o_totalprice > 1000.50 AND o_orderdate < TIMESTAMP '1999-07-01'""",
)

oracle(
    "copy_run_orders",
    """WITH s AS (SELECT * FROM orders_base WHERE o_orderstatus = 'F' AND o_totalprice > 1000.50 AND o_orderdate < TIMESTAMP '1999-07-01')
       SELECT COALESCE(t.o_orderkey, s.o_orderkey) AS o_orderkey,
              CASE WHEN s.o_orderkey IS NULL THEN t.o_custkey ELSE s.o_custkey END AS o_custkey,
              CASE WHEN s.o_orderkey IS NULL THEN t.o_orderstatus ELSE s.o_orderstatus END AS o_orderstatus,
              CASE WHEN s.o_orderkey IS NULL THEN t.o_totalprice ELSE s.o_totalprice END AS o_totalprice,
              CASE WHEN s.o_orderkey IS NULL THEN t.o_orderdate ELSE s.o_orderdate END AS o_orderdate,
              CASE WHEN s.o_orderkey IS NULL THEN t.o_orderpriority ELSE s.o_orderpriority END AS o_orderpriority,
              CASE WHEN t.o_orderkey IS NULL THEN 'new' ELSE t.o_note END AS o_note
         FROM orders_target t FULL JOIN s ON t.o_orderkey = s.o_orderkey""",
)
oracle(
    "copy_run_log",
    """SELECT '20240102030405_0a1b2c' AS run_record_id, '20240102030405_0a1b2c' AS run_id, 'SUCCEEDED' AS outcome, 'SWAPPED' AS target_table_effect,
              'SUCCEEDED' AS stage, 'ORDER_COPY__stg_20240102030405_0a1b2c' AS staging_table,
              COUNT(*) AS source_rows, COUNT(*) AS staged_rows, COUNT(*) AS rows_pushed, true AS last_is_largest FROM orders_base""",
)

oracle(
    "copy_run_guarded",
    """SELECT o_orderkey AS "ORDER_ID", 'AMOUNT' AS column_name, CAST(CAST(o_totalprice AS DECIMAL(12,2)) AS VARCHAR) AS value, 'WOULD_ROUND' AS reason
       FROM orders_base WHERE CAST(o_totalprice AS DECIMAL(12,2)) <> ROUND(CAST(o_totalprice AS DECIMAL(12,2)), 1)""",
)
oracle(
    "copy_run_gate_failed",
    """SELECT 'FAILED' AS outcome, 'DISCARDED' AS target_table_effect, 'COMMITTING' AS stage, 'DATA_REJECTED' AS failure_kind, 'DATA_REJECTED' AS sink_code,
              COUNT(*) AS repeated FROM (SELECT o_custkey FROM orders_base GROUP BY o_custkey HAVING COUNT(*) > 1)""",
)

# --- task specs ---
IDENT = "'[A-Za-z][A-Za-z0-9_$#]*'"
oracle(
    "spec_audit_parts",
    f"""
    WITH names AS (
        SELECT spec_id, 1 AS i, column_1 AS s, target_1 AS t FROM spec_rows
        UNION ALL SELECT spec_id, 2, column_2, target_2 FROM spec_rows
        UNION ALL SELECT spec_id, 3, column_3, target_3 FROM spec_rows
        UNION ALL SELECT spec_id, 4, column_4, target_4 FROM spec_rows),
    keys AS (
        SELECT spec_id, 1 AS i, key_1 AS k FROM spec_rows
        UNION ALL SELECT spec_id, 2, key_2 FROM spec_rows WHERE key_2 IS NOT NULL),
    parameters AS (
        SELECT spec_id, 1 AS i, parameter_1 AS p FROM spec_rows UNION ALL SELECT spec_id, 2, parameter_2 FROM spec_rows)
    SELECT spec_id, 'OWNER_NOT_IDENTIFIER' AS rule, owner AS subject FROM spec_rows WHERE NOT regexp_full_match(owner, {IDENT})
    UNION ALL SELECT spec_id, 'TABLE_NOT_IDENTIFIER', table_name FROM spec_rows WHERE NOT regexp_full_match(table_name, {IDENT})
    UNION ALL SELECT spec_id, 'LINK_NOT_IDENTIFIER', dblink FROM spec_rows WHERE NOT regexp_full_match(dblink, {IDENT})
    UNION ALL SELECT spec_id, 'TARGET_TABLE_BLANK', target_table FROM spec_rows WHERE TRIM(target_table) = ''
    UNION ALL SELECT spec_id, 'COLUMN_NOT_IDENTIFIER', s FROM names WHERE NOT regexp_full_match(s, {IDENT})
    UNION ALL SELECT spec_id, 'TARGET_NOT_IDENTIFIER', t FROM names WHERE NOT regexp_full_match(t, {IDENT})
    UNION ALL SELECT spec_id, 'COLUMN_REPEATED', s FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY spec_id, UPPER(s) ORDER BY i) AS n FROM names) x WHERE n > 1
    UNION ALL SELECT spec_id, 'TARGET_REPEATED', t FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY spec_id, UPPER(t) ORDER BY i) AS n FROM names) x WHERE n > 1
    UNION ALL SELECT spec_id, 'KEY_NOT_IDENTIFIER', k FROM keys WHERE NOT regexp_full_match(k, {IDENT})
    UNION ALL SELECT spec_id, 'KEY_REPEATED', k FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY spec_id, UPPER(k) ORDER BY i) AS n FROM keys) x WHERE n > 1
    UNION ALL SELECT spec_id, 'KEY_NOT_SELECTED', k FROM keys
        WHERE NOT EXISTS (SELECT 1 FROM names WHERE names.spec_id = keys.spec_id AND UPPER(t) = UPPER(k))
    UNION ALL SELECT spec_id, 'PARAMETER_REPEATED', p FROM
        (SELECT *, ROW_NUMBER() OVER (PARTITION BY spec_id, LOWER(p) ORDER BY i) AS n FROM parameters) x WHERE n > 1
    UNION ALL SELECT spec_id, 'CONSTANT_MISSING', p FROM parameters JOIN spec_rows USING (spec_id)
        WHERE value_source_1 = 'constant' AND constant_1 = ''
    UNION ALL SELECT spec_id, 'CONSTANT_NOT_ALLOWED', p FROM parameters JOIN spec_rows USING (spec_id)
        WHERE value_source_1 = 'runtime' AND constant_1 <> ''
    UNION ALL SELECT spec_id, 'ORDER_NOT_IDENTIFIER', column_3 FROM spec_rows WHERE NOT regexp_full_match(column_3, {IDENT})
    """,
)
oracle(
    "run_params_audit",
    """SELECT spec_id AS run_id, 'PARAMETER_MISSING' AS rule, parameter_2 AS parameter FROM spec_rows
        WHERE parameter_2 <> 'DAY' AND parameter_2 <> UPPER(table_name)
       UNION ALL SELECT spec_id, 'PARAMETER_NOT_DECLARED', UPPER(table_name) FROM spec_rows
        WHERE UPPER(table_name) NOT IN (parameter_1, parameter_2)""",
)

# --- metadata ---
oracle(
    "derive_shapes",
    "SELECT task, ordinal, column_name, source_text, family, rejection, shape_text FROM shape_texts",
)
oracle(
    "support_tier",
    """SELECT task, CASE WHEN bare THEN 'needs_precision' WHEN rejection IS NULL THEN 'ok' ELSE 'unsupported' END AS support,
              COUNT(*) AS columns,
              COUNT(*) FILTER (t = 'DATE' OR (t = 'TIMESTAMP' AND fsp <= 6)) AS date_filter_columns
         FROM shape_texts GROUP BY 1, 2""",
)
SUGGESTION = """CASE {0} WHEN 'NUMBER_HALF_DECLARED' THEN 'declare (p,s) for this column in the task'
    WHEN 'LENGTH_MISSING' THEN 'add a CAST that states the character length'
    WHEN 'FSP_MISSING' THEN 'add a CAST to TIMESTAMP(0..6)'
    WHEN 'FSP_TOO_PRECISE' THEN 'add a CAST to TIMESTAMP(6)'
    WHEN 'DECIMAL_UNREPRESENTABLE' THEN 'no target shape exists; narrow the column with a CAST'
    WHEN 'TYPE_NOT_LISTED' THEN 'add a CAST to a supported type' END"""
MESSAGE = """CASE {0} WHEN 'NUMBER_HALF_DECLARED' THEN 'NUMBER declares only one of precision and scale'
    WHEN 'LENGTH_MISSING' THEN 'a character column needs a known length'
    WHEN 'FSP_MISSING' THEN 'a TIMESTAMP needs known fraction digits'
    WHEN 'FSP_TOO_PRECISE' THEN 'TIMESTAMP with more than 6 fraction digits is not supported'
    WHEN 'DECIMAL_UNREPRESENTABLE' THEN 'the derived shape exceeds DECIMAL(65,30)'
    WHEN 'TYPE_NOT_LISTED' THEN 'the source type is not one of the nine supported shapes' END"""
oracle(
    "reject_reasons",
    f"""SELECT rejection, COUNT(*) AS columns, {SUGGESTION.format('rejection')} AS suggestion
          FROM shape_texts WHERE rejection IS NOT NULL GROUP BY rejection""",
)
oracle(
    "dictionary_source",
    """SELECT 'APP.' || task AS task, ordinal, column_name, UPPER(type_name) AS type_name, precision, scale, length, fsp, TRUE AS nullable
         FROM source_columns""",
)
oracle(
    "dictionary_target",
    """SELECT 'shop.' || task AS task, ordinal, column_name, column_type, data_type, precision, scale, length, datetime_precision, nullable,
              character_set, default_value, extra FROM target_columns""",
)
oracle(
    "column_alignment",
    """SELECT s.task, s.ordinal, s.column_name, t.column_type AS target_type
         FROM source_columns s LEFT JOIN target_columns t ON s.task = t.task AND UPPER(s.column_name) = UPPER(t.column_name)""",
)
oracle(
    "unmapped_targets",
    """SELECT t.task, t.column_name, t.column_type FROM target_columns t WHERE NOT EXISTS
       (SELECT 1 FROM source_columns s WHERE s.task = t.task AND UPPER(s.column_name) = UPPER(t.column_name))""",
)
oracle(
    "unique_key_columns",
    "SELECT task, key_name, key_1 || COALESCE(',' || key_2, '') AS key_columns FROM unique_key_rows",
)
oracle(
    "mapping_issues",
    f"""
    WITH keys AS (
        SELECT task, UPPER(key_1) AS name_key, key_1 AS key_column FROM task_keys
        UNION ALL SELECT task, UPPER(key_2), key_2 FROM task_keys WHERE key_2 IS NOT NULL),
    j AS (
        SELECT s.*, t.column_name IS NOT NULL AS has_t, COALESCE(UPPER(t.column_type), '<missing>') AS shown,
               LOWER(t.data_type) AS td, t.precision AS tp, t.scale AS ts, t.length AS tl,
               t.datetime_precision AS tf, t.nullable AS tn, t.character_set AS tc,
               k.name_key IS NOT NULL AS is_key,
               ROW_NUMBER() OVER (PARTITION BY s.task, s.name_key ORDER BY s.ordinal) AS nth
          FROM shape_texts s
          LEFT JOIN target_columns t ON s.task = t.task AND s.name_key = UPPER(t.column_name)
          LEFT JOIN keys k ON k.task = s.task AND k.name_key = s.name_key),
    d AS (
        SELECT *, ts < ds AS scale_short, (tp < ts OR tp - ts < dp - ds) AS integer_short,
               'scale ' || ts || ' < ' || ds AS scale_text,
               'integer digits ' || GREATEST(tp - ts, 0) || ' < ' || (dp - ds) AS integer_text,
               'change to ' || shape_text AS fix
          FROM j),
    per_column AS (
        SELECT d.*, 'SOURCE_REPEATED' AS rule, 'the source column name is not unique' AS detail, 'give every source column its own name' AS suggestion FROM d WHERE nth > 1
        UNION ALL SELECT d.*, 'TARGET_MISSING', 'the target has no column of this name',
               CASE WHEN shape_text IS NOT NULL THEN 'add the target column ' || shape_text || ' NULL'
                    WHEN bare OR rejection = 'NUMBER_HALF_DECLARED' THEN 'declare (p,s) for this column and add the DECIMAL column'
                    WHEN rejection IN ('DECIMAL_UNREPRESENTABLE', 'LENGTH_MISSING') THEN {SUGGESTION.format('rejection')}
                    ELSE 'drop the column from the task, or add a compatible target column' END FROM d WHERE NOT has_t
        UNION ALL SELECT d.*, rejection, {MESSAGE.format('rejection')}, {SUGGESTION.format('rejection')} FROM d WHERE rejection IS NOT NULL
        UNION ALL SELECT d.*, 'NUMBER_TARGET_NOT_DECIMAL', 'a NUMBER needs a DECIMAL target', fix FROM d WHERE family = 'decimal' AND has_t AND td <> 'decimal'
        UNION ALL SELECT d.*, 'DECIMAL_UNDECLARED', 'the target DECIMAL gives no precision and scale', fix FROM d
            WHERE family = 'decimal' AND has_t AND td = 'decimal' AND (tp IS NULL OR ts IS NULL)
        UNION ALL SELECT d.*, 'SCALE_AND_INTEGER_SHORT', scale_text || '; ' || integer_text, fix FROM d WHERE family = 'decimal' AND td = 'decimal' AND scale_short AND integer_short
        UNION ALL SELECT d.*, 'SCALE_SHORT', scale_text || ', values would be rounded silently', fix FROM d WHERE family = 'decimal' AND td = 'decimal' AND scale_short AND NOT integer_short
        UNION ALL SELECT d.*, 'INTEGER_SHORT', integer_text, fix FROM d WHERE family = 'decimal' AND td = 'decimal' AND NOT scale_short AND integer_short
        UNION ALL SELECT d.*, 'NUMBER_SHAPE_UNKNOWN', 'a bare NUMBER needs a target DECIMAL shape', 'declare (p,s) for this column and add the DECIMAL column' FROM d WHERE bare AND NOT has_t
        UNION ALL SELECT d.*, 'NUMBER_TARGET_NOT_DECIMAL', 'a NUMBER needs a DECIMAL target', 'declare (p,s) for this column and change the target to that DECIMAL' FROM d WHERE bare AND has_t AND td <> 'decimal'
        UNION ALL SELECT d.*, 'DECIMAL_SHAPE_INVALID', 'the target DECIMAL of a bare NUMBER has no valid precision and scale', 'give the target DECIMAL a valid (p,s)' FROM d
            WHERE bare AND td = 'decimal' AND NOT COALESCE(tp BETWEEN 1 AND 65 AND ts BETWEEN 0 AND 30 AND ts <= tp, FALSE)
        UNION ALL SELECT d.*, 'TEXT_TARGET_NOT_VARCHAR', 'a character column needs a VARCHAR target', fix FROM d WHERE family = 'varchar' AND has_t AND td <> 'varchar'
        UNION ALL SELECT d.*, 'TEXT_TOO_SHORT', 'the target VARCHAR is shorter than the source length (bytes or characters as the source declares)', fix FROM d
            WHERE family = 'varchar' AND td = 'varchar' AND (tl IS NULL OR tl < length)
        UNION ALL SELECT d.*, 'TEXT_CHARSET', 'the target VARCHAR must use utf8mb4', 'change to utf8mb4' FROM d WHERE family = 'varchar' AND has_t AND tc IS DISTINCT FROM 'utf8mb4'
        UNION ALL SELECT d.*, 'TIME_TARGET_NOT_DATETIME', t || ' needs a DATETIME target', fix FROM d WHERE family = 'datetime' AND has_t AND td <> 'datetime'
        UNION ALL SELECT d.*, 'TIME_FRACTION', t || ' needs exactly ' || CASE t WHEN 'DATE' THEN '0' ELSE '6' END || ' fraction digits', fix FROM d
            WHERE family = 'datetime' AND td = 'datetime' AND tf IS DISTINCT FROM CASE t WHEN 'DATE' THEN 0 ELSE 6 END
        UNION ALL SELECT d.*, 'TARGET_NOT_NULLABLE', 'the target column must accept NULL', 'change to NULL' FROM d WHERE has_t AND NOT tn AND NOT is_key)
    SELECT task, column_name, source_text AS source, shown AS target, rule, detail, suggestion FROM per_column
    UNION ALL SELECT task, '<target_table>', '-', target_table, 'TARGET_NAME_TOO_LONG', 'the staging name would pass 64 characters',
           'shorten the target name to at most 37 characters' FROM task_keys WHERE LENGTH(target_table) > 37
    UNION ALL SELECT t.task, t.column_name, '<unmapped>', UPPER(t.column_type), 'REQUIRED_UNMAPPED',
           'the target column is required but nothing maps to it', 'map the column or give it a default'
      FROM target_columns t WHERE NOT t.nullable AND t.default_value IS NULL AND LOWER(t.extra) NOT LIKE '%auto_increment%'
       AND NOT EXISTS (SELECT 1 FROM source_columns s WHERE s.task = t.task AND UPPER(s.column_name) = UPPER(t.column_name))
    UNION ALL SELECT k.task, k.key_column, '<missing>', COALESCE(UPPER(t.column_type), '<missing>'), 'KEY_NOT_SELECTED',
           'the key column is not among the selected columns', 'select the column or choose another key'
      FROM keys k LEFT JOIN target_columns t ON t.task = k.task AND UPPER(t.column_name) = k.name_key
     WHERE NOT EXISTS (SELECT 1 FROM source_columns s WHERE s.task = k.task AND UPPER(s.column_name) = k.name_key)
    UNION ALL SELECT k.task, k.key_column, '-', UPPER(t.column_type), 'KEY_NULLABLE',
           'the key column must be NOT NULL', 'change the target column to NOT NULL'
      FROM keys k JOIN target_columns t ON t.task = k.task AND UPPER(t.column_name) = k.name_key AND t.nullable
     WHERE EXISTS (SELECT 1 FROM source_columns s WHERE s.task = k.task AND UPPER(s.column_name) = k.name_key)
    UNION ALL SELECT w.task, '<primary_key>', w.key_1 || COALESCE(',' || w.key_2, ''),
           (SELECT string_agg(key_name || '(' || key_1 || COALESCE(',' || key_2, '') || ')', '; ' ORDER BY key_name) FROM unique_key_rows u WHERE u.task = w.task),
           'KEY_NOT_UNIQUE', 'no PRIMARY or UNIQUE key of the target has exactly these columns',
           'create the key on the target or choose other key columns'
      FROM task_keys w WHERE NOT EXISTS (SELECT 1 FROM unique_key_rows u WHERE u.task = w.task
           AND UPPER(u.key_1) = UPPER(w.key_1) AND UPPER(u.key_2) IS NOT DISTINCT FROM UPPER(w.key_2))
    """,
)
DDL = """
    WITH c AS ({columns}),
    lines AS (
        SELECT c.task, k.target_table, k.key_1, k.key_2, c.ordinal,
               '  `' || column_name || '` ' || CASE WHEN NOT bare THEN shape_text WHEN hp IS NULL THEN 'DECIMAL(<p>,<s>)'
                    ELSE 'DECIMAL(' || hp || ',4)' END
               || CASE WHEN name_key IN (UPPER(k.key_1), COALESCE(UPPER(k.key_2), '')) THEN ' NOT NULL' ELSE ' NULL' END AS line,
               CASE WHEN rejection IS NOT NULL THEN column_name || ' (' || source_text || '): ' || {message}
                    WHEN bare AND hp > 65 THEN column_name || ' (' || source_text || '): the declared DECIMAL(' || hp || ',4) exceeds DECIMAL(65,30)' END AS error,
               CASE WHEN bare AND hp IS NULL THEN column_name END AS placeholder
          FROM c JOIN {keys} k ON c.task = k.task),
    lost AS (
        SELECT task, key_2 || ' (<missing>): the key column is not among the source columns' AS error FROM {keys} k
         WHERE key_2 IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.task = k.task AND c.name_key = UPPER(k.key_2))),
    lost_first AS (
        SELECT task, key_1 || ' (<missing>): the key column is not among the source columns' AS error FROM {keys} k
         WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.task = k.task AND c.name_key = UPPER(k.key_1))),
    g AS (
        SELECT l.task, target_table, key_1, key_2, string_agg(line, ',' || chr(10) ORDER BY ordinal) AS body,
               string_agg(l.error, '; ' ORDER BY ordinal) AS errors, string_agg(placeholder, ', ' ORDER BY ordinal) AS names
          FROM lines l GROUP BY ALL),
    e AS (SELECT g.*, NULLIF(concat_ws('; ', errors, f.error, x.error), '') AS all_errors
            FROM g LEFT JOIN lost x ON x.task = g.task LEFT JOIN lost_first f ON f.task = g.task)
    SELECT task, all_errors AS errors, CASE WHEN all_errors IS NULL THEN
           '-- run this yourself; the upsert relies on the primary key' || chr(10)
           || COALESCE('-- declare (p,s) for: ' || names || chr(10), '')
           || 'CREATE TABLE `' || target_table || '` (' || chr(10) || body || ',' || chr(10)
           || '  PRIMARY KEY (`' || key_1 || '`' || COALESCE(', `' || key_2 || '`', '') || ')' || chr(10) || ') DEFAULT CHARSET=utf8mb4;' END AS ddl
      FROM e"""
oracle(
    "target_ddl",
    DDL.format(
        columns="SELECT *, CASE WHEN brand > 12 THEN p_size + 20 END AS hp FROM shape_texts",
        keys="task_keys", message=MESSAGE.format("rejection"),
    ),
)
oracle(
    "target_ddl_accepted",
    DDL.format(
        columns="SELECT *, CAST(NULL AS BIGINT) AS hp FROM shape_texts WHERE rejection IS NULL",
        keys="(SELECT task, target_table, 'C1' AS key_1, CAST(NULL AS STRING) AS key_2 FROM task_keys)",
        message=MESSAGE.format("rejection"),
    ),
)
oracle(
    "ddl_round_trip",
    """WITH c AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY task, name_key ORDER BY ordinal) AS nth FROM shape_texts WHERE rejection IS NULL),
       n AS (SELECT task, COUNT(*) AS columns, COUNT(*) FILTER (t = 'TIMESTAMP') AS times, COUNT(*) FILTER (family = 'varchar') AS texts
               FROM c WHERE nth = 1 GROUP BY task HAVING COUNT(*) FILTER (name_key = 'C1') > 0)
       SELECT task, 'made' AS variant, columns, '' AS rules FROM n
       UNION ALL SELECT task, 'changed', columns, concat_ws(',', 'KEY_NOT_UNIQUE:1', CASE WHEN texts > 0 THEN 'TEXT_CHARSET:' || texts END,
              CASE WHEN times > 0 THEN 'TIME_FRACTION:' || times END) FROM n""",
)
oracle(
    "staging_ddl",
    """SELECT task, 'CREATE TABLE `T_' || task || '__stg_20240102030405_0a1b2c` (' || chr(10) || string_agg(
              '  `' || column_name || '` ' || column_type || COALESCE(' CHARACTER SET ' || character_set, '') || ' NULL',
              ',' || chr(10) ORDER BY ordinal) || chr(10) || ')' AS ddl
         FROM target_columns GROUP BY task""",
)
RANGE_PLAN = """SELECT s.task, s.column_name, t.precision, t.scale FROM shape_texts s
         JOIN target_columns t ON s.task = t.task AND s.name_key = UPPER(t.column_name)
        WHERE bare AND LOWER(t.data_type) = 'decimal' AND t.precision BETWEEN 1 AND 65 AND t.scale BETWEEN 0 AND 30
          AND t.scale <= t.precision"""
oracle("range_check_plan", RANGE_PLAN)
oracle(
    "range_verdict",
    f"""WITH planned AS (SELECT task, UPPER(column_name) AS n, precision, scale FROM ({RANGE_PLAN}) p),
        measured AS (SELECT task, UPPER(column_name) AS n, COUNT(*) AS results,
                            MAX(CASE WHEN p_size > 30 THEN p_size ELSE 0 END) AS invalid_rows
                       FROM source_columns WHERE type_name = 'number' OR brand = 25 GROUP BY 1, 2)
        SELECT COALESCE(p.task, m.task) AS task, COALESCE(p.n, m.n) AS column_name, precision, scale, invalid_rows,
               CASE WHEN p.task IS NULL THEN 'NOT_REQUESTED' WHEN m.task IS NULL THEN 'NOT_MEASURED'
                    WHEN results > 1 THEN 'MEASURED_TWICE' WHEN invalid_rows > 0 THEN 'OUT_OF_RANGE' ELSE 'OK' END AS verdict
          FROM planned p FULL JOIN measured m ON p.task = m.task AND p.n = m.n""",
)
oracle(
    "type_census",
    """SELECT task, type_name, precision, scale, COUNT(*) AS col_count, MIN(column_name) AS sample_col,
              string_agg(column_name, ' ' ORDER BY ordinal) AS columns
         FROM source_columns GROUP BY task, type_name, precision, scale""",
)
oracle(
    "unsupported_types",
    """SELECT task, ordinal, column_name, type_name,
              CASE WHEN bare THEN 'BARE_NUMBER' ELSE rejection END AS finding
         FROM shape_texts WHERE bare OR rejection IN ('TYPE_NOT_LISTED', 'FSP_TOO_PRECISE')""",
)
oracle(
    "orphan_staging",
    """WITH e AS (SELECT *, strftime(ts, '%Y%m%d%H%M%S') || '_' || lower(lpad(hex(event_id), 6, '0')) AS run_id FROM events)
       SELECT upper(event_type) || '__stg_' || run_id AS table_name, upper(event_type) AS target_table, run_id,
              date_trunc('second', ts) AS started_at
         FROM e WHERE event_type NOT IN ('view', 'click')""",
)

# --- values ---
PRICE = number_text("l_extendedprice")
oracle(
    "range_audit_lineitem",
    f"""WITH r AS (SELECT *, {PRICE} AS price_text FROM lineitem_base)
        SELECT 'l_quantity' AS column_name, COUNT(*) AS scanned_rows,
               COUNT(*) FILTER (l_quantity <> TRUNC(l_quantity * 10) / 10 OR ABS(l_quantity) >= 100) AS invalid_rows FROM r
        UNION ALL SELECT 'l_extendedprice', COUNT(*), COUNT(*) FILTER ((l_extendedprice * 10) <> FLOOR(l_extendedprice * 10) OR ABS(l_extendedprice) >= 1000000) FROM r
        UNION ALL SELECT 'l_discount', COUNT(*), COUNT(*) FILTER ((l_discount * 100) <> FLOOR(l_discount * 100) OR ABS(l_discount) >= 10) FROM r
        UNION ALL SELECT 'l_tax', COUNT(*), 0 FROM r
        UNION ALL SELECT 'l_orderkey', COUNT(*), COUNT(*) FILTER (ABS(l_orderkey) >= 10000) FROM r
        UNION ALL SELECT 'price_text', COUNT(*), COUNT(*) FILTER (ABS(l_extendedprice) >= 10000) FROM r""",
)
OP = number_text("o_totalprice")
oracle(
    "canon_values",
    f"""WITH r AS (SELECT *, {OP} AS price_text FROM orders_base)
        SELECT o_orderkey, price_text, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS day_text,
               regexp_full_match(price_text, '{NUMBER}') AS canonical,
               {whole('price_text')} AS integer_digits, {fraction('price_text')} AS fraction_digits,
               {whole('price_text')} <= 6 AND {fraction('price_text')} <= 1 AS fits FROM r""",
)
oracle(
    "canon_timestamps",
    """WITH r AS (SELECT event_id, ts, event_id % 33 AS d, event_id % 62 AS s, event_id * 500 AS ns,
                         strftime(ts, '%Y-%m-') || lpad(CAST(event_id % 33 AS STRING), 2, '0') || strftime(ts, ' %H:%M:')
                         || lpad(CAST(event_id % 62 AS STRING), 2, '0') AS spelled FROM events)
       SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS as_is,
              CASE WHEN s < 60 AND TRY_CAST(spelled AS TIMESTAMP) IS NOT NULL THEN spelled END AS as_date,
              CASE WHEN s < 60 AND TRY_CAST(spelled AS TIMESTAMP) IS NOT NULL AND ns % 1000 = 0 AND ns < 1000000000
                   THEN spelled || '.' || lpad(CAST(ns // 1000 AS STRING), 6, '0') END AS as_timestamp FROM r""",
)
oracle(
    "canon_rejects",
    f"""WITH r AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '+' || CAST(o_totalprice AS STRING)
                WHEN '2-HIGH' THEN CAST(o_totalprice AS STRING) WHEN '3-MEDIUM' THEN replace(CAST(o_totalprice AS STRING), '.', ',')
                WHEN '5-LOW' THEN {OP} || chr(10) ELSE {OP} END AS price FROM orders_base)
        SELECT o_orderkey, 'price' AS column_name, price AS value, 'NUMBER_NOT_CANONICAL' AS reason
          FROM r WHERE NOT regexp_full_match(price, '{NUMBER}')""",
)
EV = number_text("CAST(value AS DECIMAL(18,2))")
oracle(
    "target_rejects",
    f"""WITH r AS (SELECT event_id, {EV} AS amount, props AS note,
                CASE WHEN event_type = 'view' THEN replace(strftime(ts, '%Y-%m-%d %H:%M:%S'), '-01 ', '-32 ') ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS moment,
                CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(event_id AS STRING) END AS number FROM events)
        SELECT event_id, 'amount' AS column_name, amount AS value, 'OUT_OF_RANGE' AS reason, 1264 AS code FROM r WHERE {whole('amount')} > 2
        UNION ALL SELECT event_id, 'number', number, 'NOT_A_NUMBER', 1366 FROM r WHERE number = 'n/a'
        UNION ALL SELECT event_id, 'number', number, 'OUT_OF_RANGE', 1264 FROM r WHERE number <> 'n/a' AND LENGTH(number) > 5
        UNION ALL SELECT event_id, 'moment', moment, 'BAD_DATETIME', 1292 FROM r WHERE TRY_CAST(moment AS TIMESTAMP) IS NULL
        UNION ALL SELECT event_id, 'note', note, 'TOO_LONG', 1406 FROM r WHERE LENGTH(note) > 8""",
)
DISC = number_text("l_discount")
oracle(
    "silent_rounding",
    f"""WITH r AS (SELECT *, {DISC} AS d FROM lineitem_base)
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'discount' AS column_name, d AS value, 'WOULD_ROUND' AS reason
          FROM r WHERE {fraction('d')} > 1""",
)


def numeric_profile(table: str, column: str, kind: str) -> str:
    text = number_text(column)
    parts = {
        "max_len_val": f"(SELECT v FROM (SELECT {text} AS v FROM {table} WHERE {column} IS NOT NULL) x ORDER BY LENGTH(v) DESC, v DESC LIMIT 1)",
        "min_val": f"(SELECT {number_text(f'MIN({column})')} FROM {table})",
        "max_val": f"(SELECT {number_text(f'MAX({column})')} FROM {table})",
        "max_scale_val": f"(SELECT v FROM (SELECT {text} AS v FROM {table} WHERE {column} <> FLOOR({column})) x ORDER BY {fraction('v')} DESC, v DESC LIMIT 1)",
        "zero_cnt": f"(SELECT CAST(COUNT(*) FILTER ({column} = 0) AS STRING) FROM {table})",
        "null_cnt": f"(SELECT CAST(COUNT(*) FILTER ({column} IS NULL) AS STRING) FROM {table})",
    }
    return profile_rows(column, kind, parts)


def time_profile(table: str, column: str) -> str:
    parts = {
        "min_val": f"(SELECT strftime(MIN({column}), '%Y-%m-%d %H:%M:%S.%f') FROM {table})",
        "max_val": f"(SELECT strftime(MAX({column}), '%Y-%m-%d %H:%M:%S.%f') FROM {table})",
        "with_time_cnt": f"(SELECT CAST(COUNT(*) FILTER ({column} <> date_trunc('day', {column})) AS STRING) FROM {table})",
        "null_cnt": f"(SELECT CAST(COUNT(*) FILTER ({column} IS NULL) AS STRING) FROM {table})",
    }
    return profile_rows(column, "timestamp_ntz", parts)


def text_profile(table: str, column: str) -> str:
    parts = {
        "max_len_val": f"(SELECT {column} FROM {table} WHERE {column} IS NOT NULL ORDER BY LENGTH({column}) DESC, {column} DESC LIMIT 1)",
        "multibyte_val": f"(SELECT MAX({column}) FILTER (strlen({column}) > LENGTH({column})) FROM {table})",
        "null_cnt": f"(SELECT CAST(COUNT(*) FILTER ({column} IS NULL) AS STRING) FROM {table})",
    }
    return profile_rows(column, "string", parts)


def profile_rows(column: str, kind: str, parts: dict[str, str]) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{column}' AS column_name, '{kind}' AS data_type, '{name}' AS kind, {value} AS value" for name, value in parts.items()
    )
    return (
        "SELECT column_name, data_type, kind, COALESCE(value, '<NULL>') AS value, "
        f"COALESCE(LENGTH(value), 0) AS value_len FROM ({rows}) x"
    )


oracle(
    "profile_numeric",
    " UNION ALL ".join(
        numeric_profile("lineitem_base", c, k)
        for c, k in (("l_quantity", "decimal(18,2)"), ("l_extendedprice", "decimal(18,2)"), ("l_discount", "decimal(18,4)"), ("l_tax", "decimal(18,4)"))
    ),
)
oracle("profile_time", time_profile("events", "ts") + " UNION ALL " + time_profile("lineitem", "l_shipdate"))
oracle(
    "profile_text",
    " UNION ALL ".join(
        text_profile(t, c)
        for t, c in (("documents", "text"), ("documents", "lang"), ("documents", "source"), ("customer", "c_name"), ("customer", "c_mktsegment"))
    ),
)

# --- upsert and checks ---
MERGED = """SELECT COALESCE(t.o_orderkey, s.o_orderkey) AS o_orderkey,
        CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
        CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
        CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
        CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderdate ELSE t.o_orderdate END AS o_orderdate,
        CASE WHEN s.o_orderkey IS NOT NULL THEN s.o_orderpriority ELSE t.o_orderpriority END AS o_orderpriority,
        CASE WHEN t.o_orderkey IS NOT NULL THEN t.o_note ELSE 'new' END AS o_note,
        CASE WHEN t.o_orderkey IS NULL THEN 'inserted' WHEN s.o_orderkey IS NULL THEN 'kept'
             WHEN t.o_totalprice = s.o_totalprice THEN 'unchanged' ELSE 'updated' END AS effect
   FROM orders_target t FULL JOIN orders_base s ON t.o_orderkey = s.o_orderkey"""
oracle("upsert_orders", MERGED)
oracle(
    "upsert_effect",
    f"""WITH m AS ({MERGED}), c AS (SELECT COUNT(*) FILTER (effect = 'inserted') AS i, COUNT(*) FILTER (effect = 'updated') AS u,
               COUNT(*) FILTER (effect = 'unchanged') AS s, COUNT(*) FILTER (effect = 'kept') AS k FROM m)
        SELECT i AS inserted, u AS updated, s AS unchanged, k AS kept, i + u + s AS staged_rows, i + 2 * u + s AS affected FROM c""",
)
oracle(
    "upsert_allkeys",
    "SELECT o_custkey, o_orderkey FROM orders_target UNION SELECT o_custkey, o_orderkey FROM orders_base",
)
oracle(
    "key_guard",
    """WITH k AS (SELECT l_orderkey, l_linenumber, COUNT(*) AS n FROM lineitem_base GROUP BY 1, 2)
       SELECT CAST(SUM(n) AS BIGINT) AS rows, CAST(COALESCE(SUM(n) FILTER (l_orderkey IS NULL OR l_linenumber IS NULL), 0) AS BIGINT) AS null_key_rows,
              COUNT(*) AS distinct_keys, COUNT(*) FILTER (n > 1) AS duplicated_keys, CAST(SUM(n - 1) AS BIGINT) AS surplus_rows FROM k""",
)
oracle(
    "duplicate_keys",
    "SELECT l_orderkey, l_linenumber, COUNT(*) AS copies FROM lineitem_base GROUP BY 1, 2 HAVING COUNT(*) > 1",
)
oracle(
    "key_latest",
    """SELECT * EXCLUDE (n) FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS FIRST,
              l_extendedprice ASC NULLS LAST, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_discount DESC, l_tax DESC,
              l_returnflag DESC, l_linestatus DESC) AS n FROM lineitem_base) x WHERE n = 1""",
)
oracle(
    "order_statistic_bytes",
    """WITH r AS (SELECT l_returnflag, CAST(l_extendedprice * 100 AS BIGINT) AS cents FROM lineitem_base)
       SELECT l_returnflag, cents AS middle FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY cents) - 1 AS i,
              COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM r) x WHERE i = n // 2""",
)
oracle(
    "verify_gate",
    """WITH c AS (SELECT run_record_id || '/' || pos AS run_id, source_rows, source_batches,
              CASE WHEN value IS NULL THEN staged_rows ELSE source_rows END AS staged_rows, source_rows AS sink_reported_rows,
              CASE WHEN source_batches = 99 THEN 98 ELSE received_batches END AS received_batches FROM log_lines WHERE event = 'run_finished')
       SELECT *, CASE WHEN staged_rows = source_rows AND received_batches = source_batches THEN 'PASSED' ELSE 'VERIFY_FAILED' END AS verdict,
              CASE WHEN staged_rows = source_rows AND received_batches = source_batches THEN NULL
                   WHEN received_batches = source_batches AND staged_rows < sink_reported_rows THEN 'LOST_IN_WRITE' ELSE 'BATCH_NOT_DELIVERED' END AS cause FROM c""",
)
oracle(
    "batch_contiguity",
    """WITH r AS (SELECT l_returnflag || '-' || l_linestatus || '-' || l_suppkey AS run_id, l_linenumber AS b FROM lineitem_base)
       SELECT run_id, 7 AS source_batches, MIN(b) AS first_batch, MAX(b) AS last_batch, COUNT(DISTINCT b) AS batches, COUNT(*) AS rows,
              MIN(b) = 1 AND MAX(b) = 7 AND COUNT(DISTINCT b) = 7 AS contiguous FROM r GROUP BY run_id""",
)
oracle(
    "sequence_gaps",
    """WITH r AS (SELECT run_record_id AS run_id, seq, COALESCE(LAG(seq) OVER (PARTITION BY run_record_id ORDER BY seq), 0) + 1 AS expected
                    FROM log_lines WHERE event = 'batch_pushed')
       SELECT run_id, expected, seq AS got FROM r WHERE expected <> seq""",
)
DIGEST_TEXT = " || ".join(
    f"LENGTH({cell}) || ':' || {cell}"
    for cell in (
        "CAST(o_orderkey AS STRING)",
        "CAST(o_custkey AS STRING)",
        "o_orderstatus",
        OP,
        "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f')",
        "o_orderpriority",
    )
)


def digest(table: str) -> str:
    words = [f"CAST('0x' || substr(h, {at}, {n}) AS BIGINT)" for at, n in ((1, 15), (16, 15), (31, 15), (46, 15), (61, 4))]
    sums = ", ".join(f"SUM(CAST({w} AS HUGEINT))" for w in words)
    xors = ", ".join(f"bit_xor({w})" for w in words)
    return f"""SELECT COUNT(*) AS rows, concat_ws(':', {sums}) AS hash_sum, concat_ws(':', {xors}) AS hash_xor
                 FROM (SELECT sha256({DIGEST_TEXT}) AS h FROM {table}) x"""


oracle("table_digest", digest("orders_base"))
oracle(
    "rerun_digest",
    f"""WITH m AS ({MERGED}), d AS ({digest('m')}) SELECT *, 1 AS copy FROM d UNION ALL SELECT *, 2 FROM d""",
)
RECONCILE = """WITH j AS (SELECT s.o_orderkey IS NOT NULL AND t.o_orderkey IS NOT NULL AS both_sides, s.o_orderkey AS sk, t.o_orderkey AS tk,
              s.o_custkey IS DISTINCT FROM t.o_custkey AS d1, s.o_orderstatus IS DISTINCT FROM t.o_orderstatus AS d2,
              s.o_totalprice IS DISTINCT FROM t.o_totalprice AS d3, s.o_orderdate IS DISTINCT FROM t.o_orderdate AS d4,
              s.o_orderpriority IS DISTINCT FROM t.o_orderpriority AS d5
         FROM orders_base s FULL JOIN orders_target t ON s.o_orderkey = t.o_orderkey),
       n AS (SELECT COUNT(*) FILTER (both_sides) AS matched, COUNT(*) FILTER (tk IS NULL) AS only_in_source, COUNT(*) FILTER (sk IS NULL) AS only_in_target,
              COUNT(*) FILTER (both_sides AND d1) AS n1, COUNT(*) FILTER (both_sides AND d2) AS n2, COUNT(*) FILTER (both_sides AND d3) AS n3,
              COUNT(*) FILTER (both_sides AND d4) AS n4, COUNT(*) FILTER (both_sides AND d5) AS n5 FROM j)
       SELECT 'o_custkey' AS column_name, matched, n1 AS different, only_in_source, only_in_target FROM n
       UNION ALL SELECT 'o_orderstatus', matched, n2, only_in_source, only_in_target FROM n
       UNION ALL SELECT 'o_totalprice', matched, n3, only_in_source, only_in_target FROM n
       UNION ALL SELECT 'o_orderdate', matched, n4, only_in_source, only_in_target FROM n
       UNION ALL SELECT 'o_orderpriority', matched, n5, only_in_source, only_in_target FROM n"""
oracle("reconcile_orders", RECONCILE)
oracle("reconcile_tree", RECONCILE)
oracle(
    "differing_ranges",
    """WITH span AS (SELECT MIN(o_orderkey) AS low, MAX(o_orderkey) - MIN(o_orderkey) AS width FROM orders_base),
       size AS (SELECT low, GREATEST(LENGTH(FORMAT('{:b}', width)) - CASE WHEN width = 0 THEN 1 ELSE 0 END - 12, 0) AS shift FROM span),
       n AS (SELECT (o_orderkey - low) >> shift AS node, low, shift, COUNT(*) AS rows
               FROM orders_base, size GROUP BY 1, 2, 3 HAVING COUNT(*) FILTER (o_totalprice >= 450000) > 0)
       SELECT low + (node << shift) AS first_key, low + ((node + 1) << shift) - 1 AS last_key, rows AS source_rows, rows AS target_rows FROM n""",
)
oracle(
    "snapshot_diff",
    """WITH a AS (SELECT o_orderkey, o_totalprice FROM orders_base), b AS (SELECT o_orderkey, o_totalprice FROM orders_target),
       m AS (SELECT COUNT(*) AS n FROM (SELECT * FROM a EXCEPT SELECT * FROM b) x),
       d AS (SELECT COUNT(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) x)
       SELECT m.n AS missing_rows, d.n AS added_rows, m.n + d.n AS symmetric_diff FROM m, d""",
)

# --- numbering and payloads ---
oracle(
    "page_rows",
    """SELECT o_orderkey, rn, (rn - 1) // 5000 + 1 AS page_no FROM
       (SELECT o_orderkey, ROW_NUMBER() OVER (ORDER BY o_orderdate, o_orderkey) AS rn FROM orders_base) x""",
)
BATCHES = """SELECT *, (ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) // 5000 + 1 AS batch_no,
             (ROW_NUMBER() OVER (ORDER BY o_orderkey) - 1) % 5000 + 1 AS row_no FROM orders_base"""
oracle("batch_assign", f"SELECT o_orderkey, batch_no, row_no FROM ({BATCHES}) x")
oracle(
    "staging_replay",
    f"""WITH b AS ({BATCHES})
        SELECT '20240102030405_0a1b2c' AS run_id, batch_no, o_orderkey,
               CASE WHEN batch_no = (SELECT MAX(batch_no) FROM b) THEN 'again' ELSE 'first' END AS sent FROM b""",
)
oracle(
    "staged_counts",
    f"""SELECT o_orderstatus AS run_id, COUNT(*) AS staged_rows, COUNT(DISTINCT batch_no) AS received_batches
          FROM ({BATCHES}) b GROUP BY o_orderstatus""",
)
oracle(
    "batch_running",
    """SELECT run_record_id, seq, rows, CAST(SUM(rows) OVER (PARTITION BY run_record_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS source_rows
         FROM log_lines WHERE event = 'batch_pushed'""",
)
oracle(
    "batch_limits",
    "SELECT COUNT(*) AS rows, TRUE AS no_gap, TRUE AS within_rows, TRUE AS within_bytes FROM documents",
)
CELL = "'[\"' || o_orderkey || '\",\"' || o_orderstatus || '\",\"' || " + OP + " || '\",\"' || o_orderpriority || '\"]'"
oracle(
    "batch_payload",
    f"""WITH p AS (SELECT batch_no, COUNT(*) AS rows, '{{"seq":' || batch_no || ',"rows":[' || string_agg({CELL}, ',' ORDER BY row_no) || ']}}' AS payload
                     FROM ({BATCHES}) x GROUP BY batch_no)
        SELECT batch_no, rows, strlen(payload) AS bytes, sha256(payload) AS digest FROM p""",
)
oracle(
    "payload_parse",
    """SELECT event_id, CASE WHEN k >= 20 THEN event_id END AS seq,
              CASE WHEN k < 20 THEN 'BAD_SHAPE' WHEN k BETWEEN 25 AND 29 THEN 'BAD_WIDTH' END AS reason,
              CASE WHEN k >= 20 AND k NOT BETWEEN 25 AND 29 THEN event_type END AS first_cell,
              CASE WHEN k >= 30 THEN CAST(user_id AS STRING) END AS second_cell FROM log_base""",
)

# --- run log and history ---
FOLD = """
    owner AS (SELECT run_record_id, arg_min(run_id, pos) AS owner_run FROM log_lines WHERE run_id IS NOT NULL GROUP BY 1),
    a AS (SELECT l.*, o.owner_run FROM log_lines l LEFT JOIN owner o ON o.run_record_id = l.run_record_id
           WHERE l.run_id IS NULL OR l.run_id = o.owner_run),
    e AS (SELECT *, event = 'run_finished' AS fin, event = 'task_config_failed' AS ref, event = 'batch_pushed' AS bp,
                 CASE WHEN terminal = 'SUCCEEDED' THEN 'SWAPPED' WHEN terminal = 'FAILED' AND sink_code = 'VERIFY_FAILED' THEN 'DISCARDED'
                      WHEN terminal = 'FAILED' AND stage = 'COMMITTING' THEN 'UNKNOWN' WHEN terminal = 'FAILED' THEN 'DISCARDED' END AS implied,
                 CASE WHEN event = 'task_config_failed' THEN 'DISCARDED' WHEN terminal IN ('SWAPPED', 'DISCARDED') THEN terminal ELSE 'UNKNOWN' END AS told
            FROM a),
    f AS (SELECT run_record_id, MAX(owner_run) AS run_id,
                 list(staging_table ORDER BY pos DESC) FILTER (event = 'run_opened')[1] AS staging_table,
                 arg_max(ts, pos) FILTER (event = 'source_started' AND ts IS NOT NULL) AS logged_start,
                 MAX(pos) FILTER (fin) AS fin_pos, MAX(pos) FILTER (ref) AS ref_pos,
                 list(stage ORDER BY pos DESC) FILTER (event = 'stage_changed' OR fin)[1] AS stage,
                 arg_max(told, pos) FILTER (event IN ('commit_diagnosed', 'task_config_failed')) AS told_effect,
                 arg_min(implied, pos) FILTER (fin AND implied IS NOT NULL) AS implied_effect,
                 COALESCE(arg_max(seq, pos) FILTER (bp), 0) AS seq,
                 CAST(COALESCE(SUM(rows) FILTER (bp), 0) AS BIGINT) AS rows_pushed,
                 CAST(COALESCE(SUM(bytes) FILTER (bp), 0) AS BIGINT) AS bytes, CAST(COALESCE(SUM(ms) FILTER (bp), 0) AS BIGINT) AS ms,
                 COUNT(*) FILTER (event = 'mapping_precheck_failed') AS mapping_issue_count,
                 arg_max(ts, pos) FILTER (ts IS NOT NULL) AS last_ts
            FROM e GROUP BY run_record_id),
    h AS (SELECT f.*, COALESCE(ref_pos > COALESCE(fin_pos, -1), FALSE) AS by_ref,
                 t.ts AS t_ts, t.terminal AS t_terminal, t.message AS t_message, t.value AS t_value, t.failure_kind AS t_kind,
                 r.ts AS r_ts, r.message AS r_message, r.value AS r_value, r.failure_kind AS r_kind,
                 t.source_rows, t.staged_rows, t.sink_reported_rows, t.purged_rows, t.source_batches, t.received_batches,
                 t.fetch_ms, t.push_ms, t.commit_ms, t.count_ms, t.cursor_ms, t.source_code, t.sink_code, t.column_name
            FROM f LEFT JOIN log_lines t ON t.pos = f.fin_pos LEFT JOIN log_lines r ON r.pos = f.ref_pos),
    hist AS (SELECT c.run_record_id, h.run_id, c.task_id, c.segment, c.source_text, h.staging_table,
                 COALESCE(h.logged_start, c.accepted_at) AS started_at,
                 CASE WHEN by_ref THEN r_ts ELSE t_ts END AS finished_at, CASE WHEN by_ref THEN 'FAILED' ELSE t_terminal END AS outcome,
                 COALESCE(told_effect, implied_effect) AS target_table_effect, h.stage,
                 source_rows, staged_rows, sink_reported_rows, purged_rows, source_batches, received_batches, fetch_ms, push_ms,
                 commit_ms, count_ms, cursor_ms, source_code, sink_code, column_name AS "column",
                 CASE WHEN by_ref THEN r_value ELSE t_value END AS value, CASE WHEN by_ref THEN r_message ELSE t_message END AS message,
                 CASE WHEN by_ref THEN r_kind ELSE t_kind END AS failure_kind, CAST(NULL AS STRING) AS unknown_reason,
                 COALESCE(seq, 0) AS seq, COALESCE(rows_pushed, 0) AS rows_pushed, COALESCE(bytes, 0) AS bytes, COALESCE(ms, 0) AS ms,
                 COALESCE(mapping_issue_count, 0) AS mapping_issue_count, last_ts
            FROM accepted_runs c LEFT JOIN h ON h.run_record_id = c.run_record_id)"""


def history_oracle(name: str, select: str) -> None:
    oracle(name, f"WITH {FOLD} {select}")


history_oracle("run_history", "SELECT * EXCLUDE (segment) FROM hist")
history_oracle("live_runs_stream", "SELECT * EXCLUDE (segment) FROM hist")
history_oracle("live_runs_folded", "SELECT * EXCLUDE (segment) FROM hist")
history_oracle(
    "mapping_issue_lines",
    'SELECT run_record_id, pos, column_name AS "column", source, target, rule, message, suggestion FROM a WHERE event = \'mapping_precheck_failed\'',
)
history_oracle(
    "sealed_runs",
    """SELECT run_record_id, COALESCE(outcome, 'FAILED') AS outcome, CASE WHEN outcome IS NOT NULL THEN target_table_effect END AS target_table_effect,
              CASE WHEN outcome IS NULL THEN '2024-06-01T00:00:00.000Z' ELSE finished_at END AS finished_at,
              CASE WHEN outcome IS NULL THEN 'the service restarted, the outcome is unknown' ELSE message END AS message,
              CASE WHEN outcome IS NULL THEN 'SERVICE_RESTARTED' END AS unknown_reason,
              CASE WHEN outcome IS NULL THEN 'UNKNOWN' ELSE failure_kind END AS failure_kind,
              CASE WHEN outcome IS NOT NULL THEN sink_code END AS sink_code FROM hist""",
)
history_oracle(
    "history_retention",
    "SELECT run_record_id, started_at FROM hist WHERE CAST(replace(started_at, 'Z', '') AS TIMESTAMP) >= TIMESTAMP '2024-01-05'",
)
history_oracle("history_list", "SELECT run_record_id, task_id, started_at, outcome FROM hist")
STATE = """CASE WHEN outcome IS NULL THEN 'live' WHEN outcome = 'SUCCEEDED' THEN 'succeeded' ELSE 'failed' END"""
history_oracle(
    "run_states",
    f"""SELECT run_record_id, {STATE} AS run_state,
               CASE WHEN outcome IS NULL THEN CASE WHEN stage IN ('PREPARING', 'STREAMING', 'COMMITTING') THEN 'live' ELSE 'accepted' END
                    WHEN sink_code = 'PRECHECK_FAILED' THEN 'mapping-failed' ELSE {STATE} END AS run_view,
               CASE WHEN run_id IS NOT NULL AND staging_table IS NOT NULL AND sink_code IS DISTINCT FROM 'PRECHECK_FAILED'
                     AND target_table_effect IN ('SWAPPED', 'DISCARDED') THEN target_table_effect END AS shown_effect FROM hist""",
)
history_oracle(
    "rerun_candidates",
    f"""SELECT run_record_id, h.task_id, {STATE} AS run_state, t.task_id IS NOT NULL AS enabled,
               CASE WHEN t.task_id IS NULL THEN 'the task was deleted' END AS reason
          FROM hist h LEFT JOIN live_tasks t ON t.task_id = h.task_id WHERE {STATE} = 'failed'""",
)
history_oracle(
    "runs_with_task",
    """SELECT run_record_id, h.task_id, t.task_name, t.task_id IS NULL AS task_deleted
         FROM hist h LEFT JOIN live_tasks t ON t.task_id = h.task_id""",
)
history_oracle(
    "live_totals",
    "SELECT run_record_id, run_id, stage, seq, rows_pushed, ms, bytes, last_ts FROM hist WHERE outcome IS NULL",
)
history_oracle(
    "overlapping_runs",
    """SELECT task_id, '[{"key":"segment","value":"' || segment || '"}]' AS params, COUNT(*) AS open_runs,
              MIN(run_record_id) AS first_record, MAX(run_record_id) AS last_record
         FROM hist WHERE outcome IS NULL GROUP BY task_id, segment HAVING COUNT(*) > 1""",
)
oracle(
    "run_measures",
    """WITH s AS (SELECT run_record_id, MAX(pos) FILTER (event = 'run_finished') AS p,
                 MIN(rows) FILTER (event = 'batch_pushed') AS rows_min, MAX(rows) FILTER (event = 'batch_pushed') AS rows_max,
                 MIN(bytes) FILTER (event = 'batch_pushed') AS bytes_min, MAX(bytes) FILTER (event = 'batch_pushed') AS bytes_max,
                 list_sort(list(bytes) FILTER (event = 'batch_pushed')) AS sorted FROM log_lines GROUP BY 1)
       SELECT s.run_record_id, t.source_rows, t.source_batches, t.fetch_ms, t.push_ms, t.cursor_ms, t.commit_ms, t.count_ms, t.purged_rows,
              CASE WHEN t.cursor_ms <> 0 THEN CAST((t.push_ms * 10000 // t.cursor_ms) / 100 AS DECIMAL(18,2)) END AS push_percent,
              rows_min, rows_max, bytes_min, sorted[len(sorted) // 2 + 1] AS bytes_p50, bytes_max
         FROM s LEFT JOIN log_lines t ON t.pos = s.p""",
)
oracle(
    "payload_accounting",
    """WITH s AS (SELECT run_record_id, CAST(COALESCE(SUM(rows) FILTER (event = 'batch_pushed'), 0) AS BIGINT) AS r,
                 COUNT(*) FILTER (event = 'batch_pushed') AS n, CAST(COALESCE(SUM(bytes) FILTER (event = 'batch_pushed'), 0) AS BIGINT) AS b,
                 list_sort(list(bytes) FILTER (event = 'batch_pushed')) AS sorted FROM log_lines GROUP BY 1)
       SELECT run_record_id, CASE WHEN n > 0 AND r > 0 THEN r END AS rows, CASE WHEN n > 0 AND r > 0 THEN n END AS batches,
              CASE WHEN n > 0 AND r > 0 THEN b // r END AS bytes_per_row, CASE WHEN n > 0 AND r > 0 THEN sorted[n // 2 + 1] END AS bytes_p50,
              CASE WHEN n > 0 AND r > 0 THEN CAST((b * 100 // 1048576) / 100 AS DECIMAL(18,2)) END AS mib FROM s""",
)
oracle(
    "failure_kinds",
    """WITH codes AS (SELECT ['PRECHECK_FAILED', 'VERIFY_FAILED', 'SWAP_TARGET_BUSY', 'DATA_REJECTED', 'SINK_ENVIRONMENT', 'STAGING_CREATE_FAILED',
              'BATCH_WRITE_FAILED', 'SWAP_FAILED', 'SEQ_MISMATCH', 'RUN_SEALED', 'RUN_UNKNOWN', 'PAYLOAD_TOO_LARGE', 'BAD_REQUEST',
              'INTERNAL_PRECHECK_ESCAPE', 'INTERNAL_ASSERTION_FAILED', 'SOMETHING_NEW'] AS c),
       r AS (SELECT c[k % 16 + 1] AS sink_code, [2019, 2020, 2068, 12154, 12170, 12203, 12514, 12541, 1555][k % 9 + 1] AS source_code,
                    event_type = 'signup' AS connecting FROM log_base, codes)
       SELECT sink_code, CASE WHEN sink_code = 'PRECHECK_FAILED' THEN 'MAPPING_PRECHECK' WHEN sink_code IN ('VERIFY_FAILED', 'DATA_REJECTED', 'SINK_ENVIRONMENT') THEN sink_code
                   WHEN sink_code = 'SWAP_TARGET_BUSY' THEN 'TARGET_BUSY' WHEN sink_code IN ('STAGING_CREATE_FAILED', 'BATCH_WRITE_FAILED', 'SWAP_FAILED') THEN 'SINK_WRITE'
                   ELSE 'DEFECT' END AS sink_kind,
              CASE WHEN connecting THEN 'SOURCE_CONNECT' WHEN source_code <> 1555 THEN 'SOURCE_DBLINK' ELSE 'SOURCE_QUERY' END AS source_kind,
              COUNT(*) AS events FROM r GROUP BY 1, 2, 3""",
)
oracle(
    "log_lines_written",
    "SELECT run_record_id, pos, ts, 'info' AS level, event, run_id, stage, seq, rows, bytes, source_rows FROM log_lines",
)
oracle(
    "batch_intake_stream",
    """SELECT '20240102030405_' || CASE o_orderstatus WHEN 'F' THEN '00000f' ELSE '0000aa' END AS run_id, o_orderkey + 1 AS batch_no, 1 AS row_no,
              CAST(o_orderkey AS STRING) AS order_id, o_orderstatus AS status, o_orderpriority AS priority
         FROM orders_base WHERE o_orderstatus <> 'P'""",
)
oracle(
    "publish_touched_buckets",
    """WITH o AS (SELECT o_orderkey, o_orderstatus, CAST(o_totalprice AS DECIMAL(12,2)) AS o_totalprice, o_orderkey % 1000 IN (3, 8) AS later,
                      CAST('0x' || substr(md5(CAST(o_orderkey AS STRING)), 1, 12) AS BIGINT) % 64 AS bucket FROM orders_base)
       SELECT o_orderkey, o_orderstatus, CAST(o_totalprice + CASE WHEN later THEN 1 ELSE 0 END AS DECIMAL(12,2)) AS o_totalprice,
              bucket IN (SELECT bucket FROM o WHERE later) AS rewritten
         FROM o WHERE later OR o_orderkey % 10 <> 3""",
)
oracle(
    "batch_bytes",
    """WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn,
           strlen(CAST(to_json([CAST(doc_id AS STRING), text, lang, CAST(n_chars AS STRING)]) AS STRING)) AS row_bytes FROM documents),
       cut AS (SELECT rn, row_bytes, CAST(1 AS BIGINT) AS batch_no, CAST(1 AS BIGINT) AS row_no, row_bytes AS used FROM d WHERE rn = 1
         UNION ALL
         SELECT n.rn, n.row_bytes, c.batch_no + CAST(n.fresh AS INT), CASE WHEN n.fresh THEN 1 ELSE c.row_no + 1 END,
                CASE WHEN n.fresh THEN n.row_bytes ELSE c.used + n.row_bytes END
           FROM cut c JOIN LATERAL (SELECT d.rn, d.row_bytes, c.row_no = 40 OR
                18 + strlen(CAST(c.batch_no AS STRING)) + c.used + d.row_bytes + c.row_no > 65536 AS fresh FROM d WHERE d.rn = c.rn + 1) n ON TRUE)
       SELECT doc_id, d.row_bytes, batch_no, row_no FROM d JOIN cut USING (rn)""",
)
oracle(
    "intake_commit",
    """WITH b AS (SELECT *, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1) // 50 + 1 AS batch_no FROM orders_base)
       SELECT 'row' AS kind, CAST(o_orderkey AS STRING) AS a, o_orderstatus AS b, o_orderpriority AS c, CAST(1 AS BIGINT) AS n FROM b WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'refused', '20240102030405_0000ff', 'RUN_UNKNOWN', NULL, 1 WHERE EXISTS (SELECT 1 FROM b WHERE o_orderstatus = 'P')
       UNION ALL SELECT 'refused', '20240102030405_0000bb', 'RUN_SEALED', NULL, COUNT(DISTINCT batch_no) FROM b
         WHERE o_orderstatus = 'P' AND batch_no % 2 = 0 HAVING COUNT(*) > 0
       UNION ALL SELECT 'state', '20240102030405_00000f', 'PUBLISHED', NULL, COUNT(DISTINCT batch_no) FROM b WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'state', '20240102030405_0000aa', 'ABORTED', NULL, NULL
       UNION ALL SELECT 'state', '20240102030405_0000bb', 'ABORTED', 'BATCH_NOT_DELIVERED', COUNT(DISTINCT batch_no) FROM b WHERE o_orderstatus = 'P'""",
)
oracle(
    "sequence_gate_stream",
    """WITH s AS (SELECT DISTINCT '20240102030405_' || CASE o_orderstatus WHEN 'F' THEN '00000f' WHEN 'O' THEN '0000aa' ELSE '0000bb' END AS run_id,
                      o_orderkey + 1 AS batch_no FROM orders_base WHERE (o_orderkey + 1) % 7 <> 3),
       j AS (SELECT *, coalesce(lag(batch_no) OVER (PARTITION BY run_id ORDER BY batch_no), 0) + 1 AS expected FROM s),
       i AS (SELECT run_id, COUNT(*) FILTER (WHERE batch_no <> expected OR batch_no = 1) AS intervals,
                    coalesce(MIN(expected) FILTER (WHERE batch_no <> expected), MAX(batch_no) + 1) AS next FROM j GROUP BY run_id)
       SELECT run_id, next AS expected, NULL AS got, intervals FROM i
       UNION ALL SELECT run_id, expected, batch_no, intervals FROM j JOIN i USING (run_id) WHERE batch_no <> expected""",
)
