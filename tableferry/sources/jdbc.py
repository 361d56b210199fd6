"""Sources and targets behind JDBC. The driver jars are the cluster's own.

These paths need a live database; the tests cover the options and statements only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

# Fixed value: rows fetched per round trip.
FETCH_SIZE = 100


def read_options(
    name: str,
    options: Mapping[str, str],
    text_columns: Sequence[str] = (),
    split: tuple[str, str, str, int] | None = None,
) -> dict[str, str]:
    """Options of a JDBC read.

    One read is one query and one consistent snapshot. `split` (column, lower, upper, parts)
    reads in parallel, but each part is a query, and so a snapshot, of its own. Columns in
    `text_columns` (bare NUMBER) are read as text, because Spark's carrier for them would round.
    """
    out = {"fetchsize": str(FETCH_SIZE), "preferTimestampNTZ": "true", **options, "dbtable": name}
    if text_columns:
        out["customSchema"] = ", ".join(f"`{c}` STRING" for c in text_columns)
    if split is not None:
        column, lower, upper, parts = split
        out.update(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=str(parts))
    return out


def read_jdbc(spark: SparkSession, name: str, options: Mapping[str, str], **how) -> DataFrame:
    """A lazy JDBC table: Spark sends the column list and the conditions to the database."""
    return spark.read.format("jdbc").options(**read_options(name, options, **how)).load()


def append_batches(df: DataFrame, staging_table: str, options: Mapping[str, str]) -> None:
    """Append rows to a staging table, one transaction per partition."""
    df.write.format("jdbc").options(**{"batchsize": "5000", **options, "dbtable": staging_table}).mode("append").save()


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def upsert_statement(staging_table: str, target_table: str, columns: Sequence[str], key: Sequence[str]) -> str:
    """The one statement that moves staged rows into a target that has the unique key.

    Non-key columns take the staged value. When every column is a key column, a no-op
    assignment keeps a rerun from failing on the key.
    """
    names = ", ".join(_quote(c) for c in columns)
    keys = {k.upper() for k in key}
    changed = [c for c in columns if c.upper() not in keys]
    if changed:
        sets = ", ".join(f"{_quote(c)} = VALUES({_quote(c)})" for c in changed)
    else:
        sets = f"{_quote(key[0])} = {_quote(key[0])}"
    return (
        f"INSERT INTO {_quote(target_table)} ({names}) SELECT {names} FROM {_quote(staging_table)} "
        f"ON DUPLICATE KEY UPDATE {sets}"
    )


class VerifyFailed(RuntimeError):
    """Staged rows differ from the rows read; the target was left untouched."""


def publish_jdbc(connection, staging_table: str, target_table: str, columns, key, source_rows: int) -> int:
    """Count, upsert and commit in one transaction on an open `java.sql.Connection`.

    Returns the affected rows, which lie between the staged rows and twice that; anything else
    rolls back.
    """
    connection.setAutoCommit(False)
    try:
        statement = connection.createStatement()
        result = statement.executeQuery(f"SELECT COUNT(*) FROM {_quote(staging_table)}")
        result.next()
        staged = result.getLong(1)
        if staged != source_rows:
            raise VerifyFailed(f"{source_rows} rows read but {staged} staged")
        affected = statement.executeUpdate(upsert_statement(staging_table, target_table, columns, key))
        if not staged <= affected <= 2 * staged:
            raise VerifyFailed(f"{staged} rows staged but {affected} affected")
        connection.commit()
        return affected
    except BaseException:
        connection.rollback()
        raise
