"""Upsert of staged rows into a target, and the guards around it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableferry.scratch import planned_bytes
from tableferry.spec import OrderTerm


def collate_key(df: DataFrame, key: Sequence[str], collation: str | None) -> DataFrame:
    """`df` with its text key columns under `collation`, for comparing keys as the target does."""
    if collation is None:
        return df
    texts = [k for k in key if isinstance(df.schema[k].dataType, T.StringType)]
    return df.withColumns({k: F.collate(F.col(k), collation) for k in texts})


def null_key(key: Sequence[str]) -> Column:
    broken = F.col(key[0]).isNull()
    for name in key[1:]:
        broken = broken | F.col(name).isNull()
    return broken


def duplicate_keys(staged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys staged more than once, with their number of copies (counted map-side first)."""
    return staged.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def key_report(staged: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row ``rows, null_key_rows, distinct_keys, duplicated_keys, surplus_rows``."""
    per_key = staged.groupBy(*key).agg(F.count("*").alias("copies"))
    whole = ~null_key(key)
    return per_key.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(null_key(key), F.col("copies"))), F.lit(0)).alias("null_key_rows"),
        F.count_if(whole).alias("distinct_keys"),
        F.count_if(whole & (F.col("copies") > 1)).alias("duplicated_keys"),
        F.coalesce(F.sum(F.when(whole, F.col("copies") - 1)), F.lit(0)).alias("surplus_rows"),
    )


def keep_latest(staged: DataFrame, key: Sequence[str], order_by: Sequence[OrderTerm]) -> DataFrame:
    """One row per key: the last one in the task's order, ties broken by all columns.

    Spark keeps only each task's best row per key before the shuffle (WindowGroupLimit), so a
    hot key moves one row per input task.
    """
    backwards = [
        F.col(t.column).asc_nulls_last() if t.direction == "desc" else F.col(t.column).desc_nulls_first()
        for t in order_by
    ]
    named = {t.column.lower() for t in order_by} | {k.lower() for k in key}
    rest = [F.col(c).desc_nulls_first() for c in staged.columns if c.lower() not in named]
    best = Window.partitionBy(*key).orderBy(*backwards, *rest)
    return staged.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").drop("_rank")


def _same_key(target: DataFrame, key: Sequence[str], collation: str | None) -> Column:
    test = None
    for name in key:
        left, right = F.col(f"t.{name}"), F.col(f"s.{name}")
        if collation is not None and isinstance(target.schema[name].dataType, T.StringType):
            left, right = F.collate(left, collation), F.collate(right, collation)
        test = (left == right) if test is None else test & (left == right)
    return test


def _sides(target: DataFrame, staged: DataFrame, key: Sequence[str]):
    """Both sides as ``key..., _row`` with the mapped columns in one struct of the target's types,
    and on the target side ``_rest`` with the others. One struct moves and compares as a whole,
    which keeps the plan small however many columns a table has."""
    fields = [f for f in target.schema.fields if f.name not in set(key)]
    changed = [f for f in fields if f.name in set(staged.columns)]
    rest = [f for f in fields if f.name not in set(staged.columns)]
    marker = F.lit(True).alias("_present")
    t = target.select(
        *key,
        F.struct(marker, *[F.col(f.name) for f in changed]).alias("_row"),
        F.struct(marker, *[F.col(f.name) for f in rest]).alias("_rest"),
    )
    s = staged.select(*key, F.struct(marker, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in changed]).alias("_row"))
    return t.alias("t"), s.alias("s"), changed, rest


def _merged(target: DataFrame, key, changed, rest, defaults) -> list[Column]:
    """Columns of the joined row in target order, and the effect on it."""
    old, new = F.col("t._row"), F.col("s._row")
    row = F.coalesce(new, old)
    fresh = [F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in rest]
    kept = F.coalesce(F.col("t._rest"), F.struct(F.lit(True).alias("_present"), *fresh))
    source = {f.name: row for f in changed} | {f.name: kept for f in rest}
    out = []
    for f in target.schema.fields:
        if f.name in source:
            out.append(source[f.name][f.name].alias(f.name))
        else:
            spelled = F.when(old.isNotNull(), F.col(f"t.{f.name}"))
            out.append(spelled.otherwise(F.col(f"s.{f.name}").cast(f.dataType)).alias(f.name))
    effect = (
        F.when(old.isNull(), "inserted")
        .when(new.isNull(), "kept")
        .when(old.eqNullSafe(new), "unchanged")
        .otherwise("updated")
    )
    return [*out, effect.alias("_effect")]


def upsert(
    target: DataFrame,
    staged: DataFrame,
    key: Sequence[str],
    defaults: Mapping[str, object] | None = None,
    collation: str | None = None,
    keep_buckets: bool = False,
) -> DataFrame:
    """The target after the upsert, with ``_effect`` per row: inserted, updated, unchanged, kept.

    Matched rows take every mapped non-key column and keep their key as spelled; unmapped
    columns keep their value, or take their default on insert; no row is deleted. Keys must be
    unique and not null on both sides (`key_report`).

    A staged side small enough for Spark to broadcast leaves the target unshuffled; otherwise
    both sides meet in one full outer join on the key. ``keep_buckets`` always takes that join:
    with a target in buckets of the key only the staged rows move, and each task ends up with
    the rows of one bucket.
    """
    defaults = dict(defaults or {})
    t, s, changed, rest = _sides(target, staged, key)
    columns = _merged(target, key, changed, rest, defaults)
    same_key = _same_key(target, key, collation)
    if keep_buckets or collation is not None or not _fits_broadcast(staged):
        return t.join(s, same_key, "full_outer").select(*columns)
    old_rows = t.join(s, same_key, "left").select(*columns)
    matched = target.select(*key).join(staged.select(*key), list(key), "left_semi")
    mapped = set(staged.columns)
    new_rows = staged.join(matched, list(key), "left_anti").select(
        *[
            (F.col(f.name) if f.name in mapped else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ],
        F.lit("inserted").alias("_effect"),
    )
    return old_rows.unionByName(new_rows)


def _fits_broadcast(df: DataFrame) -> bool:
    spark = df.sparkSession
    limit = spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return 0 <= planned_bytes(df) <= limit


def effect_counts(merged: DataFrame) -> DataFrame:
    """One row ``inserted, updated, unchanged, kept, staged_rows, affected``.

    ``affected`` counts as the target database does: insert 1, change 2, unchanged match 1, so
    it always lies between staged_rows and twice that.
    """
    def n(effect):
        return F.count_if(F.col("_effect") == effect)

    return merged.agg(
        n("inserted").alias("inserted"),
        n("updated").alias("updated"),
        n("unchanged").alias("unchanged"),
        n("kept").alias("kept"),
        (n("inserted") + n("updated") + n("unchanged")).alias("staged_rows"),
        (n("inserted") + 2 * n("updated") + n("unchanged")).alias("affected"),
    )


def insert_new(target: DataFrame, staged: DataFrame, key: Sequence[str]) -> DataFrame:
    """Upsert when every column is a key column: matches change nothing, new keys are added."""
    return target.unionByName(staged.select(*target.columns).join(target.select(*key), list(key), "left_anti"))
