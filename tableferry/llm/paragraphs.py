"""Document fingerprints: invertible Bloom lookup sketches of paragraphs, in DataFrame operations only.

Each distinct paragraph is a 64-bit key that is put into one cell of each of three parts of a sketch. Two
sketches subtract cell by cell; a cell that then holds one key gives it away, which is taken out of its
other cells, and so on until nothing is left: the keys that only one of the texts has. A sketch that is
too small for the difference doesn't empty, and a larger one is tried.

A key is 48 bits of digest and 16 bits of check, so a cell tells by itself whether it holds one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.llm.tables import kept, named
from tableferry.operators.numbering import number_rows

PARTS = 3
#: Cells in one part of the sketch that is the fingerprint.
PART_CELLS = 8
#: Cells in one part of a retry for each key that the two texts have at most.
RETRY_CELLS = 1.0
ROUNDS = 3

#: A paragraph ends with a line or a sentence.
PARAGRAPH_END = r"\n+|(?<=[.!?])[\x20\t]+"


def paragraph_keys(text: Column) -> Column:
    """The keys of the distinct paragraphs of a text; none of an empty or null text."""
    pieces = F.filter(F.split(F.coalesce(text, F.lit("")), PARAGRAPH_END), lambda p: p != "")
    return F.array_distinct(F.transform(pieces, _key))


def _key(paragraph: Column) -> Column:
    digest = F.shiftleft(F.xxhash64(paragraph), 16)
    return digest.bitwiseOR(_check(digest))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check")).bitwiseAND(F.lit(0xFFFF).cast("bigint"))


_HOLDS_ONE = "(key & 65535) = (xxhash64(shiftleft(shiftrightunsigned(key, 16), 16), 'check') & 65535)"


def _cell(part: int) -> str:
    """The cell of `key` in one part; `cells` is the size of a part."""
    return f"cast(pmod(xxhash64(key, {part}), cells) + {part} * cells AS int)"


def _row(cell: str, n: str, key: str, gone: str) -> str:
    return f"named_struct('cell', {cell}, 'n', {n}, 'key', {key}, 'gone', {gone})"


def sketch(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, cell, n, key) from one row (by, key, side) for each key: counts and xor-ed keys of cells that hold any."""
    places = ", ".join(_cell(p) for p in range(PARTS))
    return _summed(keys.selectExpr(*by, f"explode(array({places})) AS cell", "side AS n", "key"), by)


def _summed(entries: DataFrame, by: Sequence[str]) -> DataFrame:
    total = entries.groupBy(*by, "cell").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("key").alias("key"))
    return total.filter("n <> 0 OR key <> 0")


def peel(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, undone, only_left, only_right) of subtracted sketches (by, cell, n, key); `cells` is among `by`.

    One part is peeled at a time, in which a key has one cell, so nothing is taken out twice. What is recovered
    travels along as an entry below cell 0. `undone` counts the cells that still hold something after the rounds.
    """
    state = cells.selectExpr(*by, "cell", "n", "key", "0L AS gone")
    for turn in range(ROUNDS * PARTS):
        part = turn % PARTS
        own = f"cell >= 0 AND abs(n) = 1 AND {_HOLDS_ONE} AND cell = {_cell(part)}"
        found = [_row("-1", "n", "0L", "key")] + [_row(_cell(p), "-n", "key", "0L") for p in range(PARTS) if p != part]
        entries = f"if({own}, array({', '.join(found)}), array({_row('cell', 'n', 'key', 'gone')}))"
        state = (
            state.selectExpr(*by, f"inline({entries}) AS (cell, n, key, gone)")
            .groupBy(*by, "cell", "gone").agg(F.expr("cast(sum(n) AS int) AS n"), F.expr("bit_xor(key) AS key"))
            .filter("cell < 0 OR n <> 0 OR key <> 0")
        )
    return state.groupBy(*by).agg(
        F.expr("count_if(cell >= 0 OR abs(n) <> 1) AS undone"),
        F.expr("count_if(cell < 0 AND n = 1) AS only_left"),
        F.expr("count_if(cell < 0 AND n = -1) AS only_right"),
    )


def _signed(keys: str, side: int) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(side).alias("side")))


def _attempt(versions: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]], cells: Sequence[Column]) -> DataFrame:
    """One row for each of `by`: (cells, undone, only_left, only_right), numbered by pair; null for equal pairs and null cells.

    `versions` is dealt by `by`, so all sums and rounds stay in the partition of their row.
    """
    tried = F.array(*[
        F.struct(F.lit(p).alias("pair"), cells[p].cast("int").alias("cells"), F.concat(_signed(left, 1), _signed(right, -1)).alias("keys"))
        for p, (left, right) in enumerate(pairs)
    ])
    marked = versions.select(*by, F.inline(F.filter(tried, lambda t: t["cells"].isNotNull())))
    group = [*by, "pair", "cells"]
    ends = peel(sketch(marked.select(*group, F.inline("keys")), group), group)
    return ends.groupBy(*by).agg(*[
        F.max(F.when(F.col("pair") == p, F.col(c))).alias(f"{c}_{p}") for p in range(len(pairs)) for c in _TOLD
    ])


_TOLD = ("cells", "undone", "only_left", "only_right")


def _replaced(found: DataFrame, better: DataFrame, by: Sequence[str], n_pairs: int) -> DataFrame:
    """`found` with what `better` tells of the same pairs."""
    newer = better.withColumnsRenamed({f"{c}_{p}": f"new_{c}_{p}" for p in range(n_pairs) for c in _TOLD})
    told = [F.coalesce(f"new_{c}_{p}", f"{c}_{p}").alias(f"{c}_{p}") for p in range(n_pairs) for c in _TOLD]
    return found.join(newer, list(by), "left").select(*by, *told)


def differences(versions: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]] = (("left", "right"),)) -> DataFrame:
    """(by, only_left_0, only_right_0, only_left_1, ...): what sketches of pairs of key arrays tell, by names of the arrays.

    Sketches of PART_CELLS cells a part come first. Pairs whose difference doesn't come out get larger ones, first
    as their numbers of keys suggest, then twice as large each time, until none is left over. An equal pair has nulls;
    a row of equal pairs only is left out.
    """
    arrays = list(dict.fromkeys(c for pair in pairs for c in pair))
    source = versions.select(*by, *arrays)
    any_undone = F.greatest(*[F.coalesce(f"undone_{p}", F.lit(0)) for p in range(len(pairs))], F.lit(0)) > 0

    fitting = [F.ceil(RETRY_CELLS * (F.size(left) + F.size(right))) + PART_CELLS for left, right in pairs]
    last = found = kept(_attempt(source.repartition(*by), by, pairs, [F.lit(PART_CELLS)] * len(pairs)), "peeled")
    retries = 0
    while True:
        wanted = last.filter(any_undone).select(*by, *[f"{c}_{p}" for p in range(len(pairs)) for c in _TOLD[:2]])
        failed = kept(wanted, "failed")
        if failed.isEmpty():
            break
        # The first retry is of most rows, so those are dealt and joined there; later ones are few and joined first.
        again = source.join(failed, list(by)).repartition(*by) if retries else source.repartition(*by).join(failed, list(by))
        retries += 1
        sizes = [
            F.when(F.col(f"undone_{p}") > 0, F.greatest(2 * F.col(f"cells_{p}"), fit)) for p, fit in enumerate(fitting)
        ]
        last = kept(_attempt(again, by, pairs, sizes), "peeled")
        found = _replaced(found, last, by, len(pairs))
    return found.select(*by, *[f"{c}_{p}" for p in range(len(pairs)) for c in _TOLD[2:]])


def written(keys: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, fingerprint): the cells of each sketch as text, `cell.count.key` in hexadecimal."""
    filled = sketch(keys.withColumn("cells", F.lit(PART_CELLS)).withColumn("side", F.lit(1)), by)
    cell = F.concat_ws(".", F.hex("cell"), F.hex("n"), F.hex("key"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cell", cell.alias("text")))), lambda c: c["text"])
    return filled.groupBy(*by).agg(F.array_join(ordered, "-").alias("fingerprint"))


def likeness(only_left: Column, only_right: Column, left: Column, right: Column) -> Column:
    """Share of the paragraphs of two texts that both have: 1 for equal sets, also for two empty ones."""
    differ = F.coalesce(only_left, F.lit(0)) + F.coalesce(only_right, F.lit(0))
    return F.when(left + right == 0, 1.0).otherwise(1.0 - differ / (left + right)).cast("double")


def edited_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rn, doc_id, n_chars, edited_sha256, keys, edited, next_keys) of every row, null texts as empty ones.

    The edited text ends with the first floor(n_chars / 4) code points of the next row's text (all, if it
    has fewer) in place of as many of its own. Rows come by id, nulls first, repeated ids by a hash of the
    text; after the last comes the first. Only the heads of texts move to their predecessors, besides one
    shuffle of the texts that brings each to its number. The keys of a text travel with its head.
    """
    source = named(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    mark = F.xxhash64("text")
    sizes = source.select("doc_id", mark.alias("mark"), F.length("text").cast("bigint").alias("n_chars"))
    rows = kept(number_rows(sizes, [F.col("doc_id").asc_nulls_first(), F.col("mark").asc()], unique=False), "order")
    last = rows.agg(F.max("rn").alias("last"))
    # Rows equal in id and text are told apart by a number within them, in both tables.
    order = kept(
        rows.select(
            "doc_id", "mark", "n_chars", "rn",
            (F.col("rn") - F.min("rn").over(_same_rows())).alias("copy"),
        ), "order",
    )
    follows = order.join(F.broadcast(last)).select(
        F.col("doc_id").alias("b_id"), F.col("mark").alias("b_mark"), F.col("copy").alias("b_copy"),
        F.floor(F.col("n_chars") / 4).cast("int").alias("need"), (F.col("rn") % F.col("last") + 1).alias("rn"),
    )
    wanted = order.withColumnsRenamed({"doc_id": "w_id", "mark": "w_mark", "copy": "w_copy"}).join(follows, "rn")
    wanted = kept(wanted.drop("n_chars"), "wanted")
    texts = source.withColumn("mark", mark)
    if wanted.filter("w_copy > 0").isEmpty():
        texts = texts.withColumn("copy", F.lit(0).cast("bigint"))
    else:
        texts = texts.withColumn("copy", F.row_number().over(_same_rows().orderBy(F.lit(0))).cast("bigint") - 1)
    here = texts.doc_id.eqNullSafe(F.col("w_id")) & (texts.mark == F.col("w_mark")) & (texts.copy == F.col("w_copy"))
    placed = texts.join(wanted, here)
    # Each head goes to where its predecessor's text is, so the texts themselves are dealt once.
    heads = placed.select("b_id", "b_mark", "b_copy", F.expr("left(text, need)").alias("head"), paragraph_keys(F.col("text")).alias("next_keys"))
    placed = placed.select("rn", "doc_id", "mark", "copy", "text")
    there = placed.doc_id.eqNullSafe(F.col("b_id")) & (placed.mark == F.col("b_mark")) & (placed.copy == F.col("b_copy"))
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 4) as int))"), "head")
    size = F.length("text").cast("bigint").alias("n_chars")
    joined = placed.join(heads, there).select("rn", "doc_id", size, "text", edited.alias("edited_text"), "next_keys")
    return joined.select(
        "rn", "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"),
        paragraph_keys(F.col("text")).alias("keys"), paragraph_keys(F.col("edited_text")).alias("edited"), "next_keys",
    )


def _same_rows():
    from pyspark.sql import Window

    return Window.partitionBy("doc_id", "mark")


def compare_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    Equal texts have equal fingerprints, and so have texts with the same set of paragraphs; an empty text has an
    empty one. In a table of one row the next document is the row itself. An empty table gives an empty result.
    """
    base = kept(edited_versions(docs, id_col, text_col), "versions")
    found = differences(base, ["rn"], [("keys", "edited"), ("keys", "next_keys")])
    sides = base.select("rn", F.inline(F.array(
        F.struct(F.lit(0).alias("version"), F.col("keys").alias("ks")), F.struct(F.lit(1).alias("version"), F.col("edited").alias("ks"))
    )))
    prints = written(sides.repartition("rn").select("rn", "version", F.explode("ks").alias("key")), ["rn", "version"])
    prints = prints.groupBy("rn").agg(*[
        F.max(F.when(F.col("version") == v, F.col("fingerprint"))).alias(name) for v, name in ((0, "fingerprint"), (1, "edited_fingerprint"))
    ])
    counts = [F.size(c).alias(f"n_{c}") for c in ("keys", "edited", "next_keys")]
    rows = base.select("rn", "doc_id", "n_chars", "edited_sha256", *counts)
    rows = rows.join(found, "rn", "left").join(prints, "rn", "left")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256",
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
        F.coalesce("edited_fingerprint", F.lit("")).alias("edited_fingerprint"),
        likeness(F.col("only_left_0"), F.col("only_right_0"), F.col("n_keys"), F.col("n_edited")).alias("near_edited"),
        likeness(F.col("only_left_1"), F.col("only_right_1"), F.col("n_keys"), F.col("n_next_keys")).alias("near_next"),
    )
