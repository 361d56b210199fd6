"""Repeated runs of lines, found in a suffix array over line numbers, in DataFrame operations only.

Lines that occur once part the texts into sequences. Distributed prefix doubling ranks what starts at each
line by its first 1, 2, 4, ... lines: the rank of twice as many lines is the place of the pair (rank here,
rank that many lines on) among all pairs. Starts of one rank are an interval of the suffix array with a common prefix
of that length. What starts an interval of one entry repeats no further and is left out of the next round.
All copies in an interval but the first, by id and line, are later copies. Those that hold enough characters count, and
the lines they cover are deleted; blank lines and short headings alone are no repeated run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.tables import fresh, kept, let, named
from tableferry.operators.numbering import number_rows

DOC = ("doc_id", "text_hash")


def _ranked(pairs: DataFrame, by: list[str]) -> DataFrame:
    """(by, rank) of the values that more than one row has, in their order."""
    repeated = pairs.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    return number_rows(repeated, [F.col(c).asc() for c in by], name="rank", unique=True)


def _following(starts: DataFrame, lines: int) -> DataFrame:
    """Starts (doc, pos, here, there) whose sequence goes on for `lines` lines, with both ranks and characters."""
    on = starts.select(
        *[F.col(c).alias(f"_{c}") for c in DOC], (F.col("pos") - lines).alias("_pos"), F.col("rank").alias("there"), F.col("chars").alias("after")
    )
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash")) & (F.col("pos") == F.col("_pos"))
    return starts.join(on, match).select(*DOC, "pos", F.col("rank").alias("here"), "there", F.col("chars").alias("before"), "after")


def _longer(starts: DataFrame, lines: int, name: str) -> DataFrame:
    """Starts ranked by their prefix and the one `lines` lines on, without those of their own."""
    pairs = kept(_following(starts, lines), "pairs")
    longer = pairs.join(_ranked(pairs, ["here", "there"]), ["here", "there"])
    return kept(longer.select(*DOC, "pos", (F.col("before") + F.col("after")).alias("chars"), F.least("before", "after").alias("half"), "rank"), name)


def _later(starts: DataFrame) -> DataFrame:
    """Starts that are not the first of their interval."""
    place = F.struct(F.col("doc_id"), F.col("text_hash"), F.col("pos"))
    first = starts.groupBy("rank").agg(F.min(place).alias("first"))
    return starts.join(first, "rank").filter(place > F.col("first")).select(*DOC, "pos", "chars", "half")


def line_sequences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_hash, pos, chars, half, rank) of the lines that occur more than once.

    `chars` are the characters of what starts here, without spaces around a line, and `half` the lesser of its halves'.
    """
    source = named(docs, doc_id=id_col, text=text_col)
    lines = source.select("doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = kept(
        lines.select(*DOC, "pos", F.xxhash64("line").alias("a"), F.xxhash64(F.lit("line"), "line").alias("b"), F.length(F.trim("line")).cast("bigint").alias("chars")),
        "lines",
    )
    found = lines.join(_ranked(lines, ["a", "b"]), ["a", "b"])
    # Rows equal in id and text are one document.
    once = found.groupBy(*DOC, "pos").agg(F.first("chars").alias("chars"), F.first("rank").alias("rank"))
    return kept(once.select(*DOC, "pos", "chars", F.lit(-1).cast("bigint").alias("half"), "rank"), "starts")


def repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = 2, min_chars: int = 40
) -> DataFrame:
    """(doc_id, text_hash, spans, longest_run) of the documents in which lines are later copies.

    A repeated run is a power of two of lines, or `min_lines` of them. It counts from `min_lines` lines on, or as a single
    line, if its lines hold `min_chars` characters in all, without spaces around a line; so blank lines alone never do.
    `spans` are (first, n): the stretches of lines that such runs cover, from line 0. `longest_run` is the number of lines
    of the longest such run that repeats an earlier one. Rows that share id and text are one document.
    """
    single = line_sequences(docs, id_col, text_col)
    level, size, runs = single, 1, []
    while True:
        later = kept(_later(level), "later")
        if size == 1 or size >= min_lines:
            # Halves that count by themselves cover the whole.
            halves = F.col("half") >= min_chars if size == 2 or size >= 2 * min_lines else F.lit(False)
            runs.append(later.filter(F.col("chars") >= min_chars).select(*DOC, "pos", F.lit(size).alias("n"), halves.alias("covered")))
        elif size < min_lines < 2 * size:
            exact = _sized(_later(_longer(level, min_lines - size, "exact")), single, min_lines)
            runs.append(exact.filter(F.col("chars") >= min_chars).select(*DOC, "pos", F.lit(min_lines).alias("n"), F.lit(False).alias("covered")))
        if level.isEmpty():
            break
        level, size = _longer(level, size, "starts"), 2 * size
    found = runs[0]
    for more in runs[1:]:
        found = found.unionByName(more)
    # A document's longest run is at least as long as any that its halves cover, so it is taken before these go.
    found = kept(found, "found")
    depth = found.groupBy(*DOC).agg(F.max("n").alias("longest_run"))
    own = Window.partitionBy(*DOC).orderBy("pos", "n")
    before = F.max(F.col("pos") + F.col("n")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    begins = found.filter("NOT covered").withColumn("begins", (F.coalesce(before, F.lit(-1)) < F.col("pos")).cast("int"))
    islands = begins.withColumn("island", F.sum("begins").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    spans = islands.groupBy(*DOC, "island").agg(F.min("pos").alias("first"), F.max(F.col("pos") + F.col("n")).alias("end"))
    spans = spans.select(*DOC, F.struct("first", (F.col("end") - F.col("first")).cast("int").alias("n")).alias("span"))
    spans = spans.groupBy(*DOC).agg(F.array_sort(F.collect_list("span")).alias("spans"))
    match = [spans[c].eqNullSafe(depth[c]) for c in DOC]
    return kept(spans.join(depth, match[0] & match[1], "left").select(spans.doc_id, spans.text_hash, "spans", "longest_run"), "runs")


def _sized(starts: DataFrame, single: DataFrame, lines: int) -> DataFrame:
    """Starts (doc, pos) with the characters of the `lines` lines from there on."""
    each = starts.select(*DOC, "pos", F.explode(F.sequence("pos", F.col("pos") + (lines - 1))).alias("at"))
    own = single.select(*[F.col(c).alias(f"_{c}") for c in DOC], F.col("pos").alias("_pos"), F.col("chars"))
    match = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & F.col("text_hash").eqNullSafe(F.col("_text_hash")) & (F.col("at") == F.col("_pos"))
    return each.join(own, match).groupBy(*DOC, "pos").agg(F.sum("chars").alias("chars"))


def without(text: Column, spans: Column) -> Column:
    """The text without the lines in `spans`; all of it if there are none."""
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: (s["first"] + s["n"]).cast("int")))

    def left(lines: Column) -> Column:
        ends = F.concat(F.transform(spans, lambda s: s["first"].cast("int")), F.array(F.size(lines)))
        pieces = F.filter(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda p: p["a"] < p["b"])
        return F.array_join(F.flatten(F.transform(pieces, lambda p: F.slice(lines, p["a"] + 1, p["b"] - p["a"]))), "\n")

    return F.when(spans.isNull(), text).otherwise(let(F.split(text, "\n"), left))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: int) -> DataFrame:
    """`docs` with shorter texts and the columns `n_lines`, `n_removed`, `n_spans`, `longest_run`.

    Every row stays, also one that loses all its lines. A null text stays null and has no lines; an empty one has one
    empty line. Columns of these names that `docs` has already are replaced.
    """
    runs = repeated_lines(docs, id_col, text_col, **options)
    added = ("n_lines", "n_removed", "n_spans", "longest_run")
    mark = fresh(docs, "text_hash")
    marked = docs.drop(*added).withColumn(mark, F.xxhash64(docs[f"`{text_col}`"]))
    runs = runs.select(*[F.col(c).alias(fresh(marked, f"runs_{c}")) for c in ("doc_id", "text_hash", "spans")], "longest_run")
    own_id, own_hash, spans = (runs.columns[k] for k in range(3))
    # Texts and spans meet by a shuffle at any size, so what goes to disk grows in proportion: spans grow with the texts.
    joined = marked.join(runs.hint("merge"), marked[f"`{id_col}`"].eqNullSafe(runs[own_id]) & (marked[mark] == runs[own_hash]), "left")
    text = marked[f"`{text_col}`"]
    result = joined.select(
        *[without(text, runs[spans]).alias(c) if c == text_col else marked[f"`{c}`"] for c in marked.columns if c != mark],
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"),
        F.coalesce(F.aggregate(runs[spans], F.lit(0), lambda n, s: n + s["n"]), F.lit(0)).alias("n_removed"),
        F.when(runs[spans].isNull(), 0).otherwise(F.size(runs[spans])).alias("n_spans"),
        F.coalesce("longest_run", F.lit(0)).alias("longest_run"),
    )
    return result.withColumn("n_lines", F.when(F.col("n_lines") < 0, 0).otherwise(F.col("n_lines")))
