"""Dialogues as training texts from the perspective of each of their speakers.

For every participant a dialogue is rendered with that speaker as assistant and the others as named users;
the mask marks what the assistant says. A dialogue is rendered in parts of a bounded number of turns,
so no dialogue has to fit into one row; the parts in their order are the whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableferry.llm.tables import kept, let, named
from tableferry.operators.numbering import number_rows

PART_TURNS = 32
SYSTEM, UNKNOWN = "system", "unknown"
OPEN, CLOSE = "<|", "|>"
END = "<|end|>\n"
MASKED_END = len("<|end|>")


def speaker(role: Column) -> Column:
    """The name of who speaks: no line breaks or markers, `unknown` if there is none."""
    name = F.trim(F.regexp_replace(F.coalesce(role, F.lit("")), r"[\n\r]+", " "))
    name = F.replace(F.replace(name, F.lit(OPEN), F.lit("< |")), F.lit(CLOSE), F.lit("| >"))
    return F.when(name == "", UNKNOWN).otherwise(name)


def body(text: Column) -> Column:
    """What is said, with its own markers broken so that none can pass for one of the format."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(OPEN), F.lit("< |"))


def parts(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, part_turns: int) -> DataFrame:
    """(conv_id, part, turns): each dialogue's turns by number in runs of `part_turns`.

    Turns of equal number come by speaker, then text. They are numbered over all dialogues at once, in ranges,
    so a dialogue of very many turns is spread over tasks.
    """
    rows = named(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    rows = rows.select("conv_id", "turn", speaker(F.col("role")).alias("speaker"), body(F.col("text")).alias("body"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "speaker", "body")]
    numbered = kept(number_rows(rows, order), "turns")
    first = numbered.groupBy(F.col("conv_id").alias("c")).agg(F.min("rn").alias("first"))
    placed = numbered.join(first, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("at", F.col("rn") - F.col("first"))
    placed = placed.withColumn("part", F.floor(F.col("at") / part_turns).cast("bigint"))
    own = F.struct("at", "speaker", "body")
    return kept(placed.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(own)).alias("turns")), "parts")


def perspectives(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_turns: int = PART_TURNS,
) -> DataFrame:
    """(conv_id, perspective, part, n_turns, text, mask) for each participant of each dialogue and each part.

    `mask` are the spans (start, end) of the part's text, in code points, that the participant says, each with
    its end marker. `system` turns are context for all and no participant; a dialogue with no other turns gives no rows. A null or
    blank role is the participant `unknown`, a null text is empty, a null conversation is one of its own. Repeated rows are repeated turns.
    """
    dealt = parts(turns, conv_col, turn_col, role_col, text_col, part_turns)
    people = dealt.select(F.col("conv_id").alias("c"), F.explode("turns.speaker").alias("perspective")).distinct()
    people = people.filter(F.col("perspective") != SYSTEM)
    joined = dealt.join(people, F.col("conv_id").eqNullSafe(F.col("c")))
    rotated = F.transform("turns", _block)
    rendered = let(rotated, lambda blocks: F.struct(
        F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], b["body"], F.lit(END))), "").alias("text"),
        _mask(blocks).alias("mask"),
    ))
    return joined.select("conv_id", "perspective", "part", F.size("turns").alias("n_turns"), rendered.alias("r")).select(
        "conv_id", "perspective", "part", "n_turns", "r.text", "r.mask"
    )


def _block(turn: Column) -> Column:
    mine = turn["speaker"] == F.col("perspective")
    head = F.when(mine, "<|assistant|>\n").when(turn["speaker"] == SYSTEM, "<|system|>\n")
    head = head.otherwise(F.concat(F.lit("<|user name="), turn["speaker"], F.lit("|>\n")))
    return F.struct(head.alias("head"), turn["body"].alias("body"), mine.alias("mine"))


def _mask(blocks: Column) -> Column:
    size = lambda b: F.length(b["head"]) + F.length(b["body"]) + len(END)
    ends = F.aggregate(blocks, F.array(F.lit(0)), lambda sums, b: F.concat(sums, F.array(F.element_at(sums, -1) + size(b))))
    spans = F.zip_with(blocks, ends, lambda b, at: F.when(
        b["mine"],
        F.struct((at + F.length(b["head"])).alias("start"), (at + F.length(b["head"]) + F.length(b["body"]) + MASKED_END).alias("end")),
    ))
    return F.filter(spans, lambda s: s.isNotNull())
