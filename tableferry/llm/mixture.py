"""Mixing sources to target weights by hierarchical budgeting, in DataFrame operations only.

Weights flow down a tree of domain, language and source. A node that has fewer tokens than its
share leaves the rest to its siblings, and only what a whole family cannot use goes to the siblings
of its parent. Each leaf then gives a prefix of its tokens: whole epochs and a part of the next,
each epoch in an order of its own that the seed decides.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.tables import kept

LEVELS = ("domain", "lang", "source")
#: About so many documents are ordered by one task to find the end of a leaf's prefix.
BUCKET_DOCS = 4_096
_WIDE = "decimal(38,0)"


def n_tokens(text: Column) -> Column:
    """Words between ASCII white space; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def lookup(key: Column, weights: Mapping[str, int], other: int) -> Column:
    """The whole-number weight of a name, `other` for names that are not listed."""
    result = F.lit(other)
    for name, weight in weights.items():
        result = F.when(key == name, F.lit(weight)).otherwise(result)
    return result.cast("bigint")


def order_key(seed: int, epoch: Column, doc_id: Column) -> Column:
    """Place of a document in an epoch: a hash, so that every epoch has another order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def shares(nodes: DataFrame, family: list[str], budget: str = "budget") -> DataFrame:
    """Split each family's `budget` by `weight` among its nodes, none above its `capacity`.

    Nodes are taken by capacity per weight. One is full if its share of what is left exceeds its
    capacity; the others share the rest by weight in whole tokens, the largest remainders first.
    A weight of zero gets a share only of what the others cannot use, by equal weights.
    """
    weighted = nodes.withColumn("zero", F.col("weight") <= 0).withColumn("w", F.when(F.col("zero"), 1).otherwise(F.col("weight")).cast(_WIDE))
    positive = Window.partitionBy(*family)
    weighted = weighted.withColumn("cap", F.col("capacity").cast(_WIDE))
    # Nodes of weight zero come after all others, with what these leave.
    weighted = weighted.withColumn("first", F.sum(F.when(~F.col("zero"), F.col("cap")).otherwise(F.lit(0).cast(_WIDE))).over(positive))
    weighted = weighted.withColumn(
        "b",
        F.when(F.col("zero"), F.greatest(F.col(budget).cast(_WIDE) - F.col("first"), F.lit(0).cast(_WIDE))).otherwise(F.col(budget).cast(_WIDE)),
    )
    ratio = F.col("cap").cast("double") / F.col("w").cast("double")
    by_ratio = Window.partitionBy(*family, "zero").orderBy(ratio, "name")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = weighted.select(
        "*",
        (F.col("b") - F.coalesce(F.sum("cap").over(before), F.lit(0).cast(_WIDE))).cast(_WIDE).alias("left"),
        F.sum("w").over(onward).cast(_WIDE).alias("heirs"),
    )
    full = F.col("cap") * F.col("heirs") <= F.col("w") * F.col("left")
    # Once a node is not full, no later one is.
    marked = left.withColumn("full", F.min(full.cast("int")).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    rest = Window.partitionBy(*family, "zero", "full")
    marked = marked.select("*", F.max("left").over(rest).cast(_WIDE).alias("pot"), F.max("heirs").over(rest).cast(_WIDE).alias("sharers"))
    part = (F.col("w") * F.col("pot")).cast(_WIDE)
    floors = marked.select("*", F.expr("cast(w * pot as decimal(38,0)) div sharers").alias("floor"), (part % F.col("sharers")).alias("remainder"))
    spare = (F.col("pot") - F.sum("floor").over(rest)).cast(_WIDE)
    place = F.row_number().over(rest.orderBy(F.desc("remainder"), "name"))
    given = floors.select("*", spare.alias("spare"), place.alias("place"))
    share = F.when(F.col("full"), F.col("cap")).otherwise(F.col("floor") + F.when(F.col("place") <= F.col("spare"), 1).otherwise(0))
    names = [c for c in nodes.columns if c != budget]
    return given.select(*names, share.cast("bigint").alias("share"))


def budgets(leaves: DataFrame, weights: Mapping[str, Column], budget: Column, max_epochs: int) -> DataFrame:
    """(domain, lang, source, docs, tokens, share) from leaves (domain, lang, source, docs, tokens).

    `weights` has a column over the names for each level, `budget` is a column over `available`, the
    sum of all tokens. A leaf can give its tokens `max_epochs` times.
    """
    capacity = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    parents = capacity.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("available")).select(budget.cast("bigint").alias("budget"))
    family: list[str] = []
    for k, level in enumerate(LEVELS):
        path = list(LEVELS[: k + 1])
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.join(parents, family) if family else nodes.crossJoin(parents)  # one row: the root
        nodes = nodes.select("*", weights[level].cast("bigint").alias("weight"), F.col(level).alias("name"))
        parents = kept(shares(nodes, family or [F.lit(0)]).select(*path, "share"), f"share-{level}").withColumnRenamed("share", "budget")
        family = path
    return leaves.join(parents.withColumnRenamed("budget", "share"), list(LEVELS))


def cuts(tokens: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """For each leaf the number of whole epochs, and where the prefix of the next one ends.

    (domain, lang, source, epochs, rest, cut_key, cut_before): documents with an order key below
    `cut_key` are taken whole, those at it (the repeated rows of one id, mostly one) begin after
    `cut_before` tokens and end at `rest`. Without a rest `cut_key` is null.
    """
    whole = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(0))
    spread = plan.select("*", whole.cast("bigint").alias("epochs")).withColumn("rest", F.col("share") - F.col("epochs") * F.col("tokens"))
    spread = kept(spread.withColumn("buckets", F.ceil(F.col("docs") / BUCKET_DOCS).cast("bigint")), "leaves")
    keyed = tokens.join(spread.filter("rest > 0"), list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint")
    keyed = keyed.withColumn("bucket", F.shiftright(place * F.col("buckets"), 32))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("in_bucket"))
    upto = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.withColumn("end", F.sum("in_bucket").over(upto))
    last = ends.filter((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("in_bucket") < F.col("rest")))
    last = last.select(*LEVELS, "bucket", (F.col("end") - F.col("in_bucket")).alias("earlier"))
    inside = keyed.join(last, [*LEVELS, "bucket"]).groupBy(*LEVELS, "rest", "earlier", "key").agg(F.sum("n_tokens").alias("own"))
    running = Window.partitionBy(*LEVELS).orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    found = inside.withColumn("end", F.col("earlier") + F.sum("own").over(running))
    found = found.filter((F.col("end") >= F.col("rest")) & (F.col("end") - F.col("own") < F.col("rest")))
    found = found.select(*LEVELS, F.col("key").alias("cut_key"), (F.col("end") - F.col("own")).alias("cut_before"))
    return kept(spread.join(found, list(LEVELS), "left").select(*LEVELS, "epochs", "rest", "cut_key", "cut_before"), "cuts")


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[str, Column], budget: Column, max_epochs: int = 2, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
) -> DataFrame:
    """Every taken document once for each epoch, with all columns of `docs` and the `mix_*` columns.

    `mix_epoch` counts from 0, `mix_tokens` are the tokens of the document, `mix_taken` those that
    belong to the prefix: fewer only for the last document of a leaf. `domain` is a column over
    `docs`. A null language, source or domain is the name ''. A text without words, null included, is taken with 0
    tokens where its place lies before the end of the prefix. Rows that repeat an id have one place; if the prefix ends
    there, each gives the same number of tokens at most. A column of `docs` named like a `mix_*` column is replaced.
    """
    columns = [docs[f"`{c}`"] for c in docs.columns if c.lower() not in _ADDED]
    source = docs.select(
        F.struct(*columns).alias("row"),
        F.coalesce(domain, F.lit("")).alias("domain"),
        F.coalesce(docs[f"`{lang_col}`"], F.lit("")).alias("lang"),
        F.coalesce(docs[f"`{source_col}`"], F.lit("")).alias("source"),
        docs[f"`{id_col}`"].alias("doc_id"),
        n_tokens(docs[f"`{text_col}`"]).alias("n_tokens"),
    )
    tokens = kept(source.select(*LEVELS, "doc_id", "n_tokens"), "tokens")
    leaves = kept(tokens.groupBy(*LEVELS).agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("tokens")), "leaf-sizes")
    ends = cuts(tokens, budgets(leaves, weights, budget, max_epochs), seed)
    named = source.join(ends, list(LEVELS)).withColumn("key", order_key(seed, F.col("epochs"), F.col("doc_id")))
    part = F.when(F.col("key") < F.col("cut_key"), F.col("n_tokens")).when(
        F.col("key") == F.col("cut_key"), F.least("n_tokens", F.col("rest") - F.col("cut_before"))
    )
    # One entry for each whole epoch, and one more where the document is in the last prefix.
    whole = F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("bigint"), F.col("epochs") - 1)).otherwise(F.array().cast("array<bigint>"))
    entry = lambda epoch, taken: F.struct(epoch.alias("mix_epoch"), taken.cast("bigint").alias("mix_taken"))
    entries = F.concat(
        F.transform(whole, lambda e: entry(e, F.col("n_tokens"))),
        F.when(part.isNotNull(), F.array(entry(F.col("epochs"), part))).otherwise(F.array().cast("array<struct<mix_epoch:bigint,mix_taken:bigint>>")),
    )
    return named.select("row", F.col("domain").alias("mix_domain"), F.col("n_tokens").alias("mix_tokens"), F.inline(entries)).select(
        "row.*", "mix_domain", "mix_epoch", "mix_tokens", "mix_taken"
    )


_ADDED = ("mix_domain", "mix_epoch", "mix_tokens", "mix_taken")
