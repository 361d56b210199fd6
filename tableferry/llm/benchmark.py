"""Benchmark items in texts, also with other numbers, names and units, in DataFrame operations only.

Texts become templates: numbers, units that follow them and names are typed placeholders, all other words
are themselves in lower case. Windows of five template words are joined by their hashes. An item is in a document
that has at least 0.8 of its windows, if the placeholders agree: wherever the item has one value, the
document has one value too, be it another. Where a document's places disagree as a whole, each alignment in it, a
distance of places in the document from places in the item, is judged by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tableferry.llm.tables import fresh, kept, let, named, same

WINDOW, SIMILARITY = 5, 0.8
#: Windows with fewer words that are no placeholders say too little.
LEAST_WORDS = 2

# Units of measure.
UNITS = (
    "kg", "g", "mg", "t", "lb", "lbs", "oz", "km", "m", "cm", "mm", "mi", "ft", "in", "l", "ml", "s", "ms", "min", "h",
    "hours", "minutes", "seconds", "days", "meters", "metres", "miles", "dollars", "euros", "percent",
)
# Private characters mark placeholders: one to open each kind, one to close.
NAME, NUMBER, UNIT, CLOSE = "\ue001", "\ue002", "\ue003", "\ue000"
SPACE = r"[\t\n\f\r ]"
NAME_PATTERN = rf"([^.!?:\t\n\f\r ]{SPACE}+)(\p{{Lu}}\p{{Ll}}+)"
NUMBER_PATTERN = r"([0-9]+(?:[.,:/-][0-9]+)*)"
UNIT_PATTERN = rf"({NUMBER}[^{CLOSE}]*{CLOSE}{SPACE}*)({'|'.join(sorted(UNITS, key=len, reverse=True))})([^\p{{L}}]|$)"
WORD_PATTERN = rf"([{NAME}{NUMBER}{UNIT}][^{CLOSE}]*{CLOSE}|[\p{{L}}\p{{M}}]+)"


def template_words(text: Column, values: bool = False) -> Column:
    """The words of a text as a template; with `values`, placeholders also hold what they replace.

    A name is a capitalised word that doesn't begin a sentence. It is looked for twice, since one that
    directly follows another isn't seen while that is replaced.
    """
    keep = "$2" if values else ""
    for _ in range(2):
        text = F.regexp_replace(text, NAME_PATTERN, f"$1{NAME}{keep}{CLOSE}")
    text = F.regexp_replace(text, NUMBER_PATTERN, f"{NUMBER}{'$1' if values else ''}{CLOSE}")
    has_number = F.contains(text, F.lit(NUMBER))
    text = F.when(has_number, F.regexp_replace(text, UNIT_PATTERN, f"$1{UNIT}{keep}{CLOSE}$3")).otherwise(text)
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(1))


def windows(words: Column) -> Column:
    """Each window of words, the whole sequence if it is shorter; none of no words."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(1)))
    return F.when(F.size(words) > 0, F.transform(starts, lambda i: F.slice(words, i, WINDOW)))


def _is_word(word: Column) -> Column:
    return ~word.rlike(f"^[{NAME}{NUMBER}{UNIT}]")


def item_windows(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, off, hash, n_windows, slots) of the windows of each item that hold enough words."""
    words = named(items, item_id=id_col, text=text_col).dropDuplicates().select("item_id", template_words(F.col("text")).alias("words"))
    placed = words.select("item_id", "words", F.posexplode(windows(F.col("words"))).alias("off", "window"))
    telling = placed.filter(F.size(F.filter("window", _is_word)) >= F.least(F.lit(LEAST_WORDS), F.size("window")))
    telling = telling.select(
        "item_id", "off", F.xxhash64("window").alias("hash"), F.exists("words", lambda w: ~_is_word(w)).alias("slots")
    )
    sizes = telling.groupBy(F.col("item_id").alias("sized")).agg(F.countDistinct("off").alias("n_windows"))
    joined = telling.distinct().join(sizes, F.col("item_id").eqNullSafe(F.col("sized")))
    return joined.select("item_id", "off", "hash", "n_windows", "slots")


def leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", similarity: float = SIMILARITY,
) -> DataFrame:
    """(doc_id, text_hash, item_id, n_windows, n_found, n_slots, kind) of each item in each document.

    `n_found` of the item's `n_windows` windows occur in the document. `kind` is `copy` if all aligned
    placeholders have the item's values and `variant` if they have other, consistent ones. `n_slots` counts the values of
    the item that were compared. If the places in the document disagree, all three are those of its best alignment. Texts that are null or have no words match nothing, nor do items whose windows hold
    fewer than two words; a text shorter than a window matches only an equally short one. Rows equal in id
    and text are one document or item; items that share an id but not a text count as one item.
    """
    wanted = kept(item_windows(items, item_id_col, item_text_col), "items")
    source = named(docs, doc_id=id_col, text=text_col).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    hashes = let(template_words(F.col("text")), lambda words: F.transform(windows(words), lambda w: F.xxhash64(w)))
    placed = source.select("doc_id", "text_hash", F.posexplode(hashes).alias("pos", "hash"))
    # The items' side is broadcast while it is below Spark's limit for that, else both sides are shuffled by hash.
    hits = placed.join(wanted, "hash").select("doc_id", "text_hash", "item_id", "off", "pos", "n_windows", "slots")
    hits = kept(hits.distinct(), "hits")
    found = hits.groupBy("doc_id", "text_hash", "item_id", "n_windows").agg(F.countDistinct("off").alias("n_found"), F.max("slots").alias("slots"))
    found = kept(found.filter(F.col("n_found") >= F.lit(similarity) * F.col("n_windows")), "found")
    keys = ("doc_id", "text_hash", "item_id")
    plain = found.filter(~F.col("slots")).select(*keys, "n_windows", "n_found", F.lit(0).cast("bigint").alias("n_slots"), F.lit("copy").alias("kind"))
    slotted = found.filter("slots")
    if slotted.isEmpty():
        return plain
    # Only documents with a candidate that has placeholders are read again, for the values in them.
    aligned = hits.join(slotted.select(*[F.col(c).alias(f"f_{c}") for c in keys]), _match(hits, keys), "left_semi")
    wanted_docs = aligned.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).distinct()
    doc_words = source.join(wanted_docs, source.doc_id.eqNullSafe(F.col("w_id")) & (source.text_hash == F.col("w_hash")), "left_semi")
    doc_words = kept(_slots(doc_words, ["doc_id", "text_hash"]), "document-slots")
    item_words = kept(_slots(named(items, item_id=item_id_col, text=item_text_col).dropDuplicates(), ["item_id"]), "item-slots")
    # One row for each aligned pair of places: windows overlap, so places repeat.
    places = _places(aligned.select(*keys, "off", "pos"), (*keys,)).drop("off", "pos").distinct()
    valued = _valued(places, item_words, doc_words)
    by_value = valued.groupBy(*keys, "item_value").agg(F.min("doc_value").alias("least"), F.max("doc_value").alias("most"))
    verdict = by_value.groupBy(*keys).agg(
        F.bool_and(F.col("least") == F.col("most")).alias("consistent"),
        F.bool_and((F.col("least") == F.col("item_value")) & (F.col("most") == F.col("item_value"))).alias("equal"),
        F.count("*").alias("n_slots"),
    )
    judged = slotted.join(verdict, same(slotted, verdict, *keys), "left")
    judged = kept(judged.select(*[slotted[c] for c in keys], "n_windows", "n_found", "consistent", "equal", "n_slots"), "judged")
    agreeing = judged.filter(F.coalesce("consistent", F.lit(True)))
    kind = F.when(F.coalesce("equal", F.lit(True)), "copy").otherwise("variant")
    variants = agreeing.select(*keys, "n_windows", "n_found", F.coalesce("n_slots", F.lit(0)).alias("n_slots"), kind.alias("kind"))
    mixed = judged.filter(~F.col("consistent"))
    if mixed.isEmpty():
        return plain.unionByName(variants)
    pairs = mixed.select(*[F.col(c).alias(f"f_{c}") for c in keys])
    places = aligned.join(pairs, _match(aligned, keys), "left_semi").select(*keys, "n_windows", "off", (F.col("pos") - F.col("off")).alias("at"))
    return plain.unionByName(variants).unionByName(_best_alignments(kept(places, "mixed"), item_words, doc_words, keys, similarity))


def _places(aligned: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """One row for each pair of places (item_at, doc_at) of each aligned pair of windows (off, pos)."""
    steps = aligned.select(*by, "off", "pos", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - 1))).alias("step"))
    return steps.select(*by, "off", "pos", (F.col("off") + F.col("step")).alias("item_at"), (F.col("pos") + F.col("step")).alias("doc_at"))


def _valued(places: DataFrame, item_words: DataFrame, doc_words: DataFrame) -> DataFrame:
    """The pairs of places that are placeholders, with `item_value` and `doc_value`."""
    i = item_words.select(F.col("item_id").alias("i_id"), F.col("at").alias("i_at"), F.col("word").alias("item_value"))
    d = doc_words.select(F.col("doc_id").alias("d_id"), F.col("text_hash").alias("d_hash"), F.col("at").alias("d_at"), F.col("word").alias("doc_value"))
    valued = places.join(i, places.item_id.eqNullSafe(F.col("i_id")) & (F.col("item_at") == F.col("i_at")))
    return valued.join(d, valued.doc_id.eqNullSafe(F.col("d_id")) & (valued.text_hash == F.col("d_hash")) & (F.col("doc_at") == F.col("d_at")))


def _best_alignments(
    placed: DataFrame, item_words: DataFrame, doc_words: DataFrame, keys: tuple[str, ...], similarity: float
) -> DataFrame:
    """The rows of `leaks` for pairs (doc, item) whose windows (off, at) disagree, `at` being pos - off.

    Each `at` is a seed. Windows there must agree with each other. Where it has none, as after an inserted or deleted
    word, the nearest ones before and after it stand in if they agree with what lies nearer; others are left out.
    """
    seeds = placed.select(*[F.col(c).alias(f"f_{c}") for c in keys], F.col("at").alias("seed")).distinct()
    asked = placed.select(*keys, "n_windows", "off").distinct().join(seeds, _match(placed, keys))
    asked = asked.select(*keys, "n_windows", "off", F.col("seed").alias("at"), "seed", F.lit(None).cast("int").alias("hit"))
    events = asked.unionByName(placed.select(*keys, "n_windows", "off", "at", F.lit(None).cast("int").alias("seed"), F.col("at").alias("hit")))
    by_off = Window.partitionBy(*keys, "n_windows", "off").orderBy("at")
    before = F.last("hit", ignorenulls=True).over(by_off.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.first("hit", ignorenulls=True).over(by_off.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    near = events.select(*keys, "n_windows", "off", "seed", before.alias("before"), after.alias("after")).filter("seed IS NOT NULL")
    near = near.select(*keys, "n_windows", "off", "seed", F.explode(F.array_distinct(F.array("before", "after"))).alias("at")).filter("at IS NOT NULL")
    chosen = kept(near.withColumn("pos", F.col("at") + F.col("off")).drop("at"), "chosen")

    at = (*keys, "n_windows", "seed")
    valued = _valued(_places(chosen, at), item_words, doc_words)
    far = F.abs(F.col("pos") - F.col("off") - F.col("seed"))
    by_value = Window.partitionBy(*at, "item_value")
    nearest = F.min(F.struct(far.alias("far"), F.col("doc_value").alias("value"))).over(by_value)["value"]
    valued = valued.select(*at, "off", "pos", "item_value", (F.col("doc_value") == nearest).alias("agrees"), (F.col("doc_value") == F.col("item_value")).alias("equal"))
    # Windows without placeholders have no values; one row of each window counts them in.
    told = valued.unionByName(chosen, allowMissingColumns=True).groupBy(*at, "off", "pos").agg(
        F.coalesce(F.bool_and("agrees"), F.lit(True)).alias("agrees"), F.bool_and("equal").alias("equal"), F.collect_set("item_value").alias("values")
    )
    own = F.col("pos") - F.col("off") == F.col("seed")
    seen = told.groupBy(*at).agg(
        F.bool_and(F.col("agrees") | ~own).alias("sound"),
        F.countDistinct(F.when(F.col("agrees"), F.col("off"))).alias("n_found"),
        F.coalesce(F.bool_and(F.when(F.col("agrees"), F.col("equal"))), F.lit(True)).alias("equal"),
        F.size(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("agrees"), F.col("values")))))).cast("bigint").alias("n_slots"),
    )
    passed = seen.filter(F.col("sound") & (F.col("n_found") >= F.lit(similarity) * F.col("n_windows")))
    best = passed.groupBy(*keys, "n_windows").agg(F.max(F.struct("equal", "n_found", "n_slots")).alias("best"))
    kind = F.when(F.col("best.equal"), "copy").otherwise("variant")
    return best.select(*keys, "n_windows", F.col("best.n_found"), F.col("best.n_slots"), kind.alias("kind"))


def _match(hits: DataFrame, keys: tuple[str, ...]) -> Column:
    condition = F.lit(True)
    for c in keys:
        condition = condition & hits[c].eqNullSafe(F.col(f"f_{c}"))
    return condition


def _slots(texts: DataFrame, by: list[str]) -> DataFrame:
    """(by, at, word) of the placeholders of each text, with their values."""
    words = texts.select(*by, F.posexplode(template_words(F.col("text"), values=True)).alias("at", "word"))
    return words.filter(~_is_word(F.col("word"))).distinct()


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no item, with all their columns.

    Null and empty texts hold none, so their rows stay; rows equal in id and text stay or go together, also with a
    null id. With no items at all every row stays. Columns of `docs` may have any names.
    """
    at, mark = fresh(docs, "leak_id"), fresh(docs, "leak_hash")
    found = leaks(docs, items, id_col, text_col, **options).select(F.col("doc_id").alias(at), F.col("text_hash").alias(mark)).distinct()
    found = kept(found, "leaks")
    own = docs[f"`{id_col}`"].eqNullSafe(found[at]) & (F.xxhash64(docs[f"`{text_col}`"]) == found[mark])
    return docs.join(found, own, "left_anti")
