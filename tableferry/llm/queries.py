"""The registered queries of these operations: each over a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableferry.llm import oracle, production

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_simhash_near_dedup(spark, sf_dir):
    from tableferry.llm import simhash

    found = simhash.groups(table(spark, sf_dir, "documents"), shingle=3, max_bits=3)
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query
def op2_language_id(spark, sf_dir):
    from tableferry.llm import language

    documents = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(True))
    model = language.train(documents, ~held_out)
    return language.label(documents, model, spans=False).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query
def op7_secret_scan(spark, sf_dir):
    from tableferry.llm import secrets

    found = secrets.secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), "unopened",
    )


@query
def op10_quality_classifier(spark, sf_dir):
    from tableferry.llm import quality

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(True))
    scored = quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_mixture(spark, sf_dir):
    mixed = production.mixed(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", "mix_epoch", "mix_tokens", "mix_taken")


@query
def op5_document_fingerprints(spark, sf_dir):
    from tableferry.llm import paragraphs

    return paragraphs.compare_versions(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark, sf_dir):
    from tableferry.llm import lines

    found = lines.drop_repeated_lines(table(spark, sf_dir, "documents"), min_lines=2, min_chars=40)
    return found.select("doc_id", "n_lines", "n_removed", "n_spans", "longest_run", F.sha2("text", 256).alias("kept_sha256"))


@query
def op9_benchmark_decontamination(spark, sf_dir):
    from tableferry.llm import benchmark

    found = benchmark.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_windows", "n_found", "n_slots", "kind")


@query
def op4_chat_perspectives(spark, sf_dir):
    from tableferry.llm import chat

    rendered = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"], m["end"])), ",")
    return rendered.select("conv_id", "perspective", "part", "n_turns", F.sha2("text", 256).alias("text_sha256"), spans.alias("mask"))


@query
def op8_repeated_substrings(spark, sf_dir):
    from tableferry.llm import repeats

    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=400)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op11_merkle_manifest(spark, sf_dir):
    from tableferry.llm import merkle

    documents, fields = table(spark, sf_dir, "documents"), ["doc_id", "source", "lang", "n_chars", "text"]
    changed = F.translate("text", ascii_uppercase, ascii_lowercase)
    tampered = merkle.leaf_digest(*[changed if f == "text" else F.col(f) for f in fields])
    claim = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, tampered)
    tree = merkle.manifest(documents, "source", "doc_id", fields, doc_id=F.col("doc_id"), claim=claim)
    found = merkle.proofs(tree)
    root = F.lit(None if tree.root is None else tree.root.hex())
    return found.select(
        "doc_id", merkle.hexed(F.col("digest")).alias("leaf"), merkle.hexed(F.col("subroot")).alias("subroot"), root.alias("root"),
        F.sha2(merkle.path_text(F.col("path")), 256).alias("proof_sha256"),
        merkle.folded(F.coalesce("claim", "digest"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query
def op12_token_alignment(spark, sf_dir):
    from tableferry.llm import alignment

    found = alignment.align(table(spark, sf_dir, "documents"), production.TOKENIZERS)
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", F.col("count_sum").cast("bigint"), "groups_sha256", "n_shared"]
    return found.select(*columns)


@query
def op13_minhash_near_dedup(spark, sf_dir):
    from tableferry.llm import forest

    return forest.groups(table(spark, sf_dir, "documents"), words=5, percent=85)


ORACLE: dict[str, str] = {
    "op3_mixture": oracle.mixture(),
    "op4_chat_perspectives": oracle.perspectives(),
    "op6_line_dedup": oracle.line_dedup(),
    "op9_benchmark_decontamination": oracle.leaks(),
    "op11_merkle_manifest": oracle.merkle(),
    "op13_minhash_near_dedup": oracle.near_copies(),
}
