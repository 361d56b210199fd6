"""The parameters with which the queries and the pipeline run the operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableferry.llm import mixture

#: Tokens wanted, as a share of those there are; times that a document may be taken; order of the epochs.
MIX_SHARE_PERCENT, MIX_EPOCHS, MIX_SEED = 60, 2, 17
DOMAIN_WEIGHTS = {"core": 50, "wide": 30, "rare": 20}
LANGUAGE_WEIGHTS = {"en": 55, "de": 15, "fr": 15, "es": 15}

#: Least share of a text in one language; what counts as a repeated run; near copies.
LANGUAGE_LEAST_SCORE = 0.4
RUN_LINES, RUN_CHARS = 2, 40
SHINGLE, MAX_BITS = 3, 3

#: Folder of the public vocabulary files, on the driver.
TOKENIZERS = "/opt/tokenizers"


def domain():
    """Domain of a source by the number in its name: up to 1 core, up to 12 wide, the rest and names without one rare."""
    number = F.regexp_extract("source", "([0-9]{1,9})$", 1)
    number = F.when(number == "", F.lit(99)).otherwise(number.cast("int"))
    return F.when(number <= 1, "core").when(number <= 12, "wide").otherwise("rare")


def mixed(docs: DataFrame) -> DataFrame:
    weights = {
        "domain": mixture.lookup(F.col("domain"), DOMAIN_WEIGHTS, 1),
        "lang": mixture.lookup(F.col("lang"), LANGUAGE_WEIGHTS, 5),
        "source": F.lit(1),
    }
    budget = F.expr(f"available * {MIX_SHARE_PERCENT} div 100")
    return mixture.mix(docs, domain(), weights, budget, max_epochs=MIX_EPOCHS, seed=MIX_SEED)
