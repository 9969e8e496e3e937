"""The corpus pipeline. Each stage is one operator over all that the stage before kept, and reads what that wrote.

All stages but the last return the columns of ``documents``, and read no others. Null texts are empty texts; rows with null
or repeated ids are rows like any other; an empty table gives an empty result. Reruns on the same rows agree, but for the
order of rows and the sequences that equal pieces land in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalyard.llm import mixing, packing, quality_rules, simhash, toxicity
from catalyard.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the base tests and the learned decision list keep; so none of under ten words."""
    rules = quality_rules.learned(docs, table(spark, sf_dir, "labels"))
    carried = [c for c in COLUMNS if c != "doc_id"]
    kept = docs.select("doc_id", "text", *(F.col(c).alias(f"kept_{c}") for c in carried))
    judged = quality_rules.judge_quality(kept, rules, *(f"kept_{c}" for c in carried))
    return judged.where("kept").select("doc_id", *(F.col(f"kept_{c}").alias(c) for c in carried))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents with a toxicity score under 0.5; the model is learned from labelled rows among ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model, COLUMNS)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class of near copies (five-word shingles, a similarity of 0.8 or more), told apart by text: the
    one of the smallest doc_id."""
    return simhash.without_copies(docs, COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix does: a row for each time. Reruns on the same rows agree: the mix goes by what a
    row holds (``key``); ``uid`` only joins copies to texts, and is given once, as the table is written."""
    key = F.xxhash64(*COLUMNS).alias("key")
    numbered = stored(docs.select(*COLUMNS, key, F.monotonically_increasing_id().alias("uid")), "numbered")
    sized = stored(mixing.word_counts(numbered, "source", "key", "uid"), "sizes")
    taken = mixing.mix(sized, "key", more=["uid"]).where("copies > 0").select("uid", "copies")
    joined = numbered.join(taken.hint("merge"), "uid")  # small as files, but not bounded: no broadcast
    again = joined.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 token ids, with the ids: what training reads."""
    return packing.packed(docs)


STAGES = [
    ("quality rules", quality),
    ("toxicity", clean),
    ("SimHash near-dedup", deduplicate),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: The stages learn from labels and sample, so SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, over the table ``documents``."""
    out = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stored(stage(spark, out, sf_dir), name.lower().replace(" ", "-"))
    return out
