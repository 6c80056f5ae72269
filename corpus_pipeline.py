"""A corpus made ready for training: the stages, in order, over ``documents``.

Each stage takes what its predecessor kept, whole, and returns the columns of
``documents``; the last returns the pieces of the packed sequences.  Stages read
these columns alone, so others may be there under any name.  Null texts count as
empty; null ids, languages and sources are values like others.  Rows without an
order of their own are told apart by their place in the table that the stage
reads.  An empty table goes through all stages empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm import minhash, mixing, packing, quality, repeats
from palimpsest.llm._scratch import keep, settled

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_rules(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep: not those with fewer than 50 words (null and empty texts among them), nor repetitive ones, nor those that are more like the corpus than like trusted texts.  Repeated rows get the same verdict."""
    docs = docs.select(*COLUMNS)
    return quality.keep_good(docs, quality.fit_ratio(docs, quality.trusted_ids(spark, sf_dir)))


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: the one with the smallest id (of repeated rows, one).  Texts without words are like nothing and stay, a row each."""
    docs = settled(docs.select(*COLUMNS))
    return docs.withColumn("rid", F.monotonically_increasing_id()).join(minhash.representatives(docs).hint("shuffle_hash"), "rid", "left_semi").drop("rid")


def repeat_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the strings of 200 bytes that occur twice among them.  A document of which nothing is left stays, with an empty text; null texts have nothing to take."""
    cut = repeats.without_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, each time as a whole.  A null source is a source."""
    return mixing.repeated(mixing.plan(docs.select(*COLUMNS), F.array("source"))).select(*COLUMNS)


def packed(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequence and place; a document longer than a sequence is cut, one without words has no place (null)."""
    return packing.best_fit(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("minhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeat_dedup),
    ("mixing", mixed),
    ("best_fit_packing", packed),
]

#: Hashes, flows and packings decide; SQL can't express the stages.  They are tested against brute force.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = keep(docs, name)
    return docs
