"""A corpus pipeline: quality rules, near-dedup, personal data, source mix, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes as Parquet and
rereads as the next stage's docs. All stages but the last return the columns of documents, whatever
other columns docs has and whatever their names. An empty docs gives no rows in every stage, and
repeated rows are treated alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumeloom.llm import mixing, neardup, packing, pii, rules
from plumeloom.llm.text import nested
from plumeloom.plans.storage import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the production policy accepts. Null and empty texts have no words and
    go; a null id or source changes nothing. Verdicts depend on a row's text alone, so ties agree."""
    measured = rules.ledger(nested(docs, docs["text"].alias("text")))
    return rules.judged(measured).filter("kept").select("_doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of near-duplicates. Texts without words are
    linked with nothing and stay. A null id is never the least; rows without ids that are linked
    among themselves only all stay, as do all rows of a kept id."""
    return neardup.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data and secrets by their kinds; n_chars follows the text. Null texts and
    texts without any stay as they are, with their n_chars."""
    clean = pii.redacted(docs)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources come near their targets. A null source is a source
    of its own; texts without words have size 0 and follow their source's rate; rows of one id (null
    ids together) are taken and left together."""
    return mixing.mixed(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences, one row per piece. A null or empty text is one closing token,
    a repeated row is packed as often as it occurs, a null id is carried through, and a text of any
    length is cut into pieces."""
    return packing.packed(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenisation and the choice of packing are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
