"""The corpus pipeline: documents -> quality rules -> near-dedup -> decontamination -> mixing -> shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents, whatever their
names, and rows as they were. Nulls may be in any column, an empty table gives an empty one, long texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakelogs.llm import decontaminate, mixing, quality, sharding, simhash
from lakelogs.llm.common import materialize, new_path, numbered_rows, read_table, row_key
from lakelogs.llm.components import connected_components


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Each row is judged by its text alone, so repeated rows share their fate; a null or empty
    text has no words and goes."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, of the smallest id (a null one only if there is no other; among rows of one
    id one by its hash). Null, empty and blank texts are one group. Other rows of the kept id stay if their texts are in
    other groups."""
    marked = materialize(docs.select(*row_key(), simhash.fingerprint(F.col("text")).alias("fp")), "fingerprints")
    classes = marked.groupBy("fp").agg(F.min(F.struct("none", "id", "h")).alias("first"))
    members = connected_components(simhash.similar_links(classes.select("fp")))
    groups = classes.join(members.withColumnRenamed("node", "fp"), "fp", "left").groupBy(F.coalesce("component", "fp").alias("of"))
    return numbered_rows(docs, groups.agg(F.min("first").alias("k")).select("k.*").distinct()).filter("nth = 1").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go. Each (doc_id, text) is judged alone; a null or empty text is clean; an empty
    benchmark removes nothing."""
    return decontaminate.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in rows of their own. Null, empty and blank texts are never taken; a null source is a
    source; rows of one id are rows of their own."""
    return mixing.mixed_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each row lies in the committed shards: (doc_id, shard, shard_docs, shard_bytes, version). All rows are stored, those with
    nulls as well; without rows there are no shards."""
    return sharding.shard_documents(docs, new_path(spark, "shards"))


STAGES = [
    ("quality_rules", quality_rules),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing_to_weights),
    ("sharding", sharding_stage),
]

#: Suffix arrays and file layouts are beyond SQL; tests hold the result against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
