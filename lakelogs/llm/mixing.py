"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a size (words of its texts). A share of all words is dealt out by
weight; a source stops at ``max_epochs`` times its own size and what is above is dealt again to the
others by weight until no source is above. ``targets`` finds that end state directly: sources sorted by
cap / weight fill in that order, so one running sum gives the water level.

``mix`` then takes every document floor(target / size) times and, for the fraction that remains, once
more the documents that come first in a seeded order, up to the document that brings the source
nearest to its target. The order is dealt over hash buckets: sums by (source, bucket) find the one
bucket that the end falls into, and only that bucket is sorted, so no source lands in one task.

Epochs may be fractions: with ``max_epochs`` 1.5 a source's documents are taken once, and those of half its words twice.

Edges: a null or blank text has size 0 and is never taken; null doc_ids are ordered by their texts' hashes; a null source is a source of its own, ordered last;
equal hashes are ordered by doc_id, then by content, and exact repeated rows are counted and taken as
documents of their own, together; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakelogs.llm.common import SPACE_WORDS, materialize, numbered_rows, read_table, row_key

#: Weights dealt to the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 17
BUCKETS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE_WORDS)), F.lit(0)).cast("long")


def seeded(key: Column, seed: int) -> Column:
    """32 hash characters of a document, the same for the same seed."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), key.cast("string")))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> (source, source_size, weight, target). One row a source: the list of sources
    is a small catalogue (it is ordered in one task), however many documents they hold."""
    named = F.col("source").asc_nulls_last()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(named))).withColumn("weight", weight)
    capped = ranked.withColumn("cap", F.col("source_size") * F.lit(max_epochs))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.sum("source_size").over(everything) * F.lit(share)
    level = (full - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    # The level that holds if this source is the first one that isn't full: the first such source's counts.
    open_level = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("position", "level"))
    return (
        capped.withColumn("level", level)
        .withColumn("position", F.row_number().over(fill))
        .withColumn("water", F.min(open_level).over(everything)["level"])
        .withColumn("target", F.when(F.col("water").isNull() | (F.col("cap") <= F.col("water") * F.col("weight")), F.col("cap")).otherwise(F.col("water") * F.col("weight")))
        .select("source", "source_size", "weight", "target")
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED, buckets: int = BUCKETS, keyed: bool = False) -> DataFrame:
    """Documents -> (doc_id, size, source, source_size, target, repeats, taken), one row a document; keyed: with its ``row_key``."""
    more = row_key() if keyed else []
    names = ["none", "id", "h"] if keyed else []
    sized = docs.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), seeded(F.coalesce(F.col("doc_id").cast("string"), F.xxhash64("text").cast("string")), seed).alias("order"), *more
    ).withColumn("bucket", (F.conv(F.substring("order", 1, 8), 16, 10).cast("long") % buckets).cast("int"))
    sized = materialize(sized, "sizes")  # texts are read once
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    goals = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, max_epochs)
    # Words of the fractional repetition, and the bucket in which they end.
    by_bucket = Window.partitionBy("source").orderBy("bucket")
    plan = (
        sums.join(goals.withColumnRenamed("source", "g_source"), F.col("source").eqNullSafe(F.col("g_source")))
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
        .withColumn("until", F.sum("bucket_size").over(by_bucket))
        .withColumn("since", F.col("until") - F.col("bucket_size"))
    )
    plan = plan.select(
        F.col("source").alias("p_source"), F.col("bucket").alias("p_bucket"), "source_size", "target", "whole", "rest", "since",
        F.when(F.col("until") <= F.col("rest"), 1).when(F.col("since") >= F.col("rest"), -1).otherwise(0).alias("side"),
    )
    placed = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
    # Only the buckets in which a source's words end need an order; the others are taken whole or not at all.
    in_order = Window.partitionBy("p_source", "p_bucket").orderBy("order", "doc_id", "size", *names)
    edge = (
        placed.filter("side = 0")
        .withColumn("upto", F.col("since") + F.sum("size").over(in_order))
        .withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long"))
        .drop("upto")
    )
    rest = placed.filter("side <> 0").withColumn("extra", (F.col("side") > 0).cast("long"))
    # No document is in more epochs than its source may have, a begun one included; documents without words are in none.
    reps = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(math.ceil(max_epochs)))).otherwise(0).cast("long")
    return rest.unionByName(edge).select(
        "doc_id", "source", "size", "source_size", "target", reps.alias("repeats"), (reps * F.col("size")).alias("taken"), *names
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents as often as the mix takes them, with all their columns."""
    # Repeats within a source differ by one at most, so rows of one key share their sum evenly, the first ones one more.
    taken = mix(docs, keyed=True, **options).groupBy("none", "id", "h").agg(F.sum("repeats").alias("sum"), F.count("*").alias("rows")).filter("sum > 0")
    n = (F.floor(F.col("sum") / F.col("rows")) + (F.col("nth") <= F.col("sum") % F.col("rows")).cast("long")).cast("int")
    rows = numbered_rows(docs, taken).withColumn("n", n).filter("n > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  md5('17:' || doc_id) AS ord FROM documents),
b AS (SELECT *, (('0x' || substr(ord, 1, 8))::BIGINT % 4096) AS bucket FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rnk FROM s),
c AS (SELECT *, CASE (rnk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2.0::DOUBLE AS cap FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY cap / weight, rnk) AS pos,
  ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
w AS (SELECT arg_min(level, pos) AS water FROM l WHERE cap > level * weight),
g AS (SELECT source, source_size, CASE WHEN water IS NULL OR cap <= water * weight THEN cap ELSE water * weight END AS target FROM l, w),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM g),
o AS (SELECT b.doc_id, b.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
  sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket) AS until_b,
  sum(b.size) OVER (PARTITION BY b.source ORDER BY b.bucket, b.ord, b.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM b JOIN f ON b.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN until_b <= rest THEN 1 WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 2))::BIGINT AS taken
FROM o
"""


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
