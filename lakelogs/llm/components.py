"""Connected components of a link table, by repeated hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakelogs.llm.common import discard, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, component): every node that has a link, with the smallest node it can reach.

    Distributed union-find: in each round every node takes the smallest label among its neighbours' labels, and
    hooks the node that its own label names onto it as well, so whole trees are joined at their roots (min is combined
    before the shuffle, so a hub or root costs one row a task); then labels jump to their labels' labels. Rounds grow with
    the logarithm of a component's size (21 to 37 for paths of a million nodes). The state is written to the
    shared folder each round, so a lost executor costs one round, and the round before is deleted. Labels only fall, and the rounds go on until none
    does; self-links are allowed, repeated links are merged, no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "links")
    last = materialize(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    state = last
    while True:
        near = edges.join(state.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        met = state.join(near, "node").select("node", F.least("label", "near").alias("to"), F.col("label").alias("old"))
        # Each node's offer, to itself and, where it is lower, to its label.
        own, root = F.struct("node", "to", "old"), F.struct(F.col("old").alias("node"), "to", F.lit(None).cast("long").alias("old"))
        offers = met.select(F.explode(F.when(F.col("to") < F.col("old"), F.array(own, root)).otherwise(F.array(own))).alias("o")).select("o.*")
        hooked = offers.groupBy("node").agg(F.min("to").alias("to"), F.max("old").alias("old"))
        # Jump: the label of the label, as the previous round knew it.
        jumps = state.filter("label < node").select(F.col("node").alias("to"), F.col("label").alias("far"))
        step = hooked.join(jumps, "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("label"), "old")
        step = materialize(step, "labels")
        moved = step.filter("label <> old").limit(1).count()
        discard(last)
        last, state = step, step.select("node", "label")
        if not moved:
            discard(edges)
            return state.withColumnRenamed("label", "component")
