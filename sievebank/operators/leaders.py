"""Greedy leaders in rounds: the first maximal independent set in the order of the nodes.

Scanning the nodes in order, one joins the first earlier leader it is linked to, or becomes
a leader itself.  The same comes from rounds that work on all nodes at once: a node without
undecided smaller neighbours and without a leader among them leads; a node with a leader among
its smaller neighbours follows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.snapshot import kept


def followers(edges: DataFrame) -> DataFrame:
    """``node`` and ``leader`` for every node that follows; all others lead.

    ``edges`` has ``a`` and ``b`` with a before b.  Each round ends in a table, so plans
    stay small.
    """
    edges = kept(edges.select("a", "b").filter("a < b").distinct(), "links")
    state = kept(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("state", F.lit(0)), "nodes")
    live, rounds = edges, 0
    while True:
        # of the smaller neighbours: is one a leader, is one undecided
        seen = live.join(state.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(
            F.max(F.col("state") == 1).alias("led"), F.max(F.col("state") == 0).alias("open")
        )
        new = state.join(seen, "node", "left").select(
            "node",
            F.when(F.col("state") != 0, F.col("state"))
            .when(F.coalesce("led", F.lit(False)), 2)
            .when(~F.coalesce("open", F.lit(False)), 1)
            .otherwise(0)
            .alias("state"),
        )
        state = kept(new, "nodes")
        if state.filter("state = 0").isEmpty():
            leaders = state.filter("state = 1").select(F.col("node").alias("a"))
            members = state.filter("state = 2").select(F.col("node").alias("b"))
            led = edges.join(leaders, "a").join(members, "b").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))
            return led
        rounds += 1
        if rounds > 1:  # what is decided needs no links any more, and followers decide nothing
            open_ends = state.filter("state = 0").select(F.col("node").alias("b"))
            live = kept(live.join(open_ends, "b", "left_semi").join(state.filter("state = 2").select(F.col("node").alias("a")), "a", "left_anti").select("a", "b"), "live-links")
