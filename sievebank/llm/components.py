"""Connected components of an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join, so no task holds a component, however large; each
round ends in a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import persist


def _step(edges: DataFrame, large: bool) -> DataFrame:
    """Link neighbours to the smallest node around ``u``: those above ``u``, or those below it."""
    if large:
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        around = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    # written, so that both sides of the join are dealt anew and a hub can be split
    least = persist(around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
    met = around.join(least.withColumnRenamed("u", "at"), F.col("u") == F.col("at"))
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.filter(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, its component's smallest node, for all nodes but the roots.

    ``edges`` has longs ``u`` and ``v``; loops and repeated edges do no harm, nulls are
    left out, no edges give no rows.
    """
    now = persist(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        row = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if not row["n"] or (row["n"], row["h"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (row["n"], row["h"])
        now = persist(_step(_step(now, True), False), "edges")
