"""Keeping the tables in order: upserts, pruning, samples and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.snapshot import kept


def upsert(old: DataFrame, new: DataFrame, key: str, sticky: tuple[str, ...] = ()) -> DataFrame:
    """The newest row of each key; a blank in a ``sticky`` column does not displace what was there."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    own = Window.partitionBy(key).orderBy("_seq", *[F.asc(c) for c in new.columns if c != key]).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = {c: F.coalesce(F.last(F.when(F.col(c) != "", F.col(c)), ignorenulls=True).over(own), F.col(c)) for c in sticky}
    # several new rows of a key: the largest by its columns, whatever order they came in
    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("_seq"), *[F.desc(c) for c in new.columns if c != key]))
    return both.withColumns(kept | {"_newest": newest}).filter("_newest = 1").drop("_seq", "_newest")


def pruned(posts: DataFrame, occurrences: DataFrame, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Occurrences whose question exists, and posts that still have one."""
    occ = occurrences.join(questions.select(F.col("id").alias("_q")), F.col("question_id") == F.col("_q"), "left_semi")
    return posts.join(occ.select(F.col("post_id").alias("_p")), F.col("id") == F.col("_p"), "left_semi"), occ


def without(posts: DataFrame, occurrences: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the posts in ``gone`` (``id``)."""
    ids = gone.select(F.col("id").alias("_g"))
    return posts.join(ids, F.col("id") == F.col("_g"), "left_anti"), occurrences.join(ids, F.col("post_id") == F.col("_g"), "left_anti")


def stratified(rows: DataFrame, stratum: str, key: str, n: int, seed: int = 20260913) -> DataFrame:
    """``n`` rows: ``n`` divided by the number of strata from each, and the rest by ``key`` from what is left.

    The same ones for the same seed: a stratum's rows are taken by the MD5 of seed and key.
    """
    strata = rows.agg(F.count_distinct(stratum).alias("k")).first()["k"]
    each = n // max(1, strata)
    draw = F.md5(F.encode(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), "UTF-8"))
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    ranked = kept(rows.withColumn("_rank", rank), "strata")
    own = ranked.filter(F.col("_rank") <= each)
    short = n - own.count()
    rest = ranked.filter(F.col("_rank") > each).orderBy(key).limit(max(0, short))
    return own.unionByName(rest).drop("_rank")


def numbered(rows: DataFrame, order: list[Column]) -> DataFrame:
    """``number`` from 0 in a total order, without one task for all rows: ranges are counted first."""
    # written, as the bounds of ranges may differ when they are drawn again
    dealt = kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    local = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    counts = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each partition
    before = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return dealt.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn("number", F.col("_before") + F.col("_local")).drop("_part", "_local", "_before")


def batched(rows: DataFrame, order: list[Column], size: int = 150, first: int = 0) -> DataFrame:
    """``batch`` numbers for files of ``size`` rows, going on from ``first``."""
    return numbered(rows, order).withColumn("batch", F.floor(F.col("number") / size) + first).drop("number")
