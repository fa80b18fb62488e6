"""Reposts: posts whose sets of questions are nearly the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.snapshot import kept
from .leaders import followers
from .listing import recounted
from .maintenance import numbered, without

TITLE_THRESHOLD, CROSS_THRESHOLD, CROSS_SIZE = 0.8, 0.9, 8
#: Sets up to this size are joined on combinations of their questions.
SMALL_SET = 15


def similar_pairs(sets: DataFrame, allowed: Column, threshold: float, least: int = 1, title: str | None = None, small: int = SMALL_SET) -> DataFrame:
    """Pairs ``a`` < ``b`` of posts with a Jaccard similarity of at least ``threshold``.

    ``sets`` has distinct ``post_id`` and ``question_id`` (and ``title``, within which pairs
    are sought if named).  Posts are joined on their rarest questions alone: similar sets
    must share one of the first ``n - ceil(t n) + 1``, so frequent questions are not joined on.
    Sets of up to ``small`` questions are joined on up to three of them at once.
    """
    sizes = sets.groupBy("post_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    frequent = sets.groupBy("question_id").agg(F.count(F.lit(1)).alias("freq"))
    ranked = kept(numbered(frequent, [F.col("freq"), F.col("question_id")]).select("question_id", "number"), "ranks")
    place = F.row_number().over(Window.partitionBy("post_id").orderBy("number"))
    rows = kept(sets.join(sizes, "post_id").join(ranked, "question_id").withColumn("place", place), "sets")
    packed = small < 16 and ranked.count() <= 1 << 20
    keys = ["question_id"] + ([title] if title else [])
    prefix = rows.filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).filter(F.floor(F.col("n") / threshold + 1e-9) > small)
    left = prefix.select(*keys, F.col("post_id").alias("a"), F.col("n").alias("na"))
    right = prefix.select(*keys, F.col("post_id").alias("b"), F.col("n").alias("nb"))
    close = (F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9) & (F.col("a") < F.col("b"))
    large = left.join(right, keys).filter(close & allowed & (F.greatest("na", "nb") > small)).select("a", "b", "na", "nb").distinct()
    mine, theirs = rows.select(F.col("post_id").alias("a"), "question_id"), rows.select(F.col("post_id").alias("b"), F.col("question_id").alias("q"))

    def common(pairs: DataFrame) -> DataFrame:
        met = pairs.join(mine, "a").join(theirs, (theirs["b"] == pairs["b"]) & (F.col("question_id") == F.col("q"))).select("a", pairs["b"], "na", "nb")
        return met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))

    few = kept(_small_pairs(rows, close & allowed, threshold, small, title, packed), "candidates")
    shared = _needed(F.col("na"), F.col("nb"), threshold)
    known = few.filter(shared <= 3).select("a", "b", "na", "nb", _overlap(shared, F.col("met")).alias("c"))
    open_ = few.filter(shared > 3).select("a", "b", "na", "nb")
    counted = known.union(common(kept(open_.union(large), "candidates")))
    return counted.withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).filter(F.col("jaccard") >= threshold)


def _needed(na: Column, nb: Column, threshold: float) -> Column:
    """Questions that sets of these sizes share if they are similar."""
    return F.ceil((na + nb) * threshold / (1 + threshold) - 1e-9).cast("int")


def _overlap(least: Column, met: Column) -> Column:
    """How many questions two sets share that have ``met`` of their combinations of ``least`` (1 to 3) in common."""
    of_two = ((1 + F.sqrt(1 + 8 * met)) / 2).cast("long")
    combos = F.transform(F.sequence(F.lit(3).cast("long"), F.lit(SMALL_SET).cast("long")), lambda k: F.floor(k * (k - 1) * (k - 2) / 6))
    return F.when(least == 1, met).when(least == 2, of_two).otherwise(F.array_position(combos, met) + 2)


def _small_pairs(rows: DataFrame, good: Column, threshold: float, small: int, title: str | None, packed: bool) -> DataFrame:
    """Pairs of sets of at most ``small`` questions (their ranks, ``number``), and how many combinations they ``met`` in.

    Sets that must share ``least`` questions share a combination of three of them (or of all,
    if ``least`` is lower) among the first ``n - least + 3``.  So each set has keys for each
    number that it may have to share with another.
    """
    own = rows.filter(F.col("n") <= small).groupBy("post_id", "n", *([title] if title else [])).agg(F.array_sort(F.collect_list("number")).alias("q"))
    n = F.col("n")
    lowest, highest = F.ceil(n * threshold - 1e-9).cast("int"), F.least(F.floor(n / threshold + 1e-9), F.lit(small)).cast("int")
    own = own.filter(lowest <= highest).withColumn("least", F.explode(F.array_distinct(F.transform(F.sequence(F.greatest(lowest, F.lit(1)), highest), lambda k: _needed(n, k, threshold)))))
    own = own.filter(F.col("least") <= n)
    size = F.least("least", F.lit(3))
    first = F.slice("q", 1, F.least(n, n - F.col("least") + size).cast("int"))
    own = own.select(F.col("post_id"), "n", "least", first.alias("q"), *([title] if title else []))
    p = F.size("q")
    one = F.transform("q", lambda x: F.array(x))
    two = F.flatten(F.transform("q", lambda x, i: F.transform(F.slice("q", i + 2, p), lambda y: F.array(x, y))))
    three = F.flatten(F.flatten(F.transform("q", lambda x, i: F.transform(F.slice("q", i + 2, p), lambda y, j: F.transform(F.slice("q", i + j + 3, p), lambda z: F.array(x, y, z))))))
    combos = F.when(F.col("least") == 1, one).when(F.col("least") == 2, two).otherwise(three)
    keyed = own.select("post_id", "n", "least", *([title] if title else []), F.explode(combos).alias("combo"))
    if packed:  # four bits and three times twenty
        parts = F.aggregate("combo", F.lit(0).cast("long"), lambda acc, x: F.shiftleft(acc, 20).bitwiseOR(x))
        combo, number = F.shiftleft(F.col("least").cast("long"), 60).bitwiseOR(parts), F.shiftrightunsigned("combo", 60)
    else:
        combo = F.concat_ws(",", F.col("least").cast("string"), F.transform("combo", lambda x: x.cast("string")))
        number = F.substring_index("combo", ",", 1)
    keyed = keyed.select("post_id", "n", combo.alias("combo"), *([title] if title else []))
    keys = ["combo"] + ([title] if title else [])
    left = keyed.select(*keys, F.col("post_id").alias("a"), F.col("n").alias("na"))
    right = keyed.select(*keys, F.col("post_id").alias("b"), F.col("n").alias("nb"))
    met = left.join(right, keys).filter(good).filter(number.cast("int") == _needed(F.col("na"), F.col("nb"), threshold))
    return met.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"))


def exact_copies(sets: DataFrame, title: str | None = None) -> DataFrame:
    """``id`` of the posts whose set (and title, if named) an earlier post has.

    Such a post is like whatever its first copy is like, so it never stays; without it,
    copies by the thousand make no pairs.
    """
    own = ["post_id"] + ([title] if title else [])
    # a set is as large as its post
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("question_id")), lambda x: x.cast("string")), ",")
    marked = sets.groupBy(*own).agg(F.sha2(whole, 256).alias("_set"))
    alike = ["_set"] + ([title] if title else [])
    firsts = marked.groupBy(*alike).agg(F.min("post_id").alias("_first"))
    return marked.join(firsts, alike).filter("post_id > _first").select(F.col("post_id").alias("id"))


def without_posts(sets: DataFrame, gone: DataFrame) -> DataFrame:
    return sets.join(gone.select(F.col("id").alias("post_id")), "post_id", "left_anti")


def duplicate_posts(sets: DataFrame, titles: DataFrame, threshold: float = TITLE_THRESHOLD) -> DataFrame:
    """``id`` of the posts that repeat an earlier kept one.

    First within groups of equal normalised titles, then among what is left across titles,
    for sets of at least eight questions and a similarity of 0.9.  ``titles`` has ``post_id``
    and ``title``, normalised; blank titles form no group.
    """
    # read many times below
    sets = kept(sets.select("post_id", "question_id").distinct(), "posts-sets")
    titled = sets.join(titles.filter("title <> ''"), "post_id")
    copies = kept(exact_copies(titled, "title"), "copies")
    near = followers(similar_pairs(without_posts(titled, copies), F.lit(True), threshold, 1, "title")).select(F.col("node").alias("id"))
    first = kept(copies.union(near), "same-title")
    left = without_posts(sets, first)
    large = left.groupBy("post_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= CROSS_SIZE).select("post_id")
    left = left.join(large, "post_id", "left_semi")
    copies = kept(exact_copies(left), "copies")
    pairs = similar_pairs(without_posts(left, copies), F.lit(True), CROSS_THRESHOLD, CROSS_SIZE)
    pairs = pairs.filter(19 * F.col("c") >= 9 * (F.col("na") + F.col("nb")))
    return first.union(copies).union(followers(pairs).select(F.col("node").alias("id")))


def removed(posts: DataFrame, occurrences: DataFrame, questions: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the posts in ``gone`` (``id``): counts renewed, questions that nothing asks left out.

    ``report`` has one row: how many posts, occurrences and questions went.  Done twice it
    changes nothing.
    """
    left, occ = without(posts, occurrences, gone)
    asked = kept(recounted(questions, occ, left).filter("n > 0"), "questions-left")
    sizes = [(name, old.agg(F.count(F.lit(1)).alias("a")), new.agg(F.count(F.lit(1)).alias("b"))) for name, old, new in (("posts", posts, left), ("occurrences", occurrences, occ), ("questions", questions, asked))]
    rows = [a.join(b, F.lit(True)).select(F.lit(name).alias("what"), (F.col("a") - F.col("b")).alias("gone"), F.col("b").alias("left")) for name, a, b in sizes]
    return {"posts": left, "occurrences": occ, "questions": asked, "report": rows[0].union(rows[1]).union(rows[2])}
