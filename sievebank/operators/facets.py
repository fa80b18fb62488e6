"""Counts by dimension, the company by topic matrix, and the overview."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.rules import INTRO, NOISE, PLACEHOLDERS
from .filters import Filter, date_predicates, every
from .listing import star

POST_DIMENSIONS = ("round_group", "job_group", "company")
QUESTION_DIMENSIONS = ("category", "topic")
LABEL_DIMENSIONS = ("llm_merged", "llm_domain", "llm_cat")


def ranked(counts: DataFrame) -> DataFrame:
    """Values by count, those that say nothing last; ``rank`` is the place within ``dim``."""
    place = Window.partitionBy("dim").orderBy(F.col("value").isin(*PLACEHOLDERS), F.desc("count"), F.asc("value"))
    return counts.withColumn("rank", F.row_number().over(place))


def _counted(rows: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """One pass for several dimensions: each row is turned into one for each dimension."""
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in dimensions]))
    return rows.select(pairs.alias("x")).select("x.*").filter("value <> ''").groupBy("dim", "value").agg(F.count(F.lit(1)).alias("count"))


def post_facets(posts: DataFrame, flt: Filter, dimensions: tuple[str, ...] = POST_DIMENSIONS) -> DataFrame:
    """Posts by value, those without questions too."""
    return ranked(_counted(posts.filter(every(date_predicates(flt))), dimensions))


def question_facets(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, dimensions: tuple[str, ...] = QUESTION_DIMENSIONS, category: str = "", knowledge_only: bool = True) -> DataFrame:
    """Occurrences by category and topic; noise counts, and the topic list leaves the introduction out."""
    asked = Filter(date_from=flt.date_from, date_to=flt.date_to, include_noise=True, category=category)
    rows = star(questions, occurrences, posts, asked)
    if knowledge_only:
        rows = rows.withColumn("topic", F.when(F.col("category") == INTRO, F.lit("")).otherwise(F.col("topic")))
    return ranked(_counted(rows, dimensions))


def label_facets(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, dimensions: tuple[str, ...] = LABEL_DIMENSIONS, category: str = "") -> DataFrame:
    """Occurrences by label, without noise."""
    asked = Filter(date_from=flt.date_from, date_to=flt.date_to, category=category)
    return ranked(_counted(star(questions, occurrences, posts, asked), dimensions))


def facets(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter) -> DataFrame:
    """All eight lists in one table; the five of occurrences come from one star."""
    rows = star(questions, occurrences, posts, Filter(date_from=flt.date_from, date_to=flt.date_to, include_noise=True))
    blank = F.lit("")
    noise = {c: F.when(F.col("llm_cat") == NOISE, blank).otherwise(F.col(c)) for c in LABEL_DIMENSIONS}
    rows = rows.withColumns(noise | {"topic": F.when(F.col("category") == INTRO, blank).otherwise(F.col("topic"))})
    return post_facets(posts, flt).unionByName(ranked(_counted(rows, QUESTION_DIMENSIONS + LABEL_DIMENSIONS)))


def chip_row(facet: DataFrame, dimension: str, selected: str = "", most: int = 16) -> DataFrame:
    """The first values of one list, and the selected one wherever it stands."""
    return facet.filter(F.col("dim") == dimension).filter((F.col("rank") <= most) | (F.col("value") == selected)).orderBy("rank")


def drill_down(taxonomy: DataFrame, label_counts: DataFrame) -> DataFrame:
    """The taxonomy's categories that have occurrences, with their counts."""
    counts = label_counts.filter("dim = 'llm_cat'").select(F.col("value").alias("name"), "count")
    return taxonomy.join(counts, "name").filter("count > 0").select("merged", "domain", "name", "count")


def matrix(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter) -> DataFrame:
    """Distinct questions by company and merged label; noise has a column of its own."""
    rows = star(questions, occurrences, posts, Filter(date_from=flt.date_from, date_to=flt.date_to, include_noise=True))
    return rows.filter("company <> '' AND llm_merged <> ''").groupBy("company", F.col("llm_merged").alias("cat")).agg(F.count_distinct("question_id").alias("n"))


def top_matrix(cells: DataFrame, companies: int = 15, cats: int = 12) -> DataFrame:
    """The cells of the largest companies and labels, with their ranks.

    Ranks come from the totals of all cells; the totals shown are those of the shown cells.
    The totals have one row for each company or label of the matrix.
    """
    out = cells
    for key, rank, most in (("company", "co_rank", companies), ("cat", "cat_rank", cats)):
        sums = cells.groupBy(key).agg(F.sum("n").alias("_t")).withColumn(rank, F.row_number().over(Window.orderBy(F.desc("_t"), F.asc(key)))).filter(F.col(rank) <= most)
        out = out.join(sums.select(key, rank), key)
    rows, columns = Window.partitionBy("company"), Window.partitionBy("cat")
    shade = F.round(F.col("n") / F.max("n").over(Window.partitionBy()) * 0.8, 6)
    return out.withColumns({"row_total": F.sum("n").over(rows), "col_total": F.sum("n").over(columns), "shade": shade})


def overview(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter) -> DataFrame:
    """The fourteen figures of the front page in one row; the last two ignore the dates."""
    own = posts.filter(every(date_predicates(flt)))
    named = F.when(F.col("company") != "", F.col("posted_date"))
    of_posts = own.agg(
        F.count(F.lit(1)).alias("posts"),
        F.count_distinct(F.when(F.col("company") != "", F.col("company"))).alias("companies"),
        F.date_format(F.min(named), "yyyy-MM-dd").alias("date_min"),
        F.date_format(F.max(named), "yyyy-MM-dd").alias("date_max"),
    )
    # counted by question first: several distinct counts at once would multiply the rows
    ids = questions.select(F.col("id").alias("question_id"))
    asked = occurrences.select("question_id", "post_id").join(ids, "question_id", "left_semi")
    with_questions = own.join(asked.select(F.col("post_id").alias("_p")), F.col("id") == F.col("_p"), "left_semi").agg(F.count(F.lit(1)).alias("posts_with_questions"))
    by_question = occurrences.select("question_id", "post_id").join(own.select(F.col("id").alias("post_id")), "post_id").groupBy("question_id").agg(F.count(F.lit(1)).alias("_n"))
    cat = F.col("llm_cat")
    of_rows = by_question.join(questions.select(F.col("id").alias("question_id"), "answer", "llm_cat"), "question_id").agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("raw_count"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("occurrences"),
        F.count(F.lit(1)).alias("questions"),
        F.count_if(F.col("answer").isNotNull()).alias("with_answer"),
        F.count_if((cat != "") & (cat != NOISE)).alias("labeled"),
        F.count_if(cat == NOISE).alias("noise"),
        F.count_if(cat == "").alias("unlabeled"),
    )
    whole = posts.agg(F.date_format(F.min(named), "yyyy-MM-dd").alias("global_min"), F.date_format(F.max(named), "yyyy-MM-dd").alias("global_max"))
    # four single rows side by side
    one = F.lit(1).alias("_one")
    return of_posts.select("*", one).join(with_questions.select("*", one), "_one").join(of_rows.select("*", one), "_one").join(whole.select("*", one), "_one").drop("_one")
