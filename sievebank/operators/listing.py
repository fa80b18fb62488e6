"""Ranked question lists, post lists, and the details behind an entry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import clip, display_text
from .filters import Filter, date_predicates, every, post_predicates, restricted_questions

ANSWER_PREVIEW, OCCURRENCE_PREVIEW, VARIANT_PREVIEW = 400, 6, 12


def star(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, variants: DataFrame | None = None) -> DataFrame:
    """Occurrences with the question and the post, both restricted before they are joined."""
    q = restricted_questions(questions, occurrences, variants, flt)
    p = posts.filter(every(post_predicates(flt))).select("id", "company", "job_group", "round_group", "posted_date").withColumnRenamed("id", "post_id")
    return occurrences.select("question_id", "post_id", "official").join(p, "post_id").join(q.withColumnRenamed("id", "question_id"), "question_id")


def company_counts(occurrences: DataFrame, posts: DataFrame) -> DataFrame:
    """``co_n``: how many companies ask a question, whatever is filtered."""
    named = posts.filter("company <> ''").select(F.col("id").alias("post_id"), "company")
    return occurrences.select("question_id", "post_id").join(named, "post_id").groupBy("question_id").agg(F.count_distinct("company").alias("co_n"))


def occurrence_counts(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("question_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("official").cast("int")).alias("official_n"))


def recounted(questions: DataFrame, occurrences: DataFrame, posts: DataFrame) -> DataFrame:
    """Questions with stored ``n`` and ``co_n`` brought up to date."""
    base = questions.drop("n", "co_n")
    out = base.join(occurrence_counts(occurrences).select("question_id", "n"), base["id"] == F.col("question_id"), "left").drop("question_id")
    out = out.join(company_counts(occurrences, posts), out["id"] == F.col("question_id"), "left").drop("question_id")
    return out.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("n", "co_n")})


def frequencies(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, variants: DataFrame | None = None) -> DataFrame:
    """Per question the occurrences within the filter; ``co_n`` comes as it is stored.

    Occurrences are counted by id before the questions' texts are joined, so no text goes
    through a shuffle once for each occurrence.
    """
    p = posts.filter(every(post_predicates(flt))).select(F.col("id").alias("post_id"))
    counted = occurrence_counts(occurrences.select("question_id", "post_id", "official").join(p, "post_id"))
    q = restricted_questions(questions, occurrences, variants, flt).withColumnRenamed("id", "question_id")
    return counted.join(q, "question_id").select("question_id", "n", "official_n", "canonical", "category", "topic", "llm_merged", "llm_cat", "answer", "co_n")


def order(sort: str) -> list[Column]:
    """The three orders of a list, each total."""
    if sort == "co":
        return [F.desc("co_n"), F.desc("n"), F.asc("question_id")]
    if sort == "priority":
        weight = F.col("co_n") * 3 + F.least("n", F.lit(20)) + F.when(F.col("answer").isNotNull(), 4).otherwise(0)
        return [weight.desc(), F.asc("question_id")]
    return [F.desc("n"), F.asc(F.char_length("canonical")), F.asc("question_id")]


def page(counted: DataFrame, flt: Filter) -> DataFrame:
    """One page, its answers clipped; the full length stays known."""
    out = counted.orderBy(*order(flt.sort)).offset(flt.offset).limit(flt.page_size)
    return out.withColumns({"answer_len": F.char_length(F.coalesce("answer", F.lit(""))).cast("long"), "answer": clip(F.coalesce("answer", F.lit("")), ANSWER_PREVIEW)})


def question_list(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, variants: DataFrame | None = None) -> DataFrame:
    return page(frequencies(questions, occurrences, posts, flt, variants), flt)


def total(questions: DataFrame, occurrences: DataFrame, posts: DataFrame, flt: Filter, variants: DataFrame | None = None) -> DataFrame:
    return star(questions, occurrences, posts, flt, variants).agg(F.count_distinct("question_id").alias("total"))


def latest_occurrences(occurrences: DataFrame, posts: DataFrame, questions: DataFrame | None = None, k: int | None = OCCURRENCE_PREVIEW) -> DataFrame:
    """The newest occurrences of each question; all of them without ``k``."""
    occ = occurrences if questions is None else occurrences.join(questions.select(F.col("question_id").alias("_q")).distinct(), F.col("question_id") == F.col("_q"), "left_semi")
    joined = occ.join(posts.withColumnRenamed("id", "post_id"), "post_id")
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("posted_at"), F.asc("post_id")))
    out = joined.withColumn("rank", rank)
    return out if k is None else out.filter(F.col("rank") <= k)


def first_variants(variants: DataFrame, k: int = VARIANT_PREVIEW) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy("text"))
    return variants.withColumn("rank", rank).filter(F.col("rank") <= k)


def with_previews(rows: DataFrame, occurrences: DataFrame, posts: DataFrame, variants: DataFrame) -> DataFrame:
    """A page of questions with arrays of their newest occurrences and first wordings, and full counts."""
    ids = rows.select("question_id")
    occ = latest_occurrences(occurrences, posts, ids)
    occ = occ.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("rank", "post_id", "company", "raw_text"))).alias("occurrences"))
    own = variants.join(ids.select(F.col("question_id").alias("_q")), F.col("question_id") == F.col("_q"), "left_semi")
    count = own.groupBy("question_id").agg(F.count(F.lit(1)).alias("variant_n"))
    first = first_variants(own).groupBy("question_id").agg(F.array_sort(F.collect_list("text")).alias("variants"))
    return rows.join(occ, "question_id", "left").join(first, "question_id", "left").join(count, "question_id", "left").withColumn("variant_n", F.coalesce("variant_n", F.lit(0)))


def variant_sources(occurrences: DataFrame, questions: DataFrame, posts: DataFrame, clean: bool = True) -> DataFrame:
    """Other wordings of each question with the posts that use them, most used first."""
    named = questions.select(F.col("id").alias("question_id"), "canonical")
    when = posts.select(F.col("id").alias("post_id"), "posted_at")
    text = F.trim("raw_text")
    rows = occurrences.join(named, "question_id").join(when, "post_id").withColumn("text", text).filter("text <> '' AND text <> canonical")
    if clean:
        rows = rows.withColumn("text", display_text(F.col("text")))
    posts_of = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("posted_at")).alias("at"), "post_id"))), lambda x: x["post_id"])
    out = rows.groupBy("question_id", "text").agg(F.count(F.lit(1)).alias("n_posts"), posts_of.alias("posts"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("n_posts"), F.asc("text"))))


def list_ranks(counted: DataFrame, most: int = 100) -> DataFrame:
    """The first ``most`` questions of the default order with their places from 1."""
    top = counted.orderBy(*order("")).limit(most)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order(""))))


def question_occurrences(occurrences: DataFrame, posts: DataFrame, id_: int) -> DataFrame:
    """All occurrences of one question with their posts, newest first."""
    own = occurrences.filter(F.col("question_id") == F.lit(id_))
    joined = own.join(posts.select(F.col("id").alias("post_id"), "title", "company", "round_group", "posted_at"), "post_id")
    return joined.orderBy(F.desc("posted_at"), F.asc("post_id"))


def question_variants(variants: DataFrame, id_: int) -> DataFrame:
    """All wordings of one question, in order."""
    return variants.filter(F.col("question_id") == F.lit(id_)).orderBy("text")


def question(questions: DataFrame, occurrences: DataFrame, id_: int) -> DataFrame:
    """One question with its stored count and all its official occurrences; no row if there is none."""
    own = questions.filter(F.col("id") == F.lit(id_))
    official = occurrences.filter(F.col("question_id") == F.lit(id_)).groupBy("question_id").agg(F.sum(F.col("official").cast("int")).alias("official_n"))
    out = own.join(official, own["id"] == F.col("question_id"), "left").drop("question_id")
    return out.withColumns({"official_n": F.coalesce("official_n", F.lit(0)), "answer": F.coalesce("answer", F.lit(""))})


def post(posts: DataFrame, id_: int) -> DataFrame:
    return posts.filter(F.col("id") == F.lit(id_))


def post_list(posts: DataFrame, occurrences: DataFrame, questions: DataFrame, flt: Filter, with_content: bool = False, with_questions: bool = True) -> DataFrame:
    """Posts, newest first; by default those with a question that is not noise."""
    out = posts.filter(every([F.col(c) == getattr(flt, c) for c in ("company", "round_group") if getattr(flt, c)] + date_predicates(flt)))
    if with_content:
        out = out.filter("content <> ''")
    if with_questions:
        from ..functions.rules import NOISE

        good = occurrences.join(questions.filter(F.col("llm_cat") != NOISE).select(F.col("id").alias("question_id")), "question_id").select(F.col("post_id").alias("_p"))
        out = out.join(good, F.col("id") == F.col("_p"), "left_semi")
    return out.drop("official_q").orderBy(F.desc("posted_at"), F.asc("id")).offset(flt.offset).limit(flt.page_size)
