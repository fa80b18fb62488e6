"""From posts to lines: official questions, and the questions found in the text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import rules as R
from ..functions.text import clean_text, classify, is_interview_post, is_meta_answer, is_question, split_compound, split_inline, strip_formatting, topic_of, trim_answer
from ..sources.snapshot import official_list


def official_lines(posts: DataFrame) -> DataFrame:
    """The official questions of each post; answers that only ask back become blank."""
    rows = posts.select("id", "posted_at", F.posexplode(official_list(F.col("official_q"))).alias("line", "q"))
    rows = rows.withColumn("text", clean_text(F.coalesce(F.col("q.title"), F.lit("")), every_entity=True)).filter("text <> ''")
    answer = trim_answer(F.coalesce(F.col("q.answer"), F.lit("")))
    rows = rows.withColumn("answer", answer).withColumn("answer", F.when(is_meta_answer(F.col("answer")), F.lit("")).otherwise(F.col("answer")))
    return rows.select("id", "posted_at", F.lit(0).alias("branch"), "line", F.lit(0).alias("piece"), F.lit(0).alias("part"), "text", "answer", F.lit(True).alias("official"))


def body_lines(posts: DataFrame) -> DataFrame:
    """The questions in the text of interview posts, and of those with an official list."""
    official = F.exists(official_list(F.col("official_q")), lambda q: clean_text(F.coalesce(q["title"], F.lit(""))) != "")
    own = posts.filter(is_interview_post(F.col("company"), F.col("title")) | official)
    lines = own.select("id", "posted_at", F.posexplode(F.split("content", R.LINES)).alias("line", "raw"))
    lines = lines.withColumn("clean", strip_formatting(clean_text(F.col("raw"), every_entity=True))).filter("clean <> ''")
    pieces = lines.select("id", "posted_at", "line", F.posexplode(split_inline(F.col("clean"))).alias("piece", "one"))
    asked = pieces.filter(is_question(F.col("one")))
    parts = asked.select("id", "posted_at", "line", "piece", F.posexplode(split_compound(F.col("one"))).alias("part", "text"))
    return parts.select("id", "posted_at", F.lit(1).alias("branch"), "line", "piece", "part", "text", F.lit("").alias("answer"), F.lit(False).alias("official"))


def lines_of(posts: DataFrame) -> DataFrame:
    """All lines with module and topic; ``seq`` orders them: newest posts first, official lines first."""
    rows = official_lines(posts).unionByName(body_lines(posts))
    rows = rows.withColumn("cat", classify(F.col("text"))).withColumn("topic", topic_of(F.col("text"), F.col("cat")))
    order = F.struct((-F.col("posted_at")).alias("t"), "id", "branch", "line", "piece", "part")
    return rows.select(F.col("id").alias("post_id"), order.alias("seq"), "text", "cat", "topic", "answer", "official")
