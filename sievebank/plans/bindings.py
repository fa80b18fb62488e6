"""The driver's tables seen as posts, occurrences, questions and variants, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.listing import company_counts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as posts: the customer's nation is the company, segment and priority are job and round."""
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    # customers and nations are dimensions of the orders; Spark broadcasts them if they are small
    out = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return out.select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("order "), F.col("o_orderstatus")).alias("title"),
        F.col("n_name").alias("company"),
        F.col("c_mktsegment").alias("job_group"),
        F.col("o_orderpriority").alias("round_group"),
        F.col("c_name").alias("content"),
        F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)").alias("posted_at"),
        F.col("o_orderdate").cast("date").alias("posted_date"),
        F.lit(None).cast("string").alias("official_q"),
    )


def occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as occurrences of a part in an order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("question_id"), F.col("l_orderkey").alias("post_id"))
    return lines.agg(F.max(F.col("l_returnflag") == "R").alias("official"), F.concat(F.lit("line "), F.min("l_linenumber").cast("string")).alias("raw_text"))


def questions(spark: SparkSession, sf_dir: str, counted: bool = True) -> DataFrame:
    """Parts as questions; the type PROMO stands for noise."""
    out = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("canonical"),
        F.lower("p_name").alias("norm"),
        F.col("p_brand").alias("category"),
        F.concat(F.lit("size "), F.col("p_size").cast("string")).alias("topic"),
        F.when(F.col("p_size") > 25, F.col("p_name")).alias("answer"),
        F.when(F.col("p_type") == "PROMO", F.lit("非题目")).otherwise(F.col("p_type")).alias("llm_cat"),
        F.col("p_brand").alias("llm_domain"),
        F.when(F.col("p_type") == "PROMO", F.lit("非题目")).otherwise(F.col("p_type")).alias("llm_merged"),
    )
    if not counted:
        return out
    counts = company_counts(occurrences(spark, sf_dir), posts(spark, sf_dir))
    return out.join(counts, out["id"] == counts["question_id"], "left").drop("question_id").withColumn("co_n", F.coalesce("co_n", F.lit(0)))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occurrences(spark, sf_dir).select("question_id", F.col("raw_text").alias("text")).distinct()


STAR = """
WITH posts AS (
  SELECT o_orderkey AS id, 'order ' || o_orderstatus AS title, n_name AS company, c_mktsegment AS job_group, o_orderpriority AS round_group,
         c_name AS content, epoch_ms(o_orderdate) AS posted_at, CAST(o_orderdate AS DATE) AS posted_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), occ AS (
  SELECT l_partkey AS question_id, l_orderkey AS post_id, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS official,
         'line ' || CAST(min(l_linenumber) AS VARCHAR) AS raw_text
  FROM lineitem GROUP BY 1, 2
), co AS (
  SELECT question_id, count(DISTINCT company) AS co_n FROM occ JOIN posts ON post_id = id WHERE company <> '' GROUP BY 1
), questions AS (
  SELECT p_partkey AS id, p_name AS canonical, lower(p_name) AS norm, p_brand AS category, 'size ' || CAST(p_size AS VARCHAR) AS topic,
         CASE WHEN p_size > 25 THEN p_name END AS answer, CASE WHEN p_type = 'PROMO' THEN '非题目' ELSE p_type END AS llm_cat,
         p_brand AS llm_domain, CASE WHEN p_type = 'PROMO' THEN '非题目' ELSE p_type END AS llm_merged, coalesce(co_n, 0) AS co_n
  FROM part LEFT JOIN co ON p_partkey = question_id
), variants AS (SELECT DISTINCT question_id, raw_text AS text FROM occ),
star AS (
  SELECT q.*, o.post_id, o.official, o.raw_text, p.company, p.job_group, p.round_group, p.posted_date, p.posted_at
  FROM occ o JOIN posts p ON p.id = o.post_id JOIN questions q ON q.id = o.question_id
)
"""


def list_sql(where: str, order: str, size: int = 50, offset: int = 0) -> str:
    return f"""{STAR}
SELECT id AS question_id, count(*) AS n, CAST(sum(official) AS BIGINT) AS official_n, any_value(canonical) AS canonical, any_value(category) AS category,
       any_value(topic) AS topic, any_value(llm_merged) AS llm_merged, any_value(llm_cat) AS llm_cat,
       left(coalesce(any_value(answer), ''), 400) AS answer, any_value(co_n) AS co_n, CAST(length(coalesce(any_value(answer), '')) AS BIGINT) AS answer_len
FROM star WHERE {where} GROUP BY id ORDER BY {order} LIMIT {size} OFFSET {offset}"""


NOT_NOISE = "llm_cat <> '非题目'"
BY_N = "n DESC, length(any_value(canonical)), question_id"
BY_CO = "any_value(co_n) DESC, n DESC, question_id"
BY_PRIORITY = "any_value(co_n) * 3 + least(n, 20) + CASE WHEN any_value(answer) IS NOT NULL THEN 4 ELSE 0 END DESC, question_id"


def facet_sql(dims: tuple[str, ...], source: str, where: str = "true") -> str:
    parts = " UNION ALL ".join(f"SELECT '{d}' AS dim, {d} AS value, count(*) AS count FROM {source} WHERE {where} AND {d} <> '' GROUP BY 2" for d in dims)
    return f"SELECT *, row_number() OVER (PARTITION BY dim ORDER BY value IN ('其他','其他技术','未知','不限',''), count DESC, value) AS rank FROM ({parts})"
