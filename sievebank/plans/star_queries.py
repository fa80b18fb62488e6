"""Queries over the star of posts, occurrences and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import dedup, facets as fa, listing as li, maintenance as ma
from ..operators.filters import Filter
from . import bindings as b
from .bindings import BY_CO, BY_N, BY_PRIORITY, NOT_NOISE, STAR, facet_sql, list_sql

RANGE = Filter(date_from="1996-01-01", date_to="1997-12-31")
IN_RANGE = "posted_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'"


def _list(flt: Filter, keyword: bool = False):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return li.question_list(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), flt, b.variants(spark, d) if keyword else None)

    return run


def _total(spark: SparkSession, d: str) -> DataFrame:
    return li.total(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), RANGE)


def _post_facets(spark: SparkSession, d: str) -> DataFrame:
    return fa.post_facets(b.posts(spark, d), RANGE)


def _question_facets(spark: SparkSession, d: str) -> DataFrame:
    return fa.question_facets(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), RANGE)


def _label_facets(spark: SparkSession, d: str) -> DataFrame:
    return fa.label_facets(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), RANGE)


def _all_facets(spark: SparkSession, d: str) -> DataFrame:
    return fa.facets(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), Filter())


def _drill(spark: SparkSession, d: str) -> DataFrame:
    return fa.label_facets(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), Filter(), ("llm_cat",), category="Brand#11")


def _taxonomy_chips(spark: SparkSession, d: str) -> DataFrame:
    tax = b.table(spark, d, "part").select(F.col("p_type").alias("name"), F.lit("parts").alias("domain"), F.lit("all").alias("merged")).distinct()
    return fa.drill_down(tax, fa.label_facets(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), Filter(), ("llm_cat",)))


def _matrix(spark: SparkSession, d: str) -> DataFrame:
    return fa.matrix(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), RANGE)


def _top_matrix(spark: SparkSession, d: str) -> DataFrame:
    return fa.top_matrix(_matrix(spark, d), 5, 4)


def _meta(flt: Filter):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return fa.overview(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), flt)

    return run


def _latest(spark: SparkSession, d: str) -> DataFrame:
    return li.latest_occurrences(b.occurrences(spark, d), b.posts(spark, d)).select("question_id", "rank", "post_id", "company", "raw_text")


def _variants(spark: SparkSession, d: str) -> DataFrame:
    return li.first_variants(b.variants(spark, d), 3).select("question_id", "text", "rank")


def _sources(spark: SparkSession, d: str) -> DataFrame:
    out = li.variant_sources(b.occurrences(spark, d), b.questions(spark, d, False), b.posts(spark, d))
    return out.select("question_id", "text", "n_posts", F.concat_ws(",", F.transform("posts", lambda x: x.cast("string"))).alias("posts"), "rank")


def _previews(spark: SparkSession, d: str) -> DataFrame:
    page = li.question_list(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), Filter(size=20))
    out = li.with_previews(page, b.occurrences(spark, d), b.posts(spark, d), b.variants(spark, d))
    return out.select("question_id", "n", F.size("occurrences").cast("long").alias("occurrences"), F.size("variants").cast("long").alias("variants"), "variant_n")


def _question(spark: SparkSession, d: str) -> DataFrame:
    return li.question(b.questions(spark, d), b.occurrences(spark, d), 7).select("id", "canonical", "answer", "co_n", "official_n")


def _post(spark: SparkSession, d: str) -> DataFrame:
    return li.post(b.posts(spark, d), 7).select("id", "company", "job_group", "round_group")


def _post_list(spark: SparkSession, d: str) -> DataFrame:
    out = li.post_list(b.posts(spark, d), b.occurrences(spark, d), b.questions(spark, d, False), Filter(company="NATION_3", date_from="1996-01-01"))
    return out.select("id", "company", "round_group", "posted_at")


def _recount(spark: SparkSession, d: str) -> DataFrame:
    return li.recounted(b.questions(spark, d, False), b.occurrences(spark, d), b.posts(spark, d)).select("id", "n", "co_n")


def _pruned(spark: SparkSession, d: str) -> DataFrame:
    occ = b.occurrences(spark, d).filter("question_id % 3 = 0")
    posts, _ = ma.pruned(b.posts(spark, d), occ, b.questions(spark, d, False))
    return posts.select("id")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    questions = b.questions(spark, d, False).filter("answer IS NOT NULL")
    return ma.pruned(b.posts(spark, d), b.occurrences(spark, d), questions)[1].select("question_id", "post_id")


def _upsert(spark: SparkSession, d: str) -> DataFrame:
    old = b.table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("author_name"), F.col("c_mktsegment").alias("title"))
    new = old.filter("id % 5 < 2").select("id", F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.lit("new")).alias("author_name"), F.lit("changed").alias("title"))
    return ma.upsert(old, new, "id", ("author_name",))


def _companies(spark: SparkSession, d: str) -> DataFrame:
    return b.posts(spark, d).filter("company <> ''").select("company").distinct()


def _sample(spark: SparkSession, d: str) -> DataFrame:
    return ma.stratified(b.questions(spark, d, False), "category", "id", 60).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _batches(spark: SparkSession, d: str) -> DataFrame:
    return ma.batched(b.questions(spark, d, False).select("id", "canonical"), [F.col("id")], 150).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


def _post_jaccard(spark: SparkSession, d: str) -> DataFrame:
    sets = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("post_id"), (F.col("l_partkey") % 400).alias("question_id")).distinct()
    return dedup.similar_pairs(sets, F.lit(1) == 1, 0.5, 2).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


QUERIES = {
    "list_default": (_list(Filter()), list_sql(NOT_NOISE, BY_N)),
    "list_page_2": (_list(Filter(page=2, size=30)), list_sql(NOT_NOISE, BY_N, 30, 30)),
    "list_by_companies": (_list(Filter(sort="co")), list_sql(NOT_NOISE, BY_CO)),
    "list_by_priority": (_list(Filter(sort="priority", include_noise=True)), list_sql("true", BY_PRIORITY)),
    "list_in_range": (_list(Filter(date_from="1996-01-01", date_to="1997-12-31", company="NATION_3", job_group="BUILDING")), list_sql(f"{NOT_NOISE} AND {IN_RANGE} AND company = 'NATION_3' AND job_group = 'BUILDING'", BY_N)),
    "list_with_answer": (_list(Filter(has_answer=True, only_labeled=True, category="Brand#12")), list_sql(f"{NOT_NOISE} AND llm_cat <> '' AND answer IS NOT NULL AND category = 'Brand#12'", BY_N)),
    "list_official": (_list(Filter(official_only=True, round_group="1-URGENT", size=500)), list_sql(f"{NOT_NOISE} AND round_group = '1-URGENT' AND id IN (SELECT question_id FROM occ WHERE official = 1)", BY_N, 500)),
    "list_keyword": (_list(Filter(keyword=" LINE 7 ", size=200), True), list_sql(f"{NOT_NOISE} AND (contains(lower(canonical), 'line 7') OR id IN (SELECT question_id FROM variants WHERE contains(lower(text), 'line 7')))", BY_N, 200)),
    "list_total": (_total, f"{STAR} SELECT count(DISTINCT id) AS total FROM star WHERE {NOT_NOISE} AND {IN_RANGE}"),
    "facets_posts": (_post_facets, STAR + facet_sql(("round_group", "job_group", "company"), "posts", IN_RANGE)),
    "facets_questions": (_question_facets, STAR + facet_sql(("category", "topic"), "star", IN_RANGE)),
    "facets_labels": (_label_facets, STAR + facet_sql(("llm_merged", "llm_domain", "llm_cat"), "star", f"{IN_RANGE} AND {NOT_NOISE}")),
    "facets_all": (
        _all_facets,
        STAR + " UNION ALL ".join(f"SELECT * FROM ({x})" for x in (facet_sql(("round_group", "job_group", "company"), "posts"), facet_sql(("category", "topic"), "star"), facet_sql(("llm_merged", "llm_domain", "llm_cat"), "star", NOT_NOISE))),
    ),
    "facets_drill_down": (_drill, STAR + facet_sql(("llm_cat",), "star", f"{NOT_NOISE} AND category = 'Brand#11'")),
    "taxonomy_chips": (_taxonomy_chips, f"{STAR} SELECT 'all' AS merged, 'parts' AS domain, llm_cat AS name, count(*) AS count FROM star WHERE {NOT_NOISE} GROUP BY llm_cat"),
    "matrix": (_matrix, f"{STAR} SELECT company, llm_merged AS cat, count(DISTINCT id) AS n FROM star WHERE {IN_RANGE} GROUP BY 1, 2"),
    "matrix_top": (
        _top_matrix,
        f"""{STAR}, c AS (SELECT company, llm_merged AS cat, count(DISTINCT id) AS n FROM star WHERE {IN_RANGE} GROUP BY 1, 2),
r AS (SELECT company, row_number() OVER (ORDER BY sum(n) DESC, company) AS co_rank FROM c GROUP BY 1),
k AS (SELECT cat, row_number() OVER (ORDER BY sum(n) DESC, cat) AS cat_rank FROM c GROUP BY 1)
SELECT c.company, c.cat, n, co_rank, cat_rank, CAST(sum(n) OVER (PARTITION BY c.company) AS BIGINT) AS row_total,
       CAST(sum(n) OVER (PARTITION BY c.cat) AS BIGINT) AS col_total, round(n / max(n) OVER () * 0.8, 6) AS shade
FROM c JOIN r USING (company) JOIN k USING (cat) WHERE co_rank <= 5 AND cat_rank <= 4""",
    ),
}


def _meta_sql(where: str) -> str:
    return f"""{STAR} SELECT * FROM (
  SELECT count(*) AS posts, count(DISTINCT company) AS companies, CAST(min(posted_date) AS VARCHAR) AS date_min, CAST(max(posted_date) AS VARCHAR) AS date_max FROM posts WHERE {where}),
 (SELECT count(DISTINCT post_id) AS posts_with_questions, count(*) AS raw_count, count(*) AS occurrences, count(DISTINCT id) AS questions,
   count(DISTINCT id) FILTER (answer IS NOT NULL) AS with_answer, count(DISTINCT id) FILTER (llm_cat <> '' AND {NOT_NOISE}) AS labeled,
   count(DISTINCT id) FILTER (llm_cat = '非题目') AS noise, count(DISTINCT id) FILTER (llm_cat = '') AS unlabeled FROM star WHERE {where}),
 (SELECT CAST(min(posted_date) AS VARCHAR) AS global_min, CAST(max(posted_date) AS VARCHAR) AS global_max FROM posts)"""


QUERIES |= {
    "overview": (_meta(Filter()), _meta_sql("true")),
    "overview_in_range": (_meta(RANGE), _meta_sql(IN_RANGE)),
    "latest_occurrences": (
        _latest,
        f"""{STAR} SELECT question_id, rank, post_id, company, raw_text FROM (
 SELECT o.question_id, o.post_id, p.company, o.raw_text, row_number() OVER (PARTITION BY o.question_id ORDER BY p.posted_at DESC, o.post_id) AS rank
 FROM occ o JOIN posts p ON p.id = o.post_id) WHERE rank <= 6""",
    ),
    "first_variants": (_variants, f"{STAR} SELECT question_id, text, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY text) AS rank FROM variants) WHERE rank <= 3"),
    "variant_sources": (
        _sources,
        f"""{STAR}, v AS (SELECT id AS question_id, raw_text AS text, count(*) AS n_posts, string_agg(CAST(post_id AS VARCHAR), ',' ORDER BY posted_at DESC, post_id) AS posts
 FROM star WHERE raw_text <> '' AND raw_text <> canonical GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY n_posts DESC, text) AS rank FROM v""",
    ),
    "list_previews": (
        _previews,
        f"""{STAR}, top AS (SELECT id AS question_id, count(*) AS n FROM star WHERE {NOT_NOISE} GROUP BY id ORDER BY n DESC, length(any_value(canonical)), id LIMIT 20)
SELECT question_id, n, least(6, (SELECT count(*) FROM occ o WHERE o.question_id = top.question_id)) AS occurrences,
 least(12, (SELECT count(*) FROM variants v WHERE v.question_id = top.question_id)) AS variants, (SELECT count(*) FROM variants v WHERE v.question_id = top.question_id) AS variant_n FROM top""",
    ),
    "question_detail": (_question, f"{STAR} SELECT id, canonical, coalesce(answer, '') AS answer, co_n, (SELECT CAST(coalesce(sum(official), 0) AS BIGINT) FROM occ WHERE question_id = 7) AS official_n FROM questions WHERE id = 7"),
    "post_detail": (_post, f"{STAR} SELECT id, company, job_group, round_group FROM posts WHERE id = 7"),
    "post_list": (
        _post_list,
        f"{STAR} SELECT id, company, round_group, posted_at FROM posts WHERE company = 'NATION_3' AND posted_date >= DATE '1996-01-01' AND id IN (SELECT post_id FROM star WHERE {NOT_NOISE}) ORDER BY posted_at DESC, id LIMIT 50",
    ),
    "recount": (_recount, f"{STAR} SELECT id, (SELECT count(*) FROM occ WHERE question_id = questions.id) AS n, co_n FROM questions"),
    "prune_posts": (_pruned, f"{STAR} SELECT id FROM posts WHERE id IN (SELECT post_id FROM occ WHERE question_id % 3 = 0)"),
    "prune_orphans": (_orphans, f"{STAR} SELECT question_id, post_id FROM occ WHERE question_id IN (SELECT id FROM questions WHERE answer IS NOT NULL)"),
    "upsert": (
        _upsert,
        "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 1 THEN 'new' ELSE c_name END AS author_name, CASE WHEN c_custkey % 5 < 2 THEN 'changed' ELSE c_mktsegment END AS title FROM customer",
    ),
    "companies": (_companies, f"{STAR} SELECT DISTINCT company FROM posts WHERE company <> ''"),
    "stratified_sample": (_sample, "WITH r AS (SELECT p_partkey AS id, p_brand AS category, row_number() OVER (PARTITION BY p_brand ORDER BY md5('20260913:' || p_partkey), p_partkey) AS r, 60 // (SELECT count(DISTINCT p_brand) FROM part) AS per FROM part),"
        " s AS (SELECT *, r <= per AS own, count(*) FILTER (r <= per) OVER () AS have, row_number() OVER (PARTITION BY r <= per ORDER BY id) AS place FROM r)"
        " SELECT category, count(*) AS n, min(id) AS first_id FROM s WHERE own OR place <= 60 - have GROUP BY 1"),
    "label_batches": (_batches, "SELECT (row_number() OVER (ORDER BY p_partkey) - 1) // 150 AS batch, p_partkey AS id FROM part"),
    "similar_posts": (
        _post_jaccard,
        """WITH s AS (SELECT DISTINCT l_orderkey AS p, l_partkey % 400 AS q FROM lineitem), n AS (SELECT p, count(*) AS n FROM s GROUP BY 1 HAVING count(*) >= 2),
c AS (SELECT x.p AS a, y.p AS b, count(*) AS c FROM s x JOIN s y ON x.q = y.q AND x.p < y.p GROUP BY 1, 2)
SELECT a, b, round(c / (m.n + k.n - c), 6) AS jaccard FROM c JOIN n m ON m.p = a JOIN n k ON k.p = b WHERE c / (m.n + k.n - c) >= 0.5""",
    ),
}
QUERIES["label_batches"] = (QUERIES["label_batches"][0], f"SELECT batch, count(*) AS n, min(id) AS first_id FROM ({QUERIES['label_batches'][1]}) GROUP BY batch")
