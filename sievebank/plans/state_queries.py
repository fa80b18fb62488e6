"""Queries over whole pages with an embedded state, labels in batches, leaders and reposts, with their SQL.

Every document becomes a page whose state holds it, so the way from a page to a post runs over
the whole table; names of suppliers and parts are the lines that are clustered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import rules as R, text as t, titles as ti
from ..operators import cluster, dedup, facets, labels, leaders, listing, maintenance
from ..operators.filters import Filter, has_labels
from ..sources import pages as pg
from . import bindings as b
from .bindings import BY_N, NOT_NOISE, STAR
from .text_queries import ENDS, fillers_sql, m, q, strip_sql, sub

SITE = "https://example.org"
FIRST_DAY = 1_700_000_000_000


def state_pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each document; every seventh has no content, every eleventh a state without an end."""
    k = F.col("doc_id")
    number = k.cast("string")
    content = F.struct(
        F.concat(F.lit("a"), number).alias("uuid"),
        F.when(k % 3 != 0, k).alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.concat(F.lit('<a class="tag" href="/creation/subject/x">#Tag '), number, F.lit("#</a><br/>"), F.col("text")).alias("content"),
        F.when(k % 2 == 0, k + FIRST_DAY).otherwise(F.lit(0)).alias("createdAt"),
        F.when(k % 5 == 0, k + FIRST_DAY + 1).alias("createTime"),
        (k + FIRST_DAY + 2).alias("editTime"),
        F.when(k % 4 == 0, 74).otherwise(8).alias("entityType"),
        F.col("lang").alias("ip4Location"),
        F.struct((k + 7).alias("userId"), F.col("source").alias("nickname")).alias("userBrief"),
        F.struct((k % 10).alias("likeCnt"), (k % 9).cast("string").alias("totalCommentCnt"), (k % 8).alias("viewCnt")).alias("frequencyData"),
    )
    asked = F.when(k % 6 == 0, F.array(F.struct(k.alias("id"), F.lit("a question").alias("title"), F.lit("an answer").alias("answer"))))
    shared = F.struct(F.when(k % 7 != 0, content).alias("contentData"), asked.alias("experienceQuestionList"))
    state = F.to_json(F.struct(F.struct(F.struct(shared.alias("ssrCommonData")).alias("2")).alias("prefetchData")))
    html = F.concat(F.lit("<html><script>window.__INITIAL_STATE__="), F.when(k % 11 == 0, F.left(state, F.lit(30))).otherwise(state), F.lit(";</script></html>"))
    kind = F.when(k % 2 == 0, F.concat(F.lit(f"{SITE}/discuss/"), number, F.lit("?from=x"))).otherwise(F.concat(F.lit(f"{SITE}/other/"), number))
    return b.table(spark, d, "documents").select(k.alias("page_id"), kind.alias("url"), html.alias("html"))


def _page_posts(spark: SparkSession, d: str) -> DataFrame:
    posts = pg.posts_of(state_pages(spark, d), SITE, gated=False)
    # addresses without an id get a number of their own; SQL knows them by their uuid
    known = F.regexp_extract("uuid", "[0-9]+", 0).cast("bigint")
    own = F.when(known % 3 != 0, F.col("id")).otherwise(F.lit(-1))
    return posts.select(
        "uuid", own.alias("id"), "url", "title", F.sha1(F.encode("content", "UTF-8")).alias("content_sha1"), "posted_at", F.date_format("posted_date", "yyyy-MM-dd").alias("day"), "entity_type", "topic_tag", "location",
        "author_id", "author_name", "likes", "comments", "views", (F.size(F.from_json("official_q", "array<struct<id:bigint,title:string,answer:string>>")) > 0).alias("official"),
    ).withColumn("official", F.coalesce("official", F.lit(False)))


STATES = f"""s AS (SELECT doc_id AS k, text, lang, source, string_split(text, chr(10))[1] AS head,
 CASE WHEN doc_id % 2 = 0 THEN doc_id + {FIRST_DAY} WHEN doc_id % 5 = 0 THEN doc_id + {FIRST_DAY} + 1 ELSE doc_id + {FIRST_DAY} + 2 END AS posted FROM documents)"""


def html_text_sql(x: str) -> str:
    x = sub(sub(x, R.BREAKS, "\n"), R.TAG)
    for a, c in R.ENTITIES:
        x = f"replace({x}, '{a}', {q(c)})"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {sub('y', ENDS)}), chr(10))"
    return sub(sub(x, "\n{3,}", "\n\n"), ENDS)


def page_posts_sql() -> str:
    html = """'<a class="tag" href="/creation/subject/x">#Tag ' || k || '#</a><br/>' || text"""
    return f"""WITH {STATES} SELECT 'a' || k AS uuid, CASE WHEN k % 3 <> 0 THEN k ELSE -1 END AS id,
 CASE WHEN k % 2 = 0 THEN '{SITE}/discuss/' || k ELSE '{SITE}/feed/main/detail/a' || k END AS url, {sub('head', ENDS)} AS title, sha1({html_text_sql(html)}) AS content_sha1,
 posted AS posted_at, strftime(epoch_ms(posted), '%Y-%m-%d') AS day, CASE WHEN k % 4 = 0 THEN 74 ELSE 8 END AS entity_type, {sub(f"regexp_extract({html}, {q(R.TOPIC_LINK)}, 1)", ENDS)} AS topic_tag,
 lang AS location, k + 7 AS author_id, source AS author_name, k % 10 AS likes, k % 9 AS comments, k % 8 AS views, k % 6 = 0 AS official
 FROM s WHERE k % 7 <> 0 AND k % 11 <> 0"""


def _content_pages(spark: SparkSession, d: str) -> DataFrame:
    html, url = F.col("html"), F.col("url")
    return state_pages(spark, d).select("page_id", pg.is_content_page(html).alias("is_content"), pg.is_content_url(url, SITE).alias("is_address"), pg.dig(pg.state_json(html), pg.CONTENT + ".userBrief.nickname").alias("author"))


def _survey(spark: SparkSession, d: str) -> DataFrame:
    return pg.survey(state_pages(spark, d)).filter("part <> 'kind' AND part <> 'interviews by address'")


SURVEY_SQL = f"""WITH {STATES}, p AS (SELECT * FROM s WHERE k % 7 <> 0 AND k % 11 <> 0) SELECT part, value, count(*) AS n FROM (
 SELECT 'outcome' AS part, CASE WHEN k % 11 = 0 THEN 'broken state' WHEN k % 7 = 0 THEN 'no content' ELSE 'parsed' END AS value FROM s
 UNION ALL SELECT 'entity', CASE WHEN k % 4 = 0 THEN '74' ELSE '8' END FROM p
 UNION ALL SELECT 'month', strftime(epoch_ms(posted), '%Y-%m') FROM p
 UNION ALL SELECT 'address', 'discuss' FROM p
 UNION ALL SELECT 'with official list', 'yes' FROM p WHERE k % 6 = 0) GROUP BY 1, 2"""


def _lists(spark: SparkSession, d: str) -> DataFrame:
    return listing.frequencies(b.questions(spark, d), b.occurrences(spark, d), b.posts(spark, d), Filter())


def _ranks(spark: SparkSession, d: str) -> DataFrame:
    return listing.list_ranks(_lists(spark, d)).select("rank", "question_id", "n")


def _unlabeled(counted: DataFrame) -> DataFrame:
    """Four of five questions lose their label."""
    return counted.withColumn("llm_cat", F.when(F.col("question_id") % 5 != 0, F.lit("")).otherwise(F.col("llm_cat")))


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return labels.candidates(_unlabeled(_lists(spark, d)))


def _modules(spark: SparkSession, d: str) -> DataFrame:
    return labels.module_report(_candidates(spark, d))


CANDIDATES = f"{STAR} SELECT id AS question_id, any_value(canonical) AS text, any_value(category) AS module, any_value(topic) AS topic, count(*) AS n FROM star WHERE {NOT_NOISE} AND id % 5 <> 0 GROUP BY id"


def _detail(spark: SparkSession, d: str) -> DataFrame:
    return listing.question_occurrences(b.occurrences(spark, d), b.posts(spark, d), 7).select("question_id", "post_id", "official", "raw_text", "company", "posted_at")


def _wordings(spark: SparkSession, d: str) -> DataFrame:
    return listing.question_variants(b.variants(spark, d), 7)


def _policy(spark: SparkSession, d: str) -> DataFrame:
    questions = b.questions(spark, d).withColumn("llm_cat", F.when(F.col("id") % 3 == 0, F.lit("")).otherwise(F.col("llm_cat")))
    flt = Filter(size=500).with_policy(has_labels(questions))
    return listing.question_list(questions, b.occurrences(spark, d), b.posts(spark, d), flt).select("question_id", "n")


def _chips(spark: SparkSession, d: str) -> DataFrame:
    return facets.chip_row(facets.post_facets(b.posts(spark, d), Filter()), "company", "NATION_3")


def _without(spark: SparkSession, d: str) -> DataFrame:
    gone = b.posts(spark, d).filter("id % 3 = 0").select("id")
    posts, occ = maintenance.without(b.posts(spark, d), b.occurrences(spark, d), gone)
    return posts.groupBy("company").agg(F.count(F.lit(1)).alias("posts")).join(
        occ.join(posts.select(F.col("id").alias("post_id"), "company"), "post_id").groupBy("company").agg(F.count(F.lit(1)).alias("occurrences")), "company"
    )


def _removed(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    gone = b.posts(spark, d).filter("id % 8 <> 0").select("id")
    return dedup.removed(b.posts(spark, d), b.occurrences(spark, d), b.questions(spark, d, False), gone)


def _after_removal(spark: SparkSession, d: str) -> DataFrame:
    return _removed(spark, d)["questions"].select("id", "n", "co_n")


def _removal_report(spark: SparkSession, d: str) -> DataFrame:
    return _removed(spark, d)["report"]


LEFT = f"{STAR}, keep AS (SELECT * FROM occ WHERE post_id % 8 = 0), left_over AS (SELECT id, n, co FROM questions JOIN (SELECT question_id, count(*) AS n, count(DISTINCT company) AS co FROM keep JOIN posts ON id = post_id GROUP BY 1) ON id = question_id)"


def _taxonomy_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("type "), F.min("p_type").over(Window.partitionBy("p_brand"))).alias("domain"), F.lit("").alias("description")).distinct()
    return labels.ordered_taxonomy(rows, {"small": ["Brand#1", "Brand#2"], "large": ["Brand#24"]}).select("name", "domain", "merged", "sort_order")


def _label_rows(d: DataFrame, cat: Column) -> DataFrame:
    return d.select(F.col("doc_id").cast("string").alias("norm"), cat.alias("cat"))


def _merged_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "labels")
    return labels.merged_labels(_label_rows(rows, F.concat(F.lit("quality "), F.col("quality"))), _label_rows(rows.filter("doc_id % 2 = 0"), F.concat(F.lit("toxic "), F.col("toxic"))))


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    cat = F.when(k % 7 == 0, R.NOISE).when(k % 5 == 0, "unheard of").otherwise(F.concat(F.lit("quality "), F.col("quality")))
    return b.table(spark, d, "labels").select((k % 20).alias("batch"), k.alias("id"), F.when(k % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("Doc "), k)).alias("text"), cat.alias("cat"))


def _load_report(spark: SparkSession, d: str) -> DataFrame:
    tax = spark.createDataFrame([("quality 0", "d"), ("quality 1", "d"), (R.NOISE, "e")], "name string, domain string")
    return labels.load_report(_assigned(spark, d), tax)


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    asked = b.table(spark, d, "labels").select((F.col("doc_id") % 20).alias("batch"), F.col("doc_id").alias("id"))
    return labels.coverage(asked, _assigned(spark, d).filter("NOT (batch % 4 = 1 AND id % 3 = 0) AND batch <> 5"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("参考答案："), F.replace("text", F.lit("\n"), F.lit("\n\n\n\n")))
    return b.table(spark, d, "documents").select("doc_id", F.sha1(F.encode(t.trim_answer(text), "UTF-8")).alias("answer_sha1"), t.is_meta_answer(F.col("text")).alias("meta"))


def answers_sql() -> str:
    short = sub(sub("'参考答案：' || replace(text, chr(10), repeat(chr(10), 4))", ENDS), R.ANSWER_PREFIX)
    body = sub(sub(short, "\n{3,}", "\n\n"), ENDS)
    head = f"left({sub('text', ENDS)}, 60)"
    meta = " OR ".join(f"regexp_matches({head}, {q(p)})" for p in (R.META_ANSWER, R.META_ANSWER_NEAR))
    cut = sub(f"left(a, {R.ANSWER_CAP})", ENDS)
    return f"""WITH a AS (SELECT doc_id, text, {body} AS a FROM documents)
SELECT doc_id, sha1(CASE WHEN length(a) > {R.ANSWER_CAP} THEN {cut} || '…' ELSE a END) AS answer_sha1, ({sub('text', ENDS)} = '' OR {meta}) AS meta FROM a"""


def name_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names of suppliers, parts and customers as lines; the same name stands in several posts."""
    s, p, c = (b.table(spark, d, x) for x in ("supplier", "part", "customer"))

    def rows(df: DataFrame, kind: int, key: str, text: str, cat: Column, official: Column, answer: Column) -> DataFrame:
        seq = F.struct(F.lit(kind).alias("kind"), F.col(key).cast("bigint").alias("k"))
        return df.select((F.col(key) % 40).cast("bigint").alias("post_id"), seq.alias("seq"), F.col(text).alias("text"), cat.alias("cat"), F.lit("t").alias("topic"), answer.alias("answer"), official.alias("official"))

    nothing = F.lit("")
    return (
        rows(s, 0, "s_suppkey", "s_name", F.lit("supplier"), F.col("s_acctbal") > 5000, F.when(F.col("s_suppkey") % 6 == 5, F.concat(F.lit("answer "), F.col("s_suppkey").cast("string"))).otherwise(nothing))
        .union(rows(p, 1, "p_partkey", "p_name", F.col("p_brand"), F.col("p_size") > 25, nothing))
        .union(rows(c.filter("c_custkey % 15 = 0"), 2, "c_custkey", "c_name", F.lit("customer"), F.lit(False), nothing))
    )


def _leaders(spark: SparkSession, d: str) -> DataFrame:
    """Keys in their order, and which earlier one each follows."""
    distinct = name_lines(spark, d).select(t.norm(F.col("text")).alias("key")).filter("key <> ''").distinct()
    keys = cluster.kept(maintenance.numbered(distinct, [F.col("key")]).select("key", F.col("number").alias("id")), "keys")
    led = cluster.like_followers(keys)
    names = keys.select(F.col("id").alias("leader"), F.col("key").alias("led_by"))
    return keys.join(led, keys["id"] == led["node"], "left").join(names, "leader", "left").select("key", F.coalesce("led_by", "key").alias("leader"))


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    built = cluster.build_questions(name_lines(spark, d))
    per = built["occurrences"].groupBy("question_id").agg(F.count(F.lit(1)).alias("occurrences"), F.count_if("official").alias("official_n"))
    more = built["variants"].groupBy("question_id").agg(F.count(F.lit(1)).alias("variants"))
    out = built["questions"].withColumnRenamed("id", "question_id").join(per, "question_id").join(more, "question_id", "left")
    return out.select(F.col("question_id").alias("id"), "canonical", "norm", "category", "topic", F.coalesce("answer", F.lit("")).alias("answer"), "n", "occurrences", "official_n", F.coalesce("variants", F.lit(0).cast("bigint")).alias("variants"))


def norm_sql(x: str) -> str:
    return f"lower({fillers_sql(sub(strip_sql(x), R.NON_WORD))})"


NAMES = f"""l0 AS (
 SELECT 0 AS kind, s_suppkey AS k, s_name AS text, 'supplier' AS cat, s_acctbal > 5000 AS official, CASE WHEN s_suppkey % 6 = 5 THEN 'answer ' || s_suppkey ELSE '' END AS answer FROM supplier
 UNION ALL SELECT 1, p_partkey, p_name, p_brand, p_size > 25, '' FROM part
 UNION ALL SELECT 2, c_custkey, c_name, 'customer', false, '' FROM customer WHERE c_custkey % 15 = 0),
l AS (SELECT *, k % 40 AS post_id, row_number() OVER (ORDER BY kind, k) - 1 AS number, {norm_sql('text')} AS key FROM l0)"""

#: Keys are scanned one after the other; ``leaders`` is the list of those that lead so far.
SCAN = """pair AS (
 SELECT a.id AS a, b.id AS b FROM keys a JOIN keys b ON a.id < b.id
 WHERE (abs(length(a.key) - length(b.key)) <= floor(length(b.key) * 18 / 100) AND levenshtein(a.key, b.key) * 100 <= 18 * greatest(length(a.key), length(b.key)))
  OR (least(length(a.key), length(b.key)) >= 6 AND greatest(length(a.key), length(b.key)) <= 2 * least(length(a.key), length(b.key)) AND (contains(a.key, b.key) OR contains(b.key, a.key)))),
near AS (SELECT place.place, keys.id, coalesce(list(pair.a ORDER BY pair.a) FILTER (pair.a IS NOT NULL), []) AS before
 FROM keys JOIN (SELECT id, row_number() OVER (ORDER BY id) AS place FROM keys) place ON place.id = keys.id LEFT JOIN pair ON pair.b = keys.id GROUP BY 1, 2),
scan AS (
 SELECT CAST(0 AS BIGINT) AS place, CAST(-1 AS BIGINT) AS id, CAST(-1 AS BIGINT) AS leader, CAST([] AS BIGINT[]) AS leaders
 UNION ALL
 SELECT near.place, near.id, coalesce(list_min(list_intersect(before, leaders)), near.id),
  CASE WHEN len(list_intersect(before, leaders)) = 0 THEN list_append(leaders, near.id) ELSE leaders END
 FROM scan JOIN near ON near.place = scan.place + 1),
led AS (SELECT id, leader FROM scan WHERE place > 0)"""

LEADERS_SQL = f"""WITH RECURSIVE {NAMES}, keys AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS id FROM (SELECT DISTINCT key FROM l WHERE key <> '')), {SCAN}
SELECT k.key, m.key AS leader FROM led JOIN keys k ON k.id = led.id JOIN keys m ON m.id = led.leader"""

CLUSTERS_SQL = f"""WITH RECURSIVE {NAMES}, keys AS (SELECT key, min(number) AS id FROM l GROUP BY key), {SCAN},
placed AS (SELECT l.*, led.leader AS cluster FROM l JOIN keys ON keys.key = l.key JOIN led ON led.id = keys.id),
c AS (SELECT cluster, arg_max(text, (official, length(text), -number)) AS canonical, arg_min(cat, number) AS category, coalesce(arg_min(answer, number) FILTER (answer <> ''), '') AS answer, count(DISTINCT post_id) AS n FROM placed GROUP BY cluster),
q AS (SELECT *, {norm_sql('canonical')} AS norm, row_number() OVER (ORDER BY n DESC, length(canonical), cluster) AS id FROM c),
o AS (SELECT cluster, post_id, arg_min(official, number) AS official FROM placed GROUP BY 1, 2)
SELECT id, canonical, norm, category, 't' AS topic, answer, n, (SELECT count(*) FROM o WHERE o.cluster = q.cluster) AS occurrences, (SELECT count(*) FROM o WHERE o.cluster = q.cluster AND official) AS official_n,
 (SELECT count(DISTINCT text) FROM placed p WHERE p.cluster = q.cluster AND p.text <> q.canonical) AS variants FROM q"""



def _known(spark: SparkSession, d: str) -> DataFrame:
    """Words of part and nation names found in the first lines of documents and in the parts' names."""
    part, nation = b.table(spark, d, "part"), b.table(spark, d, "nation")
    names = part.select(F.explode(F.split("p_name", " ")).alias("name")).union(nation.select("n_name")).union(part.select("p_name")).distinct()
    heads = b.table(spark, d, "documents").select(F.substring_index("text", "\n", 1).alias("title"))
    titles = heads.union(part.select(F.concat_ws(" ", "p_brand", "p_name", "p_type"))).union(nation.select(F.concat(F.lit("x"), "n_name"))).distinct()
    return ti.known_companies(titles.select(F.col("title").alias("key"), "title"), names).select(F.sha1(F.encode("key", "UTF-8")).alias("title_sha1"), "known")


KNOWN_SQL = f"""WITH n AS (SELECT lower(name) AS low, min(name) AS name FROM (SELECT unnest(string_split(p_name, ' ')) AS name FROM part UNION SELECT n_name FROM nation UNION SELECT p_name FROM part)
 WHERE length(name) BETWEEN 2 AND 14 AND NOT {m('name', R.COMPANY_NOISE)} AND NOT {m('name', R.COMPANY_PUNCTUATION)} AND {m('name', '[a-zA-Z0-9]')} GROUP BY 1),
t AS (SELECT string_split(text, chr(10))[1] AS title FROM documents UNION SELECT p_brand || ' ' || p_name || ' ' || p_type FROM part UNION SELECT 'x' || n_name FROM nation),
h AS (SELECT title, name, lower(title) AS whole, low, instr(lower(title), low) AS at FROM t JOIN n ON contains(lower(title), low))
SELECT sha1(title) AS title_sha1, arg_min(name, (-octet_length(encode(name)), name)) AS known FROM h
WHERE NOT regexp_matches((CASE WHEN h.at > 1 THEN substring(whole, h.at - 1, 1) ELSE ' ' END) || ' ' || substring(whole, h.at + length(low), 1), '[a-z0-9]') GROUP BY title"""

QUERIES = {
    "known_companies": (_known, KNOWN_SQL),
    "page_posts": (_page_posts, page_posts_sql()),
    "content_pages": (
        _content_pages,
        "SELECT doc_id AS page_id, doc_id % 7 <> 0 AND doc_id % 11 <> 0 AS is_content, doc_id % 2 = 0 AS is_address, CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 <> 0 THEN source END AS author FROM documents",
    ),
    "page_survey": (_survey, SURVEY_SQL),
    "list_ranks": (_ranks, f"{STAR} SELECT row_number() OVER (ORDER BY n DESC, size, question_id) AS rank, question_id, n FROM (SELECT id AS question_id, count(*) AS n, length(any_value(canonical)) AS size FROM star WHERE {NOT_NOISE} GROUP BY id) ORDER BY rank LIMIT 100"),
    "label_candidates": (_candidates, CANDIDATES),
    "module_report": (_modules, f"SELECT module, count(*) AS n FROM ({CANDIDATES}) GROUP BY module"),
    "question_occurrences": (_detail, f"{STAR} SELECT question_id, post_id, official = 1 AS official, raw_text, company, posted_at FROM occ JOIN posts ON id = post_id WHERE question_id = 7"),
    "question_variants": (_wordings, f"{STAR} SELECT question_id, text FROM variants WHERE question_id = 7"),
    "list_policy": (_policy, f"{STAR} SELECT id AS question_id, count(*) AS n FROM star WHERE {NOT_NOISE} AND id % 3 <> 0 GROUP BY id ORDER BY {BY_N} LIMIT 500"),
    "chip_row": (_chips, f"{STAR}, r AS (SELECT 'company' AS dim, company AS value, count(*) AS count, row_number() OVER (ORDER BY count(*) DESC, company) AS rank FROM posts GROUP BY company) SELECT * FROM r WHERE rank <= 16 OR value = 'NATION_3'"),
    "delete_posts": (_without, f"{STAR} SELECT company, count(DISTINCT posts.id) AS posts, count(question_id) AS occurrences FROM posts LEFT JOIN occ ON post_id = posts.id WHERE posts.id % 3 <> 0 GROUP BY company"),
    "questions_after_removal": (_after_removal, f"{LEFT} SELECT id, n, co AS co_n FROM left_over"),
    "removal_report": (
        _removal_report,
        f"""{LEFT} SELECT 'posts' AS what, count(*) FILTER (id % 8 <> 0) AS gone, count(*) FILTER (id % 8 = 0) AS "left" FROM posts
UNION ALL SELECT 'occurrences', count(*) FILTER (post_id % 8 <> 0), count(*) FILTER (post_id % 8 = 0) FROM occ
UNION ALL SELECT 'questions', (SELECT count(*) FROM questions) - count(*), count(*) FROM left_over""",
    ),
    "taxonomy_rows": (
        _taxonomy_rows,
        "SELECT p_brand AS name, 'type ' || min(p_type) AS domain, CASE WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'small' WHEN p_brand = 'Brand#24' THEN 'large' ELSE p_brand END AS merged, row_number() OVER (ORDER BY 'type ' || min(p_type), p_brand) - 1 AS sort_order FROM part GROUP BY p_brand",
    ),
    "merged_labels": (_merged_labels, "SELECT CAST(doc_id AS VARCHAR) AS norm, CASE WHEN doc_id % 2 = 0 THEN 'toxic ' || toxic ELSE 'quality ' || quality END AS cat FROM labels"),
    "label_load": (
        _load_report,
        "SELECT count(*) AS assigned, count(*) FILTER (doc_id % 3 = 0) AS without_text, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 <> 0 AND doc_id % 5 = 0) AS unknown,"
        " count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 7 = 0) AS noise, count(*) FILTER (doc_id % 3 <> 0 AND (doc_id % 7 = 0 OR doc_id % 5 <> 0)) AS norms FROM labels",
    ),
    "label_coverage": (
        _coverage,
        "SELECT b AS batch, count(*) AS asked, count(*) FILTER (got) AS answered, count(*) = count(*) FILTER (got) AS whole FROM (SELECT doc_id % 20 AS b, NOT (doc_id % 20 % 4 = 1 AND doc_id % 3 = 0) AND doc_id % 20 <> 5 AS got FROM labels) GROUP BY b",
    ),
    "text_answers": (_answers, answers_sql()),
    "key_leaders": (_leaders, LEADERS_SQL),
    "cluster_names": (_clusters, CLUSTERS_SQL),
}
