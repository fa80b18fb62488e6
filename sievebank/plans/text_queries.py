"""Queries over texts, titles, pages, clusters and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import regex, rules as R, text as t, titles as ti
from ..operators import cluster, dedup, extract, facets, labels, listing
from ..operators.filters import Filter
from ..sources import pages as pg, snapshot as sn
from ..streaming.ingest import counts_by_time
from . import bindings as b
from .fixtures import CONTENTS, LINES, TITLES, values_sql

ENDS = r"^[\s\p{Z}\x{85}]+|[\s\p{Z}\x{85}]+$"


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def m(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {q(pattern)})"


def sub(x: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(by)}, 'g')"


def chain(x: str, table, default: str) -> str:
    whens = " ".join(f"WHEN {m(x, p)} THEN {q(v)}" for v, p in table)
    return f"CASE {whens} ELSE {default} END"


def strip_sql(x: str) -> str:
    out = "CASE"
    for p in R.LABELS:
        rest = f"regexp_replace({sub(x, p)}, '^[ \\t]+', '')"
        out += f" WHEN {m(x, p)} THEN CASE WHEN {rest} = '' OR {m(rest, '^[0-9]')} THEN {x} ELSE {rest} END"
    return f"{out} ELSE {x} END"


def fillers_sql(x: str) -> str:
    for w in R.FILLERS:
        x = f"replace({x}, '{w}', '')"
    return x


ALL_LINES = f"SELECT DISTINCT unnest(string_split(text, chr(10))) AS s FROM documents UNION {values_sql(LINES)}"
ALL_TITLES = values_sql(TITLES)


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Distinct lines of all documents, and the domain's own."""
    own = spark.createDataFrame([(x,) for x in LINES], "s string")
    return b.table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("s")).union(own).distinct()


def _norm(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("s", t.norm(F.col("s")).alias("norm"), t.normal_title(F.col("s")).alias("title_key"))


def _clean(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return lines(spark, d).select("s", t.clean_text(s).alias("clean"), t.strip_formatting(s).alias("plain"), t.strip_label(s).alias("unlabeled"), t.display_text(s).alias("shown"))


def _question(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    out = lines(spark, d).select("s", t.is_question(s).alias("is_question"), t.classify(s).alias("cat"))
    return out.withColumn("topic", t.topic_of(s, F.col("cat"))).withColumn("knowledge", t.is_knowledge(F.col("cat")))


def question_sql() -> str:
    n, asking = "length(s)", m(sub("s", R.URL, " "), R.ASKING)
    never = f"{n} <= 5 OR starts_with(s, '（') OR starts_with(s, '(') OR {m('s', R.POST_TITLE)} OR {m('s', R.SOLICIT)} OR NOT {m('s', R.HAS_WORD)} OR ({m('s', R.ALGO_LEAD)} AND {m('s', R.ALGO_REMARK)})"
    soft = [m("s", R.OUTCOME)] + [f"({m('s', p)} AND {n} < {k})" for p, k in ((R.STRONG_REMARK, 32), (R.META_REMARK, 34), (R.COMPLAINT, 95), (R.OUTCOME_AT_END, 40))]
    soft += [f"({n} > 50 AND {m('s', R.NARRATIVE)})"] + [m("s", p) for p in (R.RECRUIT_LINE, R.TAG_LINE, R.TEACHING, R.HAS_URL, R.CODE_WORD, R.NOTE, R.SHORT_NUMBERED)]
    soft += [f"({n} > 30 AND ({m('s', R.GUIDE)} OR {m('s', R.FIRST_PERSON)}))", f"({n} > 30 AND {m('s', R.JOB_PROCESS)} AND {m('s', R.SELF)} AND NOT {m('s', R.QUESTION_PHRASE)})", f"({n} > 20 AND {m('s', R.CODE)})"]
    algo = f"({m('s', R.ALGO_START)} OR {m('s', R.ALGO_NAME)}) AND NOT {m('s', R.ALGO_REMARK)}"
    cat = f"CASE WHEN {algo} THEN {q(R.ALGO)} ELSE {chain('s', R.MODULES, q(R.BACKEND))} END"
    topics = " ".join(f"WHEN {q(c)} THEN {q(x)}" for c, x in R.FIXED_TOPICS) + " " + " ".join(f"WHEN {q(c)} THEN {chain('s', table, q(R.OTHER_TOPIC))}" for c, table in R.TOPICS.items())
    return f"""WITH l AS ({ALL_LINES}), c AS (SELECT s, NOT ({never} OR (NOT {asking} AND ({' OR '.join(soft)}))) AS is_question, {cat} AS cat FROM l)
SELECT s, is_question, cat, CASE cat {topics} ELSE {q(R.OTHER_TOPIC)} END AS topic, cat <> {q(R.INTRO)} AS knowledge FROM c"""


def clean_sql() -> str:
    x = "s"
    for p in (R.IMAGE, R.CARD, R.EMOJI, R.TAG):
        x = sub(x, p)
    for a, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{c}')"
    plain = sub("s", R.MARKDOWN)
    for p in (R.TAGS_IN_FRONT, R.BOLD):
        plain = sub(plain, p)
    shown = sub(sub("unlabeled", R.ARROW), ENDS)
    shown = f"replace({shown}, '　', ' ')"
    shown = sub(shown, r"[\x00-\x08\x0A-\x1F\x{200b}\x{200c}\x{feff}\x{2060}\x{00ad}]")
    shown = sub(sub(shown, r"[\s\p{Z}\x{85}]+", " "), ENDS)
    return f"WITH l AS ({ALL_LINES}), u AS (SELECT s, {sub(x, ENDS)} AS clean, {sub(plain, ENDS)} AS plain, {strip_sql('s')} AS unlabeled FROM l) SELECT *, {shown} AS shown FROM u"


NORM_SQL = f"WITH l AS ({ALL_LINES}), u AS (SELECT s, {strip_sql('s')} AS u FROM l) SELECT s, lower({fillers_sql(sub('u', R.NON_WORD))}) AS norm, lower({sub('s', R.NON_WORD)}) AS title_key FROM u"


def _split(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    return lines(spark, d).select("s", F.array_join(t.split_inline(s), "|").alias("inline"), F.array_join(t.split_compound(s), "|").alias("compound"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in TITLES], "s string")


def _rounds(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s")
    out = titles(spark, d).select("s", ti.round_of(s).alias("round"), ti.job_of(s).alias("job"))
    return out.withColumns({"round_group": ti.round_group(F.col("round")), "job_group": ti.job_group(F.col("job")), "interview": t.is_interview_post(F.lit(""), s)})


ROUND_SQL = f"""WITH l AS ({ALL_TITLES}), r AS (SELECT s, {chain('s', R.ROUNDS, "''")} AS round, {chain('s', R.JOBS, "''")} AS job FROM l)
SELECT s, round, job, CASE WHEN contains(lower(round), 'hr') THEN 'HR 面' WHEN contains(round, '复活赛') THEN '复活赛' WHEN round IN ('一面', '二面', '') THEN round ELSE '三面及以上' END AS round_group,
 CASE WHEN contains(lower(job), 'agent') THEN 'Agent 开发' WHEN contains(job, '全栈') THEN '全栈开发' WHEN contains(job, '数据') THEN '数据平台'
 WHEN contains(lower(job), 'infra') OR contains(job, '平台') OR contains(job, '基础') THEN '平台/Infra' WHEN {m('job', '(?i)ai|算法|大模型')} THEN 'AI/算法'
 WHEN {m('job', '(?i)c[+][+]|cpp')} THEN 'C++' WHEN {m('job', chr(92) + 'bgo' + chr(92) + 'b|golang')} THEN 'Go' ELSE '其他' END AS job_group, {m('s', R.INTERVIEW_TITLE)} AS interview FROM r"""


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return titles(spark, d).select("s", ti.parse_title(F.col("s")).alias("p")).select("s", "p.*")


def _headings(spark: SparkSession, d: str) -> DataFrame:
    own = spark.createDataFrame([(x,) for x in CONTENTS], "s string")
    return own.union(b.table(spark, d, "documents").select("text")).select("s", ti.round_from_content(F.col("s")).alias("round")).distinct()


def _gates(spark: SparkSession, d: str) -> DataFrame:
    title, text = F.substring_index("text", "\n", 1), F.col("text")
    rows = b.table(spark, d, "documents").select("doc_id", title.alias("title"), text.alias("content"))
    own = spark.createDataFrame([(-k - 1, x, "面经 一面 自我介绍 反问 内推码") for k, x in enumerate(TITLES)], "doc_id long, title string, content string")
    a, c = F.col("title"), F.col("content")
    return rows.union(own).select("doc_id", pg.is_recruit_ad(a, c).alias("is_ad"), pg.interview_score(a, c).cast("long").alias("score"), pg.looks_like_interview(a, c).alias("passes"))


def gates_sql() -> str:
    own = ", ".join(f"({-k - 1}, {q(x)}, '面经 一面 自我介绍 反问 内推码')" for k, x in enumerate(TITLES))
    hits = lambda x, p: f"len(regexp_extract_all({x}, {q(p)}))"
    return f"""WITH r AS (SELECT doc_id, string_split(text, chr(10))[1] AS title, text AS content FROM documents UNION ALL SELECT * FROM (VALUES {own}) v(doc_id, title, content)),
g AS (SELECT *, {m("title || chr(10) || content", R.AD_WORD)} AND {hits("title || chr(10) || content", R.INTERVIEW_SIGNAL)} < 2 AS is_ad,
 CASE WHEN {m('title', R.INTERVIEW_WORD)} THEN 10 ELSE 0 END + CASE WHEN {m('trim(title)', R.STRICT_TITLE)} THEN 8 ELSE 0 END + {hits('content', R.INTERVIEW_WORD)} AS score FROM r)
SELECT doc_id, is_ad, score, NOT (title = '' AND content = '') AND NOT {m('title', R.EXCLUDED_TITLE)} AND NOT is_ad AND ({m('title', R.INTERVIEW_WORD)} OR score >= 4) AS passes FROM g"""


def _page_text(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return b.table(spark, d, "pages").select("page_id", F.sha1(F.encode(pg.html_to_text(html), "UTF-8")).alias("text_sha1"), pg.page_title(html).alias("title"), pg.is_content_page(html).alias("is_content"))


def page_text_sql() -> str:
    x = sub(sub("html", R.BREAKS, "\n"), R.TAG)
    for a, c in R.ENTITIES:
        x = f"replace({x}, '{a}', {q(c)})"
    x = f"array_to_string(list_transform(string_split({x}, chr(10)), lambda y: {sub('y', ENDS)}), chr(10))"
    x = sub(sub(x, "\n{3,}", "\n\n"), ENDS)
    return f"SELECT page_id, sha1({x}) AS text_sha1, {sub('regexp_extract(html, ' + q('(?is)<title[^>]*>(.*?)</title>') + ', 1)', ENDS)} AS title, false AS is_content FROM pages"


def _page_keys(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return b.table(spark, d, "pages").select("page_id", sn.page_key(url).alias("key"), sn.shard_of(url, 3).cast("long").alias("shard"), F.substring_index(url, "?", 1).alias("bare"), pg.absolute_url(F.lit("/x"), "https://example.org").alias("absolute"))


def _queue(spark: SparkSession, d: str) -> DataFrame:
    urls = b.table(spark, d, "pages").select("page_id", "url")
    return sn.queue(urls.select("url").distinct(), urls.filter("page_id % 2 = 0"), 1, 3).select("url")


SHARD = "(CAST('0x' || substring(sha1(url), 1, 16) AS UBIGINT) % 3)"


def _posts(spark: SparkSession) -> DataFrame:
    """Posts of the domain, written as pages with an embedded state and read back."""
    rows = []
    for k, title in enumerate(TITLES):
        body = "<br>".join(LINES[3 * k : 3 * k + 9]).replace('"', "'")
        state = '{"prefetchData":{"2":{"ssrCommonData":{"contentData":{"id":%d,"uuid":"u%d","title":"%s","content":"%s","createdAt":%d},"experienceQuestionList":[{"id":%d,"title":"介绍一下 GMP 模型","answer":"- 正确答案：G 是 goroutine"}]}}}}' % (k + 1, k + 1, title, body, 1767225600000 + 86400000 * k, k)
        rows.append((k + 1, f"https://example.org/discuss/{k + 1}?x=1", f"<html><script>window.__INITIAL_STATE__={state};</script></html>"))
    return pg.posts_of(spark.createDataFrame(rows, sn.PAGES))


def _ingest(spark: SparkSession, d: str) -> DataFrame:
    return _posts(spark).select("id", "url", "company", "job_group", "round", "round_group", F.date_format("posted_date", "yyyy-MM-dd").alias("day"), F.length("content").alias("size"))


def _extract(spark: SparkSession, d: str) -> DataFrame:
    return extract.lines_of(_posts(spark)).select("post_id", "text", "cat", "topic", "answer", "official")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return cluster.build_questions(extract.lines_of(_posts(spark)))["questions"].select("id", "canonical", "norm", "category", "topic", "n")


def _part_keys(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "supplier").select(F.lower("s_name").alias("key")).union(b.table(spark, d, "nation").select(F.lower("n_name"))).union(b.table(spark, d, "part").select(F.lower("p_name"))).groupBy("key").agg(F.xxhash64("key").alias("id"))


def _like(spark: SparkSession, d: str) -> DataFrame:
    found = cluster.like_keys(_part_keys(spark, d), symmetric=True)
    return found.select(F.least("ka", "kb").alias("first"), F.greatest("ka", "kb").alias("second"))


LIKE_SQL = """WITH k AS (SELECT DISTINCT lower(s_name) AS key FROM supplier UNION SELECT DISTINCT lower(n_name) FROM nation UNION SELECT DISTINCT lower(p_name) FROM part)
SELECT a.key AS first, b.key AS second FROM k a JOIN k b ON a.key < b.key
WHERE (abs(length(a.key) - length(b.key)) * 100 <= 18 * greatest(length(a.key), length(b.key)) AND levenshtein(a.key, b.key) * 100 <= 18 * greatest(length(a.key), length(b.key)))
 OR (least(length(a.key), length(b.key)) >= 6 AND greatest(length(a.key), length(b.key)) <= 2 * least(length(a.key), length(b.key)) AND (contains(a.key, b.key) OR contains(b.key, a.key)))"""


def _reposts(spark: SparkSession, d: str) -> DataFrame:
    docs = b.table(spark, d, "documents")
    sets = docs.select(F.col("doc_id").alias("post_id"), F.explode(F.split("text", "\n")).alias("s")).filter("s <> ''").select("post_id", F.xxhash64("s").alias("question_id")).distinct()
    title = t.normal_title(F.substring_index("text", "\n", 1))
    # first lines may be long, and titles go with each question: equal ones have equal digests
    heads = docs.select(F.col("doc_id").alias("post_id"), F.when(title == "", "").otherwise(F.sha2(title, 256)).alias("title"))
    return dedup.duplicate_posts(sets, heads)


def _labeled(spark: SparkSession, d: str) -> DataFrame:
    lab = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("norm"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("cat"))
    tax = spark.createDataFrame([("quality 1", "quality", "good")], "name string, domain string, merged string")
    docs = b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").cast("string").alias("norm"))
    return labels.labeled(docs, lab, tax).select("id", "llm_cat", "llm_domain", "llm_merged")


def _label_stats(spark: SparkSession, d: str) -> DataFrame:
    lab = b.table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("norm"), F.lit("x").alias("cat"))
    return labels.label_stats(_labeled(spark, d), lab)


def _precision(spark: SparkSession, d: str) -> DataFrame:
    rows = b.table(spark, d, "documents").join(b.table(spark, d, "labels"), "doc_id").select("text", (F.col("quality") == 0).alias("noise"))
    return labels.rule_precision(rows, RULES)


RULES = {"shout": "!!", "la": r"(?i)\bla\b", "mail": "@", "bar": r"\|"}


def _windows(spark: SparkSession, d: str) -> DataFrame:
    out = counts_by_time(b.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def splits_sql() -> str:
    inline = f"list_filter(list_transform(string_split(regexp_replace(s, '([？?])', '\\1' || chr(1), 'g'), chr(1)), lambda x: {sub('x', ENDS)}), lambda x: x <> '')"
    cut = lambda x, p: f"regexp_split_to_array({x}, {q(p)})"
    parts = f"list_filter(list_transform(flatten(list_transform({cut('body', R.COMPOUND)}, lambda x: {cut('x', R.COMMAS)})), lambda x: {sub('x', ENDS)}), lambda x: x <> '')"
    prefix = sub(sub("lead", ENDS), "[：:、 \t]+$")
    return f"""WITH l AS ({ALL_LINES}), a AS (SELECT s, regexp_extract(s, {q(R.ALGO_LEAD)}) AS lead FROM l),
b AS (SELECT s, lead, {inline} AS several, {sub("substring(s, length(lead) + 1)", ENDS)} AS body FROM a), c AS (SELECT *, {parts} AS parts, {prefix} AS prefix FROM b)
SELECT s, CASE WHEN length(s) > 40 AND len(regexp_extract_all(s, '[？?]')) >= 2 AND len(several) > 1 THEN array_to_string(several, '|') ELSE s END AS inline,
 CASE WHEN lead <> '' AND len(parts) > 1 AND len(list_filter(parts, lambda x: length(x) < 2)) = 0 THEN array_to_string(list_transform(parts, lambda x: prefix || '：' || x), '|') ELSE s END AS compound FROM c"""


def headings_sql() -> str:
    table = tuple((name, pattern) for _, name, pattern in R.HEADINGS)
    lines = f"list_filter(list_transform(string_split(s, chr(10)), lambda x: {sub(sub('x', R.HEADING_LEAD), ENDS)}), lambda x: x <> '' AND length(x) <= 24)"
    chained = chain("x", table, "''")
    names = f"list_distinct(list_filter(list_transform({lines}, lambda x: {chained}), lambda x: x <> ''))"
    return f"WITH l AS ({values_sql(CONTENTS)} UNION SELECT text FROM documents), n AS (SELECT s, {names} AS names FROM l) SELECT s, CASE WHEN len(names) = 1 THEN names[1] ELSE '' END AS round FROM n"


def scan_sql(name: str, posts: str, pairs: str) -> str:
    """One scan in the order of ids: a post goes if one that stays before it is like it."""
    return f"""{name}_near AS (SELECT p.place, p.id, coalesce(list(x.a) FILTER (x.a IS NOT NULL), []) AS before
 FROM (SELECT id, row_number() OVER (ORDER BY id) AS place FROM {posts}) p LEFT JOIN {pairs} x ON x.b = p.id GROUP BY 1, 2),
{name}_scan AS (SELECT CAST(0 AS BIGINT) AS place, CAST(NULL AS BIGINT) AS id, false AS gone, CAST([] AS BIGINT[]) AS kept
 UNION ALL SELECT n.place, n.id, len(list_intersect(before, kept)) > 0, CASE WHEN len(list_intersect(before, kept)) > 0 THEN kept ELSE list_append(kept, n.id) END
 FROM {name}_scan s JOIN {name}_near n ON n.place = s.place + 1)"""


REPOSTS_SQL = f"""WITH RECURSIVE s AS (SELECT DISTINCT doc_id AS id, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) WHERE s <> ''),
t AS (SELECT doc_id AS id, lower({sub("string_split(text, chr(10))[1]", R.NON_WORD)}) AS title FROM documents),
n AS (SELECT s.id, title, count(*) AS n FROM s JOIN t ON t.id = s.id GROUP BY 1, 2),
c AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
j AS (SELECT a, b, c / (m.n + k.n - c) AS jaccard, m.title = k.title AND m.title <> '' AS same, least(m.n, k.n) AS least FROM c JOIN n m ON m.id = a JOIN n k ON k.id = b),
one_pairs AS (SELECT a, b FROM j WHERE same AND jaccard >= 0.8), {scan_sql("one", "n", "one_pairs")},
rest AS (SELECT id FROM one_scan WHERE place > 0 AND NOT gone),
two_pairs AS (SELECT a, b FROM j WHERE least >= 8 AND jaccard >= 0.9 AND a IN (SELECT id FROM rest) AND b IN (SELECT id FROM rest)), {scan_sql("two", "rest", "two_pairs")}
SELECT id FROM one_scan WHERE gone UNION ALL SELECT id FROM two_scan WHERE gone"""

QUERIES = {
    "text_norm": (_norm, NORM_SQL),
    "text_clean": (_clean, clean_sql()),
    "text_questions": (_question, question_sql()),
    "text_splits": (_split, splits_sql()),
    "title_rounds_jobs": (_rounds, ROUND_SQL),
    "title_parse": (_parsed, None),
    "title_from_content": (_headings, headings_sql()),
    "post_gates": (_gates, gates_sql()),
    "page_text": (_page_text, page_text_sql()),
    "page_keys": (_page_keys, f"SELECT page_id, substring(sha1(url), 1, 20) AS key, CAST({SHARD} AS BIGINT) AS shard, string_split(url, '?')[1] AS bare, 'https://example.org/x' AS absolute FROM pages"),
    "crawl_queue": (_queue, f"SELECT DISTINCT url FROM pages WHERE {SHARD} = 1 AND url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)"),
    "ingest_posts": (_ingest, None),
    "extract_lines": (_extract, None),
    "cluster_questions": (_clusters, None),
    "like_pairs": (_like, LIKE_SQL),
    "reposts": (_reposts, REPOSTS_SQL),
    "label_join": (_labeled, "SELECT d.doc_id AS id, CASE WHEN quality = 1 THEN 'quality 1' ELSE '' END AS llm_cat, CASE WHEN quality = 1 THEN 'quality' ELSE '' END AS llm_domain, CASE WHEN quality = 1 THEN 'good' ELSE '' END AS llm_merged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"),
    "label_stats": (_label_stats, "SELECT (SELECT count(*) FROM labels) AS labels, (SELECT count(*) FROM labels JOIN documents USING (doc_id) WHERE quality = 1) AS applied"),
    "rule_precision": (
        _precision,
        "WITH r AS (SELECT text, quality = 0 AS noise FROM documents JOIN labels USING (doc_id)), h AS ("
        + " UNION ALL ".join(f"SELECT {q(k)} AS rule, {m('text', p)} AS hit, noise FROM r" for k, p in RULES.items())
        + ") SELECT rule, count(*) FILTER (hit) AS hits, count(*) FILTER (hit AND noise) AS noise_hits, round(count(*) FILTER (hit AND noise) / nullif(count(*) FILTER (hit), 0), 6) AS precision,"
        " round(count(*) FILTER (hit AND noise) / nullif(count(*) FILTER (noise), 0), 6) AS coverage FROM h GROUP BY rule",
    ),
    "events_by_day": (_windows, "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
}
