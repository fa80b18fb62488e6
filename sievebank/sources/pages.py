"""From raw pages to posts: embedded state, content fields, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import rules as R
from ..functions.regex import count, found, group, replaced, trim
from ..functions.titles import COMPANIES, job_group, parse_title, round_from_content, round_group, strict

MARKER = "window.__INITIAL_STATE__="
CONTENT = "$.prefetchData.2.ssrCommonData.contentData"
QUESTIONS = "$.prefetchData.2.ssrCommonData.experienceQuestionList"
#: The content's fields as text, whatever their kind in the page; numbers are cast afterwards.
FIELDS = (
    "uuid string, id string, title string, content string, createdAt string, createTime string, editTime string, entityType string, ip4Location string,"
    " userBrief struct<userId:string,nickname:string>, frequencyData struct<likeCnt:string,totalCommentCnt:string,viewCnt:string>"
)


def state_json(html: Column) -> Column:
    """The page's embedded state as JSON text; null without a marker, an object or its end.

    Spark's JSON parser stops at the end of the first value, so no braces are counted here.
    """
    at = F.locate(MARKER, html)
    rest = F.ltrim(F.substring(html, at + len(MARKER), F.length(html)))
    return F.when((at > 0) & rest.startswith("{"), F.get_json_object(rest, "$"))


def dig(state: Column, path: str) -> Column:
    return F.get_json_object(state, path)


def text_at(state: Column, name: str) -> Column:
    return F.coalesce(dig(state, f"{CONTENT}.{name}"), F.lit(""))


def number_at(state: Column, name: str) -> Column:
    return F.coalesce(dig(state, f"{CONTENT}.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))


def first_time(*times: Column) -> Column:
    """The first of several times that is there; 0 stands for none."""
    return F.coalesce(*[F.when(t != 0, t) for t in times], F.lit(0).cast("bigint"))


def html_to_text(html: Column) -> Column:
    """Text of HTML: breaks become newlines, tags go, six entities are resolved in their order."""
    text = replaced(replaced(html, R.BREAKS, "\n"), R.TAG)
    for entity, by in R.ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(by))
    text = F.array_join(F.transform(F.split(text, "\n"), trim), "\n")
    return trim(F.regexp_replace(text, "\n{3,}", "\n\n"))


def page_title(html: Column) -> Column:
    return trim(group(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def topic_tag(html: Column) -> Column:
    return group(html, R.TOPIC_LINK, 1)


def is_content_page(html: Column) -> Column:
    """Whether the state parses and its content has a uuid or an id."""
    state = state_json(html)
    return F.coalesce(dig(state, CONTENT).startswith("{") & ((text_at(state, "uuid") != "") | (number_at(state, "id") != 0)), F.lit(False))


def is_content_url(url: Column, site: str) -> Column:
    import re

    return url.rlike(f"^{re.escape(site)}/(feed/main/detail/[0-9a-f]+|discuss/[0-9]+)")


def canonical_url(url: Column, uuid: Column, site: str) -> Column:
    bare = F.substring_index(url, "?", 1)
    return F.when(is_content_url(bare, site), bare).otherwise(F.concat(F.lit(f"{site}/feed/main/detail/"), uuid))


def absolute_url(path: Column, site: str) -> Column:
    return F.when(path.rlike("^[a-z]+:"), path).otherwise(F.concat(F.lit(site), path))


def fallback_id(url: Column) -> Column:
    """A positive number that stands for an address without an id."""
    return F.xxhash64(url).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF).cast("bigint"))


def is_recruit_ad(title: Column, content: Column) -> Column:
    """A strong word of advertising and fewer than two signs of an interview."""
    text = F.concat(title, F.lit("\n"), content)
    return found(text, R.AD_WORD) & (count(text, R.INTERVIEW_SIGNAL) < 2)


def interview_score(title: Column, content: Column) -> Column:
    return (
        F.when(found(title, R.INTERVIEW_WORD), 10).otherwise(0)
        + F.when(strict(title)[2] != "", 8).otherwise(0)
        + count(content, R.INTERVIEW_WORD)
    )


def looks_like_interview(title: Column, content: Column) -> Column:
    empty = (title == "") & (content == "")
    named = found(title, R.INTERVIEW_WORD)
    return ~empty & ~found(title, R.EXCLUDED_TITLE) & ~is_recruit_ad(title, content) & (named | (interview_score(title, content) >= 4))


def posts_of(pages: DataFrame, site: str = "https://example.org", companies: tuple[str, ...] | list[str] = COMPANIES, gated: bool = True) -> DataFrame:
    """Posts of content pages, with company, job and round; advertising and other noise left out.

    The content is parsed once, all its fields together.
    """
    state = state_json(F.col("html"))
    rows = pages.select("url", state.alias("state")).filter(F.col("state").isNotNull())
    rows = rows.select("url", F.from_json(dig(F.col("state"), CONTENT), FIELDS).alias("c"), dig(F.col("state"), QUESTIONS).alias("official_q"))

    def words(name: str) -> Column:
        return F.coalesce(F.col(f"c.{name}"), F.lit(""))

    def number(name: str) -> Column:
        return F.coalesce(F.col(f"c.{name}").try_cast("bigint"), F.lit(0).cast("bigint"))

    rows = rows.select(
        "url",
        words("uuid").alias("uuid"),
        number("id").alias("own_id"),
        trim(words("title")).alias("title"),
        words("content").alias("html"),
        html_to_text(words("content")).alias("content"),
        first_time(number("createdAt"), number("createTime"), number("editTime")).alias("posted_at"),
        number("entityType").cast("int").alias("entity_type"),
        words("ip4Location").alias("location"),
        number("userBrief.userId").alias("author_id"),
        words("userBrief.nickname").alias("author_name"),
        number("frequencyData.likeCnt").alias("likes"),
        number("frequencyData.totalCommentCnt").alias("comments"),
        number("frequencyData.viewCnt").alias("views"),
        "official_q",
    ).filter("uuid <> '' OR own_id <> 0")
    if gated:
        rows = rows.filter(looks_like_interview(F.col("title"), F.col("content")))
    parsed = parse_title(F.col("title"), list(companies))
    rows = rows.withColumn("parsed", parsed).withColumn("url", canonical_url(F.col("url"), F.col("uuid"), site))
    said = F.when(F.col("parsed.round") != "", F.col("parsed.round")).otherwise(round_from_content(F.col("content")))
    return rows.select(
        F.when(F.col("own_id") != 0, F.col("own_id")).otherwise(fallback_id(F.col("url"))).alias("id"),
        "uuid",
        "title",
        "url",
        F.col("parsed.company").alias("company"),
        F.col("parsed.job").alias("job"),
        job_group(F.col("parsed.job")).alias("job_group"),
        said.alias("round"),
        round_group(said).alias("round_group"),
        "content",
        "posted_at",
        F.to_date(F.timestamp_millis("posted_at")).alias("posted_date"),
        "entity_type",
        trim(topic_tag(F.col("html"))).alias("topic_tag"),
        "location",
        "author_id",
        "author_name",
        "likes",
        "comments",
        "views",
        "official_q",
    )


def survey(pages: DataFrame) -> DataFrame:
    """Counts over raw pages: how they parse, what they seem to hold, entity types, months and kinds of address (``part``, ``value``, ``n``)."""
    html, url = F.col("html"), F.col("url")
    state = state_json(html)
    rows = pages.select("url", state.alias("state"), (F.locate(MARKER, F.coalesce(html, F.lit(""))) > 0).alias("marked"))
    rows = rows.select("url", "state", "marked", F.from_json(dig(F.col("state"), CONTENT), FIELDS).alias("c"), dig(F.col("state"), QUESTIONS).alias("q"))
    text = F.coalesce(replaced(F.col("c.content"), R.TAG), F.lit(""))
    title = trim(F.coalesce("c.title", F.lit("")))
    time = first_time(*[F.coalesce(F.col(f"c.{x}").try_cast("bigint"), F.lit(0).cast("bigint")) for x in ("createdAt", "createTime", "editTime")])
    parsed = F.col("c").isNotNull()
    outcome = F.when(~F.col("marked"), "no state").when(F.col("state").isNull(), "broken state").when(~parsed, "no content").otherwise("parsed")
    kind = F.when((title == "") & (text == ""), "empty").when(is_recruit_ad(title, text), "advertising").when(found(F.concat(title, F.lit("\n"), text), R.INTERVIEW_WORD), "interview").otherwise("other")
    address = F.when(url.contains("/feed/"), "feed").otherwise("discuss")
    listed = F.coalesce(q_size(F.col("q")), F.lit(0)) > 0
    facts = F.array(
        F.struct(F.lit("outcome").alias("part"), outcome.alias("value")),
        F.struct(F.lit("kind").alias("part"), F.when(parsed, kind).alias("value")),
        F.struct(F.lit("entity").alias("part"), F.when(parsed, F.coalesce("c.entityType", F.lit(""))).alias("value")),
        F.struct(F.lit("month").alias("part"), F.when(parsed & (time != 0), F.date_format(F.timestamp_millis(time), "yyyy-MM")).alias("value")),
        F.struct(F.lit("address").alias("part"), F.when(parsed, address).alias("value")),
        F.struct(F.lit("interviews by address").alias("part"), F.when(parsed & (kind == "interview"), address).alias("value")),
        F.struct(F.lit("with official list").alias("part"), F.when(parsed & listed, F.lit("yes")).alias("value")),
    )
    return rows.select(F.explode(facts).alias("f")).select("f.*").filter("value IS NOT NULL").groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))


def q_size(text: Column) -> Column:
    return F.json_array_length(text)


def refilled(posts: DataFrame, companies: DataFrame | tuple[str, ...] | list[str] = COMPANIES) -> DataFrame:
    """Company, job and round of all posts again, with a dictionary that their own names have grown.

    All names that the posts carry join the dictionary but generic words and those without a
    letter; ``companies`` is a list or a table of names (``name``).
    """
    from ..functions.titles import is_generic, known_companies

    spark = posts.sparkSession
    base = companies if isinstance(companies, DataFrame) else spark.createDataFrame([(n,) for n in companies], "name string")
    seen = posts.select(trim(F.col("company")).alias("name")).filter((F.col("name") != "") & ~is_generic(F.col("name")) & F.col("name").rlike("[A-Za-z\\p{IsHan}]"))
    titles = posts.select(F.col("title").alias("key"), trim(F.col("title")).alias("title")).distinct()
    known = known_companies(titles, base.select("name").union(seen).distinct())
    met = posts.join(known.select(F.col("key").alias("_title"), F.col("known").alias("_known")), F.col("title") == F.col("_title"), "left")
    again = met.withColumn("_parsed", parse_title(F.col("title"), known=F.coalesce("_known", F.lit(""))))
    said = F.when(F.col("_parsed.round") != "", F.col("_parsed.round")).otherwise(round_from_content(F.col("content")))
    again = again.withColumns({"company": F.col("_parsed.company"), "job": F.col("_parsed.job"), "job_group": job_group(F.col("_parsed.job")), "round": said, "round_group": round_group(said)})
    return again.select(*posts.columns)
