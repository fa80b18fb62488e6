"""Company, job and round of a post, from its title and its text."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import rules as R
from .regex import any_of, found, group, java, replaced, trim

#: A few companies; pass the dictionary in use as a parameter.
COMPANIES = ("字节跳动", "字节", "腾讯", "阿里巴巴", "阿里", "百度", "京东", "美团", "拼多多", "快手", "华为", "小米", "minimax", "google")
EDGE = r"^[ |·\-—:：,，.。\[\]【】()（）]+|[ |·\-—:：,，.。\[\]【】()（）]+$"
EDGE_MORE = r"^[ |·\-—:：,，.。\[\]【】()（）!！?？~～]+|[ |·\-—:：,，.。\[\]【】()（）!！?？~～]+$"


def strict(title: Column) -> tuple[Column, Column, Column]:
    """Company, job and round of a title of exactly that form; blanks otherwise."""
    t = trim(title)
    return tuple(trim(group(t, R.STRICT_TITLE, k)) for k in (1, 2, 3))


def round_of(title: Column) -> Column:
    return any_of(F.lit(""), R.ROUNDS, title)


def job_of(title: Column) -> Column:
    return any_of(F.lit(""), R.JOBS, title)


def looks_like_company(name: Column) -> Column:
    name = trim(name)
    n = F.char_length(name)
    return n.between(2, 14) & ~found(name, R.COMPANY_NOISE) & ~found(name, R.COMPANY_PUNCTUATION) & name.rlike("[一-鿿a-zA-Z0-9]")


def is_generic(name: Column) -> Column:
    return F.lower(trim(name)).isin(*R.GENERIC_COMPANY_WORDS)


def dictionary(names: list[str]) -> list[str]:
    """Distinct names that can be matched, longest in bytes first, ties by name."""
    noise, mark = re.compile(R.COMPANY_NOISE), re.compile(R.COMPANY_PUNCTUATION.replace("[]", r"[\]"))
    seen: dict[str, str] = {}
    for name in (n.strip() for n in names):
        if 2 <= len(name) <= 14 and not noise.search(name) and not mark.search(name):
            seen.setdefault(name.lower(), name)
    return sorted(seen.values(), key=lambda n: (-len(n.encode()), n))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Names of companies (``name``) from a text file, one a line; blank lines and those behind ``#`` are left out."""
    return spark.read.text(path).select(trim(F.col("value")).alias("name")).filter("name <> '' AND NOT startswith(name, '#')").distinct()


def learned(names: list[str]) -> list[str]:
    """Names seen in posts that may join the dictionary: no generic word, and with a letter."""
    letter = re.compile("[A-Za-z一-鿿㐀-䶿]")
    return [n for n in names if n.strip().lower() not in R.GENERIC_COMPANY_WORDS and letter.search(n)]


def company_in(title: Column, names: list[str]) -> Column:
    """The longest dictionary name that the title holds; an ASCII name must stand alone at its first place.

    For a short list; ``known_companies`` joins a table of names of any size.
    """
    low, known = F.lower(title), dictionary(names)
    if not known:
        return F.lit("")
    table = F.arrays_zip(F.array(*[F.lit(n.lower()) for n in known]).alias("low"), F.array(*map(F.lit, known)).alias("name"))
    held = F.filter(table, lambda d: low.contains(d["low"]) & stands_alone(low, d["low"], F.instr(low, d["low"])))
    return F.coalesce(F.get(held, F.lit(0))["name"], F.lit(""))


def stands_alone(low: Column, name: Column, at: Column) -> Column:
    """Whether no ASCII letter or digit touches an ASCII name at its place."""
    before = F.when(at > 1, F.substring(low, at - 1, F.lit(1))).otherwise(F.lit(" "))
    around = F.concat(before, F.lit(" "), F.substring(low, at + F.char_length(name), F.lit(1)))
    return name.rlike(r"[^\x00-\x7F]") | ~around.rlike("[a-z0-9]")


def known_companies(titles: DataFrame, names: DataFrame) -> DataFrame:
    """``key`` and ``known``, the longest of ``names`` (``name``) in each title (``key``, ``title``) that holds one.

    Every substring of a name's possible length meets the names in an equality join, so
    neither table needs to fit anywhere; longer names in bytes go first, ties by name.  Titles
    may be long: one pass cuts them into windows, and rows carry a digest in place of the title.
    """
    name = trim(F.col("name"))
    words = names.select(name.alias("name")).filter(looks_like_company(F.col("name"))).groupBy(F.lower("name").alias("low")).agg(F.min("name").alias("name"))
    # a window is a character and up to fifteen behind it: what stands before, a name, and what stands after
    padded = F.concat(F.lit(" "), F.lower("title"), F.lit(" "))
    windows = F.regexp_extract_all(padded, F.lit("(?s)(?=(.{3,16}))"), F.lit(1))
    digest = F.unhex(F.sha1(F.encode(F.col("key").cast("string"), "UTF-8"))).alias("_id")
    own = titles.filter(F.char_length("title") >= 2)
    long = own.select(digest, F.posexplode(windows).alias("at", "w"))
    long = long.select("_id", "at", "w", F.explode(F.sequence(F.lit(2), F.least(F.lit(14), F.char_length("w") - 1))).alias("n"))
    around = F.concat(F.left("w", F.lit(1)), F.lit(" "), F.substring("w", F.col("n") + 2, F.lit(1)))
    long = long.select("_id", "at", around.alias("around"), F.substring("w", F.lit(2), F.col("n")).alias("gram"))
    met = long.join(words, F.col("gram") == F.col("low"))
    first = met.groupBy("_id", "low").agg(F.min_by("around", "at").alias("around"), F.min("name").alias("name"))
    good = first.filter(F.col("low").rlike(r"[^\x00-\x7F]") | ~F.col("around").rlike("[a-z0-9]"))
    best = good.groupBy("_id").agg(F.min_by("name", F.struct(-F.octet_length("name"), "name")).alias("known"))
    return own.select(digest, "key").dropDuplicates(["_id"]).join(best, "_id").select("key", "known")


def guess_company(title: Column, known: Column, may_guess: Column) -> Column:
    """A dictionary name, or else what stands before the first round word once role words are taken out."""
    places = [F.regexp_instr(title, F.lit(java(p))) for _, p in R.ROUNDS]
    cut = F.least(*[F.when(p > 0, p).otherwise(F.lit(1 << 30)) for p in places])
    head = F.regexp_replace(trim(F.substring(title, F.lit(1), cut - 1)), EDGE, "")
    bad = (head == "") | found(head, R.NO_COMPANY_LEAD) | (F.char_length(head) > 12) | found(head, R.SENTENCE_PUNCTUATION)
    bare = reduce(lambda x, w: F.replace(x, F.lit(w), F.lit(" ")), R.ROLE_WORDS, head)
    bare = F.regexp_replace(F.regexp_replace(bare, r"[\s\p{Z}\x{85}]+", ""), EDGE_MORE, "")
    bare = replaced(bare, R.LEADING_DIGITS)
    good = found(bare, R.ANY_LETTER) & ~bare.isin(*R.GENERIC_WORDS) & ~is_generic(bare) & (F.char_length(bare) >= 3) & looks_like_company(bare)
    return F.when(known != "", known).when(may_guess & ~bad & good, bare).otherwise(F.lit(""))


def parse_title(title: Column, names: list[str] | tuple[str, ...] = COMPANIES, known: Column | None = None) -> Column:
    """struct<company, job, round> of a title: the exact form first, then the loose rules.

    ``known`` is the dictionary's name in the title, blank for none, if it has been joined already.
    """
    title = trim(title)
    c, j, r = strict(title)
    exact = (c != "") | (r != "")
    trusted = (c != "") & looks_like_company(c) & found(c, R.ANY_LETTER) & ~is_generic(c)
    guessed = guess_company(title, company_in(title, list(names)) if known is None else known, (r != "") | (round_of(title) != ""))
    return F.struct(
        F.when(exact & trusted, c).otherwise(guessed).alias("company"),
        F.when(j != "", j).otherwise(job_of(title)).alias("job"),
        F.when(r != "", r).otherwise(round_of(title)).alias("round"),
    )


def round_from_content(content: Column) -> Column:
    """The round that the text's headings name, if they name exactly one."""
    lines = F.transform(F.split(content, "\n"), lambda x: trim(replaced(x, R.HEADING_LEAD)))
    lines = F.filter(lines, lambda x: (x != "") & (F.char_length(x) <= 24))
    table = tuple((name, pattern) for _, name, pattern in R.HEADINGS)
    names = F.array_distinct(F.filter(F.transform(lines, lambda x: any_of(F.lit(""), table, x)), lambda x: x != ""))
    return F.when(F.size(names) == 1, F.element_at(names, 1)).otherwise(F.lit(""))


def job_group(job: Column) -> Column:
    low = F.lower(job)
    return (
        F.when(low.contains("agent"), "Agent 开发")
        .when(job.contains("全栈"), "全栈开发")
        .when(job.contains("数据"), "数据平台")
        .when(low.contains("infra") | job.contains("平台") | job.contains("基础"), "平台/Infra")
        .when(found(job, r"(?i)ai|算法|大模型"), "AI/算法")
        .when(found(low, r"(?i)c\+\+|cpp"), "C++")
        .when(found(low, r"(?i)\bgo\b|golang"), "Go")
        .otherwise("其他")
    )


def round_group(name: Column) -> Column:
    return (
        F.when(F.lower(name).contains("hr"), "HR 面")
        .when(name.contains("复活赛"), "复活赛")
        .when(name.isin("一面", "二面", ""), name)
        .otherwise("三面及以上")
    )
