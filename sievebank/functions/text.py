"""Scalar text functions as column expressions: cleaning, normal forms, questions, modules, answers."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F, types as T

from . import rules as R
from .regex import count, either, first_of, found, group, replaced, trim


def clip(text: Column, n: int) -> Column:
    """The first ``n`` characters."""
    return F.left(text, F.lit(n))


@F.pandas_udf(T.StringType())
def unescape_all(text: pd.Series) -> pd.Series:
    """Every HTML entity, the rare ones too; Spark has no function for it."""
    import html

    return text.map(lambda x: None if x is None else html.unescape(x))


def unescape(text: Column) -> Column:
    """The common HTML entities, in one pass as far as results go: the ampersand's own comes last."""
    steps = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
    return reduce(lambda x, s: F.replace(x, F.lit(s[0]), F.lit(s[1])), steps, text)


def clean_text(text: Column, every_entity: bool = False) -> Column:
    """Without images, emoji marks and tags, entities resolved, trimmed."""
    bare = reduce(replaced, (R.IMAGE, R.CARD, R.EMOJI, R.TAG), text)
    return trim(unescape_all(bare) if every_entity else unescape(bare))


def strip_formatting(text: Column) -> Column:
    """Without list markers, leading hash tags and bold marks."""
    return trim(reduce(replaced, (R.MARKDOWN, R.TAGS_IN_FRONT, R.BOLD), text))


def strip_label(text: Column) -> Column:
    """Without the first kind of leading number or label found.

    A rest that starts with a digit is a version number, and an empty rest no text: both
    leave the text as it was.
    """
    out = text
    for pattern in reversed(R.LABELS):
        rest = F.regexp_replace(replaced(text, pattern), r"^[ \t]+", "")
        kept = F.when((rest == "") | rest.rlike("^[0-9]"), text).otherwise(rest)
        out = F.when(found(text, pattern), kept).otherwise(out)
    return out


def norm_keep_case(text: Column) -> Column:
    """Letters and digits only, without filler words; these go in the order of their table."""
    bare = replaced(strip_label(text), R.NON_WORD)
    return reduce(lambda x, w: F.replace(x, F.lit(w), F.lit("")), R.FILLERS, bare)


def norm(text: Column) -> Column:
    return F.lower(norm_keep_case(text))


def normal_title(title: Column) -> Column:
    return F.lower(replaced(title, R.NON_WORD))


def display_text(text: Column) -> Column:
    """For showing: no label, arrow, control or zero-width character, single spaces; joiners of emoji stay."""
    bare = trim(replaced(strip_label(text), R.ARROW))
    bare = F.regexp_replace(F.replace(bare, F.lit("　"), F.lit(" ")), r"[\x00-\x08\x0A-\x1F\x{200b}\x{200c}\x{feff}\x{2060}\x{00ad}]", "")
    return trim(F.regexp_replace(bare, r"[\s\p{Z}\x{85}]+", " "))


@F.arrow_udf(T.BooleanType())
def is_question(text: pa.Array) -> pa.Array:
    """Whether a line is a question: a long chain of refusals, most of them void if it plainly asks."""
    n = pc.utf8_length(text)

    def has(pattern: str) -> pa.Array:
        return pc.match_substring_regex(text, pattern)

    def short(pattern: str, k: int) -> pa.Array:
        return pc.and_kleene(has(pattern), pc.less(n, k))

    never = either(
        pc.less_equal(n, 5),
        pc.starts_with(text, "（"),
        pc.starts_with(text, "("),
        has(R.POST_TITLE),
        has(R.SOLICIT),
        pc.invert(has(R.HAS_WORD)),
        pc.and_kleene(has(R.ALGO_LEAD), has(R.ALGO_REMARK)),
    )
    remark = either(
        has(R.OUTCOME),
        short(R.STRONG_REMARK, 32),
        short(R.META_REMARK, 34),
        short(R.COMPLAINT, 95),
        short(R.OUTCOME_AT_END, 40),
        pc.and_kleene(pc.greater(n, 50), has(R.NARRATIVE)),
    )
    process = pc.and_kleene(pc.and_kleene(has(R.JOB_PROCESS), has(R.SELF)), pc.invert(has(R.QUESTION_PHRASE)))
    other = either(
        *(has(p) for p in (R.RECRUIT_LINE, R.TAG_LINE, R.TEACHING, R.HAS_URL, R.CODE_WORD, R.NOTE, R.SHORT_NUMBERED)),
        pc.and_kleene(pc.greater(n, 30), either(has(R.GUIDE), has(R.FIRST_PERSON), process)),
        pc.and_kleene(pc.greater(n, 20), has(R.CODE)),
    )
    asking = pc.match_substring_regex(pc.replace_substring_regex(text, R.URL, " "), R.ASKING)
    return pc.invert(pc.or_kleene(never, pc.and_kleene(pc.invert(asking), pc.or_kleene(remark, other))))


@F.arrow_udf(T.StringType())
def classify(text: pa.Array) -> pa.Array:
    """The module of a question; whatever no rule claims is a back-end question."""
    start, name, remark = (pc.match_substring_regex(text, p) for p in (R.ALGO_START, R.ALGO_NAME, R.ALGO_REMARK))
    algo = pc.and_kleene(pc.or_kleene(start, name), pc.invert(remark))
    return pc.if_else(pc.fill_null(algo, False), R.ALGO, first_of(R.BACKEND, R.MODULES, text))


@F.arrow_udf(T.StringType())
def topic_of(text: pa.Array, module: pa.Array) -> pa.Array:
    """The topic of a question within its module."""
    out = pa.repeat(R.OTHER_TOPIC, len(text))
    for name, table in R.TOPICS.items():
        own = pc.fill_null(pc.equal(module, name), False)
        out = pc.replace_with_mask(out, own, first_of(R.OTHER_TOPIC, table, text.filter(own)))
    for name, topic in R.FIXED_TOPICS:
        out = pc.if_else(pc.fill_null(pc.equal(module, name), False), topic, out)
    return out


def is_knowledge(module: Column) -> Column:
    return module != R.INTRO


def split_inline(line: Column) -> Column:
    """A long line with several question marks, cut behind each; other lines as they are."""
    parts = F.filter(F.transform(F.split(line, "(?<=[？?])"), trim), lambda x: x != "")
    several = (F.char_length(line) > 40) & (count(line, "[？?]") >= 2) & (F.size(parts) > 1)
    return F.when(several, parts).otherwise(F.array(line))


def split_compound(line: Column) -> Column:
    """The tasks of a hands-on line, each with the line's lead; other lines as they are."""
    from .regex import java

    lead = group(line, R.ALGO_LEAD)
    body = trim(F.substring(line, F.char_length(lead) + 1, F.char_length(line)))
    parts = F.flatten(F.transform(F.split(body, java(R.COMPOUND)), lambda x: F.split(x, java(R.COMMAS))))
    parts = F.filter(F.transform(parts, trim), lambda x: x != "")
    prefix = F.regexp_replace(trim(lead), r"[：:、 \t]+$", "")
    good = (lead != "") & (F.size(parts) > 1) & ~F.exists(parts, lambda x: F.char_length(x) < 2)
    return F.when(good, F.transform(parts, lambda x: F.concat(prefix, F.lit("："), x))).otherwise(F.array(line))


def trim_answer(answer: Column) -> Column:
    """Without its prefix, with single blank lines, at most 2000 characters and an ellipsis."""
    text = replaced(trim(answer), R.ANSWER_PREFIX)
    text = trim(F.regexp_replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n{3,}", "\n\n"))
    return F.when(F.char_length(text) > R.ANSWER_CAP, F.concat(trim(clip(text, R.ANSWER_CAP)), F.lit("…"))).otherwise(text)


def is_meta_answer(answer: Column) -> Column:
    """Blank, or a plea for details instead of an answer."""
    text = trim(answer)
    head = clip(text, 60)
    return (text == "") | found(head, R.META_ANSWER) | found(head, R.META_ANSWER_NEAR)


def is_interview_post(company: Column, title: Column) -> Column:
    return (company != "") | found(title, R.INTERVIEW_TITLE)


def truthy(value: str | None) -> bool:
    """A switch in a request: anything but empty, 0, false and no."""
    return (value or "").strip().lower() not in ("", "0", "false", "no")


def int_or(value: str | None, default: int) -> int:
    try:
        return int((value or "").strip())
    except ValueError:
        return default
