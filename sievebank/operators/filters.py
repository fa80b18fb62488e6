"""The query object and its predicates."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rules import NOISE


@dataclass(frozen=True)
class Filter:
    """What a request may ask for; empty fields ask for nothing."""

    date_from: str = ""
    date_to: str = ""
    company: str = ""
    round_group: str = ""
    job_group: str = ""
    category: str = ""
    topic: str = ""
    llm_merged: str = ""
    llm_domain: str = ""
    llm_cat: str = ""
    keyword: str = ""
    include_noise: bool = False
    only_labeled: bool = False
    has_answer: bool = False
    official_only: bool = False
    sort: str = ""
    page: int = 1
    size: int = 50

    @property
    def page_size(self) -> int:
        return self.size if 1 <= self.size <= 500 else 50

    @property
    def offset(self) -> int:
        return (max(self.page, 1) - 1) * self.page_size

    def only_dates(self) -> Filter:
        return Filter(date_from=self.date_from, date_to=self.date_to)

    def with_policy(self, has_labels: bool, show_all: bool = False) -> Filter:
        """Only labelled questions by default, once there are labels."""
        return replace(self, only_labeled=has_labels and not show_all and not self.include_noise)


def every(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))


def date_predicates(flt: Filter, column: str = "posted_date") -> list[Column]:
    """Both ends belong to the range; an end that is no date matches nothing."""
    out = []
    if flt.date_from:
        out.append(F.col(column) >= F.lit(flt.date_from).try_cast("date"))
    if flt.date_to:
        out.append(F.col(column) <= F.lit(flt.date_to).try_cast("date"))
    return out


def post_predicates(flt: Filter) -> list[Column]:
    asked = [F.col(c) == getattr(flt, c) for c in ("company", "round_group", "job_group") if getattr(flt, c)]
    return asked + date_predicates(flt)


def question_predicates(flt: Filter) -> list[Column]:
    out = [F.col(c) == getattr(flt, c) for c in ("category", "topic", "llm_merged", "llm_domain", "llm_cat") if getattr(flt, c)]
    if not flt.include_noise:
        out.append(F.col("llm_cat") != NOISE)
    if flt.only_labeled:
        out.append(F.col("llm_cat") != "")
    if flt.has_answer:
        out.append(F.col("answer").isNotNull())
    return out


def restricted_questions(questions: DataFrame, occurrences: DataFrame, variants: DataFrame | None, flt: Filter) -> DataFrame:
    """Questions that pass; official ones and keywords in other wordings are found by semi joins."""
    out = questions.filter(every(question_predicates(flt)))
    if flt.official_only:
        official = occurrences.filter("official").select(F.col("question_id").alias("_official"))
        out = out.join(official, F.col("id") == F.col("_official"), "left_semi")
    word = flt.keyword.strip().lower()
    if word:
        hits = questions.filter(F.lower("canonical").contains(word)).select(F.col("id").alias("_hit"))
        if variants is not None:
            hits = hits.union(variants.filter(F.lower("text").contains(word)).select("question_id"))
        out = out.join(hits, F.col("id") == F.col("_hit"), "left_semi")
    return out


def has_labels(questions: DataFrame) -> bool:
    return not questions.filter("llm_cat <> ''").limit(1).isEmpty()
