"""From pages to a question bank: the whole way, and the snapshot that readers turn to at its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.pages import is_content_page, posts_of, refilled
from ..sources.snapshot import kept, publish
from .cluster import build_questions
from .extract import lines_of
from .labels import labeled
from .listing import recounted
from .maintenance import pruned, upsert


def checked(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """The manifest without rows whose page is missing or no content page; the newest row of each address."""
    good = pages.filter(is_content_page(F.col("html"))).select("url").distinct()
    return upsert(manifest.limit(0), manifest, "url").join(good, "url", "left_semi")


def rebuild(
    pages: DataFrame,
    companies: DataFrame | tuple[str, ...],
    site: str,
    old_posts: DataFrame | None = None,
    merges: DataFrame | None = None,
    groups: DataFrame | None = None,
    labels: DataFrame | None = None,
    taxonomy: DataFrame | None = None,
    folder: str | None = None,
) -> dict[str, DataFrame]:
    """``posts``, ``questions``, ``occurrences`` and ``variants`` of all posts, old ones included.

    Questions are built from all posts, never from the new ones alone; labels are joined by
    normal form, so a rebuild loses none; posts without a question go.  With a ``folder`` the
    tables become its current snapshot once all of them are written.
    """
    posts = posts_of(pages, site, () if isinstance(companies, DataFrame) else companies)
    if old_posts is not None:
        posts = upsert(old_posts, posts, "id", ("official_q", "author_name"))
    posts = kept(refilled(kept(posts, "posts"), companies), "posts")
    built = build_questions(kept(lines_of(posts), "lines"), merges, groups)
    questions, occurrences = built["questions"], built["occurrences"]
    if labels is not None and taxonomy is not None:
        questions = labeled(questions, labels, taxonomy)
    left, occurrences = pruned(posts, occurrences, questions)
    questions = recounted(questions, occurrences, left)
    out = {"posts": left, "questions": questions, "occurrences": occurrences, "variants": built["variants"]}
    if folder is not None:
        out = publish(out, folder)
    return out
