"""Forum threads: which posts and comments count, and what is derived from a comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_comment, word_count
from .ranking import top_per_group

# Fixed values.
DELETED = "[deleted]"
PLACEHOLDERS = ("[deleted]", "[removed]")
SLOTS = 20


def live_posts(posts: DataFrame) -> DataFrame:
    """Posts (removed_by, selftext) that were neither removed nor deleted."""
    removed = F.coalesce(F.col("removed_by"), F.lit("")) != ""
    return posts.where(~removed & ~F.col("selftext").eqNullSafe(DELETED))


def comments(rows: DataFrame, thread: str, order: list, body: str = "body", parent: str | None = None) -> DataFrame:
    """The comments in a thread's first slots without placeholders: cleaned text, words and links of the raw body, top level or not."""
    kept = top_per_group(rows, thread, order, SLOTS).where(~F.col(body).isin(*PLACEHOLDERS))
    top = F.col(parent).startswith("t3_") if parent else F.lit(None).cast("boolean")
    return kept.withColumns({"cleaned": clean_comment(F.col(body)), "word_count": word_count(F.col(body)), "has_links": has_links(F.col(body)), "is_top_level": top})


def has_links(body: Column) -> Column:
    return body.rlike("https?://")
