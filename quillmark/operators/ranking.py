"""Scores of comments, threads and sections, and top rows of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import word_count, word_set


def comment_quality(score: Column, n_words: Column, awards: Column, top_level: Column) -> Column:
    votes = F.when(score > 0, 2 * F.log1p(score.cast("double"))).otherwise(0.0)
    length = F.when(n_words.between(50, 300), 3.0).when(n_words.between(30, 500), 1.5).when(n_words < 15, -2.0).otherwise(0.0)
    return votes + length + F.least(1.5 * awards, F.lit(5.0)) + F.when(top_level, 2.0).otherwise(0.0)


def top_per_group(df: DataFrame, group: str, by: list, n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*by))).where(F.col("rank") <= n)


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a non-empty ``word``."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def section_score(title: Column, content: Column, keywords: list[str]) -> Column:
    raw = sum((occurrences(F.lower(content), F.lit(k)) + F.when(F.contains(F.lower(title), F.lit(k)), 5).otherwise(0) for k in keywords), F.lit(0))
    n = word_count(content)
    return F.when(n > 0, raw / (1 + 0.5 * (n / 200))).otherwise(raw.cast("double"))


#: Forums with strict rules.
STRICT_FORUMS = ("AskHistorians", "askscience", "explainlikeimfive")


def thread_relevance(title: Column, query: Column, votes: Column, n_comments: Column, forum: Column, best_quality: Column) -> Column:
    """Share of the query's words in the title, votes, discussion, a bonus for strict forums and the best comment (null: no comment)."""
    asked = word_set(query)
    shared = F.size(F.array_intersect(asked, word_set(title))) / F.greatest(F.size(asked), F.lit(1))
    popular = F.when(votes > 0, F.log1p(votes.cast("double"))).otherwise(0.0)
    strict = F.when(forum.isin(*STRICT_FORUMS), 5.0).otherwise(0.0)
    return 10 * shared + popular + 0.5 * F.log1p(n_comments.cast("double")) + strict + F.coalesce(0.5 * best_quality, F.lit(0.0))
