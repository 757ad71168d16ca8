"""Retrieval: searches over recorded hits and threads, fan-out of what they find into chunks, and the best chunks.

What a live connector would return lies in tables (see ``sources``), so a batch of questions is joins and windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import routing
from .chunking import chunks
from .embedding import embedded
from .forum import comments, live_posts
from .ranking import comment_quality, thread_relevance, top_per_group
from .vector import mmr, top_k

#: Hits of a search, threads of a forum, articles and threads of a question, comments of a thread, categories kept.
HITS, THREADS, ARTICLES, MOST_THREADS, COMMENTS, CATEGORIES = 3, 3, 3, 5, 5, 5
LEAST_POST = 50


def expanded(questions: DataFrame) -> DataFrame:
    """query_id, exp_idx and search for each search that (query_id, query, mode) makes."""
    return questions.select("query_id", F.posexplode(routing.expanded(F.col("query"), F.col("mode"))).alias("exp_idx", "search"))


def article_search(questions: DataFrame, hits: DataFrame, flags: DataFrame, most: int = ARTICLES) -> DataFrame:
    """query_id, rank and title: each question's first ``most`` articles.

    Searches go in their order, each with its first hits of ``hits`` (search, hit_idx, title); a title counts once, at its
    first place; disambiguation pages of ``flags`` (title, disambiguation) are left out, titles it lacks are kept.
    """
    found = expanded(questions).join(hits.where(F.col("hit_idx") < HITS), "search")
    place = F.struct("exp_idx", "hit_idx")
    first = found.groupBy("query_id", "title").agg(F.min(place).alias("place")).join(flags, "title", "left")
    first = first.where(~F.coalesce(F.col("disambiguation"), F.lit(False)))
    return top_per_group(first, "query_id", ["place"], most).select("query_id", "rank", "title")


def best_comments(rows: DataFrame, thread: str, order: str, most: int = COMMENTS) -> DataFrame:
    """The comments (body, score, awards, parent_id) of a thread that count, by quality; ties in their order."""
    # what follows the slots must not count them anew
    kept = comments(rows, thread, [order], parent="parent_id").drop("rank")
    q = comment_quality(F.col("score"), F.col("word_count"), F.col("awards"), F.coalesce(F.col("is_top_level"), F.lit(False)))
    return top_per_group(kept.withColumn("quality", q), thread, [F.desc("quality"), order], most)


def forum_search(questions: DataFrame, posts: DataFrame, best: DataFrame, most: int = MOST_THREADS) -> DataFrame:
    """query_id, rank, thread_id and relevance: each question's threads.

    ``posts`` (query_id, thread_id, forum, hit_idx, title, score, num_comments, selftext, removed_by) are what a search of
    each forum returned; the first of each of the mode's forums that are live compete.  ``best`` (thread_id, quality) is
    the quality of a thread's best comment.
    """
    asked = questions.select("query_id", "query", F.posexplode(routing.forums(F.col("mode"))).alias("forum_idx", "forum"))
    found = live_posts(posts.where(F.col("hit_idx") < THREADS)).join(asked, ["query_id", "forum"]).join(best, "thread_id", "left")
    score = thread_relevance(F.col("title"), F.col("query"), F.col("score"), F.col("num_comments"), F.col("forum"), F.col("quality"))
    ranked = found.withColumn("relevance", score)
    return top_per_group(ranked, "query_id", [F.desc("relevance"), "forum_idx", "hit_idx"], most).select("query_id", "rank", "thread_id", "relevance")


def article_parts(found: DataFrame, articles: DataFrame) -> DataFrame:
    """The texts to chunk of found articles (title, url, summary, sections, categories, n_references): sections in order, then a summary that is not empty."""
    a = found.join(articles, "title").withColumn("categories", F.slice("categories", 1, CATEGORIES))
    sections = F.transform("sections", lambda s, i: F.struct((i + 0).alias("part"), s["title"].alias("section_title"), s["content"].alias("text"), F.lit(False).alias("is_summary")))
    summary = F.when(F.length("summary") > 0, F.array(F.struct(F.coalesce(F.size("sections"), F.lit(0)).alias("part"), F.lit("Summary").alias("section_title"), F.col("summary").alias("text"), F.lit(True).alias("is_summary"))))
    kind = "array<struct<part:int,section_title:string,text:string,is_summary:boolean>>"
    parts = F.concat(F.coalesce(sections.cast(kind), F.array().cast(kind)), F.coalesce(summary.cast(kind), F.array().cast(kind)))
    rows = a.select("query_id", "rank", "url", "title", "categories", "n_references", F.explode(parts).alias("p"))
    metadata = F.when(F.col("p.is_summary"), F.to_json(F.struct(F.col("p.is_summary").alias("is_summary")))).otherwise(F.to_json(F.struct(F.col("n_references").alias("references_count"), "categories")))
    return rows.select("query_id", F.struct(F.lit(0).alias("kind"), "rank", F.col("p.part").alias("part")).alias("ord"), F.lit("article").alias("source"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), "p.section_title", metadata.alias("metadata"), "p.text")


def thread_parts(found: DataFrame, posts: DataFrame, best: DataFrame) -> DataFrame:
    """The texts to chunk of found threads: their best comments in order, then a post of more than 50 characters.

    ``posts`` (thread_id, url, title, forum, selftext) has a row a thread, ``best`` (thread_id, rank, cleaned, score, quality) its comments.
    """
    t = found.select("query_id", F.col("rank").alias("t"), "thread_id").join(posts.select("thread_id", "url", "title", "forum", "selftext"), "thread_id")
    name = F.concat(F.lit("r/"), "forum")
    c = t.join(best.select("thread_id", F.col("rank").alias("c"), "cleaned", "score", "quality"), "thread_id")
    meta = F.to_json(F.struct(F.col("score").alias("comment_score"), F.col("quality").alias("quality_score"), F.col("forum").alias("subreddit")))
    said = c.select("query_id", F.struct(F.lit(1).alias("kind"), F.col("t").alias("rank"), F.col("c").alias("part")).alias("ord"), F.lit("forum").alias("source"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), name.alias("section_title"), meta.alias("metadata"), F.col("cleaned").alias("text"))
    post = t.where(F.length("selftext") > LEAST_POST)
    post = post.select("query_id", F.struct(F.lit(1).alias("kind"), F.col("t").alias("rank"), F.lit(1 << 20).alias("part")).alias("ord"), F.lit("forum").alias("source"), F.col("url").alias("source_url"), F.col("title").alias("source_title"), F.concat(name, F.lit(" (OP)")).alias("section_title"), F.to_json(F.struct(F.lit(True).alias("is_original_post"))).alias("metadata"), F.col("selftext").alias("text"))
    return said.unionByName(post)


def routed(parts: DataFrame, questions: DataFrame) -> DataFrame:
    """The parts whose source the question's mode asks."""
    return parts.join(questions.select("query_id", F.explode(routing.sources(F.col("mode"))).alias("source")), ["query_id", "source"], "left_semi")


def fan_out(parts: DataFrame) -> DataFrame:
    """The chunks of parts, in the parts' columns and those of ``chunks``."""
    return chunks(parts, F.col("source_title"), F.col("section_title"))


def best_chunks(cut: DataFrame, questions: DataFrame, k: int = 5, dimensions: int = 384, diverse: bool = True) -> DataFrame:
    """The chunks (query_id, ord, chunk_index, text) that answer each question best, with ``rank`` and ``score``.

    Every question searches its own chunks, in their order of fan-out: a chunk's number within its question is its vec_id.
    A column ``top_k`` of the questions is a question's k.
    """
    number = F.row_number().over(W.partitionBy("query_id").orderBy("ord", "chunk_index")).cast("long") - 1
    held = embedded(cut.withColumn("vec_id", number), dimensions)
    more = ["top_k"] if "top_k" in questions.columns else []
    asked = embedded(questions.select("query_id", "query", *more), dimensions, "query").select("query_id", F.col("embedding").alias("query"), *more)
    search = mmr if diverse else top_k
    best = search(held.select("query_id", "vec_id", "embedding"), asked, k, own=True).select("query_id", "vec_id", "rank", "score")
    return best.join(held.drop("embedding"), ["query_id", "vec_id"])


