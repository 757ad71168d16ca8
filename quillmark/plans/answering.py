"""The path from questions to answers, each step a plan over all questions at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences, token_set
from ..operators import answer, retrieval, routing
from ..operators.chunking import chunks
from ..operators.ranking import top_per_group
from ..session import cut

MAX_SENTENCES = 12


def answer_sources(docs: DataFrame, questions: DataFrame, k: int = 5) -> DataFrame:
    """For (query_id, query): the k chunks with most question words in proportion to their size, with citation numbers.

    A chunk's tokens are made once; an equi-join keeps those that a question asks for before anything is shuffled.
    """
    pieces = chunks(docs.select("doc_id", "source", "text"), F.col("doc_id").cast("string"), F.lit(""))
    toks = pieces.select("doc_id", "chunk_id", "chunk_index", F.explode(F.array(token_set(F.col("text")))).alias("_t"))
    toks = toks.select("doc_id", "chunk_id", "chunk_index", F.size("_t").alias("size"), F.explode("_t").alias("term"))
    asked = questions.select("query_id", F.explode(token_set(F.col("query"))).alias("term"))
    hits = toks.join(asked, "term").groupBy("query_id", "doc_id", "chunk_id", "chunk_index").agg((F.count("*") / F.sqrt(F.first("size"))).alias("score"))
    best = top_per_group(hits, "query_id", [F.desc("score"), "doc_id", "chunk_index"], k)
    return answer.citations(best, "query_id", "rank", "doc_id")


@dataclass(frozen=True)
class Corpus:
    """What the searches find: replayed or crawled tables, with the columns that ``operators.retrieval`` names."""

    hits: DataFrame  # search, hit_idx, title
    articles: DataFrame  # title, url, summary, sections, categories, n_references, disambiguation
    posts: DataFrame  # query_id, thread_id, forum, hit_idx, url, title, score, num_comments, selftext, removed_by
    comments: DataFrame  # thread_id, slot, body, score, awards, parent_id


def retrieved(questions: DataFrame, corpus: Corpus, k: int = 5, dimensions: int = 384, diverse: bool = True) -> DataFrame:
    """The best chunks of each question (query_id, query, mode): searches, fan-out, routing by mode, chunks, embeddings, ranking."""
    found = retrieval.article_search(questions, corpus.hits, corpus.articles.select("title", "disambiguation"))
    best = retrieval.best_comments(corpus.comments, "thread_id", "slot")
    top = best.groupBy("thread_id").agg(F.max("quality").alias("quality"))
    threads = retrieval.forum_search(questions, corpus.posts, top)
    about = corpus.posts.select("thread_id", "url", "title", "forum", "selftext").dropDuplicates(["thread_id"])
    parts = retrieval.article_parts(found, corpus.articles.drop("disambiguation")).unionByName(retrieval.thread_parts(threads, about, best))
    pieces = cut(retrieval.fan_out(retrieval.routed(parts, questions)), "chunks")
    return retrieval.best_chunks(pieces, questions, k, dimensions, diverse)


def synthesized(questions: DataFrame, best: DataFrame, most: int = MAX_SENTENCES) -> DataFrame:
    """answer, confidence, key_points, sources and metadata of each question from its chunks (rank, score, text, source, source_url, source_title).

    Sentences in the order of their chunks lose near-duplicates, are ranked by TextRank, formatted by the question's mode and
    followed by their sources.  A question without chunks gets the no-result answer with confidence 0.  What several
    steps read, chunks and sentences of the answers, is written to the shared folder first.
    """
    best = cut(best, "best-chunks")
    held = best.join(questions.select("query_id", "query", "mode"), "query_id")
    extracted = answer.sentence_rows(held, sentences(F.col("text")))
    nth = F.row_number().over(W.partitionBy("query_id").orderBy("rank", "sent_ord"))
    extracted = extracted.withColumn("nth", nth.cast("int")).withColumns({"text": F.col("sentence"), "relevance": F.col("score")})
    unique = answer.deduplicated(extracted.select("query_id", "nth", "text", "relevance"), "query_id", "nth")
    unique = unique.withColumnRenamed("sent_ord", "nth").select("query_id", "pos", "nth", "text", "relevance")
    about = extracted.select("query_id", "nth", "position", "query", "mode", F.col("source_title").alias("title"), "chunk_id")
    kept = cut(unique.join(about, ["query_id", "nth"]), "sentences")
    ranked = answer.textrank(kept, "query_id", "pos", F.col("query"), top=most).select("query_id", F.col("sent_ord").alias("pos"))
    chosen = cut(kept.join(ranked, ["query_id", "pos"]), "chosen")

    points = answer.key_points(chosen, "query_id", "pos").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "point"))), lambda x: x["point"]).alias("key_points"))
    cited = answer.citations(best, "query_id", "rank", "source_url")
    cited = cited.select("query_id", "citation", F.col("source_title").alias("title"), F.col("source_url").alias("url"), "source", F.round("score", 3).alias("relevance_score"))
    listed = cited.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("citation").alias("index"), "title", "url", F.col("source").alias("source_type"), "relevance_score"))).alias("sources"))
    sure = answer.confidence(best.select("query_id", "score", F.col("source_url").alias("url"), "source"), "query_id", kept.groupBy("query_id").agg(F.count("*").alias("n_sentences")))
    texts = answer.formatted(chosen, "query_id", "pos").drop("mode").join(sure, "query_id")
    out = answer.complete(questions, texts, answer.footer(cited, "query_id"), "query_id")
    scores = best.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.round("score", 3).alias("score")))), lambda x: x["score"]).alias("chunk_scores"))
    meta = answer.metadata(best, extracted, kept, "query_id").join(scores, "query_id")
    out = out.join(points, "query_id", "left").join(listed, "query_id", "left").join(meta, "query_id", "left")
    none = {"key_points": "array<string>", "sources": "array<struct<index:int,title:string,url:string,source_type:string,relevance_score:double>>", "chunk_scores": "array<double>"}
    out = out.withColumns({c: F.coalesce(F.col(c).cast(t), F.array().cast(t)) for c, t in none.items()})
    return out.fillna(0, ["chunks_used", "sentences_extracted", "unique_sentences", "from_articles", "from_forums"])


def decided(requests: DataFrame, predictions: DataFrame) -> DataFrame:
    """``requests`` (query_id, query, mode, top_k) that are right, with the mode to use, its confidence and whether it was forced."""
    right = requests.where(F.size(routing.request_errors(F.col("query"), F.col("top_k"))) == 0)
    p = right.join(predictions.select("query_id", "predicted", F.col("confidence").alias("_c"), "is_ambiguous", "probabilities"), "query_id", "left")
    m = routing.overridden(F.col("mode"), F.col("predicted"), F.col("_c"))
    # a mode that was forced has no probabilities
    shown = F.when(~m["forced"], F.col("probabilities"))
    return p.select("query_id", "query", F.coalesce("top_k", F.lit(5)).alias("top_k"), m["mode"].alias("mode"), F.round(m["confidence"], 3).alias("mode_confidence"), m["forced"].alias("mode_was_forced"), F.coalesce("is_ambiguous", F.lit(False)).alias("is_ambiguous"), shown.alias("probabilities"))


def asked(requests: DataFrame, predictions: DataFrame, corpus: Corpus, dimensions: int = 384, debug: bool = False) -> DataFrame:
    """The response to each right request: mode, answer, key points, sources and, if ``debug``, how they came about."""
    q = cut(decided(requests, predictions), "requests")
    out = synthesized(q, retrieved(q, corpus, dimensions=dimensions))
    cols = ["query_id", "query", F.col("mode").alias("detected_mode"), "mode_confidence", "mode_was_forced", "answer", F.round("confidence", 3).alias("confidence"), "key_points", "sources"]
    if debug:
        inside = F.struct("chunks_used", "sentences_extracted", "unique_sentences", "from_articles", "from_forums")
        cols.append(F.struct(F.col("probabilities").alias("intent_probabilities"), F.col("chunks_used").alias("chunks_retrieved"), "chunk_scores", inside.alias("synthesis_metadata")).alias("debug"))
    return out.select(*cols)
