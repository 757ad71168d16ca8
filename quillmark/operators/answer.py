"""Answer synthesis: near-duplicate sentences, TextRank, key points, paragraphs, verdicts, citations, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import jaccard, token_set, truncated, word_count, word_set
from .ranking import top_per_group

# Evidence words for and against.
CONFIRM = ("true", "correct", "accurate", "confirmed", "proven", "indeed", "actually", "verified", "supported", "evidence")
DENY = ("false", "incorrect", "myth", "debunked", "misconception", "untrue", "no evidence", "disproven", "misleading", "wrong")
# Signals of a key point.
KEY_POINTS = (
    r"\b(main|key|important|significant|primary|major)\b",
    r"\b(because|therefore|consequently|as a result)\b",
    r"\b(first|second|third|finally|additionally)\b",
    r"\b(studies show|research indicates|evidence suggests)\b",
    r"\b(in conclusion|overall|in summary)\b",
)
# How answers begin, which are lists, which end with the note, and the texts around them.
INTRO = {
    "advice": "Based on community discussions and expert recommendations:\n\n",
    "history": "Here's what historical sources indicate:\n\n",
    "science": "Here's the scientific explanation:\n\n",
    "verify": "After examining available sources:\n\n",
}
BULLETS = ("advice", "verify")
CAVEATS = ("advice", "science", "verify")
NOTE = "\n\n*Note: This answer is synthesized from publicly available sources. For critical decisions, please consult authoritative sources or experts.*"
NO_RESULT = "I couldn't find enough information to answer this question. Try rephrasing your query or asking something more specific."
# Verdicts.
VERDICTS = {
    "FALSE": "Mostly FALSE / Misleading ❌",
    "TRUE": "Mostly TRUE ✅",
    "MIXED": "MIXED / Partially True ⚠️",
    "INCONCLUSIVE": "INCONCLUSIVE — Not enough evidence to determine 🤔",
}
FOOTER = "\n\n---\n📚 **Sources:**\n"
ICONS = {"article": "📖", "forum": "💬"}


#: Sentences of a group at most, for an operator that holds a group as one array; more are an error.
MOST = 5000


def _bounded(xs: Column, most: int) -> Column:
    return F.when(F.size(xs) <= most, xs).otherwise(F.raise_error(F.concat(F.lit("a group has more sentences than "), F.lit(str(most)))))


def sentence_pairs(df: DataFrame, group: str, order: str, text: str = "text") -> DataFrame:
    """Similarity of the sentence pairs of a group that share a token: an equi-join on tokens, not all pairs."""
    tok = df.select(group, order, token_set(F.col(text)).alias("_t"))
    one = tok.select(group, order, F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    a, b = one.alias("a"), one.alias("b")
    both = a.join(b, (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("a._w") == F.col("b._w")) & (F.col(f"a.{order}") < F.col(f"b.{order}")))
    both = both.groupBy(F.col(f"a.{group}").alias(group), F.col(f"a.{order}").alias("i"), F.col(f"b.{order}").alias("j")).agg(F.count("*").alias("_k"), F.first("a._n").alias("_a"), F.first("b._n").alias("_b"))
    return both.select(group, "i", "j", (F.col("_k") / (F.col("_a") + F.col("_b") - F.col("_k"))).alias("similarity"))


def deduplicated(df: DataFrame, group: str, order: str, limit: float = 0.75) -> DataFrame:
    """Greedy pass in order over (text, relevance): the first kept sentence that is too similar decides; the more relevant one stays, at the end.

    A group is one array, bounded as for ``textrank``.
    """
    kind = f"array<struct<ord:bigint,text:string,relevance:double,w:array<string>>>"
    item = F.struct(F.col(order).cast("long").alias("ord"), F.col("text"), F.col("relevance"), word_set(F.col("text")).alias("w"))
    lists = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).cast(kind).alias("xs")).withColumn("xs", _bounded(F.col("xs"), MOST))

    def step(kept: Column, x: Column) -> Column:
        like = F.filter(kept, lambda k: jaccard(k["w"], x["w"]) > limit)
        swapped = F.concat(F.filter(kept, lambda k: k["ord"] != like[0]["ord"]), F.array(x))
        return F.when(F.size(like) == 0, F.concat(kept, F.array(x))).when(x["relevance"] > like[0]["relevance"], swapped).otherwise(kept)

    out = lists.select(group, F.posexplode(F.aggregate("xs", F.array().cast(kind), lambda a, x: step(a, x).cast(kind))).alias("pos", "x"))
    return out.select(group, "pos", F.col("x.ord").alias("sent_ord"), "x.text", "x.relevance")


def textrank(df: DataFrame, group: str, order: str, query: Column, top: int = 10, steps: int = 30, damping: float = 0.85) -> DataFrame:
    """Sentences of a group by TextRank over token-set similarity, with query overlap, position and relevance; the best in their order.

    Scores that agree in 12 digits tie, in favour of the earlier sentence.  A group is one array: the sentences of the
    chunks that answer one question, some hundreds; more than ``MOST`` are an error, so cut such groups down before.
    """
    item = F.struct(F.col(order).cast("int").alias("ord"), F.col("text"), F.col("relevance"), F.col("position"), token_set(F.col("text")).alias("w"))
    g = df.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("xs"), F.first(token_set(query)).alias("q")).withColumn("xs", _bounded(F.col("xs"), MOST))
    g = g.withColumn("sim", F.transform("xs", lambda a: F.transform("xs", lambda b: F.when(a["ord"] == b["ord"], 0.0).otherwise(jaccard(a["w"], b["w"])))))
    g = g.withColumn("rowsum", F.transform("sim", lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v)))
    n = F.size("xs")

    def sweep(s: Column, _: Column) -> Column:
        share = F.zip_with(s, F.col("rowsum"), lambda v, r: F.when(r > 0, v / r).otherwise(0.0))
        return F.transform("sim", lambda row: (1 - damping) / n + damping * F.aggregate(F.zip_with(row, share, lambda m, v: m * v), F.lit(0.0), lambda x, y: x + y))

    g = g.withColumn("s", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.transform("xs", lambda x: 1 / n), sweep))
    rows = g.select(group, n.alias("n"), "q", F.explode(F.arrays_zip("xs", "s")).alias("z")).select(group, "n", "q", "z.xs.*", "z.s")
    overlap = F.when((F.size("q") > 0) & (F.size("w") > 0), 0.3 * F.size(F.array_intersect("w", "q")) / F.size("q")).otherwise(0.0)
    scored = rows.withColumn("score", (F.col("s") + overlap + 0.1 * (1 - F.col("position"))) * F.col("relevance"))
    ranked = scored.withColumn("_r", F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.round("score", 12)), "ord")))
    return ranked.where((F.col("_r") <= top) | (F.col("n") <= top)).select(group, F.col("ord").alias("sent_ord"), "text", "score")


def paragraphs(df: DataFrame, group: str, order: str, title: str, most: int | Column = 3) -> DataFrame:
    """Paragraph numbers: a new one where a non-empty title changes or after ``most`` sentences."""
    w = W.partitionBy(group).orderBy(order)
    before = F.lag(title).over(w)
    island = F.sum(F.when((before != "") & (before != F.col(title)), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0))
    out = df.withColumn("_island", island)
    inside = F.row_number().over(W.partitionBy(group, "_island").orderBy(order)) - 1
    return out.withColumn("part", F.floor(inside / most).cast("int")).withColumnRenamed("_island", "island")


def verdict(df: DataFrame, group: str) -> DataFrame:
    """Evidence words weighted by relevance; one side must outweigh the other by half."""
    w = word_set(F.col("text"))
    yes = F.size(F.array_intersect(w, F.array(*map(F.lit, CONFIRM)))) * F.col("relevance")
    no = F.size(F.array_intersect(w, F.array(*map(F.lit, DENY)))) * F.col("relevance")
    out = df.groupBy(group).agg(F.sum(yes).alias("confirm"), F.sum(no).alias("deny"))
    word = F.when(F.col("deny") > 1.5 * F.col("confirm"), "FALSE").when(F.col("confirm") > 1.5 * F.col("deny"), "TRUE").when((F.col("confirm") > 0) | (F.col("deny") > 0), "MIXED").otherwise("INCONCLUSIVE")
    return out.withColumn("verdict", word)


def citations(df: DataFrame, group: str, order: str, url: str) -> DataFrame:
    """The first chunk of each URL, numbered from one."""
    first = df.withColumn("_k", F.row_number().over(W.partitionBy(group, url).orderBy(order))).where("_k = 1").drop("_k")
    return first.withColumn("citation", F.row_number().over(W.partitionBy(group).orderBy(order)))


def confidence(df: DataFrame, group: str, sentences: DataFrame | None = None) -> DataFrame:
    """From chunks (score, url, source): mean score, URLs, source kinds and sentences.

    The sentences are the sum of ``n_sentences``, or in ``sentences`` (group, n_sentences).
    """
    found = [F.avg("score").alias("m"), F.countDistinct("url").alias("u"), F.countDistinct("source").alias("t")]
    if sentences is None:
        a = df.groupBy(group).agg(*found, F.sum("n_sentences").alias("s"))
    else:
        a = df.groupBy(group).agg(*found).join(sentences.select(group, F.col("n_sentences").alias("s")), group, "left").fillna(0, ["s"])
    c = 0.4 * F.col("m") + 0.25 * F.least(F.col("u") / 3, F.lit(1.0)) + 0.15 * F.when(F.col("t") > 1, 1.0).otherwise(0.8) + 0.2 * F.least(F.col("s") / 10, F.lit(1.0))
    return a.select(group, F.round(F.least(c, F.lit(1.0)), 3).alias("confidence"))


def sentence_rows(chunks: DataFrame, sentences: Column, least: int = 5, most: int = 60) -> DataFrame:
    """One row for each sentence of ``least`` to ``most`` words, with its place among all sentences of its chunk (0 to below 1)."""
    rows = chunks.withColumn("_s", sentences).select("*", F.size("_s").alias("_n"), F.posexplode("_s").alias("sent_ord", "sentence")).drop("_s")
    rows = rows.withColumn("position", F.col("sent_ord") / F.col("_n")).drop("_n")
    return rows.where(word_count(F.col("sentence")).between(least, most))


def key_points(df: DataFrame, group: str, order: str, patterns: tuple[str, ...] = KEY_POINTS, most: int = 5) -> DataFrame:
    """The first ``most`` texts of a group that hold a signal word, cut to 150 characters."""
    signal = F.col("text").rlike("(?i)" + "|".join(patterns))
    return top_per_group(df.where(signal), group, [order], most).withColumn("point", truncated(F.trim("text")))


def _texts(column: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("_at", column))), lambda x: x[column])


def formatted(df: DataFrame, group: str, order: str, mode: str = "mode", title: str = "title") -> DataFrame:
    """group, mode, answer from sentences (text, relevance, mode, title): bullets or paragraphs, by mode.

    Paragraphs hold 3 sentences for history and 4 otherwise and end where the title changes; an unknown or null mode
    is formatted like ``fact``.  A paragraph, then an answer, is put together in two small aggregations.
    """
    d = df.withColumn("_m", F.coalesce(F.col(mode), F.lit("fact"))).withColumn("_at", F.col(order))
    d = paragraphs(d, group, order, title, F.when(F.col("_m") == "history", 3).otherwise(4))
    bullet = F.col("_m").isin(*BULLETS)
    line = d.withColumn("_line", F.when(bullet, F.concat(F.lit("• "), "text")).otherwise(F.col("text")))
    parts = line.groupBy(group, "_m", "island", "part").agg(_texts("_line").alias("_x"), F.min("_at").alias("_at"))
    parts = parts.withColumn("_para", F.when(bullet, F.array_join("_x", "\n")).otherwise(F.array_join("_x", " ")))
    whole = parts.groupBy(group, "_m").agg(_texts("_para").alias("_x")).join(verdict(df, group).select(group, "verdict"), group)
    intros = F.create_map(*[F.lit(x) for kv in INTRO.items() for x in kv])
    words = F.create_map(*[F.lit(x) for kv in VERDICTS.items() for x in kv])
    intro = F.coalesce(F.when(F.col("_m").isin(*INTRO), F.concat(intros[F.col("_m")], F.when(bullet, "\n").otherwise("\n\n"))), F.lit(""))
    body = F.when(bullet, F.array_join("_x", "\n")).otherwise(F.array_join("_x", "\n\n"))
    judged = F.when(F.col("_m") == "verify", F.concat(F.lit("**Verdict: "), words[F.col("verdict")], F.lit("**\n\n"))).otherwise("")
    note = F.when(F.col("_m").isin(*CAVEATS), NOTE).otherwise("")
    return whole.select(group, F.col("_m").alias("mode"), F.concat(judged, intro, body, note).alias("answer"))


def footer(cited: DataFrame, group: str) -> DataFrame:
    """group, footer: the sources (citation, title, url, source) of a group in order of their numbers."""
    icon = F.when(F.col("source") == "article", ICONS["article"]).otherwise(ICONS["forum"])
    line = F.format_string("  [%d] %s %s\n      %s\n", F.col("citation").cast("int"), icon, F.col("title"), F.col("url"))
    rows = cited.select(group, F.col("citation").alias("_at"), line.alias("_line"))
    return rows.groupBy(group).agg(F.concat(F.lit(FOOTER), F.array_join(_texts("_line"), "")).alias("footer"))


def metadata(chunks: DataFrame, extracted: DataFrame, unique: DataFrame, group: str) -> DataFrame:
    """group, chunks_used, sentences_extracted, unique_sentences, from_articles and from_forums of every group of ``chunks`` (source)."""
    used = chunks.groupBy(group).agg(F.count("*").alias("chunks_used"), F.count_if(F.col("source") == "article").alias("from_articles"), F.count_if(F.col("source") == "forum").alias("from_forums"))
    count = lambda df, name: df.groupBy(group).agg(F.count("*").alias(name))
    out = used.join(count(extracted, "sentences_extracted"), group, "left").join(count(unique, "unique_sentences"), group, "left")
    return out.fillna(0, ["sentences_extracted", "unique_sentences"])


def complete(queries: DataFrame, answers: DataFrame, footers: DataFrame, group: str) -> DataFrame:
    """An answer for each of ``queries``: its text and sources, or the no-result text with confidence 0."""
    out = queries.join(answers, group, "left").join(footers, group, "left")
    text = F.when(F.col("answer").isNull(), NO_RESULT).otherwise(F.concat("answer", F.coalesce("footer", F.lit(""))))
    return out.select(*queries.columns, text.alias("answer"), F.when(F.col("answer").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"))
