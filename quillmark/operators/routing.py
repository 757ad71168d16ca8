"""Modes: prediction, override, routing and query expansion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a mode adds to a question, the sources that it asks, and the forums that it asks first.
EXPANSIONS = {
    "history": ("history timeline", "historical event"),
    "science": ("scientific explanation", "mechanism process"),
    "verify": ("myth misconception", "scientific evidence"),
    "advice": ("guide overview",),
}
ARTICLE, FORUM = ("history", "science", "fact"), ("advice", "verify", "fact")
FORUMS = {
    "advice": ("advice", "NoStupidQuestions", "AskReddit", "LifeProTips", "personalfinance", "careerguidance", "relationships", "internetparents"),
    "history": ("AskHistorians", "history", "HistoryMemes", "todayilearned", "AskHistory"),
    "science": ("askscience", "science", "explainlikeimfive", "EverythingScience", "AskScienceDiscussion"),
    "fact": ("NoStupidQuestions", "explainlikeimfive", "todayilearned", "AskReddit", "answers"),
    "verify": ("IsItBullshit", "skeptic", "DebunkThis", "askscience", "NoStupidQuestions"),
}


def expanded(query: Column, mode: Column) -> Column:
    """The question, then what its mode adds: three at most."""
    out = F.array(query)
    for m, suffixes in EXPANSIONS.items():
        out = F.when(mode == m, F.array(query, *[F.concat(query, F.lit(f" {s}")) for s in suffixes])).otherwise(out)
    return F.slice(out, 1, 3)


def sources(mode: Column) -> Column:
    both = F.array(F.when(mode.isin(*ARTICLE), F.lit("article")), F.when(mode.isin(*FORUM), F.lit("forum")))
    return F.array_compact(both)


def forums(mode: Column, most: int = 3) -> Column:
    """The first ``most`` forums of a mode, those of ``fact`` where it has none."""
    known = F.create_map(*[x for m, names in FORUMS.items() for x in (F.lit(m), F.array(*map(F.lit, names)))])
    return F.slice(F.coalesce(F.element_at(known, F.coalesce(mode, F.lit("fact"))), F.element_at(known, F.lit("fact"))), 1, most)


def overridden(forced: Column, predicted: Column, confidence: Column) -> Column:
    """mode, confidence and forced: a forced mode in lower case with confidence 1, unless it is null or empty."""
    given = F.coalesce(F.length(forced) > 0, F.lit(False))
    return F.struct(F.when(given, F.lower(forced)).otherwise(predicted).alias("mode"), F.when(given, 1.0).otherwise(confidence).alias("confidence"), forced.isNotNull().alias("forced"))


def prediction(probs: DataFrame, key: str, margin: float = 0.15) -> DataFrame:
    """From (key, label, p): the best label, its probability, all probabilities, and whether the second comes within the margin."""
    order = F.array_sort(F.collect_list(F.named_struct(F.lit("q"), -F.col("p"), F.lit("label"), F.col("label"))))
    top = probs.groupBy(key).agg(order.alias("t"))
    second = F.when(F.size("t") > 1, -F.col("t")[1]["q"]).otherwise(0.0)
    best = -F.col("t")[0]["q"]
    every = F.map_from_entries(F.transform("t", lambda x: F.struct(x["label"], -x["q"])))
    return top.select(key, F.col("t")[0]["label"].alias("predicted"), best.alias("confidence"), (best - second < margin).alias("is_ambiguous"), every.alias("probabilities"))


def request_errors(query: Column, top_k: Column, shortest: int = 3, longest: int = 500, most: int = 20) -> Column:
    """What is wrong with a request, as an array; an empty one where nothing is.  A null ``top_k`` is the default and right."""
    return F.array_compact(
        F.array(
            F.when(query.isNull() | ~F.length(query).between(shortest, longest), F.lit("query")),
            F.when(top_k.isNotNull() & ~top_k.between(1, most), F.lit("top_k")),
        )
    )
