"""Evaluation: accuracy by group, exact latency percentiles, confusion matrix, classification report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count


def accuracy_by(df: DataFrame, group: str, correct: Column) -> DataFrame:
    return df.groupBy(group).agg(F.avg(correct.cast("int")).alias("accuracy"), F.count("*").alias("n"))


def latency(df: DataFrame, value: str) -> DataFrame:
    p = lambda q: F.percentile(value, q)
    return df.agg(F.avg(value).alias("mean"), p(0.5).alias("median"), p(0.95).alias("p95"), F.min(value).alias("lowest"), F.max(value).alias("highest"))


def confusion(df: DataFrame, truth: str, predicted: str, zeros: bool = False) -> DataFrame:
    """Rows of each pair of classes; with ``zeros`` of every pair of the classes that occur."""
    cells = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    if not zeros:
        return cells
    labels = cells.select(F.explode(F.array(F.col(truth), F.col(predicted))).alias("_l")).distinct()  # a row a class
    every = labels.select(F.col("_l").alias("_t")).crossJoin(labels.select(F.col("_l").alias("_p")))
    out = every.join(cells, F.col("_t").eqNullSafe(F.col(truth)) & F.col("_p").eqNullSafe(F.col(predicted)), "left")
    return out.select(F.col("_t").alias(truth), F.col("_p").alias(predicted), F.coalesce("n", F.lit(0)).alias("n"))


def averages(classes: DataFrame) -> DataFrame:
    """Macro and weighted averages of a report, one row each."""
    total = F.sum("support")
    flat = [F.avg(c).alias(f"m_{c}") for c in ("precision", "recall", "f1")]
    heavy = [(F.sum(F.col(c) * F.col("support")) / total).alias(f"w_{c}") for c in ("precision", "recall", "f1")]
    a = classes.agg(total.alias("support"), *flat, *heavy)
    rows = [F.struct(F.lit(n).alias("average"), "support", *[F.col(f"{k}_{c}").alias(c) for c in ("precision", "recall", "f1")]) for n, k in (("macro", "m"), ("weighted", "w"))]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, from one pass over the cells of the confusion matrix."""
    cells = confusion(df, truth, predicted)
    both = cells.select(F.explode(F.array(F.struct(F.col(truth).alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col(predicted).alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))).alias("c")).select("c.*")
    s = both.groupBy("label").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    safe = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    s = s.withColumn("precision", safe(F.col("hit"), F.col("said"))).withColumn("recall", safe(F.col("hit"), F.col("support")))
    return s.select("label", "support", "precision", "recall", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"))


def keywords(answer: Column, wanted: Column) -> Column:
    """found, missing and recall of an array of keywords, as substrings in any case; recall 0 where none is wanted."""
    inside = lambda k: F.contains(F.lower(answer), F.lower(k))
    found, missing = F.filter(wanted, inside), F.filter(wanted, lambda k: ~inside(k))
    recall = F.when(F.size(wanted) > 0, F.size(found) / F.size(wanted)).otherwise(0.0)
    return F.struct(found.alias("found"), missing.alias("missing"), recall.alias("recall"))


def summary(results: DataFrame) -> DataFrame:
    """One row of means over results (mode_correct, keyword_recall, confidence, latency_ms, answer_length, num_sources, has_citations)."""
    share = lambda c: F.avg(F.col(c).cast("int"))
    return results.agg(
        F.count("*").alias("total_cases"),
        share("mode_correct").alias("intent_accuracy"),
        F.avg("keyword_recall").alias("avg_keyword_recall"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("latency_ms").alias("avg_latency_ms"),
        F.percentile("latency_ms", 0.95).alias("p95_latency_ms"),
        F.avg("answer_length").alias("avg_answer_length"),
        F.avg("num_sources").alias("avg_sources_per_answer"),
        share("has_citations").alias("pct_with_citations"),
    )


def judged(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """The result of each case (query, expected_mode, expected_keywords) from its answer (query, predicted_mode, mode_confidence, answer, confidence, sources, latency_ms, error).

    A case without an answer, or whose answer is null, is an error.
    """
    r = cases.join(answers, "query", "left").withColumn("k", keywords(F.coalesce("answer", F.lit("")), F.col("expected_keywords")))
    failed = F.col("answer").isNull()
    n = F.coalesce(F.size("sources"), F.lit(0))
    return r.select(
        "query",
        "expected_mode",
        "predicted_mode",
        (F.col("predicted_mode") == F.col("expected_mode")).alias("mode_correct"),
        "mode_confidence",
        F.col("k.found").alias("keywords_found"),
        F.col("k.missing").alias("keywords_missing"),
        F.col("k.recall").alias("keyword_recall"),
        word_count(F.coalesce("answer", F.lit(""))).alias("answer_length"),
        n.alias("num_sources"),
        "confidence",
        "latency_ms",
        (n > 0).alias("has_citations"),
        F.when(failed, F.coalesce("error", F.lit("no answer"))).alias("error"),
    )


def metrics(results: DataFrame) -> DataFrame:
    """One row: the summary of the results without an error, latencies, accuracy by mode, and the share of errors.

    Where every case failed the means are null.
    """
    good = results.where("error is null")
    shares = results.agg(F.count("*").alias("cases"), F.avg(F.col("error").isNotNull().cast("int")).alias("error_rate"))
    spread = good.agg(F.min("latency_ms").alias("min_latency_ms"), F.max("latency_ms").alias("max_latency_ms"), F.percentile("latency_ms", 0.5).alias("median_latency_ms"))
    modes = accuracy_by(good, "expected_mode", F.col("mode_correct")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("expected_mode", "accuracy")))).alias("per_mode_accuracy"))
    return summary(good).crossJoin(spread).crossJoin(modes).crossJoin(shares)  # one row each


def report_lines(summary_row: DataFrame) -> DataFrame:
    """The printed report of ``metrics``: line, text; a bar of a mode has a block for each full twentieth; halves are rounded to even."""
    bar = F.transform(F.map_entries("per_mode_accuracy"), lambda e: F.concat(F.format_string("    %-8s: %.1f%% ", e["key"], F.bround(e["value"] * 100, 1)), F.repeat(F.lit("█"), F.floor(e["value"] * 20).cast("int"))))
    head = F.array(
        F.lit("EVALUATION SUMMARY"),
        F.format_string("  Intent Classification Accuracy: %.1f%%", F.bround(F.col("intent_accuracy") * 100, 1)),
        F.format_string("  Average Keyword Recall:         %.1f%%", F.bround(F.col("avg_keyword_recall") * 100, 1)),
        F.format_string("  Average Confidence:             %.3f", F.bround("avg_confidence", 3)),
        F.format_string("  Average Latency:                %.0fms", F.bround("avg_latency_ms", 0)),
        F.format_string("  P95 Latency:                    %.0fms", F.bround("p95_latency_ms", 0)),
        F.lit("  Per-Mode Accuracy:"),
    )
    tail = F.array(
        F.lit("  Answer Quality:"),
        F.format_string("    Avg length:     %.0f words", F.bround("avg_answer_length", 0)),
        F.format_string("    Avg sources:    %.1f", F.bround("avg_sources_per_answer", 1)),
        F.format_string("    Has citations:  %.0f%%", F.bround(F.col("pct_with_citations") * 100, 0)),
    )
    return summary_row.select(F.posexplode(F.concat(head, bar, tail)).alias("line", "text"))
