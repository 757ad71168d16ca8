"""Sources and sinks: the vector index, the fetch cache, datasets and the feedback log."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

FEEDBACK = "query string, was_helpful boolean, correct_mode string, timestamp double"
EXAMPLE = "text string, label string, source string, confidence double"
TTL_SECONDS = 86_400


def save_index(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_index(chunks: DataFrame, path: str) -> None:
    """Add chunks with their embeddings to a saved index."""
    chunks.write.mode("append").parquet(path)


def dimensions(index: DataFrame) -> int:
    """The length of the index's vectors, 0 where it has none."""
    row = index.where(F.col("embedding").isNotNull()).select(F.size("embedding")).first()
    return row[0] if row else 0


def save_examples(examples: DataFrame, path: str) -> None:
    """Labelled examples as JSON lines."""
    examples.write.mode("overwrite").json(path)


def load_examples(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    """Labelled examples from JSON lines, or from files of one JSON array each."""
    return spark.read.schema(EXAMPLE).option("multiLine", array).json(path)


def encode_articles(articles: DataFrame) -> DataFrame:
    """key, data: each article (title and further columns) as JSON under its cache key, sections without their parents."""
    dropped = F.transform("sections", lambda s: s.dropFields("parent_section")) if "parent_section" in str(articles.schema["sections"].dataType) else F.col("sections")
    return articles.withColumn("sections", dropped).select(cache_key(F.lit("article"), F.col("title")).alias("key"), F.to_json(F.struct("*")).alias("data"))


def decode_articles(cached: DataFrame, kind: str) -> DataFrame:
    """Articles of the struct type ``kind`` from (data); a parent that was dropped is null."""
    return cached.select(F.from_json("data", kind).alias("a")).select("a.*")


def save_model(model, metrics: dict, path: str) -> None:
    """A fitted pipeline and its metrics under one folder."""
    from pyspark.sql import SparkSession as S

    model.write().overwrite().save(f"{path}/model")
    S.active().createDataFrame([(json.dumps(metrics),)], "metrics string").write.mode("overwrite").json(f"{path}/metrics")


def load_model(spark: SparkSession, path: str):
    """The pipeline and the metrics of ``save_model``."""
    from pyspark.ml import PipelineModel

    row = spark.read.schema("metrics string").json(f"{path}/metrics").first()
    return PipelineModel.load(f"{path}/model"), json.loads(row.metrics)


def save_evaluation(results: DataFrame, metrics: DataFrame, path: str, run: str) -> None:
    """Details and metrics of a run (its timestamp), as JSON partitioned by run."""
    for name, df in (("details", results), ("metrics", metrics)):
        df.withColumn("run_ts", F.lit(run)).write.mode("append").partitionBy("run_ts").json(f"{path}/{name}")


def cache_key(kind: Column, query: Column) -> Column:
    return F.md5(F.concat_ws(":", kind, query))


def cache_lookup(wanted: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """``wanted`` (key) with the cached data if it was fetched less than a day before ``now`` (epoch seconds)."""
    fresh = cache.where(now - F.col("fetched_at") < TTL_SECONDS)
    return wanted.join(fresh, "key", "left")


def upsert(cache: DataFrame, new: DataFrame) -> DataFrame:
    """The latest row of each key; of equally late ones a new row before an old one, then the largest data."""
    both = cache.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [F.desc(c) for c in both.columns if c not in ("key", "fetched_at", "_new")]
    w = W.partitionBy("key").orderBy(F.desc("fetched_at"), F.desc("_new"), *rest)
    return both.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_new")


def record_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").json(path)


def feedback_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FEEDBACK).json(path)
