"""What a service needs: a trained model and a corpus, and answers for batches of requests."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, examples, intent, routing
from .plans.answering import Corpus, asked
from .session import ship
from .sources import store

VERSION = "1.0.0"
REQUEST = "query_id bigint, query string, mode string, top_k int"


@dataclass
class Engine:
    """Answers requests from a corpus; it is ready once it has a model.

    ``Engine(spark).train()`` fits one on the built-in examples, ``load`` takes a saved one.
    """

    spark: SparkSession
    corpus: Corpus | None = None
    feedback_path: str | None = None
    dimensions: int = 384
    model: object = None
    training: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)

    @property
    def ready(self) -> bool:
        return self.model is not None and self.corpus is not None

    def health(self) -> dict:
        return {"status": "healthy" if self.ready else "loading", "models_loaded": self.model is not None, "version": VERSION}

    def train(self, data: DataFrame | None = None, folds: int = 5, max_iter: int = 100) -> dict:
        rows = examples.keyed(examples.full(self.spark) if data is None else data)
        self.model, self.training = intent.trained(rows, "key", folds, max_iter)
        return self.training

    def save(self, path: str) -> None:
        store.save_model(self.model, self.training, path)

    def load(self, path: str) -> None:
        self.model, self.training = store.load_model(self.spark, path)

    def predict(self, questions: DataFrame) -> DataFrame:
        """query_id, predicted, confidence, is_ambiguous and probabilities of questions (query_id, query)."""
        if self.model is None:
            raise RuntimeError("there is no model: call train() or load() first")
        rows = questions.select("query_id", F.col("query").alias("text"))
        return routing.prediction(intent.predicted(self.model, rows, "query_id"), "query_id")

    def ask(self, requests: DataFrame, debug: bool = False) -> DataFrame:
        """The response to each request (``REQUEST``) within bounds; ``rejected`` has the others."""
        if not self.ready:
            raise RuntimeError("the engine is not ready: it needs a model and a corpus")
        return asked(requests, self.predict(requests.select("query_id", "query")), self.corpus, self.dimensions, debug)

    def rejected(self, requests: DataFrame) -> DataFrame:
        """The requests out of bounds, with what is wrong."""
        return requests.withColumn("errors", routing.request_errors(F.col("query"), F.col("top_k"))).where(F.size("errors") > 0)

    def timed(self, requests: DataFrame) -> tuple[list, float]:
        """The responses as rows and the milliseconds a request that they took together."""
        began = time.time()
        rows = self.ask(requests).collect()
        return rows, round((time.time() - began) * 1000 / max(len(rows), 1), 1)

    def evaluate(self, cases: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Results and metrics of cases (query, expected_mode, expected_keywords), from one batch of requests.

        The cases are a test set that the driver may hold; a failure of the whole batch is each case's error.
        """
        ids = [(i, r.query, None, None) for i, r in enumerate(cases.select("query").collect())]
        kind = "query string, predicted_mode string, mode_confidence double, answer string, confidence double, sources array<string>, latency_ms double, error string"
        try:
            rows, took = self.timed(self.spark.createDataFrame(ids, REQUEST))
            got = [(r.query, r.detected_mode, r.mode_confidence, r.answer, r.confidence, [s.url for s in r.sources], took, None) for r in rows]
        except Exception as e:  # what went wrong is part of the result
            got = [(q, None, None, None, None, None, None, f"{type(e).__name__}: {e}"[:500]) for _, q, _, _ in ids]
        results = evaluate.judged(cases, self.spark.createDataFrame(got, kind))
        return results, evaluate.metrics(results)

    def record_feedback(self, feedback: DataFrame) -> None:
        """Append (query, was_helpful, correct_mode) to the feedback log with the present time."""
        if self.feedback_path is None:
            raise ValueError("the engine has no feedback_path")
        store.record_feedback(feedback.withColumn("timestamp", F.unix_micros(F.current_timestamp()) / 1e6), self.feedback_path)
