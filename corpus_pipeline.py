"""A corpus pipeline: quality rules, near-duplicates, decontamination, secret masking, SentencePiece ids.

Each stage takes (spark, docs, sf_dir) and its result is written as Parquet and read again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import chunk_bpe, common, compression, containment, minmax, trigram
from quillmark.session import ship


def _ready(spark: SparkSession) -> None:
    """What each stage needs: the package on the workers, and small batches for the session, as its rows are asked for after it has returned."""
    ship(spark)
    common.bound_batches(spark)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents inside the compression bands."""
    _ready(spark)
    return compression.keep_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: similarity 0.8 or more, by 42 bands of 6, which miss such a pair with probability 3e-6."""
    _ready(spark)
    return minmax.drop_near_duplicates(docs, threshold=80, rows=6)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    _ready(spark)
    return containment.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    _ready(spark)
    return trigram.masked(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and the digests of its piece ids and of the text decoded from them."""
    _ready(spark)
    return chunk_bpe.digests(docs.select("doc_id", "lang", "source", "text")).select("doc_id", "lang", "source", "pieces.*")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("decontamination", decontamination),
    ("secret scan", secret_scan),
    ("piece ids", piece_ids),
]
#: Compression, MinHash and library tokenizers are beyond SQL; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = common.cut(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
