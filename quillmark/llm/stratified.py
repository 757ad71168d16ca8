"""Sharding: proportional stratified interleaving.

Rows are ranked in a seeded shuffle within their source; (rank + 1/2) / rows of the source is a row's fractional
rank; all rows are sorted by it and cut into shards of equal row counts, so every shard has the mixture's shares.
Both rankings are split into buckets by ranges of the sort key, so neither a hot source nor the whole table ever
lies in one task: a row's rank is the number of rows in lower buckets plus its rank within its bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SEED = 7
SHARDS = 16
#: Rows in a bucket of a ranking, about; ranks don't depend on it.
BUCKET_ROWS = 20_000
_SPAN = 1 << 62


def _below(rows: DataFrame, keys: list[str], bucket: str) -> DataFrame:
    """Rows in lower buckets, for each (keys, bucket)."""
    counts = rows.groupBy(*keys, bucket).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*keys).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    total = W.partitionBy(*keys)
    return counts.select(*keys, bucket, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_below"), F.sum("_n").over(total).alias("_total"))


def interleave(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, fraction, shard and slot of each row of ``docs``.

    Shards' row counts differ by one at most.  A null source is a source of its own; a null text has size 1 and the
    crc32 of no bytes; a null doc_id ranks like any other value; equal rows take ranks next to each other; an empty
    table gives no rows; further columns are left out.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.crc32(text.cast("binary"))), 2)
    rows = docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("_source"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        h.alias("_h"),
    )
    rows = common.cut(rows, "shard-rows")  # narrow; read three times below
    buckets, total = 16, rows.count()
    while buckets < 1 << 30 and buckets * bucket_rows < total:
        buckets *= 2
    rows = rows.withColumn("_b", F.expr(f"cast(_h div {_SPAN // buckets} as int)"))
    order: list[Column | str] = ["_h", "doc_id", "text_crc32", "size"]
    base = _below(rows, ["_source"], "_b")
    rank = F.row_number().over(W.partitionBy("_source", "_b").orderBy(*order)) - 1
    ranked = rows.withColumn("_rank", rank).join(base, ["_source", "_b"])
    at = F.col("_below") + F.col("_rank")
    # (2 rank + 1) / (2 total) in units that integers hold, so equal fractions tie exactly
    fraction = ((2 * at + 1) / (2 * F.col("_total"))).alias("fraction")
    placed = ranked.select("doc_id", "_source", "size", "text_crc32", "_h", fraction)
    placed = common.cut(placed.withColumn("_f", F.floor(F.col("fraction") * buckets).cast("int")), "shard-placed")
    low = _below(placed.withColumn("_all", F.lit(0)), ["_all"], "_f").drop("_all")
    inner = F.row_number().over(W.partitionBy("_f").orderBy("fraction", F.xxhash64(F.lit(seed), "_source"), "_source", *order)) - 1
    dealt = placed.withColumn("_rank", inner).join(low, "_f")  # a row a bucket
    shard = F.expr(f"cast(({shards} * (_below + _rank + 1) - 1) div _total as int)")
    dealt = dealt.withColumn("shard", shard).withColumn("slot", F.expr(f"_below + _rank - (shard * _total) div {shards}"))
    source = F.when(F.col("_source") != "", F.substring("_source", 2, 1 << 30)).alias("source")
    return dealt.select("doc_id", source, "size", "text_crc32", "fraction", "shard", "slot")


def op7_stratified_interleaving(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = interleave(common.documents(spark, sf_dir))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source", "fraction")
