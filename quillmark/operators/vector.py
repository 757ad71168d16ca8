"""Vector search over array columns of unit norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: About so many queries and vectors are one row of a block table; every query block meets every vector block.
QUERY_BLOCK, INDEX_BLOCK = 1000, 16384
#: Queries compared at once within a pair of blocks.
_AT_ONCE = 64


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def _blocks(df: DataFrame, key: str, vector: str, size: int, name: str) -> DataFrame:
    """Rows of about ``size`` rows of ``df`` with a vector, dealt by a hash of ``key``."""
    df = df.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(key, vector)
    total = df.agg(F.count("*").alias("_n"))  # one row
    block = F.pmod(F.xxhash64(key), F.greatest(F.ceil(F.col("_n") / size), F.lit(1)))
    return df.crossJoin(F.broadcast(total)).groupBy(block.alias("_b")).agg(F.collect_list(F.struct(key, vector)).alias(name)).select(name)


def _block_best(vectors: pa.StructArray, queries: pa.StructArray, best: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of queries and of their ``best`` vectors (by score, then vec_id), and the scores: sums in the order of the dimensions, as in ``dot``."""
    ids = vectors.field(0).to_numpy(zero_copy_only=False)
    out = []
    for width in np.unique(pc.list_value_length(queries.field(1)).to_numpy(zero_copy_only=False)):
        side = []
        for s in (vectors, queries):
            at = np.flatnonzero(pc.list_value_length(s.field(1)).to_numpy(zero_copy_only=False) == width)
            side.append((at, s.field(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), width).astype(np.float64)))
        (v_at, v), (q_at, q) = side
        order = np.argsort(ids[v_at], kind="stable")
        v_at, v = v_at[order], np.ascontiguousarray(v[order].T)
        for k in range(0, len(q_at), _AT_ONCE):
            score = np.zeros((len(q_at[k : k + _AT_ONCE]), len(v_at)))
            for d in range(width):
                score += q[k : k + _AT_ONCE, d, None] * v[d]
            top = np.argsort(np.where(np.isnan(score), -np.inf, -score), axis=1, kind="stable")[:, :best]
            out.append((np.repeat(q_at[k : k + _AT_ONCE], top.shape[1]), v_at[top].ravel(), np.take_along_axis(score, top, axis=1).ravel()))
    return out


def scored(index: DataFrame, queries: DataFrame, best: int) -> DataFrame:
    """query_id, vec_id, embedding, score: of every query (query_id, query) and each block of vectors the ``best`` pairs.

    Blocks, not rows, are paired, and none is left out; what a block returns holds its share of the best of all.
    """
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    result = f"array<struct<query_id: {kind(queries, 'query_id')}, vec_id: {kind(index, 'vec_id')}, embedding: {kind(index, 'embedding')}, score: double>>"

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        names = ["query_id", "vec_id", "embedding", "score"]
        for lefts, rights in batches:
            sizes, rows = [0], []
            for left, right in zip(lefts, rights, strict=True):
                v, q, n = left.values, right.values, 0
                for q_at, v_at, score in _block_best(v, q, best):
                    near = v.take(pa.array(v_at))
                    rows.append(pa.StructArray.from_arrays([q.field(0).take(pa.array(q_at)), near.field(0), near.field(1), pa.array(score)], names=names))
                    n += len(score)
                sizes.append(sizes[-1] + n)
            yield pa.ListArray.from_arrays(pa.array(sizes, type=pa.int32()), pa.concat_arrays(rows))

    two = _blocks(index, "vec_id", "embedding", INDEX_BLOCK, "vs").crossJoin(_blocks(queries, "query_id", "query", QUERY_BLOCK, "qs"))
    return two.select(F.explode(F.arrow_udf(run, result)("vs", "qs")).alias("r")).select("r.*")


def scored_own(index: DataFrame, queries: DataFrame) -> DataFrame:
    """Like ``scored``, of every query and the vectors of ``index`` that have its query_id; with the queries' ``top_k`` if they have one."""
    more = ["top_k"] if "top_k" in queries.columns else []
    return index.join(queries, "query_id").select("query_id", "vec_id", "embedding", dot(F.col("embedding"), F.col("query")).alias("score"), *more)


def top_k(index: DataFrame, queries: DataFrame, k: int = 5, floor: float = 0.3, own: bool = False) -> DataFrame:
    """The k best by score (ties by vec_id), then those at or above the floor; of the query's own vectors only if ``own``."""
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = (scored_own(index, queries) if own else scored(index, queries, k)).drop("embedding").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return best.where(F.col("score") >= floor)


def mmr(index: DataFrame, queries: DataFrame, k: int = 5, weight: float = 0.8, floor: float = 0.3, own: bool = False) -> DataFrame:
    """Diverse top k from the 3k best: each pick maximises weight * score - (1 - weight) * highest similarity to the picks before.

    With ``own``, each query searches its own vectors, and a column ``top_k`` of ``queries`` is its k.
    """
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    near = scored_own(index, queries) if own else scored(index, queries, 3 * k)
    most = F.col("top_k") if "top_k" in near.columns else F.lit(k)
    pool = near.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= 3 * most)
    pool = pool.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score", "embedding"))).alias("pool"), F.first(most).alias("_k"))
    kind = "array<struct<_r:int,vec_id:bigint,score:double,embedding:array<float>>>"

    def pick(chosen: Column, _: Column) -> Column:
        rest = F.filter(F.col("pool"), lambda c: ~F.exists(chosen, lambda s: s["_r"] == c["_r"]))

        def value(c: Column) -> Column:
            near = F.aggregate(chosen, F.lit(-2.0), lambda a, s: F.greatest(a, dot(s["embedding"], c["embedding"])))
            return F.when(F.size(chosen) == 0, c["score"]).otherwise(weight * c["score"] - (1 - weight) * near)

        ranked = F.array_sort(F.transform(rest, lambda c: F.named_struct(F.lit("v"), -value(c), F.lit("_r"), c["_r"])))
        return F.when(F.size(rest) == 0, chosen).otherwise(F.concat(chosen, F.filter(rest, lambda c: c["_r"] == ranked[0]["_r"])))

    picked = pool.select("query_id", F.aggregate(F.sequence(F.lit(1), F.col("_k")), F.array().cast(kind), lambda a, i: pick(a, i).cast(kind)).alias("p"))
    out = picked.select("query_id", F.posexplode("p").alias("rank", "c"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), "c.vec_id", "c.score").where(F.col("score") >= floor)
