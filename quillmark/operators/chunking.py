"""Sentence-aligned chunks with overlap.

Sentences and their word counts are JVM expressions, planned once a row; the fold over the counts, a state machine, runs
in an Arrow UDF that sees only the counts, in time linear in the sentences.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, word_count

_BOUNDS = "array<struct<a:int,b:int,n:int>>"


def bounds(counts: list[int], target: int = 200, overlap: int = 50, least: int = 50) -> list[tuple[int, int, int]]:
    """(first, end, words) of each chunk of sentences with these word counts.

    A full buffer is emitted if it has ``least`` words, and its shortest suffix of ``overlap`` words, none if it is
    shorter altogether, begins the next one; so does the last buffer's rest.
    """
    out: list[tuple[int, int, int]] = []
    first, held = 0, 0  # the buffer is counts[first:i]
    tail, in_tail = 0, 0  # the shortest suffix of the sentences so far with ``overlap`` words, wherever the buffer began
    for i, n in enumerate(counts):
        if i > first and held + n > target:
            if held >= least:
                out.append((first, i, held))
            if held >= overlap:
                first, held = tail, in_tail
            else:
                first, held = i, 0
        held += n
        in_tail += n
        while tail <= i and in_tail - counts[tail] >= overlap:
            in_tail -= counts[tail]
            tail += 1
    if held >= least:
        out.append((first, len(counts), held))
    return out


def _bounds(target: int, overlap: int, least: int):
    kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            rows = [bounds(x, target, overlap, least) if x else [] for x in b.to_pylist()]
            yield pa.array([[{"a": a, "b": e, "n": n} for a, e, n in r] for r in rows], type=kind)

    return run


def chunks(docs: DataFrame, title: Column, section: Column, target: int = 200, overlap: int = 50, least: int = 50) -> DataFrame:
    """One row a chunk: chunk_id, chunk_index, total_chunks, text and word_count after the columns of ``docs`` without ``text``.

    A null or empty text has no chunks.
    """
    cols = [c for c in docs.columns if c != "text"]
    # what explode() returns is a column that later expressions don't compute again
    d = docs.select(*cols, title.alias("_title"), section.alias("_section"), F.explode(F.array(sentences(F.coalesce(F.col("text"), F.lit(""))))).alias("_s"))
    d = d.withColumn("_b", F.arrow_udf(_bounds(target, overlap, least), _BOUNDS)(F.transform("_s", word_count)))
    texts = F.transform("_b", lambda b: F.struct(F.array_join(F.slice("_s", b["a"] + 1, b["b"] - b["a"]), " ").alias("text"), b["n"].alias("word_count")))
    out = d.select(*cols, "_title", "_section", F.size("_b").alias("total_chunks"), F.posexplode(texts).alias("chunk_index", "_c"))
    chunk_id = F.substring(F.md5(F.concat_ws(":", "_title", "_section", F.col("chunk_index").cast("string"))), 1, 12)
    return out.select(*cols, "total_chunks", "chunk_index", F.col("_c.text").alias("text"), chunk_id.alias("chunk_id"), F.col("_c.word_count").alias("word_count"))
