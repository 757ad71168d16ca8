"""Helpers that the corpus operators share."""

from __future__ import annotations


from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, fresh_path, read, shared_dir

__all__ = ["cut", "fresh_path", "shared_dir"]

#: A word is a run of anything but the space and the controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


def filesystem(uri: str):
    """The Arrow file system of a folder's URI, for workers, and the path in it."""
    from pyarrow import fs

    if uri.startswith("s3a:"):
        uri = "s3:" + uri[4:]
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames made by ``cut`` once nothing reads them any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        for f in df.inputFiles()[:1]:
            p = jvm.org.apache.hadoop.fs.Path(f).getParent()
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


#: Rows of a few numbers or short hashes each (under 10 MB) that may be broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df``, a written table of short rows of fixed width, marked for a broadcast if it has at most ``SMALL_ROWS`` rows, else for a shuffled hash join."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df.hint("shuffle_hash")


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of ``n`` rows for the actions inside: for rows that are large each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of rows that a Python worker gets at once; a larger row goes alone.
BATCH_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of ``BATCH_BYTES`` at most, or fewer where the session has fewer, from now on.

    A batch is held in several buffers, by the executor and by the worker, and each of them keeps what it once took;
    10,000 rows of whole texts, Spark's own bound, are up to 64 MB a buffer.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, f"{BATCH_BYTES}b"))
    spark.conf.set(key, f"{min(have, BATCH_BYTES)}b")


def spare(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = "_" + name
    return name


def private(df: DataFrame) -> str:
    """A beginning that no column name of ``df`` has, for columns of an operator's own."""
    own = "_q"
    while any(c.lower().startswith(own) for c in df.columns):
        own = "_" + own
    return own


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of an array of structs (start, rank, end, kind), by start and then by the kind's rank."""
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


SPAN = "array<struct<start:int,rank:int,end:int,kind:string,s:string>>"


def find_spans(text: Column, matches: Column, pattern: str, kind: str, rank: int, keep=None) -> Column:
    """Spans (code points, end exclusive) of the ``matches`` that ``pattern`` has in ``text``.

    The pieces between matches come from ``split`` by the same pattern, so both lists follow one leftmost,
    non-overlapping scan; a running sum of their lengths gives the positions.  Blocks of 128 matches keep
    the growing list short in texts with very many.  ``keep`` (string column -> boolean) drops failing matches.
    """
    gaps = F.split(text, pattern, -1)
    state = "struct<at:int,out:array<struct<start:int,rank:int,end:int,kind:string,s:string>>>"

    def block(outer: Column, k: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            m = F.element_at(matches, i)
            a = acc["at"] + F.length(F.element_at(gaps, i))
            b = a + F.length(m)
            one = F.array(F.struct(a.alias("start"), F.lit(rank).alias("rank"), b.alias("end"), F.lit(kind).alias("kind"), m.alias("s")))
            return F.struct(b.alias("at"), F.concat(acc["out"], one).alias("out")).cast(state)

        first = F.struct(outer["at"].alias("at"), F.array().cast(SPAN).alias("out")).cast(state)
        done = F.aggregate(F.sequence(k * 128 + 1, F.least(F.size(matches), (k + 1) * 128)), first, step)
        return F.transform(F.array(done), lambda d: F.struct(d["at"].alias("at"), F.concat(outer["out"], d["out"]).alias("out")).cast(state))[0]

    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")).cast(state)
    spans = F.aggregate(F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / 128).cast("int")), start, block, lambda s: s["out"])
    if keep is not None:
        spans = F.filter(spans, lambda x: keep(x["s"]))
    return F.when(F.size(matches) > 0, spans).otherwise(F.array().cast(SPAN))
