"""Embeddings of texts: hashed word weights as column expressions, or a model in an Arrow UDF."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

DIMENSIONS = 384


def hashed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Signed word counts by md5, dampened and of length 1; zeros for a text without words.  Nothing leaves the row."""
    h = F.transform(words(F.lower(F.coalesce(text, F.lit("")))), lambda w: F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("long"))

    def weighted(hs: Column) -> Column:
        slots = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda d: F.aggregate(F.filter(hs, lambda x: F.floor(x / 2) % dimensions == d), F.lit(0.0), lambda a, x: a + F.when(x % 2 == 0, 1.0).otherwise(-1.0)))
        return F.transform(slots, lambda v: F.signum(v) * F.log1p(F.abs(v)))

    def unit(v: Column) -> Column:
        norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(norm), lambda n: F.transform(v, lambda x: F.when(n > 0, x / n).otherwise(0.0).cast("float")))[0]

    # an array of one element passes its value on without computing it again
    return F.transform(F.transform(F.array(h), weighted), unit)[0]


def modelled(text: Column, load: Callable[[], Callable[[list[str]], list]], batch: int = 32) -> Column:
    """Vectors of a model that ``load`` makes once a task, from batches of texts, scaled to length 1; null texts are empty ones."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for b in batches:
            texts, out = [t or "" for t in b.to_pylist()], []
            for at in range(0, len(texts), batch):
                for v in encode(texts[at : at + batch]):
                    norm = sum(x * x for x in v) ** 0.5
                    out.append([x / norm for x in v] if norm else list(v))
            yield pa.array(out, pa.list_(pa.float32()))

    return F.arrow_udf(run, "array<float>")(text)


def embedded(df: DataFrame, dimensions: int = DIMENSIONS, text: str = "text") -> DataFrame:
    """``df`` with ``embedding``, made once a row."""
    return df.select("*", F.explode(F.array(hashed(F.col(text), dimensions))).alias("embedding"))


def appended(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """``index`` with further chunks of the same columns; each keeps its embedding in its own row."""
    return index.unionByName(chunks.select(*index.columns))
