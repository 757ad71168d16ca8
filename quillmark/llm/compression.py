"""Quality rules: compression bands.

The ratio raw size / zstandard size of a whole document, and of each fixed chunk of it, must lie in a band that
depends on the length: repetitive text compresses too well, incompressible text hardly at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import windows, word_hashes

LEVEL = 3
CHUNK = 4096
#: (up to so many UTF-8 bytes, lowest ratio, highest ratio) for whole documents.
BANDS = (
    (256, 0.70, 2.2),
    (512, 0.95, 2.5),
    (1024, 1.10, 2.8),
    (2048, 1.20, 3.2),
    (4096, 1.30, 3.4),
    (16384, 1.45, 3.8),
    (65536, 1.55, 4.2),
    (float("inf"), 1.60, 4.6),
)
#: Shorter documents are cut into shorter chunks; below the least size there is nothing to cut.
SHORT, SHORT_CHUNK, LEAST = 2 * CHUNK, 1024, 2048
#: A last chunk from so many bytes on is judged too.  A chunk's band is that of a document of its size.
LAST = 256
#: Of a document's chunks so great a share may lie outside.
CHUNK_SHARE = 0.34

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, ratio double, n_chunks bigint, n_chunks_out bigint, base_failed boolean, kept boolean"


def _repeat_words(h: np.ndarray) -> int:
    """Words in 5-word windows that occur twice or more."""
    if len(h) < 6:
        return 0
    _, inverse, counts = np.unique(windows(h), return_inverse=True, return_counts=True)
    if counts.max() < 2:
        return 0
    delta = np.zeros(len(h) + 1, dtype=np.int64)
    hit = np.flatnonzero(counts[inverse] > 1)
    np.add.at(delta, hit, 1)
    np.add.at(delta, hit + 5, -1)
    return int((np.cumsum(delta[:-1]) > 0).sum())


def _dup_lines(text: str) -> int:
    seen, n = set(), 0
    if "\n" not in text:
        return 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def in_band(size: int, ratio: float, bands=BANDS) -> bool:
    return next(lo <= ratio <= hi for top, lo, hi in bands if size <= top)


def pieces(data: bytes) -> Iterator[bytes]:
    """The chunks that are judged: of fixed size, and the rest if it is long enough; of documents below ``LEAST`` bytes none."""
    if len(data) >= LEAST:
        size = CHUNK if len(data) >= SHORT else SHORT_CHUNK
        for at in range(0, len(data), size):
            if min(size, len(data) - at) >= LAST:
                yield data[at : at + size]


def measure(text: str | None, zstd: zstandard.ZstdCompressor) -> tuple:
    """The measures of one text and the verdict (see ``quality``)."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    h = word_hashes(data)
    n_words, repeat = len(h), _repeat_words(h)
    chars = len(text) - sum(text.count(c) for c in " \t\n\x0b\x0c\r")
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    ratio = len(data) / len(zstd.compress(data)) if data else 0.0
    chunks = out = 0
    for part in pieces(data):
        chunks += 1
        out += not in_band(len(part), len(part) / len(zstd.compress(part)))
    failed = n_words < 10 or 100 * repeat > 20 * n_words
    kept = not failed and in_band(len(data), ratio) and out <= CHUNK_SHARE * chunks
    return n_words, chars, symbols, _dup_lines(text), repeat, ratio, chunks, out, failed, kept


def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    zstd = zstandard.ZstdCompressor(level=LEVEL)
    fields = [pa.field(x.split()[0], {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]]) for x in BASE.split(", ")]
    for texts in batches:
        rows = [measure(t.as_py(), zstd) for t in texts]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(fields)], fields=fields)


RESULT = "struct<" + ", ".join(x.replace(" ", ": ") for x in BASE.split(", ")) + ">"


def quality(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` (underscores before the name where it is taken).

    Null and empty texts have no words, fail the base rule and aren't kept; equal rows get equal verdicts; an empty
    table gives an empty table; other columns pass through.  Chunks are cut by bytes.
    """
    return docs.withColumn(common.spare(docs, "quality"), F.arrow_udf(_measured, RESULT)(F.col(text_col).cast("string")))


def op1_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quality(common.documents(spark, sf_dir).select("doc_id", "text"))
    return q.select("doc_id", "quality.*")


def keep_quality(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns; null and empty texts go, repeated rows share a verdict."""
    name = common.spare(docs, "quality")
    return quality(docs).where(F.col(name)["kept"]).select(*[F.col(f"`{c}`") for c in docs.columns])
