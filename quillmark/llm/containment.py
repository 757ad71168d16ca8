"""Benchmark decontamination: size-partitioned MinHash containment search.

Items are partitioned by their number of 5-word shingles: class k holds those of 2**k to 2**(k+1) - 1.  A document's
shingles, in order, are cut for each class into blocks of 2**(k+1), and each two neighbouring blocks form a window, so
an item's passage lies in one window that is at most four times its size, however long the document is.  Windows and
items have MinHash signatures; one equal value makes a candidate.  With 64 values, an item contained by 0.8 (Jaccard
similarity of at least 0.16 with its window) is missed with probability below 2e-5.  Each candidate is verified: the
share of the item's distinct shingles that the whole document holds.

Items are a stated query set: they are sent to the executors in blocks of bounded rows and bytes, and every document is
compared with each block.  One block is searched on the way; several are searched one after the other, each dropped
before the next is sent, and their hits, keyed by the text's hashes, are joined back.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import U, mix, shingle_set, windows, word_hashes

SHINGLE = 5
CONTAINMENT = 0.8
PERMS = 64
#: A block of items has at most about so many rows and UTF-8 bytes.
BLOCK_ROWS, BLOCK_BYTES = 20_000, 16 << 20
_MULT = mix(np.arange(1, PERMS + 1, dtype=U) * U(0xD1B54A32D192ED03)) | U(1)
_ADD = mix(np.arange(1, PERMS + 1, dtype=U) * U(0x8CB92BA72F3D8DD7))
_PART = 1 << 14
FOUND = "array<struct<item_id: bigint, n_item: bigint, n_shared: bigint>>"


class ItemIndex:
    """Signatures of a block of items by size class, and their shingles for verification."""

    def __init__(self, items: list[tuple[int, str]]):
        self.sets = [(i, s) for i, t in items if len(s := shingle_set(t, SHINGLE))]
        every = [s for _, s in self.sets]
        self.sizes = np.array([len(s) for s in every], dtype=np.int64)
        self.classes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        kind = np.floor(np.log2(np.maximum(self.sizes, 1))).astype(int)
        for k in np.unique(kind) if len(every) else ():
            which = np.flatnonzero(kind == k)
            values = np.stack([minima(every[i]) for i in which])  # items x permutations
            self.classes[int(k)] = (which, values)
        self.lookup = {}
        for k, (which, values) in self.classes.items():
            # one sorted list of (value, item) for all permutations; a value tells its permutation apart by its own mixing
            flat, owner = values.ravel(), np.repeat(which, PERMS)
            order = np.argsort(flat, kind="stable")
            self.lookup[k] = (flat[order], owner[order])

    def search(self, text: str | None, threshold: float) -> list[tuple[int, int, int]]:
        """(item_id, item shingles, shared) of the items that ``text`` contains."""
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        words = word_hashes(data)
        if not len(words) or not self.sets:
            return []
        seq = windows(words, SHINGLE) if len(words) >= SHINGLE else shingle_set(text, SHINGLE)
        cand: set[int] = set()
        for k, values in self._window_minima(seq):
            flat, owner = self.lookup[k]
            v = np.unique(values)
            at = np.searchsorted(flat, v)
            at[at == len(flat)] = 0
            hit = v[flat[at] == v]
            if len(hit):
                lo, hi = np.searchsorted(flat, hit), np.searchsorted(flat, hit, side="right")
                for a, b in zip(lo, hi, strict=True):
                    cand.update(owner[a:b].tolist())
        if not cand:
            return []
        whole = np.unique(seq)
        out = []
        for i in sorted(cand):
            item, s = self.sets[i]
            at = np.searchsorted(whole, s)
            at[at == len(whole)] = 0
            shared = int((whole[at] == s).sum())
            if shared >= threshold * len(s):
                out.append((item, len(s), shared))
        return out

    def _window_minima(self, seq: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each class the windows' minima, permutations x windows.  Block minima are made once at the smallest size and doubled up."""
        if not self.classes:
            return
        small = min(self.classes)
        size = 1 << (small + 1)
        starts = np.arange(0, len(seq), size)
        blocks = np.empty((PERMS, len(starts)), dtype=U)
        per = max(1, _PART // size)
        for a in range(0, len(starts), per):
            part = seq[a * size : (a + per) * size]
            h = part[None, :] * _MULT[:, None]
            h += _ADD[:, None]
            blocks[:, a : a + per] = np.minimum.reduceat(h, np.arange(0, len(part), size), axis=1)
        for k in range(small, max(self.classes) + 1):
            if k > small:
                if blocks.shape[1] % 2:
                    blocks = np.concatenate((blocks, np.full((PERMS, 1), np.iinfo(U).max, dtype=U)), axis=1)
                blocks = np.minimum(blocks[:, ::2], blocks[:, 1::2])
            if k in self.classes:
                yield k, np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks


def minima(s: np.ndarray) -> np.ndarray:
    out = np.full(PERMS, np.iinfo(U).max, dtype=U)
    for at in range(0, len(s), _PART):
        np.minimum(out, (s[None, at : at + _PART] * _MULT[:, None] + _ADD[:, None]).min(axis=1), out=out)
    return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Blocks of items (item_id, text), collected one at a time."""
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    rows, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, math.ceil(rows / BLOCK_ROWS), math.ceil(size / BLOCK_BYTES))
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in part.collect()]


@lru_cache(maxsize=2)
def _index(key: int, sent: Broadcast) -> ItemIndex:
    """A block's index, made once a worker and not in each task."""
    return ItemIndex(sent.value)


def _searcher(sent: Broadcast, key: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = ("item_id", "n_item", "n_shared")
        kind = pa.list_(pa.struct([pa.field(x, pa.int64()) for x in names]))
        index = _index(key, sent)
        for texts in batches:
            rows = [[dict(zip(names, r, strict=True)) for r in index.search(t.as_py(), threshold)] for t in texts]
            yield pa.array(rows, type=kind)

    return run


def contained(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """``docs`` with an array column ``contaminated`` (underscores before the name where it is taken) of the items each contains.

    Null, empty and wordless texts contain nothing, and such items are in nothing; an item or document of fewer than
    five words is one shingle, its whole sequence.  Repeated items are each reported; a null item_id is reported as
    null; empty tables give no matches; other columns pass through.
    """
    sc = docs.sparkSession.sparkContext
    name, own, text = common.spare(docs, "contaminated"), common.private(docs), F.col("text").cast("string")
    blocks = _blocks(items)
    block, following = next(blocks), next(blocks, None)

    def search(block: list[tuple[int, str]]) -> tuple[Broadcast, Column]:
        sent = sc.broadcast(block)
        return sent, F.arrow_udf(_searcher(sent, uuid.uuid4().int, threshold), FOUND)(text)

    if following is None:
        return docs.withColumn(name, search(block)[1])
    keys = [f"{own}_h1", f"{own}_h2"]  # equal texts have equal hits
    keyed = {keys[0]: F.xxhash64(text), keys[1]: F.xxhash64(F.lit(1), text)}
    hits = []
    while block is not None:
        sent, found = search(block)
        part = docs.select(*[c.alias(k) for k, c in keyed.items()], found.alias("found"))
        hits.append(common.cut(part.where(F.size("found") > 0).dropDuplicates(keys), "containment-hits"))
        sent.destroy()
        block, following = following, next(blocks, None)
    every = hits[0]
    for h in hits[1:]:
        every = every.unionByName(h)
    every = common.cut(every.groupBy(*keys).agg(F.flatten(F.collect_list("found")).alias(f"{own}_found")), "containment-found")
    common.discard(*hits)
    out = docs.withColumns(keyed).join(every, keys, "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(f"{own}_found", F.array().cast(FOUND)).alias(name))


def op3_size_partitioned_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    hits = contained(common.documents(spark, sf_dir).select("doc_id", "text"), items)
    return hits.select("doc_id", F.explode("contaminated").alias("x")).select("doc_id", "x.*", (F.col("x.n_shared") / F.col("x.n_item")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, threshold: float = CONTAINMENT) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns; null, empty and wordless texts stay, repeated rows share a verdict."""
    name = common.spare(docs, "contaminated")
    return contained(docs, items, threshold).where(F.size(name) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
