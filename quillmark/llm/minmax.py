"""MinHash near-dedup by min-max hashing.

Each permutation of the 64-bit shingle hashes gives two signature values, its minimum and its maximum, so a
signature of 252 values costs 126 hash evaluations a shingle.  36 bands of 7 values make candidates; a pair of
Jaccard similarity 0.85 shares a band with probability 1 - 9e-7.  Candidates are confirmed on full shingle sets.

Documents with equal sets are one class, known by the fingerprint of its set.  In each bucket every class is first
compared with one class, the pivot, on full sets; links make components.  Only buckets that then still hold several
components are looked at again.  Jaccard distance is a metric, so two members can only be linked if their distances
from the pivot differ by no more than the linking distance; and their set sizes must be alike.  Members are dealt into
cells by both, cells into blocks, large components into blocks of their own, and only blocks of neighbouring cells that
hold several components between them are compared, on full sets, a row a pair of blocks.  No candidate is capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .hashing import U, mix, shingle_set

BANDS, ROWS = 36, 7
PERMS = BANDS * ROWS // 2
THRESHOLD = 85
#: About so many classes and shingles are a block of the second pass; so many of a component in a cell have blocks of their own.
BLOCK, BLOCK_SHINGLES, LARGE = 512, 400_000, 64
#: Where so many rows are in mixed buckets, one bucket in so many goes first.
MIXED, EARLY = 50_000, 8
#: Distinct shingles compared at once there.
_COLUMNS = 1 << 13
_CHUNK = 4096
_MULT = mix(np.arange(1, PERMS + 1, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)
_ADD = mix(np.arange(1, PERMS + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F))
_BAND = mix(np.arange(1, 2 * PERMS + 1, dtype=U))

SIGNED = "struct<n: bigint, fp: binary, bands: array<bigint>>"


def signature(s: np.ndarray) -> np.ndarray:
    """The minima, then the maxima, of a non-empty set under all permutations."""
    lo = np.full(PERMS, np.iinfo(U).max, dtype=U)
    hi = np.zeros(PERMS, dtype=U)
    for at in range(0, len(s), _CHUNK):
        h = s[None, at : at + _CHUNK] * _MULT[:, None]
        h += _ADD[:, None]
        np.minimum(lo, h.min(axis=1), out=lo)
        np.maximum(hi, h.max(axis=1), out=hi)
    return np.concatenate((lo, hi))


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    values = sig.reshape(-1, rows)
    key = _BAND[: len(values)].copy()
    for k in range(rows):
        key = mix(key * U(0x9E3779B97F4A7C15) + values[:, k])
    return key.view(np.int64)


def _fingerprint(s: np.ndarray) -> bytes:
    two = np.array([mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U), mix(s + U(0x5851F42D4C957F2D)).sum(dtype=U)], dtype=U)
    return two.tobytes()


def _signer(rows: int):
    def _signed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            n, fp, bands = [], [], []
            for t in texts:
                s = shingle_set(t.as_py())
                n.append(len(s))
                fp.append(_fingerprint(s) if len(s) else None)
                bands.append(band_keys(signature(s), rows) if len(s) else None)
            lists = pa.array(bands, type=pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([pa.array(n, type=pa.int64()), pa.array(fp, type=pa.binary()), lists], names=["n", "fp", "bands"])

    return _signed


def _sets(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([shingle_set(t.as_py()).view(np.int64) for t in texts], type=pa.list_(pa.int64()))


def _sets_of(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """fp, s: the full sets of the classes ``ids`` (fp), each once, from its first document's text."""
    wanted = common.cut(ids.join(classes.select("fp", "doc_id", "text_hash"), "fp"), "dedup-wanted")
    texts = docs.join(common.small(wanted), ["doc_id", "text_hash"]).select("fp", "text").dropDuplicates(["fp"])
    sets = common.cut(texts.select("fp", F.arrow_udf(_sets, "array<bigint>")("text").alias("s")), "dedup-sets")
    common.discard(wanted)
    return sets


def _compared(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of what they share."""
    sets = _sets_of(pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct(), classes, docs)
    left = pairs.join(sets.select(F.col("fp").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("fp").alias("b"), F.col("s").alias("sb")), "b")
    out = common.cut(both.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("shared")), "dedup-compared")
    common.discard(sets)
    return out


def _linked(threshold: int) -> Column:
    return 100 * F.col("shared") >= threshold * (F.col("na") + F.col("nb") - F.col("shared"))


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many values each of ``left`` shares with each of ``right``; only values that stand on both sides are compared."""
    a, b = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(a, b)
    out = np.zeros((len(left), len(right)), dtype=np.float32)
    side = []
    for sets, flat in ((left, a), (right, b)):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, flat), max(len(both) - 1, 0))
        hit = both[at] == flat if len(both) else np.zeros(len(flat), dtype=bool)
        side.append((owner[hit], at[hit], len(sets)))
    for at in range(0, len(both), _COLUMNS):
        width = min(_COLUMNS, len(both) - at)
        has = []
        for owner, column, n in side:
            here = (column >= at) & (column < at + width)
            m = np.zeros((n, width), dtype=np.float32)
            m[owner[here], column[here] - at] = 1
            has.append(m)
        out += has[0] @ has[1].T
    return out


def _block(docs: pa.StructArray) -> tuple[list[bytes], list[bytes], list[np.ndarray]]:
    """Fingerprints, labels and sets of a block's classes."""
    s = docs.field("s")
    flat, ends = s.values.to_numpy(zero_copy_only=False), s.offsets.to_numpy()
    return docs.field("fp").to_pylist(), docs.field("label").to_pylist(), [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def block_links(left: tuple, right: tuple, threshold: int) -> list[tuple[bytes, bytes]]:
    """Links between classes (fingerprints, labels, sets) of different labels that join what is apart so far; a spanning forest of them, not all."""
    (fa, la, sa), (fb, lb, sb) = left, right
    shared = _shared(sa, sb)
    na, nb = np.array([len(s) for s in sa]), np.array([len(s) for s in sb])
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while x in root:
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(100 * shared >= threshold * (na[:, None] + nb[None, :] - shared)), strict=True):
        a, b = find(la[i]), find(lb[j])
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((fa[i], fb[j]))
    return out


def _across(named: DataFrame, classes: DataFrame, docs: DataFrame, threshold: int) -> DataFrame | None:
    """Links across the components of mixed buckets, from ``named`` (key, fp, n, label, distance from the pivot); None where nothing is to be compared."""
    # the small factor keeps rounding from parting neighbours
    far, narrow = (1 - threshold / 100) * 1.0001, math.log(100 / threshold) * 1.0001
    cell = named.withColumn("dc", F.floor(F.col("distance") / far).cast("int")).withColumn("nc", F.floor(F.log("n") / narrow).cast("int"))
    parts = cell.groupBy("key", "dc", "nc", "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    own = F.when(F.col("c") >= LARGE, F.col("label"))
    parts = parts.withColumn("own", own).select("key", "dc", "nc", "label", "own", "c", "w")
    groups = parts.groupBy("key", "dc", "nc", "own").agg(F.sum("c").alias("c"), F.sum("w").alias("w"))
    blocks = F.greatest(F.ceil(F.col("c") / BLOCK), F.ceil(F.col("w") / BLOCK_SHINGLES)).alias("blocks")
    same = ["key", "dc", "nc"]
    dealt = cell.join(parts.select(*same, "label", "own"), [*same, "label"])
    g = groups.select(*[F.col(c).alias(f"g_{c}") for c in same], F.col("own").alias("g_own"), blocks)
    on = [F.col(c) == F.col(f"g_{c}") for c in same] + [F.col("own").eqNullSafe(F.col("g_own"))]
    where = F.struct("key", "dc", "nc", "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).alias("k"))
    # a block is known by a hash of its place; a clash would only make a block larger
    dealt = common.cut(dealt.join(g, on).select("key", "dc", "nc", "fp", "label", F.xxhash64(where).alias("block")), "dedup-dealt")
    seen = dealt.groupBy("key", "dc", "nc", "block").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    x, y = seen.alias("x"), seen.alias("y")
    near = (F.col("x.key") == F.col("y.key")) & (F.abs(F.col("x.dc") - F.col("y.dc")) <= 1) & (F.abs(F.col("x.nc") - F.col("y.nc")) <= 1)
    several = F.least("x.lo", "y.lo") != F.greatest("x.hi", "y.hi")
    two = x.join(y, near & (F.col("x.block") <= F.col("y.block")) & several)
    two = common.cut(two.select(F.col("x.block").alias("i"), F.col("y.block").alias("j")), "dedup-two")
    used = common.cut(two.select(F.col("i").alias("block")).union(two.select("j")).distinct(), "dedup-used")
    if used.isEmpty():
        common.discard(dealt, two, used)
        return None
    held = common.cut(dealt.join(used, "block", "left_semi").select("block", "fp", "label").distinct(), "dedup-held")
    sets = _sets_of(held.select("fp").distinct(), classes, docs)
    filled = common.cut(held.join(sets, "fp").groupBy("block").agg(F.collect_list(F.struct("fp", "label", "s")).alias("docs")), "dedup-blocks")
    pairs = two.join(filled.select(F.col("block").alias("i"), F.col("docs").alias("a")), "i").join(filled.select(F.col("block").alias("j"), F.col("docs").alias("b")), "j")
    kind = pa.list_(pa.struct([pa.field("a", pa.binary()), pa.field("b", pa.binary())]))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            rows = [block_links(_block(a.values), _block(b.values), threshold) for a, b in zip(left, right, strict=True)]
            yield pa.array([[{"a": a, "b": b} for a, b in r] for r in rows], type=kind)

    with common.batch_rows(docs.sparkSession, 4):
        found = pairs.select(F.explode(F.arrow_udf(run, "array<struct<a: binary, b: binary>>")("a", "b")).alias("l"))
        out = common.cut(found.select("l.a", "l.b").distinct(), "dedup-across")
    common.discard(dealt, two, used, held, sets, filled)
    return out


def _mixed(members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members`` (key, fp, n, pivot) with labels; and key, members of the buckets that hold several components."""
    named = members.join(labels, members["fp"] == labels["node"], "left").select("key", "fp", "n", "pivot", F.coalesce("label", "fp").alias("label"))
    named = common.cut(named, "dedup-named")
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("members"))
    # of two members the pivot has settled the only pair
    return named, common.cut(mixed.where("lo <> hi and members > 2").select("key", "members"), "dedup-mixed")


def components(links: DataFrame) -> DataFrame:
    """node, label (smallest node it reaches) for every node of ``links`` (a, b).

    Each round takes the smallest label among a node's neighbours and then that label's own label; tables are
    written between rounds, so joins read plain tables and AQE can split a hot label.
    """
    both = common.cut(links.select("a", "b").union(links.select("b", "a")).distinct(), "dedup-edges")
    labels = common.cut(both.groupBy("a").agg(F.min(F.least("a", "b")).alias("label")).withColumnRenamed("a", "node"), "dedup-labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        stepped = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        stepped = common.cut(stepped, "dedup-step")
        up = stepped.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        jumped = common.cut(stepped.join(up, "label").select("node", F.least("label", "upper").alias("label"), "old"), "dedup-labels")
        done = jumped.where("label <> old").isEmpty()
        common.discard(labels, stepped)
        labels = jumped.select("node", "label")
        if done:
            common.discard(both)
            return labels


def grouped(docs: DataFrame, threshold: int = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id and rep_hash for each row of ``docs``.

    A component is known by the smallest (doc_id, text_hash) of its rows, so texts that share a doc_id stay apart.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    sig = docs.select("doc_id", "text_hash", F.arrow_udf(_signer(rows), SIGNED)("text").alias("x")).select("doc_id", "text_hash", "x.*")
    sig = common.cut(sig, "dedup-signatures")
    linked = sig.where("n > 0 and doc_id is not null")
    classes = linked.groupBy("fp").agg(F.min(F.struct("doc_id", "text_hash", "n", "bands")).alias("x"), F.count("*").alias("copies"))
    classes = common.cut(classes.select("fp", "x.*", "copies"), "dedup-classes")
    buckets = classes.select("fp", "n", F.explode("bands").alias("key"))
    shared = common.cut(buckets.groupBy("key").agg(F.min("fp").alias("pivot"), F.count("*").alias("members")).where("members > 1").select("key", "pivot"), "dedup-pivots")
    members = common.cut(buckets.join(shared, "key"), "dedup-members")

    pairs = common.cut(members.where("fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b")).distinct(), "dedup-pairs")
    compared = _compared(pairs, classes, docs)
    links = compared.where(_linked(threshold)).select("a", "b")
    labels = components(links)

    # buckets that still hold several components: links across them that no pivot has shown; where many rows are mixed, first
    # those of some buckets, whose links leave most of the others with one component
    early = F.pmod(F.xxhash64("key"), F.lit(EARLY)) == 0
    named, mixed = _mixed(members, labels)
    used, rows_mixed = [shared, pairs, named, mixed], mixed.agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]
    rounds = [early, ~early] if rows_mixed > MIXED else [F.lit(True)] if rows_mixed else []
    for k, part in enumerate(rounds):
        if k:
            named, mixed = _mixed(members, labels)
            used += [named, mixed]
        # the pivot itself is settled
        rest = named.where("fp <> pivot").join(mixed.where(part).select("key"), "key").join(compared.select(F.col("a").alias("fp"), F.col("b").alias("pivot"), "nb", "shared"), ["fp", "pivot"])
        rest = rest.withColumn("distance", 1 - F.col("shared") / (F.col("n") + F.col("nb") - F.col("shared")))
        more = _across(rest.select("key", "fp", "n", "label", "distance"), classes, docs, threshold)
        if more is not None:
            links, before = links.union(more), labels
            labels = components(links)
            common.discard(before)
            used.append(more)

    # classes that are alone and have one row need no entry
    named_class = classes.join(labels, classes["fp"] == labels["node"], "left").where("copies > 1 or label is not null").select("fp", "doc_id", "text_hash", F.coalesce("label", "fp").alias("label"))
    named_class = common.cut(named_class, "dedup-labelled")
    tops = named_class.groupBy("label").agg(F.min(F.struct("doc_id", "text_hash")).alias("top"))
    reps = common.cut(named_class.join(tops, "label").select("fp", F.col("top.doc_id").alias("component"), F.col("top.text_hash").alias("rep_hash")), "dedup-components")
    common.discard(*used, members, compared, labels, named_class, classes)

    cols = ["doc_id", "text_hash", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("rep_hash", "text_hash").alias("rep_hash")]
    # rows without links don't take part in the join: they would all have the same key
    some = linked.join(reps, "fp", "left").select(*cols)
    none = sig.where("n = 0 or doc_id is null").withColumn("component", F.lit(None).cast("long")).withColumn("rep_hash", F.lit(None).cast("long"))
    return some.unionByName(none.select(*cols))


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept for each row of ``docs`` (doc_id, text).

    Null, empty and wordless texts have no shingles and no links; so have rows with a null doc_id, which are kept
    with a null component_id.  Rows that repeat a doc_id are each returned, linked by their own texts; kept holds for each
    row whose doc_id is its component's.  Other columns are left out; an empty table gives no rows.  ``rows``, a divisor
    of 252, is the number of signature values in a band.
    """
    out = grouped(docs, threshold, rows).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir))


def drop_near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, rows: int = ROWS) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns: of each group one row, its first by doc_id and then the text's hash.

    Rows with equal doc_id and text are copies too: one of them stays, whichever columns it has beside.  Rows without words
    or doc_id all stay; a text stays whatever becomes of another one of its doc_id; an empty table gives an empty table.
    """
    own = common.private(docs)
    rows_ = grouped(docs, threshold, rows).where("n_shingles > 0 and doc_id is not null")
    rows_ = rows_.groupBy("doc_id", "text_hash").agg(F.first("component_id").alias("c"), F.first("rep_hash").alias("r"), F.count("*").alias("n"))
    rows_ = rows_.where("doc_id <> c or text_hash <> r or n > 1").select(F.col("doc_id").alias(f"{own}_id"), F.col("text_hash").alias(f"{own}_hash"), ((F.col("doc_id") != F.col("c")) | (F.col("text_hash") != F.col("r"))).alias(f"{own}_gone"))
    marked = common.cut(rows_, "dedup-marked")
    gone, repeated = marked.where(f"{own}_gone"), marked.where(f"not {own}_gone")
    keyed = docs.withColumn(f"{own}_key", F.col("doc_id").cast("long")).withColumn(f"{own}_text", F.xxhash64(F.col("text").cast("string")))

    def same(other: DataFrame) -> Column:
        return (keyed[f"{own}_key"] == other[f"{own}_id"]) & (keyed[f"{own}_text"] == other[f"{own}_hash"])

    # marks are ids: while they are few no text moves, whatever the session's own bound for broadcasts
    gone, repeated = common.small(gone), common.small(repeated)
    out = keyed.join(gone, same(gone), "left_anti")
    if not repeated.isEmpty():
        keyed = out
        once = out.join(repeated, same(repeated), "left_semi").dropDuplicates([f"{own}_key", f"{own}_text"])
        out = out.join(repeated, same(repeated), "left_anti").unionByName(once)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
