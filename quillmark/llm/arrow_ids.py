"""Token ids in Arrow IPC files of fixed-size-list batches.

Documents are range-partitioned by doc_id; each partition's ids, an end id after each document, are packed into
sequences of equal length and written as one Arrow IPC file (the stream format plus the footer that gives random
access) with a column of ids and a column of masks, both fixed-size lists, uncompressed, so a reader maps any sequence
without copying.  The last sequence of a file is padded and masked there.  A second file beside it holds the documents'
places.  Files have names of their own for each attempt; a manifest written afterwards names those that count, so
retried or duplicated tasks do no harm.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SEQUENCE = 2048
END_ID = 2
#: Sequences in a record batch.
BATCH = 64
#: Distinct chunks whose ids a Python worker keeps, and the longest that it keeps.
TABLE, LONGEST = 800_000, 64
_CALL = 256  # chunks in a call of the library
_BYTES = 2 << 20  # texts encoded together

MANIFEST = "part int, file string, docs bigint, tokens bigint"
PLACES = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, file string, sequence bigint, offset int"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """The library's ids of whole texts, with the ids of frequent chunks kept.

    The byte-level pre-tokeniser never joins what stands before a space or newline that a non-space follows with what
    comes after, nor a letter with punctuation after it, so texts are cut there.  Texts that hold an added token's string are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        kind = type(self.tok.pre_tokenizer).__name__
        self.cuts = kind == "ByteLevel" and self.tok.normalizer is None and not getattr(self.tok.pre_tokenizer, "add_prefix_space", True)
        # chunks hold no added token, as texts with one are encoded whole
        plain = [t.content for t in self.tok.get_added_tokens_decoder().values() if not (t.lstrip or t.rstrip or t.single_word or t.normalized)]
        self.mark = plain[0] if plain else None
        self.table: dict[str, bytes] = {}

    def _bytes(self, text: str) -> bytes:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    @staticmethod
    def chunks(text: str) -> list[str]:
        out: list[str] = [""]

        def put(mark: str, p: str) -> None:
            if p[-1] in ".,;:!?" and p[-2:-1].isalpha():  # a letter run ends before punctuation
                out.append(mark + p[:-1])
                out.append(p[-1])
            else:
                out.append(mark + p)

        mark = ""
        for line in text.split("\n"):
            for p in line.split(" "):
                if p and not p[0].isspace():
                    put(mark, p)
                else:
                    out[-1] += mark + p
                mark = " "
            mark = "\n"
        return out

    def _encoded(self, chunks: list[str]) -> Iterator[tuple[str, bytes]]:
        """Each chunk with its ids.  An added token that strips nothing parts them in one text, which the library splits there first."""
        if self.mark is None:
            for c, e in zip(chunks, self.tok.encode_batch_fast(chunks, add_special_tokens=False), strict=True):
                yield c, np.array(e.ids, dtype=self.dtype).tobytes()
            return
        ids = np.array(self.tok.encode_batch_fast([self.mark.join(chunks)], add_special_tokens=False)[0].ids, dtype=self.dtype)
        ends, raw, width, at = np.flatnonzero(ids == self.tok.token_to_id(self.mark)).tolist(), ids.tobytes(), self.dtype.itemsize, 0
        for c, end in zip(chunks, [*ends, len(ids)], strict=True):
            yield c, raw[at * width : end * width]
            at = end + 1

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of some texts; chunks not in the table go to the library in batches, which costs far less than calls of their own."""
        if not self.cuts:
            return [self._bytes(t) if t else b"" for t in texts]
        whole = {k for k, t in enumerate(texts) if any(a in t for a in self.added)}
        cut = [[] if k in whole else self.chunks(t) for k, t in enumerate(texts)]
        table = self.table
        new = list({c for words in cut for c in words if c not in table})
        got = table
        if new:
            if len(table) + len(new) > TABLE:
                kept = {c: table[c] for words in cut for c in words if c in table}
                table.clear()
                got = kept
            extra = {}
            for at in range(0, len(new), _CALL):
                extra.update(self._encoded(new[at : at + _CALL]))
            if got is table:
                table.update((c, x) for c, x in extra.items() if len(c) <= LONGEST)
                look = table if all(len(c) <= LONGEST for c in new) else table | extra
            else:
                look = got | extra
                table.update((c, x) for c, x in look.items() if len(c) <= LONGEST and len(table) < TABLE)
        else:
            look = table
        return [(self._bytes(t) if k in whole else b"".join([look[c] for c in cut[k]])) for k, t in enumerate(texts)]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class _Writer:
    """Packs ids into sequences and writes both files of a partition."""

    def __init__(self, base: str, dtype: np.dtype, length: int):
        self.fs, path = common.filesystem(base)
        self.fs.create_dir(path, recursive=True)
        self.name = uuid.uuid4().hex
        self.length, self.dtype, self.value = length, dtype, pa.from_numpy_dtype(dtype)
        self.ids_type, self.mask_type = pa.list_(self.value, length), pa.list_(pa.bool_(), length)
        self.schema = pa.schema([("ids", self.ids_type), ("mask", self.mask_type)])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.sinks = [self.fs.open_output_stream(f"{path}/{self.name}{x}.arrow") for x in ("", ".index")]
        self.files = [pa.ipc.new_file(s, x) for s, x in zip(self.sinks, (self.schema, self.index), strict=True)]
        self.held, self.size, self.tokens, self.docs, self.places = [], 0, 0, 0, []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.places.append((doc_id, self.tokens, n))
        self.tokens, self.docs = self.tokens + n, self.docs + 1
        self.held.append(ids)
        self.size += n
        if self.size >= self.length * BATCH:
            self._flush(False)
        if len(self.places) >= 10_000:
            self._index()

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), dtype=self.dtype)
        # all batches but the last are full, so a sequence's batch follows from its number
        rows = -(-len(flat) // self.length) if last else len(flat) // (self.length * BATCH) * BATCH
        full, rest = flat[: rows * self.length], flat[rows * self.length :]
        for at in range(0, rows, BATCH):
            part = full[at * self.length : (at + BATCH) * self.length]
            k = -(-len(part) // self.length) * self.length
            ids, mask = np.zeros(k, dtype=self.dtype), np.zeros(k, dtype=bool)
            ids[: len(part)], mask[: len(part)] = part, True
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (ids, mask)]
            self.files[0].write_batch(pa.record_batch(columns, schema=self.schema))
        self.held, self.size = [rest.tobytes()], len(rest)

    def _index(self) -> None:
        columns = [pa.array([p[k] for p in self.places], type=pa.int64()) for k in range(3)]
        self.files[1].write_batch(pa.record_batch(columns, schema=self.index))
        self.places = []

    def close(self) -> str:
        self._flush(True)
        self._index()
        for f, s in zip(self.files, self.sinks, strict=True):
            f.close()
            s.close()
        return self.name


def write_ids(docs: DataFrame, base: str, tokenizer: str | None = None, length: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """Write the ids of ``docs`` under ``base`` (a URI that all executors reach) in ascending doc_id order; the manifest.

    Null and empty texts have the end id alone; a null doc_id comes first; rows with equal doc_ids follow each other by
    their texts' hashes; an empty table makes an empty manifest; other columns are left out.
    """
    tokenizer = tokenizer or default_tokenizer()
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("_h", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(tokenizer), None
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        held, size = [], 0

        def flush(w: _Writer) -> None:
            nonlocal size
            for (i, _), ids in zip(held, enc.encode_all([t for _, t in held]), strict=True):
                w.add(i, ids + end)
            held.clear()
            size = 0

        for b in batches:
            for i, t in zip(b.column(0), b.column(1), strict=True):
                out = out or _Writer(base, enc.dtype, length)
                held.append((i.as_py(), t.as_py() or ""))
                size += len(held[-1][1])
                if size >= _BYTES:
                    flush(out)
        if out:
            flush(out)
            name = out.close()
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([name]), pa.array([out.docs], pa.int64()), pa.array([out.tokens], pa.int64())], names=["part", "file", "docs", "tokens"])

    return common.cut(rows.mapInArrow(run, MANIFEST), "ids-manifest")


class IdFile:
    """Random access to one file pair; sequences and masks are views of the mapped file where it is local.

    Masks are Arrow's packed bits, an eighth of a byte a token, and are handed out as such without being unpacked.
    """

    def __init__(self, base: str, name: str):
        self.fs, path = common.filesystem(base)
        at = f"{path}/{name}"
        local = type(self.fs).__name__ == "LocalFileSystem"
        source = (lambda p: pa.memory_map(p)) if local else self.fs.open_input_file
        self.ids, self.index = pa.ipc.open_file(source(f"{at}.arrow")), pa.ipc.open_file(source(f"{at}.index.arrow"))
        self.length = self.ids.schema.field("ids").type.list_size

    def _batch(self, k: int) -> pa.RecordBatch:
        return self.ids.get_batch(k)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of the k-th sequence, both without a copy."""
        b, at = self._batch(k // BATCH), (k % BATCH) * self.length
        ids = b.column(0).flatten().to_numpy(zero_copy_only=True)[at : at + self.length]
        return ids, b.column(1).flatten().slice(at, self.length)

    def slice(self, start: int, n: int) -> np.ndarray:
        """The ids from ``start`` on, over as many batches as they take."""
        per, out = BATCH * self.length, []
        while n > 0:
            flat = self._batch(start // per).column(0).flatten().to_numpy(zero_copy_only=True)
            part = flat[start % per : start % per + n]
            if not len(part):
                raise ValueError("the file is shorter than its index says")
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out) if out else np.zeros(0, dtype=np.uint16)

    def documents(self) -> Iterator[tuple[int | None, int, int]]:
        for k in range(self.index.num_record_batches):
            b = self.index.get_batch(k)
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)


def read_places(manifest: DataFrame, base: str) -> DataFrame:
    """Per document, from the files: doc_id, start over all files, n_tokens, crc32 of its ids, file, first sequence and offset in it."""
    before = F.sum("tokens").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))  # a row a file
    files = manifest.withColumn("base", F.coalesce(before, F.lit(0))).select("part", "file", "base")
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32", "file", "sequence", "offset"]
        types = [pa.int64()] * 4 + [pa.string(), pa.int64(), pa.int32()]
        for b in batches:
            for _, name, base_at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f, rows = IdFile(base, name), []
                for doc_id, start, k in f.documents():
                    crc = zlib.crc32(f.slice(start, k).astype("<u4").tobytes())
                    rows.append((doc_id, base_at + start, k, crc, name, start // f.length, start % f.length))
                    if len(rows) == 10_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return files.repartition(n, "part").mapInArrow(run, PLACES)


def op4_arrow_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = common.fresh_path(spark, "token-ids")
    manifest = write_ids(common.documents(spark, sf_dir), base)
    return read_places(manifest, base)
