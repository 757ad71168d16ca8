"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece of the model holds a space mark after another character, no merge can cross the start of a marked
word.  So texts are cut into marked words (a run of marks and what follows up to the next mark).  The distinct words of
all texts, counted within each partition before they are shuffled, make a table in which the library segments each word
once; ids are joined back by a word's position in its text.  The words that most texts use, at most ``HOT``, are a file
that every worker loads, so they are never shuffled with the texts.  The rare others are either segmented where they
stand, each once for a run of texts (``rare="segment"``, the table then holds frequent words only), or taken from the
table by a join (``rare="join"``), which moves several times the input where most words are rare.  Models whose pieces or
normalisation don't allow the cut are found when the model is loaded; their texts are encoded whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that every worker holds, and the longest of them; the others are joined.
HOT, LONGEST = 300_000, 64
#: Distinct words that a worker counts before it passes them on.
_COUNTED = 300_000
#: Characters of texts whose rare words are segmented together.
_RUN = 1 << 20
MARK = "▁"
#: Number of ids, the ids as text, the decoded text after one space.
Entry = tuple[int, str, str]
_ENTRY = "n: bigint, ids: string, decoded: string"
_KEY = ["h1", "h2"]


class ChunkCodec:
    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        inside = any(MARK in p.lstrip(MARK) for p in pieces)
        # the space is marked and doubled or trailing ones stay; nothing else is rewritten
        probes = ("a  b ", " a", "a\tb", "ﬁ½ Ａ", "é​", " x")
        plain = all(self.sp.decode(self.sp.encode(p)) == p for p in probes) and self.sp.encode("a", out_type=str)[0].startswith(MARK)
        self.cuts = not inside and plain

    def segment(self, word: str) -> Entry:
        """The entry of a word whose first mark is left out, or of a whole text where the model allows no cuts."""
        return self.segment_all([word])[0]

    def segment_all(self, words: list[str]) -> list[Entry]:
        ids = self.sp.encode(words, num_threads=1)
        if self.cuts:  # a mark alone; the library would add none to an empty text
            ids = [x if w else [self.sp.piece_to_id(MARK)] for x, w in zip(ids, words, strict=True)]
        decoded = self.sp.decode(ids, num_threads=1) if ids else []
        return [(len(x), ",".join(map(str, x)), d) for x, d in zip(ids, decoded, strict=True)]

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Marked words, each without its first mark.  U+2581 in a text is a mark too."""
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts
        out: list[str] = []
        lead = ""
        for part in parts:
            if part:
                out.append(lead + part)
                lead = ""
            else:
                lead += " "
        if lead:  # marks at the end, with no word
            out.append(lead[1:])
        return out

    def whole(self, found: list[Entry]) -> Entry:
        """The entry of a text from those of its words, in order."""
        # the library drops the first mark when it decodes; each further word gets its own back
        return sum([x[0] for x in found]), ",".join([x[1] for x in found if x[0]]), " ".join([x[2] for x in found])

    def encode_decode(self, text: str, *tables: dict[str, Entry]) -> Entry | list[str]:
        """The entry of a whole text, put together by position from the tables; or the distinct words that none of them has."""
        if not text:
            return 0, "", ""
        if not self.cuts:
            return self.segment(text)
        words = self.chunks(text)
        found = list(map(tables[0].get, words))
        if None in found:
            for table in tables[1:]:
                found = [x or table.get(w) for x, w in zip(found, words, strict=True)]
            if None in found:
                return list({w for x, w in zip(found, words, strict=True) if x is None})
        return self.whole(found)

    def encode_decode_all(self, texts: list[str], table: dict[str, Entry]) -> list[Entry]:
        """The entries of some texts; each distinct word that the table has not is segmented once for all of them."""
        if not self.cuts:
            return [self.segment(t) if t else (0, "", "") for t in texts]
        cut = [self.chunks(t) if t else [] for t in texts]
        found = [list(map(table.get, words)) for words in cut]
        rare = list({w for words, x in zip(cut, found, strict=True) if None in x for w, e in zip(words, x, strict=True) if e is None})
        more = dict(zip(rare, self.segment_all(rare), strict=True))
        return [self.whole(x if None not in x else [e or more[w] for e, w in zip(x, words, strict=True)]) if words else (0, "", "") for x, words in zip(found, cut, strict=True)]


@lru_cache(maxsize=2)
def codec(model: str) -> ChunkCodec:
    return ChunkCodec(model)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


# -- the table -------------------------------------------------------------------------------------------------------


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, uses: in how many texts each distinct word stands, in parts."""
    seen: Counter[str] = Counter()

    def out() -> Iterator[pa.RecordBatch]:
        words, uses = list(seen), list(seen.values())
        seen.clear()
        for at in range(0, len(words), 50_000):
            yield pa.record_batch([pa.array(words[at : at + 50_000], pa.string()), pa.array(uses[at : at + 50_000], pa.int64())], names=["word", "uses"])

    for b in batches:
        for t in b.column(0).to_pylist():
            if t:
                seen.update(set(ChunkCodec.chunks(t)))
                if len(seen) > _COUNTED:
                    yield from out()
    yield from out()


def counted(texts: DataFrame) -> DataFrame:
    """word, uses: each distinct marked word of ``texts`` (text) and the number of rows that hold it."""
    return texts.where("text is not null").mapInArrow(_counted, "word string, uses bigint").groupBy("word").agg(F.sum("uses").alias("uses"))


def segmented(words: DataFrame, model: str) -> DataFrame:
    """word, uses, n, ids, decoded: ``words`` (word, uses), each segmented once, in the shared folder."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(model)
        for b in batches:
            rows = c.segment_all(b.to_pylist())
            yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["n", "ids", "decoded"])

    return common.cut(words.select("word", "uses", F.arrow_udf(run, f"struct<{_ENTRY}>")("word").alias("e")).select("word", "uses", "e.*"), "pieces-table")


def _frequent(words: DataFrame, most: int) -> tuple[Column, bool]:
    """The condition that the words of the highest use classes (powers of two) meet, ``most`` at most, and whether those are all words."""
    short = F.length("word") <= LONGEST
    classes = words.groupBy(F.floor(F.log2("uses")).alias("c"), short.alias("short")).agg(F.count("*").alias("n")).collect()  # some dozens of rows
    total, limit = 0, None
    for c in sorted({r.c for r in classes}, reverse=True):
        total += sum(r.n for r in classes if r.c == c and r.short)
        if total > most:
            break
        limit = c
    whole = total <= most and all(r.short for r in classes)
    return (short & (F.col("uses") >= 2**limit) if limit is not None else F.lit(False)), whole


@lru_cache(maxsize=1)
def _loaded(path: str) -> dict[str, Entry]:
    """The hot words, read once a worker."""
    from pyarrow import dataset

    store, at = common.filesystem(path)
    out: dict[str, Entry] = {}
    for b in dataset.dataset(at, filesystem=store, format="parquet").to_batches():
        columns = [c.to_pylist() for c in b.columns]
        out.update(zip(columns[0], zip(*columns[1:], strict=True), strict=True))
    return out


# -- texts -----------------------------------------------------------------------------------------------------------

DIGEST = "struct<n_tokens: bigint, ids_sha256: string, decoded_sha256: string>"
IDS = "array<int>"


def _digest(e: Entry) -> dict:
    return {"n_tokens": e[0], "ids_sha256": hashlib.sha256(e[1].encode()).hexdigest(), "decoded_sha256": hashlib.sha256(e[2].encode("utf-8", "surrogatepass")).hexdigest()}


def _ids(e: Entry) -> list[int]:
    return [int(i) for i in e[1].split(",")] if e[1] else []


_RESULTS = {
    DIGEST: (_digest, pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])),
    IDS: (_ids, pa.list_(pa.int32())),
}


def _first(model: str, hot: str, kind: str):
    """From texts: the result, or null and the words that aren't hot."""
    result, arrow = _RESULTS[kind]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c, table = codec(model), _loaded(hot)
        for texts in batches:
            out = [c.encode_decode(t or "", table) for t in texts.to_pylist()]
            done = pa.array([result(x) if isinstance(x, tuple) else None for x in out], arrow)
            yield pa.StructArray.from_arrays([done, pa.array([None if isinstance(x, tuple) else x for x in out], pa.list_(pa.string()))], names=["done", "missing"])

    return F.arrow_udf(run, f"struct<done: {kind}, missing: array<string>>")


def _here(model: str, hot: str | None, kind: str):
    """From texts: the result; words that aren't hot are segmented here, once for a run of texts."""
    result, arrow = _RESULTS[kind]

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c, table = codec(model), _loaded(hot) if hot else {}
        for texts in batches:
            out, rows, held, size = [], texts.to_pylist(), [], 0
            for k, t in enumerate(rows):
                held.append(t or "")
                size += len(held[-1])
                if size >= _RUN or k == len(rows) - 1:
                    out += map(result, c.encode_decode_all(held, table))
                    held, size = [], 0
            yield pa.array(out, arrow)

    return F.arrow_udf(run, kind)


def _second(model: str, hot: str, kind: str):
    """From texts and the entries of their other words: the result."""
    result, arrow = _RESULTS[kind]

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        c, table = codec(model), _loaded(hot)
        for texts, extras in batches:
            out = []
            for t, x in zip(texts.to_pylist(), extras, strict=True):
                more = {e["word"]: (e["n"], e["ids"], e["decoded"]) for e in x.as_py()}
                out.append(result(c.encode_decode(t, table, more)))
            yield pa.array(out, arrow)

    return F.arrow_udf(run, kind)


def _segmented(docs: DataFrame, name: str, kind: str, model: str | None, most: int, rare: str) -> DataFrame:
    if rare not in ("segment", "join"):
        raise ValueError(f"rare words are 'segment'ed or 'join'ed, not {rare!r}")
    model, text = model or default_model(), F.col("text").cast("string")
    if not codec(model).cuts:
        return docs.withColumn(name, _here(model, None, kind)(text))
    words = common.cut(counted(docs.select(text.alias("text"))), "pieces-words")
    frequent, whole = _frequent(words, most)
    table = segmented(words if rare == "join" else words.where(frequent), model)
    common.discard(words)
    hot = common.cut(table.where(frequent).select("word", "n", "ids", "decoded"), "pieces-hot")
    path = _folder(hot)
    if whole or rare == "segment":
        common.discard(table)
        return docs.withColumn(name, _here(model, path, kind)(text))

    own = common.private(docs)
    keyed = [F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")]  # equal texts have equal results
    first = common.cut(docs.select(*keyed, _first(model, path, kind)(text).alias("r")).select(*_KEY, "r.*"), "pieces-first")
    wanted = first.where("missing is not null").select(*_KEY, F.explode("missing").alias("word")).distinct()
    extra = wanted.join(table.drop("uses"), "word").groupBy(*_KEY).agg(F.collect_list(F.struct("word", "n", "ids", "decoded")).alias("extra"))
    extra = common.cut(extra, "pieces-extra")
    texts = docs.select(*keyed, text.alias("text")).join(common.small(extra.select(*_KEY)), _KEY).dropDuplicates(_KEY)
    late = texts.join(extra, _KEY).select(*_KEY, _second(model, path, kind)("text", "extra").alias("done"))
    results = common.cut(first.where("missing is null").select(*_KEY, "done").dropDuplicates(_KEY).unionByName(late), "pieces-results")
    common.discard(table, first, extra, hot)
    results = results.select(*[F.col(c).alias(f"{own}_{c}") for c in (*_KEY, "done")])
    rows = docs.withColumns({f"{own}_1": F.xxhash64(text), f"{own}_2": F.xxhash64(F.lit(1), text)})
    out = rows.join(results, (rows[f"{own}_1"] == results[f"{own}_h1"]) & (rows[f"{own}_2"] == results[f"{own}_h2"]), "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(f"{own}_done").alias(name))


def _folder(df: DataFrame) -> str:
    """The folder of a frame made by ``common.cut``."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def digests(docs: DataFrame, model: str | None = None, most: int = HOT, rare: str = "segment") -> DataFrame:
    """``docs`` with a struct column ``pieces`` (underscores before the name where it is taken): n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and decode to the empty text.  Equal rows get equal results; an empty table gives
    an empty table; other columns pass through.  ``most`` is the number of words that workers hold, ``rare`` what is done
    with others; results don't depend on them.
    """
    return _segmented(docs, common.spare(docs, "pieces"), DIGEST, model, most, rare)


def encoded(docs: DataFrame, model: str | None = None, most: int = HOT, rare: str = "segment") -> DataFrame:
    """``docs`` with an array column ``ids`` (underscores before the name where it is taken); otherwise like ``digests``."""
    return _segmented(docs, common.spare(docs, "ids"), IDS, model, most, rare)


def op6_distinct_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "pieces.*")
