"""Language ID by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed character 1- to 3-grams predicts each bit.
A text's language is the codeword with the smallest loss-weighted distance to the classifiers' margins; a small lead
over the second flags ambiguity.  The classifiers are fitted on a bounded sample of labelled rows: of every language up
to ``PER_LANG`` documents, fewer where there are so many languages that ``SAMPLE`` rows would be passed (but one at
least, and about so many, as they are taken by a hash).  Rows over ``LONGEST`` bytes are left out of it but for one where a language has no
other.  No language is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bounds of the sample: rows a language, rows in all, UTF-8 bytes of a row.
PER_LANG, SAMPLE, LONGEST = 300, 3000, 1 << 16
BINS = 1 << 13
RIDGE = 0.02
AMBIGUOUS = 0.6
UNKNOWN = "und"
_PIECE = 1 << 19
RESULT = "struct<lang_pred: string, score: double, ambiguous: boolean>"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter, as ``str.isalpha`` has it."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str) -> np.ndarray:
    """Square roots of hashed n-gram counts, of length 1.  What isn't a letter counts as one gap."""
    counts = np.zeros(BINS)
    for at in range(0, len(text), _PIECE):
        c = np.frombuffer((" " + text[at : at + _PIECE].lower() + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        c = np.where(_letters()[c], c, np.uint64(32))
        c = c[(c != 32) | np.concatenate(([True], c[:-1] != 32))]
        h = c * np.uint64(0x9E3779B97F4A7C15)
        for k in range(3):
            if k:
                h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + c[k:] * np.uint64(0x94D049BB133111EB)
            counts += np.bincount(((h ^ (h >> np.uint64(31))) >> np.uint64(17)) % np.uint64(BINS), minlength=BINS)
    x = np.sqrt(counts)
    return x / max(np.linalg.norm(x), 1e-12)


def codewords(k: int) -> np.ndarray:
    """k rows of bits -1 and 1: all splits for up to six languages, else seeded random ones of 15 log2 k bits."""
    if k < 2:
        return np.ones((k, 1))
    if k <= 6:
        bits = [[1.0 if l == 0 or m >> (l - 1) & 1 else -1.0 for l in range(k)] for m in range((1 << (k - 1)) - 1)]
        return np.array(bits).T
    rng = np.random.default_rng(11)
    n = int(np.ceil(15 * np.log2(k)))
    best = max((rng.choice([-1.0, 1.0], size=(k, n)) for _ in range(50)), key=lambda m: -np.max(m @ m.T - 2 * n * np.eye(k)))
    keep = np.abs(best.sum(axis=0)) < k  # a bit that is the same for all teaches nothing
    return best[:, keep]


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # bits x bins
    bias: np.ndarray
    trust: np.ndarray  # each bit's weight in the decoding

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0, True
        margin = self.weights @ features(text) + self.bias
        loss = (self.trust * np.exp(-np.clip(self.code * margin, -4, 4))).sum(axis=1) / self.trust.sum()
        p = np.exp(-6 * (loss - loss.min()))
        p /= p.sum()
        best = int(np.argmin(loss))
        return self.langs[best], float(p[best]), bool(p[best] < AMBIGUOUS)


def fit(texts: list[str], langs: list[str]) -> Model:
    """One ridge classifier a bit; a bit's trust is its leave-one-out accuracy above chance."""
    names = sorted(set(langs))
    code = codewords(len(names))
    if not names:
        return Model([], code, np.zeros((1, BINS)), np.zeros(1), np.ones(1))
    x = np.stack([features(t) for t in texts])
    target = code[[names.index(v) for v in langs]]
    bias = target.mean(axis=0)
    gram = x @ x.T
    inverse = np.linalg.inv(gram + RIDGE * len(x) ** 0.5 * np.eye(len(x)))
    alpha = inverse @ (target - bias)
    left_out = target - alpha / np.diag(inverse)[:, None]
    trust = np.maximum((np.sign(left_out) == target).mean(axis=0) - 0.5, 0.01)
    return Model(names, code, (x.T @ alpha).T, bias, trust)


def train(docs: DataFrame, per_lang: int = PER_LANG, sample: int = SAMPLE, longest: int = LONGEST) -> Model:
    """Fit on rows whose crc32(doc_id as text) mod 5 is not 0 and whose text and lang are there.

    Of each language the rows are taken whose hash lies in the part of the range that about ``share`` of its rows share, so
    nothing is ranked or gathered.  Equal rows count once.
    """
    usable = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = usable.where("text is not null and lang is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    usable = usable.withColumn("h", F.xxhash64("text")).withColumn("short", F.octet_length("text") <= longest)
    # a row a language; its first row, a short one if there is any, is always in the sample
    first = F.min(F.struct((~F.col("short")).alias("long"), F.xxhash64("doc_id", "h").alias("x"), "doc_id", "h"))
    langs = common.cut(usable.groupBy("lang").agg(F.count_if("short").alias("n"), first.alias("first")), "langs")
    share = max(1, min(per_lang, sample // max(langs.count(), 1)))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", "h"), 11) / float(1 << 53)  # from 0 to 1, so that about ``share`` rows are below their part
    always = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    picked = usable.select("doc_id", "lang", "h", "short").join(F.broadcast(langs), "lang").where(F.col("short") & (place * F.col("n") < share) | always)
    picked = common.cut(picked.select("doc_id", "lang", "h").distinct(), "lang-sample")
    # about ``sample`` rows at most, or one a language
    rows = usable.join(F.broadcast(picked), ["doc_id", "lang", "h"], "left_semi").select("doc_id", "lang", "text").distinct().collect()
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["doc_id"], r["lang"], r["text"]))
    return fit([r["text"] for r in rows], [r["lang"] for r in rows])


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a struct column ``language`` (underscores before the name where it is taken): lang_pred, score, ambiguous.

    A text that is null or has no letter is ``und`` with score 0; so is every text where nothing was learned.  Only the
    text decides; equal texts get equal results; an empty table gives an empty table; other columns pass through.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bits x bins numbers

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = sent.value
        for texts in batches:
            rows = [m.predict(t.as_py()) for t in texts]
            columns = [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())]
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score", "ambiguous"])

    return docs.withColumn(common.spare(docs, "language"), F.arrow_udf(run, RESULT)(F.col("text").cast("string")))


def op9_output_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    held = F.coalesce(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0"), F.lit(False)).alias("held_out")
    return identified(docs.select("doc_id", "text"), train(docs)).select("doc_id", held, "language.*")
