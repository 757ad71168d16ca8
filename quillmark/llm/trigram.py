"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every match satisfies.  The index holds
postings (trigram, document) for the trigrams the queries ask for; postings are intersected document by document, and
only the documents that satisfy a rule's query are verified with its expression.  Rules without mandatory trigrams scan
every document.  The candidates' ids are written first: few enough of them are broadcast, so that no text is shuffled;
more go through a shuffled join.  All of it is DataFrame functions; postings never leave their rows for a list of
unbounded length.
"""

from __future__ import annotations

from dataclasses import dataclass
from re import _constants as C  # the parsed form of regular expressions
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import SPAN, find_spans, span_list

ALL = True  # the query that every text satisfies
_MOST = 64  # strings in an exact set


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # leftmost, non-overlapping
    least: str | None = None  # SQL over the match ``s`` that a match must satisfy


ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the least length fails from any start within it, so the length is part of the expression.
BASE = (
    Rule("assign", ASSIGN, "group2 >= 6"),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{30,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("pay_key", r"[sr]k_(?:live|test)_[0-9A-Za-z]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+]{1,15}://[A-Za-z0-9._-]{1,64}:[^\s:@/]{3,64}@"),
)
RULES = BASE + MORE


# -- regular expression -> Boolean trigram query ---------------------------------------------------------------


def _and(*parts):
    flat = [x for p in parts if p is not ALL for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))]
    flat = tuple(dict.fromkeys(flat))
    return ALL if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _or(*parts):
    if not parts or any(p is ALL for p in parts):
        return ALL
    parts = tuple(dict.fromkeys(parts))
    need = {p: {p} if isinstance(p, str) else set(p[1]) for p in parts if isinstance(p, str) or p[0] == "and"}
    parts = tuple(p for p in parts if p not in need or not any(need[q] < need[p] for q in need))  # implied by a weaker part
    return parts[0] if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]):
    """One of the strings occurs."""
    return _or(*(_and(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)))


def _small_class(items) -> set[str] | None:
    out: set[str] = set()
    for op, arg in items:
        if op is C.LITERAL:
            out.add(chr(arg).lower())
        elif op is C.RANGE and arg[1] - arg[0] < 8:
            out |= {chr(x).lower() for x in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= 8 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """(all strings the sequence can be, or None; query).  Strings are lower-cased, as the index is."""
    run, query, exact = {""}, ALL, True
    for op, arg in nodes:
        here, sub = _node(op, arg)
        query = _and(query, sub)
        if here is not None and len(here) * len(run) <= _MOST:
            run = {a + b for a in run for b in here}
        else:
            query, exact, run = _and(query, _of_strings(run)), False, {""} if here is None else here
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[1] != arg[0] and not (arg[:2] == (0, 1) and here):
            query, exact, run = _and(query, _of_strings(run)), False, {""}
    return (run, query) if exact else (None, _and(query, _of_strings(run)))


def _node(op, arg) -> tuple[set[str] | None, object]:
    if op is C.LITERAL:
        return {chr(arg).lower()}, ALL
    if op is C.IN:
        return _small_class(arg), ALL
    if op is C.SUBPATTERN:
        return _walk(arg[3])
    if op is C.ATOMIC_GROUP:
        return _walk(arg)
    if op is C.BRANCH:
        parts = [_walk(b) for b in arg[1]]
        if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= _MOST:
            return set().union(*(p[0] for p in parts)), ALL
        return None, _or(*(_and(q, ALL if s is None else _of_strings(s)) for s, q in parts))
    if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
        low, high, inner = arg
        s, q = _walk(inner)
        if (low, high) == (0, 1):
            return (s | {""}, ALL) if s is not None else (None, ALL)
        if low == 0:
            return None, ALL
        if s is not None and len(s) == 1 and low * len(next(iter(s))) <= 64:
            return {next(iter(s)) * low}, ALL
        return (s, q) if s is not None and low == 1 else (None, _and(q, ALL if s is None else _of_strings(s)))
    if op is C.AT or op in (C.ASSERT, C.ASSERT_NOT):
        return {""}, ALL
    return None, ALL


def trigram_query(pattern: str):
    """A trigram, ("and", parts), ("or", parts), or ``ALL``; every text in which ``pattern`` matches satisfies it once lower-cased."""
    s, q = _walk(_parser.parse(pattern))
    return _and(q, _of_strings(s)) if s is not None else q


def _grams(q) -> set[str]:
    return set() if q is ALL else {q} if isinstance(q, str) else set().union(*map(_grams, q[1]))


# -- index and verification -------------------------------------------------------------------------------------


class Index:
    """The queries of some rules, and the numbers of the trigrams that they ask for."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        self.queries = {r.kind: trigram_query(r.pattern) for r in rules}
        self.grams = sorted(set().union(*map(_grams, self.queries.values())))
        self.words = -(-len(self.grams) // 62)

    def postings(self, docs: DataFrame) -> DataFrame:
        """(gram, doc_id, text_hash) for each needed trigram that a document's lower-cased text holds."""
        low = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.lower("text").alias("_low")).where("text is not null") if self.grams else docs.limit(0)
        needed = F.array(*[F.struct(F.lit(i).alias("k"), F.lit(g).alias("g")) for i, g in enumerate(self.grams)])
        return low.select(F.explode(F.filter(needed, lambda x: F.contains(F.col("_low"), x["g"]))["k"]).alias("gram"), "doc_id", "text_hash")

    def candidates(self, postings: DataFrame) -> DataFrame:
        """(doc_id, text_hash, a boolean a rule with trigrams): the intersected postings."""
        bits = [F.bit_or(F.when(F.floor(F.col("gram") / 62) == w, F.expr("shiftleft(1L, gram % 62)")).otherwise(F.lit(0).cast("long"))).alias(f"_w{w}") for w in range(self.words)]
        seen = postings.groupBy("doc_id", "text_hash").agg(*bits)
        number = {g: i for i, g in enumerate(self.grams)}

        def holds(q) -> Column:
            if isinstance(q, str):
                return F.col(f"_w{number[q] // 62}").bitwiseAND(F.lit(1 << number[q] % 62).cast("long")) != 0
            cols = [holds(x) for x in q[1]]
            out = cols[0]
            for c in cols[1:]:
                out = out & c if q[0] == "and" else out | c
            return out

        flags = {f"_may_{k}": holds(q) for k, q in self.queries.items() if q is not ALL}
        any_ = None
        for c in flags.values():
            any_ = c if any_ is None else any_ | c
        return seen.where(any_).select("doc_id", "text_hash", *[c.alias(k) for k, c in flags.items()])


def scanned(docs: DataFrame, index: Index | None = None) -> DataFrame:
    """``docs`` with an array column ``secrets`` (underscores before the name where it is taken) of spans (start, rank, end, kind, s).

    Spans are in code points, end exclusive; each rule's are leftmost and don't overlap.  Null and empty texts have none;
    rows that repeat a doc_id, null ones too, are verified each by itself; an empty table gives an empty table; other
    columns pass through.
    """
    index = index or Index()
    name, own = common.spare(docs, "secrets"), common.private(docs)
    ids = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    cand = index.candidates(index.postings(ids))
    cand = common.cut(cand.select(*[F.col(c).alias(own + c) for c in cand.columns]), "secret-candidates")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    text, key = F.col("text").cast("string"), f"{own}_key"
    left = docs.withColumn(key, F.xxhash64(text))
    joined = left.join(common.small(cand), left["doc_id"].eqNullSafe(F.col(f"{own}doc_id")) & (left[key] == F.col(f"{own}text_hash")), "left")
    none, spans = F.array().cast("array<string>"), []
    for k, r in enumerate(index.rules):
        all_ = F.regexp_extract_all(text, F.lit(r.pattern), F.lit(0))
        if index.queries[r.kind] is not ALL:
            all_ = F.when(F.col(f"{own}_may_{r.kind}"), all_)
        joined = joined.withColumn(f"{own}_m{k}", F.coalesce(all_, none))
    for k, r in enumerate(index.rules):
        keep = (lambda s, p=r.pattern: F.length(F.regexp_extract(s, p, 2)) >= 6) if r.least else None
        found = F.col(f"{own}_m{k}")
        spans.append(F.when(F.size(found) > 0, find_spans(text, found, r.pattern, r.kind, k, keep)).otherwise(F.array().cast(SPAN)))
    return joined.select(*cols, F.concat(*spans).alias(name))


def op5_trigram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = scanned(common.documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = {r.kind: count(r.kind) for r in RULES}
    base = F.filter("secrets", lambda x: x["rank"] < len(BASE))
    return hits.select("doc_id", *[n[r.kind] for r in BASE], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans"), *[n[r.kind] for r in MORE], F.size("secrets").cast("long").alias("n_spans"))


def masked(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with each secret span of the text replaced by ``mark`` (one for spans that overlap).

    Null, empty and clean texts stay as they are; repeated rows are each masked; other columns pass through; an empty
    table gives an empty table.
    """
    name = common.spare(docs, "secrets")
    found = scanned(docs)
    state = "struct<at:int,out:array<string>>"

    def step(acc: Column, x: Column) -> Column:
        piece = F.when(x["start"] >= acc["at"], F.array(F.col("text").substr(acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece).alias("out")).cast(state)

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")).cast(state)
    redacted = F.aggregate(F.array_sort(name), first, step, lambda a: F.concat(F.array_join(a["out"], ""), F.col("text").substr(a["at"] + 1, F.length("text"))))
    text = F.when(F.size(name) > 0, redacted).otherwise(F.col("text")).alias("text")
    return found.select(*[text if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])
