"""PII by candidate gradient boosting, in DataFrame functions alone.

Generators of high recall propose overlapping spans (loose phone numbers, digit runs, written-out mail addresses, identity
and account numbers).  Boosted trees score each from its format and the text around it, and a threshold calibrated for
each generator selects spans.  The strict base expressions always count; selected spans that overlap them, or a selected
span with a higher score, are dropped.  The trees are fitted here on ``TRAIN`` generated examples, drawn with stated odds
for each pair of format and context, and become nested CASE expressions, so no Python runs on the executors.  A good
format counts without any cue word, and a cue word doesn't save a bad format.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import SPAN, find_spans, span_list

#: Possessive and anchored where that finds the same matches, so that long runs take linear time and little stack.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?+[0-9]){11,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card_ok(s: Column) -> Column:
    return F.length(_digits(s)).between(12, 19) & F.call_function("luhn_check", F.when(F.length(s) <= 64, _digits(s)).otherwise(F.lit("1")))


BASE = (
    ("email", EMAIL, None, "@"),
    ("ip", IP, lambda s: s.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"), "."),
    ("card", CARD, _card_ok, None),
    ("phone", PHONE, lambda s: F.length(_digits(s)).between(9, 15), "+"),
)
#: Generators: kind, expression.
GENERATORS = (
    ("phone", r"(?<![0-9.+])\(?[0-9]{2,4}\)?[ ./-]{1,2}[0-9]{3,4}[ ./-][0-9]{3,4}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9](?:[ .-]?[0-9]){8,18}(?![0-9])"),
    ("email", r"(?i)[a-z0-9._%+-]{1,64} ?(?:\(at\)|\[at\]| at ) ?[a-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\.| dot ) ?[a-z0-9-]{2,63}){1,3}"),
    ("id", r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])"),
)
KINDS = tuple(k for k, *_ in BASE) + ("id",)

FEATURES = ("generator", "length", "digits", "separators", "distinct", "parens", "luhn", "phone_word", "money_word", "other_word", "mail_word", "verb", "bracketed", "dotted", "suffix", "spaces", "dashes", "glued")


def features(g: Column, s: Column, before: Column, after: Column) -> list[Column]:
    """Numbers that describe a candidate: its format, and words up to 24 code points before it."""
    low, d = F.lower(before), _digits(s)
    one = lambda c: c.cast("int")
    return [
        g.cast("int"),
        F.length(s),
        F.length(d),
        F.length(F.regexp_replace(s, r"[^ ./-]", "")),
        F.size(F.array_distinct(F.split(d, ""))),
        one(s.contains("(")),
        one(F.coalesce(F.call_function("luhn_check", F.when(d != "", d)), F.lit(False))),
        one(low.rlike(r"phone|tel|call|mobil|cell|fax|whats|ring")),
        one(low.rlike(r"card|visa|credit|account|iban|ssn|social|passport|tax|identi")),
        one(low.rlike(r"order|invoice|version|isbn|page|ref|qty|price|article|item|model|build|\bno\b|total|chapter")),
        one(low.rlike(r"mail|contact|write|reach|address|@")),
        one(low.rlike(r"\b(?:look|stay|was|is|are|were|live|arrive|meet|met)\b")),
        one(F.lower(s).rlike(r"[(\[](?:at|dot)[)\]]")),
        one(F.contains(F.lower(s), F.lit(" dot "))),
        one(F.lower(s).rlike(r"(?:com|org|net|edu|gov|de|fr|es|io|uk)$")),
        F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit(""))),
        F.length(s) - F.length(F.replace(s, F.lit("-"), F.lit(""))),
        one(after.rlike(r"^[A-Za-z0-9%]") | before.rlike(r"[A-Za-z0-9$#]$")),
    ]


# -- examples and trees ------------------------------------------------------------------------------------------

TRAIN, TREES, DEPTH, RATE, PRECISION = 4800, 30, 4, 0.3, 0.9
#: Words before a candidate that speak for and against personal data, by generator.
CUES = {
    0: (("phone ", "call me at ", "tel: ", "mobile ", "Fax ", "ring "), ("order ", "invoice ", "version ", "ref ", "page ", "item ")),
    1: (("card ", "visa ", "credit card no ", "account "), ("isbn ", "order no ", "item ", "total ", "article ")),
    2: (("mail ", "contact ", "write to ", "reach me: "), ("look ", "we stay ", "was ", "he is ")),
    3: (("ssn ", "iban ", "passport ", "tax id "), ("model ", "build ", "article ", "chapter ", "ref ")),
}
#: The odds that a candidate is personal: with a cue for it, without a cue, with a cue against it.
ODDS = {"strong": (0.99, 0.96, 0.12), "marked": (0.99, 0.97, 0.96), "fair": (0.96, 0.45, 0.04), "weak": (0.35, 0.02, 0.01)}


def _candidate(r: random.Random, g: int) -> tuple[str, str]:
    """A candidate of generator ``g`` and how strong its format is."""
    num = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    kind = r.choice(("strong", "fair", "weak"))
    if g == 0:
        form = {"strong": ("({}) {}-{}", "({}) {} {}", "{}-{}-{}"), "fair": ("{} {} {}", "{}.{}.{}"), "weak": ("{}/{}/{}",)}[kind]
        return r.choice(form).format(num(2 if kind == "weak" else 3), num(3), num(4)), kind
    if g == 1:
        if kind == "fair":  # as long as a card, but its check digit is wrong
            s = num(16)
            return (s if not _luhn(s) else s[:-1] + str((int(s[-1]) + 1) % 10)), "weak"
        if kind == "weak":
            return num(r.randint(9, 11)), kind
        body = num(r.choice((15, 15, 14)))
        s = next(body + str(d) for d in range(10) if _luhn(body + str(d)))
        return (r.choice((" ", "-", ".")).join(s[i : i + 4] for i in range(0, len(s), 4)) if r.random() < 0.6 else s), kind
    if g == 2:
        end = r.choice(("com", "org", "net", "de", "fr", "es", "io"))
        if kind == "strong":
            at, dot = r.choice(((" (at) ", "."), ("[at]", "[dot]"), ("(at)", " dot "), (" [at] ", " [dot] ")))
            return f"{word()}{at}{word()}{dot}{end}", "marked"
        return (f"{word()} at {word()}{r.choice((' dot ', '.'))}{end}", kind) if kind == "fair" else (f"{word()} at {word()}. {word().capitalize()}", kind)
    if kind == "strong":
        iban = f"{r.choice(('DE', 'FR', 'ES', 'GB', 'IT', 'NL'))}{num(2)} " + " ".join(num(4) for _ in range(r.randint(4, 5))) + r.choice(("", "", f" {num(2)}"))
        return r.choice((f"{num(3)}-{num(2)}-{num(4)}", iban)), kind
    return r.choice(("AB", "XK", "MO", "QR")) + num(2) + "".join(r.choice("ABCDEFGH0123") for _ in range(12)), "weak"


def _luhn(digits: str) -> bool:
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(map(int, reversed(digits)))) % 10 == 0


def examples(n: int = TRAIN, seed: int = 5) -> list[dict]:
    """Generated candidates: generator, text, what stands around it, and whether it is personal, drawn by ``ODDS``."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 9)))
    for k in range(n):
        g = k % 4
        s, kind = _candidate(r, g)
        cue = r.choice((0, 1, 1, 2))
        before = word() + " " + (r.choice(CUES[g][cue // 2]) if cue != 1 else word() + " ")
        out.append({"g": g, "s": s, "b": before[-24:], "a": r.choice((" ", ".", ", ", " " + word())), "y": int(r.random() < ODDS[kind][cue])})
    return out


def _tree(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A leaf value, or (feature, threshold, left, right); left where feature <= threshold."""
    value = float(grad.sum() / (hess.sum() + 1.0))
    if not depth or len(x) < 20:
        return value
    best, gain = None, 1e-3
    parent = grad.sum() ** 2 / (hess.sum() + 1.0)
    for f in range(x.shape[1]):
        for t in np.unique(np.quantile(x[:, f], np.linspace(0.05, 0.95, 12), method="lower")):
            m = x[:, f] <= t
            if 5 <= m.sum() <= len(m) - 5:
                now = grad[m].sum() ** 2 / (hess[m].sum() + 1.0) + grad[~m].sum() ** 2 / (hess[~m].sum() + 1.0) - parent
                if now > gain:
                    best, gain = (f, float(t), m), now
    if best is None:
        return value
    f, t, m = best
    return f, t, _tree(x[m], grad[m], hess[m], depth - 1), _tree(x[~m], grad[~m], hess[~m], depth - 1)


def _leaf(tree, row) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(x: np.ndarray, y: np.ndarray) -> list:
    score, trees = np.zeros(len(y)), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        trees.append(_tree(x, y - p, p * (1 - p), DEPTH))
        score += RATE * np.array([_leaf(trees[-1], r) for r in x])
    return trees


def score(trees: list, x: Column) -> Column:
    """The sum of the trees over the struct or array ``x`` of features."""

    def case(t) -> Column:
        return F.lit(t) if isinstance(t, float) else F.when(x[t[0]] <= F.lit(t[1]), case(t[2])).otherwise(case(t[3]))

    out = case(trees[0])
    for t in trees[1:]:
        out = out + case(t)
    return out * F.lit(RATE)


@lru_cache(maxsize=4)
def _fitted(rows: tuple) -> tuple[list, tuple[float, ...]]:
    x, y = np.array([r[:-1] for r in rows], dtype=float), np.array([r[-1] for r in rows], dtype=float)
    part = np.arange(len(y)) // 4 % 3 == 0
    trees = boost(x[~part], y[~part])
    s = np.array([RATE * sum(_leaf(t, r) for t in trees) for r in x[part]])
    limits = []
    for g in range(len(GENERATORS)):  # the lowest threshold at which held-out precision is high enough
        m = x[part][:, 0] == g
        sg, yg = s[m], y[part][m]
        good = [t for t in np.unique(sg) if (yg[sg >= t].mean()) >= PRECISION]
        # half way to the next lower score, so the order of a sum doesn't matter
        limits.append(float((min(good) + max(sg[sg < min(good)], default=min(good) - 1)) / 2) if good else float("inf"))
    return trees, tuple(limits)


def model(spark: SparkSession) -> tuple[list, tuple[float, ...]]:
    """Trees and thresholds.  The examples' features come from the same expressions as the documents'."""
    rows = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(examples())), "array<struct<g:int,s:string,b:string,a:string,y:int>>")).alias("e"))
    x = features(F.col("e.g"), F.col("e.s"), F.col("e.b"), F.col("e.a"))
    got = rows.select(F.array(*x).alias("x"), "e.y").collect()  # TRAIN rows
    return _fitted(tuple((*r[0], r[1]) for r in got))


# -- documents ---------------------------------------------------------------------------------------------------


def detected(docs: DataFrame) -> DataFrame:
    """``docs`` with an array column ``pii`` (underscores before the name where it is taken) of spans (start, rank, end, kind, s).

    rank is below 10 for base spans.  Spans are in code points, end exclusive.  Null and empty texts have none; equal rows
    get equal spans; an empty table gives an empty table; other columns pass through.
    """
    trees, limits = model(docs.sparkSession)
    own, name, cols = common.private(docs), common.spare(docs, "pii"), [F.col(f"`{c}`") for c in docs.columns]
    text = F.col("text").cast("string")
    none, no_spans = F.array().cast("array<string>"), F.array().cast(SPAN)
    out = docs
    for k, (_, p, _, needs) in enumerate(BASE):
        found = F.regexp_extract_all(text, F.lit(p), F.lit(0))
        out = out.withColumn(f"{own}_b{k}", F.coalesce(F.when(text.contains(needs), found) if needs else found, none))
    for k, (_, p) in enumerate(GENERATORS):
        out = out.withColumn(f"{own}_g{k}", F.coalesce(F.regexp_extract_all(text, F.lit(p), F.lit(0)), none))
    base = [F.when(F.size(f"{own}_b{k}") > 0, find_spans(text, F.col(f"{own}_b{k}"), p, kind, k, ok)).otherwise(no_spans) for k, (kind, p, ok, _) in enumerate(BASE)]
    loose = [F.when(F.size(f"{own}_g{k}") > 0, find_spans(text, F.col(f"{own}_g{k}"), p, kind, 10 + k)).otherwise(no_spans) for k, (kind, p) in enumerate(GENERATORS)]
    out = out.withColumn(own + "_base", F.concat(*base)).withColumn(own + "_loose", F.concat(*loose))

    def overlap(a: Column, b: Column) -> Column:
        return (a["start"] < b["end"]) & (b["start"] < a["end"])

    def described(c: Column) -> Column:
        before = F.substr(text, F.greatest(c["start"] - 23, F.lit(1)), F.least(c["start"], F.lit(24)))
        return F.struct(c.alias("c"), F.array(*features(c["rank"] - 10, c["s"], before, F.substr(text, c["end"] + 1, F.lit(4)))).alias("x"))

    free = F.filter(own + "_loose", lambda c: ~F.exists(own + "_base", lambda b: overlap(b, c)))
    out = out.withColumn(own + "_free", F.when(F.size(own + "_loose") > 0, F.transform(free, described)).otherwise(F.array().cast(f"array<struct<c:{SPAN[6:-1]},x:array<int>>>")))
    out = out.withColumn(own + "_scored", F.transform(own + "_free", lambda d: F.struct(d["c"].alias("c"), score(trees, d["x"]).alias("v"))))
    limit = lambda c: F.element_at(F.array(*[F.lit(v) for v in limits]), c["rank"] - 9)
    out = out.withColumn(own + "_good", F.filter(own + "_scored", lambda d: d["v"] >= limit(d["c"])))
    better = lambda a, b: (a["v"] > b["v"]) | ((a["v"] == b["v"]) & (F.struct(a["c"]["start"], a["c"]["rank"]) < F.struct(b["c"]["start"], b["c"]["rank"])))
    best = F.filter(own + "_good", lambda d: ~F.exists(own + "_good", lambda e: overlap(e["c"], d["c"]) & better(e, d)))
    return out.select(*cols, F.concat(own + "_base", F.transform(best, lambda d: d["c"])).alias(name))


def op2_boosted_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = detected(common.documents(spark, sf_dir).select("doc_id", "text"))
    order = {k: i for i, k in enumerate(KINDS)}

    def count(kind: str, base: bool) -> Column:
        return F.size(F.filter("pii", lambda x: (x["kind"] == kind) & ((x["rank"] < 10) if base else (x["rank"] >= 10)))).cast("long")

    rank = F.create_map(*[F.lit(v) for kv in order.items() for v in kv])
    ranked = F.transform("pii", lambda x: F.struct(x["start"], rank[x["kind"]].alias("rank"), x["end"], x["kind"], x["s"]))
    base = F.filter("pii", lambda x: x["rank"] < 10)
    return hits.select("doc_id", *[count(k, True).alias(f"n_{k}") for k, *_ in BASE], F.sha2(span_list(base), 256).alias("base_sha256"), span_list(ranked).alias("spans"), *[count(k, False).alias(f"added_{k}") for k in KINDS if k != "ip"], F.size("pii").cast("long").alias("n_spans"))
