"""License scans: a trained paragraph classifier, in DataFrame functions alone.

Paragraphs end at blank lines.  Their lines and overlapping windows of their words, so that no notice is cut by a line
end and none drowns in a long text, are bags of word 1- and 2-grams; a multinomial logistic regression over the n-grams
of its templates gives licence families and an unknown class, and its probabilities are calibrated by a temperature fitted on held-out
examples.  A family is reported where the classifier is sure enough and a template of that family confirms it by word
containment; a paragraph has every family of its lines and windows.  One that holds a share of a template's words holds one of any ``n - needed + 1`` of them, so one
expression over such words leaves out paragraphs that nothing can confirm, and no result changes.  The weights, a table
bounded by the vocabulary, are broadcast.
"""

from __future__ import annotations

import json
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Notices of each family, as words in lower case.
TEMPLATES = {
    "agpl": ("licensed under the gnu affero general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license", "gnu affero general public license version 3", "released under the agpl version 3", "gnu agpl v3"),
    "apache-2.0": ("licensed under the apache license version 2.0", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license", "released under the apache software license 2.0", "apache license version 2.0", "apache 2.0 license"),
    "artistic": ("licensed under the artistic license 2.0", "redistributed under the terms of the artistic license"),
    "boost": ("distributed under the boost software license version 1.0", "licensed under the boost software license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "licensed under the 3-clause bsd license", "released under the bsd license", "use of this source code is governed by a bsd style license"),
    "cc-by": ("licensed under a creative commons attribution 4.0 international license", "licensed under cc by 4.0", "this work is licensed under cc by 3.0"),
    "cc-by-nc": ("licensed under a creative commons attribution non commercial license", "licensed under cc by-nc 4.0", "available under cc by-nc 3.0"),
    "cc-by-nc-nd": ("licensed under a creative commons attribution non commercial no derivatives license", "licensed under cc by-nc-nd 4.0"),
    "cc-by-nc-sa": ("licensed under a creative commons attribution non commercial share alike license", "licensed under cc by-nc-sa 4.0"),
    "cc-by-nd": ("licensed under a creative commons attribution no derivatives 4.0 license", "licensed under cc by-nd 4.0"),
    "cc-by-sa": ("licensed under a creative commons attribution share alike 4.0 license", "licensed under cc by-sa 4.0", "available under cc by-sa 3.0"),
    "cddl": ("licensed under the common development and distribution license version 1.0", "released under the cddl 1.0"),
    "epl": ("licensed under the eclipse public license 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", "released under the epl 2.0"),
    "eupl": ("licensed under the european union public licence 1.2", "licensed under the eupl version 1.2"),
    "gpl": ("this work is licensed under the gnu general public license version 3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gnu general public license version 3", "licensed under the gpl version 2 or later", "gnu gpl v3"),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "licensed under the isc license", "isc license"),
    "lgpl": ("licensed under the gnu lesser general public license", "gnu lesser general public license version 2.1", "this library is free software released under the lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    "mit": ("released under the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge to any person obtaining a copy of this software", "mit license"),
    "mpl": ("this source code form is subject to the terms of the mozilla public license v 2.0", "released under the mozilla public license 2.0", "mozilla public license version 2.0", "licensed under the mpl 2.0"),
    "ofl": ("this font software is licensed under the sil open font license version 1.1", "licensed under the sil ofl 1.1"),
    "proprietary": ("copyright all rights reserved", "no part of this publication may be reproduced without prior written permission of the publisher", "proprietary and confidential unauthorized copying is strictly prohibited"),
    "public-domain": ("dedicated to the public domain under cc0 1.0 universal", "released into the public domain", "no rights reserved cc0"),
    "unlicense": ("this is free and unencumbered software released into the public domain", "released under the unlicense"),
    "zlib": ("this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages", "licensed under the zlib license"),
}
UNKNOWN = "unknown"
#: Names without which, or with another word next to them, a notice is of no known family; and words that tell families apart.
NAMES = frozenset("agpl apache artistic boost bsd cddl creative eclipse epl eupl european gnu gpl isc lgpl mit mozilla mpl ofl sil unlicense zlib".split())
TELLING = NAMES | frozenset("affero alike by by-nc by-nc-nd by-nc-sa by-nd by-sa cc cc0 commercial common commons derivatives development distribution domain font general lesser no non public share unencumbered".split())
STOP = frozenset("a an and any are as at be by for from in into is it may no not of on or part person that the this to under use used we with without you your".split())
OTHERS = ("she renewed her driving license last week", "the public was free to enter the domain", "a version of the story was released", "the work of the general", "the source of the river", "terms of the lease", "the university library is open", "copy the file to the disk", "the program starts at nine", "permission to land was granted", "fishing license fees rose", "licensed to the harbour board for one year", "commercial rights were reserved for the club", "the apache people lived there", "a general public meeting", "the eclipse was free for the public to see", "the mozilla of the forest", "the common development of the european union", "no part of the boost was used", "the author is not liable for damages to the software")
#: Notices of no listed family; ``*`` is any other word.
FRAMES = ("licensed under the * license version 2.0", "released under the * license", "licensed under the * public license 1.0", "released under the * public license", "this work is licensed under the * general public license version 3", "licensed under the * software license", "distributed under the * open license 2.0", "use is subject to the terms of the * license", "licensed under the * * license v 1.1", "licensed under * by 4.0")
SAMPLES, STEPS, L2, SURE, CONFIRM = 3000, 300, 3e-4, 0.6, 0.6
#: Stands for a word that no template or sentence above has.
OTHER = "*"
TOKEN_SPLIT = r"[^a-z0-9.\-]+|[.\-]+(?=[^a-z0-9]|$)|(?<![a-z0-9])[.\-]+"


def tokens(text: str) -> list[str]:
    import re

    return [w for w in re.split(TOKEN_SPLIT, text.lower()) if w]


@lru_cache(maxsize=1)
def vocabulary() -> frozenset[str]:
    lines = [t for ts in TEMPLATES.values() for t in ts] + [t for f in FRAMES for t in f.replace("*", " ").split()] + list(OTHERS)
    return frozenset(w for t in lines for w in tokens(t))


def grams(words: list[str]) -> list[str]:
    """Distinct words and pairs of neighbours, unlisted words as ``OTHER``; none of stop words or unlisted ones alone."""
    known = [w if w in vocabulary() else OTHER for w in words]
    dull = STOP | {OTHER}
    return list(dict.fromkeys([w for w in known if w not in dull] + [f"{a} {b}" for a, b in zip(known, known[1:]) if not (a in dull and b in dull)]))


def samples(n: int = SAMPLES, seed: int = 3) -> list[tuple[list[str], str]]:
    """Words and families: notices with words dropped, added and put before or after; of no family are ordinary sentences,
    ``FRAMES``, and notices whose name is replaced or followed by another word."""
    r, out = random.Random(seed), []
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(3, 9)))
    families = sorted(TEMPLATES)
    for k in range(n):
        f = families[k % len(families)]
        words = tokens(r.choice(TEMPLATES[f]))
        kind = r.random()
        if kind < 0.6:
            words = [w for w in words if w in TELLING or r.random() > 0.08]
        elif kind < 0.75 and (named := [i for i, w in enumerate(words) if w in NAMES]):
            f, i = UNKNOWN, r.choice(named)
            words = words[:i] + [word()] + words[i + 1 :] if r.random() < 0.5 else words[: i + 1] + [word()] + words[i + 1 :]
        else:
            f, line = UNKNOWN, r.choice(FRAMES) if kind < 0.9 else r.choice(OTHERS)
            words = [w for t in line.split() for w in ([word()] if t == "*" else tokens(t))]
        words = [word() for _ in range(r.randint(0, 3))] + words + [word() for _ in range(r.randint(0, 3))]
        out.append((words, f))
    return out


#: Weights are whole multiples of this, so sums don't depend on their order.
UNIT = 1 / (1 << 20)


@lru_cache(maxsize=1)
def fitted() -> tuple[list[str], dict[str, list[int]], list[int], float]:
    """(classes, weights by n-gram and bias in units of ``UNIT``, temperature)."""
    rows = samples()
    classes = [UNKNOWN, *sorted(TEMPLATES)]
    bags = [grams(w) for w, _ in rows]
    vocab = {g: i for i, g in enumerate(sorted({g for b in bags for g in b}))}
    x = np.zeros((len(rows), len(vocab)), dtype=np.float32)
    for i, b in enumerate(bags):
        x[i, [vocab[g] for g in b]] = 1
    y = np.array([classes.index(f) for _, f in rows])
    held = np.arange(len(y)) // len(TEMPLATES) % 5 == 0
    target = np.eye(len(classes), dtype=np.float32)[y]
    w, b = np.zeros((len(vocab), len(classes)), dtype=np.float32), np.zeros(len(classes), dtype=np.float32)

    def soft(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    xt, tt = x[~held], target[~held]
    for _ in range(STEPS):
        d = (soft(xt @ w + b) - tt) / len(xt)
        w -= 6.0 * (xt.T @ d + L2 * w)
        b -= 6.0 * d.sum(axis=0)
    z = x[held] @ w + b
    loss = {t: -np.log(soft(z / t)[np.arange(len(z)), y[held]] + 1e-12).mean() for t in (0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0)}
    b[0] = max(b[0], b[1:].max() + 1e-6)  # nothing known means the unknown class
    whole = lambda v: [int(round(u / UNIT)) for u in v]
    return classes, {g: whole(w[i]) for g, i in vocab.items()}, whole(b), min(loss, key=loss.get)


def predict(words: list[str]) -> tuple[str, float]:
    """The family of some words and its probability, as the expressions below give it before any template is compared."""
    classes, weights, bias, temperature = fitted()
    z = np.array([sum(weights[g][k] for g in grams(words) if g in weights) + bias[k] for k in range(len(classes))]) * UNIT / temperature
    e = np.exp(z - z.max())
    best = max(range(len(classes)), key=lambda k: (z[k], classes[k]))
    return classes[best], float(e[best] / e.sum())


def needed(template: str) -> int:
    """The least number of a template's distinct words that confirms it."""
    n = len(set(tokens(template)))
    return next(k for k in range(1, n + 1) if k / n >= CONFIRM)


def mandatory() -> list[str]:
    """Words of which every paragraph that a template confirms holds at least one: of each template its longest."""
    out = set()
    for t in (t for ts in TEMPLATES.values() for t in ts):
        own = sorted(set(tokens(t)), key=lambda w: (w in STOP, -len(w), w))
        out.update(own[: len(own) - needed(t) + 1])
    return sorted(out)


def any_of(words: list[str]) -> str:
    """One expression for any of ``words``, branching letter by letter, so that few branches are tried at a place."""
    heads: dict[str, list[str]] = {}
    for w in words:
        if w:
            heads.setdefault(w[0], []).append(w[1:])
    parts = [("\\" + c if c in ".-" else c) + any_of(rest) for c, rest in sorted(heads.items())]
    if not parts:
        return ""
    return "(?:" + "|".join(parts) + ")" + ("?" if "" in words else "") if len(parts) > 1 or "" in words else parts[0]


def span() -> int:
    """The words of the longest template: windows of twice as many words, so many apart, hold any notice of this length whole."""
    return max(len(tokens(t)) for ts in TEMPLATES.values() for t in ts)


def paragraph_licenses(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, paragraph, family, probability) for each paragraph and each family confirmed in it.

    Null and empty texts and an empty table give no rows; rows with equal doc_id and text are one here; other columns of
    ``docs`` are left out.
    """
    classes, weights, bias, temperature = fitted()
    some = "(?<![a-z0-9])" + any_of(mandatory()) + "(?![a-z0-9])"
    table = F.from_json(F.lit(json.dumps([{"g": g, "w": w} for g, w in weights.items()])), "array<struct<g:string,w:array<bigint>>>")
    spark = docs.sparkSession
    known = spark.range(1).select(F.explode(table).alias("e")).select("e.g", "e.w")  # a row an n-gram of the vocabulary
    text = F.col("text").cast("string")
    low = F.lower(text)
    parts = docs.where(low.rlike(some)).select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(low, r"\n\s*\n")).alias("paragraph", "p")).where(F.col("p").rlike(some))
    # what explode() returns is a column that later filters don't compute again
    split = lambda t: F.filter(F.split(t, TOKEN_SPLIT), lambda w: w != "")
    lines = F.transform(F.filter(F.split("p", "\n"), lambda t: t.rlike(some)), split)
    parts = parts.select("doc_id", "text_hash", "paragraph", F.explode(F.array(F.struct(split(F.col("p")).alias("all"), lines.alias("lines")))).alias("x")).select("doc_id", "text_hash", "paragraph", "x.*")
    step = span()
    # the windows around words of which a confirmed one holds at least one
    hits = F.filter(F.transform("all", lambda w, i: F.when(w.isin(mandatory()), i)), lambda i: i.isNotNull())
    starts = F.array_distinct(F.flatten(F.transform(hits, lambda i: F.array(i - i % step, F.greatest(i - i % step - step, F.lit(0))))))
    starts = F.when(F.size("all") <= 2 * step, F.array(F.lit(0))).otherwise(starts)
    listed = sorted({w for ts in TEMPLATES.values() for t in ts for w in tokens(t)})

    def run(x: Column) -> Column:
        """The words at the beginning of ``x`` that templates hold: a window goes on through them, so that it cuts no notice short."""
        end = F.array_position(F.transform(x, lambda w: w.isin(listed)), F.lit(False)).cast("int")
        return F.slice(x, F.lit(1), F.when(end == 0, F.size(x)).otherwise(end - 1))

    before = lambda i: F.reverse(F.slice("all", F.greatest(i - step, F.lit(0)) + 1, F.least(i, F.lit(step))))
    after = lambda i: F.slice("all", i + 2 * step + 1, F.lit(step))
    windows = F.transform(starts, lambda i: F.concat(F.reverse(run(before(i))), F.slice("all", i + 1, F.lit(2 * step)), run(after(i))))
    short = F.filter("lines", lambda x: F.size(x) <= 2 * step)
    parts = parts.select("doc_id", "text_hash", "paragraph", F.posexplode(F.array_distinct(F.concat(windows, short))).alias("unit", "words"))
    fewest = min(needed(t) for ts in TEMPLATES.values() for t in ts)
    parts = parts.select("*", F.explode(F.array(F.array_intersect("words", F.array(*[F.lit(w) for w in listed])))).alias("own")).where(F.size("own") >= fewest)
    named = [F.struct(F.lit(f).alias("family"), F.array(*[F.lit(w) for w in dict.fromkeys(tokens(t))]).alias("t")) for f, ts in TEMPLATES.items() for t in ts]
    alike = F.transform(F.array(*named), lambda n: F.named_struct(F.lit("family"), n["family"], F.lit("share"), F.size(F.array_intersect("own", n["t"])) / F.size(n["t"])))
    near = F.transform(F.filter(alike, lambda n: n["share"] >= CONFIRM), lambda n: n["family"])
    parts = parts.select("doc_id", "text_hash", "paragraph", "unit", "words", F.explode(F.array(near)).alias("near")).where(F.size("near") > 0)
    words_known = F.transform("words", lambda w: F.when(w.isin(*sorted(vocabulary())), w).otherwise(OTHER))
    parts = parts.select("doc_id", "text_hash", "paragraph", "unit", "near", F.explode(F.array(words_known)).alias("words"))
    pairs = F.when(F.size("words") > 1, F.zip_with(F.slice("words", 1, F.size("words") - 1), F.slice("words", 2, F.size("words") - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    hits = parts.select("doc_id", "text_hash", "paragraph", "unit", "near", F.explode(F.array_distinct(F.concat("words", pairs))).alias("g"))
    scored = hits.join(F.broadcast(known), "g").groupBy("doc_id", "text_hash", "paragraph", "unit").agg(F.first("near").alias("near"), *[F.sum(F.col("w")[k]).alias(f"_z{k}") for k in range(len(classes))])
    z = F.array(*[F.struct(((F.col(f"_z{k}") + F.lit(bias[k])) * F.lit(UNIT / temperature)).alias("z"), F.lit(c).alias("family")) for k, c in enumerate(classes)])
    scored = scored.select("doc_id", "text_hash", "paragraph", "unit", "near", z.alias("z")).withColumn("top", F.array_max("z"))
    total = F.aggregate("z", F.lit(0.0), lambda a, v: a + F.exp(v["z"] - F.col("top.z")))
    out = scored.select("doc_id", "text_hash", "paragraph", "unit", F.col("top.family").alias("family"), (1 / total).alias("probability"), "near")
    sure = out.where((F.col("family") != UNKNOWN) & (F.col("probability") >= SURE) & F.array_contains("near", F.col("family")))
    return sure.groupBy("doc_id", "text_hash", "paragraph", "family").agg(F.max("probability").alias("probability"))


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, license (``none`` where no paragraph has one), probability, n_paragraphs and families of each row of ``docs``.

    license is the most probable paragraph's family.  Null and empty texts have none; rows that repeat a doc_id, null
    ones too, are each returned by their own text; an empty table gives no rows; other columns are left out.
    """
    found = paragraph_licenses(docs).groupBy("doc_id", "text_hash").agg(F.max(F.struct("probability", "family")).alias("top"), F.countDistinct("paragraph").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "top", "n", "families")
    rows = docs.select("doc_id", F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    return out.select("doc_id", F.coalesce("top.family", F.lit("none")).alias("license"), F.coalesce("top.probability", F.lit(0.0)).alias("probability"), F.coalesce("n", F.lit(0)).alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"))


def op10_license_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(common.documents(spark, sf_dir))
