"""Labelled examples: templates filled from slot values, noisy copies, appended examples.

Choices come from md5 of a seed, a row's key and the choice's name, so a row's result depends neither on its partition
nor on a retry, and SQL can repeat it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

EXAMPLE = "text string, label string, source string, confidence double"
#: Characters whose capitals are several letters, and the one letter that stands for each by itself.
_SEVERAL = "".join(c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1)
_CAPITAL = "".join("ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in _SEVERAL)


def draw(seed: int, purpose: str, *key: Column) -> Column:
    """A number from 0 to 2**32 - 1."""
    h = F.md5(F.concat_ws(":", F.lit(seed), F.lit(purpose), *[k.cast("string") for k in key]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def fill(templates: DataFrame, values: dict[str, list[str]], copies: int = 10, seed: int = 42) -> DataFrame:
    """``copies`` examples of each template (template_id, label, template), every ``{slot}`` replaced by one of its values.

    A slot takes the values of its name without trailing characters of ``_abcdefg``, else those of its whole name;
    a slot that neither names stays as it is.  Each occurrence is drawn anew.  A null template gives null texts.
    """
    known = F.create_map(*[c for k, v in values.items() for c in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = templates.select("template_id", "label", "template", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    names = F.regexp_extract_all("template", F.lit(r"\{(\w+)\}"), 1)

    def one(name: Column, i: Column) -> Column:
        options = F.coalesce(known[F.regexp_replace(name, "[_abcdefg]+$", "")], known[name])
        pick = F.pmod(draw(seed, "slot", F.col("template_id"), F.col("copy"), i), F.size(options)).cast("int")
        return F.coalesce(F.get(options, pick), F.concat(F.lit("{"), name, F.lit("}")))

    # one piece more than there are slots
    parts = F.zip_with(F.split("template", r"\{\w+\}", -1), F.transform(names, one), lambda piece, value: F.concat(piece, F.coalesce(value, F.lit(""))))
    text = F.when(F.col("template").isNotNull(), F.array_join(parts, "")).alias("text")
    return rows.select("template_id", "copy", text, "label", F.lit("template").alias("source"), F.lit(1.0).alias("confidence"))


def swapped(text: Column, at: Column) -> Column:
    """``text`` with the characters at ``at`` and after it (from 0) exchanged."""
    return F.concat(F.substr(text, F.lit(1), at), F.substr(text, at + 2, F.lit(1)), F.substr(text, at + 1, F.lit(1)), F.substr(text, at + 3))


def uppered(text: Column) -> Column:
    """``text`` in capitals, letter by letter: never longer, ß becomes ẞ."""
    one = lambda c: F.when(F.length(F.upper(c)) > 1, F.translate(c, _SEVERAL, _CAPITAL)).otherwise(F.upper(c))
    return F.array_join(F.transform(F.split(text, ""), one), "")


def lowered(text: Column) -> Column:
    """``text`` in small letters, letter by letter, whatever stands beside one: never longer, Σ becomes σ."""
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.substring(F.lower(c), 1, 1)), "")


def noisy(text: Column, key: Column, seed: int = 42) -> Column:
    """``text`` with one change: two neighbouring characters swapped, its case changed letter by letter, or a word but the first left out.

    Texts of up to 3 characters (swap) or 3 words (word) stay as they are.
    """
    at = (F.pmod(draw(seed, "at", key), F.greatest(F.length(text) - 2, F.lit(1))) + 1).cast("int")
    words = T.words(text)
    gone = F.pmod(draw(seed, "word", key), F.greatest(F.size(words) - 1, F.lit(1))) + 1
    kind = F.pmod(draw(seed, "kind", key), F.lit(3))
    cased = F.when(F.pmod(draw(seed, "case", key), F.lit(2)) == 0, lowered(text)).otherwise(uppered(text))
    return (
        F.when((kind == 0) & (F.length(text) > 3), swapped(text, at))
        .when(kind == 1, cased)
        .when((kind == 2) & (F.size(words) > 3), F.array_join(F.filter(words, lambda w, i: i != gone), " "))
        .otherwise(text)
    )


def augment(examples: DataFrame, key: str, ratio: float = 0.3, seed: int = 42) -> DataFrame:
    """``examples`` (text, label, source, confidence and ``key``) and a noisy copy of a share ``ratio`` of them."""
    chosen = examples.where(draw(seed, "keep", F.col(key)) <= ratio * 2**32)
    copies = chosen.withColumns({"text": noisy(F.col("text"), F.col(key), seed), "source": F.lit("augmented"), "confidence": F.lit(0.9)})
    return examples.unionByName(copies)


def append_manual(examples: DataFrame, manual: list[tuple[str, str]]) -> DataFrame:
    """``examples`` and hand-written (text, label) rows, with the columns of ``EXAMPLE``."""
    rows = [(text, label, "manual", 1.0) for text, label in manual]
    return examples.select("text", "label", "source", "confidence").unionByName(examples.sparkSession.createDataFrame(rows, EXAMPLE))
