"""Text expressions: sentences, words, token sets, cleaning.  All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The customary English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his himself
    she she's her hers herself it it's its itself they them their theirs themselves what which who whom this that that'll
    these those am is are was were be been being have has had having do does did doing a an the and but if or because as
    until while of at by for with about against between into through during before after above below to from up down in
    out on off over under again further then once here there when where why how all any both each few more most other
    some such no nor not only own same so than too very s t can will just don don't should should've now d ll m o re ve y
    ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't ma mightn
    mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won won't wouldn wouldn't
    """.split()
)


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` and white space; trimmed, blanks dropped."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def word_set(text: Column) -> Column:
    """Distinct lower-case words, punctuation kept."""
    return F.array_distinct(words(F.lower(text)))


def token_set(text: Column) -> Column:
    """Distinct runs of word characters, longer than two, without stop words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS)))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def clean_comment(text: Column) -> Column:
    """Markdown links to their text, runs of newlines to two, entities, ``Edit:`` to the end of its line, outer space."""
    out = F.regexp_replace(text, r"\[([^\]]+)\]\([^)]+\)", "$1")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    for entity, char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.regexp_replace(out, r"(?dim)Edit:.*$", "")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def truncated(text: Column, most: int = 150) -> Column:
    """At most ``most`` characters, ended at the last full stop."""
    head = F.regexp_replace(F.left(text, F.lit(most)), r"\.[^.]*$", "")
    return F.when(F.length(text) > most, F.concat(head, F.lit("."))).otherwise(text)


def quoted(title: Column) -> Column:
    """A title as a URL path: spaces to underscores, then percent-quoted."""
    out = F.url_encode(F.replace(title, F.lit(" "), F.lit("_")))
    for a, b in (("%2F", "/"), ("%7E", "~"), ("*", "%2A"), ("+", "%20")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out
