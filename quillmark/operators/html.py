"""Article pages: one parse a page lists its elements and facts; grouping into sections is relational."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import sentences, word_count

# Titles of sections that are left out, and the class of a heading's own text.
SKIP = ("see also", "references", "external links", "further reading", "notes", "bibliography", "sources", "citations")
HEADLINE = "mw-headline"
_DROP = {"sup", "style", "script"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))?")
_KIND = pa.struct(
    [
        ("items", pa.list_(pa.struct([("ord", pa.int32()), ("sub", pa.int32()), ("tag", pa.string()), ("text", pa.string())]))),
        ("infobox", pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())]))),
        ("n_references", pa.int32()),
        ("disambiguation", pa.bool_()),
        ("text", pa.string()),
    ]
)
_SQL = "struct<items:array<struct<ord:int,sub:int,tag:string,text:string>>,infobox:array<struct<key:string,value:string>>,n_references:int,disambiguation:boolean,text:string>"


class _Page(HTMLParser):
    """Elements in document order without what stands in dropped ones.

    A heading, paragraph or list tag ends an open heading or paragraph, a list item one of the same list.  An item
    stands in each list around it, and its text holds that of the lists inside it.
    """

    def __init__(self, headings: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.headings = headings
        self.mark = ""  # stands for an & that begins no reference
        self.n, self.dropped = 0, 0
        self.items: list[tuple[int, int, str, list[str]]] = []
        self.block: list[str] | None = None
        self.headline: list[str] | None = None
        self.spans: list[bool] = []
        self.lists: list[tuple[int, list[list[str]]]] = []  # number, items so far
        self.open_items: list[tuple[int, list[str]]] = []  # depth of the list, text
        self.seen_box, self.box = False, 0  # tables open within the infobox
        self.rows: list[dict[str, list[str]]] = []
        self.cells: list[list[str]] = []
        self.pairs: list[tuple[str, str]] = []
        self.references: int | None = None
        self.reference_depth = 0
        self.disambiguation = False
        self.all: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        classes = a.get("class", "").split()
        if tag in _DROP:
            self.dropped += 1
        elif tag in self.headings or tag == "p":
            self.block = []
            self.headline, self.spans = None, []
            self.items.append((self.n, 0, tag, self.block))
            self.n += 1
        elif tag == "span" and self.block is not None:
            mine = HEADLINE in classes and self.headline is None and self.items[-1][2] in self.headings
            self.spans.append(mine)
            if mine:
                self.headline = []
                self.items[-1] = (*self.items[-1][:3], self.headline)
        elif tag in ("ul", "ol"):
            self.block = None
            self.lists.append((self.n, []))
            self.n += 1
            if tag == "ol" and self.references is None and "references" in classes:
                self.references, self.reference_depth = 0, len(self.lists)
        elif tag == "li":
            self.block = None
            while self.open_items and self.open_items[-1][0] >= len(self.lists):
                self.open_items.pop()
            text: list[str] = []
            self.open_items.append((len(self.lists), text))
            for number, held in self.lists:
                held.append(text)
                self.items.append((number, len(held), "li", text))
            if self.reference_depth:
                self.references += 1
        elif tag == "table":
            self.disambiguation |= a.get("id") == "disambig"
            if self.box:
                self.box += 1
            elif not self.seen_box and "infobox" in classes:
                self.seen_box, self.box = True, 1
        elif tag == "tr" and self.box:
            self.rows.append({})
        elif tag in ("th", "td") and self.box and self.rows:
            cell: list[str] = []
            self.cells.append(cell)
            self.rows[-1].setdefault(tag, cell)
        elif tag == "div":
            self.disambiguation |= "dmbox" in classes

    def handle_endtag(self, tag):
        if tag in _DROP:
            self.dropped = max(0, self.dropped - 1)
        elif tag in self.headings or tag == "p":
            self.block = None
        elif tag == "span" and self.spans:
            if self.spans.pop():
                self.block = None  # what follows the headline in its heading is no title
        elif tag in ("ul", "ol") and self.lists:
            self.block = None
            while self.open_items and self.open_items[-1][0] >= len(self.lists):
                self.open_items.pop()
            if self.reference_depth == len(self.lists):
                self.reference_depth = 0
            self.lists.pop()
        elif tag == "li" and self.open_items:
            self.block = None
            self.open_items.pop()
        elif tag in ("th", "td") and self.box and self.cells:
            self.cells.pop()
        elif tag == "tr" and self.box and self.rows:
            self._row(self.rows.pop())
        elif tag == "table" and self.box:
            self.box -= 1

    def handle_data(self, data):
        if self.dropped:
            return
        if self.mark:
            data = data.replace(self.mark, "&")
        self.all.append(data)
        if self.headline is not None and self.spans and any(self.spans):
            self.headline.append(data)
        elif self.block is not None and self.headline is None:
            self.block.append(data)
        for _, text in self.open_items:
            text.append(data)
        for cell in self.cells:
            cell.append(data)

    def _row(self, cells: dict[str, list[str]]) -> None:
        if "th" in cells and "td" in cells:
            key = "".join(cells["th"]).strip()
            value = re.sub(r"\s+", " ", re.sub(r"\[\d+\]", "", "".join(cells["td"]).strip()))
            if key and value:
                self.pairs.append((key, value))


def _held(html: str) -> tuple[str, str]:
    """``html`` with a character that it lacks for each ``&`` that begins no reference ended by its semicolon, and that character."""
    mark = next(c for c in map(chr, range(0xE000, 0xF900)) if c not in html)
    return _REFERENCE.sub(lambda m: mark + m[0][1:] if m[0] == "&" or m[1] and m[1] not in html5 else m[0], html), mark


def parsed(html: str | None, headings: frozenset[str] = frozenset(("h2", "h3", "h4")), unended: bool = True) -> dict:
    """items (place, place in its list, tag, text), infobox, n_references, disambiguation and the bare text of a page.

    References like ``&amp`` without their semicolon are read as HTML has it; without ``unended`` they stay as they stand.
    """
    p = _Page(headings)
    if html and not unended:
        html, p.mark = _held(html)
    p.feed(html or "")
    p.close()
    for row in p.rows:
        p._row(row)
    items = sorted(p.items, key=lambda x: x[:2])
    return {
        "items": [{"ord": o, "sub": s, "tag": t, "text": "".join(x)} for o, s, t, x in items],
        "infobox": [{"key": k, "value": v} for k, v in dict(p.pairs).items()],
        "n_references": p.references or 0,
        "disambiguation": p.disambiguation,
        "text": "".join(p.all),
    }


def parse(html: Column, headings: tuple[str, ...] = ("h2", "h3", "h4"), unended: bool = True) -> Column:
    """``parsed`` as a struct column; a null page is an empty one."""
    tags = frozenset(headings)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([parsed(x, tags, unended) for x in b.to_pylist()], type=_KIND)

    return F.arrow_udf(run, _SQL)(html)


def sections(pages: DataFrame, key: str, headings: tuple[str, ...] = ("h2", "h3", "h4"), unended: bool = True) -> DataFrame:
    """key, section, title, level, ref_level, content, sentences, word_count, has_citations, parent_section of ``pages`` (key, html).

    Text before the first heading, skipped titles and sections without text are left out.  ``level`` is the section's own;
    ``ref_level`` that of the next heading, 2 for the last section.  Markers like [1] are taken out before
    ``has_citations`` looks for them; no section has a parent.  ``unended`` is that of ``parsed``.
    """
    e = pages.select(key, F.explode(parse(F.col("html"), headings, unended)["items"]).alias("e")).select(key, "e.*")
    w = W.partitionBy(key).orderBy("ord", "sub")
    head, upto = F.col("tag").isin(*headings), w.rowsBetween(W.unboundedPreceding, 0)
    own = F.when(head, F.substring("tag", 2, 1).cast("int"))
    # the next heading is the last one from the end: a frame that grows is computed row by row
    back = W.partitionBy(key).orderBy(F.desc("ord"), F.desc("sub")).rowsBetween(W.unboundedPreceding, -1)
    e = e.withColumns(
        {
            "section": F.last(F.when(head, F.col("ord")), ignorenulls=True).over(upto),
            "title": F.last(F.when(head, F.col("text")), ignorenulls=True).over(upto),
            "level": F.last(own, ignorenulls=True).over(upto),
            "next": F.last(own, ignorenulls=True).over(back),
        }
    )
    bare = F.regexp_replace(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\[\d+\]", "")
    line = F.when(F.col("tag") == "p", F.regexp_replace(bare, r"\s+", " ")).otherwise(bare)
    body = e.withColumn("line", line).where(~head & F.col("section").isNotNull() & ~F.lower("title").isin(*SKIP))
    body = body.where(((F.col("tag") == "p") & (F.length("line") > 20)) | ((F.col("tag") == "li") & (F.length("line") > 10) & (F.col("sub") <= 10)))
    line = F.when(F.col("tag") == "li", F.concat(F.lit("• "), "line")).otherwise(F.col("line")).alias("line")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ord", "sub", line))), lambda x: x["line"])
    out = body.groupBy(key, "section").agg(F.first("title").alias("title"), F.first("level").alias("level"), F.coalesce(F.first("next"), F.lit(2)).alias("ref_level"), F.array_join(lines, " ").alias("content"))
    text = F.col("content")
    return out.withColumns({"sentences": sentences(text), "word_count": word_count(text), "has_citations": text.rlike(r"\[\d+\]"), "parent_section": F.lit(None).cast("string")})


def facts(pages: DataFrame, key: str) -> DataFrame:
    """key, infobox (a map), n_references and disambiguation of ``pages`` (key, html)."""
    p = pages.select(key, parse(F.col("html")).alias("_p"))
    return p.select(key, F.map_from_entries("_p.infobox").alias("infobox"), F.col("_p.n_references").alias("n_references"), F.col("_p.disambiguation").alias("disambiguation"))


def stripped(html: Column) -> Column:
    """The text of a piece of HTML."""
    return parse(html)["text"]


def articles(pages: DataFrame, key: str, headings: tuple[str, ...] = ("h2", "h3", "h4"), unended: bool = True) -> DataFrame:
    """``pages`` (key, html, further columns) with sections (an array in order), total_word_count, infobox, n_references and disambiguation in place of html.

    ``unended`` is that of ``parsed``, for the sections.
    """
    # a name of its own, as a key may be called like a column of the sections
    p = pages.select(F.col(key).alias("_page"), "html")
    one = F.struct("section", "title", "level", "content", "sentences", "word_count", "has_citations")
    s = sections(p, "_page", headings, unended).groupBy("_page").agg(F.array_sort(F.collect_list(one)).alias("sections"), F.sum("word_count").alias("total_word_count"))
    found = facts(p, "_page").join(s, "_page", "left")
    out = pages.drop("html").join(found, F.col(key) == F.col("_page")).drop("_page")
    return out.withColumn("total_word_count", F.coalesce("total_word_count", F.lit(0)))
