"""Captured pages: nodes by an HTML reader, then sections, lists, tables and text as sets.

`tokens` is the one Python step (Spark reads no HTML). It yields a row for each element and for each
text node, in document order, with what a reader knows as it passes: the parent, where the element
ends, the table around it, and the headings that a text stands under. All else is built from these
rows by groupings and windows, in proportion to the rows of a page.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DoubleType, IntegerType, LongType, ShortType, StringType, StructField, StructType
from pyspark.sql.window import Window as W

from ..sources.scratch import materialize

#: Elements without content of their own, elements that end others, and noise.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
ENDS = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dd", "dt"}, "dd": {"dd", "dt"}, "option": {"option"}, "a": {"a"}, **{h: HEADINGS for h in sorted(HEADINGS)}}
BLOCKS = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", *HEADINGS}
NOISE_TAGS = {"script", "style", "noscript", "iframe", "nav", "header", "footer", "aside", "svg", "template"}
NOISE_NAMES = {"nav", "navigation", "menu", "sidebar", "footer", "header", "breadcrumb", "breadcrumbs", "social", "share", "advertisement", "ads", "cookie", "popup", "modal"}
#: Elements whose whole text is kept beside them, and those at which words end.
TOLD = {"a", "strong", "p", "li", "td", "th", "caption", "dt", "dd", *HEADINGS}
BREAKS = BLOCKS | TOLD - {"a", "strong"} | {"br", "tr", "option", "title"}
#: The tag of text nodes.
TEXT = "#text"

_FIELDS = ["pos", "parent", "depth", "tag", "names", "href", "selector", "text", "noise", "end", "table", "under"]
TOKENS = "url string, pos int, parent int, depth int, tag string, names string, href string, selector string, text string, noise boolean, end int, table int, under array<struct<head:int,part:int>>"
_TYPES = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.struct([("head", pa.int32()), ("part", pa.int32())]))]
_SPACE = re.compile(r"\s+")
_REFERENCE = re.compile(r"&(?:(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)?")


def _whole_references(html: str) -> str:
    """Only known names and numbers that end in a semicolon stand for a sign; other ampersands are text."""
    return _REFERENCE.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or f"{m[1]};" in html5) else f"&amp;{m[0][1:]}", html)


class _Open:
    """An element that is being read: its children by tag, and the headings among them that are
    not yet followed by one of their level or above."""

    def __init__(self, tag: str, pos: int | None, table: int | None) -> None:
        self.tag, self.pos, self.table = tag, pos, table
        self.children: dict[str, int] = {}
        self.heads: list[tuple[str, int]] = []


class _Reader(HTMLParser):
    """Rows of a page: elements with their whole text where it is kept, and text nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open = [_Open("", None, None)]
        self.told: list[dict] = []
        self.gap = False

    def _close(self) -> None:
        last = self.open.pop()
        self.rows[last.pos]["end"] = len(self.rows)
        self.gap |= last.tag in BREAKS
        if self.told and self.told[-1]["pos"] == last.pos:
            row = self.told.pop()
            row["text"] = " ".join("".join(row["text"]).split())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends = ENDS.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        while self.open[-1].tag in ends:
            self._close()
        around, pos, values = self.open[-1], len(self.rows), dict(attrs)
        place = around.children[tag] = around.children.get(tag, 0) + 1
        above = self.rows[around.pos] if around.pos is not None else None
        names = f"{values.get('class') or ''} {values.get('id') or ''}".strip().lower()
        noise = tag in NOISE_TAGS or bool(NOISE_NAMES & set(names.split())) or bool(above and above["noise"])
        row = {
            "pos": pos, "parent": around.pos, "depth": len(self.open) - 1, "tag": tag, "names": names, "href": values.get("href"),
            "selector": f"{above['selector'] if above else ''}/{tag}[{place}]", "text": None, "noise": noise, "end": pos + 1, "table": around.table, "under": [],
        }
        self.rows.append(row)
        self.gap |= tag in BREAKS
        if tag in HEADINGS and not noise:
            around.heads = [h for h in around.heads if h[0] < tag] + [(tag, pos)]
        if tag not in VOID:
            self.open.append(_Open(tag, pos, pos if tag == "table" else around.table))
            if tag in TOLD:
                row["text"] = []
                self.told.append(row)

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.open[1:]):
            while self.open[-1].tag != tag:
                self._close()
            self._close()

    def handle_data(self, data: str) -> None:
        text = _SPACE.sub(" ", data)
        if text in ("", " "):
            self.gap |= text == " "
            return
        if self.gap and text[0] != " ":
            text = " " + text
        self.gap = False
        pos, around = len(self.rows), self.open[-1]
        noise = around.pos is not None and self.rows[around.pos]["noise"]
        below = [x.pos for x in self.open[1:]] + [pos]
        under = [{"head": head, "part": part} for x, part in zip(self.open, below, strict=True) for _, head in x.heads if head != part]
        self.rows.append({"pos": pos, "parent": around.pos, "depth": len(self.open) - 1, "tag": TEXT, "names": "", "href": None, "selector": None, "text": text, "noise": noise, "end": pos + 1, "table": around.table, "under": under})
        for row in self.told:
            if row["noise"] or not noise:
                row["text"].append(text)

    def close(self) -> None:
        super().close()
        while len(self.open) > 1:
            self._close()


def tokens(pages: DataFrame, key: str = "url") -> DataFrame:
    """One row per element and text node of each page (`key`, html).

    `key` tells pages apart and stands, as text, in the result's url: where an address was captured
    more than once, take a key of the capture, as rows with one url are one page to all that follows.
    pos, parent: places in document order; end: the place after the element's last; text: a text
    node's own, with a blank where a word starts, or an element's whole text (`TOLD`), without what
    is noise inside it; table: the nearest one around; under: of a text, each heading that it
    stands under, with the heading's sibling that it is in."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                urls, rows = [], []
                for url, html in zip(part.column("url").to_pylist(), part.column("html").to_pylist(), strict=True):
                    reader = _Reader()
                    reader.feed(_whole_references(html or ""))
                    reader.close()
                    urls += [url] * len(reader.rows)
                    rows += reader.rows
                yield pa.record_batch([pa.array(urls, pa.string()), *(pa.array([r[f] for r in rows], t) for f, t in zip(_FIELDS, _TYPES, strict=True))], ["url", *_FIELDS])

    return pages.select(F.col(key).cast("string").alias("url"), "html").mapInArrow(read, TOKENS)


def clean(found: DataFrame) -> DataFrame:
    return found.filter(~F.col("noise"))


def _tidy(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, " +", " "))


def page_text(found: DataFrame) -> DataFrame:
    """The readable text of each page, in order."""
    told = clean(found).filter(F.col("tag") == TEXT)
    return told.groupBy("url").agg(_tidy(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "")).alias("text"))


def links(found: DataFrame) -> DataFrame:
    return found.filter((F.col("tag") == "a") & F.col("href").isNotNull()).select(F.col("url").alias("src"), "href", "text", "pos")


def contacts(found: DataFrame) -> DataFrame:
    """The first mail address and web address of each page's links."""
    mail = F.regexp_extract("href", r"(?i)^mailto:([^?]+)", 1)
    rows = links(found).select("src", "pos", F.when(mail != "", mail).alias("mail"), F.when(F.col("href").rlike("^https?:"), F.col("href")).alias("web"))
    return rows.groupBy(F.col("src").alias("url")).agg(F.min_by("mail", F.when(F.col("mail").isNotNull(), F.col("pos"))).alias("email"), F.min_by("web", F.when(F.col("web").isNotNull(), F.col("pos"))).alias("website"))


def heading_sections(found: DataFrame, least: int = 10, least_text: int = 50) -> DataFrame:
    """A section for each heading of `least` signs: what follows it under the same parent up to the
    next heading of its level or above, sub-sections included, if that has `least_text` signs. Parts
    (the heading's siblings) are set apart by an empty line."""
    heads = clean(found).filter(F.col("tag").rlike("^h[1-6]$") & (F.length("text") >= least))
    heads = heads.select("url", "pos", F.substring("tag", 2, 1).cast("int").alias("level"), F.col("text").alias("heading"), "selector")
    told = clean(found).filter(F.col("tag") == TEXT).select("url", F.col("pos").alias("at"), "text", F.explode("under").alias("under"))
    pieces = told.groupBy("url", F.col("under.head").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("at", F.col("under.part").alias("part"), "text"))).alias("pieces"))
    apart = lambda s, i: F.when((i > 0) & (F.get(F.col("pieces"), i - 1)["part"] != s["part"]), F.concat(F.lit("\n\n"), F.ltrim(s["text"]))).otherwise(s["text"])
    text = F.regexp_replace(_tidy(F.array_join(F.transform("pieces", apart), "")), " ?\n\n ?", "\n\n")
    return heads.join(pieces.select("url", "pos", text.alias("text")), ["url", "pos"]).filter(F.length("text") >= least_text)


def context(found: DataFrame, tags: list[str], short: int) -> DataFrame:
    """What introduces an element: the nearest heading or short paragraph before it under the
    same parent."""
    fits = F.col("tag").rlike("^h[1-6]$") | ((F.col("tag") == "p") & (F.length("text") < short))
    before = W.partitionBy("url", "parent").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    marked = clean(found).filter(F.col("tag").isin(*tags) | fits)
    marked = marked.withColumn("context", F.last(F.when(fits & (F.col("text") != ""), F.col("text")), ignorenulls=True).over(before))
    return marked.filter(F.col("tag").isin(*tags)).select("url", "pos", "context", "table")


def list_segments(found: DataFrame, least: int = 50) -> DataFrame:
    """Lists of `least` signs as bulleted lines, with the heading or short paragraph before them;
    lists in tables belong to those."""
    items = clean(found).filter((F.col("tag") == "li") & (F.col("text") != "")).select("url", F.col("parent").alias("pos"), F.col("pos").alias("at"), F.concat(F.lit("• "), "text").alias("line"))
    text = items.groupBy("url", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda s: s["line"]), "\n").alias("items"))
    lists = context(found, ["ul", "ol"], 300).filter("table is null")
    return text.filter(F.length("items") >= least).join(lists, ["url", "pos"]).select("url", "pos", F.concat_ws("\n\n", "context", "items").alias("text"))


def table_segments(found: DataFrame, most: int = 10, least: int = 50) -> DataFrame:
    """Tables as lines of `head: value` pairs, `most` rows of them, after their caption, heading or
    short paragraph. Rows with another number of cells than the first are given plainly. A nested
    table's rows are its own."""
    rows = clean(found)
    cells = rows.filter(F.col("tag").isin("td", "th")).select("url", F.col("parent").alias("row"), "pos", "text")
    cells = cells.groupBy("url", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]).alias("cells"))
    own = rows.filter("tag = 'tr' and table is not null").select("url", F.col("pos").alias("row"), F.col("table").alias("pos"))
    grid = cells.join(own, ["url", "row"]).groupBy("url", "pos").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda s: s["cells"]).alias("grid"))
    captions = rows.filter("tag = 'caption'").groupBy("url", F.col("table").alias("pos")).agg(F.min_by("text", "pos").alias("caption"))
    told = context(found, ["table"], 200).select("url", "pos", "context")
    joined = grid.filter(F.size("grid") > 1).join(told, ["url", "pos"], "left").join(captions, ["url", "pos"], "left")
    heads = F.get("grid", F.lit(0))
    pairs = lambda r: F.transform(F.filter(F.arrays_zip(heads.alias("h"), r.alias("c")), lambda z: z["c"] != ""), lambda z: F.concat_ws(": ", z["h"], z["c"]))
    line = lambda r: F.array_join(F.when(F.size(r) == F.size(heads), pairs(r)).otherwise(r), " | ")
    more = F.when(F.size("grid") - 1 > most, F.format_string("... and %d more rows", F.size("grid") - 1 - most))
    intro = F.coalesce("caption", "context")
    title = F.when(intro != "", F.concat(F.lit("TABLE: "), intro, F.lit("\n")))
    text = F.concat_ws("\n", title, F.concat(F.lit("HEADERS: "), F.array_join(heads, " | ")), F.lit("-" * 50), F.array_join(F.transform(F.slice("grid", 2, most), line), "\n"), more)
    signs = F.aggregate(F.flatten("grid"), F.lit(0), lambda n, c: n + F.length(c))
    return joined.filter(signs >= least).select("url", "pos", text.alias("text"))


def paragraphs(found: DataFrame, least: int = 50) -> DataFrame:
    return clean(found).filter((F.col("tag") == "p") & F.col("table").isNull() & (F.length("text") >= least)).select("url", "pos", "text")


def segments(found: DataFrame) -> DataFrame:
    """Sections, lists, tables and paragraphs of every page (they overlap), by place and kind.

    Pages are read once: their nodes are written, as all kinds are built from them.
    """
    found = materialize(found)
    kind = lambda df, name: df.select("url", "pos", F.lit(name).alias("kind"), "text")
    sections = heading_sections(found).withColumn("text", F.concat_ws("\n\n", "heading", "text"))
    out = kind(sections, "section")
    for name, part in (("list", list_segments(found)), ("table", table_segments(found)), ("paragraph", paragraphs(found))):
        out = out.unionByName(kind(part, name))
    return out


#: How cards of faculty members are named, where their names stand, their titles (the
#: first that the text holds, the longer ones first), and the research areas that are looked for.
CARD_NAMES = r"faculty|person|profile|member|staff|people"
CARD_NAME_TAGS = ["h2", "h3", "h4", "strong", "a"]
TITLES = ["Associate Professor", "Assistant Professor", "Professor"]
AREAS = [
    "social psychology", "social cognition", "attitudes", "prejudice", "stereotyping", "group dynamics", "intergroup", "social influence", "interpersonal", "relationships",
    "social identity", "self", "emotion", "motivation", "culture", "social neuroscience", "prosocial", "aggression", "cooperation", "social judgment",
]


def cards(found: DataFrame, areas: list[str] = AREAS, names: str = CARD_NAMES, most: int = 5) -> DataFrame:
    """Name, title, areas, mail and web address of each card of a faculty page that names an area.

    A card is an element named so; one inside another is part of it. The name is that of the first
    heading, strong text or link; areas are the first `most` of the list."""
    rows = clean(found)
    before = W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy("url").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    named = rows.withColumn("card_end", F.when((F.col("tag") != TEXT) & F.col("names").rlike(names), F.col("end")))
    top = F.col("card_end").isNotNull() & (F.coalesce(F.max("card_end").over(before), F.lit(0)) <= F.col("pos"))
    named = named.withColumn("top", top).withColumn("card", F.last(F.when(F.col("top"), F.struct("pos", "end")), ignorenulls=True).over(upto))
    inside = named.filter((F.col("pos") > F.col("card.pos")) & (F.col("pos") < F.col("card.end")))
    first = lambda value, when: F.min_by(value, F.when(when, F.col("pos")))
    out = inside.groupBy("url", F.col("card.pos").alias("pos_")).agg(
        first("text", F.col("tag").isin(*CARD_NAME_TAGS)).alias("name"),
        first("href", F.col("href").startswith("mailto:")).alias("mail"),
        first("href", F.col("href").contains("http")).alias("website"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("tag") == TEXT, F.struct("pos", "text")))), lambda s: s["text"]), "").alias("said"),
    )
    title = F.coalesce(F.get(F.filter(F.array(*map(F.lit, TITLES)), lambda t: F.contains(F.col("said"), t)), F.lit(0)), F.lit("Professor"))
    known = F.slice(F.transform(F.filter(F.array(*map(F.lit, areas)), lambda x: F.contains(F.lower("said"), x)), lambda x: F.initcap(x)), 1, most)
    told = out.withColumns({"title": title, "areas": known}).filter((F.length("name") >= 3) & (F.size("areas") > 0))
    return told.select("url", F.col("pos_").alias("pos"), "name", "title", "areas", F.regexp_replace("mail", "^mailto:", "").alias("email"), "website")


#: Characters of an Arrow batch, a few megabytes.
CHAR_ROWS = 50_000


def text_blocks(chars: DataFrame, line_step: float = 2.0, block_step: float = 10.0, least: int = 30) -> DataFrame:
    """Characters of a laid-out page grouped into blocks: a new line where the height leaves the
    line's by more than `line_step`, a new block where it leaves it by more than `block_step`.

    chars: page, pos, top, bottom, x0, x1, size, text. A line's height is that of its first
    character, so the characters of a page pass in order, and nothing but the line's height and the
    number of the block is kept in mind; pages are dealt over the tasks. Neighbours that are surely of
    one block are put together where they lie, and written, before they are dealt.
    """
    names = ["page", "pos", "top", "bottom", "x0", "x1", "size", "text"]
    if 0 <= line_step <= block_step:
        runs = _written(_runs(chars.select(*names), line_step, block_step))
    else:
        runs = chars.select(*names, F.col("size").cast("double").alias("sizes"), F.col("size").isNotNull().cast("long").alias("sized"), F.col("top").alias("low"), F.lit(None).cast("double").alias("line"))
    ordered = runs.drop("size").repartition("page").sortWithinPartitions("page", "pos", "text")
    told = ["x0", "low", "x1", "bottom"]
    kinds = [("page", runs.schema["page"].dataType), ("block", IntegerType()), ("text", StringType()), *((x, runs.schema[x].dataType) for x in told), ("sizes", DoubleType()), ("sized", LongType())]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = line = held = None  # held: the block that rows are added to
        block = 0
        types = {"block": pa.int32()}

        def out(done: list) -> pa.RecordBatch:
            values = dict(zip((name for name, _ in kinds), zip(*done, strict=True), strict=True))
            values["text"] = ["".join(x for x in texts if x is not None) for texts in values["text"]]
            return pa.record_batch([pa.array(v, types[name]) for name, v in values.items()], list(values))

        for batch in batches:
            types |= {f.name: f.type for f in batch.schema}
            done = []
            for own, top, last, text, sizes, sized, *bounds in zip(*(batch.column(x).to_pylist() for x in ("page", "top", "line", "text", "sizes", "sized", *told)), strict=True):
                new = held is None or own != page
                if new:
                    page, line, block = own, None, 0
                moved = None if line is None or top is None else abs(top - line)
                if moved is not None and moved > block_step:
                    block, new = block + 1, True
                if line is None or moved is not None and moved > line_step:
                    line = top
                if last is not None:
                    line = last
                if new:
                    if held is not None:
                        done.append(held)
                    held = [own, block, [text], *bounds, sizes, sized]
                else:
                    held[2].append(text)
                    held[3:7] = _least(held[3], bounds[0]), _least(held[4], bounds[1]), _most(held[5], bounds[2]), _most(held[6], bounds[3])
                    held[7] = sizes if held[7] is None else held[7] + (sizes or 0.0)
                    held[8] += sized
            if done:
                yield out(done)
        if held is not None:
            yield out([held])

    each = ordered.mapInArrow(number, StructType([StructField(*kind) for kind in kinds]))
    blocks = each.select("page", "block", "text", "x0", F.col("low").alias("top"), "x1", "bottom", F.try_divide("sizes", "sized").alias("size"))
    return blocks.filter(F.length("text") >= least)


def _least(one: float | None, other: float | None) -> float | None:
    """The lesser; null is none, and NaN is over all numbers."""
    if one is None or other is None:
        return other if one is None else one
    return other if one != one or other < one else one


def _most(one: float | None, other: float | None) -> float | None:
    if one is None or other is None:
        return other if one is None else one
    return other if other != other or other > one else one


def _written(runs: DataFrame) -> DataFrame:
    """The rows, written by Arrow batches of `CHAR_ROWS` that are limited by their rows alone: a batch with
    a limit in bytes is measured anew after each row, which takes four times as long as a character's
    whole way to Python. Steps in Python that `runs` are made by share that; later steps and other queries
    have the session's limits again."""
    conf = runs.sparkSession.conf
    asked = {"spark.sql.execution.arrow.maxRecordsPerBatch": CHAR_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": 2**31 - 1}
    before = {key: conf.get(key, None) for key in asked}
    try:
        for key, value in asked.items():
            conf.set(key, value)
        return materialize(runs)
    finally:
        for key, value in before.items():
            conf.unset(key) if value is None else conf.set(key, value)


def _runs(chars: DataFrame, line_step: float = 2.0, block_step: float = 10.0) -> DataFrame:
    """Characters that follow each other, with places one apart, as one row while they are of one height,
    or surely of one block: its first place and height, its text, its bounds, the sum of sizes and their
    number, and the height of its last line where that is known. Rows without a number stay alone, as do
    all where places are no whole numbers."""
    whole = isinstance(chars.schema["pos"].dataType, (ByteType, ShortType, IntegerType, LongType))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part = {name: batch.column(name) for name in batch.schema.names}
            numbers = ["top", "bottom", "x0", "x1", "size"]
            odd = np.zeros(batch.num_rows, dtype=bool)
            for name in ["page", "pos", "text", *numbers]:
                odd |= part[name].is_null(nan_is_null=name in numbers).to_numpy(zero_copy_only=False)
            page = part["page"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            linked = np.zeros(batch.num_rows, dtype=bool)
            if whole:
                pos, top = (pc.fill_null(part[x], 0).to_numpy(zero_copy_only=False) for x in ("pos", "top"))
                linked[1:] = (page[1:] == page[:-1]) & (np.diff(pos.astype(np.int64)) == 1) & ~odd[1:] & ~odd[:-1]
                starts = np.flatnonzero(~linked | np.r_[True, top[1:] != top[:-1]])
            else:
                starts = np.arange(batch.num_rows)
            lines = [None] * len(starts)
            if whole and top.dtype.kind in "fiu":
                kept, lines = _one_block(top[starts].tolist(), linked[starts].tolist(), line_step, block_step)
                starts = starts[kept]
            first = pa.array(starts)
            bound = lambda name, least: _bound(part[name], starts, first, least)  # noqa: B023, E731
            text = part["text"].cast(pa.large_string()).fill_null("")
            ends = text.cast(pa.large_binary()).buffers()[1]
            offsets = np.frombuffer(ends, dtype=np.int64)[text.offset : text.offset + batch.num_rows + 1][np.r_[starts, batch.num_rows]]
            told = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), text.buffers()[2]).cast(pa.string())
            size = part["size"].cast(pa.float64())
            sizes = np.add.reduceat(size.fill_null(0.0).to_numpy(zero_copy_only=False), starts)
            sized = np.add.reduceat(size.is_valid().to_numpy(zero_copy_only=False).astype(np.int64), starts)
            columns = [part["page"].take(first), part["pos"].take(first), part["top"].take(first), bound("bottom", False), bound("x0", True), bound("x1", False), part["size"].take(first), told]
            yield pa.record_batch([*columns, pa.array(sizes, pa.float64(), mask=sized == 0), pa.array(sized), bound("top", True), pa.array(lines, pa.float64())], names)

    fields = [*chars.schema.fields, StructField("sizes", DoubleType()), StructField("sized", LongType()), StructField("low", chars.schema["top"].dataType), StructField("line", DoubleType())]
    names = [f.name for f in fields]
    return chars.mapInArrow(fold, StructType(fields))


def _one_block(tops: list[float], linked: list[bool], line_step: float, block_step: float) -> tuple[list[int], list[float | None]]:
    """Which runs, of one height each, begin a row, and the line's height at the row's end, if it is known.

    A run's line is at most `line_step` from its height. So the line is known from the first run on that
    is over twice that from the one before (here two and a half times, for what rounding does); up to
    there a run is of the block before only if its height is as near as every such line allows."""
    begin, lines, line, before = [], [], None, 0.0
    for k, (top, on) in enumerate(zip(tops, linked, strict=True)):
        if not on:
            new, line = True, None
        elif line is not None:
            moved = abs(top - line)
            new = moved > block_step
            line = top if moved > line_step else line
        else:
            moved = abs(top - before)
            sure = moved > 2.5 * line_step
            new = not (sure and moved <= block_step - 1.5 * line_step)
            line = top if sure else None
        if new:
            begin.append(k)
            lines.append(line)
        else:
            lines[-1] = line
        before = top
    return begin, lines


def _bound(values: pa.Array, starts: np.ndarray, first: pa.Array, least: bool) -> pa.Array:
    """The least or the greatest value of each run; null where its only row has none."""
    own = (np.minimum if least else np.maximum).reduceat(pc.fill_null(values, 0).to_numpy(zero_copy_only=False), starts)
    return pa.array(own, values.type, mask=values.take(first).is_null().to_numpy(zero_copy_only=False))


#: How headings of documents look.
HEADING_PATTERNS = r"^[A-Z][A-Z\s]+$|^\d+\.\s*[A-Z]|^[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*:?$"
HEADING_WORDS = ["requirements", "admission", "application", "deadline", "tests", "english", "international"]


def is_heading(text: Column, size: Column | None = None) -> Column:
    large = size > 14 if size is not None else F.lit(False)
    named = F.exists(F.array(*map(F.lit, HEADING_WORDS)), lambda w: F.contains(F.lower(text), w))
    return F.length(text).between(5, 100) & (text.rlike(HEADING_PATTERNS) | large | named)


def extracted(chars: DataFrame, other_blocks: DataFrame, tables: DataFrame, least: int = 30) -> DataFrame:
    """Blocks and tables of one document by two extractors: `chars` are grouped into blocks here,
    `other_blocks` (page, text) came as blocks, `tables` (page, rows: array of arrays of cells) need
    two rows; all need `least` signs. page, kind, text; copies are left to `sets.by_prefix`."""
    own = text_blocks(chars, least=least).select("page", F.lit("block").alias("kind"), "text")
    theirs = other_blocks.filter(F.length(F.trim("text")) >= least).select("page", F.lit("block").alias("kind"), F.trim("text").alias("text"))
    line = lambda r: F.array_join(F.transform(r, lambda c: F.trim(F.coalesce(c, F.lit("")))), " | ")
    as_text = tables.filter(F.size("rows") >= 2).select("page", F.lit("table").alias("kind"), F.array_join(F.transform("rows", line), "\n").alias("text"))
    return own.unionByName(theirs).unionByName(as_text.filter(F.length("text") >= least))
