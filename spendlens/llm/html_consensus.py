"""HTML extraction by consensus host paths.

Each page scores its containers by the text that stands in them outside of
boilerplate and links, and votes for the generalised tag-class path of the best
one: the article or main around it, else the highest container that adds
headings, paragraphs or further parts of an article to it.  Votes are counted per host and path (combined before the shuffle); the
paths with the most votes of a host win.  In a second pass every page extracts
the containers at the first winning path it has, or its own best container if it
has none, so one odd page cannot choose and one odd template is not lost.

Boilerplate (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments, hidden parts) is known by element, role, class or id
and never extracted; a container that only its class or id marks counts as page
layout if the page's article, or nearly all text of a page without one, stands in
it.  Text: character references decoded, white space inside a
block turned into one space, blocks joined in page order by one space.

The winners reach the pages by broadcast up to ``MAX_BROADCAST_HOSTS`` rows;
beyond, pages and winners meet by host and one of ``SALTS`` salts, so a host with
a third of all pages is dealt over many tasks.  Pages pass whole.

Edge cases: NULL and empty html give an empty text; a NULL url belongs to the
host of no name; repeated pages vote and are returned each; unclosed or stray
tags, comments and attributes are read as browsers do; extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spendlens.llm.common import bound_batches, texts, written

WINNERS = 3
MAX_BROADCAST_HOSTS = 200_000
SALTS = 32

# Element kinds and the names that mark boilerplate.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu "
    "nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split())
_FRAME = frozenset("html table tbody tfoot thead tr".split())
CONTAINER = frozenset("article body center div main section td".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
SKIPPED = frozenset(
    "aside audio button canvas dialog embed footer head iframe input label menu nav noembed "
    "noframes noscript object script search select style svg template textarea title video xmp"
    .split())
SKIPPED_ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split())
BOILERPLATE = frozenset(
    "ad ads adsense advert advertisement adverts aside banner breadcrumb breadcrumbs comment "
    "commentlist comments consent cookie cookies copyright disqus disclaimer footer gdpr login "
    "masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager "
    "pagination paywall popup print promo promotion recommended related replies respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets".split())
#: Words beside which a boilerplate word still names boilerplate ("comment-list",
#: "site-header"); beside any other word it is a topic ("comment-on-law").
STRUCTURE = frozenset(
    "area article articles bar block bottom box btn button buttons col column container content "
    "counter desktop entry feed fixed form frame global group holder icons inline inner item items "
    "layer left link links list main mobile module more news outer page panel post posts primary "
    "region right row secondary section side site slot sticky story tag teaser text this thread "
    "title top tools unit user view wrap wrapper".split())
#: An open paragraph or item ends where one of these begins.
ENDS_P = BLOCK - frozenset("caption head html legend option summary tbody td tfoot th thead tr "
                           "body title".split())
SAME_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
             "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(
    r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_NAME = re.compile(r"[a-z]+")
#: Names that say what a page's layout has or lacks.
_LAYOUT = re.compile(r"(?<!\S)(?:has|no|with|without)[-_]\S*")
_OUTSIDE = BOILERPLATE | {"header"}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)}


def is_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Boilerplate by element, role or hiding."""
    if tag in SKIPPED or tag == "header" and not in_article:
        return True
    return attrs.get("role", "").lower() in SKIPPED_ROLES or "hidden" in attrs or attrs.get(
        "aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))


def is_named_boilerplate(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    """Boilerplate by class or id: a name of boilerplate words and at most words of
    structure beside them.  A form counts as such a part, as it may hold the page."""
    if tag in ("html", "body", "article", "main"):
        return False
    marks = BOILERPLATE if in_article else _OUTSIDE
    given = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
    for name in _LAYOUT.sub(" ", given).split():
        words = {w for w in _NAME.findall(name) if len(w) > 1}
        if not words.isdisjoint(marks) and words <= marks | STRUCTURE:
            return True
    return tag == "form"


def label(tag: str, attrs: dict[str, str]) -> str:
    """Tag and classes without numbers: the same for all pages of a template."""
    classes = sorted({re.sub(r"\d+", "#", c) for c in attrs.get("class", "").lower().split()})
    return ".".join([tag, *classes[:3]])


@dataclass
class Box:
    """A container: its path and the run of blocks that stand in it."""

    path: str
    tag: str
    parent: int
    first: int
    last: int = 0
    score: float = 0.0
    text: float = 0.0   # weight of all blocks in it
    prose: float = 0.0  # of those directly in it that are headings, paragraphs, ...


@dataclass
class Named:
    """A part that class or id mark as boilerplate."""

    parent: int
    text: int = 0
    articles: int = 0
    mains: int = 0


class Page:
    """Blocks of text outside boilerplate, and the containers around them."""

    def __init__(self, html: str):
        self._parse(html, frozenset())
        layout = self._layout()
        if layout:
            self._parse(html, layout)

    def _parse(self, html: str, layout: frozenset[int]) -> None:
        """Read the page; the parts numbered in ``layout`` are no boilerplate."""
        self._named, self._kept = [Named(-1)], layout
        self.blocks: list[str] = []
        self.boxes: list[Box] = [Box("", "", -1, 0)]
        # Tag, box, boilerplate, and the part by class or id (-1 in other boilerplate).
        self._open: list[tuple[str, int, bool, int]] = [("", 0, False, 0)]
        self._parts: list[str] = []
        self._in_links = self._links = 0
        self._read(html)
        self._end_block()
        self._close_to(1)
        self.boxes[0].last = len(self.blocks)
        for box in reversed(self.boxes[1:]):
            self.boxes[box.parent].text += box.text

    def _layout(self) -> frozenset[int]:
        """Named parts that hold the page's article or, on a page without one,
        three quarters of its text."""
        for part in reversed(self._named[1:]):
            up = self._named[part.parent]
            up.text, up.articles, up.mains = (
                up.text + part.text, up.articles + part.articles, up.mains + part.mains)
        page, out = self._named[0], []
        for i, part in enumerate(self._named[1:], 1):
            if part.articles + part.mains < page.articles + page.mains:
                continue
            # Several articles that are the smaller half are comments or links.
            if part.mains or part.articles == 1 or part.text > page.text * (
                    0.5 if part.articles else 0.75):
                out.append(i)
        return frozenset(out)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue  # comment, doctype, instruction
            tag, closing, rest = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
            if closing:
                self._end(tag)
                continue
            self._start(tag, rest)
            if tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                at = close.start() if close else end

    def _text(self, raw: str) -> None:
        part = self._open[-1][3]
        if part >= 0 and not self._in_links:
            self._named[part].text += len(raw.strip())
        if not self._open[-1][2]:
            self._parts.append(unescape(raw) if "&" in raw else raw)
            if self._in_links:
                self._links += len(raw)

    def _end_block(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            self._parts.clear()
            if text:
                self.blocks.append(text)
                weight, box = max(0.0, len(text) - 2.0 * self._links), self._open[-1][1]
                self.boxes[box].score += weight
                self.boxes[box].text += weight
                if self._open[-1][0] not in CONTAINER and self._open[-1][0] in BLOCK - _FRAME:
                    self.boxes[box].prose += weight
                if self.boxes[box].parent >= 0:
                    self.boxes[self.boxes[box].parent].score += weight / 2
        self._links = 0

    def _close_to(self, depth: int) -> None:
        while len(self._open) > depth:
            tag, box, _, _ = self._open.pop()
            if box != self._open[-1][1]:
                self.boxes[box].last = len(self.blocks)

    def _start(self, tag: str, rest: str) -> None:
        if tag == "br" or tag == "hr":
            self._parts.append(" ")
        if tag in VOID:
            return
        if tag not in BLOCK and tag not in SKIPPED:
            self._in_links += tag == "a"
            return
        self._end_block()
        if tag in ENDS_P:
            self._close("p", stop=CONTAINER)
        for other in SAME_ENDS.get(tag, ()):
            self._close(other, stop=frozenset(("ul", "ol", "dl", "table", "select")))
        attrs = attributes(rest) if rest else {}
        _, box, skip, part = self._open[-1]
        inside = any(t in ("article", "main") for t, *_ in self._open)
        if part >= 0 and is_boilerplate(tag, attrs, inside):
            skip, part = True, -1
        elif part >= 0 and is_named_boilerplate(tag, attrs, inside):
            self._named.append(Named(part))
            part = len(self._named) - 1
            skip = skip or part not in self._kept
        if part >= 0:
            self._named[part].articles += tag == "article"
            self._named[part].mains += tag == "main"
        if not skip:
            if tag in CONTAINER:
                path = f"{self.boxes[box].path}>{label(tag, attrs)}"
                self.boxes.append(Box(path, tag, box, len(self.blocks)))
                box = len(self.boxes) - 1
        if not rest.endswith("/") or tag in BLOCK:
            self._open.append((tag, box, skip, part))

    def _close(self, tag: str, stop: frozenset) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            if self._open[depth][0] == tag:
                self._close_to(depth)
                return
            if self._open[depth][0] in stop:
                return

    def _end(self, tag: str) -> None:
        if tag not in BLOCK and tag not in SKIPPED:
            self._in_links = max(0, self._in_links - (tag == "a"))
            return
        if any(t == tag for t, *_ in self._open):
            self._end_block()
            depth = max(i for i, (t, *_) in enumerate(self._open) if t == tag)
            self._close_to(depth)

    def best(self) -> int:
        """The box with the highest score, or the article around it."""
        box = max(range(len(self.boxes)), key=lambda i: (self.boxes[i].score, -i))
        for wanted in ("article", "main"):
            up = box
            while up > 0:
                if self.boxes[up].tag == wanted:
                    return up
                up = self.boxes[up].parent
        return self._widened(box)

    def _widened(self, box: int) -> int:
        """The highest box around ``box`` that adds prose of its own, sections beside a
        section, or other boxes a quarter as long as the longest: parts of one article."""
        best, inner, up = box, box, self.boxes[box].parent
        longest = self.boxes[box].text
        while up >= 0:
            others = [longest if b.text and b.tag == self.boxes[inner].tag == "section" else b.text
                      for i, b in enumerate(self.boxes) if b.parent == up and i != inner]
            if longest and (self.boxes[up].prose or 4 * max(others, default=0) >= longest):
                best = up
            inner, up = up, self.boxes[up].parent
        return best

    def extract(self, winners: list[str]) -> str:
        """Text of the boxes at the first of ``winners`` with text here."""
        for path in winners:
            out, done = [], 0
            for box in self.boxes:
                if box.path == path and box.first >= done:
                    out += self.blocks[box.first:box.last]
                    done = box.last
            if out:
                return " ".join(out)
        box = self.boxes[self.best()]
        return " ".join(self.blocks[box.first:box.last])


def host(url):
    """Host of a url column: lower case, without user and port."""
    return F.lower(F.coalesce(F.regexp_extract(
        url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def vote(pages: DataFrame) -> DataFrame:
    """(host, path, votes, score) of the best containers of all pages."""
    schema = T.StructType([T.StructField("host", T.StringType()),
                           T.StructField("path", T.StringType()),
                           T.StructField("score", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def choose(batches):
        for b in batches:
            pages_ = [Page(h) for h in texts(b.column(1))]
            best = [p.boxes[p.best()] for p in pages_]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(arrow.field(0).type),
                 pa.array([x.path for x in best], arrow.field(1).type),
                 pa.array([x.score for x in best], pa.float64())], schema=arrow)

    votes = pages.select(host("url").alias("host"), "html").mapInArrow(choose, schema)
    return votes.where((F.col("score") > 0) & (F.col("path") != "")).groupBy("host", "path").agg(
        F.count("*").alias("votes"), F.sum("score").alias("score"))


def winning_paths(votes: DataFrame, winners: int = WINNERS) -> DataFrame:
    """(host, paths): up to ``winners`` paths of each host, most votes first."""
    ranked = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc("score"), "path")
    return votes.withColumn("rank", F.row_number().over(ranked)).where(
        F.col("rank") <= winners).groupBy("host").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "path"))),
            lambda x: x["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""
    spark = pages.sparkSession
    bound_batches(spark, 500)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    paths = written(winning_paths(vote(pages)), "host-paths")
    keyed = pages.withColumn("host", host("url"))
    if paths.count() <= MAX_BROADCAST_HOSTS:
        met = keyed.join(F.broadcast(paths), "host", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = keyed.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast(
            "int")).join(paths.select("*", salts), ["host", "salt"], "left")
    schema = T.StructType([T.StructField("page_id", T.LongType()),
                           T.StructField("url", T.StringType()),
                           T.StructField("text", T.StringType()),
                           T.StructField("n_chars", T.LongType())])
    arrow = to_arrow_schema(schema)

    def pull(batches):
        for b in batches:
            out = [Page(h).extract(w or []) for h, w in zip(
                texts(b.column(2)), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1).cast(arrow.field(1).type),
                 pa.array(out, arrow.field(2).type),
                 pa.array(list(map(len, out)), pa.int64())], schema=arrow)

    return met.select("page_id", "url", "html", "paths").mapInArrow(pull, schema)
