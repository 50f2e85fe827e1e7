"""HTML extraction: site template removal by recurring subtrees, then the main text.

1. Each page is parsed (a tolerant stack over tags, in time that grows with the page alone) and every
   element gets two hashes: one of its subtree's content (tag, attributes that matter, children and
   text) and one of its shape with the text masked (tags and names without numbers, of its subtree and
   from the body down to it; children of one shape in a row count once). A main region (article, main)
   and what holds one are no candidates for a template.
2. Spark counts the hashes per host, and a page counts once. Two things make a template:
   - content that recurs: the same subtree on `MIN_PAGES` pages or more and on `SHARE` or more of the
     host's pages. Inside a main region it counts once per distinct region, so that copies of an
     article count once and their paragraphs are no template, while a box that recurs in different
     articles is one.
   - a shape that recurs: what stands beside the main regions (the largest subtrees without one, and
     without an h1) in the same shape on as many of the host's pages that have a region, though its words
     change, if it holds less than `SLOT_SHARE` of the text that the regions of these pages hold, and
     either `LINKED` of its own text is links (a menu) or it has at most `VARIANTS` texts per page (boxes
     that take turns). Text that is each page's own stays, wherever it stands.
   Counts are summed before they are shuffled, so a host with a third of all pages is no hot key.
3. The page is parsed again; template subtrees are deleted along with what markup itself names as
   no part of the article (navigation, adverts, forms, comments ...), inline elements too. All other text
   stays, inside and outside main regions. A class, id or role is a hint only as a whole name (`sidebar`, not
   `no-sidebar`). Hints say nothing on html, body, main and article, nor on what holds a `main`, or
   holds an `article` on a page where all main regions stand below hints.

The templates of a host number at most its mean subtrees per page / `SHARE`; they are broadcast
while their total is within `BROADCAST_ROWS`, else joined by shuffle.

Null html is empty and gives empty text; a null or odd url has no host, and templates are not
sought there. Unclosed tags, stray end tags and text without markup are accepted. Repeated rows get
equal results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, small_batches, table

MIN_PAGES, SHARE, SLOT_SHARE, LINKED, VARIANTS = 5, 0.3, 0.25, 0.5, 0.5
BROADCAST_ROWS = 500_000

#: Elements without content, with raw content, and those that never hold article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe xmp noembed noframes".split())
CHROME = frozenset("head nav footer aside form button select option datalist dialog menu svg canvas object audio video map label fieldset".split()) | RAW
#: Elements that end a block of text where they begin and end.
BLOCK = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th section article main header footer nav aside form blockquote pre figure figcaption address hr details summary fieldset center title".split())
#: Whole names in class, id or role, without a number at their end, of what is no part of an article.
HINTS = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside ad ads advert adverts advertisement advertisements banner sponsor sponsored promo promotion promoted "
    "cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup share sharing social comment comments disqus reply replies respond "
    "related recommended recommendations pagination pager widget widgets login search toolbar skip hidden footer masthead contentinfo complementary alert "
    "nav-bar nav-menu main-nav main-navigation main-menu site-nav site-navigation top-nav sub-nav post-navigation posts-navigation side-bar left-sidebar right-sidebar sidebar-left sidebar-right "
    "ad-box ad-banner ad-container ad-slot ad-unit ad-wrapper ads-box google-ad advert-box cookie-banner cookie-bar cookie-consent cookie-notice newsletter-signup newsletter-form newsletter-box "
    "share-buttons share-bar share-links share-this social-share social-links social-media social-icons social-buttons sharing-buttons comment-list comment-form comments-area comments-list comments-section "
    "related-posts related-articles related-content related-links related-stories recommended-posts page-footer page-header site-footer site-header search-form search-box search-bar login-form skip-link "
    "widget-area promo-box".split()
)
_REGION = frozenset(("article", "main"))
_UNHINTED = _REGION | {"html", "body"}
#: An open element that a new one of the same kind closes.
_CLOSES = {"p": frozenset(BLOCK - {"html", "body", "title"}), "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")), "tr": frozenset(("tr",)), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")), "option": frozenset(("option",))}
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<![^>]*>|<\?[^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.DOTALL)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NUMBER = re.compile(r"[-_]*[0-9]+$")
_DIGITS = re.compile(r"[0-9]+")


class Element:
    """An open element: its number and tag, whether it or what it stands in is chrome by its tag or a main region, the innermost region, the element that its text is filed under, and the hashes of its content, place and shape."""

    __slots__ = ("chrome", "hash", "last", "main", "number", "owner", "region", "shape", "slot", "some", "tag")

    def __init__(self, tag: str, chrome: bool, region: bool, number: int, names: str, parent: Element | None, own: bool):
        self.tag, self.number, self.some = tag, number, False
        self.chrome = chrome or parent is not None and parent.chrome
        self.main = not self.chrome and (region or parent is not None and parent.main)
        self.region = number if region and self.main else parent.region if parent is not None else -1
        self.hash = xxhash.xxh64(f"{tag}|{names}")
        self.owner = number if own or parent is None else parent.owner
        plain = f"{tag}|{_DIGITS.sub('', names)}"
        self.slot = xxhash.xxh64_intdigest(plain, parent.slot if parent is not None else 0)
        self.shape, self.last = xxhash.xxh64(plain), 0


def _named(attributes: str) -> tuple[str, bool]:
    """The class, id and role of a tag, and whether they name what is no part of an article."""
    found = []
    for m in _NAMES.finditer(attributes):
        value = (m[2] or m[3] or m[4] or "").lower()
        if m[1].lower() == "hidden" or m[1].lower() == "aria-hidden" and value == "true":
            return "hidden", True
        found.append(value)
    names = " ".join(found)
    return names, any(_NUMBER.sub("", w).replace("_", "-") in HINTS for w in names.split())


class Page:
    """A parsed page.

    `blocks` are lists of (text, number of the element it is filed under, -1 for none): the innermost block, or an
    inline element within it that may be hidden. Elements are numbered in the
    order they begin, so a parent comes before its children; of each there are the parent, whether it is
    chrome by its tag (or stands in such) and hinted, the innermost main region, -1 outside, whether it
    holds a region or an h1, its characters and those of links, and two hashes. `content` is 0 for main regions and what
    holds them, inline elements, empty ones, and the page's own outer elements; `slot` is 0 where it has
    none. `whole` has the content hash of each region.
    """

    def __init__(self, page: str):
        self.blocks: list[list[tuple[str, int]]] = []
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.chrome: list[bool] = []
        self.hinted: list[bool] = []
        self.regions: list[int] = []
        self.holds: list[bool] = []
        self.titled: list[bool] = []
        self.chars: list[int] = []
        self.links: list[int] = []
        self.values: list[int] = []
        self.content: list[int] = []
        self.slots: list[int] = []
        self.whole: dict[int, int] = {}
        self._parse(page)
        self._place_slots()

    def _parse(self, page: str) -> None:
        stack: list[Element] = []
        open_tags: dict[str, int] = {}
        open_blocks: list[int] = []  # their places in the stack
        buffer: list[tuple[str, int]] = []

        def end_block() -> None:
            if any(not t.isspace() for t, _ in buffer):
                self.blocks.append(buffer[:])
            buffer.clear()

        def add(piece: str) -> None:
            owner = stack[-1].owner if stack else -1
            if buffer and buffer[-1][1] == owner:
                piece = buffer.pop()[0] + piece
            buffer.append((piece, owner))

        def close(to: int) -> None:
            while len(stack) > to:
                e = stack.pop()
                open_tags[e.tag] -= 1
                if open_blocks and open_blocks[-1] == len(stack):
                    open_blocks.pop()
                k, root = e.number, e.region == e.number
                if stack:
                    up = stack[-1].number
                    self.holds[up] |= root or self.holds[k]
                    self.titled[up] |= self.titled[k]
                    self.chars[up] += self.chars[k]
                    self.links[up] += self.links[k]
                value, shape = e.hash.intdigest() >> 1, e.shape.intdigest()
                self.values[k] = value
                self.slots[k] = xxhash.xxh64_intdigest(shape.to_bytes(8, "little"), e.slot) >> 1
                if stack and shape != stack[-1].last:
                    stack[-1].last = shape
                    stack[-1].shape.update(shape.to_bytes(8, "little"))
                if e.some:
                    if root:
                        self.whole[k] = value
                    elif e.tag in BLOCK and e.tag != "html" and e.tag != "body" and not self.holds[k]:
                        self.content[k] = value
                    if stack:
                        stack[-1].hash.update(value.to_bytes(8, "little"))
                        stack[-1].some = True

        def text(piece: str) -> None:
            if piece:
                if "&" in piece:
                    piece = entities.unescape(piece)
                add(piece)
                if stack and (plain := piece.strip()):
                    stack[-1].hash.update(plain)
                    stack[-1].some = True
                    self.chars[stack[-1].number] += len(plain)
                    if open_tags.get("a"):
                        self.links[stack[-1].number] += len(plain)

        position, last = 0, page.rfind(">") + 1  # no tag ends beyond
        while m := _TOKEN.search(page, position, last):
            text(page[position : m.start()])
            position = m.end()
            if position == last and m[0].startswith("<!--") and not m[0].endswith("-->"):
                position = len(page)  # a comment that nothing ends
            tag = (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                if open_tags.get(tag):
                    at = len(stack) - 1
                    while stack[at].tag != tag:
                        at -= 1
                    if open_blocks and open_blocks[-1] >= at:
                        end_block()
                    close(at)
                elif tag in BLOCK:
                    end_block()
                continue
            if tag in BLOCK:
                end_block()
            if tag == "br":
                add(" ")
            while stack and tag in _CLOSES.get(stack[-1].tag, ()):
                close(len(stack) - 1)
            # an inline element left open inside a paragraph closes with it
            if tag in BLOCK and open_blocks and stack[open_blocks[-1]].tag == "p" and tag in _CLOSES["p"]:
                close(open_blocks[-1])
            if tag in VOID:
                continue
            names, hinted = _named(m[3]) if m[3] else ("", False)
            parent = stack[-1] if stack else None
            chrome = tag in CHROME or tag == "header" and not (parent is not None and parent.main)
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(page, position)
                position = end.end() if end else len(page)
                continue
            if m[3].endswith("/") and tag not in BLOCK:
                continue
            hinted = hinted and tag not in _UNHINTED
            e = Element(tag, chrome, tag in _REGION, len(self.tags), names, parent, tag in BLOCK or tag in CHROME or hinted)
            if tag in BLOCK:
                open_blocks.append(len(stack))
            stack.append(e)
            open_tags[tag] = open_tags.get(tag, 0) + 1
            for values, value in ((self.tags, tag), (self.parents, parent.number if parent is not None else -1), (self.chrome, e.chrome), (self.hinted, hinted), (self.regions, e.region), (self.holds, False), (self.titled, tag == "h1"), (self.chars, 0), (self.links, 0), (self.values, 0), (self.content, 0), (self.slots, 0)):
                values.append(value)
        text(page[position:])
        end_block()
        close(0)

    def _place_slots(self) -> None:
        """Leaves the slots of the largest subtrees without a region or h1 beside regions."""
        for k in range(len(self.tags)):
            up = self.parents[k]
            beside = up < 0 or self.holds[up] or self.tags[up] in ("html", "body")
            if not (self.whole and beside and self.regions[k] < 0 and self.tags[k] not in ("html", "body") and not self.holds[k] and not self.titled[k] and self.chars[k]):
                self.slots[k] = 0

    def hidden(self, templates: frozenset[int] | set[int]) -> list[bool]:
        """Whether each element is chrome, a template, or stands in one. Hints on what holds the page's main regions are void."""
        n, void = len(self.tags), set()
        roots = [k for k in range(n) if self.regions[k] == k]
        seen: set[int] = set()

        def spare(chosen: list[int]) -> None:
            for k in chosen:
                while k >= 0 and k not in seen:
                    seen.add(k)
                    if self.hinted[k]:
                        void.add(k)
                    k = self.parents[k]

        spare([k for k in roots if self.tags[k] == "main"])
        dead = [False] * n
        for k in range(n):
            dead[k] = self.parents[k] >= 0 and dead[self.parents[k]] or self.hinted[k] and k not in void
        if all(dead[k] for k in roots):
            spare(roots)
        out = [False] * n
        for k in range(n):
            up = self.parents[k]
            out[k] = up >= 0 and out[up] or self.chrome[k] or self.hinted[k] and k not in void or self.content[k] in templates or self.slots[k] in templates
        return out


def _contents(p: Page) -> dict[int, int]:
    """Each content hash of a page with what it is counted by: 0 (the page) or the hash of the region it stands in, the least of several.

    The key 0 stands for the page itself: 0 if it has no region, else a hash of its regions.
    """
    found = {0: xxhash.xxh64_intdigest(repr(sorted(p.whole.values()))) >> 1 if p.whole else 0}
    for h, r in zip(p.content, p.regions, strict=True):
        if h:
            by = p.whole.get(r, 0)
            found[h] = min(found.get(h, by), by)
    return found


def _slots(p: Page) -> dict[int, tuple[int, int, int]]:
    """The text (its hash), characters and characters of links of each shape of a page with regions; the key 0 stands for all its regions."""
    if not p.whole:
        return {}
    found = {0: (0, sum(p.chars[k] for k in p.whole if p.parents[k] < 0 or p.regions[p.parents[k]] < 0), 0)}
    for h, value, n, linked in zip(p.slots, p.values, p.chars, p.links, strict=True):
        if h:
            before = found.get(h, (0, 0, 0))
            found[h] = (before[0] ^ value, before[1] + n, before[2] + linked)
    return found


def main_text(page: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """The blocks that are in no chrome and no template."""
    p = Page(page)
    hidden = p.hidden(templates)
    shown = (" ".join("".join(t for t, k in block if k < 0 or not hidden[k]).split()) for block in p.blocks)
    return "\n".join(text for text in shown if text)


def page_subtrees(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, subtrees, slots): the contents of each page and what they are counted by, and its shapes with their text, its characters, those of links and those of the page's regions."""

    def column(rows: list[list[tuple[int, ...]]], names: tuple[str, ...]) -> pa.Array:
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        flat = np.array([x for r in rows for x in r], np.int64).reshape(-1, len(names))
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=[pa.field(c, pa.int64()) for c in names]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "html"):
                parsed = [Page(c.as_py() or "") for c in batch.column(1)]
                slots = [_slots(p) for p in parsed]
                shapes = [[(h, *v, found[0][1]) for h, v in found.items()] for found in slots]
                yield pa.RecordBatch.from_arrays([batch.column(0), column([list(_contents(p).items()) for p in parsed], ("hash", "by")), column(shapes, ("slot", "by", "chars", "links", "main"))], ["host", "subtrees", "slots"])

    return pages.select("host", F.col(html_col).alias("html")).mapInArrow(run, "host string, subtrees array<struct<hash:long,by:long>>, slots array<struct<slot:long,by:long,chars:long,links:long,main:long>>")


def host_of(url):
    """The host of a url in lower case, without user and port; null where there is none."""
    found = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def recurring_content(rows: DataFrame, min_pages: int, share: float) -> DataFrame:
    """(host, hash) of content that recurs; `rows` are (host, hash, by, pages)."""
    outside = F.col("by") == 0
    seen = rows.groupBy("host", "hash").agg(F.sum("pages").alias("pages"), F.sum(F.when(outside, F.col("pages")).otherwise(0)).alias("outside"), F.sum(F.when(outside, 0).otherwise(1)).alias("inside"))
    seen = materialise(seen.where((F.col("outside") + F.col("inside") >= min_pages) | (F.col("hash") == 0)))
    # the rows of hash 0 count the host's pages, and its distinct contents
    sizes = seen.where("hash = 0").select("host", F.col("pages").alias("all_pages"), (F.col("outside") + F.col("inside")).alias("contents"))
    return seen.where("hash <> 0").join(sizes, "host").where(F.col("outside") / F.col("all_pages") + F.col("inside") / F.col("contents") >= share).select("host", "hash")


def recurring_slots(rows: DataFrame, min_pages: int, share: float, slot_share: float) -> DataFrame:
    """(host, hash) of shapes that recur, hold little text against the regions, and are links or few texts; `rows` are (host, hash, by, pages, chars, links, main), `by` their text."""
    shapes = rows.groupBy("host", "hash").agg(*[F.sum(c).alias(c) for c in ("pages", "chars", "links", "main")], F.count("*").alias("texts"))
    sizes = shapes.where("hash = 0").select("host", F.col("pages").alias("all_pages"))
    often = shapes.where((F.col("hash") != 0) & (F.col("pages") >= min_pages)).join(sizes, "host")
    common = (F.col("links") >= LINKED * F.col("chars")) | (F.col("texts") <= VARIANTS * F.col("pages"))
    return often.where((F.col("pages") >= share * F.col("all_pages")) & (F.col("chars") < slot_share * F.col("main")) & common).select("host", "hash")


def site_templates(pages: DataFrame, html_col: str, min_pages: int = MIN_PAGES, share: float = SHARE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(host, templates): the content and shape hashes that recur on each host; `pages` has the column `host`."""
    parsed = page_subtrees(pages.where("host is not null"), html_col)
    # one pass over the pages: rows of contents have no characters
    none = F.lit(None).cast("long")
    contents = F.transform("subtrees", lambda x: F.struct(x["hash"].alias("hash"), x["by"].alias("by"), none.alias("chars"), none.alias("links"), none.alias("main")))
    slots = F.transform("slots", lambda x: F.struct(x["slot"].alias("hash"), x["by"].alias("by"), x["chars"].alias("chars"), x["links"].alias("links"), x["main"].alias("main")))
    rows = parsed.select("host", F.inline(F.concat(contents, slots))).withColumn("is_shape", F.col("chars").isNotNull())
    # summed per page set before anything is shuffled: a content by its region, a shape by its text
    counted = materialise(rows.groupBy("host", "is_shape", "hash", "by").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.sum("main").alias("main")))
    found = recurring_content(counted.where("not is_shape"), min_pages, share).unionByName(recurring_slots(counted.where("is_shape"), min_pages, share, slot_share))
    return found.groupBy("host").agg(F.collect_set("hash").alias("templates"))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE, slot_share: float = SLOT_SHARE) -> DataFrame:
    """(id, url, text) of each page. `min_pages`, `share` and `slot_share` are those of the templates."""
    hosted = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host_of(F.col(url_col)).alias("host"))
    templates = materialise(site_templates(hosted, "html", min_pages, share, slot_share))
    total = templates.agg(F.coalesce(F.sum(F.size("templates")), F.lit(0)).alias("n")).first()["n"]
    joined = hosted.join(F.broadcast(templates) if total <= BROADCAST_ROWS else templates, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for batch in small_batches(big, "html"):
                texts = [main_text(page.as_py() or "", frozenset(hashes.as_py() or ())) for page, hashes in zip(batch.column(2), batch.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["id", "url", "text"])

    kind = dict(hosted.dtypes)["id"]
    return joined.select("id", "url", "html", "templates").mapInArrow(run, f"id {kind}, url string, text string").select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page of `pages`, from the whole html."""
    return extract_main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
