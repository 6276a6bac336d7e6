"""Main text of web pages by a site style tree.

A page is read as lines: the text of each block element. The DOMs of all pages of a host
are merged: a style node is the path of tags and classes down to a block element. Over
the host's pages two importances are computed for each node, both between 0 and 1.
Presentation: the entropy of the shapes (sequences of child styles) with which pages
render it, to the base of the pages that have it. Content: one less the mean entropy of
its lines, where a line that stands on m of n pages has entropy log m / log n. A node's
importance is the larger of the two; with few pages it is drawn towards that of the same
path over all hosts, by the weight of ``PRIOR`` pages.

Markup is a feature of a node: navigation, headers, footers, asides, forms and elements
whose class, id or role names a menu, an advert, a notice, comments and the like have
``ROLE`` taken off their importance, and so has what stands beside the article or main
element of a page with one. That is more than any entropy makes up for, so such lines
aren't counted at all. A name is judged as a whole (``is_mark``): "share-price" and
"has-sidebar" mark nothing. A heading is never marked by its own names, nor a header
inside an article. Of the others

* all lines of a node are removed whose importance is ``LOW`` or less, and
* a line of any node is removed if its own importance, 1 - log m / log(n + LINE_PRIOR),
  is: one on every page goes from seven pages on.

A page that would lose more than half of its text so is a copy of what its host repeats
(an article under several addresses), no page around a template: it loses nothing.

Pages are parsed once. Statistics are sums per (host, node, feature) with map-side
partial sums, so a host of any size is no group in one task; only nodes and lines that
are removed come back to pages. Paths are running hashes, so deep pages cost their size.

Defined results: null or empty html gives "" and 0; malformed html is read to its end;
a null url is one host of its own; repeated rows are each counted and answered; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, discard, ship, stored

# Elements of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas audio video head title textarea select button".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("nav header footer aside form menu dialog".split())
MAIN = ("article", "main")
CLOSED_BY = {"p": BLOCKS - {"br"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Words that say what an element is, if its class, id or role consists of them and of words of LAYOUT.
MARKS = frozenset("ad ads adv advert advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar widget aside cookie cookies consent notice alert popup modal newsletter subscribe signup login share sharing social comment comments disqus reply replies related recommended pagination pager search complementary contentinfo".split())

#: Words of MARKS that say so at the end of a name whatever qualifies them ("post-comments", but not "lunch-menu").
CLEAR = frozenset("ad ads advert advertisement advertising nav navbar breadcrumb breadcrumbs masthead footer sidebar popup newsletter comments disqus pagination pager".split())
LAYOUT = frozenset("site page top bottom left right main global primary secondary bar box block list wrap wrapper container inner outer area section panel slot unit zone row link links item items icon icons button buttons form posts stories articles media".split())
#: Words that make a name say what stands beside an element, and words of MARKS that may head an article.
BESIDE, TITLES = frozenset("has no not with without is hide".split()), frozenset("header banner masthead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Importance up to which a node or line is template, pages that the prior weighs for either, and what markup takes off.
LOW, PRIOR, LINE_PRIOR, ROLE = 0.07, 8, 1, 0.95
#: Bytes of template hashes up to which they are sent to every executor, and parts of a host beyond.
SENT_BYTES, DEALT = 8 << 20, 64
_SPACE = re.compile(r"[\s\xa0]+")
_NAME = re.compile(r"[a-z]+")


def is_mark(name: str) -> bool:
    """Whether a class, id or role names page furniture.

    Its words are all of MARKS or LAYOUT, one of MARKS ("cookie-notice", "sidebar-2"), or
    the last one before words of LAYOUT is of CLEAR ("post-comments-list"). What an element
    has or lacks beside it ("has-sidebar") names nothing.
    """
    words = _NAME.findall(name.lower())
    if MARKS.isdisjoint(words) or not BESIDE.isdisjoint(words):
        return False
    if all(w in MARKS or w in LAYOUT or len(w) == 1 for w in words):
        return True
    while words and words[-1] in LAYOUT:
        words.pop()
    return bool(words) and words[-1] in CLEAR


@dataclass
class Node:
    tag: str
    style: str
    marked: bool = False
    title: bool = False
    children: list[Node | str] = field(default_factory=list)


class _Builder(HTMLParser):
    """A forgiving DOM: unknown closings are ignored, open elements close with their parents."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#", "#")
        self.open = [self.root]
        self.tags: Counter[str] = Counter()

    def _close(self, at: int) -> None:
        for node in self.open[at:]:
            self.tags[node.tag] -= 1
        del self.open[at:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        while self.open[-1].tag in CLOSED_BY and tag in CLOSED_BY[self.open[-1].tag]:
            self._close(-1)
        if tag in BLOCKS and tag != "br" and self.tags["p"]:
            scope = next((i for i in range(len(self.open) - 1, 0, -1) if self.open[i].tag in ("p", "td", "th", "button", "article", "section", "div", "body")), 0)
            if self.open[scope].tag == "p":
                self._close(scope)
        own = dict(attrs)
        marks = [n for a in ("class", "id", "role") for n in (own.get(a) or "").split() if is_mark(n)]
        classes = ".".join(sorted((own.get("class") or "").lower().split()))
        marked = bool(marks) and tag not in ("html", "body", "article", "main") and tag not in HEADINGS
        node = Node(tag, f"{tag}.{classes}" if classes else tag, marked, marked and all(n.lower() in TITLES for n in marks))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.tags[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self._close(-1)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1) if self.tags[tag] else ():
            if self.open[i].tag == tag:
                self._close(i)
                return
            if self.open[i].tag in ("article", "main", "body", "table") and tag in CLOSED_BY:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    builder = _Builder()
    if html:
        try:
            builder.feed(html)
            builder.close()
        except (AssertionError, ValueError):  # a broken declaration: the rest is taken as text
            builder.open[-1].children.append(unescape(getattr(builder, "rawdata", "") or ""))
    return builder.root


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def host_of(url: str | None) -> str:
    return re.sub(r"^[a-z][a-z0-9+.-]*://", "", (url or "").lower()).split("/")[0].split("?")[0].split("#")[0].rpartition("@")[2]


def _mains(root: Node) -> set[int]:
    """The topmost article and main elements."""
    found, stack = set(), [root]
    while stack:
        node = stack.pop()
        if node.tag in MAIN:
            found.add(id(node))
        else:
            stack.extend(c for c in node.children if isinstance(c, Node) and c.tag not in RAW)
    return found


def lines_of(html: str | None) -> tuple[list[tuple[int, str]], set[tuple[int, int]]]:
    """(style path, text) of the lines in page order that no markup sets apart, and the (style path, shape) of their elements."""
    root = parse(html)
    mains = _mains(root)
    lines: list[tuple[int, str]] = []
    shapes = {(0, 0)}
    line: list[str] = []

    def close(path: int) -> None:
        text = _SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            lines.append((path, text))

    # (node, path of its block, inside an article), or (None, the path whose block ends, ...), in page order
    stack: list[tuple[Node | str | None, int, bool]] = [(root, 0, not mains)]
    while stack:
        node, path, inside = stack.pop()
        if node is None:
            close(path)
            continue
        if isinstance(node, str):
            if inside:
                line.append(node)
            continue
        within = inside and mains
        if node.tag in RAW or node.marked and not (within and node.title) or node.tag in OUTSIDE and not (within and node.tag == "header"):
            continue
        inside = inside or id(node) in mains
        if node.tag in BLOCKS:
            close(path)
            path = _digest(f"{path} {node.style}")
            stack.append((None, path, inside))
            if inside:
                shapes.add((path, _digest("|".join(dict.fromkeys(c.style for c in node.children if isinstance(c, Node) and c.tag in BLOCKS)))))
        for child in reversed(node.children):
            stack.append((child, path, inside))
    close(0)
    return lines, shapes


_LINES = "page_id long, url string, host string, lines array<struct<path:long,feature:long,text:string>>, shapes array<struct<path:long,shape:long>>"


def page_lines(pages: DataFrame) -> DataFrame:
    """Every row with its host and ``lines_of`` its html."""
    ship(pages.sparkSession)
    text = pa.struct([("path", pa.int64()), ("feature", pa.int64()), ("text", pa.string())])
    shape = pa.struct([("path", pa.int64()), ("shape", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = column(batch, "url").to_pylist()
            read = [lines_of(h.as_py()) for h in column(batch, "html")]
            lines = [[{"path": p, "feature": _digest(t), "text": t} for p, t in x] for x, _ in read]
            shapes = [[{"path": p, "shape": k} for p, k in sorted(x)] for _, x in read]
            yield pa.RecordBatch.from_arrays([column(batch, "page_id"), column(batch, "url"), pa.array(map(host_of, urls), pa.string()), pa.array(lines, pa.list_(text)), pa.array(shapes, pa.list_(shape))], ["page_id", "url", "host", "lines", "shapes"])

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, _LINES)


def _importance(counts: DataFrame, *keys: str) -> DataFrame:
    """pages and importance per style node from the pages m with each of its features (kind 0: the node, 1: shapes, 2: lines)."""
    m = F.col("m")
    weighed = m * F.ln(m)
    nodes = counts.groupBy(*keys).agg(
        F.max(F.when(F.col("kind") == 0, m)).alias("pages"),
        F.sum(F.when(F.col("kind") == 1, weighed)).alias("shape_mlogm"),
        F.sum(F.when(F.col("kind") == 1, m)).alias("shapes"),
        F.sum(F.when(F.col("kind") == 2, weighed)).alias("line_mlogm"),
        F.sum(F.when(F.col("kind") == 2, m)).alias("lines"),
    )
    base = F.ln(F.greatest(F.col("pages"), F.lit(2)))
    # -sum p log p with p = m / shapes
    presentation = (F.ln("shapes") - F.col("shape_mlogm") / F.col("shapes")) / base
    # the mean over uses of log m / log n: a line on every page counts as often as it stands
    content = 1 - F.col("line_mlogm") / F.col("lines") / base
    importance = F.when(F.col("pages") < 2, F.lit(1.0)).otherwise(F.greatest(F.coalesce(presentation, F.lit(0.0)), F.coalesce(content, F.lit(0.0))))
    return nodes.select(*keys, "pages", importance.alias("importance"))


def feature_counts(pages: DataFrame) -> DataFrame:
    """host, path, kind, feature and m, the pages that have it, of ``page_lines``."""
    here = F.array_distinct(F.transform("shapes", lambda s: F.struct(s["path"].alias("path"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("feature"))))
    shapes = F.transform("shapes", lambda s: F.struct(s["path"].alias("path"), F.lit(1).alias("kind"), s["shape"].alias("feature")))
    lines = F.array_distinct(F.transform("lines", lambda x: F.struct(x["path"].alias("path"), F.lit(2).alias("kind"), x["feature"].alias("feature"))))
    rows = pages.select("host", F.explode(F.concat(here, shapes, lines)).alias("x")).select("host", "x.*")
    return rows.groupBy("host", "path", "kind", "feature").agg(F.count("*").alias("m"))


def style_tree(counts: DataFrame, prior: float = PRIOR) -> DataFrame:
    """host, path, pages and importance of every style node, drawn towards the path's importance over all hosts."""
    own = _importance(counts, "host", "path")
    every = _importance(counts.groupBy("path", "kind", "feature").agg(F.sum("m").alias("m")), "path").select("path", F.col("importance").alias("usual"))
    seen = F.col("pages") - 1
    return own.join(every, "path").select("host", "path", "pages", ((seen * F.col("importance") + prior * F.col("usual")) / (seen + prior)).alias("importance"))


def templates(counts: DataFrame, low: float = LOW, prior: float = PRIOR, line_prior: float = LINE_PRIOR) -> DataFrame:
    """host, paths and features: the style nodes and the lines of low importance."""
    nodes = style_tree(counts, prior).where(F.col("importance") <= low).select("host", F.col("path").alias("node"), F.lit(None).cast("long").alias("line"))
    lines = counts.where("kind = 2").select("host", "path", "feature", "m")
    size = counts.where("kind = 0").groupBy("host").agg(F.max("m").alias("n"))
    # n is m at least
    often = lines.where(F.ln("m") >= (1 - low) * F.ln(F.col("m") + line_prior)).join(size, "host")
    often = often.where(1 - F.ln("m") / F.ln(F.col("n") + line_prior) <= low).select("host", F.lit(None).cast("long").alias("node"), F.col("feature").alias("line"))
    return nodes.unionAll(often).groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("paths"), F.array_sort(F.collect_set("line")).alias("features"))


def extract_main_text(df: DataFrame, low: float = LOW, prior: float = PRIOR, line_prior: float = LINE_PRIOR) -> DataFrame:
    """page_id, url, text, n_chars of every row, and n_removed: the lines that the tree took out."""
    pages = stored(page_lines(df), "page-lines")
    counts = stored(feature_counts(pages), "style-features")
    removed = stored(templates(counts, low, prior, line_prior), "templates")
    discard(counts)
    # sent whole while small, else a host's rows are dealt to DEALT joins
    size = removed.agg(F.sum(8 * (F.size("paths") + F.size("features")) + F.length("host") + 64)).first()[0] or 0
    if size <= SENT_BYTES:
        joined = pages.join(F.broadcast(removed), "host", "left")
    else:
        deal = F.pmod(F.xxhash64("page_id", "url"), F.lit(DEALT)).cast("int")
        joined = pages.withColumn("deal", deal).join(removed.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1)))), ["host", "deal"], "left")
    low_ = lambda x: F.coalesce(F.array_contains("paths", x["path"]), F.lit(False)) | F.coalesce(F.array_contains("features", x["feature"]), F.lit(False))
    kept = F.when(F.col("paths").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~low_(x)))
    whole, part = (F.concat_ws("\n", F.transform(c, lambda x: x["text"])) for c in ("lines", "kept"))
    out = joined.withColumn("kept", kept).select("page_id", "url", "lines", "kept", whole.alias("whole"), part.alias("part"))
    copy = 2 * F.length("part") < F.length("whole")
    out = out.select("page_id", "url", F.when(copy, F.col("whole")).otherwise(F.col("part")).alias("text"), F.when(copy, F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_removed")
