"""Main text of web pages by site style trees.

All pages of a host are merged by the paths of their elements. A path has two importances: of its content, 1 less the
mean entropy of its texts over the host's pages (a text on every page tells nothing), and of its presentation, the entropy
of the layouts of its children. A branch of a page has the composite importance of what stands in it, from the leaves up;
branches that are low against the best of their page go. Elements and names that say what they are give priors; a prior
of a name falls on a host where it would cut more than it leaves. The tree lives in Spark as counts by (host, path, kind,
feature): a page is parsed once for the counts and once for its text, so no page ever moves.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.llm.common import written

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>\"']*+(?:\"[^\"]*+\"?[^>\"']*+|'[^']*+'?[^>\"']*+)*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)", re.S)
NAME = re.compile(r"(?:^|[\s\"'/])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
RAW = frozenset("script style textarea title noscript template iframe svg math object select option".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br hr button".split())
#: Elements that are never the article.
GONE = frozenset("nav footer aside form head menu dialog button fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Names that say so: a class or id made of these and of PLACES alone.
NOT_TEXT = frozenset("nav navbar navigation menu submenu footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr banner notice notices alert comment comments commentlist reply replies respond disqus share sharing social related recommended newsletter subscribe subscription signup popup modal overlay breadcrumb breadcrumbs pagination pager toolbar widget widgets masthead login search".split())
PLACES = frozenset("site page main global primary secondary top bottom left right inner outer area box bar block wrap wrapper container list section item items group panel content slot unit post article entry user form".split())
HEADERS = frozenset("header masthead".split())
HOLDERS = frozenset(("article", "main"))
DIGITS = re.compile(r"&#([0-9]{5,})")
NUMBER = re.compile(r"[0-9]+")
NOTICE = re.compile(r"\s*(?:©|copyright\b|\(c\)\s*[0-9]{4})", re.I)
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
DAMPING = 0.9  # what each further layout leaves of the weight of the content
SMOOTH = 2.0  # pages without any repetition that every path is taken to have besides its own
PRIOR_WEIGHT, PRIOR_CHARS = 2.0, 1000  # a prior falls where it cuts more than this many times what it leaves and so many characters


def _hash(s: str) -> int:
    h = xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >= 1 << 63 else h


def decoded(s: str) -> str:
    """Character references decoded; numbers with more digits than Python reads are cut to what is beyond Unicode as well."""
    try:
        return entities.unescape(s)
    except ValueError:
        return entities.unescape(DIGITS.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), s))


@dataclass
class Page:
    """The elements of a page that hold blocks, in page order (a parent before its children), and its blocks."""

    parents: list[int] = field(default_factory=lambda: [-1])
    names: list[str] = field(default_factory=lambda: [""])
    paths: list[int] = field(default_factory=lambda: [0])
    said: list[int] = field(default_factory=lambda: [0])  # 0 nothing, 1 its name says it's no article, 2 its element
    layouts: list[int] = field(default_factory=lambda: [0])
    counts: dict[tuple[int, str], int] = field(default_factory=dict)  # children of an element by label
    blocks: list[tuple[int, str, float]] = field(default_factory=list)  # element, text, share of links

    def open(self, parent: int, name: str, label: str, said: int, placed: bool) -> int:
        """A new element. placed: its path tells it from those before it that are like it."""
        self.layouts[parent] = (self.layouts[parent] * 0x9E3779B97F4A7C15 + (_hash(label) | 1)) & 0x7FFFFFFFFFFFFFFF
        if placed:
            before = self.counts[parent, label] = self.counts.get((parent, label), -1) + 1
            label = f"{label}[{before}]"
        self.parents.append(parent)
        self.names.append(name)
        self.paths.append(_hash(f"{self.paths[parent]}>{label}"))
        self.said.append(said)
        self.layouts.append(0)
        return len(self.parents) - 1


def named(attributes: list[tuple[str, set[str]]], inside: bool) -> bool:
    """Whether a role, class or id says that the element is no part of an article; header names count outside an article only."""
    for kind, words in attributes:
        for word in words:
            parts = [p for p in re.split(r"[-_]+", NUMBER.sub("", word)) if p]
            if kind == "role":
                if word in ROLES and not (inside and word == "banner"):
                    return True
            elif any(p in NOT_TEXT for p in parts) and all(p in NOT_TEXT or p in PLACES or p in HEADERS for p in parts):
                return True
            elif not inside and any(p in HEADERS for p in parts) and all(p in HEADERS or p in ("site", "page", "main", "global", "top") for p in parts):
                return True
    return False


def parsed(text: str) -> Page:
    """A page's tree. A path is a hash over that of its parent, so deep pages take no more than their size. Outside of articles, elements without a name are told apart by their place."""
    page, at, size, linked = Page(), 0, len(text), False
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # name, element, in an article
    waiting: list[tuple[bool, str]] = []

    def flush() -> None:
        if waiting:
            said = " ".join(decoded("".join(t for _, t in waiting)).split())
            if said:
                total = sum(len(t) - t.count(" ") for _, t in waiting)
                page.blocks.append((stack[-1][1], said, sum(len(t) - t.count(" ") for a, t in waiting if a) / max(1, total)))
            waiting.clear()

    while at < size:
        m = TAG.search(text, at)
        if m is None:
            waiting.append((linked, text[at:]))
            break
        if m.start() > at:
            waiting.append((linked, text[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if name in RAW and not m[1]:
            if not m[3].endswith("/"):
                close = re.compile(rf"</{name}\b[^>]*>?", re.I).search(text, at)
                at = close.end() if close else size
            continue
        if name == "a":
            linked = not m[1]
        attributes = [(a[0].lower(), set((a[1] or a[2] or a[3]).lower().split())) for a in NAME.findall(m[3])] if m[3] and "=" in m[3] and not m[1] else []
        inside = stack[-1][2]
        is_named = bool(attributes) and named(attributes, inside)
        if name not in BLOCKS and not is_named and not (m[1] and any(x[0] == name for x in stack)):
            continue
        flush()
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if name in VOID:
            continue
        shut = CLOSES.get(name)
        if shut or name in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in (shut or {"p"}):
                    del stack[k:]
                    break
                if stack[k][0] in ("div", "article", "section", "ul", "ol", "table", "body", "main"):
                    break
        said = 2 if name in GONE or (name == "header" and not inside) else 1 if is_named and name not in ("html", "body") else 0
        label = name + "".join(sorted("." + NUMBER.sub("0", w) for _, words in attributes for w in words))
        stack.append((name, page.open(stack[-1][1], name, label, said, not attributes and not inside), inside or name in HOLDERS))
    flush()
    return page


@dataclass
class Tree:
    """What a host's pages say: of a path the importance of its content and of its presentation and the number of its layouts, 1 where it isn't listed; and the priors that fall (paths of named branches; 0 for what stands outside of articles)."""

    paths: Mapping[int, tuple[float, float, int]] = field(default_factory=dict)
    fallen: frozenset[int] | set[int] = frozenset()


def judged(page: Page) -> tuple[bool, list[int], list[bool]]:
    """Whether the page declares an article; of each element, the element whose prior cuts it (-1 none, -2 it stands outside the article) and whether it is in an article or main.

    An article within a named branch, or with such a name, counts only if there is no other: then names on it and around it say nothing.
    """
    n = len(page.parents)
    cut, holds, inside = [-1] * n, [False] * n, [False] * n
    for k in range(1, n):
        up = page.parents[k]
        cut[k] = cut[up] if cut[up] >= 0 else k if page.said[k] else -1
    live = [k for k in range(n) if page.names[k] in HOLDERS and cut[k] < 0]
    if not live:
        live = [k for k in range(n) if page.names[k] in HOLDERS and page.said[k] < 2 and (cut[page.parents[k]] < 0 or page.said[cut[page.parents[k]]] == 1)]
        for k in live:
            while k > 0 and not holds[k]:
                holds[k] = True
                k = page.parents[k]
        for k in range(1, n):
            up = page.parents[k]
            cut[k] = cut[up] if cut[up] >= 0 else k if page.said[k] and not (holds[k] and page.said[k] == 1) else -1
        live = [k for k in live if cut[k] < 0]
    declared = set(live)
    for k in range(1, n):
        inside[k] = inside[page.parents[k]] or k in declared
        if declared and not inside[k] and cut[k] < 0:
            cut[k] = -2
    if declared:
        cut[0] = -2
    return bool(declared), cut, inside


def main_text(text: str, tree: Tree | None = None, least: float = 0.2) -> str:
    """The article's blocks, one a line."""
    page, tree = parsed(text), tree or Tree()
    return "\n".join(b[1] for b, kept in zip(page.blocks, decisions(page, tree, least), strict=True) if kept)


def decisions(page: Page, tree: Tree, least: float) -> list[bool]:
    """Which blocks of a page are its article: those no prior cuts, on branches whose composite importance is above the share least of the greatest of the page's blocks."""
    declared, cut, inside = judged(page)
    n, plain = len(page.parents), (1.0, 1.0, 1)
    gone = [(c == -2 and 0 not in tree.fallen) or (c >= 0 and (declared or page.said[c] == 2 or page.paths[c] not in tree.fallen)) for c in cut]
    known = [tree.paths.get(p, plain) for p in page.paths]
    own = [0.0 if not inside[k] and NOTICE.match(said) else known[k][0] * (1 if inside[k] else 1 - links) for k, said, links in page.blocks]
    live = [known[k][0] for k, _, _ in page.blocks if not gone[k]]
    floor = least * max(live, default=0.0)
    chars, mass = [0.0] * n, [0.0] * n
    for (k, said, _), worth in zip(page.blocks, own, strict=True):
        if not gone[k]:
            chars[k] += len(said)
            mass[k] += len(said) * worth
    composite = [0.0] * n
    for k in range(n - 1, -1, -1):
        content, share = mass[k] / chars[k] if chars[k] else 0.0, DAMPING ** known[k][2]
        composite[k] = (1 - share) * known[k][1] + share * content
        if k:
            chars[page.parents[k]] += chars[k]
            mass[page.parents[k]] += chars[k] * composite[k]
    kept = [True] * n
    for k in range(1, n):
        kept[k] = kept[page.parents[k]] and not (gone[k] and cut[k] >= 0) and (page.names[k] in ("html", "body", "article", "main") or composite[k] > 0 and composite[k] >= floor)
    return [kept[k] and not gone[k] and worth > 0 and worth >= floor for (k, _, _), worth in zip(page.blocks, own, strict=True)]


#: Kinds of counted features: pages that have the path, its texts, its layouts; characters that a prior cuts, and those left.
PAGES, TEXTS, LAYOUTS, CUT, LEFT = range(5)


def features(text: str) -> dict[tuple[int, int, int], int]:
    """(path, kind, feature) -> count, of one page. A text or layout counts once a page and path."""
    page = parsed(text)
    declared, cut, _ = judged(page)
    out: dict[tuple[int, int, int], int] = {}
    for k, path in enumerate(page.paths):
        out[path, PAGES, 0] = 1
        if page.layouts[k]:
            out[path, LAYOUTS, page.layouts[k]] = 1
    for k, said, links in page.blocks:
        out[page.paths[k], TEXTS, _hash(said)] = 1
        c, n = cut[k], round(len(said) * (1 - links))
        if c == -1:
            out[0, LEFT, int(declared)] = out.get((0, LEFT, int(declared)), 0) + n
        elif c == -2 or (not declared and page.said[c] == 1):
            at = (0 if c == -2 else page.paths[c], CUT, int(declared))
            out[at] = out.get(at, 0) + n
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for batch in batches:
        out = [(host, *key, n) for host, text in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True) for key, n in features(text).items()]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["host", "path", "kind", "feature", "n"])


def style_trees(pages: DataFrame) -> DataFrame:
    """host, path, content, presentation, layouts of the paths that tell anything, and rows with fallen = true for the priors that fall.

    A text that n of m pages have at a path has the entropy log n / log m; layouts have that of their shares, over log m.
    Both importances are drawn to 1 as if the path stood on SMOOTH more pages where nothing repeats.
    """
    counted = pages.mapInArrow(_features, "host string, path long, kind int, feature long, n long").groupBy("host", "path", "kind", "feature").agg(F.sum("n").alias("n"))
    counted = written(counted, "style-features")
    of = lambda kind, value: F.when(F.col("kind") == kind, value)
    m = F.max(of(PAGES, F.col("n")))
    by = counted.where(F.col("kind") <= LAYOUTS).groupBy("host", "path").agg(
        m.alias("m"), F.avg(of(TEXTS, F.log("n"))).alias("repeat"), F.sum(of(LAYOUTS, F.col("n") * F.log("n"))).alias("style"), F.count(of(LAYOUTS, F.lit(1))).alias("layouts")
    ).where("m > 1")
    drawn = lambda x: (SMOOTH + F.col("m") * x) / (SMOOTH + F.col("m"))
    content = F.coalesce(drawn(1 - F.col("repeat") / F.log("m")), F.lit(1.0))
    style = F.when(F.col("layouts") > 0, drawn((F.log("m") - F.col("style") / F.col("m")) / F.log("m"))).otherwise(1.0)
    told = by.select("host", "path", content.alias("content"), style.alias("presentation"), F.greatest("layouts", F.lit(1)).cast("int").alias("layouts"), F.lit(False).alias("fallen"))
    left = counted.where(F.col("kind") == LEFT).select("host", F.col("feature"), F.col("n").alias("left"))
    cut = counted.where(F.col("kind") == CUT).select("host", "path", "feature", "n").join(left, ["host", "feature"], "left")
    fallen = cut.where(F.col("n") > PRIOR_WEIGHT * (F.coalesce("left", F.lit(0)) + PRIOR_CHARS)).select("host", "path", F.lit(1.0), F.lit(1.0), F.lit(1), F.lit(True))
    return told.where("content < 0.999 or presentation < 0.999 or layouts > 1").union(fallen)


def trees_of(rows: list) -> dict[str, Tree]:
    out: dict[str, Tree] = {}
    for host, path, content, presentation, layouts, fallen in rows:
        own = out.setdefault(host, Tree({}, set()))
        if fallen:
            own.fallen.add(path)
        else:
            own.paths[path] = (content, presentation, layouts)
    return out


def _texts(shared, least: float) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list = [None, None]
        for batch in batches:
            hosts, pages = batch.column("host").to_pylist(), batch.column("html").to_pylist()
            out = []
            for host, page in zip(hosts, pages, strict=True):
                if host != last[0]:
                    last[:] = host, _tree(shared.value, host)
                out.append(main_text(page, last[1], least))
            yield pa.record_batch({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(out, pa.string())})

    return run


def _packed(rows: list) -> dict:
    """Rows of a block of hosts as arrays, sorted by host and path."""
    rows = sorted(rows, key=lambda r: (r[0], r[1]))
    spans: dict[str, tuple[int, int]] = {}
    for at, row in enumerate(rows):
        spans[row[0]] = (spans.get(row[0], (at, at))[0], at + 1)
    columns = [np.array([r[k] for r in rows], t) for k, t in ((1, np.int64), (2, np.float64), (3, np.float64), (4, np.int32), (5, bool))]
    return {"spans": spans, "columns": columns}


def _tree(packed: dict, host: str) -> Tree:
    lo, hi = packed["spans"].get(host, (0, 0))
    return trees_of([(host, *r) for r in zip(*(c[lo:hi].tolist() for c in packed["columns"]), strict=True)]).get(host) or Tree()


def extract(pages: DataFrame, least: float = 0.2, max_paths: int = 500_000) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html).

    Null html is empty and gives an empty text; a null url belongs to the host ''. Repeated rows give a row each and an
    empty table none; other columns are ignored. Texts that repeat inside an article stay unless their path holds hardly
    anything else. The trees are broadcast in blocks of hosts, of about max_paths paths each; a page is read for the block
    of its host.
    """
    spark = pages.sparkSession
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    trees = written(style_trees(rows.select("host", "html")), "style-trees")
    n_blocks = max(1, math.ceil(trees.count() / max_paths))
    block = F.pmod(F.xxhash64("host"), F.lit(n_blocks))
    out = None
    for k in range(n_blocks):
        shared = spark.sparkContext.broadcast(_packed([tuple(r) for r in trees.where(block == k).collect()]))
        own = rows.where(block == k).mapInArrow(_texts(shared, least), "page_id long, url string, text string")
        out = own if out is None else out.union(own)
    return out
