"""Main text of web pages by a site style tree.

The DOM trees of one host's pages are merged: elements with the same path of tags, classes and ids are one node of the site's tree.  A node's
presentation matters as far as its child sequences differ from page to page (their entropy), its content as far as its sentences and links do
not repeat (one minus their mean entropy).  Both are composed from the leaves up inside each page, and branches of low importance are removed, as
are elements whose tag, role or class says that they are no part of the article.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelweave.runtime import stage

#: How much a node's presentation counts falls with this power of its number of styles.
DAMPING = 0.9
#: Branches outside an article, and boxes inside one, of lower composite importance are removed.
LOW_OUTSIDE, LOW_INSIDE = 0.4, 0.1
#: Fewest pages of a site that tell that a box inside an article repeats.
LEAST_PAGES = 3
#: Largest tree (nodes of all sites that repeat) that is broadcast; a larger one is joined by a shuffle.
BROADCAST_NODES = 1_000_000
#: Entries that a task counts before it hands its counts on.
COUNTED = 200_000
SALTS = 16

# Elements of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big button cite code data del dfn em font i ins kbd label map mark meter output picture progress q rp rt ruby s samp select"
    " small span strike strong sub sup time tt u var audio video canvas object noscript template slot svg math".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: a start tag closes the open elements named here, up to the nearest of the second
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
SCOPE = frozenset("table td th caption html button object template".split())
# Elements, roles and parts of class names and ids that are not the article.
NOISE_TAGS = frozenset(
    "aside audio button canvas datalist dialog footer form head header iframe math menu nav noembed noframes noscript object script search select style svg"
    " template textarea title video".split()
)
NOISE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE_WORDS = frozenset(
    "ad ads adbox adslot adsense adunit consent copyright discussion disqus feedback gdpr login masthead modal outbrain overlay pager pagination popular popup"
    " recommended replies reply respond rss signin signup skip sticky taboola taglist toolbar trending".split()
)
NOISE_STARTS = (
    "advert", "alert", "banner", "breadcrumb", "comment", "cookie", "footer", "form", "header", "menu", "nav", "newsletter", "notice", "notification", "promo",
    "recommend", "related", "search", "share", "sharing", "sidebar", "social", "sponsor", "subscri", "teaser", "widget",
)
ARTICLE_WORDS = frozenset("article articlebody content entry main maincontent post story".split())

_ATTRIBUTES = r"((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^\s>]*+))?+)*+)(?:>|\Z)"
#: a comment or declaration, an end tag, a start tag with raw content up to its end tag, or any other start tag; the rest is text
_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    rf"|<({'|'.join(sorted(RAW))})(?=[\s/>]){_ATTRIBUTES}(.*?)(?=</\2[\s/>]|\Z)|<([a-zA-Z][^\s/>]*+){_ATTRIBUTES}",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_DIGITS = re.compile(r"\d+")
_SENTENCE = re.compile(r"[.!?;:|·•]+ ?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A tolerant DOM tree: parents come before their children; ``pieces`` are the texts and breaks in page order."""

    def __init__(self, source: str):
        self.tags: list[str] = []
        self.parents: list[int] = []
        self.marks: list[tuple[str, str]] = []  # signature; what the attributes say: noise, comment, likely, main, article or nothing
        self.links: list[str] = []
        self.pieces: list[tuple[int, str]] = []
        self._stack: list[int] = []
        self._open: dict[str, int] = {}
        self._push("html", "")
        at = 0
        for token in _TOKEN.finditer(source):
            start, end = token.span()
            if start > at:
                self._text(source[at:start])
            at = end
            close, raw, raw_attributes, content, tag, attributes = token.groups()
            if tag:
                self._start(tag.lower(), attributes)
            elif close:
                self._end(close.lower())
            elif raw:
                self._start(raw.lower(), raw_attributes)
                if raw.lower() in ("title", "textarea") and content:
                    self._text(content)
        if at < len(source):
            self._text(source[at:])

    def _push(self, tag: str, attributes: str) -> None:
        self._node(tag, attributes)
        self._stack.append(len(self.tags) - 1)
        self._open[tag] = self._open.get(tag, 0) + 1

    def _node(self, tag: str, attributes: str) -> None:
        mark, link = _mark(tag, attributes) if len(attributes) < 256 else _mark.__wrapped__(tag, attributes)
        self.parents.append(self._stack[-1] if self._stack else -1)
        self.tags.append(tag)
        self.marks.append(mark)
        self.links.append(link)

    def _pop(self) -> str:
        tag = self.tags[self._stack.pop()]
        self._open[tag] -= 1
        if tag in BLOCK:
            self._break()
        return tag

    def _pop_to(self, names, bounds) -> None:
        """Close the open elements down to the outermost of ``names`` inside the nearest of ``bounds``."""
        if not any(self._open.get(n) for n in names):
            return
        cut = None
        for i in range(len(self._stack) - 1, 0, -1):
            tag = self.tags[self._stack[i]]
            if tag in names:
                cut = i
            elif tag in bounds:
                break
        if cut is not None:
            while len(self._stack) > cut:
                self._pop()

    def _break(self) -> None:
        self.pieces.append((self._stack[-1], " "))

    def _text(self, text: str) -> None:
        if self._open.get("head") and self.tags[self._stack[-1]] == "head" and not text.isspace():
            self._pop()
        self.pieces.append((self._stack[-1], references.unescape(text) if "&" in text else text))

    def _start(self, tag: str, attributes: str) -> None:
        if tag in ("html", "body") and self._open.get(tag):
            return
        if self._open.get("head") and tag not in HEAD:
            self._pop_to({"head"}, ())
        if tag in BLOCK:
            if self._open.get("p"):
                self._pop_to({"p"}, SCOPE)
            if tag in CLOSES:
                self._pop_to(*CLOSES[tag])
            self._break()
        if tag in VOID:
            if tag == "br":
                self._break()
            elif tag == "img":
                self._node(tag, attributes)
            return
        if attributes.endswith("/") and tag not in BLOCK and (tag in ("svg", "math") or tag not in INLINE and tag not in RAW):
            return
        self._push(tag, attributes)

    def _end(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            if tag == "br":
                self._break()
            return
        names = HEADINGS if tag in HEADINGS else {tag}
        if not any(self._open.get(n) for n in names):
            return
        for i in range(len(self._stack) - 1, 0, -1):
            open_tag = self.tags[self._stack[i]]
            if open_tag in names:
                while len(self._stack) > i:
                    self._pop()
                return
            # an inline element does not end outside the block it ends in, and a block not outside its cell
            if tag not in BLOCK and open_tag in BLOCK or tag in BLOCK and open_tag in ("td", "th") and tag not in ("tr", "table", "tbody", "thead", "tfoot"):
                return


@lru_cache(1 << 14)
def _mark(tag: str, attributes: str) -> tuple[tuple[str, str], str]:
    """The signature of an element, what its attributes say, and its link."""
    if not attributes or "=" not in attributes:
        return (tag, "noise" if re.search(r"\bhidden\b", attributes, re.I) else ""), ""
    named: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        named.setdefault(name.lower(), a or b or c)
    names = f"{named.get('class', '')} {named.get('id', '')}"
    words = {w.lower() for w in _WORDS.findall(names)} | {w.lower() for w in re.split(r"[\s_-]+", names)}
    role = named.get("role", "").lower()
    says = ""
    if role in NOISE_ROLES or "hidden" in named or named.get("aria-hidden") == "true" or _HIDDEN.search(named.get("style", "")):
        says = "noise"
    elif any(w.startswith("comment") for w in words):
        says = "comment"
    elif words & NOISE_WORDS or any(w.startswith(NOISE_STARTS) for w in words if w):
        says = "likely"
    elif role in ("main", "article") or "articlebody" in named.get("itemprop", "").lower():
        says = "main"
    elif words & ARTICLE_WORDS:
        says = "article"
    classes = ".".join(sorted(_DIGITS.sub("0", named.get("class", "")).split()))
    link = named.get("href" if tag == "a" else "src" if tag == "img" else "", "")
    return (f"{tag}.{classes}#{_DIGITS.sub('0', named.get('id', ''))}", says), link


def paths(page: Page, site: int) -> list[int]:
    """The node of the site's tree (64 bits) that each element of a page belongs to."""
    out: list[int] = []
    known: dict[tuple[int, str], int] = {}
    for parent, (signature, _) in zip(page.parents, page.marks):
        key = (site if parent < 0 else out[parent], signature)
        node = known.get(key)
        if node is None:
            node = known[key] = xxhash.xxh64_intdigest(signature.encode("utf-8", "surrogatepass"), key[0])
        out.append(node)
    return out


def _item(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def styles_and_features(page: Page, nodes: list[int]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """A page's style per node, the hash of its elements' child sequences without repeats, and the occurrences of its features."""
    children: dict[int, list[str]] = {n: [] for n in nodes}
    features: dict[tuple[int, int], int] = {}
    for i, parent in enumerate(page.parents):
        if parent >= 0:
            inside = children[nodes[parent]]
            if not inside or inside[-1] != page.marks[i][0]:
                inside.append(page.marks[i][0])
        if page.links[i]:
            key = (nodes[i], _item("link " + _DIGITS.sub("0", page.links[i])))
            features[key] = features.get(key, 0) + 1
    for owner, text in page.pieces:
        if text == " " or page.tags[owner] in RAW:
            continue
        node = nodes[owner]
        for part in _SENTENCE.split(" ".join(text.lower().split())):
            if part and part != " ":
                key = (node, _item(part))
                features[key] = features.get(key, 0) + 1
    return {n: _item(" ".join(c)) for n, c in children.items()}, features


def _signed(values) -> pa.Array:
    return pa.array(np.fromiter(values, np.uint64).view(np.int64))


def site_tree(pages: DataFrame) -> DataFrame:
    """``node, pages, presentation, styles, content`` of each node that at least two pages of a site share.

    ``pages`` has ``site`` (not null) and ``html``.  ``presentation`` is the entropy of the node's styles over the site's pages, between 0 and 1, and
    ``content`` one minus the mean entropy of its features over the pages (null without any).
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int, int], list] = {}

        def close() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [
                    _signed(k[1] for k in held), pa.array([k[0] for k in held], pa.int32()), _signed(k[2] for k in held),
                    pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.float64()),
                ],
                names=["node", "kind", "item", "n", "q"],
            )
            held.clear()
            return out

        def add(kind: int, node: int, item: int, n: int) -> None:
            entry = held.get((kind, node, item))
            if entry is None:
                entry = held[kind, node, item] = [0, 0.0]
            entry[0] += n
            entry[1] += n * math.log(n)

        for batch in batches:
            for site, source in zip(batch.column("site").to_pylist(), batch.column("html")):
                page = Page(source.as_py() or "")
                nodes = paths(page, site & (1 << 64) - 1)
                styles, features = styles_and_features(page, nodes)
                for node, style in styles.items():
                    add(0, node, style, 1)
                for (node, item), n in features.items():
                    add(1, node, item, n)
                if len(held) > COUNTED:
                    yield close()
        if held:
            yield close()

    counted = pages.select("site", "html").mapInArrow(count, "node bigint, kind int, item bigint, n bigint, q double")
    items = counted.groupBy("node", "kind", "item").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    n, style = F.col("n"), F.col("kind") == 0
    sums = items.groupBy("node").agg(
        F.sum(F.when(style, n)).alias("pages"),
        F.sum(F.when(style, n * F.ln(n))).alias("same"),
        F.count(F.when(style, n)).cast("int").alias("styles"),
        F.count(F.when(~style, n)).alias("features"),
        F.sum(F.when(~style, F.ln(n) - F.col("q") / n)).alias("spread"),
    )
    m = F.col("pages")
    return sums.filter(m >= 2).select(
        "node",
        "pages",
        (1 - F.col("same") / (m * F.ln(m))).alias("presentation"),
        "styles",
        F.when(F.col("features") > 0, F.greatest(F.lit(0.0), 1 - F.col("spread") / (F.col("features") * F.ln(m)))).alias("content"),
    )


def importance(page: Page, nodes: list[int], tree: Callable[[int], tuple | None]) -> tuple[list[float], list[int]]:
    """Composite importance of each element, from the leaves up, and the pages that share its node.

    What no other page has is important.
    """
    n = len(nodes)
    total, number = [0.0] * n, [0] * n
    known = [tree(node) for node in nodes]
    for owner, text in page.pieces:
        if number[owner] == 0 and not text.isspace():
            # an element's own text is like one more child
            content = known[owner][3] if known[owner] else None
            total[owner] += 1.0 if content is None else content
            number[owner] += 1
    value = [1.0] * n
    for i in range(n - 1, -1, -1):
        if known[i]:
            _, presentation, styles, content = known[i]
            inside = total[i] / number[i] if number[i] else (content if content is not None else 0.0)
            weight = DAMPING**styles
            value[i] = (1 - weight) * presentation + weight * inside
        elif number[i]:
            value[i] = total[i] / number[i]
        if page.parents[i] >= 0:
            total[page.parents[i]] += value[i]
            number[page.parents[i]] += 1
    return value, [k[0] if k else 1 for k in known]


def main_text(source: str, site: int | None = None, tree: Callable[[int], tuple | None] | None = None) -> str:
    """The article of a page; without a site's tree by what its elements say alone."""
    page = Page(source)
    n = len(page.tags)
    size = [0] * n
    for owner, text in page.pieces:
        size[owner] += len(text.strip())
    own = size.copy()
    for i in range(n - 1, 0, -1):
        size[page.parents[i]] += size[i]
    says = [mark for _, mark in page.marks]
    sure = [page.tags[i] in NOISE_TAGS or says[i] in ("noise", "comment") for i in range(n)]
    noise = [sure[i] or says[i] == "likely" for i in range(n)]
    noise[0] = sure[0] = False
    for i in range(1, n):
        # a wrapper's class may name a part of the page, as in "with-sidebar"
        if page.tags[i] == "body" or noise[i] and not sure[i] and size[i] > 0.7 * size[0]:
            noise[i] = sure[i] = False
    below = [False] * n  # inside noise
    for i in range(1, n):
        below[i] = below[page.parents[i]] or noise[i]
    articles: list[int] = []
    for test in (
        lambda i: page.tags[i] == "article" or says[i] == "main" and page.tags[i] != "main",
        lambda i: page.tags[i] == "main" or says[i] == "main",
        lambda i: says[i] == "article" and page.tags[i] in BLOCK and page.tags[i] not in HEADINGS and page.tags[i] not in ("html", "body", "p", "li"),
    ):
        found = [i for i in range(1, n) if size[i] and not noise[i] and test(i)]
        clean = [i for i in found if not below[i]]
        if clean or found and page.tags[found[0]] in ("article", "main"):
            articles = clean or found
            break
    value, shared = ([1.0] * n, [1] * n) if tree is None else importance(page, paths(page, site), tree)
    inside = [False] * n
    for i in articles:
        inside[i] = True
    dropped, low = [False] * n, [False] * n
    for i in range(1, n):
        parent = page.parents[i]
        inside[i] = inside[i] or inside[parent]
        dropped[i] = noise[i] if not inside[i] or parent < 0 else dropped[parent] or noise[i]
        if articles and inside[i] and not inside[parent]:
            dropped[i] = False
        elif not articles:
            dropped[i] = dropped[parent] or noise[i]
        if page.tags[i] in HEADINGS and inside[parent] and page.tags[parent] == "header" and not dropped[page.parents[parent]]:
            dropped[i] = False  # the article's own title
        if articles:
            box = page.tags[i] in ("div", "section") and inside[parent]
            low[i] = inside[parent] and (low[parent] or box and shared[i] >= LEAST_PAGES and value[i] < LOW_INSIDE)
        else:
            low[i] = low[parent] or shared[i] >= 2 and page.tags[i] not in ("html", "body") and value[i] < LOW_OUTSIDE
    kept = [(not articles or inside[i]) and not dropped[i] for i in range(n)]
    whole = sum(own[i] for i in range(n) if kept[i])
    removed = sum(own[i] for i in range(n) if kept[i] and low[i])
    # a site of copies repeats its articles as well: its tree tells nothing about them
    trusted = removed * 2 <= whole if articles else removed < whole
    parts = [text for owner, text in page.pieces if kept[owner] and not (trusted and low[owner])]
    return " ".join("".join(parts).split())


def site_of(url: str | Column = "url") -> Column:
    """The host of a URL in lower case as 64 bits; null without a host."""
    column = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(column, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(F.length(host) > 0, F.xxhash64(host))


def _looked_up(tree: DataFrame) -> Callable[[], Callable[[int], tuple | None]]:
    """A function to find a node, from a tree of bounded size that every executor gets."""
    table = tree.toArrow()
    node = table.column("node").to_numpy()
    order = np.argsort(node)
    columns = [table.column(c).to_numpy()[order] for c in ("pages", "presentation", "styles", "content")]
    shared = tree.sparkSession.sparkContext.broadcast((node[order], columns))

    def make() -> Callable[[int], tuple | None]:
        keys, (pages, presentation, styles, content) = shared.value

        def find(node: int) -> tuple | None:
            signed = node - (1 << 64) if node >> 63 else node
            at = int(np.searchsorted(keys, signed))
            if at == len(keys) or keys[at] != signed:
                return None
            c = float(content[at])
            return int(pages[at]), float(presentation[at]), int(styles[at]), None if math.isnan(c) else c

        return find

    return make


def _with_nodes(pages: DataFrame, tree: DataFrame) -> DataFrame:
    """``pages`` with the tree nodes of each page as ``_nodes``, by shuffles: for trees of any size.

    A page has few nodes, but a node may belong to very many pages; those are dealt over ``SALTS`` parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for key, site, source in zip(batch.column("_key").to_pylist(), batch.column("_site").to_pylist(), batch.column("_html")):
                nodes = set(paths(Page(source.as_py()), site & (1 << 64) - 1))
                keys += [key] * len(nodes)
                found += nodes
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), _signed(found)], names=["_key", "node"])

    wanted = pages.filter("_site IS NOT NULL").select("_key", "_site", "_html").mapInArrow(run, "_key bigint, node bigint")
    wanted = wanted.withColumn("salt", F.pmod("_key", F.lit(SALTS)))
    dealt = tree.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumn("salt", F.col("salt").cast("bigint"))
    entry = F.struct("node", "pages", "presentation", "styles", "content")
    met = wanted.join(dealt, ["node", "salt"]).groupBy("_key").agg(F.collect_set(entry).alias("_nodes"))
    return pages.join(met, "_key", "left")


def extract_pages(pages: DataFrame, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``page_id, url, text, n_chars`` for every page, from its whole html.

    Null and empty pages have the empty text.  Pages without a host (or url) belong to no site and are judged by their elements alone, as is a
    site's only page.  Repeated rows and ids keep a row each.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    known = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("_html"), site_of().alias("_site"))
    tree = stage(site_tree(known.filter("_site IS NOT NULL").select(F.col("_site").alias("site"), F.col("_html").alias("html"))), "site_tree")
    if tree.count() <= broadcast_nodes:
        find = _looked_up(tree)
        source = known.select("page_id", "url", "_html", "_site")
    else:
        find = None
        source = _with_nodes(known.withColumn("_key", F.xxhash64("page_id", "url", "_html")), tree).select("page_id", "url", "_html", "_site", "_nodes")
    fields = pages.select("page_id", "url").schema.fields
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields) + ", text string, n_chars bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = find() if find else None
        for batch in batches:
            texts = []
            nodes = batch.column("_nodes") if look is None else None
            for i, (source, site) in enumerate(zip(batch.column("_html"), batch.column("_site").to_pylist())):
                lookup = look
                if nodes is not None:
                    held = {e["node"]: (e["pages"], e["presentation"], e["styles"], e["content"]) for e in nodes[i].as_py() or ()}
                    lookup = lambda node, held=held: held.get(node - (1 << 64) if node >> 63 else node)
                texts.append(main_text(source.as_py()) if site is None else main_text(source.as_py(), site & (1 << 64) - 1, lookup))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    return source.mapInArrow(run, schema)
