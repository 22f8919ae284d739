"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: elements on the same path of tags and classes are one node. Its
nodes are judged where text lives, in containers (divisions, sections, lists, tables). A container's content
importance is one less the mean entropy of its blocks over the pages that have it: a block of one page alone has
entropy 0, one that all pages share has entropy 1. Its presentation importance is the entropy of the sequences of
elements below it. Composite importance weighs the two. Distinct pages count, however many rows repeat them.

A host of few pages says little, so its importance is drawn towards that of the same path in the merged tree of
all hosts, and that towards 1, each with the weight of PRIOR pages; there is no least number of pages. A container
below LOW, on SHARE of its host's distinct pages or more, is removed from every page of the host. Inside a marked
article only what its own host repeats almost word for word goes (ROOT_LOW, ROOT_PRIOR). Paragraphs and headings
are never judged by themselves.

Composite importance also weighs where a container stands. One that names itself furniture (a form, a fieldset, a class
or id of NAMES) or that lies beside a marked article does not stand for the page's own text; a path that stands on a
share s of its host's pages keeps the share STANDING + (1 - STANDING) * s of its importance, however few pages have it.
So names and marks are evidence, and the tree decides: a path with a name goes where it holds furniture on its host's
pages, and stays where it holds their text. A container with more than MOST of a page's text, or of its marked
articles, stands whatever it is called; inside an article only names of adverts and reader comments count, and an id
that is the slug of its section's own heading is no name. An article marks nothing if the text beside it is OUTSIDE
times as long, as beside a teaser. What HTML itself sets apart (nav, footer, aside, hidden parts, ...) goes on every page.

Defined results: null html, or html without text, gives an empty text of 0 characters; a null url is a host of
its own kind; unclosed and overlapping tags are read as browsers close them; repeated rows give repeated
results; an empty table gives an empty result; columns of the input other than its key, url and html are left out.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html as entities
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, mix64, written

#: Pages whose weight the importance in all hosts has beside a host's own, and 1 beside that.
PRIOR = 16
#: Composite importance below which a container goes; and share of the host's distinct pages that must have it.
LOW, SHARE = 0.7, 0.5
#: The same inside a marked article, by its own host alone.
ROOT_LOW, ROOT_PRIOR = 0.3, 4
#: Weight of the content in a container's importance; the rest is its presentation's.
CONTENT = 0.8
#: How many times longer than a marked article the text outside it must be to be the page's text.
OUTSIDE = 3
#: Share of its importance that a container keeps which stands on no page.
STANDING = 0.5
#: Share of a page's text beyond which a container is no furniture by its name; the same for reader comments.
MOST, MOST_COMMENTS = 0.5, 0.9
#: Decisions (16 bytes each) that are broadcast at once; more go in blocks.
DECISIONS = 1_000_000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|textarea|select|object|canvas|xmp|noembed|noframes)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>"
    r"|<[!?][^>]*+>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
FURNITURE = frozenset("head title nav footer aside menu dialog datalist map audio video".split())
#: Furniture, unless they hold the page's text.
FORMS = frozenset("form fieldset".split())
CONTAINERS = frozenset("address aside body center details dialog dir div dl fieldset figure footer form header html main article menu nav ol section table tbody td tfoot th thead tr ul".split())
#: Buttons and labels inside these are words of a sentence.
SENTENCES = frozenset("p li dd dt td th h1 h2 h3 h4 h5 h6 blockquote figcaption pre".split())
ROLES = frozenset("navigation banner contentinfo complementary alert dialog menu menubar toolbar".split())
FORM_ROLES = frozenset("form search".split())
# Whole names of classes and ids that menus, headers, footers, sidebars, notices, adverts, forms and
# reader comments give themselves.
NAMES = frozenset(
    "ad ads ad-slot ad-unit ad-banner ad-container advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion "
    "nav navbar navigation main-nav main-menu menu menus site-nav site-menu breadcrumb breadcrumbs pagination pager skip-link skip-links toolbar "
    "masthead banner site-header page-header site-footer page-footer footer sidebar side-bar sidebars side-menu left-sidebar right-sidebar widget widgets widget-area "
    "cookie cookies cookie-banner cookie-bar cookie-consent cookie-notice consent gdpr notice notices site-notice popup popups modal overlay "
    "newsletter newsletter-signup subscribe subscription signup sign-up login login-form search search-form searchbox share sharing share-buttons share-bar social social-links social-share "
    "related-posts related-articles related-links related-stories recommended recommendations more-stories "
    "comment comments comment-list commentlist comment-form comments-area comment-section comments-section user-comments reader-comments disqus disqus_thread respond replies".split()
)
#: Names of adverts and reader comments count inside an article too, as do compounds of these words.
ADVERTS = frozenset("ad ads adsbygoogle ad-slot ad-unit ad-banner ad-container advert adverts advertisement advertisements advertising sponsored".split())
COMMENTS = frozenset("comment comments comment-list commentlist comment-form comments-area comment-section comments-section user-comments reader-comments disqus disqus_thread respond replies responses".split())
#: Further names outside an article, which uses them for parts of its own, and words that are furniture in any compound.
OUTER_NAMES = frozenset("header alert alerts related".split())
OUTER_WORDS = frozenset("cookie cookies gdpr newsletter promo breadcrumb breadcrumbs".split())
WORDS = frozenset("ad ads advert adverts advertisement comment comments".split())
CLOSES_P = BLOCKS - frozenset("body html head title option optgroup caption tbody td tfoot th thead tr".split())
#: An element that ends an open one of its own group, up to the container that holds both.
SIBLINGS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "datalist")}
SIBLINGS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in SIBLINGS.items()}
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


@dataclass
class Node:
    tag: str
    path: int
    furniture: bool
    in_root: bool
    container: int
    named: bool = False  # furniture by its class or id, or a form
    ident: str = ""  # the id that alone names it
    article: bool = False
    comments: bool = False
    below: list[str] = field(default_factory=list)  # tags of its children, in order


@dataclass
class Page:
    nodes: list[Node]
    parents: list[int]
    blocks: list[tuple[int, str]]  # node, text


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big")


@functools.lru_cache(maxsize=1 << 16)
def _step(name: str) -> int:
    return _hash(re.sub(r"\d+", "#", name))


def _path(up: int, name: str) -> int:
    """The path of a node from its parent's, as 64 bits."""
    x = (up * 0x9E3779B97F4A7C15 + _step(name)) & 0xFFFFFFFFFFFFFFFF
    return (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF


def _attributes(text: str) -> dict[str, str]:
    """Names in lower case with their values; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _is_name(word: str, in_root: bool) -> bool:
    parts = set(re.split("[-_]+", word))
    if word in ADVERTS or word in COMMENTS or parts & WORDS:
        return True
    return not in_root and (word in NAMES or word in OUTER_NAMES or bool(parts & OUTER_WORDS))


def _read(tag: str, text: str, in_root: bool, node: Node) -> str:
    """Fill in what an element says of itself; its step of a path is returned."""
    node.furniture = tag in FURNITURE or tag == "header" and not in_root
    node.named, node.article = tag in FORMS, tag in ROOTS
    if not text or text.isspace():
        return tag
    has = _attributes(text)
    classes, ident, role = has.get("class", "").split(), has.get("id", "").strip(), has.get("role", "").lower()
    step = f"{tag}.{'.'.join(sorted(classes))}" if classes else tag
    if tag in ("html", "body") or tag in ROOTS and not in_root:
        return step
    node.furniture = node.furniture or role in ROLES or "hidden" in has or has.get("aria-hidden", "").lower() == "true" or "display:none" in has.get("style", "").replace(" ", "").lower()
    node.article = node.article or role in ROOTS
    if role in FORM_ROLES:
        node.named, step = True, f"{step}[{role}]"
    if tag in CONTAINERS and tag not in ROOTS:
        found = [x for x in map(str.lower, classes) if _is_name(x, in_root)]
        if not node.named and not found and _is_name(ident.lower(), in_root):
            node.ident = ident
            step, found = f"{step}#{ident.lower()}", [ident.lower()]
        node.named = node.named or bool(found)
        node.comments = any(x in COMMENTS or {"comment", "comments"} & set(re.split("[-_]+", x)) for x in found)
    return step


class _Open:
    """The open elements, with the places of each tag among them, so that nothing looks through all."""

    def __init__(self, nodes: list[Node]):
        self.nodes, self.stack, self.places, self.blocks, self.sentences = nodes, [0], {}, [], 0

    def push(self, node: int) -> None:
        tag = self.nodes[node].tag
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.sentences += tag in SENTENCES
        self.stack.append(node)

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            tag = self.nodes[self.stack.pop()].tag
            self.places[tag].pop()
            if tag in BLOCKS:
                self.blocks.pop()
            self.sentences -= tag in SENTENCES

    def last(self, tags: Iterable[str]) -> int:
        """The innermost place of any of the tags; 0 if none is open."""
        return max((x[-1] for t in tags if (x := self.places.get(t))), default=0)


def parse(html: str | None) -> Page:
    """The page's elements and text blocks, in order; the time is linear in the page's length."""
    nodes, parents, blocks = [Node("", 0, False, False, 0)], [-1], []
    open_, parts, last = _Open(nodes), [], 0
    html = html or ""
    end = html.rfind(">") + 1  # no tag ends behind it

    def flush():
        if parts:
            text = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if text:
                blocks.append((open_.stack[-1], text))
            parts.clear()

    def close(to: int):
        flush()
        open_.cut(to)

    tail = html[end:]
    for m in TOKEN.finditer(html, 0, end):
        if m.start() > last:
            parts.append(html[last : m.start()])
        last = m.end()
        if last == end and not m[3] and (m[0].startswith("<!--") and not m[0].endswith("-->") or m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.I)):
            tail = ""  # never closed
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            at = open_.last((tag,))
            if at:
                if tag in BLOCKS:
                    close(at)
                elif not open_.blocks or open_.blocks[-1] < at:
                    if nodes[open_.stack[at]].furniture or nodes[open_.stack[at]].named:
                        flush()
                    open_.cut(at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in CLOSES_P and open_.blocks and nodes[open_.stack[open_.blocks[-1]]].tag == "p":
            close(open_.blocks[-1])
        if tag in SIBLINGS:
            ends, bound = SIBLINGS[tag]
            while (at := open_.last(ends)) > open_.last(bound):
                close(at)
                if tag != "tr":
                    break
        if tag in VOID:
            if tag in BLOCKS:
                flush()
            continue
        up = nodes[open_.stack[-1]]
        node = Node(tag, 0, False, False, 0)
        step = _read(tag, m[4], up.in_root, node)
        if tag in ("button", "label", "input"):
            node.furniture = node.furniture or not open_.sentences
        if tag in BLOCKS or node.furniture or node.named:
            flush()
        up.below.append(tag)
        at = len(nodes)
        node.path, node.in_root, node.container = _path(up.path, step), up.in_root or node.article, at if tag in CONTAINERS else up.container
        nodes.append(node)
        parents.append(open_.stack[-1])
        open_.push(at)
    tail = tail.split("<!--")[0]
    if html[last:end] or tail:
        parts.append(html[last:end] + tail)
    flush()
    page = Page(nodes, parents, blocks)
    _settle(page)
    return page


def _settle(page: Page) -> None:
    """Names that the page's own text outweighs are dropped; then what holds for an element holds for those in it."""
    nodes, parents = page.nodes, page.parents
    hidden = [False] * len(nodes)
    ends = list(range(1, len(nodes) + 1))  # where the elements inside one end
    for i in range(1, len(nodes)):
        hidden[i] = nodes[i].furniture or hidden[parents[i]]
    for i in range(len(nodes) - 1, 0, -1):
        ends[parents[i]] = max(ends[parents[i]], ends[i])
    text, articles = np.zeros(len(nodes) + 1, dtype=np.int64), np.zeros(len(nodes) + 1, dtype=np.int64)
    for i, t in page.blocks:
        if not hidden[i]:
            text[i + 1] += len(t)
            articles[i + 1] += len(t) if nodes[i].in_root else 0
    text, articles = np.cumsum(text), np.cumsum(articles)
    comments = np.cumsum([0, *(n.comments for n in nodes)])
    headings: list[tuple[int, str]] = [(i, t) for i, t in page.blocks if nodes[i].tag in HEADINGS] if any(n.ident for n in nodes) else []
    at = [i for i, _ in headings]
    for i, n in enumerate(nodes):
        if not n.named:
            continue
        most = MOST_COMMENTS if n.comments else MOST
        if text[ends[i]] - text[i] > most * text[-1] or not nodes[parents[i]].in_root and articles[ends[i]] - articles[i] > most * articles[-1]:
            n.named = False
        elif n.ident and nodes[parents[i]].in_root and comments[ends[i]] == comments[i + 1]:
            j = bisect.bisect_left(at, i)
            if j < len(at) and at[j] < ends[i] and _slug(headings[j][1]) == _slug(n.ident):
                n.named = False
    nodes[0].in_root = False
    for i in range(1, len(nodes)):
        n, up = nodes[i], nodes[parents[i]]
        n.furniture, n.named = n.furniture or up.furniture, n.named or up.named
        n.in_root = up.in_root or n.article and not n.furniture and not n.named


def _slug(text: str) -> str:
    return "-".join(re.findall(r"\w+", text.lower()))


def _marks(inside: int, outside: int) -> bool:
    """Whether an article of so many characters marks the page's text."""
    return bool(inside) and outside <= OUTSIDE * inside


def _standing(page: Page) -> list[bool]:
    """For each element, whether it stands for the page's own text: without a name, and in the marked article if there is one."""
    shown = [(page.nodes[i].in_root, len(t)) for i, t in page.blocks if not (page.nodes[i].furniture or page.nodes[i].named)]
    marked = _marks(sum(n for root, n in shown if root), sum(n for root, n in shown if not root))
    return [not n.named and (n.in_root or not marked) for n in page.nodes]


def _is_judged(box: Node, container: int) -> bool:
    return bool(container) and box.tag not in ("html", "body") and box.tag not in ROOTS


def decided_text(page: Page, removed: frozenset[int] | set[int]) -> str:
    """The blocks that the style tree leaves: without removed containers and what HTML sets apart. Text that is in no
    container of its own goes if the page marks an article elsewhere."""
    stands, gone, kept = _standing(page), [False] * len(page.nodes), []
    for i in range(1, len(page.nodes)):
        n = page.nodes[i]
        gone[i] = n.furniture or gone[page.parents[i]] or n.container == i and n.path in removed
    for i, t in page.blocks:
        box = page.nodes[page.nodes[i].container]
        if not gone[i] and (_is_judged(box, page.nodes[i].container) or stands[i]):
            kept.append(t)
    return "\n".join(kept)


def main_text(page: Page, removed: frozenset[int] | set[int] = frozenset()) -> str:
    """Of a page by itself: the blocks of the article (or of the page, if it marks none) outside furniture, names and
    removed containers."""
    gone = [False] * len(page.nodes)
    for i in range(1, len(page.nodes)):
        n = page.nodes[i]
        gone[i] = n.furniture or n.named or gone[page.parents[i]] or n.container == i and n.path in removed
    kept = [(page.nodes[i].in_root, t) for i, t in page.blocks if not gone[i]]
    inside = sum(len(t) for root, t in kept if root)
    if _marks(inside, sum(len(t) for root, t in kept if not root)):
        kept = [x for x in kept if x[0]]
    return "\n".join(t for _, t in kept)


def _judged(page: Page) -> dict[int, tuple[int, set[int]]]:
    """By path, the containers with text of their own that may go: their presentation and their blocks, hashed."""
    out: dict[int, tuple[int, set[int]]] = {}
    for i, t in page.blocks:
        n = page.nodes[i]
        box = page.nodes[n.container]
        if n.furniture or not _is_judged(box, n.container):
            continue
        if box.path not in out:
            out[box.path] = _hash(" ".join(box.below)), set()
        out[box.path][1].add(_hash(t))
    return out


def _signed(x: Iterable[int]) -> np.ndarray:
    return np.array(list(x), dtype=np.uint64).view(np.int64)


FEATURES = "host long, path long, page long, kind int, value long, root boolean, stands boolean"


def _features(batches):
    """(host, path, page, kind, value, inside an article, stands): blocks (kind 0) and presentations (1) of containers,
    and the page itself (path 0)."""
    for b in batches:
        cols: list[list] = [[] for _ in range(7)]
        for host, html in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            page = parse(html.as_py())
            text = _hash(main_text(page))
            says = {n.path: (n.in_root, stands) for n, stands in zip(page.nodes, _standing(page), strict=True)}
            rows = [(0, 0, text, False, True)]
            for path, (shape, blocks) in _judged(page).items():
                rows.append((path, 1, shape, *says[path]))
                rows.extend((path, 0, x, *says[path]) for x in blocks)
            for path, kind, value, root, stands in rows:
                for c, x in zip(cols, (host, path, text, kind, value, root, stands), strict=True):
                    c.append(x)
        arrays = [pa.array(cols[0], pa.int64()), *(pa.array(_signed(cols[i])) for i in (1, 2)), pa.array(cols[3], pa.int32()), pa.array(_signed(cols[4])), *(pa.array(x, pa.bool_()) for x in cols[5:])]
        yield pa.RecordBatch.from_arrays(arrays, names=["host", "path", "page", "kind", "value", "root", "stands"])


def _importance(counts: DataFrame, *keys: str) -> DataFrame:
    """The keys, pages and composite importance of each node. counts: its values with their numbers of pages (n)."""
    pages = F.sum(F.when(F.col("kind") == 1, F.col("n")))
    sums = counts.groupBy(*keys).agg(
        pages.alias("pages"), F.max("root").alias("root"), F.avg(F.when(F.col("kind") == 0, F.log("n"))).alias("shared"), F.sum(F.when(F.col("kind") == 1, F.col("n") * F.log("n"))).alias("same")
    )
    content = 1 - F.col("shared") / F.log("pages")
    shape = 1 - F.col("same") / (F.col("pages") * F.log("pages"))
    return sums.select(*keys, "pages", "root", F.when(F.col("pages") < 2, 1.0).otherwise(CONTENT * F.least(F.lit(1.0), content) + (1 - CONTENT) * shape).alias("own"))


def site_trees(pages: DataFrame) -> DataFrame:
    """host and path of the containers to remove. pages: host (a long), html.

    Pages are read once, and only hashes leave them: (host, path, page, value), folded by page, then counted by
    value; no host and no path comes together in one task, only its sums do.
    """
    each = pages.select("host", "html").mapInArrow(_features, FEATURES).groupBy("host", "path", "page", "kind", "value").agg(F.max("root").alias("root"), F.max("stands").alias("stands"))
    counted = written(each.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.max("root").alias("root"), F.count_if("stands").alias("stands")), "style-counts")
    distinct = counted.where("path = 0").groupBy("host").agg(F.sum("n").alias("distinct"))
    nodes = counted.where("path <> 0")
    standing = nodes.where("kind = 1").groupBy("host", "path").agg((F.sum("stands") / F.sum("n")).alias("standing"))
    hosts = _importance(nodes, "host", "path").join(standing, ["host", "path"])
    everywhere = _importance(nodes.groupBy("path", "kind", "value").agg(F.sum("n").alias("n"), F.max("root").alias("root")), "path")
    everywhere = everywhere.select("path", ((F.col("pages") * F.col("own") + PRIOR) / (F.col("pages") + PRIOR)).alias("general"))
    drawn = lambda own, prior, weight: (F.col("pages") * own + weight * prior) / (F.col("pages") + weight)
    both = drawn(F.col("own"), F.col("general"), PRIOR)
    low = F.when(F.col("root"), drawn(F.col("own"), F.lit(1.0), ROOT_PRIOR) <= ROOT_LOW).otherwise(both <= LOW) & (F.col("pages") >= SHARE * F.col("distinct"))
    beside = (F.col("standing") < 1) & (both * (STANDING + (1 - STANDING) * F.col("standing")) <= LOW)
    out = written(hosts.join(everywhere, "path").join(distinct, "host").where(low | beside).select("host", "path"), "style-decisions")
    discard(counted)
    return out


def _combined(host, path) -> np.ndarray:
    host, path = (np.asarray(x, dtype=np.int64).view(np.uint64) for x in (host, path))
    return mix64(host) + path


def _decision_blocks(trees: DataFrame) -> Iterator[np.ndarray]:
    """The decisions as sorted numbers, DECISIONS at a time; one empty block if there are none."""
    n = -(-trees.count() // DECISIONS)
    if n == 0:
        yield np.zeros(0, dtype=np.uint64)
    for k in range(n):
        t = trees.where(F.pmod(F.xxhash64("path", "host"), F.lit(n)) == k).toArrow()
        yield np.sort(_combined(t["host"].to_numpy(), t["path"].to_numpy()))


def _removed(page: Page, host: int, decisions: np.ndarray) -> set[int]:
    return _among(_signed(_judged(page)), host, decisions)


def _among(paths, host: int, decisions: np.ndarray) -> set[int]:
    """Those of a page's paths that are decided to go."""
    paths = np.asarray(paths, dtype=np.int64).view(np.uint64)
    if not len(paths) or not len(decisions):
        return set()
    x = _combined(np.full(len(paths), host), paths.view(np.int64))
    at = np.minimum(np.searchsorted(decisions, x), len(decisions) - 1)
    return set(paths[decisions[at] == x].tolist())


def _with_paths(rows: DataFrame) -> DataFrame:
    """rows with the paths of each page's containers."""

    def found(batches):
        for b in batches:
            out = [_signed(sorted(_judged(parse(x.as_py())))).tolist() for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out, pa.list_(pa.int64())), b.column(5)], names=b.schema.names)

    return rows.mapInArrow(found, rows.schema)


def _marked(rows: DataFrame, decisions) -> DataFrame:
    """rows with the paths that a block of decisions removes from each page; no page is parsed again."""

    def found(batches):
        for b in batches:
            out = [[*r, *_signed(sorted(_among(p, h, decisions.value))).tolist()] for h, p, r in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(out, pa.list_(pa.int64()))], names=b.schema.names)

    return rows.mapInArrow(found, rows.schema)


def main_texts(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars of every page. Pages stay where they are: no html is shuffled."""
    host = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(F.col(key), F.col(url), F.col(html).alias("html"), F.xxhash64(host).alias("host"))
    trees = site_trees(rows)
    kind = pages.schema[key].dataType.simpleString()
    none = F.array().cast("array<long>")
    rows = rows.withColumns({"paths": none, "removed": none})
    context, last = pages.sparkSession.sparkContext, None
    for n, block in enumerate(_decision_blocks(trees)):
        if n == 1:
            rows = _with_paths(rows)
        if last is not None:
            rows = _marked(rows, last)
        last = context.broadcast(block)

    def texts(batches):
        for b in batches:
            out = []
            for x, h, r in zip(b.column(2), b.column(3).to_pylist(), b.column(5).to_pylist(), strict=True):
                page = parse(x.as_py())
                out.append(decided_text(page, _removed(page, h, last.value) | {p % (1 << 64) for p in r}))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=[key, url, "text", "n_chars"])

    return rows.mapInArrow(texts, f"`{key}` {kind}, `{url}` string, text string, n_chars long")
