"""Operator 3: main text of web pages by a site style tree.

Every page is read into blocks of text, each under a style path (the block elements around it, with their classes).
The pages of one host are merged into a tree of style nodes.  A presentation node's importance comes from the entropy
of the child layouts seen under it; a content node's from the entropy of its texts over pages (a text that all pages
share tells nothing about any).  Importance is combined from the leaves up, and branches of low importance are removed
from each page of the host.

What elements and classes say of themselves enters as a prior.  Elements and roles that HTML defines as menus, forms,
footers, page headers and so on have a prior of 0 and go.  A node whose class or id is headed by one of NAMES (cookie-notice,
site-footer, related-posts; not share-price or content-with-sidebar) has its importance multiplied by NAMED, unless it
holds an article or main, or nearly all text of a host that has neither.  Branches under ``article`` or ``main`` are
weighed like all others; only these elements themselves stay, and a page whose article or main would lose all text keeps
it whole: articles are copied.  Statistics count different pages only, so mirrored pages don't look like templates; PAGES
made-up pages smooth them, so that on small hosts the priors decide and on large ones the statistics.

Blocks are joined by one newline in page order; white space inside a block becomes one space.

Defined cases: null html is an empty page with empty text; a page that is cut off keeps what came before (an unclosed
tag at the end is no text); an unclosed script, style, title or text area swallows the rest, as in browsers; of other
unread elements without an end only the start tag is left out; a null url has the host ""; repeated pages get equal
texts; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coomat.llm import kernels as K
from coomat.llm.tables import only, removed, settled, written
from coomat.llm.url_filter import parse as parse_url

#: Made-up pages in every entropy's scale.
PAGES = 6
THRESHOLD = 0.2
GAMMA = 0.9
#: What is left of the importance of a node with a name of boilerplate.
NAMED = 0.15
#: Such a node stays with this share of the host's text, if the host has no article or main.
BODY_SHARE = 0.7
#: Removed branches are broadcast up to this many; a longer list is joined by host.
MOST_BROADCAST = 50_000

#: Elements of HTML by how they act here.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("script style noscript template iframe svg math textarea title head object canvas audio video select button datalist map".split())
RAW = frozenset("script style textarea title iframe noscript".split())
BOILERPLATE = frozenset("nav aside footer form dialog menu fieldset search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar tablist status".split())
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored promo promotion banner menu menus nav navbar navigation breadcrumb breadcrumbs sidebar sidebars footer foot masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login signin search searchbox share sharing social related recommended comment comments commentlist disqus reply replies respond widget widgets toolbar pagination pager skip hidden disclaimer copyright".split())
PAGE_HEADS = frozenset("header head topbar top".split())
#: Last words of names that leave the meaning to the word before; words that say a layout has something; kinds of texts with a header of their own.
PLAIN = frozenset("area bar block body box button buttons card container content form group holder icon icons inner item items label link links list outer panel post posts section text unit wrap wrapper zone".split())
HAVING = frozenset("has no with without is".split())
TEXTS = frozenset("article entry post story".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: An item or cell in one of these doesn't end those around it.
ENCLOSING = ("ul", "ol", "dl", "table", "menu", "dir", "div", "section", "article")

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+'|[\"'])*?)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
_NAMED = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_END = {t: re.compile(rf"</{t}(?=[\s/>])|\Z", re.I) for t in RAW}
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])" + (r"|(?=<body[\s>])" if t == "head" else ""), re.I) for t in UNREAD - RAW}
_DIGITS = re.compile(r"\d+")
_RESERVED = re.compile(r"[.#]")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def headed(name: str, inside: bool) -> bool:
    """Whether a style name (tag.class.class#id) has a class or id that is headed by a name of boilerplate.

    As in English the last word is the head, but for words that mean nothing by themselves (PLAIN).
    """
    for own in name.replace("#", ".").split(".")[1:]:
        words = [w.lower() for w in _PARTS.findall(own)]
        if HAVING.intersection(words):
            continue
        while len(words) > 1 and words[-1] in PLAIN and words[-1] not in NAMES:
            words.pop()
        if words and (words[-1] in NAMES or not inside and words[-1] in PAGE_HEADS and not TEXTS.intersection(words)):
            return True
    return False


def is_main(name: str) -> bool:
    """Whether a style name is that of an article or main element, and not that of a comment or advert."""
    tag = name.partition(".")[0].partition("#")[0]
    return tag == "main" or tag == "article" and not headed(name, True)


def _plain(c: str) -> str:
    """A class without numbers and marks of paths; classes made by machines are all alike."""
    c = _RESERVED.sub("_", c)
    return "*" if len(_DIGITS.findall(c)) > 1 else _DIGITS.sub("0", c)


def _look(tag: str, rest: str, inside: bool) -> tuple[str, bool]:
    """The style name of an element and whether HTML says that it is no content.  inside: under article or main."""
    drop = tag in BOILERPLATE or tag == "header" and not inside
    if not rest.strip("/ \t\r\n"):
        return tag, drop
    own = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _NAMED.finditer(rest)}
    name = ".".join([tag, *sorted({_plain(c) for c in own.get("class", "").split()})])
    if own.get("id"):
        name += "#" + _plain(own["id"])
    return name, drop or own.get("role", "").lower() in ROLES or "hidden" in own or own.get("aria-hidden", "").lower() == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()


class Node(NamedTuple):
    """A style node of a page: its number (a hash of the path), its parent's, its depth, its name, and whether it is in an article or main."""

    key: int
    parent: int
    depth: int
    name: str
    inside: bool


ROOT = Node(0, 0, 0, "", False)
#: Nodes made lately by this process, at most CACHE.
_NODES = K.Local()
CACHE = 1 << 14


def style_node(above: Node, tag: str, rest: str) -> tuple[Node, bool]:
    """The node of an element under another, and whether HTML says that it is no content."""
    key = (above.key, tag, rest)
    found = _NODES.get(key)
    if found is None:
        name, drop = _look(tag, rest, above.inside or tag in ("article", "main"))
        found = Node(hash_of(str(above.key), name), above.key, above.depth + 1, name, above.inside or is_main(name)), drop
        if len(_NODES) >= CACHE:
            _NODES.clear()
        if len(rest) < 1000:
            _NODES[key] = found
    return found


def blocks(page: str | None, stripped: frozenset[int] = frozenset()) -> tuple[list[tuple[Node, str]], list[tuple[Node, tuple[str, ...]]]]:
    """Blocks (style node, text) and layouts (style node, names of its children in order).

    Branches under the nodes in ``stripped`` are left out.
    """
    page = page or ""
    out: list[tuple[Node, str]] = []
    layouts: list[tuple[Node, tuple[str, ...]]] = []
    stack: list[tuple[str, Node, bool, list[str]]] = [("", ROOT, False, [])]  # tag, node, dropped, children
    places: dict[str, list[int]] = {}  # where in the stack the open elements of a name are
    endless: set[str] = set()  # unread elements of which no end tag follows
    text: list[str] = []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            whole = "".join(text)
            text.clear()
            if "&" in whole:
                whole = html.unescape(whole)
            whole = " ".join(whole.split())
            if whole and not stack[-1][2]:
                out.append((stack[-1][1], whole))

    def pop(to: int) -> None:
        flush()
        while len(stack) > to:
            name, node, dropped, children = stack.pop()
            places[name].pop()
            if children and not dropped:
                layouts.append((node, tuple(children)))

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        if m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing = m[1]
        if tag in UNREAD:
            if not closing and not m[3].endswith("/"):
                if tag in RAW:
                    at = _END[tag].search(page, at).end()
                    at = page.find(">", at) + 1 or n
                elif tag not in endless:  # to the end tag; head also ends where the body starts
                    end = _ENDS[tag].search(page, at)
                    if end is None:
                        endless.add(tag)
                    else:
                        at = page.find(">", end.end() - (not end[0])) + 1 or n if end[0] else end.end()
            continue
        if tag not in BLOCKS:
            if tag == "br" or tag in VOID:
                text.append(" ")
            continue
        flush()
        if closing:
            if places.get(tag):
                pop(places[tag][-1])
            continue
        if stack[-1][0] == "p":
            pop(len(stack) - 1)
        if tag in CLOSES:
            last = max((places[x][-1] for x in CLOSES[tag] if places.get(x)), default=0)
            if last > max((places[x][-1] for x in ENCLOSING if places.get(x)), default=0):
                pop(last)
        if tag in VOID:
            continue
        _, above, dropped, children = stack[-1]
        node, drop = style_node(above, tag, m[3])
        if not children or children[-1] != node.name:  # a run of like children is one in the layout
            children.append(node.name)
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, node, dropped or drop or node.key in stripped, []))
    pop(1)
    flush()
    return out, layouts


def main_text(page: str | None, stripped: frozenset[int]) -> list[str]:
    """The page's blocks without the stripped branches, but an article or main that these would empty stays whole."""
    found = blocks(page, stripped)[0]
    if stripped and not any(node.inside for node, _ in found):
        whole, layouts = blocks(page)
        inside = {node.key for node, _ in (*whole, *layouts) if node.inside}
        if inside.intersection(stripped):
            found = blocks(page, stripped - inside)[0]
    return [t for _, t in found]


def hash_of(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def style_facts(pages: DataFrame) -> DataFrame:
    """(url, html) -> (host, page, key, parent, depth, name, inside, kind, value, size): texts (kind c) and layouts (kind p), each once a page."""
    names = ["host", "page", "key", "parent", "depth", "name", "inside", "kind", "value", "size"]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                some, rows = b.slice(lo, 500), []
                for url, page in zip(some.column("url").to_pylist(), some.column("html").to_pylist(), strict=True):
                    host = parse_url(url)[0]
                    found, layouts = blocks(page)
                    whole = hash_of(*(t for _, t in found))
                    rows.extend({(host, whole, *node, "c", hash_of(t), len(t)) for node, t in found})
                    rows.extend({(host, whole, *node, "p", hash_of(*inner), 0) for node, inner in layouts})
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return pages.select("url", "html").mapInArrow(run, "host string, page bigint, key bigint, parent bigint, depth int, name string, inside boolean, kind string, value bigint, size bigint")


def importances(rows: list[dict], pages: int) -> dict[int, float]:
    """The highest importance in the branch of each style node of a host, under the prior of its name.

    rows hold the sums of the nodes' texts (kind c) and of their layouts (kind p).  A branch goes if all of it is weak.
    """
    scale = math.log(pages + PAGES)
    node = {r["key"]: r for r in rows}
    content: dict[int, float] = {}
    layout: dict[int, tuple[float, int]] = {}
    weight: dict[int, float] = {}
    size: dict[int, float] = {}
    below: dict[int, list[int]] = {}
    for r in rows:
        k = r["key"]
        if r["kind"] == "c":  # a text on k of m pages has the entropy log k / log m
            content[k] = max(0.0, 1.0 - r["logs"] / r["values"] / scale)
            size[k] = r["size"]
        else:
            layout[k] = (min(1.0, (math.log(r["uses"]) - r["klogs"] / r["uses"]) / scale), r["values"])
        weight[k] = max(weight.get(k, 0.0), r["uses"])
    order = sorted(node, key=lambda k: -node[k]["depth"])
    holders = set()
    for k in order:
        below.setdefault(node[k]["parent"], []).append(k)
        if k in holders or is_main(node[k]["name"]):
            holders.add(node[k]["parent"])
    found: dict[int, float] = {}
    most: dict[int, float] = {}
    total = sum(size.values())
    for k in order:
        inner = [c for c in below.get(k, ()) if c != k]
        size[k] = size.get(k, 0.0) + sum(size[c] for c in inner)
        parts = [content[k]] if k in content else []
        if inner:
            mean = sum(found[c] * weight[c] for c in inner) / sum(weight[c] for c in inner)
            entropy, kinds = layout.get(k, (0.0, 1))  # a single layout says nothing
            parts.append((1 - GAMMA ** (kinds - 1)) * entropy + GAMMA ** (kinds - 1) * mean)
        found[k] = max(parts, default=1.0)
        most[k] = max([found[k], *(most[c] for c in inner)])
        if k == ROOT.key or k in holders or is_main(node[k]["name"]):
            most[k] = 1.0
        elif headed(node[k]["name"], node[k]["inside"]) and (holders or size[k] < BODY_SHARE * total):
            found[k], most[k] = NAMED * found[k], NAMED * most[k]
    return most


def weak_branches(pages: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, key) of the highest style nodes of low importance.

    Grouped sums come first, so the rows of one host that meet in a task are its style nodes, not its pages.
    """
    once, folder = written(style_facts(pages).distinct())
    about = [F.min(c).alias(c) for c in ("parent", "depth", "name", "inside")]
    counted = once.groupBy("host", "key", "kind", "value").agg(F.count(F.lit(1)).alias("k"), F.max("size").alias("size"), *about)
    k = F.col("k").cast("double")
    nodes = counted.groupBy("host", "key", "kind").agg(F.sum(k).alias("uses"), F.count(F.lit(1)).alias("values"), F.sum(F.log(k)).alias("logs"), F.sum(k * F.log(k)).alias("klogs"), F.sum(k * F.col("size")).alias("size"), *about)
    hosts = once.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    nodes = nodes.join(hosts, "host")

    def weigh(key, table):
        rows = table.to_pylist()
        found = importances(rows, rows[0]["pages"])
        parent = {r["key"]: r["parent"] for r in rows}
        weak = [k for k, x in found.items() if x < threshold <= found.get(parent[k], 1.0)]
        return pa.table({"host": pa.array([key[0].as_py()] * len(weak), pa.string()), "key": pa.array(weak, pa.int64())})

    weak = settled(nodes.groupBy("host").applyInArrow(weigh, "host string, key bigint"))
    removed(pages.sparkSession, folder)
    return weak


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(keep..., url, html) -> keep, url, text, n_chars."""
    pages = only(pages, *keep, "url", "html")
    weak = weak_branches(pages)
    many = weak.count()
    lists = weak.groupBy("host").agg(F.collect_set("key").alias("weak"))
    kinds = ", ".join(f"{k} {pages.schema[k].dataType.simpleString()}" for k in keep)
    columns = [*keep, "url", "html"]
    if 0 < many <= MOST_BROADCAST:
        shared = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.weak) for r in lists.collect()})
        rows = pages.select(*columns, F.array().cast("array<bigint>").alias("weak"))
    else:
        shared, rows = None, pages.select(*columns, F.array().cast("array<bigint>").alias("weak"))
        if many:
            host = F.regexp_extract(F.coalesce("url", F.lit("")), "://([^/?#]*)", 1)
            host = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
            rows = pages.select(*columns, host.alias("host")).join(lists, "host", "left").select(*columns, "weak")

    def run(batches):
        weak_of = shared.value if shared is not None else {}
        for b in batches:
            texts = []
            for url, page, own in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), b.column("weak").to_pylist(), strict=True):
                stripped = weak_of.get(parse_url(url)[0], frozenset()) if weak_of else frozenset(own or ())
                texts.append("\n".join(main_text(page, stripped)))
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), b.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "url", "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, url string, text string, n_chars bigint")
