"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements, in which equal neighbours are one node.  The commonest tree of a
host is its reference; the other trees of the host are aligned with it by simple tree matching.  Text that stands in one
aligned slot of at least ``CONSTANT`` of the host's different pages (``MIN_PAGES`` or more) is template; slots whose text
varies hold content.  Elements that announce what they are (navigation, page headers and footers, asides, forms,
adverts, notices, comments, scripts) are never content; if a page has an article or main element, only what is inside is.

Blocks end at block elements; ``br`` and table cells are white space.  If all blocks of a page are template, they are kept: a
host that only repeats one article has no template.  Null html is empty and gives an empty text; a null url is a host of
its own.  Repeated rows are each returned; copies count once when a template is induced.
"""

from __future__ import annotations

import html as markup
import re
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabspark.llm.common import attach, pieces, saved, text_column

CONSTANT, MIN_PAGES = 0.8, 5
SET_BYTES = 8 << 20  # template texts up to this size are broadcast; more meet their pages in a join
MAX_DEPTH = 100  # deeper trees are aligned by position only

# Element and attribute names.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea noscript iframe noembed noframes template svg math object canvas select option".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr br td th input meta link".split())
APART = set("nav footer aside form button dialog menu head".split())
ROLES = set("navigation banner contentinfo complementary search dialog alert menu menubar".split())
NAMES = set("""nav navbar navigation menu breadcrumb breadcrumbs footer sidebar sidenav aside ad ads adv advert adverts advertisement
advertising adsense sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification disclaimer banner
comment comments commentlist replies respond disqus share sharing social related newsletter subscribe signup login popup modal overlay
toolbar pagination pager widget""".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<[!?/][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_OPEN_END = re.compile(r"<[a-zA-Z/!?][^>]*\Z")
_BLANK = re.compile(r"[ \t\n\r\f\v]+")


class Node:
    __slots__ = ("sig", "parent", "kids", "place", "apart", "region", "depth", "number")

    def __init__(self, sig, parent, apart, region):
        self.sig, self.parent, self.apart, self.region = sig, parent, apart, region
        self.kids: list[str] = []
        self.place, self.depth = 0, parent.depth + 1 if parent else 0


def _kind(tag: str, raw: str, parent: Node) -> tuple[str, bool, bool]:
    """Signature, whether it is set apart from content, whether it is a main region."""
    names: set[str] = set()
    shown, role = "", ""
    if raw and "=" in raw:
        for key, value in _ATTRIBUTE.findall(raw):
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id"):
                names.update(x.lower() for x in _NAME.findall(value))
                shown = shown or value.split(" ")[0]
            elif key == "role":
                role = value.lower()
            elif key == "style" and "display:none" in value.replace(" ", "").lower() or key == "aria-hidden" and value.lower() == "true":
                names.add("popup")
    if raw and re.search(r"(?:^|\s)hidden(?=[\s/=]|$)", raw):
        names.add("popup")
    region = tag in ("article", "main") or role in ("main", "article")
    page_header = not parent.region and (tag == "header" or "header" in names or "masthead" in names)
    apart = tag in APART or role in ROLES or bool(names & NAMES) or page_header
    return tag + ("." + re.sub(r"[^\w-]", "", shown) if shown else ""), apart and tag not in ("body", "html"), region


def blocks(page: str) -> tuple[str, list[tuple[Node, str, bool, float]]]:
    """Tree of the page as a string, and its text blocks: node, text, set apart, share of link text."""
    root = Node("", None, False, False)
    stack: list[tuple[str, Node]] = [("", root)]
    out: list[tuple[Node, str, bool, float]] = []
    text: list[str] = []
    linked, in_link, at, n = 0, 0, 0, len(page)

    def flush():
        nonlocal linked
        if text:
            joined = _BLANK.sub(" ", markup.unescape("".join(text))).strip(" ")
            if joined:
                node = stack[-1][1]
                out.append((node, joined, node.apart, linked / len(joined)))
            text.clear()
        linked = 0

    def pop():
        flush()
        node = stack.pop()[1]
        tree = f"{node.sig}({','.join(node.kids)})" if node.kids else node.sig
        parent = node.parent
        if not parent.kids or parent.kids[-1] != tree:
            parent.kids.append(tree)
        node.place = len(parent.kids) - 1

    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            rest = _OPEN_END.sub("", page[at:])
            text.append(rest)
            break
        if m.start() > at:
            piece = page[at : m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        close, tag, raw = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag == "a":
                in_link = 0
            elif tag in ("br", "td", "th"):
                text.append(" ")
            elif tag == "p" and all(t != "p" for t, _ in stack):
                flush()
            elif tag not in INLINE and any(t == tag for t, _ in stack):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in RAW:
            if not raw.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = 1
            elif tag in ("br", "td", "th"):
                text.append(" ")
            continue
        flush()
        if tag in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    while len(stack) > i:
                        pop()
                    break
                if stack[i][0] in ("article", "section", "div", "main", "body", "li", "table"):
                    break
        if tag in ("li", "dt", "dd", "tr", "option") and stack[-1][0] == tag:
            pop()
        if tag in VOID:
            continue
        parent = stack[-1][1]
        sig, apart, region = _kind(tag, raw, parent)
        stack.append((tag, Node(sig, parent, apart or parent.apart, region or parent.region)))
    while len(stack) > 1:
        pop()
    flush()
    return ",".join(root.kids), out


def _candidates(found):
    """Blocks that may be content: inside the main regions if the page has any, else those that are not mostly links."""
    inside = [b for b in found if b[0].region and not b[2]]
    if inside or any(b[0].region for b in found):
        return inside
    return [b for b in found if not b[2] and b[3] < 0.6]


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def parse_tree(tree: str) -> tuple[list[str], list[list[int]], list[int]]:
    """Signatures, children and roots of a tree string, numbered in document order."""
    sigs, kids, roots, stack, last = [], [], [], [], -1
    for part in re.findall(r"[^(),]+|[()]", tree):
        if part == "(":
            stack.append(last)
        elif part == ")":
            stack.pop()
        else:
            sigs.append(part)
            kids.append([])
            last = len(sigs) - 1
            (kids[stack[-1]] if stack else roots).append(last)
    return sigs, kids, roots


def number(node: Node, kids: list[list[int]], roots: list[int]) -> int:
    """Number of a block's node in its parsed tree, -1 for text outside all elements."""
    path = []
    while node.parent is not None:
        path.append(node.place)
        node = node.parent
    at, level = -1, roots
    for place in reversed(path):
        at = level[place]
        level = kids[at]
    return at


def align(tree: str, reference: str) -> list[int]:
    """Simple tree matching: for each node of ``tree`` its partner in ``reference``, or -1."""
    a, b = parse_tree(tree), parse_tree(reference)
    if tree == reference:
        return list(range(len(a[0])))
    out = [-1] * len(a[0])
    known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def match(xs, ys, depth):
        """Weight of the best order-preserving pairing of two child lists, and its pairs."""
        w = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
        for i, x in enumerate(xs, 1):
            for j, y in enumerate(ys, 1):
                w[i][j] = max(w[i - 1][j], w[i][j - 1], w[i - 1][j - 1] + weight(x, y, depth))
        pairs, i, j = [], len(xs), len(ys)
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                pairs.append((xs[i - 1], ys[j - 1]))
                i, j = i - 1, j - 1
        return w[-1][-1], pairs

    def weight(x, y, depth):
        if a[0][x] != b[0][y] or depth > MAX_DEPTH:
            return 0
        if (x, y) not in known:
            n, pairs = match(a[1][x], b[1][y], depth + 1)
            known[x, y] = n + 1, pairs
        return known[x, y][0]

    todo = match(a[2], b[2], 0)[1]
    while todo:
        x, y = todo.pop()
        out[x] = y
        todo.extend(known[x, y][1] if (x, y) in known else [])
    return out


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


@F.pandas_udf(T.StringType())
def _hosts(urls: pd.Series) -> pd.Series:
    return urls.map(lambda x: _host(x if isinstance(x, str) else None)).astype(object)


def templates(pages: DataFrame) -> DataFrame:
    """host and hash of every text that is template there."""
    def trees(batches):
        for batch in pieces(batches, "html"):
            rows = {"host": [], "tree": [], "digest": [], "nodes": []}
            for url, page in zip(batch.column("url").to_pylist(), text_column(batch, "html").to_pylist()):
                tree, found = blocks(page)
                _, kids, roots = parse_tree(tree)
                nodes = sorted({(number(node, kids, roots), _hash(t)) for node, t, *_ in _candidates(found)})
                rows["host"].append(_host(url))
                rows["tree"].append(tree)
                rows["digest"].append(_hash(repr(nodes)))
                rows["nodes"].append([{"node": i, "text": h} for i, h in nodes])
            yield pa.RecordBatch.from_arrays([pa.array(rows["host"], pa.string()), pa.array(rows["tree"], pa.string()), pa.array(rows["digest"], pa.int64()),
                                              pa.array(rows["nodes"], pa.list_(pa.struct([("node", pa.int32()), ("text", pa.int64())])))], list(rows))

    seen = pages.select("url", "html").mapInArrow(trees, "host string, tree string, digest bigint, nodes array<struct<node:int,text:bigint>>")
    seen = saved(seen.dropDuplicates(["host", "digest"]))
    layouts = seen.groupBy("host", "tree").agg(F.count("*").alias("n"))
    hosts = layouts.groupBy("host").agg(F.max_by("tree", F.struct("n", "tree")).alias("reference"), F.sum("n").alias("n_pages")).where(F.col("n_pages") >= MIN_PAGES)

    def slots(batches):
        for batch in batches:
            got = [align(t, r) for t, r in zip(batch.column("tree").to_pylist(), batch.column("reference").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("tree"), batch.column("n"), batch.column("n_pages"), pa.array(got, pa.list_(pa.int32()))], ["host", "tree", "n", "n_pages", "slots"])

    aligned = attach(layouts, hosts, "host", "n_pages").where("reference is not null").select("host", "tree", "n", "n_pages", "reference").mapInArrow(slots, "host string, tree string, n bigint, n_pages bigint, slots array<int>")
    aligned = aligned.select(F.struct("host", "tree").alias("layout"), "n", "n_pages", "slots")
    met = attach(seen.select(F.struct("host", "tree").alias("layout"), F.explode("nodes").alias("x")).where("x.node >= 0"), aligned, "layout", "n").where("slots is not null")
    slot = met.select(F.col("layout.host").alias("host"), F.get("slots", F.col("x.node")).alias("slot"), F.col("x.text").alias("text"), "n_pages").where("slot >= 0")
    return slot.groupBy("host", "slot", "text").agg(F.count("*").alias("n"), F.max("n_pages").alias("n_pages")).where(F.col("n") >= CONSTANT * F.col("n_pages")).select("host", "text").distinct()


def _text(page: str, known) -> str:
    content = [b[1] for b in _candidates(blocks(page)[1])]
    if known:
        content = [t for t in content if _hash(t) not in known] or content
    return "\n\n".join(content)


def extract(pages: DataFrame, set_bytes: int = SET_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    known = saved(templates(pages))
    size = known.select(F.sum(F.length("host") + 80)).first()[0] or 0
    if size <= set_bytes:
        by_host: dict[str, set[int]] = {}
        for r in known.toLocalIterator():
            by_host.setdefault(r.host, set()).add(r.text)
        shared = pages.sparkSession.sparkContext.broadcast(by_host)
        rows = pages.select("page_id", "url", "html", F.lit(None).cast("array<bigint>").alias("__known"))
    else:
        shared = None
        rows = pages.select("page_id", "url", "html").withColumn("__host", _hosts("url"))
        lists = known.groupBy("host").agg(F.collect_list("text").alias("__known"), F.count("*").alias("n")).withColumnRenamed("host", "__host")
        rows = attach(rows, lists, "__host", "n").select("page_id", "url", "html", "__known")

    def run(batches):
        for batch in pieces(batches, "html"):
            urls, own = batch.column("url").to_pylist(), batch.column("__known").to_pylist()
            texts = [_text(page, shared.value.get(_host(url)) if shared else frozenset(k or ())) for url, page, k in zip(urls, text_column(batch, "html").to_pylist(), own)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return rows.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
