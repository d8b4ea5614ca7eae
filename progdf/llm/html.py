"""Main text of web pages by composite text density.

A node's composite density is its characters per tag, adjusted by the share of link characters and link tags. The node whose
children's densities have the greatest sum is the core of the article; the least density on its path to the body is the
threshold by which its neighbours on that path join it.

Marks enter the counts. What marks itself as a menu, header, footer, sidebar, notice, advert, form or comment section, and what
stands outside article and main where these have half of the text, counts as link text: all of it, or the first HINT characters where the
mark is only part of a longer name (a comment-guide is a guide). What is mostly such text joins only with a density above the threshold,
so the density of a long text overcomes a hint. A mark means nothing on what holds the longest article, or nearly all of the text.
Pages are cut into tags and nested in time linear in their length.
"""

from __future__ import annotations

import heapq
import html
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_rows, fresh, slices, table, tidy

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4
    h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split())
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead tr".split()) | frozenset(["plaintext"])
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opened element ends the nearest open ones of the first set that no element of the second set holds.
SCOPE = frozenset("td th table caption button object template".split())
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
    "a": ({"a"}, SCOPE),
}

#: Elements without text of the page, elements that are no part of an article, and words in a class, id or role that tell the same.
NEVER = frozenset("script style noscript template head title button select textarea input iframe object embed svg canvas".split())
ASIDE = frozenset("nav aside footer".split())
DOUBTFUL = frozenset("form dialog menu header".split())
NAMED = frozenset("""ad ads adbox adslot advert adverts advertisement advertising adsense sponsor sponsored promo promos promotion nav navbar navigation navmenu menu menubar
    breadcrumb breadcrumbs sidebar sidebars aside footer masthead banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe
    subscription signup login comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations pagination pager
    toolbar widget widgets complementary contentinfo search skip""".split())
#: Words in a class that tell of something else: a page that has a sidebar is none.
OTHERS = frozenset("has with no without is not js".split())

#: Words for any part of a page: they say no more about it than the mark beside them.
NEUTRAL = frozenset("area bar block body box button buttons col column container content form group header holder inner item items link links list main module outer panel row section slot text thread title top unit wrap wrapper zone".split())
#: Characters of a hint that count as link text.
HINT = 200

ATTRIBUTE = re.compile(r"(?:^|[\s\"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?(?=[\s/\"']|$)", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile("[>\"']")
COMMENT_END = re.compile("--!?>")
RAW_END = {x: re.compile(rf"</{x}(?=[\s/>]|\Z)[^>]*>?", re.I) for x in RAW}


class Node:
    __slots__ = ("name", "parts", "parent", "never", "mark", "foreign", "role", "plain", "chars", "tags", "link_chars", "link_tags", "density", "total", "counted")

    def __init__(self, name: str, parent: Node | None, mark: int = 0):
        self.name, self.parent, self.parts, self.mark = name, parent, [], mark
        # role: article within one, around where one is held, else None
        self.never, self.foreign, self.role = name in NEVER, False, None


def _marked(name: str, attributes: str) -> int:
    """Does an element's name or class tell that it is no part of an article? 2: it does, 1: a part of a longer name hints at it."""
    if name in ASIDE or name in DOUBTFUL:
        return 2
    if not attributes or name not in BLOCK or name in ("article", "main", "body", "html"):
        return 0
    found = 0
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "").lower()):
            return 2
        if key in ("class", "id", "role"):
            for token in value.split():
                words = [w for w in re.split(r"[^a-z0-9]+", CAMEL.sub("-", token).lower()) if w]
                if words and (words[0] in NAMED or words[-1] in NAMED) and OTHERS.isdisjoint(words):
                    last = words[-1].rstrip("0123456789")
                    found = max(found, 2 if not last or last in NAMED or last in NEUTRAL else 1)
    return found


def _tag_end(page: str, at: int) -> int:
    """Where the tag's > stands, which is not within a quoted value; -1 if the page ends before."""
    while m := STOP.search(page, at):
        if m[0] == ">":
            return m.start()
        before = m.start() - 1
        while before > at and page[before].isspace():
            before -= 1
        at = m.end()
        if page[before] == "=":  # elsewhere a quote is a letter like any other
            at = page.find(m[0], at) + 1
            if not at:
                return -1
    return -1


class _Open:
    """The open elements, and of each name where they stand."""

    def __init__(self, root: Node):
        self.nodes, self.places = [root], {}

    def top(self) -> Node:
        return self.nodes[-1]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.nodes))
        self.nodes.append(node)

    def close(self, place: int) -> None:
        while len(self.nodes) > place:
            self.places[self.nodes.pop().name].pop()

    def nearest(self, names) -> int:
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def end(self, names, within) -> None:
        """Close the nearest open elements of these names, unless one of `within` holds the current element nearer."""
        least = self.nearest(within)
        found = [x[-1] for n in names if (x := self.places.get(n)) and x[-1] > least]
        if found:
            self.close(min(found))


def parse(page: str) -> Node:
    """The page's tree. Elements left open end with the page, a tag cut off at its end is dropped."""
    root = Node("html", None)
    open_ = _Open(root)
    at, size = 0, len(page)

    def text(a: int, b: int) -> None:
        if b > a:
            open_.top().parts.append(html.unescape(page[a:b]) if "&" in page[a:b] else page[a:b])

    begin = 0
    while (lt := page.find("<", at)) >= 0:
        after = page[lt + 1 : lt + 2]
        if after == "!" and page.startswith("--", lt + 2):
            text(begin, lt)
            short = 5 if page.startswith(">", lt + 4) else 6 if page.startswith("->", lt + 4) else 0
            end = None if short else COMMENT_END.search(page, lt + 4)
            at = begin = lt + short if short else end.end() if end else size
            continue
        closing = after == "/"
        m = NAME.match(page, lt + 1 + closing)
        if m is None:
            if after and after in "!?/":  # a declaration, or an end tag without a name
                text(begin, lt)
                at = begin = page.find(">", lt) + 1 or size
            elif not after:  # a tag cut off after its first letter
                text(begin, lt)
                begin = size
                break
            else:
                at = lt + 1
            continue
        text(begin, lt)
        end = _tag_end(page, m.end())
        at = begin = end + 1 or size
        if end < 0:
            break
        name = m[0].lower()
        if closing:
            place = open_.places.get(name)
            if place:
                open_.close(place[-1])
            continue
        if name in ("html", "body"):
            if name == "body" and len(open_.nodes) == 1:
                body = Node("body", root)
                root.parts.append(body)
                open_.push(body)
            continue
        if name in CLOSES_P:
            open_.end(("p",), SCOPE)
            if name in HEADING and open_.top().name in HEADING:
                open_.close(len(open_.nodes) - 1)
        elif name in ENDS:
            open_.end(*ENDS[name])
        node = Node(name, open_.top(), _marked(name, page[m.end() : end]))
        node.parent.parts.append(node)
        if name in RAW:
            end = RAW_END[name].search(page, at)
            raw = page[at : end.start() if end else size]
            node.parts.append(html.unescape(raw) if name in ("title", "textarea") else raw)
            at = begin = end.end() if end else size
        elif name not in VOID:
            open_.push(node)
    text(begin, size)
    return root


def _nodes(root: Node) -> list[Node]:
    """Nodes in page order, without those that never have text."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if not n.never:
            found.append(n)
            todo += [p for p in reversed(n.parts) if not isinstance(p, str)]
    return found


def _children(n: Node):
    return (c for c in n.parts if not isinstance(c, str) and not c.never)


def set_foreign(nodes: list[Node]) -> None:
    """Decides what is foreign to an article: marked elements and, where articles have half of the other text, all outside them.

    But for nav, aside and footer, a mark is void on an element that holds the longest article or main of the page, and on one
    such that less than a twentieth of its own text stands outside all marked elements.
    """
    for n in reversed(nodes):
        n.chars = sum(len(" ".join(p.split())) for p in n.parts if isinstance(p, str)) + sum(c.chars for c in _children(n))
    articles, todo = [], [(nodes[0], False)]
    while todo:
        n, beside = todo.pop()
        if n.name in ("article", "main"):
            articles.append((n.chars, -len(articles), n, beside))
        else:
            todo += [(c, beside or c.name in ASIDE) for c in reversed(list(_children(n)))]
    for *_, top, _ in articles:  # a header within an article is a part of it
        for n in _nodes(top):
            n.mark = n.mark if n.name != "header" else 0
    up = max((x for x in articles if not x[3]), default=(0, 0, nodes[0], False), key=lambda x: x[:2])[2]
    while up is not None:
        up.mark, up = up.mark if up.name in ASIDE else 0, up.parent
    for n in reversed(nodes):
        n.plain = n.chars - sum(c.chars if c.mark else c.chars - c.plain for c in _children(n))
    outside = nodes[0].plain

    def marked(top: Node):
        """The outermost marked elements below top whose mark may be void."""
        todo = [top]
        while todo:
            for c in _children(todo.pop()):
                if not c.mark:
                    todo.append(c)
                elif c.name not in ASIDE:
                    yield c

    heap = [(-n.chars, k, n) for k, n in enumerate(marked(nodes[0]))]
    heapq.heapify(heap)
    count = len(heap)
    while heap and outside * 20 < -heap[0][0]:
        n = heapq.heappop(heap)[2]
        n.mark = 0
        outside += n.plain
        for c in marked(n):
            count += 1
            heapq.heappush(heap, (-c.chars, count, c))
    inside, todo = [], [nodes[0]]
    while todo:
        n = todo.pop()
        if n.name in ("article", "main"):
            inside.append(n)
        else:
            todo += [c for c in _children(n) if not c.mark]
    apart = bool(inside) and 2 * sum(n.plain for n in inside) >= outside
    for n in inside if apart else ():
        n.role = "article"
        up = n.parent
        while up is not None and up.role is None:
            up.role, up = "around", up.parent
    for n in nodes:
        up = n.parent
        if up is not None and up.role == "article":
            n.role = "article"
        n.foreign = n.mark == 2 or (up is not None and up.foreign) or (apart and n.role is None and not n.mark)


def measure(root: Node) -> list[Node]:
    """Counts characters and tags of every node and sets its composite density and its children's sum."""
    nodes = _nodes(root)
    set_foreign(nodes)
    for n in reversed(nodes):
        n.tags = n.link_chars = n.link_tags = 0
        for c in _children(n):
            n.tags += c.tags + 1
            n.link_chars += c.link_chars
            n.link_tags += c.link_tags + (c.name == "a" or c.foreign)
        n.counted = sum(c.counted for c in _children(n))
        if n.foreign:
            n.link_chars, n.link_tags, n.counted = n.chars, n.tags, n.chars
        elif n.mark:
            n.counted = max(n.counted, min(n.chars, HINT))
            n.link_chars = max(n.link_chars, n.counted)
        elif n.name == "a":
            n.link_chars = n.chars
        elif n.role == "around":
            n.link_chars += sum(len(" ".join(p.split())) for p in n.parts if isinstance(p, str))
    body = nodes[0]
    share = body.link_chars / max(1, body.chars)

    def density(c: int, tags: int, link_chars: int, link_tags: int) -> float:
        if c <= link_chars:
            return 0.0
        t, lc, lt = max(1, tags), max(1, link_chars), max(1, link_tags)
        base = math.log(c / (c - link_chars) * link_chars + share * c + math.e)
        return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(base + 1))

    for n in reversed(nodes):
        n.density = 0.0 if n.foreign else density(n.chars, n.tags, n.link_chars, n.link_tags)
        own = 0 if n.foreign or n.role == "around" or n.name == "a" else sum(density(len(" ".join(p.split())), 0, 0, 0) for p in n.parts if isinstance(p, str))
        n.total = own + sum(c.density for c in _children(n))
    return nodes


def main_node(nodes: list[Node]) -> tuple[Node, float]:
    """The node with the greatest sum of its children's densities, text within it being a child, and the least density of its path to the body."""
    best = max(nodes, key=lambda n: n.total)
    if best.total <= 0:
        return nodes[0], 0.0
    up, low = best, best.density
    while up is not None:
        low = min(low, up.density)
        up = up.parent
    return best, low


def _linked(n: Node) -> bool:
    return n.chars > 0 and 2 * n.link_chars > n.chars


def _below(n: Node, low: float) -> bool:
    """Is a part of an article left out? By its density: mostly link text by marks, or a list of nothing but links."""
    if n.name in BLOCK and 2 * n.counted > n.chars:
        return n.density <= low
    return n.name in ("ul", "ol", "div") and n.link_tags > 1 and n.link_chars == n.chars and n.density < low


def _blocks(roots: list, best: Node, low: float) -> list[str]:
    """The text of the roots' blocks, without what lies below the threshold."""
    blocks, now = [], []

    def end() -> None:
        line = " ".join("".join(now).split())
        if line:
            blocks.append(line)
        now.clear()

    # an entry is text, a node, a list of entries, or None where a block ends
    todo = list(reversed(roots))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            now.append(x)
        elif isinstance(x, list):
            todo += reversed(x)
        elif x.never or (x is not best and _below(x, low)):
            continue
        elif x.name == "br":
            now.append(" ")
        else:
            if x.name in BLOCK:
                end()
                todo.append(None)
            todo += [p for p in reversed(x.parts) if x.role != "around" or not isinstance(p, str)]
    end()
    return blocks


def main_text(page: str | None) -> str:
    """The main text of a page: blocks in page order, one a line; empty for a null or empty page or one without text."""
    if not page:
        return ""
    nodes = measure(parse(page))
    if not nodes[0].chars:
        return ""
    best, low = main_node(nodes)
    kept, up = [best], best
    while up.parent is not None:
        parent = up.parent
        # beside nothing but text, all joins; elsewhere what reaches the threshold, and headings of what follows them
        clean = not any(_linked(c) for c in _children(parent))
        here, before = [], True
        for p in parent.parts:
            if p is up:
                here.append(kept)
                before = False
            elif isinstance(p, str):
                here += [p] * (parent.role != "around")
            elif not p.never and (clean or (not _linked(p) and (p.density >= low or (before and p.name in HEADING) or not p.chars))):
                here.append(p)
        # a block of its own stays one
        kept, up = [None, *here, None] if parent.name in BLOCK else here, parent
    return "\n".join(_blocks(kept, best, low))


def main_texts(df: DataFrame, column: str = "html") -> DataFrame:
    """Every row of df with text and n_chars (code points), of the page in `column`.

    Other columns pass through, whatever their names; columns named text and n_chars are replaced, unless one is `column`, which then
    holds the page no more. Null, empty and broken pages give what text they have, '' at least; repeated rows stay.
    """
    kept = [c for c in df.columns if c.lower() not in ("text", "n_chars")]
    own = fresh(df, "page")
    rows = df.select(df[column].cast("string").alias(f"{own}html"), *kept)
    arrow_rows(df.sparkSession)
    schema = StructType([*rows.schema.fields[1:], StructField("text", StringType()), StructField("n_chars", LongType())])
    names = schema.names

    def run(batches):
        for batch in batches:
            for a, b in slices(batch.column(0)):
                texts = [main_text(x) for x in batch.column(0).slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[1:], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names)

    return rows.mapInArrow(tidy(run), schema)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return main_texts(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


__all__ = ["main_text", "main_texts", "op7_main_text"]
