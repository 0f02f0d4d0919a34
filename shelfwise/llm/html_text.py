"""Main text of web pages by composite text density (operator 5).

A page becomes a tree of elements (unclosed and misplaced tags are repaired as browsers would). For every node,

    density = chars / tags * log(chars / (chars outside links) * (chars in links) + share of links in the body * chars + e)
                             of the base (chars in links / chars) * (tags / links)

with zeros taken as one: text per tag, adjusted for links. A node's sum is that of its block children's densities; the
node with the largest sum is found to be content. The article is what holds it (`whole`): its nearest article or main
element, else its highest ancestor of which no other child is mostly links; all of the article stays. The lowest density on
the path from the body to the found node is a threshold, and blocks beside the path to the article which reach it belong to
the content too, as do paragraphs, bare text and inline elements beside that path that aren't mostly links, and the heading
before it. What is a menu, header, footer, sidebar, notice, advert,
form, script, style or comment section by its element, role, class or id is taken out beforehand, wherever it lies; a class
or id must name the element itself (`names_noise`), and what is so named still stays if it wraps the page's main part (`spare`).

Text comes block by block in page order, with white space (and <br>) as one space within a block, trimmed, joined by two
line feeds; preformatted text is treated likewise. Nothing else is dropped or cut.

Defined cases: a null or empty html, or one without text outside the taken-out parts, gives an empty text; text without
any tags is one block; long pages are handled whole; rows that repeat get equal results; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content, with raw content, that are blocks, and that their own kind closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
#: What is never main text: elements, roles, and names of classes and ids.
NOISE = frozenset("nav aside footer form script style template noscript iframe object embed svg canvas button input select textarea dialog menu head title link meta audio video map search xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist".split())
WORDS = frozenset(
    "ad ads adbox advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus discussion footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices notification popup promo promotion related recommended respond replies reply share sharing sidebar skip social sponsor sponsored subscribe subscription toolbar topbar widget alert".split()
)
#: Words that may stand beside these in a name without changing what it names.
BESIDE = frozenset(
    "area bar bottom box block center column container desktop fixed floating global group icons inner item left left links list main mobile outer page posts primary right row secondary section signup site slot sticky top unit widgets wrap wrapper zone buttons side large small".split()
)
#: Words that name an element whatever comes before them, unless that says what it has or lacks.
HEADS = frozenset("ad ads advert advertisement breadcrumb breadcrumbs comments disqus footer nav navbar navigation newsletter sidebar".split())
HAS = frozenset("has with no without is show hide hides not".split())
_RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_STOP = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_TOKENS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


def names_noise(name: str) -> bool:
    """Whether a class or id names what is never main text, as itself and not as a part of something else (`has-sidebar`, `notice-period`)."""
    parts = _TOKENS.findall(_CAMEL.sub(" ", name).lower())
    if not parts or WORDS.isdisjoint(parts):
        return False
    return all(p in WORDS or p in BESIDE for p in parts) or parts[-1] in HEADS and HAS.isdisjoint(parts)


def tags_of(html: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, closing, attributes) of each tag in order; comments and declarations have no name. In time proportional to the page.

    A tag ends at the first > outside quotes. Where quotes don't close, they count no more from there on, and what begins
    like a tag but has no > after it is text.
    """
    at, last, quotes = html.find("<"), html.rfind(">"), True
    while 0 <= at:
        end = 0
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            end = stop + 3 if stop >= 0 else len(html)
            yield at, end, "", False, ""
        elif at > last:
            return
        elif html[at + 1 : at + 2] in ("!", "?"):
            end = html.find(">", at) + 1
            yield at, end, "", False, ""
        else:
            closing = html[at + 1 : at + 2] == "/"
            m = _NAME.match(html, at + 1 + closing)
            if m:
                k = m.end()
                while quotes:
                    stop = _STOP.search(html, k)
                    if not stop:
                        quotes = False
                    elif stop[0] == ">":
                        end = stop.end()
                        break
                    elif (k := html.find(stop[0], stop.end()) + 1) == 0:
                        quotes = False
                end = end or html.find(">", m.end()) + 1
                yield at, end, m[0].lower(), closing, html[m.end() : end - 1]
        at = html.find("<", max(end, at + 1))


class Node:
    __slots__ = ("tag", "parent", "content", "noise", "inside", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.content, self.noise = tag, parent, [], 0
        #: whether it lies in an article or main
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


#: How an element is noise: by its element, role or hiding, or only by a word in its class or id.
SURE, NAMED = 2, 1


def is_noise(tag: str, attributes: str, parent: Node) -> int:
    if tag in NOISE:
        return SURE
    if tag == "header":  # an article's own header has its heading
        return 0 if parent.inside or parent.tag in ("article", "main") else SURE
    if not attributes or tag in ("html", "body", "article", "main"):
        return 0
    named = 0
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if name == "role" and value.lower().strip() in ROLES:
            return SURE
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return SURE
        if name in ("class", "id") and (tag in BLOCK or tag not in ("a", "b", "i", "em", "strong", "span")) and any(map(names_noise, value.split())):
            named = NAMED
    return named


def path(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def parse(html: str) -> Node:
    """The tree of what isn't noise: a node's content is strings and nodes in order."""
    root = tree(html)
    prune(root)
    return root


def prune(root: Node) -> None:
    """Takes noise out; what is a block leaves a rule, as it still parts the text around it."""
    spare(root)
    for n in in_order(root):
        if any(isinstance(c, Node) and c.noise for c in n.content):
            n.content = [c if isinstance(c, str) or not c.noise else Node("hr", n) for c in n.content if isinstance(c, str) or not c.noise or c.tag in BLOCK]


def spare(root: Node) -> None:
    """What is noise only by its name stays if it wraps the page's main part.

    That is so if it holds a main, article or h1 and there is none beside noise, or if most of the text outside links is
    in it and there is no main or article beside noise. What such a wrapper holds is judged alike, by what lies in it.
    """
    order = in_order(root)
    if not any(n.noise == NAMED for n in order):
        return
    holds: dict[int, set[str]] = {}
    chars: dict[int, int] = {}
    for n in reversed(order):
        kids = [c for c in n.content if isinstance(c, Node) and c.noise != SURE]
        holds[id(n)] = {n.tag} & {"main", "article", "h1"} | set().union(*(holds[id(c)] for c in kids))
        chars[id(n)] = 0 if n.tag == "a" else sum(len("".join(c.split())) for c in n.content if isinstance(c, str)) + sum(chars[id(c)] for c in kids)
    scopes = [root]
    while scopes:
        scope = scopes.pop()
        free, named = set(), []
        stack = [c for c in scope.content if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.noise == NAMED:
                named.append(n)
            elif not n.noise:
                free |= {n.tag} & {"main", "article", "h1"}
                stack += [c for c in n.content if isinstance(c, Node)]
        for n in named:
            if holds[id(n)] and not free or 2 * chars[id(n)] > chars[id(root)] and not free & {"main", "article"}:
                n.noise = 0
                scopes.append(n)


def tree(html: str) -> Node:
    """The tree of all elements, in which what is noise is marked; noise ends where any element would."""
    root = now = Node("body", None)
    at = 0
    opened: Counter[str] = Counter()  # elements open at this point, by tag

    def leave(upto: Node) -> None:
        """Closes all open elements inside `upto`, and itself."""
        nonlocal now
        while now is not upto:
            opened[now.tag] -= 1
            now = now.parent
        opened[now.tag] -= 1
        now = now.parent

    def close(tags: set[str], until: set[str]) -> None:
        """Closes open elements up to the outermost of `tags`, but none beyond an element of `until`."""
        n, found, left = now, None, sum(opened[t] for t in tags)
        while left and n is not root and n.tag not in until and not (n.noise and (n.tag in NOISE or n.tag not in BLOCK)):
            if n.tag in tags:
                found, left = n, left - 1
            n = n.parent
        if found:
            leave(found)

    for start, end, tag, closing, attributes in tags_of(html):
        if start < at:  # within an element of raw text
            continue
        if start > at:
            text = html[at:start]
            now.content.append(entities.unescape(text) if "&" in text else text)
        at = end
        if not tag:
            continue
        if closing:
            n = now if opened[tag] else root
            while n is not root and n.tag != tag and not (n.tag in BLOCK and tag not in BLOCK and tag not in NOISE):
                n = n.parent
            if n is not root and n.tag == tag:
                leave(n)
            continue
        if tag in ("html", "body"):
            continue
        if tag in BLOCK and tag not in ("option", "select"):
            close({"p"}, {"td", "th", "table", "li", "blockquote", "div", "section", "article", "main", "dd", "figure"})
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in RAW:
            stop = _RAW_END[tag].search(html, at)
            at = html.find(">", stop.start()) + 1 or len(html) if stop else len(html)
            continue
        if tag in VOID:
            if tag == "br":
                now.content.append(" ")
            elif tag == "hr":
                now.content.append(Node("hr", now))
            continue
        child = Node(tag, now)
        child.noise = is_noise(tag, attributes, now)
        now.content.append(child)
        if not attributes.endswith("/") or tag in BLOCK and not child.noise:
            now = child
            opened[tag] += 1
    if at < len(html):
        now.content.append(entities.unescape(html[at:]))
    return root


def in_order(root: Node) -> list[Node]:
    """Parents before children."""
    out, stack = [], [root]
    while stack:
        n = stack.pop()
        out.append(n)
        stack += [c for c in reversed(n.content) if isinstance(c, Node)]
    return out


def weigh(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        own = sum(len(" ".join(c.split())) for c in n.content if isinstance(c, str))
        kids = [c for c in n.content if isinstance(c, Node)]
        n.chars = own + sum(k.chars for k in kids)
        n.tags = sum(k.tags + 1 for k in kids)
        n.link_chars = n.chars if n.tag == "a" else sum(k.link_chars for k in kids)
        n.links = sum(k.links + (k.tag == "a") for k in kids)
    body = nodes[0]
    share = body.link_chars / max(body.chars, 1)
    for n in nodes:
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.link_chars, 1), max(n.links, 1)
        if not c:
            n.density = 0.0
            continue
        base = math.log(max(c, 1) / max(c - n.link_chars, 1) * n.link_chars + share * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0000001)) / base
    for n in nodes:
        n.total = sum(k.density for k in n.content if isinstance(k, Node) and k.tag in BLOCK)


def whole(found: Node) -> Node:
    """The article around a node: its nearest article or main element, else its highest ancestor, below the body, beside whose way to the node nothing is mostly links."""
    n = found
    while n.parent is not None:
        if n.tag in ("article", "main"):
            return n
        n = n.parent
    n = found
    while n.parent is not None and n.parent.parent is not None:
        beside = [k for k in n.parent.content if isinstance(k, Node) and k is not n and k.chars]
        if any(2 * k.link_chars > k.chars for k in beside):
            break
        n = n.parent
    return n


def content(root: Node) -> list[Node]:
    """The parts of the tree that are main text, in page order."""
    nodes = in_order(root)
    weigh(nodes)
    blocks = [n for n in nodes if n.tag in BLOCK]
    best = max(blocks, key=lambda n: n.total)
    if best.total <= 0:
        return [root]
    least = min(n.density for n in path(best))
    best = whole(best)
    way = list(path(best))[::-1]
    out: list[Node] = []
    after: list[list[Node]] = []
    for n, down in zip(way, way[1:]):
        kids = [k for k in n.content if isinstance(k, Node)]
        at = next(i for i, k in enumerate(kids) if k is down)
        taken = {id(k) for k in kids if k.tag in BLOCK and (k.density >= least or k.tag == "p") and k.chars > 0 and k.link_chars < k.chars / 2}
        if at and re.fullmatch("h[1-6]|header|hgroup", kids[at - 1].tag):
            taken.add(id(kids[at - 1]))
        sides: tuple[list[Node], list[Node]] = [], []
        run: list[str | Node] = []
        passed = 0
        for k in [*n.content, None]:
            if isinstance(k, str) or k is not None and k is not down and k.tag not in BLOCK:
                run.append(k)
                continue
            if inline := inline_text(run, n):
                sides[passed].append(inline)
            run = []
            if k is down:
                passed = 1
            elif k is not None and id(k) in taken:
                sides[passed].append(k)
        out += sides[0]
        after.append(sides[1])
    return [*out, best, *(k for side in reversed(after) for k in side)]


def inline_text(run: list[str | Node], parent: Node) -> Node | None:
    """Bare text and inline elements between blocks, as one part, unless it is empty or half of it or more is links."""
    text = sum(len(" ".join(k.split())) if isinstance(k, str) else k.chars for k in run)
    if not text or 2 * sum(k.link_chars for k in run if isinstance(k, Node)) >= text:
        return None
    part = Node("span", parent)
    part.content = run
    return part


def blocks_of(parts: list[Node]) -> list[str]:
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(run).split()):
            out.append(text)
        run.clear()

    for part in parts:
        flush()
        stack: list = [part]
        while stack:
            n = stack.pop()
            if n is None:
                flush()
            elif isinstance(n, str):
                run.append(n)
            else:
                block = n.tag in BLOCK
                if block:
                    flush()
                    stack.append(None)
                stack += reversed(n.content)
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    root = parse(html)
    return "\n\n".join(blocks_of(content(root)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row page_id, url, text and n_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x) for x in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    plain = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return plain.mapInArrow(run, "page_id long, url string, text string, n_chars long")
