"""Main-text extraction by minimum cut.

A page becomes a row of text blocks.  A linear classifier turns what a block
looks like (its containers' tags and names, its links, length and punctuation)
into the costs of calling it content or boilerplate; these are the capacities to
the two terminals.  Blocks that follow each other, and blocks in the same
container, are joined by smoothness edges.  The minimum cut (max-flow) is the
cheapest labelling; the blocks on the source side, in page order and joined by an empty
line, are the text.

White space inside a block becomes one space; ``br`` separates words only.
Character references are decoded; markup, scripts, styles, templates and
comments never become text.

Edge cases: null or empty html, or one without content, gives an empty text and
0 characters; unclosed or stray tags are tolerated; whole pages are read whatever
their length; extra columns are ignored; repeated rows give repeated results.
"""

from __future__ import annotations

import html as entities
import re
from collections import deque
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import map_batches

# HTML elements by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol option p pre section select summary table tbody td tfoot th thead "
    "title tr ul button textarea label legend".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TAGS = frozenset("head script style noscript template svg iframe object canvas audio video title".split())
RAW_TAGS = frozenset("script style textarea title".split())
# An open element that the start of one of the others ends.
CLOSED_BY = {
    "p": BLOCK_TAGS - {"option", "button", "label", "legend", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "html", "body"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "td": frozenset({"td", "th", "tr"}), "th": frozenset({"td", "th", "tr"}), "tr": frozenset({"tr"}), "option": frozenset({"option"}),
}
# Costs, in thousandths, of containers: positive speaks for content.
TAG_WEIGHT = {
    "article": 5000, "main": 4000, "p": 900, "h1": 1200, "h2": 600, "h3": 400, "blockquote": 500, "pre": 500, "section": 300, "td": 200, "figcaption": 300,
    "nav": -9000, "footer": -9000, "header": -2500, "aside": -9000, "form": -9000, "menu": -9000, "button": -9000, "select": -9000, "dialog": -9000,
    "option": -9000, "textarea": -9000, "label": -4000, "fieldset": -6000, "address": -1500, "li": -300, "details": -500,
}
GOOD_NAMES = re.compile(r"article|content|entry|post-?body|story|main|text|prose", re.I)
BAD_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|menu|nav\w*|breadcrumbs?|side-?bar|widget|foot(?:er)?|masthead|head(?:er)?|cookies?|consent|gdpr|notice|"
    r"alert|pop-?up|modal|overlay|subscribe|newsletter|sign-?up|log-?in|comments?|comment-?\w+|repl(?:y|ies)|disqus|respond|related|recommend\w*|share|sharing|social|"
    r"tags?|pagination|pager|toolbar|search|copyright|legal|disclaimer|author-?bio|skip)(?:$|[^a-z])",
    re.I,
)
# What a name says of another element or of the topic, not of its own: no-sidebar, tag-news, layout--menu.
STATE = re.compile(r"(?:(?:^|[-_])(?:no|not|has|have|with|without)[-_]|--).*$", re.I | re.S)
TOPIC = re.compile(r"(?:type|format|status|category|cat|tag|term|tax|topic)[-_](?!(?:cloud|links?|lists?|box|bar)$)", re.I)
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
NAME_GOOD, NAME_BAD = 1500, -9000
CHAIN, SIBLING = 700, 1100  # smoothness: neighbours in the page, neighbours in a container

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW_TAGS}


class Block:
    """A block of text: its open containers, its own pieces and those inside links."""

    __slots__ = ("owner", "score", "hidden", "named", "parts", "linked")

    def __init__(self, owner: int, score: int, hidden: bool, named: int) -> None:
        self.owner, self.score, self.hidden, self.named = owner, score, hidden, named
        self.parts: list[str] = []
        self.linked = 0


@lru_cache(10_000)
def _names(value: str) -> tuple[bool, bool]:
    """Whether a class or id holds a good name, and a bad one; each name is judged by itself."""
    good = bad = False
    for name in value.split():
        if TOPIC.match(name):
            continue
        name = STATE.sub("", name)
        if BAD_NAMES.search(name):
            bad = True
        elif GOOD_NAMES.search(name):
            good = True
    return good, bad


def _container(tag: str, attrs: str) -> tuple[int, bool, int, bool]:
    """Weight of an element without its bad names, whether it is hidden, the weight of its
    bad names, and whether it speaks for content around it."""
    weight, hidden, against = TAG_WEIGHT.get(tag, 0), tag in HIDDEN_TAGS, 0
    speaks = tag in ("main", "article", "h1")
    if attrs and tag not in ("html", "body"):
        for m in _ATTR.finditer(attrs):
            name, value = m[1].lower(), (m[2] or "").strip("\"'")
            if name in ("class", "id"):
                good, bad = _names(value)
                against += NAME_BAD * bad
                weight += NAME_GOOD * good
                speaks |= good
            elif name == "role":
                weight += NAME_BAD if value.lower() in BAD_ROLES else TAG_WEIGHT["article"] if value.lower() in ("main", "article") else 0
                speaks |= value.lower() in ("main", "article")
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                hidden = True
    return weight, hidden, against, speaks


def _weigh_names(found: list[Block], names: list[list]) -> None:
    """Add the weight of bad names to the blocks inside.  A container that holds more than half
    of the page's text outside links, and a heading or container that speaks for content (or is
    one), is no boilerplate whatever its name.  ``names``: outer one, weight, whether it speaks."""
    mass = [0] * len(names)
    for b in found:
        mass[b.named] += max(0, sum(map(len, b.parts)) - b.linked)
    every = sum(mass)
    for i in range(len(names) - 1, 0, -1):
        outer, _, speaks = names[i]
        mass[outer] += mass[i]
        names[outer][2] |= speaks
    total = [0] * len(names)
    for i in range(1, len(names)):
        outer, weight, speaks = names[i]
        total[i] = total[outer] + (0 if speaks and 2 * mass[i] > every else weight)
    for b in found:
        b.score += total[b.named]


def blocks(source: str) -> list[Block]:
    """The text blocks of a page in order, without those that never show."""
    out: list[Block] = []
    # open elements: tag, number of the nearest block container, summed weight, hidden, in a link,
    # number of the nearest container with a bad name
    stack: list[tuple[str, int, int, bool, bool, int]] = [("", 0, 0, False, False, 0)]
    names: list[list] = [[0, 0, False]]
    made, current = 0, None
    at, end = 0, len(source)

    def text(piece: str) -> None:
        nonlocal current
        _, owner, score, hidden, link, named = stack[-1]
        if current is None:
            if piece.isspace():
                return
            current = Block(owner, score, hidden, named)
            out.append(current)
        current.parts.append(piece)
        if link:
            current.linked += len(piece)

    while at < end:
        low = source.find("<", at)
        if low < 0:
            text(source[at:])
            break
        if low > at:
            text(source[at:low])
        m = _TOKEN.match(source, low)
        if not m:  # a bare "<" is text
            text("<")
            at = low + 1
            continue
        at = m.end()
        tag = m[2] and m[2].lower()
        if not tag:
            continue
        if m[1]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            # an inline end tag does not close the blocks that were opened inside it
            if k and (tag in BLOCK_TAGS or tag in HIDDEN_TAGS or all(x[0] not in BLOCK_TAGS for x in stack[k + 1 :])):
                del stack[k:]
            if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
                current = None
            continue
        if tag == "br":
            text(" ")
            continue
        if tag in BLOCK_TAGS or tag in HIDDEN_TAGS:
            current = None
            for k in range(len(stack) - 1, 0, -1):
                if tag in CLOSED_BY.get(stack[k][0], ()):
                    del stack[k:]
                    break
                if stack[k][0] in ("table", "ul", "ol", "div", "article", "section", "main", "aside", "nav", "form", "body"):
                    break
        if tag in VOID_TAGS:
            continue
        if m[3].endswith("/") and tag not in BLOCK_TAGS and (tag == "svg" or tag not in HIDDEN_TAGS):
            continue  # scripts and the like stay open: there a slash means nothing
        weight, hidden, against, speaks = _container(tag, m[3])
        _, owner, score, was, link, named = stack[-1]
        if tag in BLOCK_TAGS:
            made += 1
            owner = made if tag not in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dd", "dt") else owner
        if tag in RAW_TAGS:
            close = _RAW_END[tag].search(source, at)
            at = close.end() if close else end
            continue
        if against:
            names.append([named, against, speaks])
            named = len(names) - 1
        elif speaks:
            names[named][2] = True
        stack.append((tag, owner, score + weight, was or hidden, link or tag == "a", named))
    out = [b for b in out if not b.hidden]
    _weigh_names(out, names)
    return out


def costs(block: Block, text: str) -> int:
    """Thousandths by which calling the block boilerplate costs more than content."""
    n = len(text)
    linked = block.linked / max(1, sum(map(len, block.parts)))
    score = block.score + min(n, 400) * 4
    score -= int(2500 * linked)
    if text[-1:] in ".!?:;\"'»”…":
        score += 300
    return score


def min_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Content side of the minimum cut: node i costs gain[i] when it is called
    boilerplate (or -gain[i] when content); an edge costs its weight when cut.
    Shortest augmenting paths with integer capacities."""
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def join(u: int, v: int, there: int, back: int) -> None:
        out[u].append(len(to))
        to.append(v)
        room.append(there)
        out[v].append(len(to))
        to.append(u)
        room.append(back)

    for i, g in enumerate(gain):
        join(source, i, g, 0) if g > 0 else join(i, sink, -g, 0)
    for u, v, w in edges:
        join(u, v, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        next_ = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:  # blocking flow along the levels
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] == 0)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while next_[u] < len(out[u]):
                e = out[u][next_[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                next_[u] += 1
            else:
                if u == source:
                    break
                e = path.pop()
                u = to[e ^ 1]
                next_[u] += 1
                continue
            path.append(e)
            u = to[e]


def extract(source: str | None) -> str:
    """The main text of a page."""
    if not source:
        return ""
    found = [(b, _SPACE.sub(" ", entities.unescape("".join(b.parts))).strip()) for b in blocks(source)]
    found = [(b, t) for b, t in found if t]
    if not found:
        return ""
    # neighbours that share a container and its score differ in text only: one node
    gain: list[int] = []
    node: list[int] = []
    owner: list[int] = []
    for i, (b, t) in enumerate(found):
        if not i or found[i - 1][0].owner != b.owner or found[i - 1][0].score != b.score:
            gain.append(0)
            owner.append(b.owner)
        gain[-1] += costs(b, t)
        node.append(len(gain) - 1)
    edges = [(i, i + 1, CHAIN) for i in range(len(gain) - 1)]
    last: dict[int, int] = {}
    for i, o in enumerate(owner):
        if o in last:
            edges.append((last[o], i, SIBLING))
        last[o] = i
    keep = min_cut(gain, edges)
    return "\n\n".join(t for (b, t), k in zip(found, node) if keep[k])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""

    def rows(cols: dict[str, list]) -> dict[str, list]:
        text = [extract(h) for h in cols["html"]]
        return {"page_id": cols["page_id"], "url": cols["url"], "text": text, "n_chars": [len(t) for t in text]}

    return map_batches(pages.select("page_id", "url", "html"), {"page_id": "long", "url": "string", "text": "string", "n_chars": "long"}, rows)
