"""Main text of HTML pages by minimum-cut labelling of their blocks.

A page becomes a row of text blocks. A linear classifier turns a block's length, links, punctuation and markup into the costs of calling
it content or boilerplate: its capacities from and to the terminals. Edges join blocks that follow each other, weaker the farther apart
they are in the document tree, and blocks of one container to the next ones of the same container, whatever stands between. The minimum cut, by
maximum flow, is the labelling of least total cost: what one block says of itself gives way to what stands around it.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from evidentia.llm.shared import small_batches

#: Elements of HTML by their part in the layout.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template title iframe object svg math canvas textarea audio video noframes noembed head".split())
RAW = frozenset("script style noscript template title iframe textarea noframes noembed xmp".split())
CLOSES_P = BLOCKS - frozenset("button option optgroup legend caption tr td th tbody thead tfoot".split())
BOILERPLATE = frozenset("nav footer aside form menu button select dialog search fieldset".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Words in class, id and role that speak for and against content.
AGAINST = frozenset(
    "ad ads advert advertisement adverts adsense banner breadcrumb breadcrumbs byline comment comments consent contentinfo cookie cookies copyright disqus disclaimer dialog footer "
    "form header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup privacy promo promoted "
    "promotion recommend recommended recommendations related replies reply respond rss search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags toolbar tooltip topbar widget widgets alert complementary warning".split()
)
FOR = frozenset("article articlebody body content entry main maincontent post prose story text".split())

#: The classifier's weights. A few words say little either way and follow their neighbours; length counts by its logarithm, up to ``FULL_WORDS``.
WEIGHTS = {"bias": -1.2, "words": 1.0, "links": -3.0, "stop": 0.8, "heading": 0.8, "for": 0.4, "main": 0.8, "against": -5.0}
FULL_WORDS = 60
#: Capacity between blocks that follow each other, at no distance, and between blocks of one container.
ADJACENCY, PROXIMITY = 1.0, 1.0
#: So many earlier blocks of its container a block is joined to, the farther the weaker.
SIBLINGS = 2
#: What an element says against the text in it counts in full up to this share of the page's prose, and not at all from the second on.
FADES = (0.5, 0.9)

_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCKS))})(?=[\s/>])", re.I)
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""",
    re.S,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Block:
    """A run of text between block boundaries: its element, what the elements above it say of it, and whether it is in a heading."""

    __slots__ = ("against", "element", "heading", "hint", "linked", "text", "words")

    def __init__(self, parts: list[tuple[str, bool]], element: int, hint: str, against: int, heading: bool) -> None:
        self.text = " ".join("".join(x for x, _ in parts).split())
        self.words = self.text.count(" ") + 1
        linked = sum([len(x) for x, link in parts if link])
        self.linked = linked / sum([len(x) for x, _ in parts]) if linked else 0.0
        self.element, self.hint, self.against, self.heading = element, hint, against, heading


def _says(tag: str, attributes: str, in_main: bool) -> tuple[str, bool]:
    """What an element says for the text in it ("main", "for" or nothing), and whether it speaks against it."""
    if tag in BOILERPLATE or (tag == "header" and not in_main):
        return "", True
    against = speaks_for = False
    if attributes and tag not in ("body", "html"):
        if _HIDDEN.search(attributes):
            return "", True
        names = {w.lower() for m in _NAMES.finditer(attributes) for w in _WORDS.findall(m[1] or m[2] or m[3] or "")}
        speaks_for, against = bool(names & FOR), bool(names & AGAINST)
    if tag == "main":
        return "main", False
    if against and not speaks_for:
        return "", True
    return ("main" if tag == "article" else "for" if speaks_for else ""), False


class Page:
    """The text blocks of a page, in page order, and the parent and depth of every element; malformed markup never fails."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.parent, self.depth = [0], [0]
        #: Tag, element, hint, innermost element that speaks against, innermost block element, whether in a heading.
        self._stack: list[tuple[str, int, str, int, int, bool]] = [("", 0, "", 0, 0, False)]
        self._open: dict[str, list[int]] = {}  # places in the stack by tag
        self._parts: list[tuple[str, bool]] = []
        self._parse(html)
        self._close()

    def _last(self, *tags: str) -> int:
        found = 0
        for tag in tags:
            if (places := self._open.get(tag)) and places[-1] > found:
                found = places[-1]
        return found

    def _pop_to(self, place: int) -> None:
        for tag, *_ in self._stack[place:]:
            self._open[tag].pop()
        del self._stack[place:]

    def _push(self, tag: str, attributes: str) -> None:
        _, above, hint, against, block, heading = self._stack[-1]
        number = len(self.parent)
        self.parent.append(above)
        self.depth.append(self.depth[above] + 1)
        own, opposed = _says(tag, attributes, hint == "main")
        if tag == "main":
            against = 0
        elif opposed:
            against, hint = number, ""
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, number, own or hint, against, number if tag in BLOCKS else block, heading or tag in HEADINGS))

    def _close(self) -> None:
        """End the block that is being read."""
        if not self._parts:
            return
        if not all([x.isspace() for x, _ in self._parts]):
            _, _, hint, against, element, heading = self._stack[-1]
            self.blocks.append(Block(self._parts, element, hint, against, heading))
        self._parts.clear()

    def _start(self, tag: str, attributes: str) -> None:
        if tag in BLOCKS:
            self._close()
            if tag in CLOSES_P and (place := self._last("p")) > self._last("button"):
                self._pop_to(place)
            if tag == "li" and (place := self._last("li")) > self._last("ul", "ol", "menu"):
                self._pop_to(place)
            if tag in ("dt", "dd") and (place := self._last("dt", "dd")) > self._last("dl"):
                self._pop_to(place)
            if tag in ("td", "th", "tr") and (place := self._last(*(("td", "th") if tag != "tr" else ("tr",)))) > self._last("table"):
                self._pop_to(place)
        elif tag == "a" and (place := self._last("a")):
            self._pop_to(place)
        if tag not in VOID:
            self._push(tag, attributes)

    def _parse(self, html: str) -> None:
        at, size, parts = 0, len(html), self._parts
        endless: set[str] = set()  # what has no end from here on needn't be looked for again
        while at < size:
            m = _TOKEN.search(html, at)
            upto = m.start() if m else size
            if upto > at:
                parts.append((unescape(html[at:upto]), bool(self._open.get("a"))))
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if m[0].startswith("<![CDATA["):
                    parts.append((m[0][9:].removesuffix("]]>"), bool(self._open.get("a"))))
                continue
            closing, attributes = m[1] or m[4], m[3] or m[6] or ""
            if tag in SKIPPED and not closing:
                if not attributes.rstrip().endswith("/") or tag in RAW:
                    end = None if tag in endless else _end_of(tag).search(html, at)
                    if end:
                        at = end.end()
                    else:
                        endless.add(tag)
                        if tag in RAW:
                            at = size
                        elif tag != "head":  # what was never closed ends where a block begins or ends
                            block = _BLOCK_TAG.search(html, at)
                            at = block.start() if block else size
            elif tag == "br":
                parts.append((" ", False))
            elif not closing:
                self._start(tag, attributes)
            else:
                if tag in BLOCKS:
                    self._close()
                if place := self._last(tag):
                    self._pop_to(place)

    def apart(self, a: int, b: int) -> int:
        """Steps in the tree between two elements. Over neighbours in page order all steps together are twice the elements at most."""
        steps = 0
        while a != b:
            if self.depth[a] < self.depth[b]:
                a, b = b, a
            a, steps = self.parent[a], steps + 1
        return steps

    def gains(self) -> list[float]:
        """By block its log-odds of being content: the costs of the two labels, less what they have in common."""
        speak = {b.against for b in self.blocks} - {0}
        nearest = [0] * len(self.parent)  # by element the innermost that speaks against the text in it; parents come first
        inside = dict.fromkeys(speak, 0.0)
        for element in range(1, len(self.parent)):
            nearest[element] = element if element in speak else nearest[self.parent[element]]
        prose = 0.0
        for block in self.blocks:
            prose += block.words * (1 - block.linked)
            if block.against:
                inside[block.against] += block.words * (1 - block.linked)
        for element in sorted(speak, reverse=True):  # what is inside an inner one is inside the outer one
            if outer := nearest[self.parent[element]]:
                inside[outer] += inside[element]
        low, high = FADES
        fade = {e: min(1.0, max(0.0, (high - w / prose) / (high - low))) if prose else 1.0 for e, w in inside.items()}
        return [score(b) + (WEIGHTS["against"] * fade[b.against] if b.against else 0.0) for b in self.blocks]

    def edges(self) -> list[tuple[int, int, float]]:
        """The smoothness between blocks: of neighbours, by the square of their distance in the tree, and of a
        container's blocks to the last ones before; linear in number."""
        found: list[tuple[int, int, float]] = []
        before: dict[int, list[int]] = {}
        for i, block in enumerate(self.blocks):
            if i:
                found.append((i - 1, i, ADJACENCY / (1 + self.apart(self.blocks[i - 1].element, block.element) / 2) ** 2))
            for container in {block.element, self.parent[block.element]}:
                if container:
                    last = before.setdefault(container, [])
                    found += [(j, i, PROXIMITY / far) for far, j in enumerate(reversed(last), 1)]
                    last.append(i)
                    del last[:-SIBLINGS]
        return found


@lru_cache(64)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I)


def score(block: Block) -> float:
    """Log-odds that a block is content by itself, what elements above it say against it left out."""
    total = WEIGHTS["bias"] + WEIGHTS["words"] * log2(1 + min(FULL_WORDS, block.words) / 4)
    total += WEIGHTS["links"] * block.linked / (3 if block.hint == "main" else 1)
    if block.text[-1] in ".!?…:;\"'”»":
        total += WEIGHTS["stop"]
    if block.heading:
        total += WEIGHTS["heading"]
    return total + (WEIGHTS[block.hint] if block.hint else 0.0)


def settled(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool | None]:
    """By node its label, where its own gain, with its settled neighbours, outweighs all its edges to the others; else none.

    Such a label belongs to a minimum cut whatever the others turn out to be, so only the rest needs a flow.
    """
    near: list[list[int]] = [[] for _ in gain]
    own, loose = list(gain), [0.0] * len(gain)
    for k, (a, b, capacity) in enumerate(edges):
        near[a].append(k)
        near[b].append(k)
        loose[a] += capacity
        loose[b] += capacity
    label: list[bool | None] = [None] * len(gain)
    waiting = list(range(len(gain)))
    while waiting:
        i = waiting.pop()
        if label[i] is not None or abs(own[i]) < loose[i] or own[i] == 0:
            continue
        label[i] = keep = own[i] > 0
        for k in near[i]:
            a, b, capacity = edges[k]
            j = b if a == i else a
            if label[j] is None:
                own[j] += capacity if keep else -capacity
                loose[j] -= capacity
                if abs(own[j]) >= loose[j]:
                    waiting.append(j)
    return label


def label_blocks(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """A least-cost labelling: what is settled at once, and the minimum cut of the rest with its settled neighbours in its gains."""
    label = settled(gain, edges)
    rest = [i for i, x in enumerate(label) if x is None]
    if rest:
        place, own = {i: k for k, i in enumerate(rest)}, [gain[i] for i in rest]
        inner = []
        for a, b, capacity in edges:
            if a in place and b in place:
                inner.append((place[a], place[b], capacity))
            elif a in place or b in place:
                known, other = (label[b], a) if a in place else (label[a], b)
                own[place[other]] += capacity if known else -capacity
        for i, keep in zip(rest, minimum_cut(own, inner), strict=True):
            label[i] = keep
    return label


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node, whether it stays on the source's side of a minimum cut.

    ``gain`` is a node's capacity from the source less that to the sink; what both have in common flows at once and is left out.
    ``edges`` (a, b, capacity) hold in both directions. Shortest augmenting paths by levels.
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    at: list[list[int]] = [[] for _ in range(n + 2)]

    def join(a: int, b: int, there: float, back: float) -> None:
        at[a].append(len(to))
        to.append(b)
        room.append(there)
        at[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, capacity in edges:
        join(a, b, capacity, capacity)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in at[a]:
                if room[e] > 1e-12 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn, path, a = [0] * (n + 2), [], source
        while True:
            if a == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                path, a = [], source
                continue
            while turn[a] < len(at[a]):
                e = at[a][turn[a]]
                if room[e] > 1e-12 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            if turn[a] < len(at[a]):
                path.append(at[a][turn[a]])
                a = to[path[-1]]
            elif path:
                a = to[path.pop() ^ 1]
                turn[a] += 1
            else:
                break


def main_text(html: str | None) -> str:
    """The content blocks of a page, joined by newlines; empty if there are none or no page."""
    page = Page(html or "")
    keep = label_blocks(page.gains(), page.edges())
    return "\n".join(block.text for block, k in zip(page.blocks, keep, strict=True) if k)


@F.arrow_udf(StringType())
def _main_text(pages: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in pages:
        yield pa.array([main_text(x.as_py()) for x in batch], pa.string())


def extract(pages: DataFrame, html_col: str = "html", text: str = "text") -> DataFrame:
    """``pages`` without the html and with its main text, empty for null or blank html and where no block is content.

    Every row stays, repeated ones too; no rows give no rows. A column named as the result is replaced.
    """
    small_batches(pages.sparkSession)
    rest = [F.col(f"`{c}`") for c in pages.columns if c.lower() not in (html_col.lower(), text.lower())]
    return pages.select(*rest, _main_text(F.col(html_col)).alias(text))


def length(text: Column) -> Column:
    return F.char_length(text).cast("long")
