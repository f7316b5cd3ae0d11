"""Op 1: main text of HTML pages by a minimum cut between content and boilerplate blocks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import build, col, slices

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")
#: Elements whose content is never text of the page; it goes up to the end tag.
SKIPPED = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "object", "svg", "math", "canvas", "audio", "video", "select"}
ENDS = {t: re.compile(rf"</{t}\s*>", re.I) for t in SKIPPED}
#: Elements that begin and end a block of text.
BLOCKS = set("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = {"hr"}
#: An element that opens closes these if they are open inside the same parent.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}}
#: Parts of a page that aren't its article.
AWAY = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "head", "label", "legend", "fieldset", "search"}
HOME = {"article", "main"}
#: Words in class, id or role that name such parts, and words beside them that say nothing.
AWAY_NAMES = set("ad ads advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright discussion disqus feedback footer gdpr legal login "
                 "masthead menu modal nav navbar navigation newsletter notice opinion opinions popup promo promoted related replies reply respond response responses search share sharing sidebar signup social "
                 "sponsor sponsored subscribe toc toolbar widget complementary".split())
NEUTRAL = set("area bar bottom box block container first form group header inner item last left links list outer panel reader readers right row section site slot top unit user users wrap wrapper".split())
CONTENT_NAMES = set("article body content entry main page post story text".split())
#: Elements of the whole page, whose names say what else is on it.
PAGE_LEVEL = {"html", "body", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SCALE = 100


@dataclass
class Block:
    """A run of text without block elements in it."""

    text: str
    path: tuple[int, ...]
    home: bool
    away: int
    named: float
    heading: bool
    linked: int


@dataclass
class Element:
    tag: str
    number: int
    home: bool
    away: int
    named: float


def named_away(names: list[str]) -> float:
    """How much the names of an element speak for boilerplate: 0, 0.2 beside a name for content, 1.

    Only whole names count: all of their words must name such a part or say nothing, so ``has-sidebar``, ``ad-free`` and
    ``share-on`` don't. Numbers and words of one letter are left out.
    """
    words = [[w for w in WORD.findall(n) if len(w) > 1] for n in names]
    away = any(not AWAY_NAMES.isdisjoint(w) and AWAY_NAMES.union(NEUTRAL).issuperset(w) for w in words)
    content = any(not CONTENT_NAMES.isdisjoint(w) and AWAY_NAMES.isdisjoint(w) for w in words)
    return 0.0 if not away else 0.2 if content else 1.0


@dataclass
class Reader:
    """Open block elements and the blocks read so far."""

    stack: list[Element] = field(default_factory=lambda: [Element("", 0, False, 0, 0.0)])
    blocks: list[Block] = field(default_factory=list)
    parts: list[str] = field(default_factory=list)
    count: int = 0
    linked: int = 0
    in_link: bool = False

    def end_block(self):
        if self.parts:
            text = " ".join(unescape("".join(self.parts)).split())
            if text:
                top = self.stack[-1]
                self.blocks.append(Block(text, tuple(e.number for e in self.stack), top.home, top.away, top.named, any(e.tag in HEADINGS for e in self.stack[-2:]), min(self.linked, len(text))))
        self.parts, self.linked = [], 0

    def close(self, tags: set[str], within: set[str]):
        """Closes the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return
            if self.stack[k].tag in within:
                return

    def open(self, tag: str, attributes: str):
        self.end_block()
        if tag in CLOSES:
            self.close(CLOSES[tag], {"ul", "ol", "dl", "table", "select"})
        if self.stack[-1].tag == "p":
            self.stack.pop()
        if tag in VOID:
            return
        top, self.count = self.stack[-1], self.count + 1
        away = top.away + (tag in AWAY) + (tag == "header" and not top.home)
        names = []
        for name, *value in NAMES.findall(attributes):
            value = "".join(value).lower()
            name = name.lower()
            if name in ("class", "id", "role"):
                names += value.split()
            elif name == "hidden" or name == "aria-hidden" and value == "true" or "display:none" in value.replace(" ", ""):
                away += 1
        named = top.named + (named_away(names) if names and tag not in PAGE_LEVEL else 0.0)
        self.stack.append(Element(tag, self.count, top.home or tag in HOME, away, named))

    def text(self, part: str):
        self.parts.append(part)
        if self.in_link:
            self.linked += len(part)


def read_blocks(html: str) -> list[Block]:
    """Blocks in page order; markup errors never raise."""
    r, at = Reader(), 0
    scan = TOKEN.search
    while m := scan(html, at):
        if m.start() > at:
            r.text(html[at:m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends = bool(m[1] or m[4])
        if tag in SKIPPED:
            if not ends and not (m[3] or m[6] or "").endswith("/"):
                stop = ENDS[tag].search(html, at)
                at = stop.end() if stop else len(html)
        elif tag in BLOCKS:
            if ends:
                r.end_block()
                r.close({tag}, set())
            else:
                r.open(tag, m[3] or m[6] or "")
            r.in_link = False
        elif tag == "a":
            r.in_link = not ends
        elif tag in ("br", "wbr", "img", "input"):
            r.text(" " if tag != "wbr" else "")
    r.text(html[at:])
    r.end_block()
    return r.blocks


def score(b: Block, names: bool = True) -> int:
    """What the classifier holds for content, as SCALE times a log-odds of weak signals: length, links, place and names.

    Elements that are by definition no article (AWAY) weigh most. A name weighs 12, one beside a name for content 2.4; the neighbours of a block
    in the same parent weigh 2.5 each, so they carry short or linked blocks along, but not a named one.
    """
    words = b.text.count(" ") + 1
    z = -1.0 + min(words, 30) * 0.15 - 4.5 * b.linked / len(b.text) - 20.0 * min(b.away, 1) + 0.5 * (b.text[-1] in ".!?…\"”»")
    return int(SCALE * (z + 1.5 * b.home + 1.0 * b.heading - names * 12.0 * min(b.named, 1.0)))


def edges(blocks: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness between neighbours in the page and to the last block of the same parent; less the farther apart in the tree."""
    out, last = [], {}
    for i, b in enumerate(blocks):
        near = {i - 1} if i else set()
        for depth in (1, 2):
            key = b.path[:-depth]
            if key in last:
                near.add(last[key])
        for j in near:
            if bool(b.away) != bool(blocks[j].away) or (b.named >= 1) != (blocks[j].named >= 1):
                continue  # the border of a part that isn't the article
            shared = 0
            for x, y in zip(b.path, blocks[j].path):
                if x != y:
                    break
                shared += 1
            steps = len(b.path) + len(blocks[j].path) - 2 * shared
            out.append((j, i, int(SCALE * 5 / max(steps, 2))))
        for depth in (1, 2):
            last[b.path[:-depth]] = i
    return out


def source_side(gain: list[int], smooth: list[tuple[int, int, int]]) -> list[bool]:
    """The source side of a minimum cut: node i hangs on the source with capacity gain[i] or on the sink with -gain[i].

    Maximum flow by shortest augmenting paths in phases (level graph, then blocking flow).
    """
    n = len(gain)
    source, sink = n, n + 1
    to: list[int] = []
    cap: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a, b, forth, back):
        out[a].append(len(to)), to.append(b), cap.append(forth)
        out[b].append(len(to)), to.append(a), cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            link(source, i, g, 0)
        elif g < 0:
            link(i, sink, -g, 0)
    for a, b, c in smooth:
        if c:
            link(a, b, c, c)
    while True:
        level = [-1] * (n + 2)
        level[source], queue = 0, [source]
        for a in queue:
            for e in out[a]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                full = next(k for k, e in enumerate(path) if not cap[e])
                at = to[path[full] ^ 1]
                del path[full:]
                continue
            edges_of = out[at]
            while turn[at] < len(edges_of):
                e = edges_of[turn[at]]
                if cap[e] and level[to[e]] == level[at] + 1:
                    break
                turn[at] += 1
            if turn[at] < len(edges_of):
                path.append(edges_of[turn[at]])
                at = to[path[-1]]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]


def main_text(html: str | None) -> str:
    """Content blocks joined by line feeds; empty if there are none.

    Names are hints: where they would leave nothing of an ``article`` or ``main`` element, or nothing of a page without
    one, the page is cut again without them.
    """
    blocks = read_blocks(html or "")
    smooth = edges(blocks)
    for names in (True, False):
        gain = [score(b, names) for b in blocks]
        keep = source_side(gain, smooth) if any(g > 0 for g in gain) else [False] * len(blocks)
        inner = [k for b, k in zip(blocks, keep) if b.home and not b.away]
        if any(inner) or not inner and any(keep):
            break
    return "\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col``, ``url_col``, text, n_chars (code points) of every row.

    A null or empty page, or one without content, has an empty text of 0 characters. Pages are read whole; broken markup
    is read as far as it goes; equal rows and ids each give their row; other columns are ignored; an empty table gives
    an empty one. Nothing is shuffled.
    """
    src = pages.select(col(id_col).alias("a"), col(url_col).alias("b"), col(html_col).cast("string").alias("c"))
    kind = [src.schema[x].dataType.simpleString() for x in "ab"]

    def run(batches):
        for whole in batches:
            schema = pa.schema([("a", whole.schema.field(0).type), ("b", whole.schema.field(1).type), ("text", pa.string()), ("n_chars", pa.int64())])
            for b in slices(whole, 2):
                texts = [main_text(h) for h in b.column(2).to_pylist()]
                yield build(schema, b.column(0), b.column(1), texts, list(map(len, texts)))

    out = src.mapInArrow(run, f"a {kind[0]}, b {kind[1]}, text string, n_chars long")
    return out.select(F.col("a").alias(id_col), F.col("b").alias(url_col), "text", "n_chars")
