"""A small HTML tree: elements, and text blocks in page order."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# fixed values: element kinds of the HTML standard
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe".split())  # up to the end tag their content is no markup
#: Ordinary elements whose content is no text of the page.  One without an end tag ends where its parent does or a block
#: begins; noscript and template, which hold blocks, are then no elements.
ASIDE = frozenset("svg select option optgroup button noscript template".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul caption video audio object".split())
CLOSES_P = BLOCK - frozenset("html head body".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
            "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"),
            "tfoot": ("tbody", "tr", "td", "th"), "option": ("option",),
            "optgroup": ("option", "optgroup")}
LISTS = frozenset("table ul ol dl menu".split()) | ASIDE
SCOPE = frozenset("table ul ol dl div article section body html td th".split()) | ASIDE

#: A tag that holds no "<" and whose quotes are in order: most are.
_PLAIN = re.compile(r"<(/?)([a-zA-Z][^\s/><]*)((?:[^<>\"'=]++|=(?:\s*+(?:\"[^\"<]*+\"|'[^'<]*+'))?+)*+)>")
_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r">|=\s*+[\"']")  # the next place in a tag that matters: its end, or a quoted value
_ASIDE_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|textarea|iframe)\b.*?(?:</\1\s*>|\Z)"
    r"|<(/?)(svg|select|button|noscript|template)(?![^\s/>])", re.S | re.I)
_CUT = re.compile(r"</?[a-zA-Z][^>]*\Z")  # a tag that the page's end cuts off
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAMED = re.compile(r"\b(?:class|id|role)\s*=", re.I)


@dataclass
class Node:
    tag: str
    parent: int
    attrs: str
    children: list[int] = field(default_factory=list)
    chars: int = 0  # of its own text
    link_chars: int = 0
    inline: bool = False

    def attributes(self) -> dict[str, str]:
        return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(self.attrs)}


@dataclass
class Page:
    nodes: list[Node]
    blocks: list[list[tuple[int, str]]]  # in page order; each of (node, text) pieces, white space as it stands


class Marks:
    """Tags, comments and declarations of a page, in time proportional to its
    length: what a search has once found out holds for later ones too."""

    def __init__(self, source: str):
        self.source = source
        self.last = source.rfind(">")
        self.stop = (0, -1, None)  # from, to, match: the next stop of any place between
        self.lacks: set[str] = set()  # quotes that no longer occur
        self.dead: set[int] = set()  # stops from which no tag ends

    def _next_stop(self, at: int) -> re.Match | None:
        lo, hi, m = self.stop
        if not lo <= at <= hi:
            m = _STOP.search(self.source, at)
            self.stop = (at, m.start() if m else len(self.source), m)
        return m

    def tag_end(self, at: int) -> int:
        """Place of the ">" that ends the tag whose name ends at ``at``; -1
        without one.  A quoted value begins after "=" only, and a quote that is
        never closed is none."""
        met = []
        while at <= self.last:
            m = self._next_stop(at)
            if m is None or m.start() in self.dead:
                break
            if m[0] == ">":
                return m.start()
            met.append(m.start())
            quote, at = m[0][-1], m.end()
            if quote not in self.lacks:
                shut = self.source.find(quote, at)
                if shut < 0:
                    self.lacks.add(quote)
                else:
                    at = shut + 1
        self.dead.update(met)
        return -1

    def find(self, at: int) -> tuple[int, int, str | None, str, str] | None:
        """(start, end, name, slash, attributes) of the next mark; comments and
        declarations have no name."""
        source = self.source
        while (lt := source.find("<", at)) >= 0:
            m = _PLAIN.match(source, lt)
            if m:
                return lt, m.end(), m[2].lower(), m[1], m[3]
            if lt >= self.last and not source.startswith("<!--", lt):
                return None
            if source.startswith("<!--", lt):
                shut = source.find("-->", lt + 4)
                return lt, shut + 3 if shut >= 0 else len(source), None, "", ""
            if source.startswith(("<!", "<?"), lt):
                return lt, source.find(">", lt) + 1, None, "", ""
            m = _NAME.match(source, lt)
            if m and (end := self.tag_end(m.end())) >= 0:
                return lt, end + 1, m[2].lower(), m[1], source[m.end():end]
            at = lt + 1
        return None


def _ended(source: str, marks: Marks) -> set[int]:
    """Starts of the elements of ``ASIDE`` that have an end tag."""
    open_at: dict[str, list[int]] = {}
    out, at = set(), 0
    while m := _ASIDE_MARK.search(source, at):
        at = m.end()
        if m[3]:
            end = marks.tag_end(at)
            if end < 0:
                continue
            at = end + 1
            if source[m.end():end].rstrip().endswith("/"):
                continue
            mine = open_at.setdefault(m[3].lower(), [])
            if not m[2]:
                mine.append(m.start())
            elif mine:
                out.add(mine.pop())
    return out


class _Open:
    """The open elements, and where each tag stands among them."""

    def __init__(self):
        self.stack: list[tuple[str, int, bool]] = [("#root", 0, True)]  # tag, node, whether it begins a block
        self.at: dict[str, list[int]] = {}

    def push(self, tag: str, node: int, block: bool) -> None:
        self.at.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, node, block))

    def pop(self) -> tuple[str, int, bool]:
        top = self.stack.pop()
        self.at[top[0]].pop()
        return top

    def last(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[-1] if found else 0

    def node(self) -> int:
        return self.stack[-1][1]


def parse(source: str | None) -> Page:
    """The tree of a page's block elements and of those inline ones that have a
    class, id or role.  Other inline elements only count for the share of link
    text; text belongs to the nearest node."""
    source = source or ""
    nodes = [Node("#root", -1, "")]
    blocks: list[list[tuple[int, str]]] = []
    opened = _Open()
    held: list[tuple[int, str]] = []
    links = 0
    link_chars: dict[int, int] = {}
    aside, loose = 0, False  # where the outermost open element of ASIDE stands, and that it has no end tag
    marks = Marks(source)
    ended = _ended(source, marks)

    def flush() -> None:
        if held:
            pieces: list[tuple[int, list[str]]] = []
            for node, text in held:
                if not pieces or pieces[-1][0] != node:
                    pieces.append((node, []))
                pieces[-1][1].append(text)
            block = [(node, html.unescape("".join(texts))) for node, texts in pieces]
            if any(text.strip() for _, text in block):
                blocks.append(block)
                for node, text in block:
                    n = len(" ".join(text.split()))
                    nodes[node].chars += n
                    nodes[node].link_chars += min(link_chars.pop(node, 0), n)
            held.clear()
        link_chars.clear()

    def close(down_to: int) -> None:
        nonlocal links, aside
        stop = aside or len(opened.stack)
        if any(block for _, _, block in opened.stack[down_to:stop]):
            flush()  # while the block is still open
        while len(opened.stack) > down_to:
            links -= opened.pop()[0] == "a"
        if aside >= down_to:
            aside = 0

    def close_open(tags: tuple[str, ...], barrier: frozenset[str]) -> None:
        mine = max(map(opened.last, tags))
        if mine and mine >= max(map(opened.last, barrier)):
            close(mine)

    at, end = 0, len(source)
    while at < end:
        mark = marks.find(at)
        stop = mark[0] if mark else end
        if stop > at and not aside:
            piece = source[at:stop]
            if not mark:
                cut = _CUT.search(piece, piece.rfind(">") + 1)
                piece = piece[:cut.start()] if cut else piece
            held.append((opened.node(), piece))
            if links > 0:
                link_chars[opened.node()] = link_chars.get(opened.node(), 0) + len(piece.strip())
        if not mark:
            break
        start, at, tag, slash, attrs = mark
        if tag is None:
            continue
        if slash:
            if opened.last(tag):
                close(opened.last(tag))
            continue
        if tag == "br":
            if not aside:
                held.append((opened.node(), " "))
            continue
        if tag in BLOCK and aside and loose:
            close(aside)
        if tag in CLOSES_P:
            close_open(("p",), SCOPE)
        if tag in SIBLINGS:
            close_open(SIBLINGS[tag], LISTS)
        if tag in BLOCK and not aside:
            flush()
        if tag in VOID or attrs.rstrip().endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW and not (tag == "title" and aside and opened.last("svg") >= aside):
            # its content is no text of the page
            shut = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            at = shut.end() if shut else end
            continue
        if tag in ("noscript", "template") and start not in ended:
            continue
        if tag in ASIDE and not aside:
            aside, loose = len(opened.stack), start not in ended
        block = tag in BLOCK
        if not aside and (block or _NAMED.search(attrs)):
            parent = opened.node()
            nodes.append(Node(tag, parent, attrs, inline=not block))
            nodes[parent].children.append(len(nodes) - 1)
            opened.push(tag, len(nodes) - 1, block)
        else:
            opened.push(tag, opened.node(), block)
        links += tag == "a"
    flush()
    return Page(nodes, blocks)
