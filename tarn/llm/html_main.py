"""Main text of web pages by inferred wrappers.

A page is a stream of tags and texts.  Streams of one host are aligned, one
after another, into a wrapper: a regular expression without unions.  Siblings
of equal shape meet in order; where their numbers differ they become a repeated
group, but for leading and trailing ones whose text is the same on both sides;
a sequence that recurs many times becomes a repeated group of its own; what one
side lacks becomes optional, and texts that differ become slots.

A host's wrapper decides what its pages say.  Its main part is the article (or
main element); nothing inside one goes for being the same on other pages.  Where
a host has none, the main part is the smallest that holds every sentence and
heading that varies from page to page; inside it, a text that all of the host's
pages have, word for word, is furniture, unless it is a heading or a label of
what varies.  Elements that HTML has for menus, asides, forms and the like are
furniture everywhere.  Names of classes are weak evidence: they take a part out
only if enough is left.  Each page is then matched with its host's wrapper, and
the texts that fall on its kept slots are the page's text.

Wrappers are learnt from all distinct pages: each task folds its own into one
partial wrapper a host, and the partial wrappers of a host are aligned in a tree.
A page in which the wrapper finds no main part is read by a wrapper of its own.
All walks use lists for stacks, so pages may be nested to any depth; sequences
are aligned exactly at any length, by longest common subsequences in bit vectors.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import HOT_LEAST, HOT_SHARE, carried, join_hot, small_batches
from tarn.session import materialize, release

#: From this many distinct pages on it can be told what never varies.
FEW_PAGES = 3
#: Partial wrappers that meet in one group of a tree's level, and hosts that a task holds at once; of more, the half that was met longest ago is handed on.
FAN_IN, OPEN_HOSTS = 16, 1000
#: Characters on average from which a text is a sentence, and tags whose texts name what comes after them.
SENTENCE, LABELS = 25, {"h1", "h2", "h3", "h4", "h5", "h6", "dt", "th", "legend", "caption", "figcaption"}
#: Where parts whose class names tell of furniture hold this share of the text, the heaviest of them stays; repeated articles with less than the other share are teasers.
MARKED_SHARE, TEASER_SHARE = 0.8, 0.3
#: Siblings of one shape that are one group at sight, and recurrences of a sequence (of at most so many parts) that are.
RUN, TANDEM, PERIOD = 16, 8, 16
#: Bits that an alignment holds at once; a longer one is halved first.
ALIGN_BITS = 1 << 27
#: Up to so many repeated pages are broadcast by their digest; more are joined by a shuffle.
BROADCAST_REPEATS = 1_000_000
#: Up to this size, all wrappers are broadcast; beyond, pages are dealt to them.
BROADCAST_BYTES = 16 << 20

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
    "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th",
    "thead", "tr", "ul",
}
FURNITURE = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "fieldset", "footer", "form", "head", "iframe", "input", "label",
    "map", "math", "menu", "nav", "noembed", "noframes", "noscript", "object", "option", "optgroup", "script", "select", "style", "svg",
    "template", "textarea", "title", "video", "xmp",
}
#: Words in a class, id or role that mark furniture.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|nav|navbar|navigation|menu|breadcrumbs?|sidebar|aside|"
    r"footer|masthead|topbar|toolbar|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|"
    r"comments?|commentlist|disqus|replies|reply|respond|responses|discussion|share|sharing|social|related|recommend(?:ed|ations)?|pagination|pager|paging|"
    r"widget|search|skip-link|hidden|sr-only|visually-hidden|print-only|complementary|contentinfo|dialog|tooltip)(?:$|[\s_-])",
    re.I,
)
#: A start tag that closes an open tag of these names, up to the nearest tag that bounds the search.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDS = {"ul", "ol", "dl", "table", "select", "div", "section", "article", "body", "aside", "nav", "footer", "header", "main", "form", "td", "th", "blockquote"}
ENDS_P = BLOCK - {"br", "option", "optgroup", "tbody", "thead", "tfoot", "tr", "td", "th", "legend", "caption", "html", "body"}

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)""", re.S)
#: Classes that count pages (post-123) are one shape.
_DIGITS = re.compile(r"\d+")
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)



@dataclass
class Node:
    """An element; ``parts`` holds texts and elements in order. ``marked``: its class, id or role tells of furniture."""

    tag: str
    shape: str
    marked: bool = False
    parts: list = field(default_factory=list)

    def add_text(self, text: str) -> None:
        if self.parts and isinstance(self.parts[-1], str):
            self.parts[-1] += text
        else:
            self.parts.append(text)


def parse(page: str) -> Node:
    """The page as a tree, with the end tags that authors leave out."""
    root = Node("#root", "#root")
    stack, at, open_ = [root], 0, {}

    def cut(i: int) -> None:
        for x in stack[i:]:
            open_[x.tag] -= 1
        del stack[i:]

    def close(tags: set[str]) -> None:
        for t in tags:
            if open_.get(t):
                break
        else:
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return cut(i)
            if stack[i].tag in BOUNDS:
                return None

    while True:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].add_text(entities.unescape(text) if "&" in text else text)
        if not m:
            return root
        at = m.end()
        if not m.group(2):
            if m.group().startswith("<![CDATA["):
                stack[-1].add_text(m.group()[9:-3])
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1) if open_.get(tag) else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if stack[i].tag in ("article", "body", "main", "td", "table") and tag not in ("html", "body", "article", "main", "table", "tr", "td"):
                    break
            continue
        if tag in ENDS_P:
            close({"p"})
        if tag in CLOSES:
            close(CLOSES[tag])
        node = Node(tag, *_shape(tag, m.group(3))) if m.group(3) else Node(tag, tag)
        stack[-1].parts.append(node)
        if tag in VOID or m.group(3).endswith("/") and tag in RAW:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            node.parts.append(page[at : end.start() if end else len(page)])
            at = end.end() if end else len(page)
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1


@lru_cache(maxsize=1 << 14)
def _shape(tag: str, written: str) -> tuple[str, bool]:
    """An element's shape, and whether its names tell of furniture."""
    attrs = {a.lower(): (v or "").strip("\"'") for a, v in _ATTR.findall(written)}
    marks = " ".join(attrs[a] for a in ("class", "id", "role", "itemprop") if attrs.get(a))
    shape = tag + "".join(f".{_DIGITS.sub('#', c)}" for c in sorted(attrs.get("class", "").split())) + (f"@{attrs['role']}" if attrs.get("role") else "")
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        shape += "!hidden"
    return shape, bool(marks) and tag not in ("html", "body", "main", "article") and bool(MARKS.search(marks))


# ---- wrappers

TEXT = "#text"


@dataclass(eq=False, slots=True)
class Part:
    """A piece of a wrapper, or of one page.

    ``value``: all text inside, if it is the same wherever the part stands;
    None for what varies.  ``seen``: surroundings that have the part; ``count``:
    how often it stands in them.  ``mass``: characters of a text, all of them.
    A group is a sequence that recurs; its body holds the sequence once.
    """

    shape: str
    marked: bool = False
    value: str | None = None
    count: int = 1
    seen: int = 1
    repeated: bool = False
    mass: int = 0
    body: list = field(default_factory=list)
    role: str = ""

    @property
    def key(self) -> tuple[str, bool]:
        return self.shape, self.marked

    @property
    def tag(self) -> str:
        return _tag(self.shape)

    def row(self) -> list:
        return [self.shape, self.marked, self.value, self.count, self.seen, self.repeated, self.mass]


@lru_cache(maxsize=1 << 14)
def _tag(shape: str) -> str:
    return re.match(r"[^.@!]*", shape).group()


def is_furniture(tag: str, shape: str) -> bool:
    """Whether HTML itself says that an element is no text to read."""
    return tag in FURNITURE or shape.endswith("!hidden")


def page_parts(root: Node) -> Part:
    """One page as parts, blank texts left out; elements that are furniture have no body."""
    top = Part(root.shape)
    order, stack = [], [(root, top)]
    while stack:
        node, part = stack.pop()
        order.append(part)
        for x in node.parts:
            if isinstance(x, str):
                text = " ".join(x.split())
                if text:
                    part.body.append(Part(TEXT, value=text, mass=len(text)))
            else:
                part.body.append(Part(x.shape, x.marked))
                if not is_furniture(x.tag, x.shape):
                    stack.append((x, part.body[-1]))
    for part in reversed(order):
        part.value = _digest([p.value for p in part.body])
    return top


def _digest(values: list[str | None]) -> str | None:
    """What stands for all text inside a part: short, or by its digest."""
    if any(v is None for v in values):
        return None
    text = " ".join(v for v in values if v)
    return text if len(text) <= 64 else hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest()


def grouped(parts: list[Part]) -> list:
    """``parts`` in order, with a list of lists in place of a sequence that recurs ``TANDEM`` times or more."""
    if len(parts) < 2 * TANDEM:
        return parts
    keys, out, i = [p.key for p in parts], [], 0
    last = len(parts) - 2 * TANDEM
    while i < len(parts):
        for period in range(2, PERIOD + 1) if i <= last and keys[i] != keys[i + 1] else ():
            if i + TANDEM * period > len(keys) or keys[i] != keys[i + period]:
                continue
            end = i + period
            while end + period <= len(keys) and all(keys[end + k] == keys[i + k] for k in range(period)):
                end += period
            if end - i >= TANDEM * period and len(set(keys[i : i + period])) > 1:
                out.append([parts[k : k + period] for k in range(i, end, period)])
                i = end
                break
        else:
            out.append(parts[i])
            i += 1
    return out


def _runs(parts: list) -> list[tuple[tuple, list]]:
    """Neighbours of one key together; groups that recur stand alone."""
    out: list[tuple[tuple, list]] = []
    for p in grouped(parts):
        key = p.key if isinstance(p, Part) else (_group_shape(p[0]), False)
        if out and out[-1][0] == key:
            out[-1][1].append(p)
        else:
            out.append((key, [p]))
    return out


def _group_shape(parts: list[Part]) -> str:
    return "(" + " ".join(f"{p.shape}{'~' if p.marked else ''}" for p in parts) + ")"


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists of keys, as places in both."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = [(i, i) for i in range(head)]
    stack = [(head, len(a) - tail, head, len(b) - tail)]
    while stack:
        i, k, j, m = stack.pop()
        if i == k or j == m:
            continue
        if (k - i) * (m - j) > ALIGN_BITS and k - i > 1:
            half = (i + k) // 2
            front = _lengths(list(_rows(a[i:half], b[j:m]))[-1], m - j)
            back = _lengths(list(_rows(a[half:k][::-1], b[j:m][::-1]))[-1], m - j)[::-1]
            cut = j + int((front + back).argmax())
            stack += [(half, k, cut, m), (i, half, j, cut)]
        else:
            found += [(i + x, j + y) for x, y in _common(a[i:k], b[j:m])]
    return found + [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]


def _rows(a: list, b: list) -> Iterator[int]:
    """For each head of ``a``, a bit vector over ``b``: bit j is 0 where its longest common subsequence with b[:j + 1] is longer than with b[:j]."""
    at: dict = {}
    for j, key in enumerate(b):
        at[key] = at.get(key, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for key in a:
        met = row & at.get(key, 0)
        row = ((row + met) | (row - met)) & full
        yield row


def _bits(row: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(row.to_bytes(-(-n // 8), "little"), dtype=np.uint8), bitorder="little")[:n]


def _lengths(row: int, n: int) -> np.ndarray:
    """Lengths of the longest common subsequence with each head of b, from the empty one on."""
    return np.concatenate([[0], np.cumsum(_bits(row, n) == 0)])


def _common(a: list, b: list) -> list[tuple[int, int]]:
    """A longest common subsequence of two lists; of several the one met first from their heads."""
    n, width = len(b), -(-len(b) // 8)
    rows = [r.to_bytes(width, "little") for r in _rows(a[::-1], b[::-1])][::-1]  # row i: of a[i:] with the tails of b
    i = j = 0
    found = []
    while i < len(a) and j < n:
        if a[i] == b[j]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i][(n - 1 - j) >> 3] >> ((n - 1 - j) & 7) & 1:
            j += 1  # as long without b[j]
        else:
            i += 1
    return found


class _Pending:
    """Bodies that still have to be aligned with the body of a part."""

    def __init__(self):
        self.of: dict[int, tuple[Part, list]] = {}

    def add(self, part: Part, bodies: list) -> None:
        bodies = [b for b in bodies if b]
        if bodies:
            self.of.setdefault(id(part), (part, []))[1].extend(bodies)

    def take(self, part: Part) -> list:
        return self.of.pop(id(part), (part, []))[1]


def _meet(x: Part, y: Part, todo: _Pending) -> Part:
    """``y`` of another page on ``x``."""
    x.count, x.seen, x.mass, x.repeated = x.count + y.count, x.seen + y.seen, x.mass + y.mass, x.repeated or y.repeated
    x.value = x.value if x.value == y.value else None
    todo.add(x, [y.body, *todo.take(y)])
    return x


def _fold(parts: list, todo: _Pending) -> Part:
    """Neighbours of one key, or of one recurring sequence, as one repeated part."""
    if isinstance(parts[0], list):
        rounds = [r for p in parts for r in p]
        body = [_fold([r[k] for r in rounds], todo) for k in range(len(rounds[0]))]
        return Part(_group_shape(rounds[0]), False, _digest([p.value for p in body]), len(rounds), 1, True, 0, body)
    x = parts[0]
    for y in parts[1:]:
        seen = max(x.seen, y.seen)
        _meet(x, y, todo).seen = seen
    x.repeated = x.repeated or len(parts) > 1
    return x


def _ends(a: list[Part], b: list[Part]) -> tuple[int, int]:
    """How many at the head and at the tail of two runs have one and the same text on both sides."""
    same = lambda x, y: isinstance(x, Part) and isinstance(y, Part) and not x.repeated and not y.repeated and bool(x.value) and x.value == y.value
    most, head, tail = min(len(a), len(b)), 0, 0
    while head < most and same(a[head], b[head]):
        head += 1
    while tail < most - head and same(a[-1 - tail], b[-1 - tail]):
        tail += 1
    return head, tail


def _one_by_one(a: list, b: list) -> bool:
    return len(a) == len(b) <= RUN and all(isinstance(p, Part) and not p.repeated for p in [*a, *b])


def _level(a: list[Part], b: list[Part], todo: _Pending) -> list[Part]:
    """Two sequences of siblings as one; what is inside them is left to ``todo``."""
    if len(a) == len(b) <= RUN and all(x.shape == y.shape and x.marked == y.marked and not x.repeated and not y.repeated for x, y in zip(a, b, strict=True)):
        return [_meet(x, y, todo) for x, y in zip(a, b, strict=True)]
    left, right = _runs(a), _runs(b)
    out, i, j = [], 0, 0
    for p, q in [*pairs([k for k, _ in left], [k for k, _ in right]), (len(left), len(right))]:
        for _, run in [*left[i:p], *right[j:q]]:
            out += _settled(run, todo)
        if p < len(left):
            x, y = left[p][1], right[q][1]
            if _one_by_one(x, y):
                out += [_meet(s, t, todo) for s, t in zip(x, y, strict=True)]
            else:
                head, tail = _ends(x, y)
                out += [_meet(s, t, todo) for s, t in zip(x[:head], y[:head], strict=True)]
                inner = [x[head : len(x) - tail], y[head : len(y) - tail]]
                folded = [_fold(part, todo) for part in inner if part]
                if len(folded) == 2:
                    folded = [_meet(*folded, todo)]
                for part in folded:
                    part.repeated = True
                out += folded
                out += [_meet(s, t, todo) for s, t in zip(x[len(x) - tail :], y[len(y) - tail :], strict=True)]
        i, j = p + 1, q + 1
    return out


def _settled(run: list, todo: _Pending) -> list[Part]:
    """A run as it goes into a wrapper: as it stands, or as one group if it is long or recurs."""
    if isinstance(run[0], list) or len(run) > RUN:
        return [_fold(run, todo)]
    return run


def merge(a: Part, b: Part) -> Part:
    """One wrapper for two, or for a wrapper and a page: level by level, for all parts of a level before any of the next."""
    todo = _Pending()
    _meet(a, b, todo)
    return _settle(a, todo)


def _settle(top: Part, todo: _Pending) -> Part:
    while todo.of:
        _, (part, bodies) = todo.of.popitem()
        for body in bodies:
            part.body = _level(part.body, body, todo)
    return top


def folded(top: Part) -> Part:
    """A page's parts as the wrapper of one page: long runs and recurring sequences become groups."""
    stack = [top]
    while stack:
        part, todo = stack.pop(), _Pending()
        if not part.body:
            continue
        part.body = [p for _, run in _runs(part.body) for p in _settled(run, todo)]
        _settle(part, todo)
        stack += part.body
    return top


def expression(top: Part) -> str:
    """The body of a wrapper as a regular expression without unions."""
    made: dict[int, str] = {}
    for p in reversed(_preorder(top)):
        inside = []
        for q in p.body:
            one = made.pop(id(q))
            sign = {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[q.seen < p.count, q.repeated]
            inside.append(f"({one}){sign}" if sign else one)
        body = " ".join(inside)
        made[id(p)] = (p.value or "#PCDATA") if p.shape == TEXT else body if p is top or p.shape.startswith("(") else f"<{p.shape}>{body}</{p.tag}>"
    return made[id(top)]


@dataclass
class Wrapper:
    """A wrapper of some distinct pages of a host."""

    top: Part | None = None

    def add(self, page: str) -> None:
        self.merge(Wrapper(folded(page_parts(parse(page)))))

    def merge(self, other: Wrapper) -> None:
        if other.top is not None:
            self.top = other.top if self.top is None else merge(self.top, other.top)

    def dump(self) -> str:
        rows, stack = [], [(self.top, 0)] if self.top else []
        while stack:
            part, depth = stack.pop()
            rows.append([depth, *part.row()])
            stack += [(p, depth + 1) for p in reversed(part.body)]
        return json.dumps(rows)

    @staticmethod
    def load(text: str) -> Wrapper:
        path: list[Part] = []
        for depth, *row in json.loads(text):
            part = Part(*row)
            del path[depth:]
            if path:
                path[-1].body.append(part)
            path.append(part)
        return Wrapper(path[0] if path else None)

    def decide(self) -> Wrapper:
        """Give parts their roles: ``main``, ``out`` (furniture, with all inside) and ``fixed`` (a text that never varies)."""
        if self.top is not None:
            _decide(self.top)
        return self

    def main_paths(self) -> list[list[str]]:
        out, stack = [], [(self.top, [])] if self.top else []
        while stack:
            part, path = stack.pop()
            if part.role == "main":
                out.append(path)
            else:
                stack += [(p, [*path, p.shape]) for p in reversed(part.body) if p.role != "out"]
        return out


def _preorder(top: Part) -> list[Part]:
    out, stack = [], [top]
    while stack:
        part = stack.pop()
        out.append(part)
        stack += reversed(part.body)
    return out


def _decide(top: Part) -> None:
    order, pages = _preorder(top), top.count
    for p in order:
        p.role = "out" if p.shape != TEXT and is_furniture(p.tag, p.shape) else ""
    _drop_marked(top, _weights(order, pages))
    weight = _weights(order, pages)
    mains = _outermost(top, {"article"})
    if mains and all(p.repeated for p in mains) and sum(weight[id(p)] for p in mains) < TEASER_SHARE * weight[id(top)]:
        for p in mains:
            p.role = "out"
        mains = []
    mains = mains or _outermost(top, {"main"}) or [p for p in order if p.shape.endswith("@main") and p.role != "out"]
    for main in mains:
        main.role = "main"
        weight = _weights(_preorder(main), 0)  # what other pages say doesn't count here
        nested = _outermost(main, {"article"})  # what readers say about an article is often an article inside it
        for p in nested if 2 * sum(weight[id(p)] for p in nested) < weight[id(main)] else []:
            p.role = "out"
        _drop_marked(main, weight)
    if not mains:
        main = _holder(top, weight, pages)
        main.role = "main"
        _drop_marked(main, _weights(_preorder(main), pages))
        for p in _preorder(main):
            if p is not main and p.role != "out" and _only_links(p):
                p.role = "out"
        if pages >= FEW_PAGES:
            _fix(main)


def _only_links(p: Part) -> bool:
    return bool(p.body) and p.tag in ("li", "div", "ul", "span", "td") and all(q.tag == "a" for q in p.body)


def _varies(p: Part, pages: int) -> bool:
    """Whether a text is not one and the same on several pages; where there are too few pages to tell, every text may vary."""
    return pages < FEW_PAGES or p.value is None or p.seen < FEW_PAGES


def _weights(order: list[Part], pages: int) -> dict[int, int]:
    """Characters inside each part: those that vary; what is out, and text of links outside of sentences, does not count."""
    weight: dict[int, int] = {}
    for p in reversed(order):
        if p.role == "out":
            weight[id(p)] = 0
        elif p.shape == TEXT:
            weight[id(p)] = p.mass if _varies(p, pages) else 0
        else:
            weight[id(p)] = 0 if _only_links(p) else sum(weight.get(id(q), 0) for q in p.body)
    return weight


def _holder(top: Part, weight: dict[int, int], pages: int) -> Part:
    """The smallest part that holds every sentence and heading that varies; lists, tables, paragraphs and what recurs are taken with their surroundings."""
    wanted: dict[int, int] = {}
    for p in reversed(_preorder(top)):
        if p.role == "out" or p.shape != TEXT and not weight[id(p)]:
            wanted[id(p)] = 0
        elif p.shape == TEXT:
            wanted[id(p)] = int(_varies(p, pages) and p.mass >= SENTENCE * p.count)
        else:
            wanted[id(p)] = 1 if p.tag in LABELS else sum(wanted[id(q)] for q in p.body)
    while True:
        inner = next((q for q in top.body if wanted[id(q)] and wanted[id(q)] == wanted[id(top)]), None)
        if inner is None or inner.shape == TEXT or inner.repeated or inner.tag in LABELS or inner.tag in ("p", "b", "span", "ul", "ol", "dl", "table", "tr", "pre", "blockquote"):
            return top
        top = inner


def _fix(main: Part) -> None:
    """Texts that every page has, and all alike, are ``fixed``, but for labels that stand before a text that varies."""
    texts: list[tuple[Part, bool, int | None]] = []  # (a text, whether it is constant and never missing, its label's number)
    stack: list[tuple[Part, bool, int | None]] = [(p, True, None) for p in reversed(main.body)]
    while stack:
        p, always, label = stack.pop()
        if p.role == "out":
            continue
        always = always and not p.repeated and p.seen == p.count == main.count
        if p.shape == TEXT:
            texts.append((p, always and p.value is not None, label))
        else:
            label = id(p) if p.tag in LABELS else label
            stack += [(q, always, label) for q in reversed(p.body)]
    after: tuple[bool, int | None] = (True, None)  # whether the text after is constant, and its label
    varies_after = False
    for p, constant, label in reversed(texts):
        if label is None or label != after[1]:
            varies_after = not after[0]
        if constant and not (label is not None and varies_after):
            p.role = "fixed"
        after = (constant, label)


def _drop_marked(top: Part, weight: dict[int, int]) -> None:
    """Parts whose names tell of furniture go; where little would be left, the heaviest stays, and is looked into."""
    while top is not None:
        marked, stack = [], list(top.body)
        while stack:
            p = stack.pop()
            if p.marked and p.role != "out":
                marked.append(p)
            elif p.role != "out":
                stack += p.body
        for p in marked:
            p.role = "out"
        rest = weight[id(top)] - sum(weight[id(p)] for p in marked)
        top = max(marked, key=lambda p: weight[id(p)]) if marked and rest < (1 - MARKED_SHARE) * weight[id(top)] else None
        if top is not None:
            top.role = ""


def _outermost(top: Part, tags: set[str]) -> list[Part]:
    out, stack = [], list(reversed(top.body))
    while stack:
        p = stack.pop()
        if p.role == "out":
            continue
        if p.tag in tags:
            out.append(p)
        else:
            stack += reversed(p.body)
    return out


def infer(pages: list[str]) -> Wrapper:
    """The wrapper of a host's pages."""
    found = Wrapper()
    for page in dict.fromkeys(pages):
        found.add(page)
    return found.decide()


def _matched(wrapper: list[Part], page: list[Part]) -> dict[int, Part]:
    """The part of a wrapper's body that each part of a page's body falls on, by ``id``."""
    if len(wrapper) == len(page) <= RUN and all(p.shape == q.shape and p.marked == q.marked and not p.repeated for p, q in zip(wrapper, page, strict=True)):
        return {id(q): p for p, q in zip(wrapper, page, strict=True)}
    out: dict[int, Part] = {}
    left = []
    for p in wrapper:
        if left and left[-1][0] == p.key:
            left[-1][1].append(p)
        else:
            left.append((p.key, [p]))
    right = _runs(page)
    for i, j in pairs([k for k, _ in left], [k for k, _ in right]):
        x, y = left[i][1], right[j][1]
        if isinstance(y[0], list):
            for rounds in y:
                for one in rounds:
                    out.update((id(q), p) for q, p in zip(one, x[0].body, strict=True))
            continue
        if _one_by_one(x, y):
            out.update((id(q), p) for p, q in zip(x, y, strict=True))
            continue
        head, tail = _ends(x, y)
        head, tail = min(head, len(x) - 1), min(tail, max(0, len(x) - 1 - head))
        for k, q in enumerate(y):
            at = k if k < head else len(x) - (len(y) - k) if k >= len(y) - tail else next((n for n, p in enumerate(x) if p.repeated), head)
            out[id(q)] = x[at]
    return out


def read_by(root: Node, wrapper: Wrapper) -> str | None:
    """The text that falls on kept parts of the wrapper, its blocks joined by line feeds; None if its main part is nowhere in the page."""
    if wrapper.top is None:
        return None
    blocks: list[list[tuple[str, bool]]] = [[]]
    top = page_parts(root)
    found = wrapper.top.role == "main"
    # (element, its part, the wrapper's part, whether inside the main part); None ends a block
    stack: list = [(root, top, wrapper.top, found)]
    while stack:
        here = stack.pop()
        if here is None:
            blocks.append([])
            continue
        if isinstance(here[0], str):
            blocks[-1].append(here)
            continue
        node, part, met, main = here
        if node is not root and node.tag in BLOCK:
            blocks.append([])
            stack.append(None)
        known = _matched(met.body, part.body) if met is not None else {}
        own, later = iter(part.body), []
        for x in node.parts:
            if isinstance(x, str):
                p = known.get(id(next(own))) if x.strip() else None
                if main:
                    later.append((x, p is not None and p.role == "fixed"))
                continue
            mine = next(own)
            p = known.get(id(mine))
            begins = p.role == "main" if p is not None else x.tag == "article" and not main
            if is_furniture(x.tag, x.shape) or p is not None and p.role == "out" or p is None and main and x.marked or x.tag == "header" and not (main or begins):
                if main and (x.tag in BLOCK or x.tag not in ("label", "button", "input", "svg", "math", "script", "style")):
                    later.append(None)
                continue
            if begins:
                found = True
                later += [None, (x, mine, p, True), None]
            else:
                later.append((x, mine, p, main))
        stack += reversed(later)
    if not found:
        return None
    # a line goes if all of it is fixed; a fixed label beside a slot stays
    kept = [b for b in blocks if any(text.strip() and not fixed for text, fixed in b)]
    lines = [" ".join("".join(text for text, _ in b).split()) for b in kept]
    return "\n".join(x for x in lines if x)


def extract(page: str, wrapper: Wrapper | None) -> str:
    """The main text of a page by its host's wrapper (with roles), or by its own where that one finds no main part."""
    root = parse(page)
    text = read_by(root, wrapper) if wrapper is not None else None
    return text if text is not None else read_by(root, infer([page])) or ""


# ---- Spark


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def distinct_pages(rows: DataFrame) -> DataFrame:
    """``rows`` (host, html) without repeats; only repeated pages are shuffled, combined before."""
    keyed = rows.withColumn("key", F.xxhash64("host", "html"))
    repeats = materialize(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated-pages")
    side = F.broadcast(repeats) if repeats.count() <= BROADCAST_REPEATS else repeats
    again = keyed.join(side, "key", "left_semi").groupBy("host", "html").agg(F.lit(1).alias("one"))
    return keyed.join(side, "key", "left_anti").select("host", "html").union(again.select("host", "html"))


def learn_wrappers(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, wrapper as JSON, pages), from all distinct pages: partial wrappers by task, then aligned about ``FAN_IN`` at a time."""
    small_batches(pages.sparkSession)
    rows = distinct_pages(pages.select(host_of(F.col(url)).alias("host"), F.coalesce(html, F.lit("")).alias("html")))
    schema = "host string, partial string, pages long"

    def frame(found: list[tuple[str, Wrapper]]) -> pd.DataFrame:
        return pd.DataFrame([(h, w.dump(), w.top.count) for h, w in found], columns=["host", "partial", "pages"])

    def begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Wrapper] = {}  # the host met last stands last
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                held[host] = held.pop(host, None) or Wrapper()
                held[host].add(page)
                if len(held) > OPEN_HOSTS:
                    cold = list(held)[: OPEN_HOSTS // 2]
                    yield frame([(h, held.pop(h)) for h in cold])
        yield frame(list(held.items()))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        out = Wrapper()
        for text in sorted(pdf["partial"]):
            out.merge(Wrapper.load(text))
        return frame([(pdf["host"].iloc[0], out)])

    found = materialize(rows.mapInPandas(begin, schema), "wrappers")
    while True:
        held = found.groupBy("host").agg(F.count("*").alias("n")).where("n > 1")
        most = held.agg(F.max("n")).first()[0]
        if most is None:
            return found.select("host", F.col("partial").alias("wrapper"), "pages")
        # a host with many partial wrappers deals them to groups that meet next
        told = join_hot(found, held.withColumn("copies", F.col("n")), ["host"], "copies", found.count(), ["partial"], "left")
        slot = F.pmod(F.xxhash64("partial"), F.ceil(F.col("n") / FAN_IN)).alias("slot")
        met = told.where("n > 1").groupBy("host", slot).applyInPandas(join, schema)
        found, before = materialize(told.where("n IS NULL").select("host", "partial", "pages").union(met), "wrappers"), found
        release(before)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", out: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``pages`` with ``out``: the main text of each page, empty if it has none.

    A null page counts as empty; a null or odd address as one host of its own.
    Rows may repeat (a repeated page reads as if it stood once), nest to any
    depth and be of any length.  An empty table gives no rows.  A column already
    named like the output is replaced.  Where all wrappers together are small
    (``broadcast_bytes``), every task gets them; otherwise pages are dealt to
    the wrapper of their host, those of a large host over many tasks.
    """
    spark = pages.sparkSession
    small_batches(spark)
    keep = carried(pages, [out])
    wrappers = learn_wrappers(pages, url, html)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host")).alias("n"), F.sum("pages").alias("pages")).first()
    kinds = {f.name: f.dataType for f in pages.schema}
    result = ", ".join([*(f"`{c}` {kinds[c].simpleString()}" for c in keep), f"`{out}` string"])
    if (size.n or 0) <= broadcast_bytes:
        shared = spark.sparkContext.broadcast({r.host: r.wrapper for r in wrappers.select("host", "wrapper").collect()})

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            known: dict[str, Wrapper] = {}
            for pdf in batches:
                texts = []
                for host, page in zip(pdf["__tarn_host"], pdf["__tarn_html"], strict=True):
                    if host not in known:
                        known[host] = Wrapper.load(shared.value[host]).decide()
                    texts.append(extract(page, known[host]) if page else "")
                yield pdf[keep].assign(**{out: texts})

        rows = pages.select(*keep, host_of(F.col(url)).alias("__tarn_host"), F.col(html).alias("__tarn_html"))
        return rows.mapInPandas(run, result)

    hot = max(HOT_LEAST, size.pages // HOT_SHARE)
    salts = wrappers.withColumn("salts", F.greatest(F.lit(1), F.ceil(F.col("pages") / hot)).cast("int"))
    large = F.broadcast(salts.where("salts > 1").select("host", "salts"))  # fewer than HOT_SHARE hosts
    rows = pages.select(host_of(F.col(url)).alias("host"), F.struct(*keep).alias("row"), F.col(html).alias("html"))
    salt = F.pmod(F.xxhash64("html"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt")
    rows = rows.join(large, "host", "left").select("host", salt, F.lit(1).alias("kind"), "html", "row")
    first = salts.select("host", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("kind"), F.col("wrapper").alias("html"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = first.unionByName(rows, allowMissingColumns=True).repartition(parts, "host", "salt").sortWithinPartitions("host", "salt", "kind")

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """A host's wrapper comes right before its pages."""
        wrapper = None
        for pdf in batches:
            made = []
            for kind, page, row in zip(pdf["kind"], pdf["html"], pdf["row"], strict=True):
                if kind == 0:
                    wrapper = Wrapper.load(page).decide()
                else:
                    made.append((*[row[c] for c in keep], extract(page, wrapper) if page else ""))
            yield pd.DataFrame(made, columns=[*keep, out])

    return dealt.mapInPandas(follow, result)
