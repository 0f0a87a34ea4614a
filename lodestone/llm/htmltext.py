"""Main text of web pages by a tree-structured graphical model over their elements.

Each element is main text or not. An element's own potential comes from its tag, names, place,
links, text and share of the page, by weighted features; each parent and child are tied by a potential
that depends on the child's tag. Both are learned together from labelled pages, by the gradient of
their likelihood. One upward and one downward pass of sum-product messages give every
element's exact marginal; the text that stands directly in elements whose marginal is over one half
is the page's main text.

White space inside a block becomes one space, blocks are joined by one space, and character
references are decoded once. Scripts, styles, titles, text areas and comments are no text. Formulas
are inline text; what stands in other embedded elements (svg, select, object, video, audio, canvas,
iframe, noscript, template) is judged as in any element. html and body are the page itself.

Defined results: null and empty pages have no text; broken markup is read as browsers do in the common
cases (open paragraphs end at the next block, and so do drawings, formulas and selections; of players, frames
and other embedded elements without their end only the tag is dropped; an unfinished tag at the end is
dropped, and so is the rest of the page after a script, style, title or text area without its end); a
page without main text gives an empty string. Reading takes time in proportion to the page, however deep its elements are.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import annotate

#: Fixed values of HTML: elements without content, with raw content, and those that don't break a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
#: Formulas are inline text.
MATH = frozenset("math annotation annotation-xml maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
INLINE = MATH | frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: In these an element may end itself by a slash, and titles and text areas aren't raw.
FOREIGN = frozenset({"svg", "math"})
#: A block that starts ends these where they are open, except inside of what holds HTML of its own.
BROKEN, HOLDS = FOREIGN | {"select"}, frozenset({"foreignobject", "annotation-xml"})
#: Embedded elements: without their end nothing is in them.
EMBEDDED = frozenset("object video audio canvas iframe noscript template".split())
#: What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
#: A start tag closes these open elements, up to the given borders.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_P, _P_BORDERS = {"p"}, {"table", "article", "section", "div", "main", "button"}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"""(?:^|[\s"'])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_MARK = re.compile(r'data-main="([01])"')
_ENDS = re.compile(rf"<(/?)({'|'.join(sorted(EMBEDDED))})(?=[\s/>])", re.I)


class Open:
    """The elements that are open, with the places of each name, so that no question walks over all of them."""

    def __init__(self):
        self.elements, self.names, self._at = [0], ["#page"], {}
        self._blocks = [0]

    def push(self, k: int, name: str) -> None:
        self._at.setdefault(name, []).append(len(self.elements))
        if name not in INLINE:
            self._blocks.append(len(self.elements))
        self.elements.append(k)
        self.names.append(name)

    def place(self, name: str) -> int:
        """Of the innermost element of this name; 0 if none is open."""
        at = self._at.get(name)
        return at[-1] if at else 0

    def innermost(self, names) -> int:
        return max(map(self.place, names))

    def first_after(self, name: str, border: int) -> int:
        """Place of the outermost element of this name that lies within the border; 0 if there is none."""
        at = self._at.get(name, ())
        i = bisect_right(at, border)
        return at[i] if i < len(at) else 0

    def block(self) -> int:
        return self._blocks[-1]

    def cut(self, place: int) -> None:
        """Ends the element at this place and all in it."""
        for name in self.names[:place - 1 if place else 0:-1] if place else ():
            self._at[name].pop()
            if name not in INLINE:
                self._blocks.pop()
        del self.elements[place:], self.names[place:]


class Page:
    """Elements in document order, each after its parent, and the text that stands directly in them."""

    __slots__ = ("tag", "names", "parent", "marks", "texts", "own", "linked", "stops", "rights")

    def __init__(self, source: str):
        self.tag, self.names, self.parent, self.marks = ["#page"], [""], [-1], [None]
        self.own, self.linked, self.stops, self.rights = [0], [0], [0], [0]
        self.texts: list[tuple[int, str]] = []  # element, text; -1 is the border of a block
        self._read(source)

    def _read(self, s: str) -> None:
        open_, at, n = Open(), 0, len(s)
        texts, unended = self.texts, None
        while at < n:
            low = s.find("<", at)
            if low < 0:
                self._text(open_, s[at:])
                return
            if low > at:
                self._text(open_, s[at:low])
            after = s[low + 1 : low + 2]
            if after in ("!", "?"):
                end = s.find("-->", low + 4) + 2 if s.startswith("<!--", low) else s.find(">", low)
                if end < low + 1:
                    return
                at = end + 1
                continue
            m = _TAG.match(s, low) or _LOOSE.match(s, low)
            if not m:
                if after.isalpha() or after == "/":  # not finished
                    return
                self._text(open_, "<")
                at = low + 1
                continue
            at = m.end()
            name = m[2].lower()
            inline = name in INLINE
            if not inline:
                texts.append((-1, ""))
            if m[1]:
                place = open_.place(name)
                if place and not (inline and place < open_.block()):
                    open_.cut(place)
                continue
            if name in ("html", "body"):
                if head := open_.place("head"):
                    open_.cut(head)
                self._describe(0, m[3])
                continue
            foreign = (name in RAW or m[3].endswith("/")) and self._foreign(open_, name)
            if foreign and m[3].endswith("/"):
                continue
            if name in RAW and not m[3].endswith("/") and not (foreign and name in ("textarea", "title")):
                end = _RAW_END[name].search(s, at)
                if end is None:
                    return
                at = end.end()
                continue
            if name in VOID:
                continue
            if name in EMBEDDED:
                unended = _unended(s) if unended is None else unended
                if low in unended:
                    continue
            if name not in IN_HEAD and open_.names[-1] == "head":
                open_.cut(len(open_.names) - 1)
            if name in CLOSES:
                self._close(open_, *CLOSES[name])
            elif name in CLOSES_P:
                self._break_out(open_)
                self._close(open_, _P, _P_BORDERS)
            k = len(self.tag)
            self.tag.append(name)
            self.names.append("")
            self.marks.append(None)
            self.parent.append(open_.elements[-1])
            for counts in (self.own, self.linked, self.stops, self.rights):
                counts.append(0)
            self._describe(k, m[3])
            open_.push(k, name)

    def _describe(self, k: int, attributes: str) -> None:
        if attributes:
            if found := _NAMES.findall(attributes):
                self.names[k] = " ".join(x.strip("\"'") for x in found).lower()
            if mark := _MARK.search(attributes):
                self.marks[k] = mark[1]

    @staticmethod
    def _close(open_: Open, these: set, borders: set) -> None:
        place = open_.innermost(these)
        if place and place > open_.innermost(borders):
            open_.cut(place)

    @staticmethod
    def _foreign(open_: Open, name: str) -> bool:
        """Whether an element of this name that starts now belongs to a drawing or a formula."""
        return name in FOREIGN or open_.innermost(FOREIGN) > open_.innermost(HOLDS)

    @staticmethod
    def _break_out(open_: Open) -> None:
        """Ends the outermost open drawing, formula or selection."""
        if open_.innermost(BROKEN):
            border = max(open_.innermost(HOLDS), open_.innermost(CLOSES_P))
            if within := [x for name in BROKEN if (x := open_.first_after(name, border))]:
                open_.cut(min(within))

    def _text(self, open_: Open, text: str) -> None:
        k = open_.elements[-1]
        size = len(text) - text.count(" ")
        if size and open_.names[-1] == "head" and text.strip():
            open_.cut(len(open_.names) - 1)
            k = open_.elements[-1]
        self.texts.append((k, text))
        if size:
            self.own[k] += size
            self.stops[k] += text.count(".") + text.count("!") + text.count("?") + text.count(",")
            if "©" in text or "&copy;" in text or "&#169;" in text or "opyright" in text:
                self.rights[k] = 1
            if open_.place("a"):
                self.linked[k] += size


_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I) for name in RAW}


def _unended(s: str) -> set[int]:
    """Where embedded elements start that have no end of their own."""
    waiting: dict[str, list[int]] = {}
    for m in _ENDS.finditer(s):
        held = waiting.setdefault(m[2].lower(), [])
        if not m[1]:
            held.append(m.start())
        elif held:
            held.pop()
    return {x for held in waiting.values() for x in held}


#: Elements whose text is their parent's as well: what stands in them, stands in its flow.
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre figure b strong i em font span center tt small big".split())


def _size(n: int) -> int:
    return 0 if n == 0 else 1 + min(6, int(math.log2(n)) // 2)


def _share(part: int, whole: int) -> int:
    """In eighths, but all and nearly nothing apart."""
    return 0 if not part else 1 + min(8, 8 * part // whole)


def signatures(page: Page) -> list[tuple]:
    """What an element's own potential depends on: tag, names, parent's tag; share of links, of the page's unlinked text in
    the element and straight in its flow; sizes of its own and of all text, how dense its stops are, and whether rights are claimed."""
    n = len(page.tag)
    tag, parent = page.tag, page.parent
    total, links, stops, rights = list(page.own), list(page.linked), list(page.stops), list(page.rights)
    flow = [a - b for a, b in zip(page.own, page.linked)]
    for k in range(n - 1, 0, -1):
        up = parent[k]
        total[up] += total[k]
        links[up] += links[k]
        stops[up] += stops[k]
        if tag[k] in FLOW:
            flow[up] += flow[k]
            rights[up] |= rights[k]
    plain = max(1, total[0] - links[0])
    largest = max(flow)
    out = []
    for k in range(n):
        up, all_ = parent[k], total[k]
        density = 0 if not all_ else 1 + min(4, 5 * links[k] // all_)
        stop = 0 if not stops[k] else 1 + min(4, 200 * stops[k] // all_)
        out.append((tag[k], page.names[k], tag[up] if up >= 0 else "", density, _size(page.own[k]), _size(all_), _share(all_ - links[k], plain), _share(flow[k], plain), stop, rights[k], flow[k] == largest, up >= 0 and 2 * flow[k] >= largest))
    return out


def features(sig: tuple) -> list[str]:
    tag, names, up, density, own, total, share, flow, stop, rights, largest, large = sig
    words = set(re.findall(r"[a-z]+", names))
    boxed = tag if tag in _KNOWN else "*"
    out = ["bias", f"t:{boxed}", f"t:{boxed}^{up if up in _KNOWN else '*'}", f"d:{density}", f"o:{own}", f"s:{total}", f"td:{boxed}:{density}", f"h:{share}", f"f:{flow}", f"p:{stop}", f"dp:{density}:{stop}", f"fd:{flow}:{density}", f"sp:{total}:{stop}"]
    out += [f"n:{w}" for w in words]
    if rights:
        out.append("rights")
    if largest:
        out += ["largest", f"largest:{boxed}"]
    elif large:
        out.append("large")
    return out


_KNOWN = CLOSES_P | FOREIGN | EMBEDDED | HOLDS | {"#page", "head", "select", "option", "button", "label", "a", "b", "i", "em", "span", "font", "center", "li", "td", "th", "tr", "tbody", "body", "aside", "blockquote"}


def _messages(parent: list[int], own: list[float], edges: list[tuple]) -> tuple[list[float], list[float]]:
    """(log odds of each element's marginal, messages to parents): sum-product upward, then downward.

    edges: of each element the potentials of (parent, child) labels."""
    n, log, exp = len(parent), math.log, math.exp
    inward, message = list(own), [0.0] * n
    for k in range(n - 1, 0, -1):
        e00, e01, e10, e11 = edges[k]
        x = exp(max(-60.0, min(60.0, inward[k])))
        message[k] = log((e10 + e11 * x) / (e00 + e01 * x))
        inward[parent[k]] += message[k]
    full = list(inward)
    for k in range(1, n):
        e00, e01, e10, e11 = edges[k]
        x = exp(max(-60.0, min(60.0, full[parent[k]] - message[k])))
        full[k] = inward[k] + log((e01 + e11 * x) / (e00 + e10 * x))
    return full, message


class Model:
    """weights of features, and for a child's tag the potentials of (parent, child) labels."""

    def __init__(self, weights: dict[str, float], edges: dict[str, tuple[float, ...]]):
        self.weights, self.edges = weights, edges
        self._default = edges["*"]
        self._own = lru_cache(100_000)(lambda sig: sum(weights.get(f, 0.0) for f in features(sig)))

    def __reduce__(self):
        return Model, (self.weights, self.edges)

    def log_odds(self, page: Page) -> list[float]:
        """Log odds of each element's marginal."""
        own = [max(-30.0, min(30.0, self._own(s))) for s in signatures(page)]
        return _messages(page.parent, own, [self.edges.get(t, self._default) for t in page.tag])[0]

    def text(self, source: str | None) -> str:
        if not source:
            return ""
        page = Page(source)
        odds = self.log_odds(page)
        parts = [" " if k < 0 else text if odds[k] > 0 else "" for k, text in page.texts]
        blocks = "".join(parts)
        if "&" in blocks:
            # blocks are decoded one by one, so that no reference spans two of them
            pieces, held = [], []
            for k, text in page.texts:
                if k < 0:
                    pieces.append("".join(held))
                    held = []
                elif odds[k] > 0:
                    held.append(text)
            pieces.append("".join(held))
            blocks = " ".join(html.unescape(p) for p in pieces)
        return " ".join(x for x in _WHITE.split(blocks) if x)


_WHITE = re.compile(r"\s+")


def labels(page: Page) -> list[int]:
    out = []
    for k, mark in enumerate(page.marks):
        out.append(int(mark) if mark is not None else 0 if k == 0 or page.tag[k] == "head" else out[page.parent[k]])
    return out


def train(sources: list[str], epochs: int = 5, rate: float = 0.4, decay: float = 2e-4) -> Model:
    """From pages whose elements are marked with data-main: own potentials and ties together, by the gradient of the labels'
    likelihood (what is seen less what the marginals expect), page by page with a step that shrinks for each weight as it moves."""
    number: dict = {}
    rows = []
    for source in sources:
        page = Page(source)
        at = [[number.setdefault(f, len(number)) for f in features(sig)] for sig in signatures(page)]
        rows.append((page.parent, at, page.tag, labels(page)))
    w, seen = [0.0] * len(number), [1e-8] * len(number)
    ties: dict[str, list[float]] = {"*": [0.0] * 4}  # logs of (parent, child) potentials
    moved: dict[str, list[float]] = {"*": [1e-8] * 4}
    exp = math.exp
    squash = lambda x: 1 / (1 + exp(-x)) if x > -60 else 0.0
    for epoch in range(epochs):
        potential = lambda t: tuple(exp(ties["*"][i] + ties.get(t, _NONE)[i]) for i in range(4))
        for i in np.random.default_rng(epoch).permutation(len(rows)).tolist():
            parent, at, tag, y = rows[i]
            own = [max(-30.0, min(30.0, sum(w[f] for f in fs))) for fs in at]
            known = {t: potential(t) for t in set(tag)}
            full, message = _messages(parent, own, [known[t] for t in tag])
            slope: dict[int, float] = {}
            bend: dict[str, list[float]] = {}
            for k, fs in enumerate(at):
                g = squash(full[k]) - y[k]
                if abs(g) > 1e-4:
                    for f in fs:
                        slope[f] = slope.get(f, 0.0) + g
                if k:
                    e00, e01, e10, e11 = known[tag[k]]
                    up = exp(max(-60.0, min(60.0, full[parent[k]] - message[k])))  # odds without this child
                    down = exp(max(-60.0, min(60.0, full[k] - math.log((e01 + e11 * up) / (e00 + e10 * up)))))  # without the parent
                    p = (e00, e01 * down, e10 * up, e11 * up * down)
                    all_ = sum(p)
                    for t in ("*", tag[k]):
                        b = bend.setdefault(t, [0.0] * 4)
                        for j in range(4):
                            b[j] += p[j] / all_
                        b[2 * y[parent[k]] + y[k]] -= 1
            for f, g in slope.items():
                g += decay * w[f]
                seen[f] += g * g
                w[f] -= rate * g / math.sqrt(seen[f])
            for t, b in bend.items():
                tie, m = ties.setdefault(t, [0.0] * 4), moved.setdefault(t, [1e-8] * 4)
                for j in range(4):
                    g = b[j] + decay * tie[j]
                    m[j] += g * g
                    tie[j] = max(-4.0, min(4.0, tie[j] - 0.25 * rate * g / math.sqrt(m[j])))
    edges = {t: tuple(exp(ties["*"][i] + (x[i] if t != "*" else 0.0)) for i in range(4)) for t, x in ties.items()}
    return Model({f: w[i] for f, i in number.items()}, edges)


_NONE = [0.0] * 4


def extract(pages: DataFrame, model: Model, source: str = "html", keep: list[str] | None = None, name: str = "text") -> DataFrame:
    """pages' columns in keep and the main text. The model is a few hundred weights."""
    weights, edges = model.weights, model.edges

    def make():
        own = Model(weights, edges)
        return lambda column: [pa.array([own.text(x.as_py()) for x in column], pa.string())]

    return annotate(pages, [source], make, [T.StructField(name, T.StringType())], keep)
