"""Labelled pages for the extraction model: invented pages whose elements are known to be main text or not.

A page is of one of FAMILIES, ways in which sites lay out a page: by elements that say what they
are, by names, by names nobody knows, without any name, by tables, by line breaks alone. An
element is marked with data-main="1" or "0" and its descendants follow it; marks of html and body are the
page's own. pages() always gives the same pages; a family can be left out, to be judged by a model that never saw it.
"""

from __future__ import annotations

import random

#: Names that page authors commonly give to the parts of a page.
MAIN = ["article", "content", "post", "entry", "main", "story", "text", "body"]
FURNITURE = ["ad", "ads", "advert", "banner", "sponsor", "promo", "menu", "navbar", "nav", "breadcrumb", "share", "social", "sidebar", "widget", "related", "newsletter", "subscribe", "cookie", "consent", "notice", "popup", "comments", "comment", "header", "footer", "copyright", "login", "search", "pagination", "tags", "toc", "infobox", "advertisement", "sponsored", "breadcrumbs", "sharing", "follow", "toolbar", "masthead", "disclaimer", "legal", "feedback", "respond", "replies", "discussion", "cookies", "signup"]
EMBEDDED = ["object", "video", "audio", "canvas", "iframe", "noscript", "template"]
_LETTERS = ["aeiourstlnmdkp", "eainrsthdlucg", "oaeisnrldtcm", "éaoueinrstlmdp", "äeiünrstchgbk"]


class Writer:
    """Words, sentences and blocks of one page."""

    def __init__(self, r: random.Random):
        self.r, self.letters = r, r.choice(_LETTERS)

    def words(self, low: int, high: int) -> str:
        return " ".join("".join(self.r.choice(self.letters) for _ in range(self.r.randint(2, 9))) for _ in range(self.r.randint(low, high)))

    def sentences(self, low: int, high: int) -> str:
        out = []
        for _ in range(self.r.randint(low, high)):
            x = self.words(2, 16).capitalize()
            out.append(x.replace(" ", ", ", self.r.random() < 0.4) + self.r.choice(".....!?"))
        return " ".join(out)

    def name(self) -> str:
        """One that says nothing."""
        return "".join(self.r.choice("bcdfghjkqvwxyz") for _ in range(self.r.randint(2, 5))) + self.r.choice(["", "-1", "_x", "9"])

    def named(self, names: list[str]) -> str:
        return f'{self.r.choice(["class", "class", "id"])}="{self.r.choice(names)}{self.r.choice(["", "", "", "-wrap", " " + self.name()])}"'

    # --- what isn't main text ---

    def links(self, low: int = 2, high: int = 12) -> str:
        link = lambda: f'<a href="/{self.name()}">{self.words(1, 3)}</a>'
        n, kind = self.r.randint(low, high), self.r.random()
        if kind < 0.6:
            return "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>"
        if kind < 0.8:
            return self.r.choice([" | ", " &middot; ", " ", "<br>"]).join(link() for _ in range(n))
        return "".join(f"<div>{link()}</div>" for _ in range(n))

    def form(self) -> str:
        return f'<form data-main="0" action="/s"><label>{self.words(1, 5)}</label><input name="q"><select><option>{self.words(1, 2)}<option>{self.words(1, 2)}</select><textarea>{self.words(1, 9)}</textarea><button>{self.words(1, 2)}</button></form>'

    def rights(self) -> str:
        return self.r.choice(["&copy; ", "&#169; ", "© ", "Copyright "]) + self.r.choice(["", "2019 ", "2024 "]) + self.r.choice([self.words(1, 4), f"{self.words(1, 3)} &middot; {self.sentences(1, 3)}", f'{self.words(1, 2)} <a href="/p">{self.words(1, 2)}</a>'])

    def furniture(self, names: bool = True, inside: bool = False) -> str:
        """With names, elements may be called what they are; without, only their kind and text tell. Inside of a text no page's header stands."""
        kind = self.r.uniform(0.28, 1) if inside else self.r.random()
        if kind < 0.2:
            return f'<nav data-main="0">{self.links()}</nav>'
        if kind < 0.28:
            return f'<header data-main="0"><h1>{self.words(1, 4)}</h1><p>{self.sentences(1, 1)}</p></header>'
        if kind < 0.42:
            return f'<footer data-main="0">{self.r.choice([self.rights(), self.links() + self.rights(), f"<p>{self.rights()}</p>"])}</footer>'
        if kind < 0.5:
            return self.form()
        if kind < 0.58:
            return f'<aside data-main="0">{self.r.choice([self.links(), f"<h3>{self.words(1, 3)}</h3>{self.links()}", f"<p>{self.sentences(1, 3)}</p>"])}</aside>'
        if not names or kind < 0.68:
            how = self.r.choice(["", f' class="{self.name()}"'])
            head = self.r.choice(["", f"<h3>{self.words(1, 3)}</h3>", f"<h4>{self.words(1, 3)}</h4>", f"<b>{self.words(1, 2)}</b>"])
            return f'<div data-main="0"{how}>{head}{self.links(3)}</div>'
        inner = self.r.choice([self.sentences(1, 4), self.words(1, 6), f"<p>{self.sentences(1, 4)}</p>", f"<p>{self.sentences(1, 4)}</p><p>{self.sentences(1, 4)}</p>", f"<h3>{self.words(1, 4)}</h3>{self.links()}", f'<div class="author">{self.words(1, 2)}</div><p>{self.sentences(1, 4)}</p>', f"<span>{self.words(1, 6)}</span><button>{self.words(1, 2)}</button>", self.links()])
        tag = self.r.choice(["div", "div", "div", "section", "aside", "p"])
        return f'<{tag} data-main="0" {self.named(FURNITURE)}>{inner if tag != "p" else self.sentences(1, 2)}</{tag}>'

    def embedded(self) -> str:
        """Drawings, players and frames; what they say instead of themselves is no main text."""
        kind = self.r.random()
        if kind < 0.45:
            return f'<svg data-main="0" viewBox="0 0 9 9"><g><path d="M0 0"/><text>{self.words(1, 3)}</text>{self.r.choice(["", f"<svg><text>{self.words(1, 3)}</text></svg>"])}</g><title>{self.words(1, 3)}</title></svg>'
        if kind < 0.6:
            return f'<select data-main="0"><option>{self.words(1, 2)}</option><option>{self.words(1, 2)}</option></select>'
        tag = self.r.choice(EMBEDDED)
        return f'<{tag} data-main="0">{self.r.choice(["", self.words(2, 9), f"<p>{self.sentences(1, 1)}</p>", self.sentences(1, 2)])}</{tag}>'

    # --- main text ---

    def paragraph(self) -> str:
        kind = self.r.random()
        if kind < 0.7:
            return f"<p>{self.sentences(1, 8)}</p>"
        if kind < 0.78:
            return f"<p><b>{self.words(1, 20).capitalize()}<br>"
        if kind < 0.84:
            return f"<p>{self.words(1, 8)}</p>"
        return f"<p>{self.sentences(1, 3)} <b>{self.words(1, 4)}</b> <a href='/x'>{self.words(1, 4)}</a>, <em>{self.words(1, 9)}</em> {self.sentences(1, 3)}</p>"

    def block(self) -> str:
        kind = self.r.random()
        if kind < 0.74:
            return self.paragraph()
        if kind < 0.83:
            return f"<h{(n := self.r.randint(2, 4))}>{self.words(1, 9).capitalize()}</h{n}>"
        if kind < 0.88:
            link = lambda: f"<a href='/x'>{self.words(1, 3)}</a> {self.words(1, 3)} " if self.r.random() < 0.5 else ""
            linked, tag = self.r.random() < 0.4, self.r.choice(["ul", "ul", "ol"])
            return f"<{tag}>" + "".join(f"<li>{link() if linked else ''}{self.sentences(1, 2)}</li>" for _ in range(self.r.randint(1, 8))) + f"</{tag}>"
        if kind < 0.91:
            return f"<blockquote><p>{self.sentences(1, 3)}</p></blockquote>"
        if kind < 0.94:
            head = f"<tr><th>{self.words(1, 2)}</th><th>{self.words(1, 2)}</th></tr>" * (self.r.random() < 0.6)
            return f"<table>{head}" + "".join(f"<tr><td>{self.words(1, 4)}</td><td>{self.words(1, 4)}</td></tr>" for _ in range(self.r.randint(1, 4))) + "</table>"
        if kind < 0.96:
            return f"<p>{self.words(1, 6)} <math><mi>x</mi><mo>=</mo><mn>1</mn></math> {self.sentences(1, 2)}</p>"
        if kind < 0.97:
            return f'<svg data-main="0"><g/><foreignObject data-main="1"><p>{self.sentences(1, 2)}</p></foreignObject></svg>'
        if kind < 0.98:
            return f"<pre>{self.words(2, 12)}</pre>"
        return f"<figure><img src='a.png'><figcaption>{self.sentences(1, 1)}</figcaption></figure>"

    def blocks(self, inside: bool = True) -> list[str]:
        if self.r.random() < 0.06:
            return [self.r.choice([self.words(1, 8).capitalize(), self.sentences(1, 3), f"<p>{self.words(1, 6).capitalize()}</p>", f"<h1>{self.words(1, 5).capitalize()}</h1>"])]
        out = [f"<h1>{self.words(2, 12).capitalize()}</h1>"] * (self.r.random() < 0.85)
        out += [self.paragraph()] + [self.block() for _ in range(self.r.choice([0, 1, 2, 3, 5, 8, 12, 20]))]
        for _ in range(self.r.choice([0, 0, 0, 1, 2]) if inside else 0):
            out.insert(self.r.randint(1, len(out)), self.furniture(inside=True) if self.r.random() < 0.5 else self.embedded())
        return out

    def around(self, main: str, names: bool = True, most: int = 4) -> str:
        some = lambda: "".join(self.furniture(names) for _ in range(self.r.randint(0, most)))
        return f"{some()}{main}{some()}"


def _semantic(w: Writer) -> str:
    tag, blocks = w.r.choice(["article", "article", "main"]), w.blocks()
    if blocks[0].startswith("<h1") and w.r.random() < 0.2:  # a title's own header belongs to the text
        blocks[0] = f'<header>{blocks[0]}{w.r.choice(["", f"""<p data-main="0" class="byline">{w.words(1, 4)}</p>"""])}</header>'
    if w.r.random() < 0.15 and len(blocks) > 2:
        blocks[1:] = [f'<div class="{w.r.choice(MAIN)}">{"".join(blocks[1:])}</div>']
    return w.around(f'<{tag} data-main="1"{w.r.choice(["", "", " " + w.named(MAIN)])}>{"".join(blocks)}</{tag}>')


def _named(w: Writer) -> str:
    tag = w.r.choice(["div", "div", "section"])
    return w.around(f'<{tag} data-main="1" {w.named(MAIN)}>{"".join(w.blocks())}</{tag}>')


def _unknown(w: Writer) -> str:
    """Names that tell nothing, around the text and around lists of links."""
    return w.around(f'<div data-main="1" {w.r.choice(["class", "id"])}="{w.name()}">{"".join(w.blocks())}</div>', w.r.random() < 0.5)


def _plain(w: Writer) -> str:
    return w.around(f'<div data-main="1">{"".join(w.blocks())}</div>', w.r.random() < 0.5)


def _bare(w: Writer) -> str:
    """Blocks stand in the body itself, furniture among them."""
    out = w.blocks(w.r.random() < 0.3)
    return "<body-main>" + w.around("".join(out), w.r.random() < 0.7, 3)


def _wrapped(w: Writer) -> str:
    """Wrappers in wrappers; the text may be dealt to several boxes."""
    blocks = w.blocks()
    if w.r.random() < 0.5 and len(blocks) > 3:
        cut = w.r.randint(1, len(blocks) - 1)
        blocks = [f'<div{w.r.choice(["", f" class={w.name()}"])}>{"".join(x)}</div>' for x in (blocks[:cut], blocks[cut:])]
    main = f'<div data-main="1"{w.r.choice(["", " " + w.named(MAIN), f" id={w.name()}"])}>{"".join(blocks)}</div>'
    for _ in range(w.r.randint(1, 4)):
        main = f'<div{w.r.choice(["", f" class={w.name()}", " class=wrapper", " id=page"])}>{w.around(main, True, 1)}</div>'
    return main


def _table(w: Writer) -> str:
    """A table lays out the page: a cell of links beside the cell of the text."""
    menu = f'<td data-main="0" width="20%">{w.links(3)}</td>'
    main = f'<td data-main="1">{"".join(w.blocks(w.r.random() < 0.3))}</td>'
    top = f'<tr data-main="0"><td colspan="2">{w.r.choice([w.words(1, 4), w.links(2, 6)])}</td></tr>' * (w.r.random() < 0.5)
    foot = f'<tr data-main="0"><td colspan="2">{w.rights()}</td></tr>' * (w.r.random() < 0.5)
    cells = [menu, main] if w.r.random() < 0.7 else [main, menu] if w.r.random() < 0.7 else [menu, main, menu]
    return w.around(f'<table border="0">{top}<tr>{"".join(cells)}</tr>{foot}</table>', True, 1)


def _encyclopedia(w: Writer) -> str:
    """Text in a box within a box, with contents, a box of facts, links to edit and categories."""
    outer, inner = w.r.choice([("content", "bodyContent"), ("content", "mw-content-text"), ("bodyContent", "mw-content"), ("globalWrapper", "article-text")])
    blocks = [*w.blocks(False), w.paragraph()]
    head = blocks.pop(0) if blocks[0].startswith("<h1") else ""
    for _ in range(w.r.randint(0, 2)):
        blocks.insert(w.r.randint(0, len(blocks)), w.r.choice([f'<div data-main="0" id="toc" class="toc"><h2>{w.words(1, 1)}</h2>{w.links(3)}</div>', f'<table data-main="0" class="infobox"><tr><th>{w.words(1, 2)}</th><td>{w.words(1, 3)}</td></tr><tr><th>{w.words(1, 2)}</th><td>{w.words(1, 3)}</td></tr></table>']))
    main = f'<div data-main="1" id="{outer}">{head}<div id="{inner}">{"".join(blocks)}</div><div data-main="0" id="catlinks">{w.links(2)}</div></div>'
    return w.around(main, True, 2)


def _lines(w: Writer) -> str:
    """Old pages: text with line breaks straight in the body, a font or a centred box."""
    text = w.r.choice(["<br><br>", "<br>", "\n<br>\n<br>"]).join(w.sentences(1, 5) for _ in range(w.r.randint(2, 9)))
    title = f"<h2>{w.words(1, 8).capitalize()}</h2>" * (w.r.random() < 0.5)
    kind = w.r.random()
    if kind < 0.4:
        return "<body-main>" + w.around(title + text, True, 2)
    tag = w.r.choice(["font", "center", "div", "span"])
    return w.around(f'<{tag} data-main="1">{title}{text}</{tag}>', True, 2)


FAMILIES = {"semantic": _semantic, "named": _named, "unknown": _unknown, "plain": _plain, "bare": _bare, "wrapped": _wrapped, "table": _table, "encyclopedia": _encyclopedia, "lines": _lines}


def page(family: str, seed: int) -> str:
    w = Writer(random.Random(f"{family} {seed}"))
    body = FAMILIES[family](w)
    mark = ' data-main="1"' * body.startswith("<body-main>")
    body = body.removeprefix("<body-main>")
    if mark and w.r.random() < 0.2:
        return f"<body{mark}>{body}"
    head = "".join(x for x in (f"<title>{w.words(2, 9)}</title>", '<meta charset="utf-8">', "<style>a{color:red}</style>", "<script>var a = '<b>';</script>") if w.r.random() < 0.6)
    return f"<!DOCTYPE html><html><head>{head}</head><body{mark}>{body}" + "</body></html>" * (w.r.random() < 0.9)


def pages(each: int = 200, families: list[str] | None = None, first: int = 0) -> list[str]:
    """`each` pages of each family, from number `first` on."""
    return [page(f, i) for i in range(first, first + each) for f in (families or FAMILIES)]
