"""Main text of web pages by a tree-structured graphical model.

A page's block elements form a tree. Every node is content or not; a node's own potentials come
from its tag, its class, id and role words, its text's length, links and sentence marks, its subtree's links and
share of the page, and potentials between parent and child say how content is inherited. Sum-product messages, upward
and then downward, give each node's exact marginal, and the text of nodes that are content with
probability over one half is the main text. Weights are trained by gradient on the exact
conditional likelihood (observed less expected features) over TRAINING_PAGES labelled pages,
which labelled_page() writes in many layouts with the labels known; the bound is a parameter.

Blocks. Inline elements, formulas among them, do not cut a block and br is white space in it. Start
tags of blocks end an open p, items end items of the same list, and an end tag without a start is
ignored. Raw text elements, comments and declarations have no text. A raw text element ends at its
end tag; without one it ends with the page if it is script or style, else only its tag is left out.
A self-closed svg is empty. Everything is iterative: depth does not matter.

Defined cases. Null and empty html give an empty text. Text without any tag is one block of the
root. A stray quote in a tag is a character of it; a value's quote that is never closed ends with the
tag. Repeated rows give repeated results, a null page_id or url is carried through, and an empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINING_PAGES, EPOCHS, SEED = 320, 14, 11
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATH = frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd mlabeledtr maction semantics annotation annotation-xml".split())
#: Elements of MATH that begin with white space.
APART = frozenset("br mtr mtd mlabeledtr annotation annotation-xml".split())
RAW = frozenset("script style noscript template textarea title select svg iframe object head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element of the first kind ends one of the second, up to the container named.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select", "datalist")),
}
CONTAINERS = frozenset("html body div section article main aside header footer nav form table tbody thead ul ol dl center fieldset details".split())
#: A quote opens a value only right after "="; one that is never closed is a plain character.
VALUE = r"=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+)"
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|{VALUE})*+)(?:>|\Z)", re.S)
NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: A value without quotes to which the last slash of a tag belongs.
UNQUOTED = re.compile(r"=\s*[^\s\"']+/\Z")
SENTENCE = re.compile(r"[.!?。]")


#: Words of class, id and role attributes in the labelled pages.
MENUS = "nav menu navbar navigation breadcrumb breadcrumbs topbar toolbar links menue hauptmenue leiste navegacion navigazione principal".split()
HEADS = "header masthead banner top logo branding kopf kopfzeile entete cabecera testata encabezado".split()
FEET = "footer bottom copyright colophon legal fuss fusszeile pied pie piede impressum".split()
SIDES = "sidebar side widget aside related recommended popular archive tags share social rail seitenleiste seite laterale lateral rand voisins relacionados author byline bio autor auteur autore".split()
ADVERTS = "ad ads advert advertisement sponsor sponsored promo promotion adbox werbung anzeige publicite publicidad pubblicita pub".split()
NOTICES = "cookie consent notice alert gdpr popup modal newsletter subscribe warning hinweis avis aviso avviso".split()
REPLIES = "comments comment replies reply discussion responses respond disqus thread kommentare kommentar commentaires comentarios commenti".split()
FORMS = "form search login signup contact suche recherche buscar anmeldung".split()
BODIES = "article content post entry main story text body page inhalt haupt artikel beitrag contenu texte contenido articulo cuerpo contenuto".split()
#: Words that say nothing.
PLAIN = "x x1 row col inner wrapper wrap container box block item clearfix left center section c1 module component".split()
#: What a word tells, so that a seldom one tells as much as its like.
GROUPS = {w: name for name, words in (("menu", MENUS), ("head", HEADS), ("foot", FEET), ("side", SIDES), ("advert", ADVERTS), ("notice", NOTICES), ("reply", REPLIES), ("form", FORMS), ("body", BODIES)) for w in words}


@dataclass
class Page:
    """Nodes in page order (a parent before its children) and their runs of text."""

    tags: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    chars: list[int] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    marks: list[int] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, attributes: str) -> int:
        named = " ".join(x for m in NAMED.findall(attributes) for x in m if x) if attributes else ""
        self.tags.append(tag)
        self.parents.append(parent)
        self.words.append(re.findall(r"[a-z]+", named.lower()))
        for counts in (self.chars, self.linked, self.marks):
            counts.append(0)
        return len(self.tags) - 1


def parsed(source: str) -> Page:
    page = Page()
    stack = [page.add("html", -1, "")]
    pending: list[tuple[str, bool]] = []
    links, at, lower = 0, 0, None
    unclosed: set[str] = set()  # raw elements that have no end tag any more

    def flush() -> None:
        if pending:
            text = " ".join(html.unescape("".join(t for t, _ in pending)).split())
            if text:
                node = stack[-1]
                page.runs.append((node, text))
                page.chars[node] += len(text)
                page.linked[node] += sum(len(t) for t, in_link in pending if in_link)
                page.marks[node] += len(SENTENCE.findall(text))
            pending.clear()

    def close(names: tuple[str, ...], within: tuple[str, ...]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            tag = page.tags[stack[k]]
            if tag in names:
                del stack[k:]
                return
            if tag in within:
                return

    while True:
        m = TOKEN.search(source, at)
        if m is None or m.start() > at:
            pending.append((source[at : m.start() if m else len(source)], links > 0))
        if m is None:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag, end = m[2].lower(), m[1] == "/"
        if tag in RAW and not end:
            lower = lower or source.lower()
            if tag == "head" or tag in unclosed or (tag == "svg" and m[3].endswith("/") and not UNQUOTED.search(m[3])):
                continue
            found = lower.find(f"</{tag}", at)
            if found >= 0:
                at = source.find(">", found) + 1 or len(source)
            elif tag in ("script", "style"):
                at = len(source)
            else:
                unclosed.add(tag)
            continue
        if tag in INLINE or tag in MATH:
            if tag == "a":
                links = max(0, links + (-1 if end else 1))
            if tag in APART:
                pending.append((" ", False))
            continue
        if tag in ("html", "head"):
            continue
        flush()
        if end:
            for k in range(len(stack) - 1, 0, -1):
                if page.tags[stack[k]] == tag:
                    del stack[k:]
                    links = 0
                    break
            continue
        links = 0
        if page.tags[stack[-1]] == "p":
            stack.pop()
        if tag in ENDS:
            close(*ENDS[tag])
        if tag not in VOID:
            stack.append(page.add(tag, stack[-1], m[3]))
    flush()
    return page


def subtrees(page: Page) -> list[tuple[int, int]]:
    """Of every node, the characters under it and those in links."""
    chars, linked = list(page.chars), list(page.linked)
    for n in range(len(page.tags) - 1, 0, -1):
        chars[page.parents[n]] += chars[n]
        linked[page.parents[n]] += linked[n]
    return list(zip(chars, linked, strict=True))


def features(page: Page, n: int, under: list[tuple[int, int]] | None = None, whole: bool | None = None) -> list[str]:
    """under: subtrees(page). whole: the page has a body; without one its root stands for it."""
    under, whole = under or subtrees(page), "body" in page.tags if whole is None else whole
    tag, chars = page.tags[n], page.chars[n]
    up = page.tags[page.parents[n]] if n else ""
    out = [f"t:{tag}", f"up:{up if whole or up != 'html' else 'body'}"]
    out += [f"c:{w}" for w in page.words[n]]
    out += [f"g:{g}" for g in sorted({GROUPS[w] for w in page.words[n] if w in GROUPS})]
    out.append(f"len:{min(9, chars.bit_length())}")
    if chars:
        out.append(f"link:{round(4 * min(1.0, page.linked[n] / chars))}")
        out.append(f"marks:{min(3, page.marks[n])}")
    every, linked = under[n]
    if every:
        out.append(f"links under:{round(4 * min(1.0, linked / every))}")
        out.append(f"share:{round(4 * every / under[0][0])}")
    return out


def kind_of(tag: str) -> str:
    return "box" if tag in CONTAINERS else "text"


class Model:
    """Weights of the features and, per kind of child, of parent and child labels."""

    def __init__(self) -> None:
        self.unary: dict[str, float] = defaultdict(float)
        self.pair: dict[tuple[str, int, int], float] = defaultdict(float)

    def marginals(self, page: Page) -> tuple[list[float], list[tuple[float, float, float, float]], list[list[str]]]:
        """Per node: P(content), P(parent and child labels as 00, 01, 10, 11), features."""
        n = len(page.tags)
        under = subtrees(page)
        own = [features(page, i, under, "body" in page.tags) for i in range(n)]
        score = [sum(self.unary.get(f, 0.0) for f in fs) for fs in own]
        edges = {k: tuple(math.exp(self.pair.get((k, a, b), 0.0)) for a in (0, 1) for b in (0, 1)) for k in ("box", "text")}
        up0, up1 = [1.0] * n, [math.exp(max(-30.0, min(30.0, s))) for s in score]
        msg: list[tuple[float, float]] = [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):  # upward: a child's belief summed over its label
            z = up0[i] + up1[i]
            a, b = up0[i] / z, up1[i] / z
            e = edges[kind_of(page.tags[i])]
            m0, m1 = e[0] * a + e[1] * b, e[2] * a + e[3] * b
            z = m0 + m1
            msg[i] = (m0 / z, m1 / z)
            p = page.parents[i]
            up0[p] *= msg[i][0] * 2
            up1[p] *= msg[i][1] * 2
            z = max(up0[p], up1[p])
            up0[p], up1[p] = up0[p] / z + 1e-300, up1[p] / z + 1e-300
        prob = [0.0] * n
        joint: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * n
        prob[0] = up1[0] / (up0[0] + up1[0])
        for i in range(1, n):  # downward: the parent's belief without what the child told it
            p = page.parents[i]
            q0, q1 = (1 - prob[p]) / msg[i][0], prob[p] / msg[i][1]
            e = edges[kind_of(page.tags[i])]
            j = (q0 * e[0] * up0[i], q0 * e[1] * up1[i], q1 * e[2] * up0[i], q1 * e[3] * up1[i])
            z = sum(j) or 1.0
            joint[i] = (j[0] / z, j[1] / z, j[2] / z, j[3] / z)
            prob[i] = joint[i][1] + joint[i][3]
        return prob, joint, own

    def step(self, page: Page, labels: list[int], rate: float) -> None:
        """One gradient step on the log-likelihood of a page's labels."""
        prob, joint, own = self.marginals(page)
        for i, y in enumerate(labels):
            for f in own[i]:
                self.unary[f] += rate * (y - prob[i] - 0.002 * self.unary[f])
            if i:
                seen = 2 * labels[page.parents[i]] + y
                for k, expected in enumerate(joint[i]):
                    at = (kind_of(page.tags[i]), k >> 1, k & 1)
                    self.pair[at] += rate * ((k == seen) - expected)


def labelled_page(seed: int) -> tuple[str, list[int]]:
    """A page in one of many layouts, and the label of each of its nodes in page order."""
    rnd = random.Random(seed)
    labels = [0]
    pick, chance = rnd.choice, lambda p: rnd.random() < p
    plain = chance(0.4)  # pages whose elements have classes that say nothing
    bare = chance(0.25)  # pages without a telling name: what is no content is links, a short line or a form

    def word() -> str:
        return "".join(pick(("an", "er", "th", "on", "in", "le", "ou", "sch", "re", "ció", "to", "vi")) for _ in range(rnd.randint(1, 4)))

    def prose(low: int, high: int) -> str:
        out = [word() for _ in range(rnd.randint(low, high))]
        for k in range(len(out)):
            if chance(0.12) or k == len(out) - 1:
                out[k] += pick(".,.")
        return " ".join(out).capitalize()

    def link() -> str:
        return f'<a href="/{word()}">{word()} {word() if chance(0.4) else ""}</a>'

    def node(tag: str, label: int, inner: list, named: list[str] | None = None, p: float = 0.8, closed: bool = True) -> str:
        """inner: strings, and functions that write child nodes (called in page order)."""
        labels.append(label)
        attribute = f' {pick(("class", "id"))}="{pick(named)}{pick(("", "", "-box", " x1"))}"' if named and not bare and chance(p) else ""
        if not attribute and plain and chance(0.6):
            attribute = f' class="{pick(PLAIN)}{pick(("", f"-{word()}", f" {pick(PLAIN)}"))}"'
        body = "".join(x() if callable(x) else x for x in inner)
        return f"<{tag}{attribute}>{body}" + (f"</{tag}>" if closed else "")

    def many(low: int, high: int, f) -> list:
        return [f] * rnd.randint(low, high)

    def items(label: int, text) -> str:
        return node(pick(("ul", "ul", "ol")), label, many(2, 6, lambda: node("li", label, [text()])))

    def menu() -> str:
        tag = pick(("nav", "nav", "div"))
        return node(tag, 0, [lambda: items(0, link)] if chance(0.7) else many(1, 1, lambda: " ".join(link() for _ in range(5))), MENUS, 1.0 if tag == "div" else 0.5)

    def head() -> str:
        tag = pick(("header", "div"))
        return node(tag, 0, [lambda: node(pick(("h1", "h2", "p")), 0, [prose(1, 5)])] + ([menu] if chance(0.5) else []), HEADS, 1.0 if tag == "div" else 0.4)

    def foot() -> str:
        tag = pick(("footer", "footer", "div"))
        text = f"&copy; {word()}.example.com &middot; {prose(2, 14)}"
        return node(tag, 0, [text] if chance(0.6) else [lambda: node("p", 0, [text])], FEET, 1.0 if tag == "div" else 0.4)

    def boxed(names: list[str], tags: tuple[str, ...]) -> str:
        tag = pick(tags)
        inner = [prose(3, 30)] if chance(0.5) else many(1, 3, lambda: node(pick(("p", "p", "h3", "div")), 0, [prose(2, 40)]))
        if chance(0.2):
            inner.append(lambda: items(0, link))
        return node(tag, 0, inner, names, 1.0 if tag == "div" else 0.6)

    def replies() -> str:
        one = lambda: node(pick(("div", "article", "li")), 0, [lambda: node("p", 0, [prose(3, 40)])], REPLIES)
        return node(pick(("div", "section")), 0, [lambda: node("h3", 0, [prose(1, 3)]), *many(1, 4, one)], REPLIES, 1.0)

    def form() -> str:
        return node("form", 0, [lambda: node("p", 0, [prose(1, 4), '<input type="text">']), lambda: node("button", 0, [word()])], FORMS, 0.4)

    def aside() -> str:
        return pick((lambda: boxed(ADVERTS, ("div", "aside")), lambda: boxed(SIDES, ("aside", "div")), lambda: boxed(NOTICES, ("div", "section"))))()

    def para() -> str:
        text = prose(3, 90) if chance(0.85) else prose(1, 2)
        if chance(0.2):
            text = f"<b>{text}</b>" if chance(0.5) else f"<b>{text}<br>"
        return node("p", 1, [text + (link() if chance(0.1) else "")], closed=chance(0.8))

    def block() -> str:
        kind = rnd.random()
        if kind < 0.8:
            return para()
        if kind < 0.86:
            return node(pick(("h2", "h3")), 1, [prose(1, 7)])
        if kind < 0.91:
            return items(1, lambda: prose(2, 25))
        if kind < 0.94:
            return node("blockquote", 1, [lambda: node("p", 1, [prose(4, 40)])])
        if kind < 0.96:
            return node("pre", 1, [prose(4, 30)])
        row = lambda: node("tr", 1, many(2, 3, lambda: node("td", 1, [prose(1, 6)])))
        return node("table", 1, many(1, 3, row)) if kind < 0.98 else node("div", 1, [prose(10, 60)])

    def article() -> str:
        inner = [lambda: node("h1", 1, [prose(2, 12)])] * chance(0.8) + many(1, 9, block)
        if chance(0.08):  # an article without an element of its own
            return "".join(f() for f in inner)
        if chance(0.3) and not bare:
            inner.insert(rnd.randint(0, len(inner)), aside)
        if chance(0.15) and not bare:
            inner.append(replies)
        tag = pick(("article", "article", "main", "div", "section"))
        if chance(0.25):
            return node(pick(("main", "div", "section")), 1, [lambda: node("div", 1, inner, BODIES)], BODIES, 0.8)
        return node(tag, 1, inner, BODIES, 1.0 if tag in ("div", "section") else 0.3)

    if bare:
        row = lambda: node(pick(("div", "div", "p")), 0, [" ".join(link() for _ in range(rnd.randint(2, 7)))])
        listed = lambda: row() if chance(0.5) else node(pick(("div", "ul")), 0, many(2, 6, lambda: node(pick(("li", "p", "div")), 0, [link()])))
        line = lambda: node(pick(("div", "p", "div")), 0, [f"&copy; {rnd.randint(1990, 2030)} {word()}" if chance(0.7) else f"Copyright {rnd.randint(1990, 2030)} {word()} {word()}"])
        text = pick((article, article, lambda: "".join(f() for f in many(1, 6, block)), para))
        body = node("body", 0, [*[listed] * chance(0.7), text, *[listed] * chance(0.3), *[form] * chance(0.1), *[line] * chance(0.6)])
        return f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title></head>{body}</html>", labels
    before = [menu] * chance(0.7) + [head] * chance(0.4) + [aside] * chance(0.6) + [form] * chance(0.1)
    rnd.shuffle(before)
    after = [replies] * chance(0.3) + [aside] * chance(0.4) + [form] * chance(0.15) + [foot] * chance(0.85)
    body = node("body", 0, [*before, article, *after])
    return f"<!DOCTYPE html><html><head><title>{prose(2, 6)}</title><script>var t='</p>';</script></head>{body}</html>", labels


@functools.lru_cache(4)
def trained(pages: int = TRAINING_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    rnd, model, data = random.Random(seed), Model(), []
    for k in range(pages):
        source, labels = labelled_page(seed * 100_003 + k)
        page = parsed(source)
        if len(page.tags) != len(labels):
            raise AssertionError("labels and nodes differ")
        data.append((page, labels))
    for epoch in range(epochs):
        rnd.shuffle(data)
        for page, labels in data:
            model.step(page, labels, 0.25 / (1 + 0.3 * epoch))
    return model


#: Elements and names of what is no main text even where a page has no other.
NEVER = frozenset("nav header footer aside form button fieldset".split())
TOLD = frozenset([*MENUS, *HEADS, *FEET, *SIDES, *ADVERTS, *NOTICES, *REPLIES, *FORMS])


def main_text(source: str | None, model: Model) -> str:
    """The blocks that are content with a probability over one half. Where none is, but the page has prose outside of
    what its elements and names tell to be something else, the likeliest prose is."""
    page = parsed(source or "")
    prob = model.marginals(page)[0]
    kept = [text for node, text in page.runs if prob[node] > 0.5]
    if not kept and page.runs:
        told = [False] * len(page.tags)
        for n, tag in enumerate(page.tags):
            told[n] = (n > 0 and told[page.parents[n]]) or tag in NEVER or not TOLD.isdisjoint(page.words[n])
        prose = [(n, text) for n, text in page.runs if not told[n] and 2 * page.linked[n] <= page.chars[n]]
        best = max((prob[n] for n, _ in prose if page.marks[n]), default=2.0)
        kept = [text for n, text in prose if 2 * prob[n] >= best]
    return "\n\n".join(kept)


def _extract(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h.as_py(), model) for h in batch.column("html")]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text and n_chars. The model is trained on the driver and sent with the task."""
    model = model or trained()
    rows = pages.select(F.col("page_id").cast("long"), "url", "html")
    return rows.mapInArrow(lambda b: _extract(b, model), "page_id long, url string, text string, n_chars long")
