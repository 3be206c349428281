"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page is cut into blocks, runs of text between block-level tags, each with the tags, classes and ids of its ancestors.
A block's label, article or not, is scored from its ancestors and from its text, and so is the change of label between
neighbours. Weights are fitted by maximum likelihood (forward-backward, Adam) on labelled pages, and a page is decoded
by Viterbi. `labelled_pages` makes pages of many layouts with known labels to train on.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCKS = frozenset((
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead tr ul").split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template title textarea svg noscript iframe object canvas math".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
HOLDS = frozenset("table ul ol dl div section article td th body select".split())  # an implied end does not reach beyond

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]  # tags from the root down
    names: frozenset  # parts of classes, ids and roles of the ancestors
    linked: int  # characters inside links


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page, in order; hidden elements, comments and empty blocks are left out."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements: tag and names
    held: list[str] = []
    linked = links = 0
    at = 0

    def flush():
        nonlocal linked
        text = " ".join(html.unescape("".join(held)).split())
        if text and not any(t == "head" for t, _ in stack):
            out.append(Block(text, tuple(t for t, _ in stack if t in BLOCKS), frozenset(n for _, names in stack for n in names), linked))
        held.clear()
        linked = 0

    def add(text: str):
        nonlocal linked
        held.append(text)
        if links:
            linked += len(text)

    for token in _TOKEN.finditer(page):
        if token.start() < at:
            continue
        add(page[at:token.start()])
        at = token.end()
        tag = (token[2] or "").lower()
        if not tag:
            continue
        if token[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag or tag not in BLOCKS and stack[i][0] in BLOCKS), -1)
            if tag in BLOCKS:
                flush()
            if place >= 0 and stack[place][0] == tag:
                links -= sum(t == "a" for t, _ in stack[place:])
                del stack[place:]
            continue
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            flush()
            closing = CLOSES.get(tag, ())
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == "p" or stack[i][0] in closing:
                    links -= sum(t == "a" for t, _ in stack[i:])
                    del stack[i:]
                elif stack[i][0] in HOLDS and not closing or stack[i][0] in ("table", "ul", "ol", "dl", "select"):
                    break
            if tag == "body":
                stack[:] = [x for x in stack if x[0] != "head"]
        if tag in HIDDEN and not token[3].endswith("/"):
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or token[3].endswith("/"):
            continue
        names = tuple(n.lower() for m in _ATTRIBUTE.finditer(token[3]) for n in _NAME.findall(m[2] or m[3] or m[4] or ""))
        stack.append((tag, names))
        links += tag == "a"
    add(page[at:])
    flush()
    return out


def features(page: list[Block]) -> list[list[str]]:
    """The features of each block: its ancestors, and what its text is like."""
    out, n = [], len(page)
    for i, b in enumerate(page):
        words = b.text.split(" ")
        size = len(words)
        own = b.path[-1] if b.path else "none"
        share = b.linked / max(1, len(b.text))
        inside = [t for t in ("article", "main", "nav", "aside", "footer", "header", "form") if t in b.path]
        f = ["bias", f"own={own}", f"inside={'+'.join(inside)}", f"words={min(6, size.bit_length())}", f"links={int(share * 4 + 0.5)}", f"own={own},words={min(6, size.bit_length())}"]
        f += [f"tag={t}" for t in set(b.path)] + [f"name={x}" for x in b.names]
        f.append("stop" if b.text[-1] in ".!?…:\"”»" else "no stop")
        if "©" in b.text:
            f.append("copyright")
        f.append("first" if i == 0 else "last" if i == n - 1 else "middle")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of the field: state (feature -> 2 labels), change (label before, label) and first label."""

    state: dict[str, np.ndarray]
    change: np.ndarray
    first: np.ndarray


def _sums(feature_ids: list[list[list[int]]], n: int):
    """Pages as padded arrays: (page, step, feature) triples, lengths."""
    page, step, which = [], [], []
    for p, rows in enumerate(feature_ids):
        for t, ids in enumerate(rows):
            page += [p] * len(ids)
            step += [t] * len(ids)
            which += ids
    return np.array(page), np.array(step), np.array(which)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(pages: list[tuple[str, list[bool]]], steps: int = 120, rate: float = 0.15, ridge: float = 0.02) -> Field:
    """Fit a field to labelled pages (html, label of each block)."""
    cut = [features(blocks(page)) for page, _ in pages]
    names = {f: i for i, f in enumerate(sorted({f for rows in cut for r in rows for f in r}))}
    page, step, which = _sums([[[names[f] for f in r] for r in rows] for rows in cut], len(names))
    lengths = np.array([len(rows) for rows in cut])
    longest = int(lengths.max())
    gold = np.zeros((len(pages), longest), int)
    for i, (_, labels) in enumerate(pages):
        gold[i, :len(labels)] = labels
    live = np.arange(longest) < lengths[:, None]
    state, change, first = np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2)
    flat = page * longest + step
    params = [state, change, first]
    m, v = [np.zeros_like(x) for x in params], [np.zeros_like(x) for x in params]
    rows = np.arange(len(pages))
    for n in range(1, steps + 1):
        u = np.stack([np.bincount(flat, state[which, y], len(pages) * longest) for y in (0, 1)], 1).reshape(len(pages), longest, 2)
        a, b = np.zeros_like(u), np.zeros_like(u)
        a[:, 0] = u[:, 0] + first
        for t in range(1, longest):
            a[:, t] = np.where(live[:, t, None], u[:, t] + _log_sum(a[:, t - 1, :, None] + change, 1), a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            b[:, t] = np.where(live[:, t + 1, None], _log_sum(change + (u[:, t + 1] + b[:, t + 1])[:, None, :], 2), 0)
        z = _log_sum(a[rows, lengths - 1], 1)
        p = np.exp(a + b - z[:, None, None]) * live[..., None]
        p[rows[:, None], np.arange(longest)[None, :], gold] -= live
        slope_state = np.stack([np.bincount(which, p.reshape(-1, 2)[flat, y], len(names)) for y in (0, 1)], 1)
        pair = np.exp(a[:, :-1, :, None] + change + (u[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        slope_change = pair.sum((0, 1))
        np.subtract.at(slope_change, (gold[:, :-1][live[:, 1:]], gold[:, 1:][live[:, 1:]]), 1)
        slopes = [slope_state / len(pages) + ridge / 50 * state, slope_change / len(pages) + ridge / 50 * change, p[:, 0].sum(0) / len(pages)]
        for k, (x, g) in enumerate(zip(params, slopes, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x -= rate * (m[k] / (1 - 0.9 ** n)) / (np.sqrt(v[k] / (1 - 0.99 ** n)) + 1e-6)
    return Field({f: state[i].copy() for f, i in names.items()}, change, first)


def decode(field: Field, page: list[Block]) -> list[bool]:
    """The likeliest labels of a page's blocks, by Viterbi."""
    if not page:
        return []
    none = np.zeros(2)
    scores = [sum((field.state.get(f, none) for f in fs), none).tolist() for fs in features(page)]
    (c00, c01), (c10, c11) = field.change.tolist()
    x, y = scores[0][0] + field.first[0], scores[0][1] + field.first[1]
    back = []
    for s0, s1 in scores[1:]:
        back.append((x + c00 < y + c10, x + c01 < y + c11))
        x, y = s0 + max(x + c00, y + c10), s1 + max(x + c01, y + c11)
    label = y > x
    out = [label]
    for before in reversed(back):
        label = before[1] if label else before[0]
        out.append(label)
    return [bool(x) for x in reversed(out)]


def main_text(field: Field, page: str | None) -> str:
    """The article's blocks in page order, joined by an empty line; null and empty pages have none."""
    cut = blocks(page or "")
    return "\n\n".join(b.text for b, keep in zip(cut, decode(field, cut), strict=True) if keep)


# ---- labelled pages ---------------------------------------------------------------------------

_MENU = ["nav", "menu", "navbar", "navigation", "topnav", "breadcrumb", "breadcrumbs", "tabs", "links", "toolbar", "pagination", "pager"]
_SIDE = ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "rail", "tags", "archive", "share", "social", "author", "meta", "subscribe"]
_ADS = ["ad", "ads", "advert", "advertisement", "banner", "sponsored", "sponsor", "promo", "promotion", "adsense"]
_NOTICE = ["cookie", "cookies", "consent", "notice", "gdpr", "alert", "popup", "modal", "overlay", "paywall", "privacy", "warning", "newsletter", "message"]
_TALK = ["comments", "comment", "discussion", "replies", "reply", "respond", "disqus", "responses", "thread", "reader", "feedback"]
_FOOT = ["footer", "foot", "bottom", "copyright", "colophon", "legal", "imprint"]
_HEAD = ["header", "masthead", "top", "logo", "branding", "hero", "site", "title"]
_GOOD = ["content", "article", "post", "entry", "story", "body", "text", "main", "page", "wrapper", "container"]
_SYLLABLES = "ka lo mi ren tu va sel do pra ne xi bo gan hul wer ti sol ma".split()


class _Writer:
    """Writes one page and the label of each block it makes."""

    def __init__(self, seed: int):
        self.r, self.html, self.labels = random.Random(seed), [], []

    def words(self, low: int, high: int) -> str:
        r = self.r
        return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high)))

    def sentences(self, n: int) -> str:
        return " ".join(self.words(3, 18).capitalize() + self.r.choice("...!?") for _ in range(n))

    def named(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.15:
            return ""
        name = r.choice(names)
        if r.random() < 0.4:
            name += r.choice(["-", "_"]) + r.choice(["list", "box", "wrap", "area", "section", "inner", "item", "main", "container", "1", "block"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def leaf(self, tag: str, text: str, label: bool, attributes: str = "", end: bool = True) -> None:
        self.html.append(f"<{tag}{attributes}>{text}" + (f"</{tag}>" if end else ""))
        self.labels.append(label)

    def links(self, label: bool, names: list[str], tags=("nav", "div", "ul", "aside")) -> None:
        r, tag = self.r, self.r.choice(tags)
        self.html.append(f"<{tag}{self.named(names)}>" + ("<ul>" if tag != "ul" else ""))
        for _ in range(r.randint(2, 7)):
            text = self.words(1, 3)
            self.leaf("li", f'<a href="/{text[:4]}">{text}</a>' if r.random() < 0.85 else text, label, end=r.random() < 0.9)
        self.html.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def box(self, names: list[str], tags: tuple[str, ...], low: int = 1, high: int = 3) -> None:
        """A box that is no part of the article, with text that may well read like one."""
        r, tag = self.r, self.r.choice(tags)
        attributes = self.named(names) if tag not in ("nav", "footer", "header", "aside", "form") or r.random() < 0.5 else ""
        if tag in ("div", "section", "p", "span") and not attributes:
            attributes = f' class="{r.choice(names)}"'
        if r.random() < 0.4:
            self.leaf(tag, self.sentences(r.randint(1, 2)) if r.random() < 0.7 else self.words(1, 8), False, attributes)
            return
        self.html.append(f"<{tag}{attributes}>")
        if r.random() < 0.4:
            self.leaf(r.choice(["h2", "h3", "h4"]), self.words(1, 4), False)
        for _ in range(r.randint(low, high)):
            inner = r.choice(["p", "p", "div", "li"]) if tag != "p" else "div"
            text = self.sentences(r.randint(1, 6)) if r.random() < 0.6 else self.words(1, 6)
            self.leaf(inner, f"<a href='#'>{text}</a>" if r.random() < 0.2 else text, False)
        self.html.append(f"</{tag}>")

    def form(self) -> None:
        self.html.append(f"<form{self.named(['search', 'login', 'subscribe', 'newsletter', 'contact', 'signup'])}>")
        for _ in range(self.r.randint(1, 3)):
            self.leaf(self.r.choice(["p", "div", "label", "legend"]), self.words(1, 6), False)
            if self.html[-1].startswith("<label"):
                self.html.append("<hr>")
        self.html.append("<input type=text><textarea>x</textarea></form>")

    def article(self) -> None:
        r = self.r
        style = r.random()
        opening, closing = ("<article>", "</article>") if style < 0.4 else ("<main>", "</main>") if style < 0.55 else (
            "<main><article>", "</article></main>") if style < 0.65 else (f'<div class="{r.choice(_GOOD)}{r.choice(["", "-body", "-content", "-text"])}">', "</div>")
        if style > 0.9:
            opening, closing = f'<section id="{r.choice(_GOOD)}">', "</section>"
        self.html.append(opening)
        if r.random() < 0.85:
            if r.random() < 0.25:
                self.html.append("<header>")
                self.leaf("h1", self.words(3, 10), True)
                self.html.append("</header>")
            else:
                self.leaf("h1", self.words(2, 10), True, f' class="{r.choice(["title", "headline", "post-title", "entry-title"])}"' if r.random() < 0.3 else "")
        for _ in range(r.randint(1, 9)):
            kind = r.random()
            if kind < 0.68:
                text = self.sentences(r.randint(1, 8)) if r.random() < 0.85 else self.words(1, 5) + r.choice([".", ""])
                if r.random() < 0.15:
                    text = "<b>" + text + "<br>"
                elif r.random() < 0.2:
                    text += f' <a href="#">{self.words(1, 3)}</a> {self.words(2, 9)}.'
                self.leaf("p", text, True, end=r.random() < 0.85)
            elif kind < 0.76:
                self.leaf(r.choice(["h2", "h3"]), self.words(1, 6), True)
            elif kind < 0.83:
                self.html.append("<ul>")
                for _ in range(r.randint(1, 4)):
                    self.leaf("li", self.words(2, 14), True)
                self.html.append("</ul>")
            elif kind < 0.88:
                self.leaf("blockquote", self.sentences(2), True)
            elif kind < 0.92:
                self.leaf("pre", self.words(3, 12), True)
            elif kind < 0.95:
                self.html.append("<table><tr>")
                for _ in range(3):
                    self.leaf("td", self.words(1, 4), True)
                self.html.append("</tr></table>")
            else:
                self.box(_ADS + _SIDE[:6] + _NOTICE[-3:], ("div", "aside"))
        if r.random() < 0.12:
            self.box(_TALK, ("div", "section"))
        self.html.append(closing)


def labelled_pages(n: int = 500, seed: int = 1) -> list[tuple[str, list[bool]]]:
    """Pages of varied layouts with a label for each block: true for the article's."""
    out = []
    for i in range(n):
        w = _Writer(seed * 1_000_003 + i)
        r = w.r
        w.html.append(f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{w.words(2, 6)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>')
        if r.random() < 0.3:
            w.box(_NOTICE, ("div", "section", "aside"))
        if r.random() < 0.5:
            w.box(_HEAD, ("header", "header", "div"))
        if r.random() < 0.75:
            w.links(False, _MENU, ("nav", "nav", "div", "ul"))
        w.html.append("<!-- x -->")
        if r.random() < 0.5:
            w.box(_ADS, ("div", "aside", "section"), 1, 2)
        if r.random() < 0.25:
            w.form()
        if r.random() < 0.25:
            w.box(_SIDE, ("aside", "div"))
        w.article()
        for names, tags, chance in ((_ADS, ("div", "aside"), 0.3), (_SIDE, ("aside", "div", "section"), 0.4), (_TALK, ("div", "section"), 0.45), (_NOTICE, ("div",), 0.2)):
            if r.random() < chance:
                w.box(names, tags, 1, 4)
        if r.random() < 0.3:
            w.links(False, _SIDE, ("div", "aside"))
        if r.random() < 0.25:
            w.form()
        if r.random() < 0.8:
            if r.random() < 0.6:
                w.leaf("footer", ("&copy; " if r.random() < 0.6 else "") + w.words(1, 5) + " &middot; " + w.sentences(1), False)
            else:
                w.box(_FOOT, ("footer", "div"))
        w.html.append("</body></html>")
        out.append(("".join(w.html), w.labels))
    return out


def text_column(field: Field, pages: DataFrame, page: str = "html") -> Column:
    """A column with the main text of each page."""
    shared = pages.sparkSession.sparkContext.broadcast(field)

    @F.arrow_udf(T.StringType())
    def extracted(column: pa.Array) -> pa.Array:
        return pa.array([main_text(shared.value, x.as_py()) for x in column], pa.string())

    return extracted(F.col(f"`{page}`").cast("string"))


def main_texts(pages: DataFrame, page: str = "html", out: str = "text", field: Field | None = None) -> DataFrame:
    """`pages` with a column `out`: the main text, empty for null and empty pages and for pages without an article.

    Rows are worked on alone, so repeated rows and null ids pass through; a column named `out` is replaced.
    """
    return pages.withColumn(out, text_column(field or train(labelled_pages()), pages, page))
