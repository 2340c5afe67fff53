"""Main-text extraction with a tree-structured graphical model of the DOM.

Every element of a page is a node with a hidden label, content or boilerplate. Node potentials come from a logistic model of
what is seen of the element (tag, class and id words, what encloses it, link density, its share of the page's text); pair
potentials from counts of (parent label, child label) by the child's kind of tag. Sum-product message passing, leaves to
root and back, yields each node's content marginal; blocks of text under nodes whose marginal reaches THRESHOLD are the main
text.

The model is trained on labelled pages: LABELLED_PAGES pages made from a seed by `labelled_pages`, which mixes layouts,
element names, long and very short articles, pages without an article element or without any element, and sloppy markup
(unclosed p, li and b, stray ends, quotes in unquoted values, comments, scripts with markup inside).

Text: character references are decoded once, white space inside a block becomes one space, blocks are trimmed, empty ones
go, and the rest are joined by line feeds in page order. Scripts, styles, templates, comments, form
controls, frames, drawings (svg, canvas) and annotations of formulas never give text; formulas and an object's fallback do.

Tags and attributes are read as browsers read them: a quote opens a value only right behind the equals sign. Elements nested
deeper than MAX_DEPTH become children of the element at that depth, so a page takes time in proportion to its length.

Inputs: null, empty and textless pages give the empty text; unfinished tags end with the page, and so
do scripts, styles, titles and textareas without an end, while other elements without one hide nothing; rows that repeat a page_id are
each extracted; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import random
import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

LABELLED_PAGES, SEED, THRESHOLD = 600, 5, 0.5
MAX_DEPTH = 512
#: Tag sets of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg select button canvas annotation annotation-xml".split())
#: Those of RAW that hide the rest of the page where their end is missing.
TO_END = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = BLOCK - frozenset("option legend caption body html td th tr tbody thead tfoot".split())
SELF_CLOSING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",)}
#: Parts of class and id names that tell what an element is; all but the last two tell boilerplate.
NAME_HINTS = (
    ("ad", r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|adslot|dfp)(?:[-_ ]|$)"),
    ("nav", r"(?:^|[-_ ])(?:\w*nav\w*|menu\w*|breadcrumbs?|crumbs?|pagination|pager|toc|tabs?|skip\w*)(?:[-_ ]|$)"),
    ("side", r"(?:^|[-_ ])(?:side|sidebar\w*|aside|widgets?|related|recommend\w*|trending|popular|rail|more)(?:[-_ ]|$)"),
    ("foot", r"(?:^|[-_ ])(?:\w*footer|copyright|legal|colophon|credits)(?:[-_ ]|$)"),
    ("head", r"(?:^|[-_ ])(?:header|masthead|topbar|branding|logo)(?:[-_ ]|$)"),
    ("comment", r"(?:^|[-_ ])(?:comment\w*|disqus|reply|replies|respon[sd]\w*|discussion|feedback|readers?)(?:[-_ ]|$)"),
    ("notice", r"(?:^|[-_ ])(?:cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|paywall|signup|toast|warning|message)(?:[-_ ]|$)"),
    ("share", r"(?:^|[-_ ])(?:shar(?:e|ing)\w*|social|follow|tags?|toolbar|tools)(?:[-_ ]|$)"),
    ("content", r"(?:^|[-_ ])(?:\w*content|articles?|posts?|entry|story|main|text)(?:[-_ ]|$)"),
    ("credit", r"(?:^|[-_ ])(?:byline|author|dateline|meta|time|caption)(?:[-_ ]|$)"),
)
_HINTS = [re.compile(p) for _, p in NAME_HINTS]
N_BOILER = len(NAME_HINTS) - 2
TAGS = ("div", "p", "article", "main", "section", "nav", "aside", "header", "footer", "form", "ul", "ol", "li", "h1", "h2", "h3", "table", "td", "blockquote", "pre", "figure", "figcaption", "a", "b", "span", "body", "html", "address", "dialog", "dl", "details")
_TAG_NO = {t: i for i, t in enumerate(TAGS)}
#: Roles of elements, and what they are like.
ROLES = {"navigation": "nav", "complementary": "aside", "contentinfo": "footer", "banner": "header", "search": "form", "form": "form", "dialog": "dialog", "alertdialog": "dialog", "alert": "dialog", "menu": "nav", "menubar": "nav", "main": "main", "article": "article"}
#: Elements that are boilerplate, with all that they hold.
OUTSIDE = frozenset("nav aside footer form dialog".split())
#: Features of a node besides its tag and the hints of its own names.
MORE = ("hidden", "in outside", "in header", "in hinted", "in article", "article elsewhere", "holds article", "linked", "linked list", "mostly linked", "in links", "words > 5", "words > 40", "share", "share > half", "bare", "bare page", "has text", "one")
_AT = {n: len(TAGS) + 1 + len(NAME_HINTS) + i for i, n in enumerate(MORE)}
N_FEATURES = len(TAGS) + 1 + len(NAME_HINTS) + len(MORE)
_VALUE = r"""=\s*"[^"]*(?:"|$)|=\s*'[^']*(?:'|$)|=\s*[^\s"'>][^\s>]*"""
_MARKUP = re.compile(rf"""<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?>{_VALUE}|[^>=]+|=)*))(?:>|$)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)(?:"|$)|'([^']*)(?:'|$)|([^\s>]*)))?""")
_WHITE = re.compile(r"\s+")


@dataclass
class Tree:
    tags: list[str]
    names: list[str]
    roles: list[str]
    parent: list[int]
    pieces: list[tuple[int, str | None]]  # (node, text) in page order; None begins a block


def parse(page: str) -> Tree:
    """Elements and their texts in page order, with the usual implied ends."""
    tree = Tree(["html"], [""], [""], [-1], [])
    tags, parent, pieces = tree.tags, tree.parent, tree.pieces
    stack, at, n = [0], 0, len(page)
    endless: set[str] = set()  # of which no end follows
    held: dict[str, int] = {}  # open elements by tag

    def pop(i: int) -> None:
        block = False
        for j in stack[i:]:
            held[tags[j]] -= 1
            block = block or tags[j] in BLOCK
        del stack[i:]
        if block:
            pieces.append((stack[-1], None))

    while at < n:
        m = _MARKUP.search(page, at)
        if m is None:
            pieces.append((stack[-1], page[at:]))
            break
        if m.start() > at:
            pieces.append((stack[-1], page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                pieces.append((stack[-1], html.escape(m[0][9:].removesuffix("]]>"))))
            continue
        tag = m[2].lower()
        if m[1]:
            if not held.get(tag):
                if tag == "p":  # a stray end of a paragraph is an empty one
                    pieces.append((stack[-1], None))
                continue
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == tag:
                    pop(i)
                    break
                if tag not in BLOCK and tags[stack[i]] in BLOCK:
                    break
            continue
        if tag == "html":
            continue
        if tag == "br":
            pieces.append((stack[-1], " "))
            continue
        if tag in VOID:
            if tag == "hr":
                pieces.append((stack[-1], None))
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at) if tag not in endless else None
                if end or tag in TO_END:
                    at = end.end() if end else n
                else:
                    endless.add(tag)
            continue
        if tag in CLOSES_P and held.get("p"):
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] == "p":
                    pop(i)
                    break
                if tags[stack[i]] in BLOCK:
                    break
        if tag in SELF_CLOSING:
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in SCOPES[tag]:
                    break
                if tags[stack[i]] in SELF_CLOSING[tag]:
                    pop(i)
                    break
        name, role = _names(m[3]) if m[3] else ("", "")
        while len(stack) > MAX_DEPTH:
            pop(len(stack) - 1)
        tree.names.append(name)
        tree.roles.append(role)
        tags.append(tag)
        parent.append(stack[-1])
        stack.append(len(tags) - 1)
        held[tag] = held.get(tag, 0) + 1
        if tag in BLOCK:
            pieces.append((stack[-1], None))
    return tree


def _names(attributes: str) -> tuple[str, str]:
    """Class and id words of a tag, and its role; hidden elements have the role hidden."""
    name, role = "", ""
    for a in _ATTRIBUTE.finditer(attributes):
        key, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
        if key in ("class", "id"):
            name += " " + value
        elif key == "role" and role != "hidden":
            role = value.strip()
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            role = "hidden"
    return _WHITE.sub(" ", name).strip(), role


_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


def _hinted(names: str) -> tuple[int, ...]:
    return tuple(i for i, h in enumerate(_HINTS) if h.search(names))


_short_hinted = lru_cache(20_000)(_hinted)


_COMMENT = [name for name, _ in NAME_HINTS].index("comment")


def _large(tree: Tree, like: list[str]) -> list[bool]:
    """Elements around more than half of the text of the page's articles: no name makes these boilerplate."""
    n, parent = len(tree.tags), tree.parent
    within, chars = [False] * n, [0] * n
    for i in range(1, n):
        within[i] = within[parent[i]] or (like[i] in ("article", "main") and "comment" not in tree.names[i])
    for node, text in tree.pieces:
        if text and within[node]:
            chars[node] += len(text)
    for i in range(n - 1, 0, -1):
        chars[parent[i]] += chars[i]
    return [2 * c > chars[0] and not w for c, w in zip(chars, within, strict=True)]


def node_features(tree: Tree) -> np.ndarray:
    n, tags, parent = len(tree.tags), tree.tags, tree.parent
    like = [ROLES.get(r, t) if r else t for t, r in zip(tags, tree.roles, strict=True)]
    columns: list[tuple[int, int]] = []
    put = lambda i, what: columns.append((i, _AT[what]))
    outside, inside, holds, large = [False] * n, [False] * n, [False] * n, _large(tree, like)
    for i in range(n):
        p, tag = parent[i], like[i]
        columns.append((i, _TAG_NO.get(tag, len(TAGS))))
        names = tree.names[i] if tag not in ("html", "body") else ""
        hints = (_short_hinted if len(names) <= 400 else _hinted)(names) if names else ()
        columns += [(i, len(TAGS) + 1 + h) for h in hints]
        content = N_BOILER in hints and not any(h < N_BOILER for h in hints)
        boiler = bool(hints) and hints[0] < N_BOILER and (tag not in ("article", "main") or _COMMENT in hints) and not large[i]
        hidden = tree.roles[i] == "hidden"
        if hidden:
            put(i, "hidden")
        in_header = tag == "header" and not inside[p] if i else False
        if in_header:
            put(i, "in header")
        if boiler:
            put(i, "in hinted")
        outside[i] = (i > 0 and outside[p]) or (tag in OUTSIDE and not (tag == "form" and large[i])) or hidden or in_header or boiler
        inside[i] = (i > 0 and inside[p]) or (not outside[i] and (tag in ("article", "main") or content))
        if inside[i]:
            put(i, "in article")
            if i and not holds[p] and not inside[p]:
                j = p
                while j >= 0 and not holds[j]:
                    holds[j] = True
                    j = parent[j]
    chars, linked, words, links, clean = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    bare = [False] * n
    for node, text in tree.pieces:
        if text:
            k = len(text) if not text.isspace() else 0
            chars[node] += k
            words[node] += len(text.split()) if k else 0
            bare[node] = bare[node] or k > 0
            if tags[node] == "a":
                linked[node] += k
            elif not outside[node]:
                clean[node] += k
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        chars[p] += chars[i]
        words[p] += words[i]
        clean[p] += clean[i]
        links[p] += links[i] + (tags[i] == "a")
        linked[p] += chars[i] if tags[i] == "a" else linked[i]
    x = np.zeros((n, N_FEATURES), np.float32)
    at = np.array(columns, np.int64)
    x[at[:, 0], at[:, 1]] = 1
    c, w, density = (np.array(v, np.float32) for v in (chars, words, linked))
    density /= np.maximum(c, 1)
    listed = np.array([t in ("ul", "ol", "li", "div", "dl", "table") for t in tags]) & (np.array(links) > 0)
    out = np.array(outside)
    x[:, _AT["in outside"]] = out
    x[:, _AT["article elsewhere"]] = (not inside[0]) and any(inside)
    x[:, _AT["article elsewhere"]] *= ~np.array(inside) & ~np.array(holds)
    x[:, _AT["holds article"]] = holds
    x[:, _AT["linked"]] = density
    x[:, _AT["linked list"]] = density * listed
    x[:, _AT["mostly linked"]] = (density > 0.6) & listed
    menu = listed & (density > 0.6) & (np.array(links) > 2) & ~np.array(inside)
    for i in range(1, n):
        menu[i] |= menu[parent[i]]
    x[:, _AT["in links"]] = menu
    x[:, _AT["words > 5"]] = w > 5
    x[:, _AT["words > 40"]] = w > 40
    share = np.array(clean, np.float32) / max(1, clean[0])
    x[:, _AT["share"]] = share
    x[:, _AT["share > half"]] = share > 0.5
    x[:, _AT["bare"]] = bare
    x[:, _AT["bare page"]] = np.array(bare) & np.array([t in ("html", "body") for t in tags])
    x[:, _AT["has text"]] = c > 0
    x[:, _AT["one"]] = 1
    return x


def _kind(tag: str, name: str) -> int:
    """Kinds of edges: into containers, headings, text blocks, lists and inline elements."""
    return 0 if tag in ("div", "section", "article", "main", "body", "table", "tbody", "tr", "td") else 1 if tag in HEADINGS else 2 if tag in ("p", "blockquote", "pre", "li", "dd", "dt", "figcaption") else 3 if tag in BLOCK else 4


@dataclass
class Model:
    weights: np.ndarray
    pair: np.ndarray  # log P(child label | parent label, kind) - log P(child label | kind): (kind, parent, child)


def marginals(tree: Tree, model: Model, unary: np.ndarray | None = None) -> np.ndarray:
    """Content marginal of each node by sum-product messages up and down the tree."""
    n = len(tree.tags)
    logit = np.clip(node_features(tree) @ model.weights, -12, 12) if unary is None else unary
    odds = np.exp(logit).tolist()  # content to boilerplate
    pair = np.exp(model.pair).tolist()
    parent, kinds = tree.parent, [_kind(t, "") for t in tree.tags]
    up0, up1, m0, m1 = [1.0] * n, odds, [1.0] * n, [1.0] * n
    for i in range(n - 1, 0, -1):
        (a, b), (c, d) = pair[kinds[i]]
        x, y = up0[i], up1[i]
        e, f = a * x + b * y, c * x + d * y
        s = 1 / (e + f)
        m0[i], m1[i] = e * s, f * s
        p = parent[i]
        x, y = up0[p] * m0[i], up1[p] * m1[i]
        s = 1 / (x + y)
        up0[p], up1[p] = x * s, y * s
    out = [0.0] * n
    b0, b1 = up0[:], up1[:]
    for i in range(n):
        if i:
            p = parent[i]
            (a, b), (c, d) = pair[kinds[i]]
            x, y = b0[p] / m0[i], b1[p] / m1[i]
            s = 1 / (x + y)
            x, y = x * s, y * s
            b0[i], b1[i] = up0[i] * (x * a + y * c), up1[i] * (x * b + y * d)
            s = 1 / (b0[i] + b1[i])
            b0[i], b1[i] = b0[i] * s, b1[i] * s
        out[i] = b1[i] / (b0[i] + b1[i])
    return np.array(out)


def text_of(tree: Tree, content: np.ndarray) -> str:
    """Blocks of the pieces whose node is content."""
    blocks, parts = [], []

    def end() -> None:
        if parts:
            block = _WHITE.sub(" ", html.unescape("".join(parts)) if "&" in (s := "".join(parts)) else s).strip()
            if block:
                blocks.append(block)
            parts.clear()

    for node, text in tree.pieces:
        if text is None:
            end()
        elif content[node]:
            parts.append(text)
    end()
    return "\n".join(blocks)


def extract(page: str | None, model: Model, threshold: float = THRESHOLD) -> str:
    if not page:
        return ""
    tree = parse(page)
    return text_of(tree, (marginals(tree, model) >= threshold).tolist())


def labelled_pages(n: int = LABELLED_PAGES, seed: int = SEED):
    """Made-up pages; content words start with k, all other words with q."""
    rng = random.Random(seed)
    pick = rng.choice

    words = {c: [c + "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(800)] for c in "kq"}

    def word(c: str) -> str:
        return pick(words[c])

    def run(c: str, a: int, b: int) -> str:
        return " ".join(rng.choices(words[c], k=rng.randint(a, b)))

    def named(*names: str) -> str:
        extra = pick(("", "", "", "x1 ", "js-", "col-4 "))
        attribute = pick(("class", "class", "id"))
        return pick((f'{attribute}="{extra}{pick(names)}"', f"{attribute}='{pick(names)}'", f"{attribute}={pick(names)}", f'title=don\'t {attribute}="{pick(names)}"'))

    def links(c: str, a: int = 3, b: int = 12) -> str:
        return "".join(f"<li><a href='/x'>{run(c, 1, 3)}</a>" + pick(("</li>", "")) for _ in range(rng.randint(a, b)))

    def body() -> str:
        text = pick((run("q", 3, 30), f"<p>{run('q', 5, 40)}</p>", f"<p>{run('q', 5, 40)}<p>{run('q', 3, 20)}", f"<h3>{run('q', 1, 4)}</h3><p>{run('q', 4, 25)}</p>", f"<div><p>{run('q', 4, 25)} <a href=/q>{run('q', 1, 4)}</a></p></div>", f"<ul>{links('q')}</ul>"))
        return pick((text, text, f"<div>{text}</div>", f"<div class=inner><div>{text}</div></div>"))

    def menu() -> str:
        bar = " | ".join(f"<a href=/q>{run('q', 1, 2)}</a>" for _ in range(rng.randint(3, 9)))
        return pick((f"<nav><ul>{links('q')}</ul></nav>", f"<nav>{bar}</nav>", f"<div {named('menu', 'navbar', 'breadcrumbs', 'site-nav', 'pagination')}><ul>{links('q')}</ul></div>", f"<ul id=menu>{links('q')}</ul>", f"<div>{bar}</div>", f"<ul>{links('q', 4)}</ul>", f"<div role=navigation>{bar}</div>"))

    def advert() -> str:
        return f"<div {named('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'promo', 'banner', 'advertisement')}>{body()}</div>"

    def side() -> str:
        return pick((f"<aside>{body()}</aside>", f"<aside {named('sidebar', 'box')}>{body()}{body()}</aside>", f"<div {named('sidebar', 'widget', 'related', 'side-col', 'related-posts', 'popular', 'trending')}>{body()}<ul>{links('q')}</ul></div>", f"<div role=complementary>{body()}</div>"))

    def notice() -> str:
        return pick((f"<div {named('cookie-notice', 'notice', 'cookie-banner', 'alert', 'newsletter', 'popup', 'subscribe', 'consent', 'gdpr')}>{body()}<button>{run('q', 1, 2)}</button></div>", f"<dialog>{body()}</dialog>", f"<div role=alert>{body()}</div>"))

    def form() -> str:
        return f"<form action='/s'><label>{run('q', 1, 3)}</label><input name=a><p>{run('q', 2, 12)}</p><select><option>{run('q', 1, 2)}<option>{run('q', 1, 2)}</select><textarea>{run('q', 1, 5)}</textarea><button>{run('q', 1, 2)}</button></form>"

    def comments() -> str:
        tag = pick(("section", "div"))
        each = pick(("div", "article", "li"))
        rows = "".join(f"<{each} class='comment'><b>{run('q', 1, 2)}</b><p>{run('q', 5, 60)}</p></{each}>" for _ in range(rng.randint(1, 5)))
        rows = f"<ol>{rows}</ol>" if each == "li" else rows
        return f"<{tag} {named('comments', 'comment-list', 'reader-comments', 'responses', 'discussion')}><h2>{run('q', 1, 3)}</h2>{rows}</{tag}>"

    def tools() -> str:
        return f"<div {named('share', 'social', 'tags', 'toolbar', 'share-buttons')}><a href=#>{run('q', 1, 2)}</a> <a href=#>{run('q', 1, 2)}</a></div>"

    def hidden() -> str:
        return f"<div {pick(('style=\"display:none\"', 'hidden', 'aria-hidden=true', 'style=\"color:red;display: none\"'))}>{body()}</div>"

    def top() -> str:
        return pick((f"<header><a href='/'>{run('q', 1, 3)}</a><p>{run('q', 2, 8)}</p></header>", f"<div {named('header', 'masthead', 'topbar')}><h1>{run('q', 1, 3)}</h1></div>", f"<header><h1>{run('q', 1, 4)}</h1>{menu()}</header>", f"<div role=banner>{run('q', 1, 6)}</div>"))

    def bottom() -> str:
        return pick((f"<footer>&copy; {run('q', 1, 8)}</footer>", f"<footer><p>{run('q', 2, 20)}</p><ul>{links('q')}</ul></footer>", f"<div {named('footer', 'site-footer', 'copyright')}>{run('q', 2, 16)}</div>", f"<footer><div><p>{run('q', 2, 16)}</p></div></footer>"))

    def text() -> str:
        return pick((
            run("k", 1, 6), run("k", 5, 60), run("k", 20, 120), f"{run('k', 3, 20)} <a href='/y'>{run('k', 1, 4)}</a> {run('k', 3, 30)}", f"<b>{run('k', 1, 4)}</b> {run('k', 4, 50)}",
            f"<b>{run('k', 4, 40)}.<br>", f"{run('k', 4, 30)} &amp; <em>{run('k', 1, 5)}</em>", f"{run('k', 1, 3)} <a href=/y>{run('k', 2, 6)}</a>{pick(('.', ' ' + run('k', 1, 3)))}", f"{run('k', 1, 9)} <math><mi>{word('k')}</mi><mo>=</mo></math> {run('k', 1, 9)}",
            f"<a href=/y>{run('k', 1, 5)}</a>", f"<span>{run('k', 2, 20)}</span><sup><a href=#n>1</a></sup> {run('k', 2, 20)}"))

    def block() -> str:
        kind = rng.randrange(22)
        if kind < 12:
            return f"<p>{text()}" + pick(("</p>", "</p>", ""))
        return (
            f"<{(h := pick(('h2', 'h3', 'h4')))}>{run('k', 1, 6)}</{h}>", f"<ul>{''.join(f'<li>{run(chr(107), 2, 15)}</li>' for _ in range(rng.randint(1, 5)))}</ul>", f"<blockquote><p>{text()}</p></blockquote>",
            f"<pre>{run('k', 3, 30)}</pre>", f"<table><tr><td>{run('k', 1, 4)}<td>{run('k', 1, 9)}<tr><td>{pick(('1', word('k')))}<td>2</table>", f"<figure><img src=a><figcaption>{run('k', 2, 10)}</figcaption></figure>",
            f"<div>{run('k', 3, 40)}</div>", f"<div class=row><div><p>{text()}</p><p>{text()}</p></div></div>", f"<section><h2>{run('k', 1, 4)}</h2><p>{text()}</p></section>", f"<dl><dt>{run('k', 1, 3)}<dd>{run('k', 2, 12)}</dl>")[kind - 12]

    boiler = (menu, advert, side, notice, form, comments, tools, hidden)
    for i in range(n):
        blocks = [block() for _ in range(pick((1, 1, 2, 3, rng.randint(2, 6), rng.randint(4, 14))))]
        shape = rng.randrange(20)
        if shape == 0:  # no block at all
            plain = pick((run("k", 1, 60), f"{run('k', 3, 30)}<br><br>{run('k', 3, 30)}", f"<b>{run('k', 1, 5)}</b> {run('k', 1, 40)}", f"{run('k', 1, 40)} <a href=/y>{run('k', 1, 5)}</a>"))
            yield plain if rng.random() < 0.5 else f"<html><head><title>{run('q', 1, 5)}</title></head><body>{plain}{pick(('', bottom()))}</body></html>"
            continue
        for _ in range(pick((0, 0, 0, 1, 1, 2))):
            blocks.insert(rng.randint(1, len(blocks)), pick((advert, side, notice, form, tools, hidden, advert))())
        before, after = ("".join(pick(boiler)() for _ in range(pick((0, 1, 2, 3)))) for _ in range(2))
        head = pick((f"<h1>{run('k', 1, 10)}</h1>", f"<h1>{run('k', 1, 10)}</h1><div class={pick(('byline', 'author', 'meta'))}>{run('k', 1, 4)}</div>", ""))
        if shape < 12:
            tag, name = pick((("article", ""), ("article", ""), ("main", ""), ("article", " class='post-3 post has-sidebar'"), ("div", " role=main"), ("main", " id=content")))
            if tag == "article":
                head = pick((head, f"<header>{head}</header>"))
                blocks += [pick((f"<footer>{run('q', 1, 9)}</footer>", f"<footer>{tools()}</footer>", comments()))] if rng.random() < 0.2 else []
        elif shape < 17:
            tag, name = pick((("div", " class='content'"), ("div", " id='main'"), ("div", " class='post-body'"), ("section", " class='entry'"), ("div", " class='story'"), ("div", " class='entry-content'"), ("div", " id=article-text")))
        else:
            tag, name = pick((("div", ""), ("div", " class=c7"), ("section", ""), ("", "")))
        shell = f"<{tag}{name}>{head}{''.join(blocks)}</{tag}>" if tag else head + "".join(blocks)
        if rng.random() < 0.3:
            shell = f"<div class='{pick(('wrap', 'container', 'page', 'row', 'site-content', 'content-sidebar-wrap' if tag in ('article', 'main') else 'wrap'))}'>{shell}{pick(('', pick(boiler)()))}</div>"
        if rng.random() < 0.05 and tag in ("article", "main"):
            shell = f"<form id=aspnetForm action=/>{shell}</form>"
        top_, foot = pick(("", top())), pick(("", bottom()))
        start = pick(("<!DOCTYPE html><html><head>", "<html lang=en><head><meta charset=utf-8>", "<head>")) + f"<title>{run('q', 1, 5)}</title><style>p{{margin:0}}</style><script>var t='<p>q</p>';</script></head><body{pick(('', '', ' class=comments-open'))}>"
        yield f"{start}{top_}{before}<!-- q {i} -->{shell}{after}{foot}{pick(('</body></html>', ''))}"


def labels_of(tree: Tree) -> np.ndarray:
    """1 for nodes whose subtree has more content words than others, 0 for the other way round, -1 for nodes without text."""
    n = len(tree.tags)
    score = np.zeros(n)
    total = np.zeros(n)
    for node, text in tree.pieces:
        for w in (text or "").split():
            score[node] += w.lstrip("<")[:1] == "k"
            total[node] += w[:1] in ("k", "q")
    own, own_total = score.copy(), total.copy()
    for i in range(n - 1, 0, -1):
        score[tree.parent[i]] += score[i]
        total[tree.parent[i]] += total[i]
    share = np.where(own_total > 0, own / np.maximum(own_total, 1), score / np.maximum(total, 1))
    return np.where(total == 0, -1, (share > 0.5).astype(int))


def fit(pages, rounds: int = 12) -> Model:
    """Logistic node weights by Newton's method and pair potentials from counts, of labelled pages."""
    trees = [parse(p) for p in pages]
    x = np.concatenate([node_features(t) for t in trees]).astype(np.float64)
    y = np.concatenate([labels_of(t) for t in trees])
    # many nodes look alike: each different row counts once, with its number of content nodes and of all
    rows, place = np.unique(x[y >= 0], axis=0, return_inverse=True)
    hit, all_ = np.bincount(place, y[y >= 0]), np.bincount(place)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        w -= np.linalg.solve((rows * (all_ * p * (1 - p) + 1e-9)[:, None]).T @ rows + np.eye(len(w)), rows.T @ (all_ * p - hit) + w)
    counts, base = np.ones((5, 2, 2)), np.ones((5, 2))
    at = 0
    for t in trees:
        labels = y[at : at + len(t.tags)]
        at += len(t.tags)
        for i in range(1, len(t.tags)):
            if labels[i] >= 0 and labels[t.parent[i]] >= 0:
                k = _kind(t.tags[i], t.names[i])
                counts[k, labels[t.parent[i]], labels[i]] += 1
                base[k, labels[i]] += 1
    pair = np.log(counts / counts.sum(axis=2, keepdims=True)) - np.log(base / base.sum(axis=1, keepdims=True))[:, None, :]
    return Model(w.astype(np.float32), pair)


def train(n: int = LABELLED_PAGES, seed: int = SEED) -> Model:
    return fit(list(labelled_pages(n, seed)))


def extract_pages(pages: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, text, n_chars."""
    chosen = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few kB

    def run(batches):
        for batch in lean(batches):
            texts = [extract(x.as_py(), shared.value, threshold) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:2]) + ", text string, n_chars long"
    return chosen.mapInArrow(run, schema)
