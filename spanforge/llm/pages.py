"""Main-text extraction from web pages by gradient-boosted trees over DOM nodes.

A page is parsed into block elements and *runs*: text without a block boundary in it, inline
elements included.  Each node has features of its subtree (text, link and tag densities,
punctuation, paragraphs, list items, form fields), its attributes' tokens and those above it, its
depth, and its place and share among its siblings and on the page.  Boosted trees, fitted here on
generated pages whose runs are labelled (``practice``, a fixed number), give each node the log odds
that it holds main text.

Decoding is hierarchical: of all labellings in which a node with main text has it from a child or is
a run, and a node without has none below it, the likeliest is found by dynamic programming over the
tree, so that no choice contradicts an ancestor's or descendant's.

Defined results: null or empty pages give an empty text; character references are decoded; white
space within a run (line breaks included) is one space; runs are trimmed, empty ones dropped, and
the rest joined in page order by a line feed.  Unclosed and misnested elements, unclosed comments,
scripts and tags are parsed as far as they go.  Repeated rows give repeated results; other columns
are ignored.  A page is one record; nothing is shuffled.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.llm.boosting import Boosted, boost
from spanforge.sources.tables import table

PRACTICE_PAGES = 300
BATCH = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|iframe|textarea|title|xmp|noembed|noframes)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?:svg|math)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?<=/)>"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+|[^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_HELD = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("template", "svg", "math", "object", "canvas", "audio", "video", "select")}
_ATTR = re.compile(r"(?:\A|(?<=[\s\"'/]))([^\s=\"'/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]++))")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}, "body": {"head"}}
_SCOPE = frozenset("ul ol dl table body html article section main nav aside form".split())

KINDS = ("run", "div", "p", "heading", "list", "li", "table", "cell", "quote", "article", "main", "section", "nav", "header", "footer", "aside", "form", "field", "figure", "body", "other")
_KIND = {"div": "div", "p": "p", "ul": "list", "ol": "list", "dl": "list", "menu": "list", "li": "li", "dt": "li", "dd": "li", "table": "table", "tr": "table", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "quote", "article": "article", "main": "main", "section": "section", "nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "fieldset": "form", "input": "field", "button": "field", "label": "field", "legend": "field", "dialog": "form", "figure": "figure", "figcaption": "figure", "html": "body", "body": "body"}
_KIND |= {f"h{k}": "heading" for k in range(1, 7)}
_NUMBER = {k: i for i, k in enumerate(KINDS)}
#: Attribute tokens by what they hint at; which of them matter, and how, is learnt.
HINTS = {
    "text": "article content entry post story main body text prose page blog",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pager pagination tabs toc",
    "advert": "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense",
    "comment": "comment comments reply replies respond disqus discussion reader",
    "foot": "footer foot copyright legal colophon bottom imprint",
    "head": "header head masthead logo top topbar branding site title",
    "side": "sidebar side widget widgets related recommended popular trending more aside rail teaser complementary",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay dialog warning message info",
    "share": "share sharing social follow twitter facebook",
    "form": "newsletter subscribe subscription signup login search form register contact",
    "meta": "meta byline author date tags tag category",
    "hidden": "hidden invisible none",
}
_HINT = {w: 1 << i for i, words in enumerate(HINTS.values()) for w in words.split()}
_MARKS = (",", ".", "!", "?", ";", ":")


class Page:
    """Nodes of one page in document order: ``kind``, ``parent``, ``end`` (behind the subtree),
    ``depth``, ``hint`` and ``above`` (own and inherited tokens and kinds), run ``text`` and counts.
    ``practice`` pages have labels, which no other page's attributes are taken for.  The open elements of
    each name are known by their place, so that every tag costs the same however deep it is."""

    def __init__(self, source: str, practice: bool = False) -> None:
        self._practice = practice
        self._places: dict[str, list[int]] = {}  # of open elements on the stack, by tag
        self.kind: list[int] = []
        self.parent: list[int] = []
        self.end: list[int] = []
        self.depth: list[int] = []
        self.hint: list[int] = []
        self.above: list[int] = []
        self.counts: list[tuple[int, int, int, int, int]] = []  # of runs: characters, link characters, words, marks, digits
        self.text: dict[int, str] = {}
        self.label: dict[int, int] = {}
        self._stack: list[tuple[str, int, int]] = []  # tag, node, practice label
        self._links = 0
        self._parts: list[str] = []
        self._linked = 0
        self._open("html", "")
        at = 0
        never: set[str] = set()  # held elements whose end does not come any more
        while m := _TOKEN.search(source, at):
            if m.start() > at:
                self._add(source[at : m.start()])
            at = m.end()
            tag = m["tag"]
            if tag is None:
                if (m["raw"] or "").lower() == "textarea":
                    self._open("input", "")
                    self._close_to(len(self._stack) - 1)
                continue
            tag = tag.lower()
            if tag in _HELD and not m["close"] and tag not in never:
                if end := _HELD[tag].search(source, at):
                    at = end.end()
                    if tag == "select":
                        self._open("input", "")
                        self._close_to(len(self._stack) - 1)
                    continue
                never.add(tag)
            if tag in _INLINE:
                if tag == "br":
                    self._parts.append(" ")
                elif tag == "a":
                    self._links = 0 if m["close"] else 1
                continue
            self._flush()
            if m["close"]:
                if (k := self._last(tag)) > 0:
                    self._close_to(k)
            elif tag not in ("html", "head") and not (tag == "body" and self._last("body") >= 0):
                self._end_implied(tag)
                self._open(tag, m["attrs"])
                if tag in _VOID or m["attrs"].endswith("/") and tag in ("input",):
                    self._close_to(len(self._stack) - 1)
        if at < len(source):
            self._add(source[at:])
        self._flush()
        self._close_to(0)

    def _last(self, *tags: str) -> int:
        """The place of the innermost open element of these tags, or -1."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=-1)

    def _end_implied(self, tag: str) -> None:
        if tag in _ENDS_P and (k := self._last("p")) > self._last("td", "th", "button", "object", "table", "body"):
            self._close_to(k)
        ends = _ENDS.get(tag)
        while ends and (k := self._last(*ends)) > max(0, self._last(*(_SCOPE - ends))):
            self._close_to(k)
            if tag not in ("tr", "tbody", "tfoot", "thead"):
                break

    def _node(self, kind: int, hint: int) -> int:
        node = len(self.kind)
        parent = self._stack[-1][1] if self._stack else -1
        self.kind.append(kind)
        self.parent.append(parent)
        self.end.append(node + 1)
        self.depth.append(len(self._stack))
        self.hint.append(hint)
        self.above.append((self.above[parent] | self.hint[parent] | 1 << 20 + self.kind[parent]) if parent >= 0 else 0)
        self.counts.append((0, 0, 0, 0, 0))
        return node

    def _open(self, tag: str, attrs: str) -> None:
        hint, label = 0, self._stack[-1][2] if self._stack else 0
        if "=" in attrs:
            for name, a, b, c in _ATTR.findall(attrs):
                name = name.lower()
                if name in ("class", "id", "role", "itemprop", "aria-label", "style"):
                    for w in _WORD.findall(_CAMEL.sub(" ", a or b or c).lower()):
                        hint |= _HINT.get(w, 0)
                elif self._practice and name == "data-practice":
                    label = int(a)
        if "hidden" in attrs and re.search(r"(?:^|\s)(?:hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true)", attrs):
            hint |= _HINT["hidden"]
        node = self._node(_NUMBER[_KIND.get(tag, "other")], hint)
        self.label[node] = label
        self._places.setdefault(tag, []).append(len(self._stack))
        self._stack.append((tag, node, label))

    def _close_to(self, k: int) -> None:
        n = len(self.kind)
        for tag, node, _ in reversed(self._stack[k:]):
            self.end[node] = n
            self._places[tag].pop()
        del self._stack[k:]

    def _add(self, text: str) -> None:
        if "&" in text:
            text = html.unescape(text)
        self._parts.append(text)
        if self._links:
            self._linked += len(text)

    def _flush(self) -> None:
        if not self._parts:
            return
        text = " ".join("".join(self._parts).split())
        linked, self._parts, self._linked = self._linked, [], 0
        if not text:
            return
        node = self._node(0, 0)
        self.text[node] = text
        self.label[node] = self._stack[-1][2]
        digits = sum(map(str.isdigit, text)) if len(text) < 400 else 0
        self.counts[node] = (len(text), min(linked, len(text)), text.count(" ") + 1, sum(map(text.count, _MARKS)), digits)


def features(pages: list[Page]) -> np.ndarray:
    """One row per node of all pages, in order."""
    sizes = np.array([len(p.kind) for p in pages])
    base = np.repeat(np.cumsum(sizes) - sizes, sizes)
    flat = lambda name: np.concatenate([np.asarray(getattr(p, name), np.int64) for p in pages])
    kind, depth, hint, above = flat("kind"), flat("depth"), flat("hint"), flat("above")
    parent, end = flat("parent"), flat("end") + base
    root = parent < 0
    parent = np.where(root, np.arange(len(kind)), parent + base)
    counts = np.concatenate([np.asarray(p.counts, np.float64) for p in pages])
    here = np.arange(len(kind))

    def below(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(values)])
        return total[end] - total[here]

    chars, linked, words, marks, digits = (below(counts[:, i]) for i in range(5))
    runs = below(kind == 0)
    nodes = (end - here).astype(np.float64)
    start = np.concatenate([[0.0], np.cumsum(counts[:, 0])])[here]
    top = base
    page_chars = np.maximum(chars[top], 1)
    children = np.bincount(parent[~root], minlength=len(kind)).astype(np.float64)
    order = np.zeros(len(kind))
    seen = np.argsort(parent, kind="stable")
    order[seen] = np.arange(len(kind)) - np.searchsorted(parent[seen], parent[seen])
    up_chars = np.maximum(chars[parent], 1)
    siblings = np.maximum(children[parent], 1)
    before = np.r_[0, here[:-1]]
    cols = [
        depth, np.log1p(chars), np.log1p(words), np.log1p(runs), linked / np.maximum(chars, 1), marks / np.maximum(words, 1), digits / np.maximum(chars, 1), chars / np.maximum(runs, 1),
        nodes / np.maximum(chars, 1), children, chars / page_chars, (start - start[top]) / page_chars, chars / up_chars, order / siblings, siblings, chars[parent] / siblings,
        linked[parent] / up_chars, chars[parent] / page_chars, marks[parent] / np.maximum(words[parent], 1), words / np.maximum(runs, 1), np.log1p(chars[before]),
    ]
    for name in ("p", "li", "field", "heading", "figure"):
        own = below(kind == _NUMBER[name])
        cols += [own / np.maximum(nodes, 1), own[parent] / np.maximum(nodes[parent], 1)]
    cols += [kind == i for i in range(len(KINDS))] + [kind[parent] == i for i in range(len(KINDS))]
    cols += [above >> 20 + i & 1 for i in range(1, len(KINDS))]
    cols += [hint >> i & 1 for i in range(len(HINTS))] + [above >> i & 1 for i in range(len(HINTS))]
    return np.stack([np.asarray(c, np.float32) for c in cols], axis=1)


def decode(page: Page, margin: np.ndarray) -> list[str]:
    """The runs of the likeliest labelling without contradictions."""
    n = len(page.kind)
    size = np.maximum(np.array([c[0] for c in page.counts], float), 1.0)
    weight = np.where(np.array(page.kind) == 0, 1 + np.log1p(size), 1.0)
    gain = margin * weight  # of labelling a node 1 rather than 0
    best = gain.tolist()  # of a node's subtree, the node labelled 1, over all labelled 0
    inner = [0.0] * n  # what children add that are better labelled 1
    most = [-1e18] * n  # the best child, if none is better labelled 1
    for v in range(n - 1, -1, -1):
        if page.kind[v]:
            if most[v] == -1e18:
                best[v] = -1e18  # an element without runs holds no text
            else:
                best[v] += inner[v] if most[v] > 0 else most[v]
        if v:
            u, b = page.parent[v], best[v]
            if b > 0:
                inner[u] += b
            if b > most[u]:
                most[u] = b
    kept = [False] * n
    kept[0] = best[0] > 0
    out = []
    for v in range(n):
        if v:
            u = page.parent[v]
            kept[v] = kept[u] and (best[v] > 0 or best[v] == most[u] and most[u] <= 0)
        if kept[v] and not page.kind[v]:
            out.append(page.text[v])
    return out


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice(("an", "the", "er", "ing", "re", "sol", "ti", "ou", "è", "st", "en", "ma", "lo", "qui", "u")) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    words = [w + "," if r.random() < 0.1 else w for w in words]
    return " ".join(words).capitalize() + r.choice((".", ".", ".", "!", "?"))


def practice(seed: int) -> str:
    """A generated page; ``data-practice`` marks main text with 1."""
    r = random.Random(seed)
    text = lambda a=1, b=6: " ".join(_sentence(r, 3, 16) for _ in range(r.randint(a, b)))
    few = lambda: " ".join(_sentence(r, 1, 4)[:-1] for _ in range(r.randint(1, 2)))
    link = lambda: f'<a href="/{r.randint(1, 999)}">{few()}</a>'
    attr = lambda *names: r.choice((f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="x{r.randint(1, 99)} {r.choice(names)}"'))
    wrap = lambda semantic, names, inner: f"<{semantic}>{inner}</{semantic}>" if r.random() < 0.5 else f"<div{attr(*names)}>{inner}</div>"
    links = lambda a=3, b=9: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(r.randint(a, b))) + "</ul>"
    close = r.choice(("</p>", "</p>", "</p>", ""))

    def menu() -> str:
        return wrap("nav", ("nav", "menu", "navbar", "breadcrumbs"), links() if r.random() < 0.8 else " | ".join(link() for _ in range(5)))

    def advert() -> str:
        return r.choice(("<!-- ad -->", "")) + f"<div{attr('ad', 'ads', 'advert', 'banner', 'sponsored', 'promo')}>{text(1, 2)}</div>"

    def comments() -> str:
        one = lambda: r.choice((f"<p>{text(1, 4)}</p>", f'<div class="{r.choice(("comment", "reply"))}"><b>{few()}</b><p>{text(1, 3)}</p></div>', f"<li><p>{text(1, 3)}</p></li>"))
        return f"<{(tag := r.choice(('section', 'div', 'ol')))}{attr('comments', 'comment-list', 'replies', 'discussion', 'respond')}>" + r.choice(("<h2>Comments</h2>", "")) + "".join(one() for _ in range(r.randint(1, 8))) + f"</{tag}>"

    def side() -> str:
        return wrap("aside", ("sidebar", "side", "widget", "related", "popular"), f"<h3>{few()}</h3>" + r.choice((links(), f"<p>{text(1, 3)}</p>", f"<p>{text(1, 2)}</p>" + links())))

    def notice() -> str:
        return f"<div{r.choice((attr('cookie-notice', 'cookie-banner', 'consent', 'gdpr', 'notice', 'alert', 'popup'), ' role="alert"', ' role="dialog"'))}><p>{text(1, 3)}</p>{r.choice(('<button>OK</button>', ''))}</div>"

    def form() -> str:
        return f"<form{r.choice(('', attr('newsletter', 'subscribe', 'login', 'search', 'contact')))}>{r.choice(('', f'<p>{text(1, 2)}</p>'))}<label>{few()}</label><input name=q>" + r.choice(("", "<textarea>x</textarea>")) + f"<button>{few()}</button></form>"

    def share() -> str:
        return f"<div{attr('share', 'social', 'follow', 'tags', 'byline')}>{' '.join(link() for _ in range(r.randint(1, 4)))}</div>"

    def block() -> str:
        kind = r.random()
        if kind < 0.62:
            return f"<p>{text(1, r.choice((1, 3, 6, 12)))}{close}"
        if kind < 0.7:
            return f"<p>{text(1, 3)} {link()} {text(1, 2)}</p>"
        if kind < 0.76:
            return f"<p><b>{text(1, 2)}<br><p>{text(1, 5)}</p>"
        if kind < 0.82:
            return f"<h{(h := r.randint(2, 4))}>{few()}</h{h}>"
        if kind < 0.87:
            return f"<{(t := r.choice(('ul', 'ol')))}>" + "".join(f"<li>{text(1, 2)}</li>" for _ in range(r.randint(2, 6))) + f"</{t}>"
        if kind < 0.9:
            return f"<blockquote>{text(1, 3)}</blockquote>"
        if kind < 0.93:
            return f"<p>{few()}</p>"
        if kind < 0.96:
            return "<table>" + "".join(f"<tr><td>{few()}</td><td>{text(1, 1)}</td></tr>" for _ in range(r.randint(2, 4))) + "</table>"
        return f"<div>{text(1, 4)}</div>" if kind < 0.98 else f"<pre>{text(1, 2)}</pre>"

    def article() -> str:
        inner = r.choice((f"<h1>{text(1, 1)}</h1>", f"<h1>{few()}</h1>", ""))
        for _ in range(r.choice((0, 1, 2, 4, 8, 16, 30))):
            inner += block()
            if r.random() < 0.05:
                inner += f'<div data-practice="0">{r.choice((advert, share, side, form, notice))()}</div>'
        inner = inner or f"<p>{text(1, 2)}</p>"
        mark = ' data-practice="1"'
        style = r.random()
        if style < 0.4:
            return f"<article{mark}>{inner}</article>"
        if style < 0.55:
            return f"<main{mark}>{inner}</main>"
        if style < 0.85:
            return f"<{(t := r.choice(('div', 'section')))}{attr('content', 'post', 'entry-content', 'article-body', 'story', 'main', 'text')}{mark}>{inner}</{t}>"
        return f"<div{mark}>{inner}</div>"

    def footer() -> str:
        return wrap("footer", ("footer", "foot", "copyright", "site-footer"), f"&copy; {few()} &middot; {text(1, 2)}" + r.choice(("", links(2, 5))))

    def header() -> str:
        return wrap("header", ("header", "masthead", "topbar", "site-header"), r.choice((f"<h1>{few()}</h1>", f"<div{attr('logo')}>{few()}</div><p>{text(1, 1)}</p>", few())) + r.choice(("", links(2, 5))))

    maybe = lambda chance, *makers: "".join(m() for m in makers if r.random() < chance)
    before = maybe(0.4, notice, header) + maybe(0.7, menu) + maybe(0.45, advert) + maybe(0.15, side, form)
    middle = article()
    if r.random() < 0.35:
        middle = f"<div{r.choice(('', attr('wrapper', 'container', 'page', 'row')))}>{maybe(0.3, menu, side)}{middle}{maybe(0.3, share, side, comments)}</div>"
    after = maybe(0.25, share, comments, side, form, advert, notice) + maybe(0.8, footer)
    tail = r.choice(("</body></html>", "</body></html>", ""))
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{few()}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{before}{middle}{after}{tail}'


@functools.cache
def model(n_pages: int = PRACTICE_PAGES) -> Boosted:
    """Trees fitted on ``n_pages`` practice pages. A node is 1 if it holds main text."""
    pages = [Page(practice(k), True) for k in range(n_pages)]
    x = features(pages)
    y, weight = [], []
    for p in pages:
        own = np.array([p.label[v] if not p.kind[v] else 0 for v in range(len(p.kind))])
        total = np.r_[0, np.cumsum(own)]
        y.append(total[np.array(p.end)] - total[:-1] > 0)
        weight.append(np.where(np.array(p.kind) == 0, 2.0, 0.5))
    return boost(x, np.concatenate(y).astype(float), np.concatenate(weight))


def extract(sources: list[str | None], trees: Boosted) -> list[str]:
    """Main texts of pages."""
    pages = [Page(s or "") for s in sources]
    margin = trees.margin(features(pages)) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        out.append("\n".join(decode(p, margin[at : at + len(p.kind)])))
        at += len(p.kind)
    return out


def main_texts(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of every row."""
    trees = pages.sparkSession.sparkContext.broadcast(model())  # a fixed number of trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, BATCH):
                part = b.slice(k, BATCH)
                texts = extract(part.column(part.num_columns - 1).to_pylist(), trees.value)
                arrays = [*part.columns[:-1], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*part.schema.names[:-1], "text", "n_chars"])

    rows = pages.select(*keep, F.col(html_col).alias("_html"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{fields}, text string, n_chars long")


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return main_texts(table(spark, sf_dir, "pages"))
