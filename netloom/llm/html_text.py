"""Main text of web pages by a tree-structured graphical model.

A page is read into its element tree. Every element has a hidden state, content or not; potentials between parent and child say how
readily the state changes there, and an element's tag, the meaning of its class and id names, the length of its own text and its
links speak for either state. One upward and one downward pass of sum-product messages give the exact marginal
of every element, and the text of elements that are content more likely than not is kept, in page order. Where nothing is kept although the
page has running text outside unwanted containers, it is known to have content: the passes are run again with a root that is content.

The potentials are counted on labelled pages: a bounded sample of the input whose semantic containers label it (inside the article, but not
inside a menu, form and so on), and a few pages written here with their labels, so that kinds the sample lacks are known too.

Defined results: a null or empty page has the empty text; a page without any element is its own text, also one with a bare "<"; inside an article
links count as text, and names that speak of menus, forms, headers or footers are not heard on the article itself; marks of labels are read
in the pages of this module only; unclosed tags end with their parent, a tag cut off at the end is
markup; ties (a marginal of exactly one half) are not content; repeated rows each get a result; an empty table gives an
empty result; only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE_PAGES = 500               # labelled pages the potentials are counted on,
SAMPLE_CHARS = 100_000           # none of them longer than this, so that the sample is small on the driver
EVIDENCE = {"block": 0.5, "part": 0.25}   # exponents: neighbouring blocks, and parts of a block, repeat each other's evidence
SEED_WEIGHT = 20                 # a page labelled here counts as much as so many sampled ones

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template title textarea svg iframe".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data dfn em font i img kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
PARTS = INLINE | frozenset("ul ol li dl dt dd table thead tbody tfoot tr td th figure figcaption br".split())
KNOWN = frozenset("html body main article section header footer nav aside form div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table tr td th blockquote pre "
                  "figure figcaption a b i em strong span button select input".split())
# What class, id and role names mean, by whole name parts.
MEANINGS = {
    "advert": "ad ads advert advertisement adverts banner sponsor sponsored promo promotion",
    "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc",
    "header": "header masthead topbar branding logo", "footer": "footer copyright colophon legal",
    "side": "sidebar aside side widget related recommended trending popular share social rail",
    "notice": "notice cookie cookies consent gdpr popup modal alert overlay paywall disclaimer",
    "form": "form newsletter subscribe signup login search", "comments": "comment comments discussion disqus replies reply respond",
    "content": "content article post entry story main body text",
}
MEANING = {part: kind for kind, parts in MEANINGS.items() for part in parts.split()}
UNWANTED_TAGS = frozenset("nav aside footer header form button select".split())
CONTENT_TAGS = frozenset(("article", "main"))
UNHEARD = frozenset(("menu", "form", "header", "footer"))      # meanings that the name of an article does not change it by

# Labelled pages: an element with y="1" begins content, one with y="0" ends it for its subtree.
LABELLED = (
    '<html><body y="0"><header><h1>Name of the site</h1><p>A line about it</p></header><nav><ul><li><a>One</a></li><li><a>Two</a></li></ul></nav>'
    '<main y="1"><article><h1>Some heading of a text</h1><p>A long paragraph that goes on for some while and then for some more, until it has said what it had to say.</p>'
    '<aside y="0"><p>Elsewhere on this site</p></aside><p>Short.</p><h2>Next part</h2><p>Another long paragraph, with <b>bold</b> and <a>linked</a> words in it, that also goes on for a while.</p>'
    '<form y="0"><label>Your address</label><button>Send</button></form></article></main><aside><p>Most read</p><ul><li><a>Three</a></li></ul></aside>'
    '<footer><p>All rights kept by the site and its owners, whoever they may be in the end.</p></footer></body></html>',
    '<html><body y="0"><div class="cookie-notice"><p>We keep crumbs on your machine, and you are asked to agree to it before reading on.</p></div><div id="menu"><a>Home</a><a>About</a></div>'
    '<div class="content" y="1"><h1>Heading</h1><p>A long paragraph that tells the story from its beginning, with all the words it takes to tell it.</p><div class="ad" y="0">Buy this now, it is cheap.</div>'
    '<ul><li>A first point of the text</li><li>A second point</li></ul><blockquote><p>Words of somebody else, quoted at some length in the text.</p></blockquote>'
    '<section class="comments" y="0"><h3>Comments</h3><div class="comment"><p>A reader wrote quite a lot here about the text above, at length and with much feeling.</p></div></section></div>'
    '<div class="sidebar"><h3>Related</h3><ul><li><a>Other text</a></li></ul></div><div class="footer"><p>Imprint</p></div></body></html>',
    '<html><body y="0"><nav><a>Home</a></nav><article y="1"><h1>Heading</h1><p>First paragraph, long enough to be read as running text by anybody who looks at it.</p><p>No.</p>'
    '<table><tr><td>Cell</td><td>Other cell</td></tr></table><pre>code of some kind</pre><figure><figcaption>What the picture shows</figcaption></figure>'
    '<div><p>A paragraph in a box of its own which belongs to the text nevertheless, as its length shows.</p></div></article>'
    '<section id="comments"><article class="comment"><p>A remark of a reader that is long enough to look like running text but is none of it.</p></article></section>'
    '<div class="share"><a>Tell others</a></div><div class="newsletter"><p>Get our letter every week, free of charge, and never miss a text again.</p></div></body></html>',
    '<html><body y="0"><div><a>Home</a><a>About</a></div><h1 y="1">Heading of it all</h1><p y="1">A page without any container still has paragraphs, and this is one of them, long enough to be seen as such.</p>'
    '<p y="1">Another one follows it, with about as many words as the first, so that nobody takes it for a label or a link.</p><div><p>Imprint</p></div></body></html>',
)

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]+|"[^"]*"|'[^']*')*+)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
MARK = re.compile(r'\by="([01])"')


@dataclass
class Page:
    """Elements in page order, and the page as a row of texts and breaks."""
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    meaning: list[str] = field(default_factory=list)
    mark: list[str | None] = field(default_factory=list)
    own: list[int] = field(default_factory=list)
    within: list[bool] = field(default_factory=list)               # inside an article, with nothing unwanted between
    linked: list[bool] = field(default_factory=list)
    flow: list[tuple[int, str]] = field(default_factory=list)      # (element, text); (-1, "") is a break between blocks


def meaning_of(attributes: str) -> str:
    for m in NAMES.finditer(attributes):
        for part in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower()):
            if part in MEANING:
                return MEANING[part]
    return "none"


def read(page: str, marks: bool = False) -> Page:
    """The element tree; marks of labels are read only where asked for."""
    out, stack, n_open = Page(), [], Counter()

    def leave() -> None:
        tag = out.tag[stack.pop()]
        n_open[tag] -= 1
        if tag not in INLINE:
            out.flow.append((-1, ""))

    def close(tag: str) -> None:
        if n_open[tag]:
            while out.tag[stack[-1]] != tag:
                leave()
            leave()

    def enter(tag: str, attributes: str) -> None:
        out.parent.append(stack[-1] if stack else -1)
        out.tag.append(tag)
        meaning = meaning_of(attributes) if attributes else "none"
        out.meaning.append("none" if tag in CONTENT_TAGS and meaning in UNHEARD else meaning)
        m = MARK.search(attributes) if attributes and marks else None
        out.mark.append(m[1] if m else None)
        out.own.append(0)
        plain = tag not in UNWANTED_TAGS and out.meaning[-1] in ("none", "content")
        out.within.append(tag in CONTENT_TAGS or plain and bool(stack and out.within[stack[-1]]))
        out.linked.append(not out.within[-1] and (tag == "a" or bool(stack and out.linked[stack[-1]])))
        stack.append(len(out.tag) - 1)
        n_open[tag] += 1
        if tag not in INLINE:
            out.flow.append((-1, ""))

    def text(raw: str) -> None:
        if not stack:
            enter("body", "")
        out.own[stack[-1]] += len(raw)
        out.flow.append((stack[-1], raw))

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        if m.start() > at:
            text(page[at:m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, attributes = name.lower(), m[3] or m[6] or ""
        if m[1] or m[4]:
            close(tag)
            continue
        if tag in RAW and not attributes.endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID:
            if stack:
                out.flow.append((stack[-1], " "))
            continue
        if tag not in INLINE and n_open["p"]:
            _close_open(out, stack, "p", close)
        if tag in ("li", "dt", "dd", "tr", "td", "th", "option") and n_open[tag]:
            _close_open(out, stack, tag, close)
        enter(tag, attributes)
    return out


def _close_open(out: Page, stack: list[int], tag: str, close) -> None:
    """End an open element of this kind if only inline elements, or its own parts, lie above it."""
    for i in reversed(stack):
        if out.tag[i] == tag:
            close(tag)
            return
        if out.tag[i] not in INLINE and not (tag in ("tr", "td", "th") and out.tag[i] in ("td", "th")):
            return


def features(page: Page, i: int) -> tuple[str, str, int, bool]:
    tag, size = page.tag[i], page.own[i]
    if page.within[i] and tag in PARTS and page.meaning[i] == "none":
        tag = "part"                                               # lists and links of an article are not those of a menu
    return tag if tag in KNOWN or tag == "part" else "other", page.meaning[i], 0 if not size else 1 if size < 20 else 2 if size < 80 else 3, page.linked[i]


def turns(tag: str, meaning: str) -> bool:
    return meaning != "none" or tag in UNWANTED_TAGS or tag in CONTENT_TAGS


def kind(page: Page, i: int) -> str:
    """Where a state may change: readily at elements whose tag or name means something, rarely at blocks, hardly at parts of blocks."""
    if turns(page.tag[i], page.meaning[i]):
        return "turning"
    return "part" if page.tag[i] in PARTS else "block"


def teacher_states(page: Page) -> list[bool] | None:
    """Labels of a page: its own marks if it has any, else its semantic containers; none if it has no container."""
    marked = any(m is not None for m in page.mark)
    if not marked and not any(t in CONTENT_TAGS for t in page.tag):
        return None
    states: list[bool] = []
    for i, up in enumerate(page.parent):
        state = states[up] if up >= 0 else False
        if marked:
            state = page.mark[i] == "1" if page.mark[i] is not None else state
        elif page.tag[i] in UNWANTED_TAGS or page.meaning[i] not in ("none", "content"):
            state = False
        elif page.tag[i] in CONTENT_TAGS:
            state = not any(s == "comments" for s in _meanings_above(page, i))
        states.append(state)
    return states


def _meanings_above(page: Page, i: int) -> Iterator[str]:
    while i >= 0:
        yield page.meaning[i]
        i = page.parent[i]


@dataclass
class Model:
    """Counted potentials: state changes by kind of element, and evidence of each feature, with add-one smoothing."""
    change: dict[tuple[str, bool], Counter] = field(default_factory=dict)
    evidence: dict[tuple[int, bool], Counter] = field(default_factory=dict)
    cache: dict = field(default_factory=dict)

    def learn(self, page: Page, weight: float) -> None:
        states = teacher_states(page)
        if states is None:
            return
        for i, state in enumerate(states):
            up = states[page.parent[i]] if page.parent[i] >= 0 else False
            self.change.setdefault((kind(page, i), up), Counter())[state] += weight
            for k, value in enumerate(features(page, i)):
                self.evidence.setdefault((k, state), Counter())[value] += weight

    def step(self, kind_: str, up: bool, state: bool) -> float:
        c = self.change.get((kind_, up), Counter())
        return (c[state] + 0.5) / (sum(c.values()) + 1)

    def emitted(self, values: tuple) -> tuple[float, float]:
        if values not in self.cache:
            pair = []
            for state in (False, True):
                p = 1.0
                for k, value in enumerate(values):
                    c = self.evidence.get((k, state), Counter())
                    kinds = len(set(c) | set(self.evidence.get((k, not state), Counter()))) + 1
                    p *= (c[value] + 1) / (sum(c.values()) + kinds)
                pair.append(p)
            trust = 1.0 if turns(values[0], values[1]) else EVIDENCE["part" if values[0] in PARTS or values[0] == "part" else "block"]
            pair = [p ** trust for p in pair]
            total = sum(pair)
            self.cache[values] = (pair[0] / total, pair[1] / total)
        return self.cache[values]

    def marginals(self, page: Page, above: bool = False) -> list[float]:
        """P(content) of every element by one upward and one downward pass; ``above`` is the state the root hangs on."""
        n = len(page.tag)
        table = {k: tuple(tuple(self.step(k, up, s) for s in (False, True)) for up in (False, True)) for k in ("part", "block", "turning")}
        steps = [table[kind(page, i)] for i in range(n)]
        belief = [list(self.emitted(features(page, i))) for i in range(n)]
        sent: list[tuple[float, float]] = [(0.5, 0.5)] * n
        for i in range(n - 1, -1, -1):                      # children come after their parents
            (ff, ft), (tf, tt) = steps[i]
            b0, b1 = belief[i]
            m0, m1 = ff * b0 + ft * b1, tf * b0 + tt * b1
            sent[i] = (m0 / (m0 + m1), m1 / (m0 + m1))
            up = page.parent[i]
            if up >= 0:
                p0, p1 = belief[up][0] * sent[i][0], belief[up][1] * sent[i][1]
                belief[up] = [p0 / (p0 + p1), p1 / (p0 + p1)]
        full: list[tuple[float, float]] = []
        for i in range(n):
            up, ((ff, ft), (tf, tt)) = page.parent[i], steps[i]
            u0, u1 = (full[up][0] / sent[i][0], full[up][1] / sent[i][1]) if up >= 0 else (1.0 - above, 0.0 + above)
            a0, a1 = (u0 * ff + u1 * tf) * belief[i][0], (u0 * ft + u1 * tt) * belief[i][1]
            full.append((max(a0 / (a0 + a1), 1e-300), max(a1 / (a0 + a1), 1e-300)))
        return [p for _, p in full]


def trained(pages: list[str]) -> Model:
    model = Model()
    for page in LABELLED:
        model.learn(read(page, marks=True), SEED_WEIGHT)
    for page in pages:
        model.learn(read(page), 1.0)
    return model


def has_running_text(page: Page) -> bool:
    """Whether words stand outside links and unwanted containers."""
    unwanted: list[bool] = []
    for i, up in enumerate(page.parent):
        unwanted.append(page.tag[i] in UNWANTED_TAGS or page.meaning[i] not in ("none", "content") or up >= 0 and unwanted[up])
    return any(i >= 0 and not unwanted[i] and not page.linked[i] and not raw.isspace() for i, raw in page.flow)


def main_text(page: str | None, model: Model) -> str:
    if not page:
        return ""
    if "<" not in page:
        return " ".join(entities.unescape(page).split())
    tree = read(page)
    content = [p > 0.5 for p in model.marginals(tree)]
    if not any(i >= 0 and content[i] and not raw.isspace() for i, raw in tree.flow) and has_running_text(tree):
        content = [p > 0.5 for p in model.marginals(tree, above=True)]
    blocks, current = [], []
    for i, raw in [*tree.flow, (-1, "")]:
        if i >= 0:
            if content[i]:
                current.append(raw)
        elif current:
            block = " ".join(entities.unescape("".join(current)).split())
            if block:
                blocks.append(block)
            current = []
    return "\n".join(blocks)


def learned(pages: DataFrame, html: str = "html") -> Model:
    """Potentials counted on a bounded sample: the different pages with the smallest hashes, very long ones left aside. Hashes alone are
    ranked; only the chosen pages come to the driver."""
    short = pages.where(F.length(html) <= SAMPLE_CHARS).select(F.xxhash64(html).alias("hash"), F.col(html).alias("page"))
    chosen = [r[0] for r in short.select("hash").distinct().orderBy("hash").limit(SAMPLE_PAGES).collect()]
    if not chosen:
        return trained([])
    sample = short.where(F.col("hash") <= chosen[-1]).groupBy("hash").agg(F.min("page").alias("page"))
    return trained([r["page"] for r in sorted(sample.collect(), key=lambda r: r["hash"])])


def extract(pages: DataFrame, html: str = "html", model: Model | None = None) -> Column:
    """The main text as a column over ``pages``."""
    model = model or learned(pages, html)

    @F.pandas_udf(T.StringType())
    def text(batch: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, model) for p in batch.tolist()], dtype=object)
    return text(F.col(html))


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = pages.select("page_id", "url", extract(pages).alias("text"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
