"""Main text of web pages: flat text blocks classified by a decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<", re.S)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: One attribute after another: a name, and its value, if it has one.
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
#: Elements whose content is no text of the page.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select", "canvas", "audio", "video", "xmp", "noframes")}
#: Elements that end a line of text; all others, but for those of custom names, are part of one.
BLOCK = frozenset(("address", "article", "aside", "blockquote", "body", "button", "caption", "center", "colgroup", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"))
#: Elements that close an open paragraph, as browsers do.
CLOSES = frozenset(("address", "article", "aside", "blockquote", "center", "details", "dialog", "dd", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"))
#: Elements that an opening one of the name closes.
ENDS = {"li": ("li",), "option": ("option",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
BOILER_TAGS = frozenset(("nav", "footer", "aside", "form", "button", "menu", "dialog"))
ARTICLE_TAGS = frozenset(("article", "main"))
#: Words that hint at what is not the article: at the end of a name in a class, id or role, or at its beginning, before
#: no more than a place, a part or a number. What a layout has, and what an article is about, are other names.
WORDS = r"(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banners?|cookies?|consent|gdpr|notices?|alerts?|pop-?ups?|modal|overlay|newsletter|subscri\w*|sign-?up|share|sharing|social|related|recommend\w*|side-?bar|menu\w*|nav\w*|breadcrumbs?|masthead|footers?|site-?header|page-?header|top-?bar|comments?|disqus|repl(?:y|ies)|respond|widgets?|log-?in|search\w*|pagination|pager|toolbar|copyright|complementary|contentinfo|paywall)"
PARTS = r"(?:left|right|top|bottom|main|primary|secondary|inner|outer|fixed|sticky|bars?|box(?:es)?|wrap(?:per)?|container|content|area|block|section|panel|links?|list|items?|buttons?|btns?|icons?|form|text|title|header|col(?:umn)?|row|slot|unit|zone|body|inline|mobile|desktop|small|large|count|thread|post|author|meta|us|me|\d{1,3}|[a-z])"
BOILER = re.compile(rf"(?:(?<![^\s_-])|^){WORDS}(?:[_-]{PARTS})*(?!\S)", re.I)
ARTICLE = re.compile(r"(?:^|[\s_-])(?:article\w*|post-?(?:body|content)|entry-?content|main-?content|story(?:-?body)?|content-?body)(?:$|[\s_-])", re.I)
LAYOUT = re.compile(r"(?<!\S)(?:has|with|without|no|is|not|js)[-_]\S+", re.I)
SPACE = re.compile(r"\s+")
FEATURES = ("words", "link_density", "words_before", "link_before", "words_after", "link_after", "place", "marked_share", "free_share", "heading")


class Block(NamedTuple):
    """A run of text between two block elements."""

    text: str
    words: int
    links: float  #: share of its words inside links
    place: int  #: what elements around it hint at: 2 article, 1 article below a name of boilerplate, 0 nothing, -1 boilerplate by a name, -2 by an element
    heading: int


class _Open(NamedTuple):
    name: str
    mark: int  #: 1 in an article, -1 in boilerplate, by the nearest element that hints at either
    outer: int  #: 1 if a name around it, 2 if an element hints at boilerplate
    hidden: int
    inline: bool


def _hint(name: str, named: str, role: str, inside: _Open) -> tuple[int, int]:
    """(mark, outer) of an element inside another."""
    tag = name in BOILER_TAGS or (name == "header" and inside.mark < 1)
    if tag or (named and name not in ("body", "html") and BOILER.search(named)):
        return -1, max(inside.outer, 2 if tag else 1)
    if name in ARTICLE_TAGS or role in ("main", "article") or (named and ARTICLE.search(named)):
        return 1, inside.outer
    return inside.mark, inside.outer


def _place(inside: _Open) -> int:
    if inside.mark == 0:
        return 0
    return (2, 1, -2)[inside.outer] if inside.mark == 1 else -inside.outer


def blocks(page: str | None) -> list[Block]:
    """Flat text blocks of a page, in page order.

    Scripts, styles, form fields, comments and hidden elements make no block. Character references are decoded after
    tags are cut, white space inside a block is one space. Unclosed elements end with the element around them.
    """
    page = page or ""
    out: list[Block] = []
    stack = [_Open("", 0, 0, 0, False)]
    names: Counter[str] = Counter()  # of the open block elements
    parts: list[str] = []
    linked = anchor = heading = at = 0  # anchor: how many block elements were open where the open link began, and 1

    def flush():
        nonlocal parts, linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                words = text.count(" ") + 1
                out.append(Block(text, words, min(1.0, linked / words), _place(stack[-1]), heading))
            parts, linked = [], 0

    while at < len(page):
        m = TOKEN.match(page, at)
        t, at = m.group(), m.end()
        if t[0] != "<" or len(t) == 1:
            if not stack[-1].hidden:
                text = html.unescape(t)
                parts.append(text)
                if anchor:
                    linked += len(text.split())
            continue
        if t[1] in "!?":
            continue
        name = NAME.match(t).group(1).lower()
        inline = name not in BLOCK and "-" not in name
        if t[1] == "/":
            if name == "a":
                anchor = 0
            if inline:
                if stack[-1].inline and stack[-1].name == name:
                    stack.pop()
                continue
            flush()
            if names[name]:
                while True:
                    last = stack.pop()
                    names[last.name] -= not last.inline
                    if last.name == name and not last.inline:
                        break
                heading = 0
                if anchor > sum(not x.inline for x in stack):
                    anchor = 0  # it was never closed
            continue
        if name in RAW:
            end = RAW[name].search(page, at)
            at = end.end() if end else len(page)
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name == "a":
            anchor = sum(not x.inline for x in stack)  # links do not nest
        said: dict[str, str] = {}
        if "=" in t or "hidden" in t:
            for k, v in ATTRIBUTE.findall(t, len(name) + 1):
                said.setdefault(k.lower(), v.strip("\"'"))  # of an attribute given twice the first counts
        hidden = name == "head" or "hidden" in said or said.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(said.get("style", "")))
        if inline:
            # only what is hidden, and what lies in it, needs to be closed again
            if (hidden or stack[-1].inline) and not t.endswith("/>"):
                stack.append(stack[-1]._replace(name=name, hidden=stack[-1].hidden + hidden, inline=True))
            continue
        flush()
        while stack[-1].inline or (name in CLOSES and stack[-1].name == "p") or stack[-1].name in ENDS.get(name, ()):
            last = stack.pop()
            names[last.name] -= not last.inline
            if anchor > sum(not x.inline for x in stack):
                anchor = 0
        named = LAYOUT.sub(" ", " ".join(said.get(k, "") for k in ("class", "id", "role")))
        mark, outer = _hint(name, named, said.get("role", ""), stack[-1])
        stack.append(_Open(name, mark, outer, (0 if name == "body" else stack[-1].hidden) + hidden, False))
        names[name] += 1
        heading = int(name in HEADINGS)
    flush()
    return out


def features(found: list[Block]) -> list[list[float]]:
    """Rows of FEATURES: figures of each block and of the blocks before and after it (none: 0), hints, and page shares.

    marked_share is the share of the page's words in articles that nothing else surrounds; free_share is that of words
    which no hint calls boilerplate. They tell how far the hints of a page can be trusted.
    """
    total = sum(x.words for x in found) or 1
    marked = sum(x.words for x in found if x.place == 2) / total
    free = sum(x.words for x in found if x.place in (0, 2)) / total
    w, d = [0, *(x.words for x in found), 0], [0.0, *(x.links for x in found), 0.0]
    return [[w[i], d[i], w[i - 1], d[i - 1], w[i + 1], d[i + 1], x.place, marked, free, x.heading] for i, x in enumerate(found, 1)]


#: Labelled pages, by hand: markup as sites of several kinds write it. A number is so many words of text; + begins a
#: block of the main text, - one that is not.
LABELLED = (
    # news: everything has its element
    "<header><a>-2</a></header><nav><ul><li><a>-1</a><li><a>-2</a><li><a>-1</a></ul></nav><div class=ad>-8</div><article><h1>+8</h1><p>+40<p>+2<p>+75<ul><li>+5<li><a>+2</a></ul><p>+1<p>+18</article><footer>-12<p>-7</footer>",
    # the same, with what interrupts an article
    "<nav><a>-1</a> <a>1</a> <a>2</a></nav><article><header><h1>+6</h1><p>+4</header><p>+35<aside>-20</aside><p>+50<div class=advert>-9</div><p>+3<div class=related><a>-6</a></div><p>+22<form><label>-2</label></form></article><section id=comments><h2>-2</h2><p>-30<p>-12</section><footer>-5</footer>",
    "<nav><a>-2</a></nav><article><h1>+5</h1><p>+30<ul><li><a>+14</a><li><a>+9</a></ul><p>+20<p>+6<p><a>+18</a><p>+2</article><footer>-8</footer>",
    # nothing after the article, or nothing around it
    "<nav><a>-1</a> <a>1</a></nav><article><h1>+5</h1><p>+30<p>+3</article>", "<header>-3</header><main><p>+50<p>+6</main>",
    "<article><h1>+4</h1><p>+70<p>+5</article>", "<main><h1>+2</h1><p>+9<p>+1</main>", "<article><p>+2<p>+1</article>", "<article>+2</article>",
    "<ul><li><a>-1</a><li><a>-1</a></ul><article><p>+1<p>+3<p>+2</article>", "<div>-2</div><article><p>+44<p>+1</article>",
    "<div class=cookie-notice>-30</div><nav>-20</nav><article><p>+40<p>+25</article>", "<header>-40</header><main><p>+12<p>+9</main>",
    # an article below a layout whose names hint at something else
    "<div class='page nav-fixed'><nav><a>-1</a></nav><main><h1>+5</h1><p>+60<p>+34<p>+80<p>+12<p>+45<a>5</a></main><div class=sidebar><p>-25<a>-4</a></div></div>",
    "<div class='sidebar-right wrapper'><ul><li><a>-2</a><li><a>-1</a></ul><div><h1>+7</h1><p>+55<p>+48<p>+9<p>+70<p>+31</div><p>-4<ul><li><a>-3</a></ul></div>",
    "<div class='menu-open wrap'><nav><a>-1</a></nav><article><p>+30<p>+22</article><p>-4</div>",
    "<div class=topbar-page><div><a>-2</a></div><main><p>+12</main></div>",
    # a blog without any element or name of an article
    "<div><a>-2</a></div><ul><li><a>-1</a><li><a>-1</a><li><a>-2</a></ul><div><h2>+6</h2><p>+45<p>+62<p>+3<p>+28<p>+51<blockquote>+17</blockquote><p>+38</div><ul><li><a>-5</a><li><a>-4</a></ul><p>-6",
    "<ul><li><a>-1</a><li><a>-2</a></ul><div><p>+60<p>+40<p>+6<p>+52</div>",
    "<table><tr><td><a>-1</a><td><a>-2</a></table><table><tr><td><h1>+5</h1><p>+90<p>+66<td><a>-3</a><br><a>2</a></table><p>-9",
    "<div><h1>+4</h1></div><div>+30</div><div>+44</div><div>+2</div><div>+26</div><div><a>-2</a> <a>3</a></div><div>-3</div>",
    # teasers around, and a text without a mark
    "<aside><article><h3><a>-6</a></h3><p>-15</article><article><h3><a>-5</a></h3><p>-18</article></aside><div><h1>+9</h1><p>+72<p>+40<p>+5<p>+58</div><p>-5",
    "<div class=related><article><a>-7</a></article><article><a>-6</a><p>-4</article></div><div class=content><p>+52<p>+37<p>+64</div>",
    # notices, banners and sign-ups before and after
    "<div class=cookie-notice>-14</div><div class=banner><p>-10</div><div class=post-content><p>+33<p>+47<p>+4<p>+25</div><div class=newsletter><p>-11<form>-3</form></div><div>-2</div>",
    "<dialog><p>-16</dialog><main><article><h1>+3</h1><p>+1<p>+2<p>+4</article></main><footer>-20</footer>",
    "<article><p>+6</article><footer>-9</footer>",
    "<nav><a>-1</a></nav><div class=ad>-6</div><article><h1>+2</h1><p>+3<p>+1<p>+2</article><footer>-14</footer>",
    "<nav><a>-1</a> <a>2</a></nav><div class=ad>-9</div><article><h1>+1</h1><p>+1</article><footer>-16</footer>",
    "<div class=ad>-4</div><article><p>+1</article><footer>-30<p>-22</footer>",
    # lists of links with some words between
    "<div><h2>-3</h2><ul><li><a>-6</a> 2<li><a>-7</a> 1<li><a>-5</a> 2</ul></div><div><p>+80<p>+41<p>+66</div><div>-1 <a>4</a></div>",
    # an article that begins beside links, and is nothing else
    "<article><p>+40<ul><li><a>+2</a><li>+3</ul><p>+40</article>", "<main><p>+12<p><a>+4</a></main>", "<article><h1>+4</h1><p><a>+3</a><p>+20</article>", "<nav><a>-1</a></nav><article><p>+9<p><a>+5</a><p>+30</article>",
    # cards: links around headings and teasers
    "<div><h1>+6</h1><p>+70<p>+55<p>+48</div><div><a><h3>-5</h3><p>-26</p></a></div><div><a><h3>-4</h3><p>-18</p></a></div>",
    # text alone
    "<p>+20", "+30", "<div>+12</div><div>+40</div>", "<pre>+25</pre>",
)


def labelled_rows() -> list[list[float]]:
    """FEATURES and the label of every block of LABELLED, in three sizes of text."""

    def words(m: re.Match, scale: float) -> str:
        return re.sub(r"([+-]?)(\d+)", lambda n: n.group(1) + " ".join(["w"] * max(1, round(int(n.group(2)) * scale))), m.group())

    rows = []
    for scale in (0.4, 1, 3):
        for page in LABELLED:
            found = blocks(re.sub(r"(?:(?<=>)|^)[^<]+", lambda m, s=scale: words(m, s), page))
            rows += [[*row, float(x.text[0] == "+")] for x, row in zip(found, features(found), strict=True)]
    return rows


def train_tree(spark: SparkSession, depth: int = 6) -> tuple:
    """Fits a decision tree to LABELLED; returns it as nested (feature, threshold, left, right) or a leaf's class."""
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    table = spark.createDataFrame([tuple(map(float, r)) for r in labelled_rows()], [*FEATURES, "label"]).coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(table))

    def nested(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), nested(node.leftChild()), nested(node.rightChild()))

    return nested(model._java_obj.rootNode())


def is_main(tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def extract_text(pages: DataFrame, html_col: str = "html", tree: tuple | None = None) -> DataFrame:
    """``pages`` (all columns) with ``text``, the main text, and ``n_blocks``, the number of blocks it is made of.

    Each page is cut in flat text blocks; a decision tree over FEATURES (word counts and link densities of a block and
    its neighbours, hints around it, and how far the page's hints can be trusted) picks those of the article, which are
    joined by one space in page order. The tree grown on LABELLED asks first whether a hint of boilerplate stands around
    a block (place): such blocks go, unless hardly a word of the page is free of hints and neither the block nor what
    follows it is a link. All other blocks are decided by their link density, then by word counts and link densities of
    the blocks before and after them, and links that remain stay only inside an element or name of an article. Null and
    empty pages, and pages without such blocks, give an empty string. Rows are independent: no
    shuffle. Nothing is dropped or cut otherwise.
    """
    tree = tree or train_tree(pages.sparkSession)

    @F.pandas_udf("text string, n_blocks int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, counts = [], []
            for page in b:
                found = blocks(page)
                kept = [x.text for x, row in zip(found, features(found), strict=True) if is_main(tree, row)]
                texts.append(" ".join(kept))
                counts.append(len(kept))
            yield pd.DataFrame({"text": texts, "n_blocks": counts})

    return pages.withColumn("__main", run(F.col(html_col))).select(*[pages[c] for c in pages.columns if c not in ("text", "n_blocks")], "__main.text", "__main.n_blocks")
