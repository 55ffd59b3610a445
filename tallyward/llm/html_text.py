"""Main text of web pages by composite text density.

Every node of a page gets its characters per tag, adjusted for links (Sun, Song and Liao, "DOM Based
Content Extraction via Text Density", 2011):

    C / T * log_b(C / LC * T / LT),   b = ln(C / (C - LC) * LC + LC_body / C_body * C + e)

with C characters, T tags, LC characters in links and LT links below the node. The node whose children's
densities have the largest sum is the core of the content, and the article or main around it (else the body)
is its container. Density grows with the size of a node, so it cannot tell a short paragraph from furniture: all
of the container is kept but blocks beside the path to the core that are half or more links and thinner than
everything on the path from the body to it, and, on a page without article or main, containers of less than a tenth of
the container that holds two thirds of the page, outside of it and without a heading. Page furniture that says what it is (by tag, role, class or id) is
left out beforehand, as short articles can be thinner than their footer.

A page is one row and never leaves its task; the parser below is the small per-row helper.
"""

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre search section summary table "
    "tbody td tfoot th thead tr ul".split()
)
#: Never content, whatever they hold.
FURNITURE = frozenset(
    "aside audio button canvas embed footer head iframe input label map nav noscript "
    "option script select style svg template textarea title video".split()
)
#: Furniture unless content stands in them, as a whole page can stand in one form.
WRAPS = frozenset("dialog form menu object search".split())
#: Whole parts of class names, ids and roles that mark comments, adverts, navigation and the page's own margins.
HINTS = frozenset(
    "ad ads adsense advert adverts advertisement advertising breadcrumb breadcrumbs comment comments complementary "
    "contentinfo disqus footer masthead menu nav navbar navigation pager pagination sidebar sponsor sponsored toolbar "
    "topbar".split()
)
#: Those that name content as well (search history, social policy): furniture if two of them agree, or with links.
WEAK_HINTS = frozenset(
    "alert banner byline consent cookie cookies dialog gdpr login modal newsletter notice notices notification overlay "
    "popup promo promotion recommended related replies reply respond search share sharing signup skip social subscribe "
    "subscription widget".split()
)
#: What may stand beside them in a name without making it one of content (ad-hoc-queries, menu-of-the-day); so may numbers
#: and parts of one or two letters.
BESIDE_HINTS = frozenset(
    "aria area bar block body bottom box button center col column container content desktop extra global group header "
    "holder inner item items layout left line link links list main mobile module outer page panel post primary right root "
    "row secondary section site slot sticky text thread title top unit wrap wrapper".split()
)
#: Never furniture by name: a word in a line of code can be called comment.
INLINE = frozenset(
    "a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split()
)
CONTAINERS = frozenset(("div", "section", "center", "td"))
HIDDEN, MARKED, DOUBTFUL = 3, 2, 1
HOLDS_CONTENT = frozenset(("html", "body", "article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Open elements that a start tag closes, and where the search for them ends.
CLOSES = {
    **{tag: (frozenset(("li",)), frozenset(("ul", "ol", "menu"))) for tag in ("li",)},
    **{tag: (frozenset(("dt", "dd")), frozenset(("dl",))) for tag in ("dt", "dd")},
    **{tag: (frozenset(("td", "th")), frozenset(("table",))) for tag in ("td", "th")},
    "tr": (frozenset(("tr",)), frozenset(("table",))),
    "option": (frozenset(("option",)), frozenset(("select",))),
}
CLOSES_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary"}

_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page(HTMLParser):
    """Nodes in document order (parents before children) and texts with their node and block."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.marked = ["#root"], [0], [0]
        self.texts: list[tuple[int, int, str]] = []
        self.block = 0
        self.open = [0]
        self.feed(html)
        self.close()

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are of no use here

    def _pop_to(self, closing: frozenset | set, barrier: frozenset) -> None:
        for depth in range(len(self.open) - 1, 0, -1):
            tag = self.tags[self.open[depth]]
            if tag in closing:
                del self.open[depth:]
                return
            if tag in barrier:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in CLOSES_P:
            self._pop_to({"p"}, BLOCK - {"p"})
        if tag in CLOSES:
            self._pop_to(*CLOSES[tag])
        if tag in BLOCK:
            self.block += 1
        elif tag == "br":
            self.texts.append((self.open[-1], self.block, " "))
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        self.marked.append(_furniture(dict(attrs)) if attrs else 0)
        if tag not in VOID:
            self.open.append(len(self.tags) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCK:
            self.block += 1
            self._pop_to({tag}, frozenset(("td", "th")) - {tag} if tag not in ("table", "tr", "tbody", "article", "body", "html", "main") else frozenset())
        elif tag not in VOID:
            self._pop_to({tag}, BLOCK)  # an inline end tag closes nothing outside its block

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], self.block, data))


def _furniture(attrs: dict) -> int:
    """HIDDEN, MARKED as furniture, DOUBTFUL, or 0."""
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or _HIDDEN.search(attrs.get("style") or ""):
        return HIDDEN
    found = set()
    for name in (name for a in ("class", "id", "role") for name in (attrs.get(a) or "").split()):
        parts = {part.lower() for part in _NAME_PART.findall(name)}
        hints = parts & (HINTS | WEAK_HINTS)
        if all(len(part) <= 2 or part.isdigit() or part in BESIDE_HINTS for part in parts - hints):
            found |= hints
    return MARKED if found & HINTS else min(len(found), MARKED)


def _left_out(page: Page) -> list[bool]:
    """Per node: it or one of its ancestors is page furniture.

    What is hidden never counts. Other marked nodes and WRAPS stay where they hold an article, a main or an h1,
    or most characters of the article around them (on a page without articles: of the page).
    """
    n = len(page.tags)
    holds, article, never, in_link = [False] * n, [0] * n, [False] * n, [False] * n
    for i in range(n - 1, 0, -1):
        holds[page.parents[i]] |= holds[i] or page.tags[i] in HOLDS_CONTENT or page.tags[i] == "h1"
    for i in range(1, n):
        up, tag = page.parents[i], page.tags[i]
        never[i] = never[up] or tag in FURNITURE or (page.marked[i] == HIDDEN and tag not in HOLDS_CONTENT and not holds[i] and tag not in HEADINGS)
        in_link[i] = in_link[up] or tag == "a"
        article[i] = i if tag in ("article", "main") else article[up]
    chars, link_chars = [0] * n, [0] * n
    for node, _, text in page.texts:
        if not never[node]:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        chars[page.parents[i]] += chars[i]
        link_chars[page.parents[i]] += link_chars[i]
    no_articles = not any(article)
    out = [False] * n
    for i in range(1, n):
        up, tag = page.parents[i], page.tags[i]
        most = (article[i] or no_articles) and 2 * chars[i] > chars[article[i]] and 2 * link_chars[i] < chars[i]
        stays = tag in HOLDS_CONTENT or holds[i] or tag in HEADINGS or most
        named = 0 if tag in INLINE else page.marked[i]
        marked = named >= MARKED or tag in WRAPS or (named == DOUBTFUL and 2 * link_chars[i] >= chars[i])
        out[i] = out[up] or never[i] or (marked and not stays)
        # A header is the page's, or holds the title of an article: then only headings are text.
        out[i] |= tag == "header" and not article[i]
        if not out[i] and page.tags[up] == "header" and tag not in HEADINGS and not holds[i]:
            out[i] = True
    return out


def main_text(html: str | None) -> str:
    """Text of the main article: blocks in page order, one per line, white space inside made single."""
    if not html:
        return ""
    page = Page(html)
    out, n = _left_out(page), len(page.tags)
    chars, tags, link_chars, links, in_link = [0] * n, [0] * n, [0] * n, [0] * n, [False] * n
    for i in range(1, n):
        in_link[i] = in_link[page.parents[i]] or page.tags[i] == "a"
    for node, _, text in page.texts:
        if not out[node]:
            size = len("".join(text.split()))
            chars[node] += size
            link_chars[node] += size * in_link[node]
    for i in range(n - 1, 0, -1):
        if not out[i]:
            up = page.parents[i]
            chars[up] += chars[i]
            link_chars[up] += link_chars[i]
            tags[up] += tags[i] + 1
            links[up] += links[i] + (page.tags[i] == "a")
    body = next((i for i, tag in enumerate(page.tags) if tag == "body"), 0)
    if not chars[body]:
        body = 0
    link_share = link_chars[body] / max(1, chars[body])

    def density(i: int) -> float:
        if not chars[i]:
            return 0.0
        c, t, lc, lt = chars[i], max(1, tags[i]), link_chars[i], max(1, links[i])
        base = math.log(c / max(1, c - lc) * lc + link_share * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / lt)) / max(0.5, math.log(max(base, 1.0 + 1e-9)))

    densities = [0.0 if out[i] else density(i) for i in range(n)]
    # Formatting inside a block is part of the block, not a child that could make it the core.
    sums = [0.0] * n
    for i in range(1, n):
        if page.tags[i] in BLOCK:
            sums[page.parents[i]] += densities[i]
    inside = [False] * n
    inside[body] = True
    for i in range(body + 1, n):
        inside[i] = inside[page.parents[i]]
    core = max((i for i in range(n) if inside[i] and not out[i]), key=lambda i: (sums[i], chars[i], -i), default=body)
    path = [core]
    while path[-1] not in (body, 0):
        path.append(page.parents[path[-1]])
    threshold = min(densities[i] for i in path)
    article = next((i for i in path if page.tags[i] in ("article", "main")), None)
    container = path[-1] if article is None else article
    # On a page without articles: the part that holds most of it. Beside that, a line or two are the page's own.
    # Paragraphs and lists are text wherever they stand, so only containers beside a container are looked at.
    most = next((i for i in path if page.tags[i] in CONTAINERS and 3 * chars[i] >= 2 * chars[path[-1]]), path[-1])
    around = set(path[path.index(most) + 1 :]) if article is None else set()
    titled = [tag in HEADINGS for tag in page.tags]
    for i in range(n - 1, 0, -1):
        titled[page.parents[i]] |= titled[i]
    on_path, keep = set(path), [False] * n
    keep[container] = True
    for i in range(container + 1, n):
        up = page.parents[i]
        beside = up in on_path and up != core and i not in on_path and page.tags[i] not in HEADINGS
        if page.tags[container] in ("article", "main"):
            beside &= page.tags[i] in BLOCK  # a link between words of the article is one of them
        thin = 2 * link_chars[i] >= chars[i] and densities[i] < threshold
        margin = up in around and i not in on_path and page.tags[i] in CONTAINERS and not titled[i] and 10 * chars[i] < chars[most]
        keep[i] = keep[up] and not out[i] and not (beside and thin) and not margin
    blocks: dict[int, list[str]] = {}
    for node, block, text in page.texts:
        if keep[node] and not out[node]:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for _, parts in sorted(blocks.items()))
    return "\n".join(line for line in lines if line)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column("html")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_text(pages: DataFrame) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points of text).

    pages needs page_id, url and html; other columns are ignored. NULL and empty html, and pages without
    text outside of page furniture, give an empty text. NULL ids and urls are returned as they are,
    repeated rows repeat. Broken markup is read as browsers read it in the cases that occur: paragraphs, list
    items and cells without end tag, stray end tags, a page cut off anywhere. An empty table gives an empty
    result.
    """
    return pages.select("page_id", "url", "html").mapInArrow(_extract, "page_id BIGINT, url STRING, text STRING, n_chars BIGINT")
