"""Main text of web pages by composite text density.

One pass over the markup builds the element tree (raw-text elements, comments, void elements, implied end tags and
missing ones included). Elements that can't be article text by their tag, role or name (menus, forms, adverts,
reader comments, ...) fall away, but not those that hold the article: a form or an element of such a role or name stays
where it holds a ``main`` element, over half of the body's text outside links, or ``article`` elements with more such text
than all that would be left; blocks that can outgrow an article (comments, cookie notices, ``aside``, ...) stay where they hold
a ``main`` element, or over half of the text and an ``h1``. Inside them the same holds for each block. For every other node, C characters and T tags are counted over its subtree, LC and LT of
them in links, and its link-adjusted density is

    C / T * log(C / LC * T / LT) / log(ln(C / nLC * LC + LCb / Cb * C + e))

with nLC the characters outside links and b the body. A block's density sum adds up the densities of the blocks inside it; its
own text, with the inline elements of it, counts as one more. The block of largest sum, the outermost of equal ones, is the core
of the article. The threshold is the least density on the path from the core to the body: every level of this path
adds the blocks beside it that are at least as dense, so sections beside the core stay in.

Blocks are cut at block elements (``br`` is white space), character references decoded, white space squeezed, and
blocks joined by an empty line. Null and empty pages, and pages without text, give an empty text. Pages of
any size are read whole, in time and memory linear in their size; markup nested to any depth, and end tags that close nothing,
are fine. Rows map one to one; extra columns don't matter.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Element names of HTML, and names that pages give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul".split()
)
DROPPED = frozenset("nav footer aside form button select input label fieldset dialog menu search template noscript object embed svg math canvas audio video head".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsbygoogle banner sponsor sponsored promo promotion sidebar sidebars menu menus nav navbar navigation "
    "breadcrumb breadcrumbs footer comment comments disqus reply replies respond cookie cookies consent gdpr notice notices notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended toolbar masthead pagination pager skip".split()
)
HEADERS = frozenset("header topbar".split())
#: Of the tags and names, those of blocks whose text is their own, however much it is.
OWN_TAGS = frozenset("nav footer aside dialog menu search".split())
OWN_NAMES = frozenset("comment comments disqus reply replies respond related recommended cookie cookies consent gdpr notice notices newsletter".split())
#: How an element stands: it stays, falls unless it holds the article, the same for blocks of their own text, falls.
STAYS, LAYOUT, OWN, FALLS = range(4)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu menubar".split())
ARTICLES = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Open elements that a start tag closes, and those beyond which it doesn't look.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
P_KEEPERS = frozenset("div td th li section article aside blockquote body main header footer table button caption object form dd dt figure figcaption nav".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
#: One attribute: its whole name, and its value if it has one.
ATTRIBUTE = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Tree:
    """Elements in page order as parallel lists; ``parts`` holds their texts and children in order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.attributes, self.parts = ["#page"], [-1], [""], [[]]

    def open(self, tag: str, attributes: str, parent: int) -> int:
        node = len(self.tag)
        self.tag.append(tag)
        self.parent.append(parent)
        self.attributes.append(attributes)
        self.parts.append([])
        self.parts[parent].append(node)
        return node


class Open:
    """The open elements, and for each name where the last ones of it stand, so that no tag walks over the others."""

    def __init__(self, tree: Tree) -> None:
        self.tree, self.stack = tree, [0]
        self.places: dict[str, list[int]] = {}
        self.keepers = [0]

    def push(self, node: int) -> None:
        name, at = self.tree.tag[node], len(self.stack)
        self.stack.append(node)
        self.places.setdefault(name, []).append(at)
        if name in P_KEEPERS:
            self.keepers.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place, and those inside it."""
        while len(self.stack) > at:
            name = self.tree.tag[self.stack.pop()]
            self.places[name].pop()
            if name in P_KEEPERS:
                self.keepers.pop()

    def last(self, names) -> int:
        """Place of the innermost element of these names, 0 if there is none."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)


def parse(page: str) -> Tree:
    tree, at, size = Tree(), 0, len(page)
    parts, opened = tree.parts, Open(tree)
    stack = opened.stack
    lower: str | None = None
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            parts[stack[-1]].append(page[at:])
            break
        if m.start() > at:
            parts[stack[-1]].append(page[at : m.start()])
        at = m.end()
        name = m[2]
        if not name:
            continue
        name = name.lower()
        if m[1]:  # an end tag closes the nearest open element of its name, and those inside it
            place = opened.last((name,))
            if place and (name in BLOCKS or place >= opened.keepers[-1]):
                opened.cut(place)
            continue
        inner, outer = CLOSES.get(name, (set(), None))
        if name in BLOCKS:
            inner = inner | {"p"}
        if name in HEADINGS:
            inner = inner | HEADINGS
        if inner:
            least = opened.last(outer) if outer else opened.keepers[-1]
            while (place := opened.last(inner)) > least:
                opened.cut(place)
        node = tree.open(name, m[3] or "", stack[-1])
        if name in VOID or (m[3] or "").endswith("/") and name not in BLOCKS and name not in RAW and name != "a":
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            if len(lower) != size:  # lower-casing changed lengths: search without it
                end = re.compile(rf"</{re.escape(name)}", re.I).search(page, at)
                close = end.start() if end else -1
            else:
                close = lower.find("</" + name, at)
            at = size if close < 0 else close
        opened.push(node)
    return tree


def _standing(tree: Tree, node: int, in_article: bool) -> int:
    tag, attributes = tree.tag[node], tree.attributes[node]
    if tag in RAW or tag in DROPPED and tag not in OWN_TAGS and tag not in ("form", "fieldset"):
        return FALLS
    by_tag = STAYS if tag not in DROPPED else OWN if tag in OWN_TAGS else LAYOUT
    names: set[str] = set()
    found: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(attributes) if attributes else ():
        found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")  # of repeats the first counts
    for kind, value in found.items():
        if kind == "hidden" or kind == "style" and HIDDEN.search(value) or kind == "aria-hidden" and value.lower() == "true":
            return FALLS
        if kind == "role" and value.lower() in ROLES:
            by_tag = max(by_tag, LAYOUT)
        if kind in ("class", "id"):
            for name in value.lower().split():
                words = re.split(r"[-_]+", name)
                if words[0] not in ("no", "has", "with", "without", "is"):
                    names.update(words)
    by_name = OWN if names & OWN_NAMES else LAYOUT
    if tag in ("html", "body"):
        return by_tag
    if tag in ARTICLES:
        return max(by_tag, by_name) if names & {"comment", "comments", "reply", "ad", "ads", "advert", "advertisement", "sponsored", "related"} else by_tag
    if tag == "header" or names & HEADERS:
        return by_tag if in_article else max(by_tag, by_name)
    return max(by_tag, by_name) if names & NAMES else by_tag


def _fallen(tree: Tree, inside: list[bool], linked: list[bool]) -> list[bool]:
    """Whether each node is gone, by itself or with one above it."""
    tag, parent, n = tree.tag, tree.parent, len(tree.tag)
    standing, hidden, plain = [STAYS] * n, [False] * n, [False] * n
    text, articles, main, h1, left = [0] * n, [0] * n, [False] * n, [False] * n, 0
    for i in range(1, n):
        hidden[i], plain[i] = hidden[parent[i]], plain[parent[i]]
        if not hidden[i]:
            standing[i] = _standing(tree, i, inside[i])
            hidden[i], plain[i] = standing[i] == FALLS, plain[i] or standing[i] != STAYS
    if plain == hidden:
        return hidden
    for i in range(n - 1, -1, -1):  # text outside links that can be seen, what of it is in articles, and what each node holds
        if hidden[i]:
            continue
        own = 0 if linked[i] else sum(len(x.strip()) for x in tree.parts[i] if isinstance(x, str))
        text[i] += own
        left += 0 if plain[i] else own
        if tag[i] in ARTICLES and standing[i] == STAYS:
            articles[i] = text[i]
            main[i] |= tag[i] == "main" and text[i] > 0
        h1[i] |= tag[i] == "h1"
        if i:
            p = parent[i]
            text[p] += text[i]
            articles[p] += articles[i]
            main[p] |= main[i]
            h1[p] |= h1[i]
    gone = [False] * n
    for i in range(1, n):
        most = 2 * text[i] > text[0]
        holds = main[i] or (most or articles[i] > left if standing[i] == LAYOUT else most and h1[i])
        gone[i] = gone[parent[i]] or standing[i] == FALLS or standing[i] != STAYS and not holds
    return gone


def main_text(page: str | None) -> str:
    """The blocks of the page's main text, joined by empty lines."""
    if not page:
        return ""
    tree = parse(page)
    n = len(tree.tag)
    tag, parent, parts = tree.tag, tree.parent, tree.parts
    inside, linked, headed = [False] * n, [False] * n, [False] * n
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    own = [0] * n
    for i in range(n):  # parents come before their children
        p = parent[i]
        if p >= 0:
            inside[i], linked[i] = inside[p], linked[p]
        inside[i] |= tag[i] in ARTICLES
        linked[i] |= tag[i] == "a"
    gone = _fallen(tree, inside, linked)
    for i in range(n):
        if parent[i] >= 0:
            headed[i] = headed[parent[i]]
        if tag[i] == "header":
            headed[i] = True
        elif headed[i] and tag[i] in HEADINGS:
            headed[i] = False
        if not gone[i] and not headed[i]:
            own[i] = sum(len(x.strip()) for x in parts[i] if isinstance(x, str))
            chars[i] = own[i]
            if linked[i]:
                link_chars[i] = own[i]
    for i in range(n - 1, 0, -1):
        if not gone[i]:
            p = parent[i]
            chars[p] += chars[i]
            link_chars[p] += link_chars[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (tag[i] == "a")
    for i in range(1, n):  # lists of nothing but links are menus
        if not gone[i]:
            gone[i] = gone[parent[i]] or tag[i] in ("ul", "ol") and link_tags[i] > 1 and link_chars[i] >= 0.9 * max(1, chars[i])
    body = next((i for i in range(n) if tag[i] == "body"), 0)
    share = link_chars[body] / max(1, chars[body])

    def density(c: int, t: int, lc: int, lt: int) -> float:
        if not c:
            return 0.0
        t, base = max(1, t), math.log(c / max(1, c - lc) * lc + share * c + math.e)
        return c / t * math.log(max(1.0, c / max(1, lc) * t / max(1, lt)) + 1e-9) / math.log(base + 1e-9) if base > 1 + 1e-12 else c / t * math.log(max(1.0, c * t))

    dense = [0.0 if gone[i] else density(chars[i], tags[i], link_chars[i], link_tags[i]) for i in range(n)]
    # inline elements belong to their block: its own text, and one child of it as far as sums go
    block, inner = list(range(n)), [False] * n
    text, marks, link_text, links = own[:], [0] * n, [own[i] if linked[i] else 0 for i in range(n)], [0] * n
    for i in range(1, n):
        b = block[parent[i]]
        if tag[i] in BLOCKS:
            inner[b] |= not gone[i] and chars[i] > 0
        elif not gone[i]:
            block[i] = b
            text[b] += own[i]
            link_text[b] += link_text[i]
            marks[b] += 1
            links[b] += tag[i] == "a"
    total = [density(text[i], marks[i], link_text[i], links[i]) if inner[i] else dense[i] for i in range(n)]
    for i in range(1, n):
        if not gone[i] and block[i] == i:
            total[block[parent[i]]] += dense[i]
    # what stands outside the body, as after a missing start tag, counts where there is no body
    under = [False] * n
    for i in range(n):
        under[i] = i == body or i > 0 and under[parent[i]]
    candidates = [i for i in range(n) if under[i] and not gone[i] and chars[i] and (block[i] == i or i == body)]
    if not candidates:
        return ""
    core = max(candidates, key=lambda i: (total[i], -i))
    path = [core]
    while path[-1] != body:
        path.append(parent[path[-1]])
    least, roots = min(dense[i] for i in path), {core}
    for above, below in zip(path[1:], path):
        roots.update(i for i in parts[above] if not isinstance(i, str) and i != below and not gone[i] and dense[i] >= least and tag[i] in BLOCKS)
    return _blocks(tree, roots, gone, headed, body)


def _blocks(tree: Tree, roots: set[int], gone: list[bool], headed: list[bool], body: int) -> str:
    """Texts under the roots in page order, cut at block elements."""
    out: list[str] = []
    line: list[str] = []

    def cut() -> None:
        text = " ".join(html.unescape("".join(line)).split())
        line.clear()
        if text:
            out.append(text)

    tag, parts = tree.tag, tree.parts
    work: list[tuple[int, int, bool]] = [(body, 0, body in roots)]
    while work:
        node, at, taken = work.pop()
        if at == 0 and tag[node] in BLOCKS:
            cut()
        while at < len(parts[node]):
            part = parts[node][at]
            at += 1
            if isinstance(part, str):
                if taken and not headed[node]:
                    line.append(part)
            elif tag[part] == "br" or tag[part] in ("td", "th"):
                line.append(" ")
                if tag[part] == "br":
                    continue
            if not isinstance(part, str) and not gone[part]:
                work.append((node, at, taken))
                work.append((part, 0, taken or part in roots))
                break
        else:
            if tag[node] in BLOCKS:
                cut()
    cut()
    return "\n\n".join(out)


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row."""
    kinds = dict(pages.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", column).mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
