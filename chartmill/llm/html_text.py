"""Main text of web pages by a tree-structured graphical model.

Each block element of a page is a node with a hidden label, content or not.  A node's own potentials come from its
tag, the hints in its class, id and role, the amount of its text and the share of text in links; parent and child
are tied by a potential on their labels.  Sum-product messages run from the leaves to the root and back, level by
level over all pages of a chunk at once, which gives exact marginals.  Text whose node is more likely content than
not is the main text.

All potentials are log relative frequencies in labelled pages: pages of the table that mark their article
themselves, at most TRAIN of them, chosen by hash, and the pages of LABELLED, which show kinds of page and of
boilerplate that the table may lack.  A page of the table is also learned in layouts that have no such mark, with the
same labels: its article and menu become other elements or none (LAYOUTS), so that what carries over is the amount of
text, the links and the hints, not the mark.  Every layout weighs the same.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columnar import emit, long, string, with_columns

TRAIN = 1000
#: Nodes that the pages of LABELLED, and those of the table in all layouts, count as.
WEIGHT = 2000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe noembed noframes xmp textarea title".split())
#: Elements whose text is never read.
HIDDEN = frozenset("script style template noscript head title iframe noembed noframes object svg math canvas audio video select button textarea option datalist dialog xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr".split())
#: Block elements whose start closes an open paragraph.
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: Elements that a sibling's start closes, and the element that stops the search for them.
SIBLING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MARK = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|</([a-zA-Z][^\s/>]*+)[^>]*+>|<([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
HINT = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
WORD = re.compile(r"[a-z]+")
AGAINST = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright discussion disqus foot footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices outbrain pager pagination popup privacy promo promoted promotion recommended related replies reply respond search share sharing sidebar signup sitemap social sponsor sponsored subscribe taboola tags toc toolbar topbar widget complementary contentinfo".split())
#: Beginnings of further such words.
STEMS = ("advert", "breadcrumb", "comment", "cookie", "discuss", "newsletter", "paginat", "recommend", "repl", "respons", "share", "sharing", "sidebar", "social", "sponsor", "subscri", "navig", "menu", "footer", "promo")
FOR = frozenset("article articlebody body content entry main post story text".split())
GROUPS = ["article", "main", "section", "div", "p", "h1 h2 h3 h4 h5 h6", "ul ol menu dl", "li dt dd", "nav", "header", "footer", "aside", "form fieldset", "table tbody thead tr td th", "blockquote pre figure figcaption", "html body #root"]
GROUP = {t: i for i, g in enumerate(GROUPS) for t in g.split()}
#: Values of a node's features: tag group and amount of own text, hints, amount of all text and share of links, apart for
#: nodes with and without text of their own.
SIZES = [4 * (len(GROUPS) + 1), 4, 2 * 16 + 1]
#: Tag groups that are boilerplate by their meaning.
ASIDE = [GROUP[t] for t in ("nav", "header", "footer", "aside", "form")]
CELLS = sum(2 * s for s in SIZES) + 9 * 4 + 2


class Page:
    """Block nodes of a page, parents before children, and its pieces of text in page order."""

    __slots__ = ("tags", "hints", "parents", "pieces", "links")

    def __init__(self, source: str) -> None:
        self.tags, self.hints, self.parents = ["#root"], [0], [-1]
        self.pieces: list[list] = []  # [node, raw text runs]
        self.links: list[int] = []  # characters in links of each piece
        stack: list[tuple[str, int]] = [("#root", 0)]  # every open element, with its block node
        hidden = linked = 0  # open elements of these kinds
        fresh = True
        at, size = 0, len(source)

        def text(run: str) -> None:
            nonlocal fresh
            if hidden or not run:
                return
            node = stack[-1][1]
            if fresh or self.pieces[-1][0] != node:
                self.pieces.append([node])
                self.links.append(0)
                fresh = False
            self.pieces[-1].append(run)
            if linked:
                self.links[-1] += len(run)

        def close(depth: int) -> None:
            nonlocal hidden, linked, fresh
            while len(stack) > depth:
                tag, _ = stack.pop()
                hidden -= tag in HIDDEN
                linked -= tag == "a"
                fresh = fresh or tag not in INLINE

        while at < size:
            m = MARK.search(source, at)
            if not m:
                text(html.unescape(source[at:]))
                break
            if m.start() > at:
                text(html.unescape(source[at : m.start()]))
            at = m.end()
            end, tag, attributes = m[1], m[2] or m[4], m[3] or m[5] or ""
            if end:
                end = end.lower()
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == end:
                        close(depth)
                        break
                    if stack[depth][0] in ("td", "th", "table", "body") and end in INLINE:
                        break
                if end not in INLINE:
                    fresh = True
            elif tag:
                tag = tag.lower()
                if tag == "br":
                    text(" ")
                if tag not in INLINE:
                    fresh = True
                if tag in VOID:
                    continue
                if tag in CLOSES_P:
                    self._close_last(stack, {"p"}, {"td", "th", "li", "div", "article", "section", "main", "body", "table", "blockquote", "aside", "nav", "header", "footer", "form", "button"}, close)
                if tag in SIBLING:
                    self._close_last(stack, *SIBLING[tag], close)
                if tag == "a" and linked:
                    self._close_last(stack, {"a"}, {"td", "th", "table"}, close)
                node = stack[-1][1]
                if tag not in INLINE and not hidden and tag not in HIDDEN:
                    self.tags.append(tag)
                    self.hints.append(hint(attributes))
                    self.parents.append(node)
                    node = len(self.tags) - 1
                stack.append((tag, node))
                hidden += tag in HIDDEN
                linked += tag == "a"
                if tag in RAW:
                    over = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(source, at)
                    at = over.start() if over else size
                elif attributes.endswith("/") and tag not in CLOSES_P and tag not in SIBLING and tag in {"svg", "path", "use"}:
                    close(len(stack) - 1)

    @staticmethod
    def _close_last(stack: list, tags: set[str], until: set[str], close: Callable) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] in tags:
                close(depth)
                return
            if stack[depth][0] in until:
                return


def hint(attributes: str) -> int:
    """0 without hints, 1 against content, 2 for it, 3 both."""
    if not attributes or "=" not in attributes:
        return 0
    words = {w for m in HINT.finditer(attributes) for w in WORD.findall((m[2] or m[3] or m[4] or "").lower())}
    return bool(words & AGAINST or any(w.startswith(STEMS) for w in words)) + 2 * bool(words & FOR)


def observed(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parent of each node of all pages (-1 for roots), its features, and its depth."""
    first = np.cumsum([0] + [len(p.tags) for p in pages])
    n = int(first[-1])
    parent = np.array([x + f if x >= 0 else -1 for p, f in zip(pages, first.tolist(), strict=False) for x in p.parents], np.int64)
    own, linked = np.zeros(n), np.zeros(n)
    for p, f in zip(pages, first.tolist(), strict=False):
        for piece, link in zip(p.pieces, p.links, strict=True):
            own[f + piece[0]] += sum(map(len, piece[1:]))
            linked[f + piece[0]] += link
    depth = np.zeros(n, np.int64)
    for i, x in enumerate(parent.tolist()):  # a parent stands before its children
        if x >= 0:
            depth[i] = depth[x] + 1
    below, below_linked = own.copy(), linked.copy()
    for level in levels(depth)[:0:-1]:
        np.add.at(below, parent[level], below[level])
        np.add.at(below_linked, parent[level], below_linked[level])
    density = below_linked / np.maximum(1, below)
    features = np.stack(
        [
            4 * np.array([GROUP.get(t, len(GROUPS)) for p in pages for t in p.tags], np.int64) + np.digitize(own, [1, 20, 80]),
            np.array([h for p in pages for h in p.hints], np.int64),
            np.where(below == 0, 32, 16 * (own == 0) + 4 * np.minimum(3, np.digitize(below, [20, 80, 300])) + np.digitize(density, [0.05, 0.3, 0.7])),
        ],
        axis=1,
    )
    return parent, features, depth


def levels(depth: np.ndarray) -> list[np.ndarray]:
    """Nodes by depth."""
    if not len(depth):
        return []
    order = np.argsort(depth, kind="stable")
    return np.split(order, np.cumsum(np.bincount(depth))[:-1])


def kinds(features: np.ndarray) -> np.ndarray:
    """0 for a node that looks like boilerplate by tag or hints, 2 for one that looks like content, else 1."""
    group, hints = features[:, 0] // 4, features[:, 1]
    return np.where((hints == 1) | np.isin(group, ASIDE), 0, np.where((hints == 2) | (group < 2), 2, 1))


class Model:
    """Log potentials: of a node's features given its label, and of a child's label given its parent's label and the kinds of both."""

    def __init__(self, own: list[np.ndarray], tie: np.ndarray, root: np.ndarray) -> None:
        self.own = [np.log((c + 0.5) / (c + 0.5).sum(axis=0)) for c in own]
        self.tie = np.log((tie + 0.5) / (tie + 0.5).sum(axis=2, keepdims=True))
        self.root = np.log((root + 0.5) / (root + 0.5).sum())

    def marginals(self, parent: np.ndarray, features: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Probability that each node is content."""
        up = sum(table[features[:, k]] for k, table in enumerate(self.own))
        up = np.array(up, float)
        order = levels(depth)
        kind = kinds(features)
        tie = self.tie[3 * kind[parent] + kind]  # of each node with its parent; unused for roots
        message = np.zeros_like(up)  # from a node to its parent
        for level in order[:0:-1]:
            message[level] = np.logaddexp.reduce(tie[level] + up[level][:, None, :], axis=2)
            np.add.at(up, parent[level], message[level])
        belief = up.copy()
        if order:
            belief[order[0]] += self.root
        for level in order[1:]:
            without = belief[parent[level]] - message[level]
            belief[level] += np.logaddexp.reduce(tie[level] + without[:, :, None], axis=1)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700)))


def marked(page: Page) -> np.ndarray | None:
    """Labels of a page that marks its article itself; None if it doesn't."""
    out = np.zeros(len(page.tags), bool)
    stop = {"nav", "aside", "footer", "header", "form"}
    seen = False
    for i, (tag, parent) in enumerate(zip(page.tags, page.parents, strict=True)):
        if tag == "article":
            out[i] = seen = True
        elif parent >= 0:
            out[i] = out[parent] and tag not in stop and page.hints[i] != 1
    return out if seen else None


#: What becomes of an article and its paragraphs, and of a menu; None takes the article's element away, "text" leaves all
#: its text in it, without elements of their own, as does a menu that is a div or a cell; a bare page is its article's text.
LAYOUTS = [(a, p, m) for a, p in (("article", "p"), ("div", "p"), ("section", "p"), ("main", "div"), ("div", "div"), (None, "p"), (None, "div"), (None, "section"), ("div", "text"), ("ul", "li"), ("td", "p")) for m in ("nav", "div", "ul", "td")] + [("bare", "", "")]


def laid_out(page: Page, labels: np.ndarray, article: str | None, paragraph: str, menu: str) -> tuple[Page, np.ndarray]:
    """A labelled page in another layout; what isn't an article, its paragraphs or a menu stays.

    Where the menu isn't one by its tag, some of the article's text, by turns none, a tenth and a fifth, is in links.
    """
    out, new, y, inside = object.__new__(Page), [], [], []
    if article == "bare":
        out.tags, out.hints, out.parents, own = ["#root"], [0], [-1], [i for i, (node, *_) in enumerate(page.pieces) if labels[node]]
        out.pieces, out.links = [[0, *page.pieces[i][1:]] for i in own], [page.links[i] for i in own]
        return out, np.ones(1, bool)
    out.tags, out.hints, out.parents = [], [], []
    for i, (tag, hints, parent) in enumerate(zip(page.tags, page.hints, page.parents, strict=True)):
        above = new[parent] if parent >= 0 else -1
        inside.append(parent >= 0 and (inside[parent] or page.tags[parent] == "nav"))
        gone = tag == "article" and article is None or paragraph == "text" and labels[i] and parent >= 0 and labels[parent] or menu in ("div", "td") and inside[i]
        new.append(above if gone and above >= 0 else len(out.tags))
        if gone and above >= 0:
            continue
        if tag == "article" or tag == "nav":
            tag, hints = (article if tag == "article" else menu), 0
        elif tag == "p" and labels[i]:
            tag = paragraph
        out.tags.append(tag)
        out.hints.append(hints)
        out.parents.append(above)
        y.append(labels[i])
    out.pieces = [[new[node], *runs] for node, *runs in page.pieces]
    told = [sum(map(len, runs)) * (i % 3) // 10 if menu != "nav" and labels[node] else 0 for i, (node, *runs) in enumerate(page.pieces)]
    out.links = [max(x, y) for x, y in zip(page.links, told, strict=True)]
    return out, np.array(y)


def labelled(page: Page) -> np.ndarray:
    """Labels of a page of LABELLED: its pieces with a + are content, and so is an element with such pieces alone."""
    good, bad = np.zeros(len(page.tags), bool), np.zeros(len(page.tags), bool)
    for node, *runs in page.pieces:
        body = "".join(runs).strip()
        (good if body.startswith("+") else bad)[node] |= bool(body)
    for i in range(len(page.tags) - 1, 0, -1):
        good[page.parents[i]] |= good[i]
        bad[page.parents[i]] |= bad[i]
    return good & ~bad


def count(pages: Sequence[Page], labels: Sequence[np.ndarray]) -> np.ndarray:
    """All counts of labelled pages in one row."""
    parent, features, _ = observed(pages)
    y = np.concatenate([np.zeros(0, bool), *labels]).astype(np.int64)
    own = [np.bincount(features[:, k] * 2 + y, minlength=2 * size) for k, size in enumerate(SIZES)]
    child = parent >= 0
    above, kind = parent[child], kinds(features)
    tie = np.bincount(12 * kind[above] + 4 * kind[child] + 2 * y[above] + y[child], minlength=36)
    return np.concatenate([*own, tie, np.bincount(y[~child], minlength=2)])


def model_of(counts: np.ndarray) -> Model:
    *own, tie, root = np.split(counts, np.cumsum([2 * s for s in SIZES] + [36]))
    return Model([c.reshape(-1, 2) for c in own], tie.reshape(9, 2, 2), root)


FILL = "+ one sentence of an article that is long enough to look like running text, with a second clause"
SHORT = "menu entry"
ADVERT = "buy this now, it is cheap, and so are all the other things that we have in store for you today"
TALK = f"<div class=comment><p>{ADVERT}</p></div>"
LABELLED = [
    f"<body><header><a href=/>{SHORT}</a></header><main><h1>+ title</h1><p>{FILL}</p><p>{FILL}</p><ul><li>+ point<li>+ point</ul><ol><li>+ point<li>+ point</ol></main><aside><h3>{SHORT}</h3><p>{ADVERT}</p></aside><footer><p>{ADVERT}</p></footer></body>",
    f"<body><div id=header><ul><li><a href=/>{SHORT}</a></ul></div><div class=content><h2>+ title</h2><p>{FILL}</p><div class=ad>{ADVERT}</div><p>{FILL}</p></div><div class=sidebar><p>{ADVERT}</p></div><div id=footer>{ADVERT}</div></body>",
    f"<body><nav><a href=/>{SHORT}</a></nav><article><h1>+ title</h1><p>{FILL}</p><blockquote>{FILL}</blockquote><section class=comments><h3>Comments</h3><p>{ADVERT}</p>{TALK}{TALK}</section></article></body>",
    f"<body><div class='cookie-notice'><p>{ADVERT}</p></div><article><header><h1>title</h1></header><p>{FILL}</p><table><tr><td>+ cell<td>+ cell</table><form><p>{ADVERT}</p></form><aside><p>{ADVERT}</p></aside></article><footer>{SHORT}</footer></body>",
    f"<body><h1>+ title</h1><p>{FILL}</p><p>{FILL}</p><pre>+ code</pre><div class=share><a href=/>{SHORT}</a></div></body>",
    f"<body><div class=menu><a href=/>{SHORT}</a></div><div><div><p>{FILL}</p><p>+ short</p></div><div class=related><ul><li><a href=/>{SHORT}</a><li><a href=/>{SHORT}</a></ul></div></div><form action=/><p>{SHORT}</p></form></body>",
    f"<body><div id=page><div class=post><h1>+ title</h1><div><p>{FILL}</p><p>+ short</p><ol><li>+ point</ol></div><div class=promo><p>{ADVERT}</p></div></div><div class=comments><h2>Comments</h2>{TALK}{TALK}</div><div class=newsletter><form><p>{SHORT}</p></form></div></div></body>",
    f"<body><article><p>+ short</p><p>{FILL}</p><div class=advert>{ADVERT}</div><aside>{SHORT}</aside><p>+ short</p><form>{SHORT}</form><footer>{SHORT}</footer><section id=comments><ul><li>{ADVERT}<li>{ADVERT}</ul></section><nav><a href=/>{SHORT}</a></nav></article></body>",
    f"<body><section><h2>+ title</h2><p>{FILL}</p></section><section><h2>+ title</h2><p>{FILL}</p></section><div class=widget><h3>{SHORT}</h3><p>{ADVERT}</p></div><div class=banner>{ADVERT}</div></body>",
    f"{FILL}",
    f"<body>{FILL}</body>",
    f"<body><div>{FILL}</div></body>",
    f"<p>{FILL}</p><p>+ short</p>",
]


def scaled(counts: np.ndarray) -> np.ndarray:
    """Counts as of WEIGHT nodes: each node has one tag."""
    return counts * (WEIGHT / max(1, counts[: 2 * SIZES[0]].sum()))


def examples() -> np.ndarray:
    # Each page also with shorter articles, shorter boilerplate, and both.
    forms = [s.replace(FILL, fill).replace(ADVERT, advert) for s in LABELLED for fill in (FILL, FILL[:50]) for advert in (ADVERT, ADVERT[:50], ADVERT[:12])]
    pages = [Page(s) for s in forms]
    return scaled(count(pages, [labelled(p) for p in pages]))


def fitted(pages: DataFrame, source: str) -> Model:
    """The model from LABELLED and from a bounded hash sample of the pages that mark their article."""
    n = pages.count()
    share = min(1.0, TRAIN / max(1, n))
    chosen = pages.select(F.col(source).alias("source")).where(F.pmod(F.xxhash64("source"), F.lit(1_000_000)) < share * 1_000_000)

    def kernel():
        def work(part: pa.RecordBatch):
            parsed = [Page(s or "") for s in part.column(0).to_pylist()]
            both = [(p, y) for p in parsed if (y := marked(p)) is not None]
            for k, layout in enumerate(LAYOUTS if both else []):
                total = count(*zip(*(laid_out(p, y, *layout) for p, y in both), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(total)), pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], names=["layout", "cell", "n"])

        return work

    counts = np.zeros((len(LAYOUTS), CELLS))
    for r in emit(chosen, ["source"], "source", "layout long, cell long, n long", kernel).groupBy("layout", "cell").agg(F.sum("n").alias("n")).collect():
        counts[r.layout, r.cell] = r.n
    return model_of(examples() + sum(scaled(c) for c in counts) / len(LAYOUTS))


def main_text(sources: list[str | None], model: Model) -> list[str]:
    """Blocks of each page that are content, with white space made single, one to a line."""
    pages = [Page(s or "") for s in sources]
    chance = model.marginals(*observed(pages)) if pages else np.zeros(0)
    out, at = [], 0
    for p in pages:
        blocks = (" ".join("".join(runs).split()) for node, *runs in p.pieces if chance[at + node] > 0.5)
        out.append("\n".join(b for b in blocks if b))
        at += len(p.tags)
    return out


def extract(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages with text and n_chars (its code points).

    Character references are decoded, white space within a block becomes one space, blocks follow in page order with
    one line feed between them; nothing is capped.  Null and empty pages have an empty text, very long or deep pages are
    read whole.  A block is content if that is likelier than not.  Repeated rows are extracted each; an
    empty table leaves the pages of this module to learn from.  Columns with a result's name, in any case, are replaced.
    """
    model = fitted(pages, source)

    def kernel():
        def work(part: pa.RecordBatch) -> list[pa.Array]:
            texts = main_text(part.column(part.schema.get_field_index(source)).to_pylist(), model)
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return with_columns(pages, source, [string("text"), long("n_chars")], kernel, 2 << 20)
