"""Main-text extraction from HTML by minimum-cut labelling (operator 2).

A page is cut into text blocks. A logistic classifier over bounded features (element, evidence of the enclosing
regions, length, links, punctuation) gives each block a cost of being called content and a cost of being
called boilerplate: the capacities to the two terminals. Neighbours in page order and siblings are joined by
smoothness edges that grow weaker with their distance in the DOM. The maximum flow separates the blocks with the
least total cost, so a block of unsure kind goes with those around it. The classifier is fitted
here, on pages that ``html_training`` makes with known labels.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from .common import tidy

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>",
    re.S,
)
#: A tag whose quotes don't match.
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
#: So many tags without matching quotes are looked through to the end of the page; further ones end at the next ">".
PATIENCE = 50
_NAMES = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# fixed values: element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose inside is no text of the page: scripts, styles, form fields and what is never shown.
RAW = frozenset("script style title textarea template iframe noembed noframes select datalist".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: An opening tag ends these where they are open, up to the nearest of the second set.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

#: Kinds of regions and what speaks for them: element names, roles, words of class and id.
REGIONS: dict[str, tuple[str, str, str]] = {
    "menu": ("nav menu", "navigation menu menubar toolbar", "nav navbar navigation menu menus breadcrumb breadcrumbs crumbs pagination pager paging toolbar skip tabs toc"),
    "header": ("header", "banner", "header masthead topbar branding"),
    "footer": ("footer", "contentinfo", "footer foot copyright legal colophon disclaimer"),
    "side": ("aside", "complementary", "sidebar side aside rail widget widgets related recommended recommendations teaser teasers trending popular tags"),
    "notice": ("dialog", "dialog alert alertdialog", "cookie cookies consent gdpr privacy notice notices notification alert popup modal overlay"),
    "advert": ("", "", "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner"),
    "form": ("form search fieldset", "form search", "form newsletter subscribe subscription signup login register search"),
    "comments": ("", "", "comment comments commentlist reply replies respond discussion disqus responses"),
    "share": ("", "", "share sharing social follow"),
    "content": ("article main", "main article", "article content contents post entry story body main text prose"),
}
_KINDS = list(REGIONS)
_BY_TAG = {x: 1 << k for k, kind in enumerate(_KINDS) for x in REGIONS[kind][0].split()}
_BY_ROLE = {x: 1 << k for k, kind in enumerate(_KINDS) for x in REGIONS[kind][1].split()}
_BY_WORD: dict[str, int] = {}
for _k, _kind in enumerate(_KINDS):
    for _x in REGIONS[_kind][2].split():
        _BY_WORD[_x] = _BY_WORD.get(_x, 0) | 1 << _k
_CONTENT, _HEADER = 1 << _KINDS.index("content"), 1 << _KINDS.index("header")
_BAD = (_CONTENT - 1) & ~_CONTENT
_SHAPES = {
    **dict.fromkeys(("p",), "p"), "h1": "title", **dict.fromkeys(("h2", "h3", "h4", "h5", "h6", "caption", "summary"), "heading"),
    **dict.fromkeys(("li", "dt", "dd"), "item"), **dict.fromkeys(("td", "th", "tr", "table"), "cell"),
    **dict.fromkeys(("pre", "blockquote", "figcaption"), "quoted"), **dict.fromkeys(("label", "button", "legend", "option", "optgroup"), "control"),
}
_LENGTHS = (20, 60, 150, 400)
FEATURES = (
    ["one", "links", "all links", "sentence", "commas", "before title", "under comments heading"]
    + [f"up to {n}" for n in _LENGTHS]
    + [f"is {x}" for x in sorted({*_SHAPES.values()})]
    + [f"in {x}" for x in _KINDS]
    + [f"by name {x}" for x in _KINDS]
    + [f"around {x}" for x in _KINDS]
)
_AT = {x: k for k, x in enumerate(FEATURES)}
#: Costs are cut off here. All edges of a block together weigh less, so a block of which the classifier is sure isn't outvoted.
MOST = 6.0
#: Strength of an edge between blocks of one parent; it falls with the steps between their parents.
NEXT, SIBLING, FAR = 1.5, 0.75, 6
#: What is left of an edge where the evidence changes: one block in a region (or a control) that the other isn't in.
CONTRAST = 0.05
# fixed values: what headings of reader comments say
COMMENT_WORDS = frozenset("comment comments reply replies response responses discussion kommentar kommentare antworten commentaire commentaires comentario comentarios respuestas".split())
_HEADINGS = {f"h{k}": k for k in range(1, 7)}
_SENTENCE_END = ".!?…。\"”’»"


class _Node:
    __slots__ = ("name", "parent", "depth", "tag", "named", "hidden", "link", "open", "size", "heads")

    def __init__(self, name: str, parent: _Node | None, tag: int, named: int, hidden: bool, link: bool):
        self.name, self.parent, self.tag, self.named, self.hidden, self.link = name, parent, tag, named, hidden, link
        self.depth, self.open, self.size, self.heads = parent.depth + 1 if parent else 0, True, 0, 0


def _evidence(name: str, attributes: str) -> tuple[int, int, bool]:
    """Regions that the element and its role speak for, those of its class and id, and whether it is hidden."""
    tag, named, hidden = _BY_TAG.get(name, 0), 0, False
    if not attributes or attributes.isspace():
        return tag, named, hidden
    for key, *values in _NAMES.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if key in ("class", "id"):
            for word in _WORDS.findall(value):
                named |= _BY_WORD.get(word.lower(), 0)
        elif key == "role":
            tag |= _BY_ROLE.get(value.strip().lower(), 0)
        elif key == "style":
            squeezed = value.replace(" ", "").lower()
            hidden |= "display:none" in squeezed or "visibility:hidden" in squeezed
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            hidden = True
    if named & _BAD:
        named &= _BAD  # "comment-content" is about comments
    return tag, named, hidden


class Block:
    """A run of inline text: its words, the share of them in links, and its element."""

    __slots__ = ("text", "links", "node")

    def __init__(self, text: str, links: float, node: _Node):
        self.text, self.links, self.node = text, links, node


class _Open:
    """The open elements. Every step takes constant time, whatever the nesting and stray tags."""

    def __init__(self, root: _Node):
        self.stack = [root]
        self.blocks = [0]  # places of block elements in the stack
        self.places: dict[str, list[int]] = {}

    def top(self) -> _Node:
        while not self.stack[-1].open:
            self.pop()
        return self.stack[-1]

    def block(self) -> _Node:
        return self.stack[self.blocks[-1]]

    def push(self, node: _Node) -> None:
        self.places.setdefault(node.name, []).append(len(self.stack))
        if node.name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def pop(self) -> None:
        node = self.stack.pop()
        if node.open:
            self.places[node.name].pop()
        if self.blocks[-1] == len(self.stack):
            self.blocks.pop()

    def last(self, names: set[str] | tuple[str, ...]) -> int:
        """Place of the innermost open element of these names; 0 without."""
        return max((self.places[x][-1] for x in names if self.places.get(x)), default=0)

    def drop(self, place: int) -> None:
        """Closes the innermost element of its name and none of those inside it."""
        node = self.stack[place]
        node.open = False
        self.places[node.name].pop()
        if node.link:
            for inner in self.stack[place:]:
                inner.link = False

    def close_to(self, place: int) -> None:
        while len(self.stack) > place:
            self.pop()


def parse_blocks(page: str) -> tuple[list[Block], list[_Node]]:
    """Text blocks of a page in order, and all elements, parents first. Any string is accepted; tags need not match."""
    root = _Node("#", None, 0, 0, False, False)
    open_, nodes, blocks = _Open(root), [root], []
    texts: list[str] = []
    plain = [0, 0]  # characters outside and inside links
    at, n = 0, len(page)
    last, patience = page.rfind(">"), PATIENCE
    ends: dict[str, int] = {}  # raw elements whose end tag is known to be missing from some place on

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(texts)).split())
            if text:
                node = open_.block()
                if not node.hidden:
                    blocks.append(Block(text, plain[1] / max(1, sum(plain)), node))
                    node.size += len(text)
            texts.clear()
            plain[:] = 0, 0

    def add(text: str) -> None:
        texts.append(text)
        plain[open_.top().link] += len(text) - text.count(" ")

    while at < n:
        if page[at] != "<":  # text up to the next tag
            stop = page.find("<", at)
            add(page[at : stop if stop >= 0 else n])
            at = stop if stop >= 0 else n
            continue
        token = None
        if at <= last:
            if patience or page[at + 1] in "!?":
                token = _TOKEN.match(page, at)
            if not token and (token := _LOOSE.match(page, at)) and ('"' in token[3] or "'" in token[3]):
                patience = max(0, patience - 1)
        if not token:
            add("<")
            at += 1
            continue
        at = token.end()
        name = (token[2] or "").lower()
        if not name:
            continue
        attributes = token[3] or ""
        if token[1]:
            if name in BLOCK:
                flush()
            if place := open_.last((name,)):
                if name in BLOCK:
                    open_.close_to(place)
                elif place > open_.blocks[-1] or name == "a":  # an inline end tag closes no block
                    open_.drop(place)
            continue
        if name == "br":
            add("\n")
            continue
        if name in RAW and not attributes.endswith("/"):
            stop = None
            if name not in ends:
                stop = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                if not stop:
                    ends[name] = at
            at = stop.start() if stop else n
            close_tag = page.find(">", at)
            at = close_tag + 1 if close_tag >= 0 else n
            continue
        if name in BLOCK:
            flush()
            if name in CLOSES:
                names, until = CLOSES[name]
                within = open_.last(until)
                if places := [k for x in names if (k := open_.last((x,))) > within]:
                    open_.close_to(min(places))
            elif (place := open_.last(("p",))) and place == open_.blocks[-1]:
                open_.close_to(place)
        if name not in VOID and not (attributes.endswith("/") and name not in BLOCK):
            top = open_.top()
            if name == "a" and (place := open_.last(("a",))) > open_.blocks[-1]:
                open_.close_to(place)
                top = open_.top()
            tag, named, hidden = _evidence(name, attributes)
            if name == "head":
                hidden = True
            if name in ("html", "body"):
                tag = named = 0
            node = _Node(name, top, tag, named, hidden or top.hidden, top.link or name == "a")
            open_.push(node)
            if name in BLOCK:
                nodes.append(node)
            if name in ("h1", "article", "main") and not node.hidden:
                node.heads = 1
    flush()
    return blocks, nodes


def minimum_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) with the least sum of violated scores and cut edges.

    scores: a positive score is the cost of calling the node boilerplate, a negative one that of
    calling it content. Maximum flow by augmenting along level graphs; nodes that the source
    still reaches are content.
    """
    n = len(scores)
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in edges:
        head[a].append(len(to))
        to.append(b)
        room.append(w)
        head[b].append(len(to))
        to.append(a)
        room.append(w)
    supply = [max(0.0, s) for s in scores]
    drain = [max(0.0, -s) for s in scores]
    tiny = 1e-9
    while True:
        level = [-1] * n
        queue = deque(k for k in range(n) if supply[k] > tiny)
        for k in queue:
            level[k] = 0
        reached = False
        while queue:
            k = queue.popleft()
            if drain[k] > tiny:
                reached = True
                continue
            for e in head[k]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[k] + 1
                    queue.append(to[e])
        if not reached:
            return [x >= 0 for x in level]
        turn = [0] * n
        for source in range(n):
            while supply[source] > tiny and level[source] == 0:
                path: list[int] = []
                k = source
                while True:
                    if drain[k] > tiny:
                        flow = min([supply[source], drain[k], *(room[e] for e in path)])
                        supply[source] -= flow
                        drain[k] -= flow
                        for e in path:
                            room[e] -= flow
                            room[e ^ 1] += flow
                        break
                    while turn[k] < len(head[k]):
                        e = head[k][turn[k]]
                        if room[e] > tiny and level[to[e]] == level[k] + 1:
                            break
                        turn[k] += 1
                    if turn[k] < len(head[k]):
                        path.append(head[k][turn[k]])
                        k = to[path[-1]]
                    elif path:  # a dead end: back one edge
                        e = path.pop()
                        k = to[e ^ 1]
                        turn[k] += 1
                    else:
                        level[source] = -2
                        break


def _regions(nodes: list[_Node]) -> dict[int, tuple[int, int, int]]:
    """By id of the element: regions that enclose it by element or role, by name, and regions that it is too much of the page for.

    An element that holds a title or an article and half the page's text, or nearly all of it, is no region but a wrapper, as a
    form around a whole page or a body's division of classes for all its parts.
    """
    for node in reversed(nodes):
        up = node.parent
        while up is not None and up.name not in BLOCK and up.parent is not None:
            up = up.parent
        if up is not None:
            up.size += node.size
            up.heads += node.heads
    total = max(1, nodes[0].size)
    out: dict[int, tuple[int, int, int]] = {}
    for node in nodes:
        up = node.parent
        while up is not None and id(up) not in out:
            up = up.parent
        tag, named, around = out[id(up)] if up is not None else (0, 0, 0)
        mine, call = node.tag, node.named
        if node.name == "header" and tag & _CONTENT:
            mine &= ~_HEADER  # an article's header holds its title
        own_head = node.name in ("h1", "article", "main")
        if (mine | call) & _BAD and (2 * node.size >= total and node.heads > own_head or 10 * node.size >= 9 * total):
            around |= (mine | call) & _BAD
            mine, call = mine & _CONTENT, call & _CONTENT
        out[id(node)] = (tag | mine, named | call, around)
    return out


def _is_comments_heading(block: Block) -> bool:
    """A heading such as "3 Comments": no word but one of COMMENT_WORDS and numbers."""
    if block.node.name not in _HEADINGS or len(block.text) > 40:
        return False
    words = re.findall(r"[^\W\d_]+", block.text.lower())
    return len(words) == 1 and words[0] in COMMENT_WORDS


def under_comments_heading(blocks: list[Block]) -> list[bool]:
    """Which blocks are a heading of comments or come after one within its parent element, up to another heading of its rank or above."""
    out, rank, parent = [], 0, None
    for block in blocks:
        mine = _HEADINGS.get(block.node.name, 0)
        if _is_comments_heading(block):
            rank, parent = mine, block.node.parent
        elif rank:
            up = block.node
            while up is not None and up is not parent and up.depth > parent.depth:
                up = up.parent
            if up is not parent or 0 < mine <= rank:
                rank = 0
        out.append(rank > 0)
    return out


def block_features(blocks: list[Block], nodes: list[_Node]) -> np.ndarray:
    """Features [block, FEATURES], all from 0 to 1."""
    regions = _regions(nodes)
    out = np.zeros((len(blocks), len(FEATURES)), np.float32)
    title = next((k for k, b in enumerate(blocks) if _SHAPES.get(b.node.name) == "title"), 0)
    commented = under_comments_heading(blocks)
    for place, (row, block) in enumerate(zip(out, blocks, strict=True)):
        row[_AT["before title"]] = place < title
        row[_AT["under comments heading"]] = commented[place]
        node, text = block.node, block.text
        tag, named, around = regions[id(node)]
        shape, up = _SHAPES.get(node.name), node
        while shape is None and up.parent is not None and up.depth > node.depth - 3:
            up = up.parent
            shape = _SHAPES.get(up.name)
        row[_AT["one"]] = 1
        row[_AT["links"]], row[_AT["all links"]] = block.links, block.links > 0.9
        row[_AT["sentence"]] = text[-1] in _SENTENCE_END
        row[_AT["commas"]] = min(4, text.count(",") + text.count("，") + text.count("、")) / 4
        for most in _LENGTHS:
            if len(text) <= most:
                row[_AT[f"up to {most}"]] = 1
                break
        if shape:
            row[_AT[f"is {shape}"]] = 1
        for k, kind in enumerate(_KINDS):
            row[_AT[f"in {kind}"]] = tag >> k & 1
            row[_AT[f"by name {kind}"]] = named >> k & 1
            row[_AT[f"around {kind}"]] = around >> k & 1
    return out


def fit(x: np.ndarray, y: np.ndarray, decay: float = 2e-4, rounds: int = 60) -> np.ndarray:
    """Weights of a logistic regression by Newton's method with a quadratic penalty."""
    w = np.zeros(x.shape[1])
    x = x.astype(np.float64)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) / len(y) + decay * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x / len(y) + decay * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


@lru_cache(maxsize=1)
def trained(n_pages: int = 400, seed: int = 5, unmarked: float = 2.0) -> np.ndarray:
    """The weights, fitted on ``n_pages`` made pages (once a process)."""
    from .html_training import labelled_pages

    xs, ys = [], []
    for page, labels in labelled_pages(n_pages, seed, unmarked):
        blocks, nodes = parse_blocks(page)
        known = [k for k, b in enumerate(blocks) if b.text in labels]
        xs.append(block_features(blocks, nodes)[known])
        ys += [labels[blocks[k].text] for k in known]
    return fit(np.concatenate(xs), np.array(ys, float))


def _steps(a: _Node, b: _Node) -> int:
    """Steps between two elements over their common ancestor, FAR at most."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth and a.parent is not None:
            a = a.parent
        elif b.parent is not None:
            b = b.parent
        n += 1
    return n


#: Columns of block_features whose change between two blocks makes their edge weak.
_EVIDENCE = [k for k, x in enumerate(FEATURES) if x in ("under comments heading", "is control") or x.startswith(("in ", "by name ")) and not x.endswith(" content")]


def smoothness(blocks: list[Block], features: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges between neighbours in page order and between following blocks of one parent element.

    An edge falls with the distance in the DOM, and to CONTRAST of that where the regions that speak against the blocks differ.
    """
    marks = [x.tobytes() for x in features[:, _EVIDENCE] > 0]
    edges = []
    last: dict[int, int] = {}

    def join(a: int, b: int, strength: float) -> None:
        edges.append((a, b, strength if marks[a] == marks[b] else strength * CONTRAST))

    for k, block in enumerate(blocks):
        parent = block.node.parent or block.node
        if k:
            other = blocks[k - 1].node.parent or blocks[k - 1].node
            if (far := _steps(other, parent)) < FAR:
                join(k - 1, k, NEXT / (1 + far) ** 2)
        if (j := last.get(id(parent))) is not None:
            join(j, k, SIBLING)
        last[id(parent)] = k
    return edges


def label_blocks(page: str, weights: np.ndarray) -> tuple[list[Block], list[bool], list[bool]]:
    """The blocks of a page, which of them the cut calls content, and which the classifier alone would."""
    blocks, nodes = parse_blocks(page)
    if not blocks:
        return blocks, [], []
    features = block_features(blocks, nodes)
    scores = np.clip(features @ weights, -MOST, MOST).tolist()
    return blocks, minimum_cut(scores, smoothness(blocks, features)), [s > 0 for s in scores]


def extract(page: str, weights: np.ndarray | None = None) -> tuple[str, int, int, int]:
    """Main text of a page, its number of blocks, of those kept, and of those that the cut labels otherwise than their own score."""
    blocks, keep, alone = label_blocks(page, trained() if weights is None else weights)
    kept = [b.text for b, good in zip(blocks, keep, strict=True) if good]
    return "\n\n".join(kept), len(blocks), len(kept), sum(a != b for a, b in zip(keep, alone, strict=True))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_kept, n_flipped for every row of pages (page_id, url, html).

    Null html counts as empty; a page without content gives an empty text. Nulls in page_id and url pass
    through, repeated rows give repeated results, other columns are ignored, an empty table gives an empty result. Tags may be broken in any way; of those whose
    quotes don't match, the first PATIENCE are read with their quotes to the end of the page, further ones up to the next ">".
    n_flipped counts the blocks that the cut labels otherwise than the classifier alone.
    """
    ship_package(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # one number a feature

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [extract(x.as_py(), shared.value) for x in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array([x[0] for x in found], pa.string())]
            counts = ([len(x[0]) for x in found], *([x[k] for x in found] for k in (1, 2, 3)))
            columns += [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept", "n_flipped"])

    rows = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("html"))
    return rows.mapInArrow(
        tidy(work), "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long, n_flipped long"
    )
