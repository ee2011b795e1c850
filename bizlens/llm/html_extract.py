"""Main text of web pages by minimum cut: classifier costs against costs of parting neighbours.

A page becomes blocks of text in page order. Markup evidence and a logistic classifier over the block's text give each
block a cost of being called content and one of being called boilerplate: the capacities of its two terminal edges.
Blocks that follow each other, and blocks of one parent element, are joined by smoothness edges, weaker the farther
apart they are in the tree. The minimum cut is the cheapest labelling of the whole page.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 1 << 23
# Element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("head script style template noscript textarea title xmp iframe noembed noframes svg canvas object audio video map select datalist button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
                  "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
          "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
#: Elements that an implied or stray end tag may not close through.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}, "option": {"select"}}
ENDS_P = BLOCK - {"body", "html", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "option", "legend", "summary"}
SITE = frozenset("nav footer aside dialog menu search".split())
SITE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words in class and id that name reader comments and adverts; even an article element inside stays boilerplate.
STICKY = frozenset("comment comments disqus respond replies ad ads adsbox advert adverts advertisement advertisements advertising adslot adsense sponsor sponsored promo promotion".split())
#: Words that name other parts around the article.
AROUND = frozenset("nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer masthead banner cookie cookies consent gdpr notice notices notification alert popup modal "
                   "overlay newsletter subscribe subscription signup login form search share sharing social related recommended recommendations widget widgets toolbar pager pagination legal "
                   "copyright disclaimer skip topbar teaser teasers".split())
HEADER = frozenset("header head top".split())
INSIDE = frozenset("article content main post entry story articlebody maincontent".split())
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|hidden|style|aria-hidden)(?=[\s=/]|\Z)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
SENTENCE = re.compile(r"[.!?…]['\")\]]?$")
FEATURES = ("bias", "log words", "link share", "all links", "sentence end", "commas a word", "heading", "paragraph", "list item", "copyright", "capital starts", "middle of page")


@dataclass(frozen=True)
class Settings:
    """Costs are natural log odds. `max_pages` bounds the pages that the classifier is fitted on, whatever the table
    holds; `prior` are the weights it starts from and keeps where the pages say nothing."""
    article: float = 6.0
    inside: float = 2.5
    around: float = 6.5
    sticky: float = 12.0
    text_limit: float = 4.0
    adjacent: float = 1.2
    sibling: float = 0.8
    max_pages: int = 2_000
    prior: tuple[float, ...] = (-1.0, 0.6, -2.5, -1.0, 1.0, 4.0, 0.8, 0.6, -0.6, -2.0, -0.8, 0.5)
    prior_rows: float = 50.0
    rounds: int = 12


@dataclass
class Element:
    tag: str
    number: int
    parent: "Element | None"
    depth: int
    evidence: int = 0  # 2 article, 1 inside, 0 none, -1 around, -2 sticky
    source: int = 0  # the element whose class or id says so, 0 if none does
    link: bool = False
    hidden: bool = False
    block: "Element | None" = None  # the block element that it is or lies in


@dataclass
class Block:
    text: str
    owner: Element
    tag: str
    link_chars: int
    evidence: int
    source: int


def _evidence(tag: str, attributes: str, have: int) -> tuple[int, bool, bool]:
    """What the element and those around it (`have`) say, whether a class or id says so, and whether it is out of sight."""
    names, role, hidden = set(), "", False
    if attributes:
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names |= {x.lower() for x in PARTS.findall(value)}
            elif key == "role":
                role = value.strip().lower()
            elif key == "style":
                hidden |= "display:none" in value.replace(" ", "").lower()
            else:
                hidden |= key == "hidden" or value.lower() == "true"
    if hidden:
        return -2, False, True
    if have == -2 or tag in ("html", "body"):
        return have, False, False
    if tag in SITE or role in SITE_ROLES:
        return -2, False, False
    if names & STICKY:
        return -2, True, False
    if tag in ("article", "main") or role in ("article", "main"):
        return 2, False, False
    if tag == "header" and have < 1:
        return -1, False, False
    if names & AROUND or names & HEADER and have < 1 or tag == "form" or role == "form":
        return -1, True, False
    if have == 0 and names & INSIDE:
        return 1, False, False
    return have, False, False


def blocks_of(html: str) -> list[Block]:
    """The page's blocks of text in page order. A block is what stands between two tags of block elements; white space in
    it is one space, character references are decoded, and comments, scripts, styles and form controls are left out."""
    out: list[Block] = []
    stack: list[Element] = []
    counts: dict[str, int] = {}
    root = Element("", 0, None, 0)
    root.block = root
    here, number, hidden = root, 0, 0
    pieces: list[str] = []
    says: dict[tuple[int, int], int] = {}  # characters of the block by evidence and its source
    link_chars = links = 0

    def flush() -> None:
        nonlocal pieces, link_chars
        if pieces:
            if text := " ".join("".join(pieces).split()):
                evidence, source = max(says, key=says.get, default=(here.evidence, here.source))
                out.append(Block(text, here.block, here.block.tag, min(link_chars, len(text)), evidence, source))
            pieces, link_chars = [], 0
            says.clear()

    def pop_to(k: int) -> None:
        nonlocal here, hidden, links
        while len(stack) > k:
            e = stack.pop()
            counts[e.tag] -= 1
            hidden -= e.hidden
            links -= e.link
        here = stack[-1] if stack else root

    def close(names, scope) -> None:
        """Close the nearest open element of `names`, with all inside it, unless `scope` stands between."""
        if not any(counts.get(x) for x in names):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in names:
                pop_to(k)
                return
            if stack[k].tag in scope:
                return

    pos, end = 0, len(html)
    while pos < end:
        at = html.find("<", pos)
        if at < 0:
            at = end
        m = TAG.match(html, at) if at < end else None
        stop = at if m or at == end else at + 1  # a bare < is text
        if stop > pos and not hidden:
            piece = html[pos:stop]
            piece = unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            size = len(" ".join(piece.split()))
            if size:
                says[here.evidence, here.source] = says.get((here.evidence, here.source), 0) + size
            if links:
                link_chars += size
        if at == end:
            break
        if not m:
            pos = stop
            continue
        pos = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing = name.lower(), bool(m[1] or m[4])
        block = tag in BLOCK
        if block:
            flush()
        if closing:
            if tag == "br":
                pieces.append(" ")
            elif counts.get(tag):
                close({tag}, SCOPE.get(tag, ()))
            continue
        if tag in VOID:
            if tag == "br":
                pieces.append(" ")
            continue
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE.get(tag, ()) or {"table", "button", "object"})
        if tag in ENDS_P and counts.get("p"):
            close({"p"}, {"table", "button", "object", "td", "th", "li", "blockquote"})
        attributes = m[3] if m[2] else m[6] or ""
        number += 1
        evidence, named, unseen = _evidence(tag, attributes, here.evidence)
        if attributes.endswith("/") and not block and tag not in RAW and tag != "a":
            continue
        e = Element(tag, number, here, here.depth + 1, evidence, number if named else here.source if evidence == here.evidence else 0, tag == "a", unseen or tag in HIDDEN)
        e.block = e if block else here.block
        stack.append(e)
        counts[tag] = counts.get(tag, 0) + 1
        here = e
        hidden += e.hidden
        links += e.link
        if tag in RAW:  # what is in it is no markup
            gone = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, pos)
            pos = gone.start() if gone else (end if tag != "title" else pos)
    flush()
    return _without_wrappers(out)


def _without_wrappers(blocks: list[Block]) -> list[Block]:
    """A class or id on what wraps most of the page (a form around it all, "with-sidebar") says nothing about its text."""
    total = sum(len(b.text) for b in blocks)
    held: dict[tuple[int, int], int] = {}
    for b in blocks:
        if b.source:
            held[b.evidence, b.source] = held.get((b.evidence, b.source), 0) + len(b.text)
    wraps = {k for k, n in held.items() if 10 * n > total * (6 if k[0] == -1 else 9)}
    for b in blocks:
        if (b.evidence, b.source) in wraps:
            b.evidence = 0
    return blocks


def describe(blocks: list[Block]) -> np.ndarray:
    """Features of every block, in the order of FEATURES; nothing from markup that the evidence already counts."""
    x = np.zeros((len(blocks), len(FEATURES)))
    for i, b in enumerate(blocks):
        words = b.text.split(" ")
        n = len(words)
        share = b.link_chars / max(1, len(b.text))
        x[i] = (1.0, min(np.log1p(n), 5.0), share, share > 0.95, bool(SENTENCE.search(b.text)), min(1.0, b.text.count(",") / n), b.tag in ("h1", "h2", "h3"),
                b.tag in ("p", "blockquote", "pre"), b.tag in ("li", "dt", "dd", "option"), "©" in b.text or "copyright" in b.text.lower(),
                sum(w[:1].isupper() for w in words) / n, 1 - abs(2 * (i + 0.5) / len(blocks) - 1))
    return x


def distance(a: Element, b: Element) -> int:
    """Steps in the tree from one element to the other."""
    steps = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        steps += 1
    return steps


def edges_of(blocks: list[Block], s: Settings) -> list[tuple[int, int, float]]:
    """Smoothness edges: each block to the next one in the page, and to the last one before it with the same parent."""
    out: list[tuple[int, int, float]] = []
    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        near = b.owner.parent.number if b.owner.parent is not None else 0
        if i:
            out.append((i - 1, i, s.adjacent / (1 + distance(blocks[i - 1].owner, b.owner))))
        if (k := last.get(near)) is not None and blocks[k].tag == b.tag:
            out.append((k, i, s.sibling / (1 if k + 1 == i else 2)))
        last[near] = i
    return out


def minimum_cut(gain: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: a block called False costs its gain if that is positive, called True its loss; each edge
    between unlike labels costs its weight.

    A block whose gain outweighs all its edges is settled at once and passes its edges on to its neighbours; what is left
    is cut by shortest augmenting paths (Dinic).
    """
    n = len(gain)
    gain = list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, w in edges:
        if a != b and w > 0:
            near[a][b] = near[a].get(b, 0) + w
            near[b][a] = near[b].get(a, 0) + w
    label: list[bool | None] = [None] * n
    pull = [sum(x.values()) for x in near]
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is not None or abs(gain[i]) < pull[i] or gain[i] == 0 and pull[i]:
            continue
        label[i] = gain[i] > 0
        for j, w in near[i].items():
            if label[j] is None:
                gain[j] += w if label[i] else -w
                pull[j] -= w
                del near[j][i]
                todo.append(j)
        near[i] = {}
    rest = [i for i in range(n) if label[i] is None]
    if rest:
        number = {v: k for k, v in enumerate(rest)}
        for k, side in enumerate(_dinic([gain[i] for i in rest], [{number[j]: w for j, w in near[i].items()} for i in rest])):
            label[rest[k]] = side
    return [bool(x) for x in label]


def _dinic(gain: list[int], near: list[dict[int, int]]) -> list[bool]:
    """Blocks on the source's side of a minimum cut; residual capacities live in `near`, terminals in `source`, `sink`."""
    n = len(gain)
    source, sink = [max(g, 0) for g in gain], [max(-g, 0) for g in gain]
    while True:
        level = [-1] * n
        queue = deque(i for i in range(n) if source[i])
        for i in queue:
            level[i] = 0
        reached = False
        while queue:
            i = queue.popleft()
            reached |= sink[i] > 0
            for j, c in near[i].items():
                if c and level[j] < 0:
                    level[j] = level[i] + 1
                    queue.append(j)
        if not reached:
            return [x >= 0 for x in level]
        ways = [list(x) for x in near]
        for start in range(n):
            while source[start]:
                path = [start]
                while path:
                    i = path[-1]
                    if sink[i]:
                        break
                    while ways[i] and not (near[i][ways[i][-1]] and level[ways[i][-1]] == level[i] + 1):
                        ways[i].pop()
                    if ways[i]:
                        path.append(ways[i][-1])
                    else:
                        path.pop()
                        if path:
                            ways[path[-1]].pop()
                if not path:
                    break
                flow = min([source[start], sink[path[-1]], *(near[a][b] for a, b in zip(path, path[1:]))])
                source[start] -= flow
                sink[path[-1]] -= flow
                for a, b in zip(path, path[1:]):
                    near[a][b] -= flow
                    near[b][a] += flow


def label_blocks(blocks: list[Block], weights: np.ndarray, s: Settings = Settings()) -> list[bool]:
    """Which blocks are content."""
    if not blocks:
        return []
    odds = np.clip(describe(blocks) @ weights, -s.text_limit, s.text_limit)
    marked = {2: s.article, 1: s.inside, 0: 0.0, -1: -s.around, -2: -s.sticky}
    gain = [round(1000 * (o + marked[b.evidence])) for o, b in zip(odds.tolist(), blocks)]
    return minimum_cut(gain, [(a, b, round(1000 * w)) for a, b, w in edges_of(blocks, s)])


def main_text(html: str | None, weights: np.ndarray, s: Settings = Settings()) -> str:
    blocks = blocks_of(html or "")
    return "\n".join(b.text for b, keep in zip(blocks, label_blocks(blocks, weights, s)) if keep)


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of blocks whose markup is plain, with what it says."""
    for b in batches:
        found = []
        for html in b.column("_html").to_pylist():
            blocks = blocks_of(html or "")
            found += [[float(k.evidence == 2), *x] for k, x in zip(blocks, describe(blocks).tolist()) if k.evidence in (2, -2)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64()))], names=["x"])


def fit(pages: DataFrame, s: Settings = Settings(), id_col: str = "page_id", html_col: str = "html") -> np.ndarray:
    """Weights of the text classifier. Blocks in plain markup (article or main; nav, footer, aside, adverts, comments)
    teach it what text is like on either side, for blocks whose markup says nothing.

    At most about `max_pages` pages are read, drawn by a fixed hash of the page; both sides weigh the same. The weights
    minimise logistic loss plus the squared distance from `prior` (Newton's method), so that they are `prior` where no
    page has both sides.
    """
    prior = np.array(s.prior)
    order = F.pmod(F.xxhash64(F.lit(11), F.col(id_col).cast("string"), F.col(html_col)), F.lit(1 << 40))
    share = min(1.0, s.max_pages / max(pages.count(), 1))
    sample = pages.where(order < F.lit(int(share * (1 << 40)))).limit(s.max_pages + s.max_pages // 10).select(F.col(html_col).alias("_html"))
    rows = sample.mapInArrow(_examples, "x array<double>").toArrow().column("x").to_pylist()
    if not rows:
        return prior
    data = np.array(sorted(rows))  # in one order, whatever tasks they came from
    y, x = data[:, 0], data[:, 1:]
    if y.min() == y.max():
        return prior
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    w = prior.copy()
    for _ in range(s.rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + s.prior_rows * (w - prior)
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + s.prior_rows * np.eye(len(w))
        w = w - np.linalg.solve(curve, slope)
    return np.round(w, 6)


def _extract(weights: np.ndarray, s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, first, held = [], 0, 0
            for i in range(b.num_rows):
                text = main_text(b.column("_html")[i].as_py(), weights, s)
                texts.append(text)
                held += len(text)
                if held > BATCH_BYTES or i == b.num_rows - 1:
                    part = b.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("_url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                                                     names=["page_id", "url", "text", "n_chars"])
                    texts, first, held = [], i + 1, 0
    return run


def html_extract(pages: DataFrame, s: Settings = Settings(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null and empty html, and pages without any content block, give an empty text. Rows that repeat an id are read each,
    and equal pages give equal texts. White space is Unicode's (a no-break space too); line breaks by br are white
    space. Broken markup is read as browsers do in the main: unclosed paragraphs and items end where the next begins,
    stray end tags are passed over, an unclosed comment or script takes the rest of the page. Extra columns are ignored;
    an empty table gives an empty result.
    """
    weights = fit(pages, s, id_col, html_col)
    kept = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"))
    kind = lambda c: pages.schema[c].dataType.simpleString()
    return kept.mapInArrow(_extract(weights, s), f"page_id {kind(id_col)}, url {kind(url_col)}, text string, n_chars long")
