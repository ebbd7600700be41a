"""Main text of web pages by minimum cut.

A page becomes a row of text blocks (runs of text between block-level tags) and the elements around
them that tell something by tag or by class words: a menu, a footer, an article. A classifier gives each
block a log-odds of being content: a logistic regression over its text (length, share of links, end,
kind of tag) and over what the nearest telling element says. The text's part is bounded, the sum is too, and
is the block's capacities to the two terminals. No element has a capacity of its own: elements are nodes
that tie their blocks together. Smoothness edges tie neighbouring blocks, more so under one parent, each
block to its element, and each element to the one around it. The minimum cut is the labelling of least
total cost; the content side, in page order, is the text.

So a class word that fits few pages well (tags, alert, legal) is outvoted by a paragraph under it, and a list of
links by none. Tags and words of what is never main text (menus, adverts, reader comments) weigh more than a
block's own text can. Weights of the text's features are fitted on a bounded sample of pages, on blocks whose
markup leaves no doubt; what markup itself weighs is given, as the labels come from it.

Words weigh on the element that carries them only, whole class names before their parts; parts are a
hint. An element around most of the page's text is a wrapper, whose words say little.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import deque
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batchwise, spread

# Element names of HTML by what they do to text.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
RAW_TAGS = frozenset("script style template iframe noembed xmp svg annotation annotation-xml textarea".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that an opening tag of the key's kind ends, if the nearest open block is one of them.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"tr", "td", "th", "thead"}, "thead": {"tr", "td", "th"}, "tfoot": {"tr", "td", "th", "tbody"}, "body": {"head"},
}
# Elements, roles and class words that tell what they hold.
CONTENT_TAGS = frozenset("article main".split())
APART = CONTENT_TAGS | frozenset("nav footer aside menu header dialog select search head title".split())
BOILERPLATE_TAGS = frozenset("nav footer aside menu header dialog select search form fieldset button head title".split())
ROLES = {"main": 1, "article": 1, "navigation": -1, "banner": -1, "contentinfo": -1, "complementary": -1, "search": -1, "dialog": -1, "alert": -1, "menu": -1, "menubar": -1, "form": -1}
CONTENT_WORDS = frozenset("article content entry story post main maincontent mainbody articlebody postbody text prose".split())
BOILERPLATE_WORDS = frozenset(
    (
        "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar header masthead topbar footer foot bottombar sidebar side rail aside widget "
        "comment comments discussion disqus replies reply respond cookie cookies consent gdpr notice notification alert disclaimer warning popup modal overlay share sharing social related recommended recommendations "
        "breadcrumb breadcrumbs pagination pager login signin signup register subscribe subscription newsletter form search skip copyright legal tags toolbar hidden"
    ).split()
)
#: Of these words, those that also stand on elements of main text.
WEAK_WORDS = frozenset("alert banner disclaimer legal promotion rail register respond side skip tags toolbar warning".split())
#: What an element says: a tag of content, a word of it, a hint; a tag, role or word of boilerplate, a weak word; what isn't shown.
IS_CONTENT, NAMED_CONTENT, HINTED = 4.0, 1.5, 1.0
IS_BOILERPLATE, NAMED_WEAKLY, NOT_SHOWN = 6.0, 2.0, 8.0
#: What a wrapper says, at most.
WRAPPER = 0.5
#: Ties: a block to its element, an element to the one around it, neighbours under one parent and other neighbours.
TIE, NESTED, SIBLINGS, NEIGHBOURS = 0.75, 0.5, 0.75, 0.35
#: Bounds of the log-odds from a block's text, and of all.
TEXT_MOST, MOST = 3.0, 8.0
#: Pages that the classifier is fitted on, and blocks of each, at most.
FIT_PAGES, FIT_BLOCKS = 400, 200
LONG_WORDS = 30
FEATURES = ("bias", "linked", "length", "stop", "heading", "prose", "item", "inside", "outside")
TEXT = 7
#: Weights before fitting, and without any labelled block.
PRIOR = np.array([-1.2, -4.0, 2.5, 0.6, 1.2, 0.8, -0.3, 1.0, 1.0])
#: Strength of the penalty that keeps weights near PRIOR. Those of tags hardly move, since the pages whose markup is certain use tags
#: otherwise than others do; the last two can't be learned from labels that markup gives.
RIDGE = np.array([50.0, 50.0, 50.0, 50.0, 1e5, 1e5, 1e5, 1e9, 1e9])

# A tag with its attributes, whose names and values end as in the HTML standard: a quote within an unquoted value or a name is part of it.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>][^\s>]*+|(?=>)))?+)*+)>")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_ATTR = re.compile(r"(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Element:
    """An element with a role (or a hint of one): sign, and where it is."""

    sign: int
    around: int  # nearest element of this kind around it, -1 if none
    certain: bool
    said: float  # log-odds, by size
    softens: str = ""  # "words" or "form": what an element around most of the text loses
    blocks: int = 0
    chars: int = 0
    titled: bool = False  # holds a h1 or an element of content


@dataclass
class Block:
    parent: int  # number of the block-level element directly around it
    within: int  # number of the one around that
    inline: bool  # in an inline element that tells something: part of no row of blocks
    tag: str
    element: int  # nearest element with a role or hint, -1 if none
    hints: tuple[int, ...] = ()
    pieces: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def _role(tag: str, attrs: str, around: int = 0, apart: bool = False) -> tuple[float, bool, str]:
    """(what an element says, certain, softens); 0 tells nothing.

    around: sign of the nearest certain element around it; within boilerplate, words of content say
    nothing, and an article only if it is not apart (within another article, a menu or the like).
    """
    said, certain, softens = _said(tag, attrs, around > 0)
    if said > 0 and (apart if tag in CONTENT_TAGS else around < 0):
        return 0.0, True, ""
    return said, certain, softens


def _said(tag: str, attrs: str, inside_content: bool) -> tuple[float, bool, str]:
    said, softens = 0.0, ""
    if tag in CONTENT_TAGS:
        said = IS_CONTENT
    elif tag in BOILERPLATE_TAGS and not (tag == "header" and inside_content):
        said, softens = -IS_BOILERPLATE, "form" if tag in ("form", "fieldset") else "words" if tag == "header" else ""
    if not attrs or tag in ("html", "body"):  # words there tell pages apart, not the texts within one
        return said, True, softens
    tokens: set[str] = set()
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return -NOT_SHOWN, True, ""
        if name == "role" and value.lower() in ROLES:
            return IS_CONTENT if ROLES[value.lower()] > 0 else -IS_BOILERPLATE, True, ""
        if name in ("class", "id"):
            tokens.update(value.split())
    whole = {t.lower() for t in tokens}
    good, poor = whole & CONTENT_WORDS, whole & BOILERPLATE_WORDS
    if bool(good) != bool(poor):
        if tag in BOILERPLATE_TAGS and good:  # a menu stays one, whatever it is called
            return said, True, softens
        if tag in CONTENT_TAGS and poor <= WEAK_WORDS:
            return said, True, softens
        return _weight(poor) if poor else max(said, NAMED_CONTENT), True, "words" if poor else softens
    if said or good:
        return said, True, softens
    named = [{w.lower() for w in _WORDS.findall(t)} for t in tokens]
    parts = set().union(*named)
    good, poor = parts & CONTENT_WORDS, parts & BOILERPLATE_WORDS
    if bool(good) == bool(poor):
        return 0.0, True, ""
    # a name of such words only says as much as one of them
    only = [n for n in named if n and n <= BOILERPLATE_WORDS]
    if poor and only:
        return _weight(set().union(*only)), True, "words"
    return HINTED if good else -HINTED, False, ""


def _weight(words: set[str]) -> float:
    return -NAMED_WEAKLY if words <= WEAK_WORDS else -IS_BOILERPLATE


def parse(page: str) -> tuple[list[Block], list[Element]]:
    """The page's text blocks in order and the elements with a role or hint; never fails on broken markup.

    One pass: a tag that is never closed swallows the rest, as the HTML standard has it.
    """
    blocks: list[Block] = []
    elements: list[Element] = []
    stack: list[tuple[str, int, int, tuple[int, ...], int, bool]] = [("", 0, -1, (), 0, False)]  # tag, number, element, hints, its sign, apart
    inline: list[tuple[str, int, Block | None]] = []  # open inline elements with a bearing (and those of their tag within): element, the block that goes on after them
    count, at, links, lowered = 0, 0, 0, None
    current: Block | None = None

    def enter(tag: str, attrs: str, around: tuple) -> tuple[int, tuple[int, ...], int, bool]:
        """Element, hints, sign and whether it is apart, within a new element."""
        _, _, element, hints, own, apart = around
        said, certain, softens = _role(tag, attrs, own, apart)
        apart |= tag in APART and not (tag == "header" and said >= 0)
        if not said:
            return element, hints, own, apart
        sign = 1 if said > 0 else -1
        elements.append(Element(sign, element, certain, said, softens))
        number = len(elements) - 1
        if certain:
            return number, (), sign, apart
        return element, (*hints[-3:], number), own, apart

    def text(piece: str) -> None:
        nonlocal current
        if not piece or piece.isspace() and current is None:
            return
        if current is None:
            tag, number, element, hints, *_ = stack[-1]
            apart = [e for _, e, _ in inline if e >= 0]
            if apart:
                element, hints = apart[-1], ()
            current = Block(number, stack[-2][1] if len(stack) > 1 else -1, bool(apart), tag, element, hints)
            blocks.append(current)
        piece = html_lib.unescape(piece) if "&" in piece else piece
        current.pieces.append(piece)
        if links:
            current.linked += len(piece.strip())

    while at < len(page):
        start = page.find("<", at)
        if start < 0:
            text(page[at:])
            break
        nxt = page[start + 1 : start + 3]
        letter = (nxt[1:2] if nxt[:1] == "/" else nxt[:1]) in _LETTERS  # of any other alphabet it is text
        if not letter and nxt[:1] not in ("!", "?", "/"):
            text(page[at : start + 1])
            at = start + 1
            continue
        text(page[at:start])
        if not letter:  # comments, declarations and what is treated as a comment
            end, size = (page.find("-->", start + 4), 3) if page.startswith("<!--", start) else (page.find(">", start), 1)
            if end < 0:
                break
            at = end + size
            continue
        m = _TAG.match(page, start)
        if m is None:  # no end anywhere: the tag is open at the end of the page
            break
        at = m.end()
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW_TAGS:
            if not closing and not (m[3].endswith("/") and tag == "svg"):
                lowered = lowered if lowered is not None else page.lower() if page.isascii() else _lower_ascii(page)
                stop = lowered.find(f"</{tag}", at)
                at = len(page) if stop < 0 else stop
            continue
        if tag == "br":
            if current is not None:
                current.pieces.append(" ")
            continue
        if tag == "a":
            links = 0 if closing else 1
        if tag not in BLOCK_TAGS:
            if closing:
                for i in range(len(inline) - 1, -1, -1):
                    if inline[i][0] == tag:
                        _, e, before = inline.pop(i)
                        if e >= 0 and i < len(inline):  # badly nested: those left open go on
                            inline[i], current = (*inline[i][:2], before), None
                        elif e >= 0:
                            current = before
                        break
            elif tag not in VOID_TAGS and (m[3] or tag == "button" or inline):
                said, certain, _ = _role(tag, m[3])
                if said < 0 and certain:
                    around = next((e for _, e, _ in reversed(inline) if e >= 0), stack[-1][2])
                    elements.append(Element(-1, around, True, said))
                    inline.append((tag, len(elements) - 1, current))
                    current = None
                elif any(t == tag for t, _, _ in inline):
                    inline.append((tag, -1, None))
            continue
        current = None
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    inline.clear()
                    break
            continue
        if stack[-1][0] == "p":
            stack.pop()
            inline.clear()
        while stack[-1][0] in ENDS.get(tag, ()):
            stack.pop()
            inline.clear()
        if tag not in VOID_TAGS:
            count += 1
            stack.append((tag, count, *enter(tag, m[3], stack[-1])))
            if tag == "h1" or tag in CONTENT_TAGS:
                e = stack[-1][2]
                for h in (*stack[-1][3], *([e] if e >= 0 else [])):
                    elements[h].titled = True
    kept = []
    for b in blocks:
        b.text = " ".join("".join(b.pieces).split())
        if b.text:
            kept.append(b)
            for e in (b.element, *b.hints):
                if e >= 0:
                    elements[e].blocks += 1
                    elements[e].chars += len(b.text)
    # an element holds what those within it hold; they come after it
    for e in range(len(elements) - 1, -1, -1):
        around = elements[e].around
        if around >= 0:
            if elements[e].certain:
                elements[around].blocks += elements[e].blocks
                elements[around].chars += elements[e].chars
            elements[around].titled |= elements[e].titled
    return kept, elements


def _lower_ascii(page: str) -> str:
    """Lower case that keeps every position."""
    return re.sub(r"[A-Z]+", lambda m: m[0].lower(), page)


def text_features(b: Block) -> list[float]:
    words = b.text.count(" ") + 1
    heading, prose = b.tag in ("h1", "h2", "h3", "h4", "h5", "h6"), b.tag in ("p", "blockquote", "pre")
    return [1.0, min(1.0, b.linked / len(b.text)), min(1.0, words / LONG_WORDS), float(b.text[-1] in ".!?…:;\"”»"), float(heading), float(prose), float(b.tag in ("li", "dt", "dd", "td", "th", "option"))]


def sayings(elements: list[Element], chars: int) -> list[float]:
    """What each element says, less if it is a wrapper around most of the page's text."""
    out = []
    for e in elements:
        most = 2 * e.chars > chars
        soft = not e.certain or e.sign < 0 and (e.softens == "form" or e.softens == "words" and e.titled)
        out.append(e.sign * min(abs(e.said), WRAPPER) if most and soft else e.said)
    return out


def telling(elements: list[Element], said: list[float]) -> list[int]:
    """For each element the nearest one, itself or around it, that is no wrapper; -1 if there is none."""
    out: list[int] = []
    for k, e in enumerate(elements):  # those around come before
        out.append(k if abs(said[k]) > WRAPPER else out[e.around] if e.around >= 0 else -1)
    return out


def features(blocks: list[Block], elements: list[Element]) -> np.ndarray:
    """A row for each block: its text's features, and what the markup around says for and against."""
    said = sayings(elements, sum(len(b.text) for b in blocks))
    near = telling(elements, said)
    rows = np.zeros((len(blocks), len(FEATURES)))
    for row, b in zip(rows, blocks, strict=True):
        row[:TEXT] = text_features(b)
        words = [said[h] for h in b.hints] + ([said[near[b.element]]] if b.element >= 0 and near[b.element] >= 0 else [])
        row[TEXT], row[TEXT + 1] = sum(w for w in words if w > 0), sum(w for w in words if w < 0)
    return rows


def log_odds(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return np.clip(np.clip(x[:, :TEXT] @ weights[:TEXT], -TEXT_MOST, TEXT_MOST) + x[:, TEXT:] @ weights[TEXT:], -MOST, MOST)


def network(blocks: list[Block], elements: list[Element], odds: list[float]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Terminal capacities of blocks, and of elements (none), and the smoothness edges between them."""
    n, ties = len(blocks), []
    near = telling(elements, sayings(elements, sum(len(b.text) for b in blocks)))
    last = -1
    for i, b in enumerate(blocks):
        if not b.inline:
            if last >= 0:
                p = blocks[last]
                near_by = b.within == p.within or b.parent in (p.parent, p.within) or b.within == p.parent
                ties.append((last, i, SIBLINGS if near_by else NEIGHBOURS))
            last = i
        if b.element >= 0 and near[b.element] >= 0:
            ties.append((i, n + near[b.element], TIE))
    for k, e in enumerate(elements):
        if e.around >= 0 and near[e.around] >= 0:
            ties.append((n + k, n + near[e.around], NESTED))
    return odds + [0.0] * len(elements), ties


def minimum_cut(odds: list[float], ties: list[tuple[int, int, float]]) -> list[bool]:
    """True for the content side of the minimum cut (undecided blocks go to boilerplate).

    A block whose terminal capacity exceeds all its edges together keeps its terminal in every
    minimum cut; such blocks are settled first and their edges become capacities of their
    neighbours. What is left is solved by augmenting shortest paths level by level.
    """
    n = len(odds)
    unary, near = list(odds), [dict() for _ in range(n)]
    for i, j, w in ties:
        near[i][j] = near[i].get(j, 0.0) + w
        near[j][i] = near[j].get(i, 0.0) + w
    label: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if label[i] is None and abs(unary[i]) > sum(near[i].values()):
            label[i] = unary[i] > 0
            for j, w in near[i].items():
                del near[j][i]
                unary[j] += w if label[i] else -w
                todo.append(j)
            near[i] = {}
    left = [i for i in range(n) if label[i] is None]
    if not left:
        return [bool(x) for x in label]
    number = {i: k for k, i in enumerate(left)}
    s, t = len(left), len(left) + 1
    graph: list[list[int]] = [[] for _ in range(len(left) + 2)]
    to: list[int] = []
    cap: list[float] = []

    def arc(a: int, b: int, forth: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        cap.append(forth)
        graph[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i in left:
        if unary[i] > 0:
            arc(s, number[i], unary[i], 0.0)
        elif unary[i] < 0:
            arc(number[i], t, -unary[i], 0.0)
        for j, w in near[i].items():
            if i < j:
                arc(number[i], number[j], w, w)
    tiny = 1e-12
    while True:
        level = [-1] * len(graph)
        level[s], queue = 0, deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            break
        nxt, path, v = [0] * len(graph), [], s
        while True:
            if v == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                path, v = [], s
                continue
            while nxt[v] < len(graph[v]):
                e = graph[v][nxt[v]]
                if cap[e] > tiny and level[to[e]] == level[v] + 1:
                    break
                nxt[v] += 1
            if nxt[v] < len(graph[v]):
                path.append(e)
                v = to[e]
            elif v == s:
                break
            else:
                v = to[path.pop() ^ 1]
                nxt[v] += 1
    for i in left:
        label[i] = level[number[i]] >= 0
    return [bool(x) for x in label]


def labels(blocks: list[Block], elements: list[Element], weights: np.ndarray = PRIOR) -> list[bool]:
    """True for the blocks on the content side of the minimum cut."""
    if not blocks:
        return []
    odds = log_odds(features(blocks, elements), weights).tolist()
    return minimum_cut(*network(blocks, elements, odds))[: len(blocks)]


def main_text(page: str, weights: np.ndarray = PRIOR) -> str:
    blocks, elements = parse(page)
    return "\n".join(b.text for b, k in zip(blocks, labels(blocks, elements, weights), strict=True) if k)


def certain_blocks(page: str) -> tuple[list[list[float]], list[bool]]:
    """Features of the text, and labels, of blocks whose nearest element leaves no doubt; evenly drawn, FIT_BLOCKS at most."""
    blocks, elements = parse(page)
    said = sayings(elements, sum(len(b.text) for b in blocks))
    near = telling(elements, said)
    sure = [(b, said[near[b.element]]) for b in blocks if b.element >= 0 and near[b.element] >= 0 and b.tag not in ("title", "head")]
    sure = [(b, v) for b, v in sure if abs(v) >= IS_CONTENT]
    if len(sure) > FIT_BLOCKS:
        sure = [sure[i * len(sure) // FIT_BLOCKS] for i in range(FIT_BLOCKS)]
    return [text_features(b) + [0.0, 0.0] for b, _ in sure], [v > 0 for _, v in sure]


def regress(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps, with a penalty on the distance from PRIOR; both classes weigh alike."""
    w = PRIOR.copy()
    if not y.any() or y.all():
        return w
    weight = np.where(y, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + RIDGE * (w - PRIOR)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(RIDGE), grad)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(pages: DataFrame, key: str = "page_id", body: str = "html") -> np.ndarray:
    """Weights of the block classifier, from FIT_PAGES pages at most, those of least hash of the whole body.

    Only blocks whose role the markup leaves no doubt about are learned from. Without any of both kinds the
    weights are PRIOR, as for an empty table.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            xs, ys = [], []
            for page in batch.column(0).to_pylist():
                x, y = certain_blocks(page)
                xs += x
                ys += y
            yield pa.RecordBatch.from_arrays([pa.array([np.array(xs, np.float32).tobytes()]), pa.array([np.array(ys, bool).tobytes()])], names=["x", "y"])

    n = pages.count()
    if not n:
        return PRIOR.copy()
    share = min(1.0, FIT_PAGES / n)
    page = pages.select(F.col(body).cast("string").alias("h")).where("h IS NOT NULL").withColumn("order", F.xxhash64("h"))
    # a hash below a bound first, so that few pages are sorted; then exactly those of least hash
    drawn = F.pmod("order", F.lit(1 << 30)) < int(min(1.0, 2 * share) * (1 << 30))
    sample = page.where(drawn).orderBy(F.pmod("order", F.lit(1 << 30)), "h").limit(FIT_PAGES).select("h")
    rows = sample.transform(batchwise(run, "x binary, y binary")).collect()
    x = np.concatenate([np.zeros((0, len(FEATURES))), *(np.frombuffer(r["x"], np.float32).reshape(-1, len(FEATURES)) for r in rows)])
    y = np.concatenate([np.zeros(0, bool), *(np.frombuffer(r["y"], bool) for r in rows)])
    order = np.lexsort((*x.T, y))  # sums alike whatever order the rows come in
    return regress(x[order], y[order])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", body: str = "html", weights: np.ndarray | None = None) -> DataFrame:
    """Rows (key, url, text, n_chars), one for each row; '' and 0 if there is no content or the body is null or empty.

    weights: of the block classifier; fitted on the pages themselves unless given. Keys and urls may be
    null or repeat: each row is extracted on its own, and equal bodies have equal texts. A block whose
    two sides of the cut cost the same is boilerplate. A very long page is parsed in one pass, by
    itself. An empty table gives no rows. Other columns are ignored.
    """
    learned = fit(pages, key, body) if weights is None else weights

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                texts = [main_text(h or "", learned) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["k", "u", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    rows = spread(pages.select(F.col(key).alias("k"), F.col(url).cast("string").alias("u"), F.col(body).cast("string").alias("h")))
    return rows.transform(batchwise(run, f"k {kind}, u string, text string, n_chars bigint")).withColumnsRenamed({"k": key, "u": url})
