"""Main text of web pages by minimum-cut labelling of their text blocks.

A page becomes a row of text blocks, each with the elements around it. A
classifier gives each block log odds for content, the capacity of its edge to
one of the two terminals. Neighbouring blocks, and blocks that follow each
other in the same parent, are tied by smoothness edges. The minimum cut between
the terminals, found by maximum flow, is the labelling of least total cost.

The classifier is a logistic regression on what the text is like, on the role
that the elements' names state (article, nav, an advert's class, ...) and on
the names themselves. It is trained on the pages: blocks with a stated role are
its examples, each with its role, without it, and without names at all, so that
it also learns which names that no list has go with either sort of block, and
what blocks without names look like.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import frugal
from .words import texts_of

#: Pages whose blocks train the classifier, at most, chosen by a hash of page_id; and kinds of blocks of these, at most.
SAMPLE, KINDS = 500, 20_000
#: Names with a weight of their own, at most, and innermost names that a block counts as around it.
NAMES, AROUND = 512, 8
#: Capacities between neighbouring blocks, and between successive blocks of one parent.
ADJACENT, SIBLING = 0.5, 1.0
#: What the weights are drawn to, and are without examples of both sorts: link share, log words, sentence marks, paragraph, heading, list item, bias; then roles: content, and boilerplate from LOOSE to OTHER.
DEFAULT = np.array([-6.0, 0.9, 1.0, 1.0, 0.5, -0.5, -2.0, 6.0, -9.0, -9.0, -9.0, -9.0])
PLAIN = 7

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"|<(script|style|title|textarea|noscript|template|iframe|xmp|noembed|noframes)\b(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*+|[^>]*)>"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: A tag that is cut off; another "<" is text.
_UNFINISHED = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_BLOCK = frozenset(
    "address article aside blockquote body button caption center datalist dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main math menu nav object ol optgroup option p pre search section select summary svg table tbody td tfoot th thead tr ul head".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
_OTHER_TAGS = frozenset("nav footer aside menu dialog head search".split())
#: Elements that show no text of the article: controls, drawings, and what stands in for an embedded object.
_UNSHOWN = frozenset("button datalist math object optgroup option select svg".split())
_OTHER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_OTHER_NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|footer|foot|header|topbar|masthead|sidebar|side|aside|ads?|advert|adverts|advertisement|advertising|adsense|banner|promo|promotion|sponsor|sponsored|cookie|cookies|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|related|recommended|recommendations|more|comment|comments|disqus|reply|replies|respond|breadcrumb|breadcrumbs|pagination|pager|widget|toolbar|copyright|legal|search|form|tags|byline-links|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Names of an element that has a sidebar and the like, rather than of the sidebar.
_AROUND = re.compile(r"^(?:has|with|without|no|is|tag|category)[_-]|(?:wrap|wrapper|container|layout|page|grid)$|(?:^|[_-])(?:content|main)[_-]|[_-](?:content|main)(?:$|[_-])", re.I)
#: Names of the head of an article.
_TITLED = re.compile(r"^(?:article|content|post|entry|story)[_-]{1,2}header$", re.I)
#: Names of lists that may hold articles of their own.
_LISTS = re.compile(r"(?:^|[_-])(?:related|recommended|recommendations|more|comments?|disqus|reply|replies|respond|promo|promotion|sponsor|sponsored|ads?|adverts?|advertisement|advertising)(?:$|[_-])", re.I)
#: Boilerplate, from what gives way to an article inside to what never does.
LOOSE, FIRM, LISTED, OTHER, HIDDEN = -1, -2, -3, -4, -5
ARTICLE, MAIN = 2, 3
_CONTENT_NAMES = re.compile(r"(?:^|[\s_-])(?:article|content|post|entry|story|main|body|text|prose|maintext)(?:$|[\s_-])", re.I)
_SPACES = re.compile(r"\s+")
_ENDS = re.compile(r"[.!?…。](?:\s|$)")


class Block:
    """Text between two borders of blocks, with what is known of its surroundings."""

    __slots__ = ("text", "linked", "tag", "parent", "role", "names")

    def __init__(self, text, linked, tag, parent, role, names):
        self.text, self.linked, self.tag, self.parent, self.role, self.names = text, linked, tag, parent, role, names


def _own(tag: str, attributes: str, names: list[str]) -> int:
    """What an element is by its own tag and attributes: one of the levels below, 0, 1 (named for content), ARTICLE or MAIN. Its classes and id are added to ``names``."""
    if tag in _UNSHOWN:
        return HIDDEN
    own = MAIN if tag == "main" else ARTICLE if tag == "article" else OTHER if tag in _OTHER_TAGS else LOOSE if tag == "form" else 0
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return HIDDEN
        if name == "role":
            value = value.lower()
            if value in _OTHER_ROLES:
                own = min(own, LOOSE if value == "form" else OTHER)
            elif value in ("main", "article") and own >= 0:
                own = max(own, MAIN if value == "main" else ARTICLE)
        elif name in ("class", "id") and tag not in ("body", "html"):
            for token in value.split():
                names.append(token.lower())
                if _OTHER_NAMES.search(token) and not _TITLED.search(token):
                    level = LOOSE if _AROUND.search(token) else LISTED if _LISTS.search(token) else FIRM
                    # what an article or main is named besides, as in has-sidebar, doesn't count
                    own = own if own == MAIN or own == ARTICLE and level == LOOSE else min(own, level)
                elif own == 0 and _CONTENT_NAMES.search(token):
                    own = 1
    return own


def _role(tag: str, own: int, inherited: int, wrapper: bool) -> int:
    """1 in an element named for content, below 0 for boilerplate, 0 in neither. Boilerplate within content counts, and main within boilerplate unless hidden."""
    if HIDDEN in (own, inherited):
        return HIDDEN
    if own == MAIN:
        return 1
    if inherited < 0 or wrapper:
        return inherited
    if own < 0 or tag == "header" and inherited == 0:
        return own or OTHER
    return 1 if own else inherited


def blocks_of(html: str) -> list[Block]:
    """The page's text blocks in order; comments, scripts, styles and other text that isn't shown are left out.

    A form, or an element named for boilerplate, that contains the main part
    of the page is no boilerplate: with a name like has-sidebar if any article
    or main is inside, with a name like sidebar if what is inside outweighs
    the content elsewhere, with one like comments if there is none elsewhere.
    """
    blocks, around = _parsed(html, frozenset())
    wrappers: frozenset[int] = frozenset()
    for level in (LOOSE, FIRM, LISTED):
        if around[level]:
            trial, _ = _parsed(html, wrappers | around[level])
            before, after = (sum(len(b.text) for b in x if b.role > 0) for x in (blocks, trial))
            if level == LOOSE or after > 2 * before and (level == FIRM or not before):
                blocks, wrappers = trial, wrappers | around[level]
    return blocks


def _parsed(html: str, wrappers: frozenset[int]) -> tuple[list[Block], dict[int, set[int]]]:
    """Blocks, where elements of the numbers in ``wrappers`` aren't boilerplate; and by level the boilerplate elements around articles and main."""
    stack: list[tuple[str, int, int, int, tuple[str, ...], bool]] = []  # tag, number, role, own, names, whether within an element that shows no text
    around: dict[int, set[int]] = {LOOSE: set(), FIRM: set(), LISTED: set()}
    out: list[Block] = []
    parts: list[str] = []
    linked, in_link, number, at = 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = _SPACES.sub(" ", unescape("".join(parts))).strip()
            top = len(stack)
            while top and stack[top - 1][5]:
                top -= 1
            tag, parent, role, _, names, _ = stack[top - 1] if top else ("", -1, 0, 0, (), False)
            if text and role != HIDDEN:
                up = stack[top - 2][1] if top > 1 else -1
                out.append(Block(text, min(linked, len(text)), tag, up if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "dt", "dd", "td") else parent, role, names))
            parts.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            if not (stack and stack[-1][5]):
                piece = html[at : m.start()]
                parts.append(piece)
                if in_link:
                    linked += len(piece)
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "a":
            in_link = 0 if m[2] else 1
            continue
        if tag not in _BLOCK:
            if tag == "br" or tag == "wbr":
                parts.append(" " if tag == "br" else "")
            continue
        if tag not in _UNSHOWN:  # these stand within a line
            flush()
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    in_link = 0
                    break
        elif tag not in _VOID and not (tag in ("svg", "math") and m[4].rstrip().endswith("/")):
            if stack and stack[-1][0] == "p" and tag not in _UNSHOWN:
                stack.pop()
            while tag in _CLOSES and stack and stack[-1][0] in _CLOSES[tag]:
                stack.pop()
            number += 1
            around_it: list[str] = list(stack[-1][4]) if stack else []
            own, inherited = _own(tag, m[4], around_it), stack[-1][2] if stack else 0
            if tag == "article" and own in around and inherited != HIDDEN:
                # one named like what may hold articles of its own is taken for one if it outweighs the rest like these
                around[own].update({number, *(n for _, n, _, o, *_ in stack if o < 0)})
                own = ARTICLE if number in wrappers else own
            if own >= ARTICLE and inherited != HIDDEN:
                outer = [(o, n) for _, n, _, o, *_ in stack if o < 0]
                worst = min(outer, default=(0, 0))[0]
                if own == MAIN:
                    around[LOOSE].update(n for o, n in outer if o > OTHER)
                elif worst in around:
                    around[worst].update(n for _, n in outer)
            names = tuple(dict.fromkeys(around_it))[-AROUND:]
            stack.append((tag, number, _role(tag, own, inherited, number in wrappers and own < ARTICLE), OTHER if tag == "header" and inherited <= 0 and own >= 0 else own, names, tag in _UNSHOWN or bool(stack) and stack[-1][5]))
    if at < len(html) and not (stack and stack[-1][5]):
        unfinished = _UNFINISHED.search(html, at)
        parts.append(html[at : unfinished.start()] if unfinished else html[at:])
    flush()
    return out, around


def features(blocks: list[Block], named: bool = True) -> np.ndarray:
    """What is known of each block: link share, log words, sentences, paragraph, heading, list item, 1; then which role it has, if ``named``."""
    rows = np.zeros((len(blocks), len(DEFAULT)))
    for i, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        rows[i, :PLAIN] = (b.linked / len(b.text), np.log(words), min(len(_ENDS.findall(b.text)), 3), b.tag in ("p", "blockquote", "pre"), b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag in ("li", "td", "th", "dt", "dd"), 1)
        if named and b.role:
            rows[i, PLAIN if b.role > 0 else PLAIN - b.role] = 1
    return rows


class Classifier:
    """Weights of the features and of names; ``odds`` gives each block's log odds for content."""

    def __init__(self, weights: np.ndarray = DEFAULT, names: dict[str, float] | None = None):
        self.weights, self.names = weights, names or {}

    def odds(self, blocks: list[Block]) -> np.ndarray:
        return features(blocks) @ self.weights + np.array([sum(self.names.get(n, 0.0) for n in b.names) for b in blocks])


def minimum_cut(odds: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """True for the nodes on the content side of a minimum cut.

    ``odds`` above zero are capacities from the content terminal, below zero
    to the other; ``edges`` join nodes both ways. A node whose terminal
    outweighs all its edges keeps that side in some minimum cut; such nodes
    are settled first. The others have the block before and after them and the
    one before and after them in their parent as neighbours. As such edges
    never cross, all can be replaced one by one in linear time; what crossing
    edges leave goes through augmenting paths.
    """
    n = len(odds)
    odds = np.asarray(odds, dtype=float).tolist()
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, w in edges:
        if i != j and w > 0:
            near[i][j] = near[i].get(j, 0.0) + w
            near[j][i] = near[j].get(i, 0.0) + w
    side: list[bool | None] = [None] * n
    front = deque(range(n))
    while front:
        i = front.popleft()
        if side[i] is None and abs(odds[i]) >= sum(near[i].values()):
            side[i] = odds[i] > 0
            for j, w in near[i].items():
                odds[j] += w if side[i] else -w
                del near[j][i]
                front.append(j)
            near[i] = {}
    # a node with two neighbours at most is replaced by the capacities between these and to the terminals that let the same flow through
    replaced: list[tuple[int, float, list[tuple[int, float]]]] = []
    front = deque(i for i in range(n) if side[i] is None)
    gone = [x is not None for x in side]
    while front:
        i = front.popleft()
        if gone[i] or len(near[i]) > 2:
            continue
        gone[i] = True
        ends = list(near[i].items())
        replaced.append((i, odds[i], ends))
        # least cost of the node for each labelling of its ends
        cost = {}
        for a in (0, 1):
            for b in (0, 1):
                apart = sum(w for (_, w), x in zip(ends, (a, b)) if x == 0)
                cost[a, b] = min(sum(w for (_, w), x in zip(ends, (a, b)) if x == 1), apart - odds[i])
        for j, _ in ends:
            del near[j][i]
            front.append(j)
        tie = 0.0
        if len(ends) == 2:
            (a, _), (b, _) = ends
            tie = max(0.0, (cost[0, 1] + cost[1, 0] - cost[0, 0] - cost[1, 1]) / 2)
            if tie > 0:
                near[a][b] = near[a].get(b, 0.0) + tie
                near[b][a] = near[b].get(a, 0.0) + tie
            odds[b] -= cost[0, 1] - cost[0, 0] - tie
        if ends:
            odds[ends[0][0]] -= cost[1, 0] - cost[0, 0] - tie
    rest = [i for i in range(n) if not gone[i]]
    if rest:
        source, sink = n, n + 1
        room: dict[int, dict[int, float]] = {i: dict(near[i]) for i in rest} | {source: {}, sink: {}}
        for i in rest:
            a, b = (source, i) if odds[i] > 0 else (i, sink)
            room[a][b] = abs(odds[i])
            room[b][a] = 0.0
        while True:
            before: dict[int, int] = {source: source}
            front = deque([source])
            while front and sink not in before:
                i = front.popleft()
                for j, w in room[i].items():
                    if w > 1e-12 and j not in before:
                        before[j] = i
                        front.append(j)
            if sink not in before:
                break
            path, j = [], sink
            while j != source:
                path.append((before[j], j))
                j = before[j]
            flow = min(room[i][j] for i, j in path)
            for i, j in path:
                room[i][j] -= flow
                room[j][i] = room[j].get(i, 0.0) + flow
        for i in rest:
            side[i] = i in before
    for i, own, ends in reversed(replaced):
        side[i] = own > sum(w if not side[j] else -w for j, w in ends)
    return np.array(side, dtype=bool)


def labelled(blocks: list[Block], classifier: Classifier) -> np.ndarray:
    """Which blocks the minimum cut takes for content."""
    edges, last = [], {}
    for i, b in enumerate(blocks):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if b.parent in last:
            edges.append((last[b.parent], i, SIBLING))
        last[b.parent] = i
    return minimum_cut(classifier.odds(blocks), edges)


def main_text(html: str, classifier: Classifier | None = None) -> str:
    """The blocks labelled as content, in page order, joined by an empty line."""
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n\n".join(b.text for b, keep in zip(blocks, labelled(blocks, classifier or Classifier())) if keep)


def _weights(x: np.ndarray, y: np.ndarray, towards: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps, towards given weights; classes weigh the same."""
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) * min(1.0, 2000 / len(y))
    w = towards.copy()

    def loss(w):
        z = x @ w
        return weight @ (np.logaddexp(0, z) - y * z) + 0.5 * (w - towards) @ (w - towards)

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + (w - towards)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(len(w)), grad)
        now, rate = loss(w), 1.0
        while loss(w - rate * step) > now - 1e-4 * rate * (grad @ step) and rate > 1e-6:
            rate /= 2
        w = w - rate * step
        if np.abs(rate * step).max() < 1e-6:
            break
    return w


def _training_rows(batches):
    for _, texts in texts_of(batches, "html"):
        rows, ys, names = [], [], []
        for t in texts:
            blocks = [b for b in blocks_of(t.decode("utf-8", "replace")) if b.role]
            rows += features(blocks).tolist()
            ys += [int(b.role > 0) for b in blocks]
            names += [list(b.names) for b in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), pa.array(ys, pa.int32()), pa.array(names, pa.list_(pa.string()))], names=["x", "y", "names"])


def train(pages: DataFrame) -> Classifier:
    """The classifier from at most SAMPLE pages and KINDS kinds of blocks of these."""
    picked = pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLE)
    rows = pages.select("page_id", "html").join(F.broadcast(picked), "page_id").mapInArrow(_training_rows, "x array<double>, y int, names array<string>")
    # repeated vectors, as menus have them, are counted rather than collected
    found = rows.groupBy("x", "y", "names").agg(F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64("x", "y", "names"), "x", "y", "names").limit(KINDS).collect()
    return fitted([(list(r.x), r.y, list(r.names), r.n) for r in found])


def fitted(examples: list[tuple[list[float], int, list[str], int]]) -> Classifier:
    """From (features, whether content, names, how many) of blocks with a stated role: each as it is, without the role, and without names too."""
    y = np.array([e[1] for e in examples], dtype=int)
    if not len(y) or y.min() == y.max():
        return Classifier()
    counts: dict[str, int] = {}
    for _, _, names, n in examples:
        for name in names:
            counts[name] = counts.get(name, 0) + n
    index = {name: k for k, name in enumerate(sorted(counts, key=lambda x: (-counts[x], x))[:NAMES])}
    x = np.zeros((3 * len(y), len(DEFAULT) + len(index)))
    for i, (row, _, names, _) in enumerate(examples):
        x[i, : len(DEFAULT)] = row
        x[i, [len(DEFAULT) + index[name] for name in names if name in index]] = 1
        x[len(y) + i] = x[i]
        x[len(y) + i, PLAIN : len(DEFAULT)] = 0
        x[2 * len(y) + i, :PLAIN] = row[:PLAIN]
    n = np.tile([e[3] for e in examples], 3)
    few = np.minimum(n, 50)  # a menu's line that stands on every page doesn't outvote the rest
    w = _weights(np.repeat(x, few, axis=0), np.repeat(np.tile(y, 3), few), np.append(DEFAULT, np.zeros(len(index))))
    return Classifier(w[: len(DEFAULT)], {name: float(w[len(DEFAULT) + k]) for name, k in index.items()})


def extracted(pages: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html).

    A null or empty page, and one without content, has an empty text. Pages
    are independent of each other, repeated ones give equal results, and an
    empty table gives an empty result. Markup that is cut off or badly nested
    is read as far as it goes. Very long pages are read whole, in time that
    grows with their length. Scripts, styles, form controls, drawings and what
    stands in for embedded objects are never text.
    """
    classifier = train(pages) if classifier is None else classifier

    def run(batches):
        for rows, texts in texts_of(batches, "html"):
            out = [main_text(t.decode("utf-8", "replace"), classifier) for t in texts]
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return frugal(pages).select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
