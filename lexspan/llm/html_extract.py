"""Main text of web pages by the maximum-scoring subsequence of words and tags.

A page is a sequence of words and tags. Tags score negative. A word scores by where it stands: the sum
of the weights of the elements around it, of their names and of their classes, ids, roles and labels.
All weights are fitted to labelled pages, those whose article or main element says where the text is;
weights that these pages say nothing about stay at the prior ones below. A prior weight holds for a
whole name of a known form, known words and words of layout alone: "site-footer", but not
"navigation-at-sea"; beside other classes it is weak, so that the text in and around an element decides.
What an element that holds nearly all words of a page is called says nothing against them.

An element whose words sum up to less than nothing is boilerplate (a menu, sidebar, notice, advert,
reader comments, ...) and counts as nothing, from the innermost elements outwards. One
linear scan over what is left finds the contiguous region with the highest sum; the blocks that it
touches are the text. Where nothing scores above zero, names say too much about the page (a class
"search" around all of it): the scan is repeated without the words of class, id, role and label.
Scripts, styles, form controls and hidden elements hold no text, whatever their score.

Text: character references are decoded; white space in a block, also a br, is one space; blocks are
trimmed and joined by a line end, in page order. Nothing else is dropped or cut.

Cases: null and empty pages, and pages without words, give an empty text; unclosed tags end with what
holds them, unclosed raw text and comments with the page; a quote only opens a value behind an equals
sign; very long and very deep pages take time in proportion to their length; repeated rows give equal
texts; rows of a null page_id are kept; an empty table gives an empty result; other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Container, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled pages that weights are fitted to, about, and how long these may be, in characters; both bound the driver.
FIT_ROWS, FIT_CHARS = 1_000, 100_000
#: All labelled words together weigh as much as up to so many words against the prior's one, half of it with so many pages.
EVIDENCE, EVIDENCE_PAGES = 100.0, 50
#: The range of a tag's score.
TAG_SCORES = (-0.5, -0.1)

#: Kinds of HTML elements.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup"
    " time tt u var wbr".split())
NO_TEXT = set("script style title head select option textarea iframe object svg canvas template button datalist audio video map noembed noframes noscript".split())
LABELS = {"article", "main"}
#: Elements that end when another of their kind begins, and by what else.
CLOSED_BY = {
    "p": None, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"},
    "option": {"option"}}
#: Elements that stand within a line of text, though what is in them is no text.
WITHIN_TEXT = set("button select input textarea label output meter progress svg canvas object audio video iframe picture script style noscript template datalist map".split())
#: What can't be closed from inside by an element of the ones above.
SCOPES = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th"}}

#: Prior weights: of any word, of words in an element of a name, and in one whose class, id, role or label has a word.
BIAS = 1.0
PRIOR_TAGS = {
    "nav": -9.0, "footer": -9.0, "aside": -9.0, "form": -9.0, "menu": -9.0, "dialog": -9.0, "header": -2.5, "label": -3.0, "a": -1.0, "address": -1.0,
    "p": 1.5, "h1": 0.5, "h2": 0.5, "h3": 0.5, "blockquote": 1.0, "pre": 1.0, "article": 1.0, "main": 1.0}
PRIOR_NAMES = {
    -9.0: "ad ads adbox advert adverts advertisement adv banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr"
          " masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promotion respond share sharing sidebar"
          " signup social sponsor sponsored subscribe subscription toolbar contentinfo",
    -4.0: "alert aside complementary copyright discussion header legal login overlay recommended replies reply search searchbox side skip tags taglist widget",
    -2.0: "related",
    0.5: "article body content entry main post story text",
}
#: Words of layout, which may stand beside known ones in a name.
LAYOUT = set(
    "site page main top bottom left right primary secondary global block box area section container wrapper wrap list item items inner outer bar links link form button"
    " buttons icon icons slot unit row col column columns grid wide narrow sticky fixed mobile desktop small large first last block default".split())
#: The least that a known word says beside words that aren't known.
DOUBTFUL = -3.0
#: By how much that counts within an article or main element.
WITHIN_LABEL = 0.4
#: Names of classes and ids that are fitted, at most: those on most labelled pages, two at least.
FITTED_NAMES = 500
#: The share of a page's words from which an element around them is just a wrapper.
WRAPS = 0.95
#: Where a page has an article or main element, what stands outside all of these.
OUTSIDE, PRIOR_OUTSIDE = "(outside)", -9.0

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.S)
NAME_WORD = re.compile(r"[a-z]+")
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
WORD = re.compile(r"\S+")

#: What is known of where a word stands: elements around it, their names and known words with a dot before, doubtful ones with a question mark.
Context = frozenset
KNOWN = {w for words in PRIOR_NAMES.values() for w in words.split()}


@dataclass
class Node:
    tag: str
    parent: int
    context: Context
    silent: bool
    says: tuple[str, ...] = ()
    pruned: bool = False


@dataclass
class Page:
    """Tokens of a page (text or None, tag or None, node that it stands in), its elements, and whether one is labelled."""

    tokens: list[tuple[str | None, str | None, int]] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=lambda: [Node("", -1, Context(), False)])
    labelled: bool = False


def _named(names: list[str]) -> Iterator[str]:
    """What the names of an element say: each as a whole, and its known words if it is of a known form."""
    found, sure = [], True
    for name in names:
        parts = NAME_WORD.findall(HUMP.sub("-", name).lower())
        if "-".join(parts) not in KNOWN:
            yield "." + "-".join(parts)
        own = [w for w in parts if w in KNOWN]
        formed = all(w in KNOWN or w in LAYOUT for w in parts)
        found += own if formed else []
        sure = sure and formed
    yield from ((("." if sure else "?") + w) for w in found)


def _about(tag: str, attributes: str) -> tuple[Iterable[str], bool]:
    """What an element's start says of the words in it, and whether it is hidden."""
    says = [tag] if tag not in ("html", "body") else []
    if not attributes.strip(" /"):
        return says, False
    found = {}
    for k, v in ATTRIBUTE.findall(attributes):
        found.setdefault(k.lower(), v.strip("\"'"))
    if tag not in ("html", "body"):
        names = [found.get("class", "").split(), *([found[k].replace(" ", "-")] for k in ("id", "role", "aria-label") if found.get(k))]
        says += dict.fromkeys(x for own in names for x in _named(own) if len(x) > 1)
    style = re.sub(r"\s", "", found.get("style", "").lower())
    return says, "hidden" in found or "display:none" in style or "visibility:hidden" in style


def parse(html: str, known: Container[str] | None = None) -> Page:
    """known: all that a context needs to say of a word's place."""
    page = Page()
    nodes, tokens = page.nodes, page.tokens
    stack, n_open, at, n = [0], Counter(), 0, len(html)

    def pop() -> None:
        n_open[nodes[stack.pop()].tag] -= 1

    while at < n:
        m = TOKEN.search(html, at)
        upto = m.start() if m else n
        if upto > at:
            tokens.append((html[at:upto], None, stack[-1]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3]
        if m[1]:
            if n_open[tag]:
                while nodes[stack[-1]].tag != tag:
                    pop()
                pop()
            tokens.append((None, "/" + tag, stack[-1]))
            continue
        if tag not in INLINE and tag not in WITHIN_TEXT:  # a block ends unclosed inline elements around it
            while nodes[stack[-1]].tag in INLINE:
                pop()
        ends = CLOSED_BY.get(nodes[stack[-1]].tag, ())
        while ends is None and tag not in INLINE and tag not in WITHIN_TEXT and tag not in VOID or ends and tag in ends:
            pop()
            ends = CLOSED_BY.get(nodes[stack[-1]].tag, ())
        around = nodes[stack[-1]]
        says, hidden = _about(tag, attributes)
        says = [x for x in says if known is None or x in known]
        context = around.context if around.context.issuperset(says) else around.context.union(says)
        tokens.append((None, tag, stack[-1]))
        page.labelled |= tag in LABELS
        if tag in VOID:
            continue
        nodes.append(Node(tag, stack[-1], context, around.silent or hidden or tag in NO_TEXT, tuple(says)))
        stack.append(len(nodes) - 1)
        n_open[tag] += 1
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(html, at)
            tokens.append((html[at : end.start()], None, stack[-1]))
            at = end.start()
        elif attributes.endswith("/") and tag in ("svg", "path"):
            pop()
    return page


def prior() -> dict[str, float]:
    names = [(w, x) for x, words in PRIOR_NAMES.items() for w in words.split()]
    return {**PRIOR_TAGS, **{"." + w: x for w, x in names}, **{"?" + w: max(x, DOUBTFUL) for w, x in names}, OUTSIDE: PRIOR_OUTSIDE}


def unwrap(page: Page, weights: Weights) -> None:
    """Take back what elements say against the words of a page if they hold nearly all of them, or most and its labelled element."""
    nodes = page.nodes
    words, labels = [0] * len(nodes), [x.tag in LABELS for x in nodes]
    for text, tag, node in page.tokens:
        words[node] += 0 if tag or nodes[node].silent else len(WORD.findall(text))
    for k in range(len(nodes) - 1, 0, -1):
        words[nodes[k].parent] += words[k]
        labels[nodes[k].parent] |= labels[k]
    against = lambda x: [s for s in x.says if weights.words.get(s, 0.0) < 0]
    wraps = [
        k > 0 and words[k] > 0 and nodes[k].tag not in LABELS and bool(against(nodes[k]))
        and (words[k] >= WRAPS * words[0] or labels[k] and 2 * words[k] >= words[0]) for k in range(len(nodes))]
    if any(wraps):
        for k in range(1, len(nodes)):
            x = nodes[k]
            own = set(x.says) - set(against(x)) if wraps[k] else x.says
            x.context = nodes[x.parent].context.union(own)


@dataclass
class Weights:
    """words: of what is known of a word's place; tags: scores of tags by name (other: of any other)."""

    bias: float = BIAS
    words: dict[str, float] = field(default_factory=prior)
    tags: dict[str, float] = field(default_factory=dict)
    other: float = -0.3

    def word(self, context: Context, outside: bool, named: bool = True) -> float:
        within = not context.isdisjoint(LABELS)  # there the label outweighs what is doubtful
        total = sum(self.words.get(x, 0.0) * (WITHIN_LABEL if within and x[0] == "?" else 1.0) for x in context if named or x[0] not in ".?")
        return self.bias + total + outside * self.words.get(OUTSIDE, 0.0)


def learn(pages: Iterable[str]) -> Weights:
    """The most likely weights, given the prior ones, of a logistic model of whether a word is in a labelled element."""
    parsed = [page for page in map(parse, pages) if page.labelled]
    weights = Weights()
    on = Counter(x for page in parsed for x in {s for node in page.nodes for s in node.says if s[0] == "."})
    often = sorted((x for x in on if on[x] > 1 and x not in weights.words), key=lambda x: (-on[x], x))[:FITTED_NAMES]
    fitted = {s for page in parsed for node in page.nodes for s in node.says if s[0] not in ".?"} | set(weights.words) | set(often)
    inside, outside = Counter(), Counter()
    tags_in, tags_out, m = Counter(), Counter(), len(parsed)
    for page in parsed:
        for text, tag, node in page.tokens:
            context = page.nodes[node].context
            held = not context.isdisjoint(LABELS)
            if tag:
                if tag.lstrip("/") not in LABELS:
                    (tags_in if held else tags_out)[tag] += 1
            elif not page.nodes[node].silent:
                # What the label itself is made of says nothing new, and keeps its prior weight.
                (inside if held else outside)[(context - LABELS) & fitted] += len(WORD.findall(text))
    n = sum(inside.values()) + sum(outside.values())
    if not n:
        return weights
    contexts = sorted((inside | outside).keys(), key=sorted)
    names = sorted(set().union(*contexts))
    x = np.array([[1.0, *(k in c for k in names)] for c in contexts])
    yes, no = (np.array([t[c] for c in contexts]) * EVIDENCE * m / (m + EVIDENCE_PAGES) / n for t in (inside, outside))
    start = np.array([weights.bias, *(weights.words.get(k, 0.0) for k in names)])
    w = start.copy()
    for _ in range(50):  # Newton's method with step halving; convex, and well conditioned by the prior
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve(np.eye(len(w)) + (x.T * ((yes + no) * p * (1 - p))) @ x, x.T @ (yes - (yes + no) * p) - (w - start))
        if abs(step).max() < 1e-9:
            break
        w = w + step * min(1.0, 2.0 / abs(step).max())
    weights.bias = float(w[0])
    weights.words |= dict(zip(names, w[1:].tolist(), strict=True))
    lo, hi = TAG_SCORES
    n_in, n_out = sum(tags_in.values()), sum(tags_out.values())
    for t in tags_in | tags_out:
        odds = math.log((tags_in[t] + 1) / (n_in + 2)) - math.log((tags_out[t] + 1) / (n_out + 2))
        weights.tags[t] = lo + (hi - lo) / (1 + math.exp(-odds))
    return weights


def scored(page: Page, weights: Weights, named: bool = True) -> list[float]:
    """The score of each token, 0 in elements that hold no text or sum up to less than nothing; these are marked."""
    nodes, known = page.nodes, {}

    def word(context: Context) -> float:
        if context not in known:
            known[context] = weights.word(context, page.labelled and LABELS.isdisjoint(context), named)
        return known[context]

    scores, sums, words = [], [0.0] * len(nodes), [0] * len(nodes)
    for text, tag, node in page.tokens:
        if nodes[node].silent:
            scores.append(0.0)
            continue
        n = 0 if tag else len(WORD.findall(text))
        scores.append(weights.tags.get(tag, weights.other) if tag else n * word(nodes[node].context) if n else 0.0)
        sums[node] += scores[-1] if n else 0.0
        words[node] += n
    for k in range(len(nodes) - 1, 0, -1):  # children come behind their parents
        x = nodes[k]
        x.pruned = x.silent or x.tag not in INLINE and x.tag not in ("html", "body") and words[k] > 0 and sums[k] < 0
        if not x.pruned:
            sums[x.parent] += sums[k]
            words[x.parent] += words[k]
    for x in nodes[1:]:
        x.pruned = x.pruned or nodes[x.parent].pruned
    return [0.0 if nodes[node].pruned else s for s, (*_, node) in zip(scores, page.tokens, strict=True)]


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and end of the contiguous run with the highest sum, the first and shortest such; empty where none is positive."""
    best, found, total, start = 0.0, (0, 0), 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, found = total, (start, i + 1)
    return found


def _is_break(token: tuple) -> bool:
    return token[1] is not None and token[1].lstrip("/") not in INLINE and token[1].lstrip("/") not in WITHIN_TEXT


def extract(html: str | None, weights: Weights) -> str:
    """The main text of a page."""
    page = parse(html or "", weights.words)
    unwrap(page, weights)
    first, end = best_region(scored(page, weights))
    if first == end:
        first, end = best_region(scored(page, weights, named=False))
    if first == end:
        return ""
    tokens = page.tokens
    while first > 0 and not _is_break(tokens[first - 1]):  # whole blocks
        first -= 1
    while end < len(tokens) and not _is_break(tokens[end]):
        end += 1
    blocks: list[list[str]] = [[]]
    for token in tokens[first:end]:
        text, tag, node = token
        if _is_break(token):
            blocks.append([])
        elif tag:
            blocks[-1].append(" " if tag == "br" else "")
        elif not page.nodes[node].pruned:
            blocks[-1].append(text)
    joined = (" ".join(entities.unescape("".join(b)).split()) for b in blocks)
    return "\n".join(b for b in joined if b)


def train(pages: DataFrame, rows: int = FIT_ROWS) -> Weights:
    """Weights from about `rows` of the pages of bounded length that have an article or main element."""
    known = pages.where(F.lower("html").rlike("<(article|main)[ >]") & (F.length("html") <= FIT_CHARS))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(1_000_000)) < int(1e6 * rows / n))
    return learn(sorted(r.html for r in known.select("html").collect()))


#: Rows of an Arrow batch that are turned into Python objects together.
SLICE = 500


def _extracted(weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            texts = [extract(h, weights.value) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return run


def extract_pages(pages: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """page_id, url, text, n_chars; a row for each page."""
    weights = pages.sparkSession.sparkContext.broadcast(train(pages, rows))
    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(_extracted(weights), "page_id long, url string, text string, n_chars long")
