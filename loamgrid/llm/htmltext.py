"""Main text of web pages, from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each block is described by its own
and its neighbours' numbers of words and link densities, and by whether it
stands in an element that is marked as an article or as something else. A
small decision tree, trained here on the table LABELLED, says which blocks
belong to the main text.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgrid.llm.common import table

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "article")

#: Examples: words, link density, then the same of the block before and after, in other matter, in an article; main text or not.
LABELLED = (
    # menus and link lists
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0), (2, 1.0, 1, 1.0, 40, 0.0, 1, 0, 0),
    (1, 1.0, 0, 0.0, 1, 1.0, 0, 0, 0), (2, 1.0, 1, 1.0, 2, 1.0, 0, 0, 0), (3, 1.0, 2, 1.0, 60, 0.0, 0, 0, 0),
    (6, 0.9, 5, 1.0, 7, 0.8, 0, 0, 0), (25, 0.8, 3, 1.0, 20, 0.9, 0, 0, 0), (40, 0.7, 30, 0.9, 12, 1.0, 0, 0, 0),
    # page headers, footers, notices and adverts
    (4, 0.0, 0, 0.0, 1, 1.0, 1, 0, 0), (12, 0.1, 80, 0.0, 0, 0.0, 1, 0, 0), (30, 0.0, 2, 1.0, 10, 0.0, 1, 0, 0),
    (9, 0.0, 1, 1.0, 12, 0.0, 1, 0, 0), (60, 0.0, 45, 0.0, 30, 0.0, 1, 0, 0), (120, 0.0, 60, 0.0, 80, 0.1, 1, 0, 0),
    (5, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0), (4, 0.0, 2, 1.0, 3, 0.0, 0, 0, 0), (7, 0.2, 3, 0.0, 4, 1.0, 0, 0, 0),
    (3, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0), (8, 0.0, 6, 0.0, 5, 0.5, 0, 0, 0),
    # comments, sidebars and forms inside an article
    (20, 0.0, 50, 0.0, 25, 0.0, 1, 1, 0), (80, 0.0, 40, 0.0, 90, 0.0, 1, 1, 0), (3, 0.0, 30, 0.0, 15, 0.0, 1, 1, 0),
    (2, 1.0, 90, 0.0, 2, 1.0, 1, 1, 0), (6, 0.0, 100, 0.0, 40, 0.0, 1, 1, 0), (14, 0.5, 12, 0.0, 20, 0.0, 1, 1, 0),
    # link lists inside an article
    (2, 1.0, 3, 1.0, 2, 1.0, 0, 1, 0), (4, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0), (3, 1.0, 4, 1.0, 0, 0.0, 0, 1, 0),
    # headings and paragraphs of an article
    (7, 0.0, 1, 1.0, 50, 0.0, 0, 1, 1), (2, 0.0, 60, 0.0, 80, 0.0, 0, 1, 1), (1, 0.0, 40, 0.0, 40, 0.0, 0, 1, 1),
    (9, 0.0, 9, 0.0, 30, 0.0, 0, 1, 1), (50, 0.0, 9, 0.0, 70, 0.0, 0, 1, 1), (120, 0.1, 60, 0.0, 40, 0.2, 0, 1, 1),
    (1, 0.0, 30, 0.0, 2, 1.0, 0, 1, 1), (4, 0.0, 60, 0.0, 3, 1.0, 0, 1, 1), (8, 0.0, 20, 0.0, 1, 1.0, 0, 1, 1), (15, 0.1, 45, 0.0, 2, 0.9, 0, 1, 1),
    (3, 0.0, 2, 0.0, 4, 0.0, 0, 1, 1), (25, 0.3, 40, 0.0, 3, 0.0, 0, 1, 1), (6, 0.5, 50, 0.0, 45, 0.0, 0, 1, 1),
    (4, 1.0, 60, 0.0, 55, 0.0, 0, 1, 1), (300, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (5, 0.0, 12, 0.0, 9, 0.1, 0, 1, 1),
    (2, 0.0, 1, 0.0, 0, 0.0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 1, 1), (10, 0.4, 20, 0.1, 30, 0.1, 0, 1, 1),
    # the same where no element is marked as an article
    (50, 0.0, 9, 0.0, 70, 0.0, 0, 0, 1), (120, 0.1, 60, 0.0, 40, 0.2, 0, 0, 1), (300, 0.0, 2, 1.0, 3, 1.0, 0, 0, 1),
    (30, 0.1, 3, 1.0, 45, 0.0, 0, 0, 1), (22, 0.0, 80, 0.0, 25, 0.1, 0, 0, 1), (18, 0.0, 30, 0.0, 2, 0.0, 0, 0, 1),
    (8, 0.0, 60, 0.0, 70, 0.0, 0, 0, 1), (6, 0.0, 45, 0.0, 50, 0.1, 0, 0, 1), (9, 0.1, 40, 0.0, 90, 0.0, 0, 0, 1),
    (3, 0.0, 50, 0.0, 60, 0.0, 0, 0, 1), (45, 0.2, 6, 0.0, 5, 1.0, 0, 0, 1),
)

#: Element names.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noframes ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("button datalist head iframe noscript option script select style svg template textarea title".split())
FOREIGN = frozenset("math svg".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
ASIDE = frozenset("nav footer aside form menu dialog".split())
ARTICLE = frozenset("article main".split())
CLOSED_BY_NEXT = frozenset("p li dt dd td th tr option".split())
#: Parts of class, id and role names that mark other matter or an article.
ASIDE_NAMES = frozenset(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination popup promo promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar topbar widget".split()
)
ARTICLE_NAMES = frozenset("article articlebody content entry main maincontent post story".split())
#: Beginnings of names that say what a page's layout has, not what an element is; words after which a name says so.
LAYOUT = frozenset("has is layout no page with without".split())
WITH = frozenset("has no with without".split())
#: Names of what readers add, which is never a page's frame, however long.
READERS = frozenset("comment comments commentlist disqus replies reply respond".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+'|[\"'])*+)(?:>|\Z|(?=<))", re.S)
NAMED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
PART = re.compile(r"[a-z]+")


def named_parts(value: str) -> list[str]:
    """The words of class names, but for those that say what a layout has."""
    parts: list[str] = []
    for x in value.split():
        words = PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", x).lower())
        if len(words) == 1 or words and words[0] not in LAYOUT:
            parts += words[: next((k for k, w in enumerate(words) if k and w in WITH), len(words))]
    return parts


def marks(name: str, attributes: str) -> tuple[bool, bool, bool, bool]:
    """Whether an element holds other matter, whether it holds an article, whether it is a header of either, and whether it may be a page's frame.

    Names of headings are where links lead to, and say nothing.
    """
    aside, article, header, frame = name in ASIDE, name in ARTICLE, name == "header", name not in ASIDE
    for key, a, b, c in NAMED.findall(attributes) if "=" in attributes else ():
        value = (a or b or c).lower()
        if key.lower() in ("style", "aria-hidden", "hidden"):
            squeezed = value.replace(" ", "")
            hidden = "display:none" in squeezed or "visibility:hidden" in squeezed or (key.lower() == "aria-hidden" and value == "true")
            aside, frame = aside or hidden, frame and not hidden
        elif name not in ("html", "body") and name not in HEADINGS:
            parts = named_parts(a or b or c)
            aside |= not ASIDE_NAMES.isdisjoint(parts)
            article |= not ARTICLE_NAMES.isdisjoint(parts)
            header |= "header" in parts
            frame &= READERS.isdisjoint(parts)
    return aside, article and not aside, header, frame


def blocks(page: str | None) -> list[tuple[str, int, int, bool, bool]]:
    """Flat blocks of text: text, words, words in links, in other matter, in an article.

    An element that is named as other matter but has more than half of the
    page's words is the page's frame, and not other matter, if it holds an
    article, or if no text outside of other matter is in one. What is named so
    within a frame stays other matter.
    """
    found: list = []
    if not page:
        return found
    texts: list[tuple[str, bool]] = []
    stack: list[tuple[str, int, bool, bool]] = []  # name, innermost element of other matter or -1, article, dropped
    open_names: dict[str, int] = {}
    state = (-1, False, False)
    link = -1  # elements that are open around the open link
    outer_of: list[int] = []  # of each element of other matter, the one around it
    framing: list[bool] = []  # whether it holds an article
    may_frame: list[bool] = []

    def flush() -> None:
        if texts:
            text = " ".join(html.unescape("".join(t for t, _ in texts)).split())
            if text:
                linked = sum(len(t.split()) for t, in_link in texts if in_link)
                found.append((text, text.count(" ") + 1, linked, state[0], state[1]))
            texts.clear()

    def pop_to(k: int) -> None:
        for name, *_ in stack[k:]:
            open_names[name] -= 1
        del stack[k:]

    at, n = 0, len(page)
    while at < n:
        start = page.find("<", at)
        tag = TAG.match(page, start) if start >= 0 else None
        if start < 0 or tag is None:
            end = n if start < 0 else start + 1
            if not state[2]:
                texts.append((page[at:end], link >= 0))
            at = end
            continue
        if start > at and not state[2]:
            texts.append((page[at:start], link >= 0))
        at = max(tag.end(), start + 1)
        name = tag[2].lower() if tag[2] else ""
        if not name:
            continue
        if name == "br" or name in VOID and name not in BLOCKS:
            texts.append((" ", False))
            continue
        if name == "a":
            link = -1 if tag[1] else len(stack)
        if name in BLOCKS:
            flush()
        if tag[1]:
            if open_names.get(name):
                k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
                flush()
                pop_to(k)
        elif name not in VOID and not (name in FOREIGN and tag[3].endswith("/")):
            if name in RAW:
                close = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = close.end() if close else n
                continue
            if name in CLOSED_BY_NEXT and stack and stack[-1][0] == name:
                pop_to(len(stack) - 1)
            aside, article, header, frame = marks(name, tag[3])
            aside |= header and not (stack and stack[-1][2])
            if name in BLOCKS or aside or name in DROPPED:
                if aside:
                    flush()
                over = stack[-1] if stack else ("", -1, False, False)
                outer = over[1]
                if outer >= 0 and article:
                    framing[outer] = True
                if aside:
                    outer_of.append(outer)
                    framing.append(False)
                    may_frame.append(frame)
                    outer = len(outer_of) - 1
                stack.append((name, outer, over[2] or article, over[3] or name in DROPPED))
                open_names[name] = open_names.get(name, 0) + 1
        if link > len(stack):
            link = -1
        state = stack[-1][1:] if stack else (-1, False, False)
    flush()
    held = [0] * len(outer_of)
    for _, words, _, outer, _ in found:
        if outer >= 0:
            held[outer] += words
    for k in range(len(outer_of) - 1, -1, -1):  # inner ones come after those around them
        if outer_of[k] >= 0:
            held[outer_of[k]] += held[k]
            framing[outer_of[k]] |= framing[k]
    total, plain = sum(b[1] for b in found), not any(outer < 0 and article for *_, outer, article in found)
    other: list[bool] = []
    for k, outer in enumerate(outer_of):
        frame = 2 * held[k] > total and (framing[k] or plain and may_frame[k])
        other.append(outer >= 0 and other[outer] or not frame)
    return [(text, words, linked, outer >= 0 and other[outer], article) for text, words, linked, outer, article in found]


def block_features(found: list) -> np.ndarray:
    words = np.array([b[1] for b in found], float)
    density = np.array([min(1.0, b[2] / b[1]) for b in found])
    before = lambda x: np.concatenate([[0.0], x[:-1]])
    after = lambda x: np.concatenate([x[1:], [0.0]])
    return np.stack([words, density, before(words), before(density), after(words), after(density), [float(b[3]) for b in found], [float(b[4]) for b in found]], 1)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6) -> tuple:
    """A binary tree (feature, bound, left, right) or a leaf (label,), by Gini impurity; ties go to the first feature and bound."""
    if depth == 0 or len(set(y)) < 2:
        return (int(y.mean() >= 0.5),)
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= bound
            cost = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or cost < best[0] - 1e-12:
                best = (cost, f, float(bound), left)
    if best is None:
        return (int(y.mean() >= 0.5),)
    _, f, bound, left = best
    return f, bound, grow(x[left], y[left], depth - 1), grow(x[~left], y[~left], depth - 1)


def train_tree(rows: tuple = LABELLED) -> tuple:
    data = np.array(rows, float)
    return grow(data[:, :-1], data[:, -1])


def decide(tree: tuple, x: np.ndarray) -> int:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def main_text(page: str | None, tree: tuple) -> str:
    found = blocks(page)
    if not found:
        return ""
    x = block_features(found)
    return " ".join(b[0] for b, row in zip(found, x, strict=True) if decide(tree, row))


def main_text_of(page: Column) -> Column:
    """The main text of a column of pages; empty where there is none."""
    tree = train_tree()

    def run(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p.as_py(), tree) for p in pages], pa.string())

    return F.arrow_udf(run, "string")(page)


def extract_text(pages: DataFrame) -> DataFrame:
    """Adds ``main_text`` to all columns of ``pages``.

    A null or empty page has the empty text. Unclosed elements, comments and
    tags end with the page. Repeated rows stay; an empty table gives an empty
    result.
    """
    return pages.withColumn("main_text", main_text_of(F.col("html")))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_text(pages).withColumnRenamed("main_text", "text")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
