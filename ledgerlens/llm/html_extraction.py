"""Main text of web pages by a tree-structured graphical model.

Every block element of a page's tree is a node with two states, article or
other. A node's own evidence is a logistic model over its tag, the words of its
class, id and role, its share of linked text, its length and, for lists, the
blocks before and after; parents and
children are joined by potentials, the ratio P(child | parent) / P(child).
Sum-product messages go from the leaves up and from the root down, and give each
node's exact marginal; the text that stands directly in a node whose marginal is
above one half is kept. Both parts are fitted on labelled pages
(``html_pages``, a bounded and seeded number of them).

A block's text is its runs of text between child blocks, inline elements and
character references resolved, white space turned into one space; blocks are
joined in page order by one space. Formulas and drawings are inline. Scripts, styles,
comments, head, form controls, what stands in for media, and the sources and
descriptions of formulas and drawings are seen by no reader and are not nodes.

Defined cases: a null or empty page has no text (""); text outside any tag
belongs to the page's root; unclosed and stray tags follow the nesting they
have; unknown references stay as they are; repeated rows are extracted each; an
empty table gives an empty table; columns other than page_id, url and html are
ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .html_pages import labelled_pages
from .runtime import importable, table

#: Labelled pages that the model is fitted on.
FIT_PAGES = 1200
OUT_SCHEMA = "page_id long, url string, text string, n_chars long"

# Fixed values of the markup language: elements by how they nest and show.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Formulas and drawings: their visible text stands in the line.
INLINE |= frozenset("math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup "
                    "munder mover munderover mmultiscripts mprescripts none mtable mtr mtd mlabeledtr semantics "
                    "svg g text tspan textpath switch foreignobject map".split())
HIDDEN = frozenset("script style head title noscript template iframe object audio video canvas select datalist textarea button "
                   "annotation annotation-xml defs desc metadata".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: A start tag of the key's kind ends an open element of these, unless a container stands between.
ENDS_PARAGRAPH = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form "
                           "h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
CONTAINERS = frozenset("html body article aside div section main nav header footer form table ul ol dl td th blockquote "
                       "figure fieldset details dialog".split())

LISTS = ("ul", "ol")

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|data-l)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
NAME_WORD = re.compile(r"[a-z]+")


@dataclass
class Node:
    tag: str
    parent: int
    names: tuple[str, ...] = ()
    label: int | None = None
    texts: list[tuple[int, str]] = field(default_factory=list)
    own: int = 0
    linked: int = 0


def parse(page: str) -> list[Node]:
    """Block elements in page order, the root first; each with the runs of text directly in it."""
    nodes = [Node("#root", -1, label=1)]
    stack: list[tuple[str, int]] = [("#root", 0)]
    run: list[str] = []
    order = [0]
    links = 0

    def flush() -> None:
        if run:
            text = " ".join(references.unescape("".join(run)).split())
            run.clear()
            if text:
                node = nodes[stack[-1][1]]
                node.texts.append((order[0], text))
                order[0] += 1

    def say(text: str) -> None:
        if text:
            node = nodes[stack[-1][1]]
            size = len(text.strip())
            node.own += size
            if links:
                node.linked += size
            run.append(text)

    def close(to: int) -> None:
        nonlocal links
        if any(nodes_at != stack[to - 1][1] for _, nodes_at in stack[to:]):
            flush()
        links -= sum(tag == "a" for tag, _ in stack[to:])
        del stack[to:]

    at, end = 0, len(page)
    while at < end:
        match = TAG.search(page, at)
        if match is None:
            say(page[at:])
            break
        say(page[at:match.start()])
        at = match.end()
        name = match["name"]
        if name is None:
            continue
        name = name.lower()
        if match["end"]:
            if name == "p" or name in INLINE:
                places = []
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] == name:
                        places.append(k)
                        break
                    if stack[k][0] in CONTAINERS or (name in INLINE and stack[k][0] not in INLINE):
                        break
            else:
                places = [k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name][:1]
            if places:
                close(places[0])
            continue
        if name in RAW:
            shut = re.compile(rf"</{re.escape(name)}[^>]*(?:>|\Z)", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if name in HIDDEN:
            at = _past(page, at, name)
            continue
        if name == "br":
            run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        if name in INLINE:
            if not match["rest"].endswith("/"):
                if name == "a":
                    links += 1
                stack.append((name, stack[-1][1]))
                continue
            continue
        for ended in (("p",) if name in ENDS_PARAGRAPH else ()), ENDS.get(name, ()):
            while ended:
                place = 0
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in ended:
                        place = k
                        break
                    if stack[k][0] in CONTAINERS and stack[k][0] not in ended:
                        break
                if not place:
                    break
                close(place)
        # inline elements left open (an unclosed <b>) end with the block that held them
        flush()
        names, label = [], None
        for attribute in ATTRIBUTE.finditer(match["rest"]):
            value = attribute[2] or attribute[3] or attribute[4] or ""
            if attribute[1].lower() == "data-l":
                label = int(value == "1")
            else:
                names += NAME_WORD.findall(value.lower())
        nodes.append(Node(name, stack[-1][1], tuple(names), label))
        if not match["rest"].endswith("/"):
            stack.append((name, len(nodes) - 1))
    flush()
    return nodes


def _past(page: str, at: int, name: str) -> int:
    """Where an element that no reader sees ends: its own end tag, nested ones counted."""
    depth = 1
    for tag in re.compile(rf"<(/?){name}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if tag[1] else not tag[0].endswith("/>")
        if depth == 0:
            return tag.end()
    if name == "head" and (body := re.compile(r"<body\b", re.I).search(page, at)):
        return body.start()
    return at


def features(nodes: list[Node]) -> list[list[str]]:
    """Evidence of each node by name; text counts include everything below the node."""
    size = [n.own for n in nodes]
    linked = [n.linked for n in nodes]
    for k in range(len(nodes) - 1, 0, -1):
        size[nodes[k].parent] += size[k]
        linked[nodes[k].parent] += linked[k]
    before, after, last = [""] * len(nodes), [""] * len(nodes), {}
    for k, n in enumerate(nodes):  # the blocks beside each node
        if n.parent in last:
            before[k], after[last[n.parent]] = nodes[last[n.parent]].tag, n.tag
        last[n.parent] = k
    out = []
    for k, n in enumerate(nodes):
        share = linked[k] / size[k] if size[k] else 0.0
        found = ["bias", f"tag {n.tag}", f"links {min(3, int(share * 4))}", f"size {min(5, int(math.log2(size[k] + 1) / 2))}"]
        found += [f"name {w}" for w in dict.fromkeys(n.names)]
        # a list, and each of its items, by the blocks that the list stands between
        place = k if n.tag in LISTS else n.parent if k and nodes[n.parent].tag in LISTS else 0
        if before[place] and after[place] and not nodes[place].names:
            found.append(f"{'list' if place == k else 'item'} between {before[place]} and {after[place]}")
        out.append(found)
    return out


def fit(n_pages: int = FIT_PAGES, steps: int = 12, ridge: float = 0.01) -> dict:
    """Logistic weights of the evidence and the log potentials of parent and child."""
    rows, labels, pairs = [], [], np.ones((2, 2))
    for page in labelled_pages(n_pages):
        nodes = parse(page)
        for k, (node, found) in enumerate(zip(nodes, features(nodes))):
            if node.label is not None:
                rows.append(found)
                labels.append(node.label)
                if k and nodes[node.parent].label is not None:
                    pairs[nodes[node.parent].label, node.label] += 1
    index = {f: i for i, f in enumerate(sorted({f for row in rows for f in row}))}
    x = np.zeros((len(rows), len(index)))
    for i, row in enumerate(rows):
        x[i, [index[f] for f in row]] = 1
    y, w = np.array(labels, float), np.zeros(len(index))
    for _ in range(steps):  # Newton steps; the ridge keeps weights of separating names finite
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
    given = pairs / pairs.sum(1, keepdims=True)
    share = np.bincount(np.array(labels), minlength=2) / len(labels)
    return {"weights": dict(zip(index, w.tolist())), "pair": np.log(given / share).tolist()}


def marginals(parents: list[int], own: list[float], pair: list[list[float]]) -> list[float]:
    """P(article) of each node: ``own`` is its log odds, ``pair[a][b]`` the log potential
    of a parent in state a and a child in state b. Parents stand before their children."""
    n = len(parents)
    up = [[0.0, o] for o in own]
    sent = [(0.0, 0.0)] * n
    (p00, p01), (p10, p11) = pair
    for k in range(n - 1, 0, -1):
        u0, u1 = up[k]
        m0, m1 = _logsum(p00 + u0, p01 + u1), _logsum(p10 + u0, p11 + u1)
        sent[k] = m0, m1
        above = up[parents[k]]
        above[0] += m0
        above[1] += m1
    belief: list[tuple[float, float]] = [(up[0][0], up[0][1])] * n
    for k in range(1, n):
        b0, b1 = belief[parents[k]]
        b0, b1 = b0 - sent[k][0], b1 - sent[k][1]
        top = max(b0, b1)
        b0, b1 = b0 - top, b1 - top
        belief[k] = (up[k][0] + _logsum(p00 + b0, p10 + b1), up[k][1] + _logsum(p01 + b0, p11 + b1))
    return [1 / (1 + math.exp(max(-700.0, min(700.0, b0 - b1)))) for b0, b1 in belief]


def _logsum(a: float, b: float) -> float:
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def extract(page: str, model: dict) -> str:
    nodes = parse(page)
    weights = model["weights"]
    own = [sum(weights.get(f, 0.0) for f in found) for found in features(nodes)]
    chance = marginals([n.parent for n in nodes], own, model["pair"])
    kept = sorted(run for node, p in zip(nodes, chance) if p > 0.5 for run in node.texts)
    return " ".join(text for _, text in kept)


def _extracted(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(page, model) if page else "" for page in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return run


def main_text(pages: DataFrame, model: dict | None = None) -> DataFrame:
    importable(pages.sparkSession)
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
            .mapInArrow(_extracted(model or fit()), OUT_SCHEMA))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
