"""Main text of web pages: a linear-chain conditional random field over the blocks of a page."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .page_blocks import Block, Element, Elements, leaf_blocks
from .page_layouts import labelled_pages

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_NAME = re.compile(r"[^\W\d_]+")
_SIZES, _SHARES = np.array([2, 4, 7, 13, 26, 51]), np.array([1e-9, 0.25, 0.5, 0.9])
MARKS = "©®|›»•·@%$€*#=<>{}_/\\"


def element_features(element: Element) -> frozenset[str]:
    """Of an element and all that it lies in: their tags, and the words of their names with their first four letters; the nearest names count again. Worked out once for each place in a page."""
    chain = []
    while element.known is None and element.parent is not None:
        chain.append(element)
        element = element.parent
    known = element.known or (frozenset(), frozenset())
    for e in reversed(chain):
        words = _NAME.findall(_CAMEL.sub(" ", e.names).lower())
        names = frozenset(x for w in words for x in (f"w:{w}", f"x:{w[:4]}"))
        near = frozenset(x for w in words for x in (f"n:{w}", f"y:{w[:4]}")) or known[1]
        known = e.known = (known[0] | names | {f"t:{e.tag}"}, near)
    return known[0] | known[1]


def text_features(text: str, linked: float, tag: str) -> tuple[list[str], str]:
    """Of a block's own text: its size, links, punctuation, case and marks; the words of short ones. The second value is what its neighbours are told."""
    words = text.split(" ")
    n, share = int(np.searchsorted(_SIZES, len(words), "right")), int(np.searchsorted(_SHARES, linked, "right"))
    last, first = text[-1], text[0]
    end = "." if last in ".!?…" else "," if last in ",;:" else "a" if last.isalnum() else "o"
    begin = "U" if first.isupper() else "l" if first.islower() else "d" if first.isdigit() else "o"
    out = [f"size:{n}", f"link:{share}", f"end:{end}", f"begin:{begin}", f"size:{n}link:{share}", f"size:{n}end:{end}", f"tag:{tag}", f"size:{n}tag:{tag}", f"tag:{tag}link:{share}"]
    out += [f"mark:{m}" for m in MARKS if m in text]
    if text.isupper():
        out.append("upper")
    if sum(map(str.isdigit, text)) * 3 > len(text):
        out.append("digits")
    if len(words) <= 16:
        out += {f"u:{w}" for w in _NAME.findall(text.lower())}
    return out, f"{min(n, 4)}{min(share, 2)}"


def page_features(blocks: list[Block]) -> tuple[list[tuple[list[str], frozenset[str]]], list[int]]:
    """For each block its own features and its elements'; and for each step whether the next block lies in the same element or in one beside it of the same names (2), beside it or within it under other names (1), or elsewhere (0)."""
    own = [text_features(b.text, b.linked, b.element.tag) for b in blocks]
    out, steps, heading, k = [], [], "before", len(blocks)
    for i, (b, (features, _)) in enumerate(zip(blocks, own)):
        heading = "at" if b.element.tag == "h1" else "after" if heading != "before" else heading
        around = [f"h1:{heading}", f"head:{min(i, 4)}", f"foot:{min(k - 1 - i, 4)}", "back:" + (own[i - 1][1] if i else "-"), "next:" + (own[i + 1][1] if i + 1 < k else "-")]
        out.append((features + around, element_features(b.element)))
        if i:
            a, z = blocks[i - 1].element, b.element
            beside = a.parent is z.parent
            steps.append(2 if a is z or beside and a.names == z.names else 1 if beside or a.parent is z or z.parent is a else 0)
    return out, steps


@dataclass
class Crf:
    """``weights`` of features for "main" against "other"; ``turns[s, a, b]`` of a step of kind s from label a to b; ``base`` of any block."""

    weights: dict[str, float]
    turns: np.ndarray
    base: float

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi: the labels of all blocks that are likeliest together."""
        if not blocks:
            return []
        features, steps = page_features(blocks)
        get = self.weights.get
        best, back = [0.0, 0.0], []
        for i, (own, around) in enumerate(features):
            score = self.base + sum(get(f, 0.0) for f in own) + sum(get(f, 0.0) for f in around)
            if i:
                t = self.turns[steps[i - 1]]
                from_0 = best[0] + t[0][0] >= best[1] + t[1][0], best[0] + t[0][1] >= best[1] + t[1][1]
                back.append((0 if from_0[0] else 1, 0 if from_0[1] else 1))
                best = [max(best[0] + t[0][0], best[1] + t[1][0]), max(best[0] + t[0][1], best[1] + t[1][1])]
            best = [best[0], best[1] + score]
        at = int(best[1] > best[0])
        labels = [at == 1]
        for came in reversed(back):
            at = came[at]
            labels.append(at == 1)
        return labels[::-1]


def fit(pages: list[str], rounds: int = 120, rate: float = 0.2, ridge: float = 0.3, rare: int = 3) -> Crf:
    """Learn from pages whose elements say ``data-label`` ("main" or another word): the likelihood of all labels of a page together, by forward and backward sums over all
    pages at once, climbed with Adam. Features of fewer than ``rare`` pages are left out. The pages are a bounded set that the caller gives."""
    elements = Elements()
    read = [leaf_blocks(p, elements) for p in pages]
    read = [b for b in read if b]
    if not read:
        return Crf({}, np.zeros((3, 2, 2)), -1.0)
    found = [page_features(b) for b in read]
    seen = Counter(f for features, _ in found for f in {x for own, around in features for x in (*own, *around)})
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= rare))}
    ids, bounds = [], [0]
    for features, _ in found:
        for own, around in features:
            ids += [index[f] for f in (*own, *around) if f in index]
            bounds.append(len(ids))
    ids, sizes = np.array(ids), np.diff(bounds)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    y = np.array([b.element.label == "main" for blocks in read for b in blocks], int)
    pages_n, longest = len(read), max(map(len, read))
    row = np.repeat(np.arange(pages_n), [len(b) for b in read])
    col = np.concatenate([np.arange(len(b)) for b in read])
    step = np.zeros((pages_n, longest), int)
    alive = np.zeros((pages_n, longest), bool)
    alive[row, col] = True
    for p, (_, steps) in enumerate(found):
        step[p, 1 : len(steps) + 1] = steps
    gold = np.zeros((pages_n, longest), int)
    gold[row, col] = y
    both = alive[:, 1:] & alive[:, :-1]
    true_turns = np.zeros((3, 2, 2))
    np.add.at(true_turns, (step[:, 1:][both], gold[:, :-1][both], gold[:, 1:][both]), 1)
    size = len(index) + 1 + 12
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    lse = lambda x, axis: np.logaddexp.reduce(x, axis=axis)
    for k in range(1, rounds + 1):
        turns = w[-12:].reshape(3, 2, 2)
        node = np.zeros((pages_n, longest, 2))
        node[row, col, 1] = np.bincount(owner, w[ids], len(sizes)) + w[len(index)]
        ahead, behind = np.zeros_like(node), np.zeros_like(node)
        ahead[:, 0] = node[:, 0]
        for t in range(1, longest):
            ahead[:, t] = np.where(alive[:, t, None], lse(ahead[:, t - 1, :, None] + turns[step[:, t]], 1) + node[:, t], ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            behind[:, t] = np.where(alive[:, t + 1, None], lse(turns[step[:, t + 1]] + (node[:, t + 1] + behind[:, t + 1])[:, None, :], 2), 0)
        total = lse(ahead[:, -1], 1)
        p = np.exp(ahead + behind - total[:, None, None])[row, col, 1]
        pair = np.exp(ahead[:, :-1, :, None] + turns[step[:, 1:]] + (node + behind)[:, 1:, None, :] - total[:, None, None, None])
        expected = np.zeros((3, 2, 2))
        np.add.at(expected, step[:, 1:][both], pair[both])
        grad = np.concatenate([np.bincount(ids, (y - p)[owner], len(index)), [(y - p).sum()], (true_turns - expected).ravel()]) - ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return Crf({f: float(w[i]) for f, i in index.items()}, w[-12:].reshape(3, 2, 2).copy(), float(w[len(index)]))


@lru_cache(maxsize=4)
def default_model(pages: int = 400) -> Crf:
    """The model of ``pages`` labelled pages in many layouts; learnt once in a process, as it depends on nothing else."""
    return fit(labelled_pages(pages))


def main_text(page: str | None, model: Crf, elements: Elements) -> str:
    blocks = leaf_blocks(page or "", elements)
    text = "\n\n".join(b.text for b, main in zip(blocks, model.decode(blocks)) if main)
    elements.trim()
    return text


def extract(pages: DataFrame, model: Crf, html_col: str = "html", keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` (default: all but those that the result replaces), ``text_col`` and ``n_chars``: the blocks that the model takes for the article, in the page's order, with two
    line feeds between them.

    Each page is read whole in one task, a few at a time, and nothing is shuffled; the model (a few thousand weights) goes with the task. A null or empty page, or one without a
    block of the article, has an empty text. Null and repeated ids keep their rows; an empty table gives an empty table.
    """
    kept = pages.select(*[f"`{c}`" for c in keep or pages.columns]).drop(text_col, "n_chars")
    names = [f"c{i}" for i in range(len(kept.columns))]
    rows = pages.select(F.col(f"`{html_col}`").alias("page"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names)])
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, kept.schema)), T.StructField("said", T.StringType())])

    def run(batches):
        elements = Elements()
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                texts = [main_text(p, model, elements) for p in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(texts, pa.string())], names=[*names, "said"])

    out = rows.mapInArrow(run, schema)
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, kept.columns)], F.col("said").alias(text_col), F.length("said").cast("long").alias("n_chars"))
