"""Quality classifier: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What a text is measured by. None knows the row's id, language, source or label.
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "commonest_word", "repeats_previous", "upper", "digits",
    "pipes", "shouts", "symbols", "commas", "spaces", "blank_breaks", "line_length", "repeated_lines", "single_word_lines", "longest_word",
    "odd_endings", "stops", "worst_line", "odd_lines",
)
_SYMBOLS = tuple(b"#$%&*+<=>@\\^_`{}~[]/")


def features(text: str | None) -> list[float]:
    """One number per name in ``FEATURES``, over the whole text. Null counts as empty."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    byte = np.bincount(raw, minlength=256)
    words = text.split()
    m = max(1, len(words))
    counts = Counter(words)
    lines = text.split("\n")
    k = len(lines)
    symbols = int(byte[list(_SYMBOLS)].sum())
    repeats = sum(map(str.__eq__, words[1:], words[:-1]))
    plain = sum(map(str.isalpha, words))
    odd = 0.0
    worst = 0.0
    for line in lines:
        own = line.split()
        if len(own) >= 5:
            alike = 1 - len(set(own)) / len(own)
            marks = sum(map(line.count, "|!$%&*#")) / len(own)
            bad = max(alike * (len(own) >= 20), marks, 1.0 * (line.isupper()))
            worst = max(worst, min(1.0, bad))
            odd += (bad > 0.6) * len(own)
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / m, len(counts) / m, max(counts.values(), default=0) / m, repeats / m,
        byte[65:91].sum() / n, byte[48:58].sum() / n, byte[124] / m, byte[33] / m, symbols / m, byte[44] / m, byte[32] / n, sum(not x.strip() for x in lines) / k,
        len(text) / k, 1 - len(set(lines)) / k, sum(" " not in x.strip() for x in lines) / k, max(map(len, words), default=0),
        1 - plain / m, byte[46] / m, worst, odd / m,
    ]


@dataclass
class Gam:
    """Score = sigmoid(base + one table look-up per feature + one per pair). Bins are cut at ``edges``."""

    names: tuple[str, ...]
    edges: list[np.ndarray]
    base: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Vectorised: one addition per feature and pair for all rows at once."""
        total = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for p in self.pairs for j in p}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-total))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _shallow_tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """A tree over the ordered bins of one feature: the best split, then the best within its parts, up to ``leaves``; the value per bin."""
    cuts, gsum, hsum = [0, len(grad)], np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    worth = lambda i, j: (gsum[j] - gsum[i]) ** 2 / (hsum[j] - hsum[i] + ridge)
    for _ in range(leaves - 1):
        best, where = 1e-9, None
        for lo, hi in zip(cuts, cuts[1:]):
            if hi - lo > 1:
                at = np.arange(lo + 1, hi)
                gain = worth(lo, at) + worth(at, hi) - worth(lo, hi)
                if gain.max() > best:
                    best, where = gain.max(), int(at[gain.argmax()])
        if where is None:
            break
        cuts = sorted([*cuts, where])
    out = np.zeros(len(grad))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (gsum[hi] - gsum[lo]) / (hsum[hi] - hsum[lo] + ridge)
    return out


def _pair_tree(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """A cross of one cut on each feature of a pair, four leaves: the value per cell and the gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (grad, hess))
    rows, cols = grad.shape
    best, table = 0.0, np.zeros_like(grad)
    for i in range(1, rows):
        for j in range(1, cols):
            parts = [(slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))]
            gs = np.array([g[i, j], g[i, -1] - g[i, j], g[-1, j] - g[i, j], g[-1, -1] - g[i, -1] - g[-1, j] + g[i, j]])
            hs = np.array([h[i, j], h[i, -1] - h[i, j], h[-1, j] - h[i, j], h[-1, -1] - h[i, -1] - h[-1, j] + h[i, j]])
            gain = float((gs**2 / (hs + ridge)).sum())
            if gain > best:
                best, table = gain, np.zeros_like(grad)
                for part, value in zip(parts, gs / (hs + ridge)):
                    table[part] = value
    return table, best - float(grad.sum() ** 2 / (hess.sum() + ridge))


def fit(x: np.ndarray, y: np.ndarray, names=FEATURES, rounds: int = 150, pair_rounds: int = 30, n_pairs: int = 6, bins: int = 32, pair_bins: int = 8, rate: float = 0.1, leaves: int = 3, ridge: float = 5.0) -> Gam:
    """Cyclic boosting: each round visits every feature in turn and adds one shallow tree over its bins to its table;
    then the ``n_pairs`` pairs that explain most of what is left are boosted the same way. One class only: a constant score."""
    rate_of_ones = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    edges = [_cuts(x[:, j], bins) if len(x) else np.zeros(0) for j in range(len(names))]
    coarse_edges = [_cuts(x[:, j], pair_bins) if len(x) else np.zeros(0) for j in range(len(names))]
    model = Gam(tuple(names), edges, float(np.log(rate_of_ones / (1 - rate_of_ones))), [np.zeros(len(e) + 1) for e in edges], pair_edges=coarse_edges)
    if len(x) == 0 or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse_edges)]
    logit = np.full(len(y), model.base)
    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            p = 1 / (1 + np.exp(-logit))
            n = len(table)
            step = rate * _shallow_tree(np.bincount(binned[j], y - p, n), np.bincount(binned[j], p * (1 - p), n), leaves, ridge)
            table += step
            logit += step[binned[j]]

    def cells(a, b):
        shape = (len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)
        p = 1 / (1 + np.exp(-logit))
        at = coarse[a] * shape[1] + coarse[b]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_pair_tree(*cells(a, b)[1:], ridge)[1], a, b) for a in range(len(names)) for b in range(a)), reverse=True)
    model.pairs = [(a, b) for _, a, b in gains[:n_pairs]]
    model.pair_tables = [np.zeros((len(coarse_edges[a]) + 1, len(coarse_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for (a, b), table in zip(model.pairs, model.pair_tables):
            at, g, h = cells(a, b)
            step = rate * _pair_tree(g, h, ridge)[0]
            table += step
            logit += step.ravel()[at]
    return model


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _measure(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            values = [features(x) for x in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.list_(pa.float64()))], names=["y", "x"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> Gam:
    """Fit on at most ``max_rows`` labelled rows that are not held out, those of the smallest hash of the id; the model's tables are
    of fixed size. Labels that are null or neither 0 nor 1, and those without a document, are not used; of repeated
    labels of an id the mean decides (0.5 counts as 1); of rows that repeat an id the least text counts. No usable label: every text scores one half."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).where("id is not null")
    one = texts.join(F.broadcast(sample), "id").groupBy("id").agg(F.first("y").alias("y"), F.min("body").alias("body"))  # a row per label, however often an id repeats
    rows = one.select("y", "body").mapInArrow(_measure, "y double, x array<double>")
    found = sorted((r.y, *r.x) for r in rows.toLocalIterator())
    table = np.array(found, float).reshape(len(found), 1 + len(FEATURES))
    return fit(table[:, 1:], table[:, 0])


def score(docs: DataFrame, model: Gam, text_col: str = "text", score_col: str = "score", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (default: all of ``docs`` but any that the result replaces) with ``score_col`` (0 to 1) and ``predicted`` (score >= threshold).

    The model (a few kB) goes to every executor; each text is measured whole and scored by table look-ups, batch
    by batch. Null and empty texts are scored too. An empty table gives an empty table.
    """
    kept = docs.select(*[f"`{c}`" for c in keep or docs.columns]).drop(score_col, "predicted")
    names = [f"c{i}" for i in range(len(kept.columns))]
    rows = docs.select(F.col(f"`{text_col}`").alias("body"), *[F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, names)])
    schema = T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, kept.schema)), T.StructField("s", T.DoubleType())])

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                x = np.array([features(t) for t in part.column(0).to_pylist()], float)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(model.score(x))], names=[*names, "s"])

    out = rows.mapInArrow(run, schema)
    renamed = [F.col(n).alias(c) for n, c in zip(names, kept.columns)]
    return out.select(*renamed, F.col("s").alias(score_col), (F.col("s") >= threshold).cast("int").alias("predicted"))
