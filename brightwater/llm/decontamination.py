"""Benchmark decontamination: a BM25 inverted index of the test items, queried by every training passage."""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

WORDS = re.compile(r"\w+")
K1, B = 1.2, 0.75
#: Most bytes of one index as ``index_size`` reckons it; more items go through in several, so what is broadcast stays bounded.
INDEX_BYTES = 64 << 20
#: Bytes of an index, in a Python process, per word and per item: a posting with its key and impact, the word's number, its entry in the table of terms.
WORD_BYTES, ITEM_BYTES = 150, 500
ITEMS_IN_BLOCK = 8
#: Words that an item counts as having, at least, for the length of its windows; a power of two.
SHORTEST = 16


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def shingles(words: list, n: int) -> set[tuple]:
    """Runs of ``n`` words; fewer words: the one run of them all; none: none."""
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@dataclass
class Index:
    """Postings by term in order of the items, with impacts divided by the item's threshold: a passage reaches an item at 1."""

    term_of: dict[str, int]
    starts: np.ndarray  # of each term's postings
    items: np.ndarray
    impacts: np.ndarray
    key: np.ndarray  # of each posting: term and item in one number
    block_starts: np.ndarray  # of each term's blocks
    block_key: np.ndarray  # of each block: term and number of the block in one number
    block_max: np.ndarray
    term_max: np.ndarray
    ids: list
    words: list[np.ndarray]  # each item's words, as terms
    answers: list[np.ndarray]


def build_index(items: list[tuple], shingle: int, overlap: float, block: int = ITEMS_IN_BLOCK) -> Index:
    """items: (id, question, answer). An item's threshold is a score that every passage reaches which holds ``overlap`` of
    its shingles. A word is missing only if all runs over it are: one before a run that is there counts against the missing
    run that starts with it, one after it against the one that ends with it. So there are no more missing
    words than missing runs (twice as many if runs repeat), and the heaviest so many are taken to be missing."""
    texts = [(words_of(q), words_of(a)) for _, q, a in items]
    keep = [i for i, (q, a) in enumerate(texts) if q or a]
    items, answers, texts = [items[i] for i in keep], [texts[i][1] for i in keep], [texts[i][0] + texts[i][1] for i in keep]
    df = Counter(t for w in texts for t in set(w))
    terms = {t: i for i, t in enumerate(sorted(df))}
    mean = sum(map(len, texts)) / max(1, len(texts))
    entries: list[tuple[int, int, float]] = []
    for i, w in enumerate(texts):
        tf, size = Counter(w), len(w)
        score = {t: math.log(1 + (len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for t, n in tf.items()}
        own = len(shingles(w, shingle))
        may_miss = (own - math.ceil(overlap * own - 1e-9)) * (1 if own == max(1, size - shingle + 1) else 2)
        left = sorted(score.values())[: max(1, len(score) - may_miss)]
        least = sum(left) * (1 - 1e-9)
        entries += [(terms[t], i, s / least) for t, s in score.items()]
    entries.sort()
    term, item, impact = (np.array(x) for x in zip(*entries)) if entries else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    starts = np.searchsorted(term, np.arange(len(terms) + 1))
    block_key = term * (len(items) // block + 1) + item // block
    first = np.flatnonzero(np.diff(block_key, prepend=-1)) if len(term) else np.zeros(0, int)
    block_max = np.maximum.reduceat(impact, first) if len(first) else np.zeros(0)
    block_starts = np.searchsorted(term[first], np.arange(len(terms) + 1))
    term_max = np.maximum.reduceat(impact, starts[:-1]) if len(terms) else np.zeros(0)
    numbers = lambda w: np.array([terms[t] for t in w], np.int32)
    return Index(terms, starts, item, impact, term * len(items) + item, block_starts, block_key[first], block_max, term_max, [x[0] for x in items], [numbers(w) for w in texts], [numbers(w) for w in answers])


def _live(index: Index, passage: np.ndarray, term: np.ndarray, n_blocks: int, cells: int = 1 << 21) -> np.ndarray:
    """Which pairs belong to a passage with a block in which its terms' maxima add up to 1; ``cells``: passages times blocks at a time."""
    out = np.zeros(len(passage), bool)
    names, own = np.unique(passage, return_inverse=True)
    edges = np.searchsorted(own, np.arange(0, len(names) + 1, max(1, cells // n_blocks)))
    for lo, hi in zip(edges, np.append(edges[1:], len(own))):
        p, t = own[lo:hi] - (own[lo] if lo < hi else 0), term[lo:hi]
        n = index.block_starts[t + 1] - index.block_starts[t]
        entry = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n) + np.repeat(index.block_starts[t], n)
        cell = np.repeat(p, n) * n_blocks + index.block_key[entry] % n_blocks
        reach = np.bincount(cell, index.block_max[entry], (p.max(initial=-1) + 1) * n_blocks) >= 1 - 1e-12
        out[lo:hi] = reach.reshape(-1, n_blocks).any(1)[p]
    return out


def retrieve(index: Index, passage: np.ndarray, term: np.ndarray, block: int = ITEMS_IN_BLOCK) -> list[tuple[int, int, float]]:
    """All (passage, item, score) with a score of 1 or more, for distinct pairs of passage and term in order of the passages, by block-max WAND.

    Passages without a block in which their terms' block maxima add up to 1 stop at once. The others hold a cursor into the postings of each of
    their terms. In order of the items the cursors stand at, the first at which the lists' maxima add up to 1 is the pivot: no
    earlier item can reach 1. If the block maxima there don't add up to 1 either, the cursors skip to the end of the block (or to the next
    cursor's item); else those behind move up to the pivot, and once all stand there the item is scored. All passages of a
    batch take these steps together.
    """
    n_items, n_blocks, out = len(index.ids), len(index.ids) // block + 1, []
    if not len(passage) or not n_items:
        return out
    alive = np.bincount(passage, index.term_max[term])[passage] >= 1
    passage, term = passage[alive], term[alive]
    alive = _live(index, passage, term, n_blocks)
    p, t = passage[alive], term[alive]
    at, end = index.starts[t], index.starts[t + 1]
    while len(p):
        order = np.lexsort((index.items[at], p))
        p, t, at, end = p[order], t[order], at[order], end[order]
        item = index.items[at]
        first = np.flatnonzero(np.diff(p, prepend=-1))
        group = np.repeat(np.arange(len(first)), np.diff(first, append=len(p)))
        bound = np.cumsum(index.term_max[t])
        bound -= (bound[first] - index.term_max[t[first]])[group]
        reach = np.flatnonzero(bound >= 1 - 1e-12)
        has, where = np.unique(group[reach], return_index=True)  # the pivot of each passage that still has one
        pivot = np.full(len(first), -1)
        pivot[has] = item[reach[where]]
        pivot = pivot[group]
        upto = (pivot >= 0) & (item <= pivot)
        wanted = t * n_blocks + pivot // block
        k = np.minimum(np.searchsorted(index.block_key, wanted), len(index.block_key) - 1)
        here = np.bincount(group[upto], np.where(index.block_key[k] == wanted, index.block_max[k], 0)[upto], len(first)) >= 1 - 1e-12
        ready = (here & (item[first] == pivot[first]))[group]
        score = np.bincount(group[upto & ready], index.impacts[at[upto & ready]], len(first))
        good = np.flatnonzero(score >= 1)
        out += zip(p[first[good]].tolist(), pivot[first[good]].tolist(), score[good].tolist())
        beyond = np.full(len(first), n_items)
        np.minimum.at(beyond, group[~upto], item[~upto])
        skip = np.minimum((pivot // block + 1) * block, beyond[group])
        goal = np.where(ready, pivot + 1, np.where(here[group], pivot, skip))
        at = np.where(upto, np.maximum(at, np.searchsorted(index.key, t * n_items + goal)), at)
        left = (pivot >= 0) & (at < end)
        p, t, at, end = p[left], t[left], at[left], end[left]
    return out


def half_window(words: int) -> int:
    """Half the length of the windows in which an item of so many words is looked for: its length, rounded up to a power of two."""
    return max(SHORTEST, 1 << (words - 1).bit_length())


class Classes:
    """Items by the length of their windows, each class with an index of its own, and one table of words for all."""

    def __init__(self, items: list[tuple], shingle: int, overlap: float) -> None:
        by_half: dict[int, list[tuple]] = {}
        for i, q, a in items:
            if n := len(words_of(q)) + len(words_of(a)):
                by_half.setdefault(half_window(n), []).append((i, q, a))
        self.indexes = [(half, build_index(own, shingle, overlap)) for half, own in sorted(by_half.items())]
        self.word = {w: k for k, w in enumerate(sorted({w for _, x in self.indexes for w in x.term_of}))}
        self.local = []
        for _, index in self.indexes:
            known = np.full(len(self.word) + 1, -1)  # the last is for words that no item has
            known[[self.word[w] for w in index.term_of]] = list(index.term_of.values())
            self.local.append(known)
            index.term_of = {}

    def matches(self, words_by_doc: list[list[str]], shingle: int, overlap: float, answer_overlap: float) -> list[dict]:
        """Per document: item id -> (question-and-answer overlap, score) of the verified items."""
        get = self.word.get
        numbers = [np.fromiter((get(w, -1) for w in words), np.int64, len(words)) for words in words_by_doc]
        found: list[dict] = [{} for _ in words_by_doc]
        for (half, index), known in zip(self.indexes, self.local):
            for d, own in enumerate(_matches([known[n] for n in numbers], index, half, shingle, overlap, answer_overlap)):
                for i, x in own.items():
                    found[d][index.ids[i]] = max(found[d].get(index.ids[i], (0.0, 0.0)), x)
        return found


def _matches(numbers: list[np.ndarray], index: Index, half: int, shingle: int, overlap: float, answer_overlap: float, step: int = 1 << 17) -> list[dict]:
    """Per document: item -> (question-and-answer overlap, score) of the verified items, in windows of twice ``half`` words that overlap by half."""
    v = len(index.term_max)
    passages, terms, place = [], [], []
    for d, ids in enumerate(numbers):
        at = np.flatnonzero(ids >= 0)
        if not len(at):
            continue
        k = at // half  # each word is in the window that begins with its half and in the one before
        n = max(1, math.ceil(len(ids) / half) - 1)
        base = len(place)
        place += [(d, i * half) for i in range(n)]
        both = np.concatenate([base + np.minimum(k, n - 1), base + np.maximum(np.minimum(k - 1, n - 1), 0)])
        pair = np.unique(both * v + np.concatenate([ids[at], ids[at]]))
        passages.append(pair // v)
        terms.append(pair % v)
    found: list[dict] = [{} for _ in numbers]
    if not passages:
        return found
    passage, term = np.concatenate(passages), np.concatenate(terms)
    edges = [0]
    while edges[-1] < len(passage):  # parts of whole passages, so that a batch stays small
        at = min(len(passage), edges[-1] + step)
        edges.append(int(np.searchsorted(passage, passage[at - 1], side="right")))
    for lo, hi in zip(edges, edges[1:]):
        for p, i, score in retrieve(index, passage[lo:hi], term[lo:hi]):
            d, first = place[p]
            window = numbers[d][first : first + 2 * half].tolist()
            item = index.words[i].tolist()
            n = min(shingle, len(item))
            own = shingles(item, n)
            share = len(own & shingles(window, n)) / len(own)
            answer = set(index.answers[i].tolist())
            if share >= overlap and len(answer & set(window)) >= answer_overlap * len(answer):
                found[d][i] = max(found[d].get(i, (0.0, 0.0)), (share, score))
    return found


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    question_col: str = "question",
    answer_col: str = "answer",
    shingle: int = 5,
    overlap: float = 0.8,
    answer_overlap: float = 0.5,
    index_bytes: int = INDEX_BYTES,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, item_ids (sorted array), best_overlap, n_items: the test items that the text contains; and the row's own ``carry`` columns.

    An item is looked for in windows of twice its own length, rounded up to a power of two (``half_window``), that overlap by half, so each occurrence lies whole in one. Items of one
    length of windows have an inverted index; every window queries it by block-max WAND for all items above their threshold (``build_index``: no item that the check would pass is
    lost); for these the words are compared: ``overlap`` of the item's ``shingle``-word runs, and ``answer_overlap`` of its answer's words, must be in the window. Which other
    items there are changes nothing in that.

    The index goes to executors with a checked size: items that take more than ``index_bytes`` are dealt by hash to as many indexes
    as that takes. They go out one after the other, and what one finds is stored before the next is built, so the driver and
    the executors hold one. Documents are not shuffled for one index.

    Null and empty texts contain nothing; items without words match nothing and null questions or answers count as empty.
    Repeated rows and ids are each judged by their own text. Only the named columns are read. Empty tables give
    an empty table, or rows without items.
    """
    kind, item_kind = docs.schema[id_col].dataType, items.schema[item_col].dataType
    source = items.select(F.col(item_col).alias("i"), F.coalesce(F.col(question_col), F.lit("")).alias("q"), F.coalesce(F.col(answer_col), F.lit("")).alias("a")).where("i is not null")
    n_words = F.size(F.split(F.concat_ws(" ", "q", "a"), r"\W+", -1))
    total = source.agg(F.sum(n_words * WORD_BYTES + F.octet_length("q") + F.octet_length("a") + ITEM_BYTES).alias("b")).first().b or 0
    parts = max(1, math.ceil(total * 1.2 / index_bytes))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), *([F.struct(*carry).alias("carried")] if carry else []))
    if parts > 1:
        rows = rows.withColumn("row", F.xxhash64("id", "body"))
    schema = T.StructType([T.StructField("id", kind), T.StructField("items", T.ArrayType(item_kind)), T.StructField("best", T.DoubleType()), *rows.schema[2:3 if carry else 2]])

    def scan(part: int):
        own = source.where(F.pmod(F.xxhash64("i"), F.lit(parts)) == part).orderBy("i", "q", "a")
        index = docs.sparkSession.sparkContext.broadcast(Classes([(r.i, r.q, r.a) for r in own.toLocalIterator()], shingle, overlap))

        def run(batches):
            held = index.value
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    piece = batch.slice(start, 256)
                    found = held.matches([words_of(x) for x in piece.column(1).to_pylist()], shingle, overlap, answer_overlap)
                    ids = [sorted(x) for x in found]
                    best = [max((v[0] for v in x.values()), default=0.0) for x in found]
                    answer = [pa.array(ids, pa.list_(_arrow(item_kind))), pa.array(best, pa.float64())]
                    own, names = ([piece.column(2)], ["id", "row", "items", "best"]) if parts > 1 else ([], ["id", "items", "best"])
                    rest = [] if parts > 1 else piece.columns[2:]
                    yield pa.RecordBatch.from_arrays([piece.column(0), *own, *answer, *rest], names=names + ["carried"] * len(rest))

        if parts == 1:
            return rows.mapInArrow(run, schema)
        out = stored(rows.select("id", "body", "row").mapInArrow(run, T.StructType([schema[0], T.StructField("row", T.LongType()), *schema[1:3]])).where(F.size("items") > 0), "found")
        index.destroy()
        return out

    if parts == 1:
        found = scan(0)
    else:
        each = scan(0)
        for part in range(1, parts):
            each = each.union(scan(part))
        # identical rows find the same items: one result for them all, joined back to every one
        one = each.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.max("best").alias("best"))
        none = F.array().cast(T.ArrayType(item_kind))
        found = rows.drop("body").join(one, "row", "left").select("*", F.coalesce("items", none).alias("items_"), F.coalesce("best", F.lit(0.0)).alias("best_")).drop("items", "best").withColumnsRenamed({"items_": "items", "best_": "best"})
    return found.select(F.col("id").alias(id_col), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), F.col("best").alias("best_overlap"), *(["carried.*"] if carry else []))


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def question_and_answer(benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """Items that are one text: its last sentence is the answer, what comes before it the question. One sentence: all question."""
    text = F.trim(F.coalesce(F.col(text_col), F.lit("")))
    split = r"(?s)^(.*[.!?])\s+(\S.*)$"
    question = F.regexp_extract(text, split, 1)
    return benchmark.withColumn("question", F.when(question == "", text).otherwise(question)).withColumn("answer", F.regexp_extract(text, split, 2))
