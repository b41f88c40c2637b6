"""Embedding near-dedup: a subspace pigeonhole join."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import stored

#: Most rows that one task compares with each other.
CHUNK = 16_384


def rotation(dim: int, seed: int = 17) -> np.ndarray:
    """A fixed random orthogonal matrix: it evens out the variance of the coordinates and keeps all distances."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def _valid(vector, dim: int | None) -> np.ndarray | None:
    if vector is None or any(x is None for x in vector):
        return None
    v = np.asarray(vector, np.float64)
    return v if v.size and (dim is None or v.size == dim) and np.isfinite(v).all() and v.any() else None


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "label",
    threshold: float = 0.93,
    block_dims: int = 6,
    chunk: int = CHUNK,
) -> DataFrame:
    """One row per input row: id, n_links (other rows at a cosine of ``threshold`` or more within the same group), component_id, kept.

    1. Equal vectors of a group become one class; only classes are compared, and a link counts all its members.
    2. Unit vectors at that cosine have a squared distance of 2 - 2 * threshold at most. Rotated and cut into
       blocks of ``block_dims``, they are within a share of that in proportion to the block's width in at least one block.
    3. Each block is a range join (``range_join``): the vectors of a group meet on a grid of the block's coordinates, coordinate by
       coordinate, and cells part as soon as the gaps between them use up the block's budget. Groups of more than ``chunk`` classes
       (counted first) are spread over tasks by a coarser grid of the first coordinates, as many as their size calls for: a vector
       goes to its own cell, and as a visitor to those within what is left of the budget. A pair belongs to the own cell
       of its smaller end, and to the first block that it passes in, so the union of the blocks holds each pair once
       without a shuffle to dedupe it.
    4. Pairs within a block's budget are verified by the cosine of the given vectors in double precision.
       Groups return each vector's count and one link per local component, never the pairs.
    Cells that still have more than ``chunk`` rows (counted) are dealt into pairs of chunks, each a group of its own.

    Vectors that are null, empty, zero or hold null or non-finite components, and those without a group or id, link with nothing:
    n_links 0, component_id the own id. Vectors of different lengths never link. Repeated ids are rows of their own
    for counts and one vertex for components. Only the three columns are read; an empty table gives an empty table.
    """
    kind, group_kind = vectors.schema[id_col].dataType, vectors.schema[group_col].dataType
    rows = vectors.select(F.col(id_col).alias("id"), F.col(group_col).alias("g"), F.col(vector_col).alias("v"))

    def measure(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys = []
                for v in part.column(2).to_pylist():
                    v = _valid(v, None)
                    keys.append(None if v is None else hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(keys, pa.binary())], names=["id", "g", "v", "k"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("g", group_kind), T.StructField("v", vectors.schema[vector_col].dataType), T.StructField("k", T.BinaryType())])
    keyed = stored(rows.mapInArrow(measure, schema), "vectors")
    usable = keyed.where("id is not null and g is not null and k is not null")
    classes = stored(usable.groupBy("g", "k").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("v").alias("v")), "classes")
    linked = stored(_links(classes, kind, group_kind, threshold, block_dims, chunk), "linked")
    degree = linked.where("local is null").groupBy("g", "k").agg(F.sum("more").alias("more"))
    degree = stored(classes.select("g", "k", "rep", "n").join(degree, ["g", "k"], "left").select("g", "k", "rep", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links")), "degrees")
    components = connected_components(linked.where("local is not null").select(F.col("rep").alias("a"), F.col("local").alias("b")).distinct())
    final = stored(degree.join(components.withColumnRenamed("node", "rep"), "rep", "left").select(F.col("g").alias("g_"), F.col("k").alias("k_"), "n_links", F.coalesce("component", "rep").alias("component_id")), "final")
    out = keyed.select("id", "g", F.when(F.col("id").isNotNull(), F.col("k")).alias("k")).join(final, (F.col("g") == F.col("g_")) & (F.col("k") == F.col("k_")), "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _turned(v: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Rotated unit vectors. Summed in one fixed order, so a vector has the same coordinates to the last bit in every task."""
    out = np.zeros_like(v)
    for j in range(v.shape[1]):
        out += v[:, j : j + 1] * turn[j]
    return out / np.sqrt((v * v).sum(1))[:, None]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose lists have one length."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


class _Grid:
    """Points in order of their cells; per coordinate the cells of the first coordinates up to it: where each starts, its last number, where its parts start."""

    def __init__(self, points: np.ndarray, width: float) -> None:
        cell = np.floor(points / width).astype(np.int64)
        self.order = np.lexsort(cell.T[::-1])
        cell, opens, above = cell[self.order], np.zeros(len(points), bool), np.zeros(1, np.int64)
        opens[:1] = True
        self.levels = []
        for column in cell.T:
            opens = opens.copy()
            opens[1:] |= column[1:] != column[:-1]
            starts = np.flatnonzero(opens)
            self.levels.append((column[starts], np.append(np.searchsorted(starts, above), len(starts))))
            above = starts
        self.starts = np.append(above, len(points))


def range_join(left: np.ndarray, right: np.ndarray | None, budget: float, at_once: int = 1 << 18):
    """(i, j) arrays that hold all pairs of points within a squared distance of ``budget``, and few others; ``right`` None: pairs of the left points, once each.

    Both sides lie on a grid of just over half the radius. From cells of the first coordinate to cells of them all, a pair of cells goes on
    to its parts while the squares of the gaps between them add up to no more than the budget, ``at_once`` pairs at a time: lists of pairs of cells are cut in two, and so is
    the larger side of a pair of cells with more pairs than that, so crowded cells take no more memory than others.
    """
    width = np.sqrt(budget) * 0.500001  # two cells between are out of reach
    a, same = _Grid(left, width), right is None
    b = a if same else _Grid(right, width)

    def inside(level, x, y):
        """The ranges of parts that cells of the level before have."""
        ends_a, ends_b = (g.starts if level == len(a.levels) else g.levels[level][1] for g in (a, b))
        return ends_a[x], ends_a[x + 1], ends_b[y], ends_b[y + 1]

    first = np.zeros(1, np.int64)
    stack = [(0, *inside(0, first, first), np.zeros(1))] if len(left) and len(b.order) else []
    while stack:
        level, low_a, high_a, low_b, high_b, used = stack.pop()
        n, m = high_a - low_a, high_b - low_b
        total = (n * m).cumsum()
        if total[-1] > at_once:
            if len(n) > 1:
                cut = min(max(1, int(np.searchsorted(total, total[-1] / 2))), len(n) - 1)
                stack += [(level, low_a[s], high_a[s], low_b[s], high_b[s], used[s]) for s in (slice(cut, None), slice(cut))]
            elif n[0] >= m[0]:
                half = (low_a + high_a) // 2
                stack += [(level, half, high_a, low_b, high_b, used), (level, low_a, half, low_b, high_b, used)]
            else:
                half = (low_b + high_b) // 2
                stack += [(level, low_a, high_a, half, high_b, used), (level, low_a, high_a, low_b, half, used)]
            continue
        k = np.repeat(np.arange(len(n)), n * m)
        off = np.arange(total[-1]) - (total - n * m)[k]
        i, j = low_a[k] + off // m[k], low_b[k] + off % m[k]
        if level == len(a.levels):
            if same:
                i, j = i[i < j], j[i < j]
            if len(i):
                yield a.order[i], b.order[j]
            continue
        gap = np.maximum(np.abs(a.levels[level][0][i] - b.levels[level][0][j]) - 1, 0) * width
        spent = used[k] + gap * gap
        on = spent <= budget * (1 + 1e-9)
        if same:
            on &= i <= j
        if on.any():
            stack.append((level + 1, *inside(level + 1, i[on], j[on]), spent[on]))


def unite(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Labels (each node's own number or that of a smaller one of its component), in place, after the links p-q: all links at once, by the lesser of two components' labels, until
    no link joins two."""
    while len(p):
        while not np.array_equal(up := label[label], label):
            label[:] = up
        a, b = label[p], label[q]
        on = a != b
        p, q, a, b = p[on], q[on], a[on], b[on]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _links(classes: DataFrame, kind, group_kind, threshold: float, block_dims: int, chunk: int) -> DataFrame:
    """(g, k, rep, more, local): with local null, ``more`` rows linked to a class within one group; else a link of its to ``local``."""
    budget = (2 - 2 * threshold) * (1 + 1e-9) + 1e-12  # room for rounding

    def cells(unit: np.ndarray, depth: int):
        """(block, which vectors, cell, is it the own one) over rotated unit vectors of one length; ``depth``: coordinates in a cell's name."""
        dim = unit.shape[1]
        for b, low in enumerate(range(0, dim, block_dims)):
            part = unit[:, low : low + block_dims]
            radius = np.sqrt(budget * part.shape[1] / dim)
            x = part[:, :depth] / (2 * radius)
            home = np.floor(x).astype(np.int64)
            side = np.where(x - home < 0.5, -1, 1)  # the one neighbour within the radius along each coordinate
            gap = 2 * np.minimum(x - home, 1 - (x - home))  # in radii
            for moves in itertools.product((0, 1), repeat=x.shape[1]):
                some = np.flatnonzero(((gap * moves) ** 2).sum(1) <= 1 + 1e-6)
                yield b, some, home[some] + side[some] * np.array(moves, np.int64), not any(moves)

    def expand(batches):
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                key = np.asarray(pc.list_value_length(part.column(4))).astype(np.int64) * 64 + np.asarray(part.column(5))
                for x in np.unique(key).tolist():
                    some, dim = part.take(pa.array(np.flatnonzero(key == x))), x // 64
                    unit = _turned(_matrix(some.column(4)), turns.setdefault(dim, rotation(dim)))
                    for b, which, cell, own in cells(unit, x % 64):
                        names, n = [f"{dim}:{b}:" + ":".join(map(str, c)) for c in cell.tolist()], len(which)
                        yield pa.RecordBatch.from_arrays([*some.take(pa.array(which)).columns[:5], pa.array([b] * n, pa.int32()), pa.array(names, pa.string()), pa.array([own] * n, pa.bool_())], names=["g", "k", "rep", "n", "v", "b", "cell", "own"])

    base = [T.StructField("g", group_kind), T.StructField("k", T.BinaryType()), T.StructField("rep", kind), T.StructField("n", T.LongType()), T.StructField("v", classes.schema["v"].dataType)]
    wide = T.StructType([*base, T.StructField("b", T.IntegerType()), T.StructField("cell", T.StringType()), T.StructField("own", T.BooleanType())])
    # coordinates until cells of two equal halves each would be small enough; only groups over the limit are named
    many = classes.groupBy("g").count().where(F.col("count") > chunk).select("g", F.least(F.ceil(F.log2(F.col("count") / chunk)), F.lit(block_dims)).cast("int").alias("depth"))
    placed = classes.select("g", "k", "rep", "n", "v").join(stored(many, "groups"), "g", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).mapInArrow(expand, wide)
    # how many chunks a cell needs; only cells over the limit are named
    large = stored(placed.groupBy("g", "cell").count().where(F.col("count") > chunk).select("g", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("c")), "cells")
    dealt = placed.join(large, ["g", "cell"], "left").withColumn("c", F.coalesce("c", F.lit(1))).withColumn("h", F.pmod(F.xxhash64("k"), F.col("c")).cast("int"))
    # chunk h meets every chunk once, in the group of the two
    meetings = F.transform(F.sequence(F.lit(0), F.col("c") - 1), lambda j: F.struct(F.least(F.col("h"), j).alias("i"), F.greatest(F.col("h"), j).alias("j")))
    groups = dealt.withColumn("to", F.explode(meetings)).select("g", "cell", "b", "k", "rep", "n", "v", "own", "h", F.col("to.i").alias("i"), F.col("to.j").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        own = np.asarray(table.column("own").combine_chunks().to_numpy(zero_copy_only=False), bool)
        half = np.asarray(table.column("h"))
        reps, keys = table.column("rep").to_pylist(), table.column("k").to_pylist()
        n, v = np.asarray(table.column("n")), _matrix(table.column("v"))
        dim, block = v.shape[1], table.column("b")[0].as_py()
        u = _turned(v, rotation(dim))
        norm = np.sqrt((v * v).sum(1))
        lows = np.arange(0, dim, block_dims)
        widths = np.minimum(block_dims, dim - lows)
        limits = budget * widths / dim
        order = {x: i for i, x in enumerate(sorted(set(zip(reps, keys))))}
        place = np.array([order[x] for x in zip(reps, keys)])
        sizes = np.zeros(len(order), np.int64)
        sizes[place] = n
        more, label = np.zeros(len(order), np.int64), np.arange(len(order))
        touched = np.zeros(len(order), bool)
        part = u[:, lows[block] : lows[block] + widths[block]]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        for left, right in {(i, j), (j, i)}:
            a_all, b_all = np.flatnonzero(own & (half == left)), np.flatnonzero(half == right)
            same = len(a_all) == len(b_all) == len(part)
            for at, bt in range_join(part[a_all], None if same else part[b_all], limits[block]):
                a, b = a_all[at], b_all[bt]
                back = place[a] > place[b]
                if same:
                    a, b = np.where(back, b, a), np.where(back, a, b)
                else:
                    a, b = a[~back], b[~back]
                for lo in range(0, len(a), 50_000):
                    p, q = a[lo : lo + 50_000], b[lo : lo + 50_000]
                    on = ((part[p] - part[q]) ** 2).sum(1) <= limits[block] + 1e-9
                    p, q = p[on], q[on]
                    # the same sums wherever the pair meets, so exactly one block takes it
                    within = np.add.reduceat((u[p] - u[q]) ** 2, lows, axis=1) <= limits
                    here = within[:, block] & (within.argmax(1) == block) & (place[p] != place[q])
                    p, q = p[here], q[here]
                    linked = (v[p] * v[q]).sum(1) / (norm[p] * norm[q]) >= threshold
                    p, q = place[p[linked]], place[q[linked]]
                    if not len(p):
                        continue
                    np.add.at(more, p, sizes[q])
                    np.add.at(more, q, sizes[p])
                    touched[p] = touched[q] = True
                    unite(label, p, q)
        names = list(order)
        got = np.flatnonzero(touched).tolist()
        while not np.array_equal(up := label[label], label):
            label = up
        joins = [(x, t) for x in got if (t := int(label[x])) != x]
        g = table.column("g")[0].as_py()
        who = got + [x for x, _ in joins]
        return pa.table(
            [
                pa.array([g] * len(who), table.schema.field("g").type),
                pa.array([names[x][1] for x in who], pa.binary()),
                pa.array([names[x][0] for x in who], table.schema.field("rep").type),
                pa.array([int(more[x]) for x in got] + [0] * len(joins), pa.int64()),
                pa.array([None] * len(got) + [names[t][0] for _, t in joins], table.schema.field("rep").type),
            ],
            names=["g", "k", "rep", "more", "local"],
        )

    schema = T.StructType([base[0], base[1], base[2], T.StructField("more", T.LongType()), T.StructField("local", kind)])
    return groups.groupBy("g", "cell", "i", "j").applyInArrow(compare, schema)
