"""The evidence gate: may a source be used for an answer?"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TRUE_WORDS, entities, entity_variants
from ..sources.scratch import stored

#: Most bytes of hashes of names that one scan of the texts takes along.
ALIAS_BYTES = 32 << 20


# Fixed values that results depend on: why a source is rejected.
ENTITY_ABSENT = "查询实体未出现在证据中，且语义分不足"
RERANK_SAYS_NO = "重排判定不相关"
NO_SCORE = "缺少语义证据（仅字面命中且重排不可用）"
WEAK_VECTOR = "向量相似度不足"


@dataclass(frozen=True)
class EvidencePolicy:
    """Thresholds and aliases. Defaults are fixed values that results depend on."""

    enabled: bool = True
    min_rerank_probability: float = 0.50
    min_vector_similarity: float = 0.50
    strong_vector_similarity: float = 0.75
    entity_miss_rerank_probability: float = 0.80
    aliases: Mapping[str, Sequence[str]] = field(default_factory=dict)
    extra_generic: tuple[str, ...] = ()

    @classmethod
    def from_config(cls, config: Mapping | None, aliases: Mapping[str, Sequence[str]] | None = None) -> EvidencePolicy:
        """Numbers are clamped to 0..1; what is no number keeps the default. Aliases of the file and of the configuration are united."""
        config = config or {}

        def number(name: str) -> float:
            try:
                x = float(config.get(name))
            except (TypeError, ValueError):
                return getattr(cls, name)
            return getattr(cls, name) if math.isnan(x) else max(0.0, min(1.0, x))

        on = config.get("enabled")
        enabled = on if isinstance(on, bool) else True if on is None else str(on).strip().lower() in TRUE_WORDS
        return cls(
            enabled, number("min_rerank_probability"), number("min_vector_similarity"), number("strong_vector_similarity"), number("entity_miss_rerank_probability"),
            merge_aliases(aliases, config.get("aliases")), tuple(str(t).strip() for t in config.get("extra_generic_terms") or () if str(t).strip()),
        )


def merge_aliases(*tables: Mapping[str, Sequence[str]] | None) -> dict[str, list[str]]:
    """Alias tables united key by key: lower case, in order, once each, without the name itself."""
    out: dict[str, list[str]] = {}
    for table in tables:
        for key, values in (table.items() if isinstance(table, Mapping) else ()):
            name = str(key).strip().lower()
            for value in values if name and isinstance(values, (list, tuple)) else ():
                text = str(value).strip().lower()
                if text and text != name and text not in out.setdefault(name, []):
                    out[name].append(text)
    return {k: v for k, v in out.items() if v}


def entity_found(found: Column, aliases: Mapping[str, Sequence[str]], *texts: Column) -> Column:
    """Whether any entity or alias of it stands in one of the texts; null if there are no entities."""
    low = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]

    def inside(variant: Column) -> Column:
        hit = F.lit(False)
        for text in low:
            hit = hit | F.contains(text, variant)
        return hit

    return F.when(F.size(found) > 0, F.exists(found, lambda e: F.exists(entity_variants(e, aliases), inside)))


def mentions(texts: DataFrame, aliases: DataFrame, id_col: str = "chunk_id", text_cols: Sequence[str] = ("text",), alias_bytes: int = ALIAS_BYTES) -> DataFrame:
    """(id, entity): each entity of a table (entity, alias) whose name or alias stands in one of a row's texts, without regard to case.

    The table is data and no part of the plan. What goes out with a scan of the texts is a hash of each name (``_Names``), in parts of ``alias_bytes`` at most; a window of a text whose hash is
    among them is a candidate (row, window), and a join with the names finds out which are names, and whose. So no task holds a table or what a batch of rows finds. An entity's first
    alias gives its rows (``_each_entity``); other names of it are few as a rule, and what they find is held against the first one's, so the rows as a whole are not shuffled to be told
    apart. Blank names match nothing; null ids keep their rows.
    """
    bare = lambda c: F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    pairs = aliases.select(bare("entity").alias("entity"), bare("alias").alias("name"))
    own = pairs.where("entity <> ''").select("entity", F.col("entity").alias("name"))
    named = pairs.where("entity <> '' and name <> ''").union(own).groupBy("entity").agg(F.collect_set("name").alias("names"))
    first = F.coalesce(F.array_min(F.array_remove("names", F.col("entity"))), F.col("entity"))
    named = stored(named.select("entity", first.alias("first"), F.explode("names").alias("name")), "names")
    hashed = stored(named.select("name").distinct().mapInArrow(_hashes, "size int, head long, whole long"), "hashes")
    parts = max(1, -(-hashed.count() * 16 // alias_bytes))
    keyed = texts.select(F.col(id_col).alias("id"), F.array(*[F.lower(F.coalesce(F.col(c), F.lit(""))) for c in text_cols]).alias("said"), F.monotonically_increasing_id().alias("row"))
    schema, spark = T.StructType([keyed.schema["id"], T.StructField("row", T.LongType()), T.StructField("name", T.StringType())]), texts.sparkSession
    found = None
    for part in range(parts):
        held = spark.sparkContext.broadcast(_Names(hashed.where(F.pmod(F.xxhash64("size", "whole"), F.lit(parts)) == part).toArrow()))
        one = stored(keyed.mapInArrow(_finder(held, _SLICE), schema), "mentions")
        held.destroy()
        found = one if found is None else found.union(one)
    firsts = _each_entity(found.select("id", "row", "name"), named.where("name = first").select("name", "entity"))
    others = found.join(named.where("name <> first").select("name", "entity", "first"), "name").select("id", "row", "entity", "first").distinct()
    others = others.join(found.select("row", F.col("name").alias("first")), ["row", "first"], "left_anti").select("id", "entity")
    return firsts.union(others).withColumnRenamed("id", id_col)


def _each_entity(found: DataFrame, named: DataFrame) -> DataFrame:
    """(id, entity): the rows that found a name with all entities of the name.

    Copies of a text share their names, so a name may have as many entities as rows, and pairs as their product. Its entities are put into lists of about ``_LIST`` and its rows are dealt to
    shares of about as many; a list meets a share in one task and is unrolled there. The pairs decide how many tasks there are, as the lists are small and the pairs are not.
    """
    rows, entities = (df.groupBy("name").agg(F.count(F.lit(1)).alias("n")).select("name", F.ceil(F.col("n") / _LIST).alias(of), F.col("n").alias(f"n_{of}")) for df, of in ((found, "shares"), (named, "lists")))
    sizes = stored(rows.join(entities, "name"), "sizes")
    pairs = sizes.agg(F.sum(F.col("n_shares").cast("double") * F.col("n_lists"))).first()[0] or 0
    tasks = max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(_MOST_TASKS, int(pairs / _LIST**2)))
    one_of = lambda c, n: F.pmod(F.xxhash64(c), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    lists = named.join(sizes, "name").groupBy("name", one_of("entity", "lists").alias("list"), "shares").agg(F.collect_list("entity").alias("entities"))
    lists = lists.select("name", "list", each("shares").alias("share"), "entities")
    asked = found.join(sizes, "name").select("id", "name", one_of("row", "shares").alias("share"), each("lists").alias("list"))
    met = asked.repartition(tasks, "name", "list", "share").join(lists.repartition(tasks, "name", "list", "share"), ["name", "list", "share"])
    return met.select("id", F.explode("entities").alias("entity"))


#: Entities in a list and rows in a share of a name, about; most tasks that unroll lists.
_LIST, _MOST_TASKS = 2048, 20_000
#: Multiplier of the hashes; windows of at most so many bytes are looked up by their first bytes, a power of two of them.
_BASE, _MOST_HEAD = np.uint64(0x9E3779B97F4A7C15), 32
#: Bytes of text that a task hashes at a time.
_SLICE = 2 << 20


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _windows(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
    """The hashes of windows, of the sums of bytes times powers: the same wherever a window stands."""
    h = (sums[ends] - sums[at]) * inverse[at]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def _sums(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: len(data)], out=out[1:])
    return out


def _inverse(n: int) -> np.ndarray:
    out = np.full(n + 1, pow(int(_BASE), -1, 1 << 64), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _head(size: int | np.ndarray) -> np.ndarray:
    return np.minimum(_MOST_HEAD, 1 << (np.frexp(size)[1] - 1))


def _hashes(batches):
    """Per name its bytes, and the hashes of its head and of the whole, some ``_SLICE`` bytes of names at a time."""
    for batch in batches:
        names = batch.column(0)
        if not len(names):
            continue
        ends = np.frombuffer(names.buffers()[1], np.int32)[names.offset : names.offset + len(names) + 1].astype(np.int64)
        data = np.frombuffer(names.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(names):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + _SLICE, "right")) - 1)
            at, sizes = ends[a:b] - ends[a], np.diff(ends[a : b + 1])
            n = int(ends[b] - ends[a])
            sums, inverse = _sums(data[ends[a] : ends[b]], _powers(n)), _inverse(n)
            heads, wholes = (_windows(sums, inverse, at, at + k).view(np.int64) for k in (_head(sizes), sizes))
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(heads), pa.array(wholes)], names=["size", "head", "whole"])
            a = b


class _Held:
    """Sorted hashes. A bit field turns away most of those that are not among them."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.known = np.unique(hashes.view(np.uint64))
        self.shift = np.uint64(64 - max(10, min(27, int(len(self.known) * 16).bit_length())))
        field = np.zeros(1 << (64 - int(self.shift)), bool)
        field[self.known >> self.shift] = True
        self.field = np.packbits(field, bitorder="little")

    def among(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that are held."""
        key = hashes >> self.shift
        at = np.flatnonzero(self.field[key >> np.uint64(3)] >> (key & np.uint64(7)).astype(np.uint8) & 1)
        hashes = hashes[at]
        i = np.searchsorted(self.known, hashes)
        return at[self.known[np.minimum(i, len(self.known) - 1)] == hashes]


class _Names:
    """Names as hashes: by the length of their head those of heads, by their length those of wholes."""

    def __init__(self, table: pa.Table) -> None:
        size, head, whole = (table[c].to_numpy() for c in ("size", "head", "whole"))
        starts = _head(size)
        self.sizes = {int(n): _Held(whole[size == n]) for n in np.unique(size)}
        self.heads = {int(q): _Held(head[starts == q]) for q in np.unique(starts)}


def _spans(ends: np.ndarray, length: int, overlap: int):
    """Slices of rows' bytes put end to end, each of whole rows; one longer than a slice comes in pieces that overlap by the longest name."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + length, "right")) - 1)
        lo, hi = int(ends[a]), int(ends[b])
        while hi - lo > length + overlap:
            yield lo, lo + length + overlap
            lo += length
        yield lo, hi
        a = b


def _finder(held, length: int):
    def run(batches):
        names = held.value
        longest = max(names.sizes, default=0)
        powers, inverse = _powers(length + longest + 1), _inverse(length + longest + 1)
        for batch in batches:
            said = batch.column(1)
            texts = said.flatten()
            if not len(texts):
                continue
            text_ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            row_ends = text_ends[np.append(0, np.cumsum(said.value_lengths().to_numpy()))]
            once: set = set()
            for lo, hi in _spans(row_ends, length, longest) if names.sizes else ():
                part = data[lo:hi]
                sums = _sums(part, powers)
                ends = np.append(text_ends[(text_ends > lo) & (text_ends < hi)], hi) - lo
                found = []
                for q, held_heads in names.heads.items():
                    if len(part) < q:
                        continue
                    at = held_heads.among(_windows(sums, inverse, slice(0, len(part) - q + 1), slice(q, len(part) + 1)))
                    room = ends[np.searchsorted(ends, at, "right")] - at
                    for size, wholes in names.sizes.items():
                        if _head(size) == q:
                            here = at[room >= size]
                            here = here[wholes.among(_windows(sums, inverse, here, here + size))]
                            found.append(np.stack([here, np.full(len(here), size)]))
                place, size = np.concatenate(found, axis=1) if found else np.zeros((2, 0), int)
                rows = np.searchsorted(row_ends, place + lo, "right") - 1
                bare = part.tobytes()
                once |= {(r, bare[p : p + n]) for r, p, n in zip(rows.tolist(), place.tolist(), size.tolist())}
                if once and hi in row_ends:
                    index = pa.array([r for r, _ in once], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(2).take(index), pa.array([x for _, x in once], pa.binary()).cast(pa.string())], names=["id", "row", "name"])
                    once = set()

    return run


def judge(vector: Column, rerank: Column, status: Column, matched: Column, policy: EvidencePolicy) -> Column:
    """struct(passed, basis). Lexical scores never admit a source. A null ``matched`` means that the query names no entity."""
    vector, rerank = F.when(~F.isnan(vector), vector), F.when(~F.isnan(rerank), rerank)
    ready = rerank.isNotNull() & (F.coalesce(status, F.lit("ok")) == "ok")

    def verdict(passed: bool, basis: str) -> Column:
        return F.struct(F.lit(passed).alias("passed"), F.lit(basis).alias("basis"))

    absent = (
        F.when(ready & (rerank >= policy.entity_miss_rerank_probability), verdict(True, "rerank_strict"))
        .when(~ready & (vector >= policy.strong_vector_similarity), verdict(True, "vector_strict"))
        .otherwise(verdict(False, ENTITY_ABSENT))
    )
    reranked = F.when(rerank >= policy.min_rerank_probability, verdict(True, "rerank")).when(vector >= policy.strong_vector_similarity, verdict(True, "vector_strong")).otherwise(verdict(False, RERANK_SAYS_NO))
    plain = F.when(vector.isNull(), verdict(False, NO_SCORE)).when(vector >= policy.min_vector_similarity, verdict(True, "vector")).otherwise(verdict(False, WEAK_VECTOR))
    if not policy.enabled:
        return verdict(True, "disabled")
    return F.when(F.coalesce(matched, F.lit(True)) == F.lit(False), absent).when(ready, reranked).otherwise(plain)


def gate(results: DataFrame, policy: EvidencePolicy, query_col: str = "query", text_col: str = "text", file_col: str = "filename") -> DataFrame:
    """Results with entity_matched, passed, basis, and the query's status (sufficient if anything passes, else insufficient)."""
    found = results.withColumn("entities", entities(F.col(query_col)))
    found = found.withColumn("entity_matched", entity_found(F.col("entities"), policy.aliases, F.col(text_col), F.col(file_col)))
    verdict = judge(F.col("vector_similarity"), F.col("rerank_similarity"), F.col("rerank_status"), F.col("entity_matched"), policy)
    judged = found.withColumn("v", verdict).withColumn("passed", F.col("v.passed")).withColumn("basis", F.col("v.basis")).drop("v", "entities")
    ok = F.max("passed").over(Window.partitionBy("query_id"))
    return judged.withColumn("status", F.when(ok, "sufficient").otherwise("insufficient"))
