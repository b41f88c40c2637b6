"""A store that is searched as it changes: every change writes one segment, with the chunks and lists of what it adds and the ids of what it ends."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import doc_key
from ..sources.commits import Conflict, commit, state
from ..sources.scratch import stored
from . import sparse
from .documents import FOLDERS, numbered_chunks

_CHUNKS = "chunk_id long, filename string, text string"
_KINDS = {
    "chunks": _CHUNKS + ", bucket int", "lists": "term string, shard long, n long, top double, ids array<long>, tfs array<int>, dls array<int>", "terms": "term string, df long, gone long, base double, tops array<double>",
    "dead": "chunk_id long", "lost": "term string, chunk_id long, tf long, dl long",
}
#: A merge begins when a store has more segments than this.
MOST_SEGMENTS = 8


def read(spark: SparkSession, store: str, version: int | None = None) -> DataFrame:
    """The chunks (chunk_id, filename, text) that a version has, the latest unless told otherwise; none before the first change."""
    return _chunks(spark, store, state(spark, store, version)[1]).select("chunk_id", "filename", "text")


def index(spark: SparkSession, store: str, version: int | None = None) -> sparse.Index:
    """The version's index, for ``sparse.search``: the segments' lists side by side, their counts added up."""
    _, now = state(spark, store, version)
    parts = now.get("segments", [])
    n, tokens = now.get("n", 0), now.get("tokens", 0)
    stats = spark.createDataFrame([(n, tokens / n if n else 0.0)], "n long, avgdl double")
    lists, terms, dead = (_part(spark, store, parts, kind) for kind in ("lists", "terms", "dead"))
    return sparse.Index(lists, terms, stats, dead if now.get("dead", 0) else None)


def _part(spark: SparkSession, store: str, segments: list[str], kind: str) -> DataFrame:
    paths = [f"{store}/{p}/{kind}" for p in segments]
    if not paths:
        return spark.createDataFrame([], _KINDS[kind])
    if kind != "chunks":
        return spark.read.schema(_KINDS[kind]).parquet(*paths)
    return reduce(DataFrame.union, [spark.read.schema(_KINDS[kind]).parquet(p) for p in paths])  # each has its own folders of buckets


def _chunks(spark: SparkSession, store: str, now: dict) -> DataFrame:
    parts = now.get("segments", [])
    rows = _part(spark, store, parts, "chunks")
    return rows.join(_part(spark, store, parts, "dead"), "chunk_id", "left_anti") if now.get("dead", 0) else rows


def _bucket():
    return F.pmod(F.xxhash64(doc_key(F.col("filename"))), F.lit(FOLDERS)).cast("int")


def _write_chunks(dealt: DataFrame, path: str) -> None:
    """By a hash of the document, so a change reads the folders of its own documents. The chunks of a bucket come in one partition."""
    dealt.select("chunk_id", "filename", "text", "bucket").write.option("compression", "zstd").partitionBy("bucket").parquet(path)


def change(spark: SparkSession, store: str, documents: DataFrame | None = None, remove: DataFrame | None = None, stream: tuple[str, int] | None = None, expected: int | None = None, chunk_size: int = 800, overlap: int = 120, attempts: int = 20) -> int:
    """Put documents (filename, text) in place of what the store has under their names, remove those named in ``remove`` (filename), and commit both as one version; returns its number.

    Written are the chunks and lists of the new documents, the ids of the chunks that end, and for each term that either has by how much its count changes: nothing of the other
    documents. New ids follow the last one that was ever given. If another writer commits first, the change is made again upon its version; with ``expected``, the version that the
    change was made for, it fails with ``Conflict``. ``stream``: (name, batch) of a stream; a batch that is committed already changes nothing.
    """
    for _ in range(attempts):
        version, now = state(spark, store)
        if expected is not None and expected != version:
            raise Conflict(f"{store} has version {version}, not {expected}")
        if stream and now.get("streams", {}).get(stream[0], -1) >= stream[1]:
            return version
        try:
            after = _segment(spark, store, now, documents, remove, chunk_size, overlap)
            if stream:
                after["streams"] = {**after.get("streams", {}), stream[0]: stream[1]}
            commit(spark, store, version + 1, after)
            return version + 1
        except Conflict:
            if expected is not None:
                raise
    raise Conflict(f"{store} changed {attempts} times meanwhile")


def _segment(spark: SparkSession, store: str, now: dict, documents: DataFrame | None, remove: DataFrame | None, chunk_size: int, overlap: int) -> dict:
    path = f"seg-{uuid.uuid4().hex}"
    at = f"{store}/{path}"
    documents = spark.createDataFrame([], "filename string, text string") if documents is None else documents
    names = documents.select("filename") if remove is None else documents.select("filename").union(remove.select("filename"))
    touched = names.select(doc_key(F.col("filename")).alias("k"), _bucket().alias("bucket")).distinct()
    folders = [r.bucket for r in touched.select("bucket").distinct().collect()]  # FOLDERS at most
    new = numbered_chunks(documents.where("filename <> ''"), chunk_size, overlap, by_folder=True)
    _write_chunks(new.withColumn("chunk_id", F.col("place") + now.get("last", -1)).withColumn("bucket", F.col("folder").cast("int")), f"{at}/chunks")
    fresh = spark.read.schema(_KINDS["chunks"]).parquet(f"{at}/chunks")
    own = F.col("bucket").isin(folders)
    held = _chunks(spark, store, now).where(own).select("chunk_id", doc_key(F.col("filename")).alias("k"))
    dead = stored(held.join(touched.select("k"), "k", "left_semi").select("chunk_id"), "dead", f"{at}/dead")  # a table whose size is known, so that the texts stay where they are
    ended = _part(spark, store, now.get("segments", []), "chunks").where(own).select("chunk_id", "text").join(dead, "chunk_id", "left_semi")
    lost = stored(sparse.postings(ended), "lost", f"{at}/lost")
    facts = lambda rows: rows.agg(F.count("*"), F.coalesce(F.max("chunk_id"), F.lit(-1))).first()
    lost_tokens = lost.agg(F.coalesce(F.sum("tf"), F.lit(0))).first()[0]
    (added, highest), (gone, _) = facts(fresh), facts(dead)
    n, total = now.get("n", 0) + added - gone, now.get("tokens", 0) + sparse.sizes(fresh)[1] - lost_tokens
    avgdl = total / n if n else 0.0
    ordered = added >= FOLDERS * sparse.SHARD  # a folder holds whole ranges of ids, in order; else there are few texts to shuffle
    sparse.write_lists(sparse.lists(fresh if ordered else sparse.by_range(fresh), avgdl), avgdl, at, lost)
    return {**now, "segments": [*now.get("segments", []), path], "n": n, "tokens": total, "last": max(now.get("last", -1), highest), "dead": now.get("dead", 0) + gone}


def merge(spark: SparkSession, store: str, most: int = MOST_SEGMENTS, attempts: int = 20) -> int | None:
    """If the store has more than ``most`` segments, write the smallest ones (all but half of ``most``) as one; returns the new version, else None.

    What ends within these segments goes: chunks, their postings and what was taken off their terms' counts. Ids that end chunks of other segments stay, as do all changes that are committed
    meanwhile: the merge takes the place of the segments that it read, in whatever version comes last. Lists are merged as they are; no text is split again.
    """
    _, now = state(spark, store)
    if len(now.get("segments", [])) <= most:
        return None
    size = {p: spark.read.parquet(f"{store}/{p}/dead").count() + spark.read.schema(_CHUNKS).parquet(f"{store}/{p}/chunks").count() for p in now["segments"]}
    old = sorted(size, key=lambda p: (size[p], p))[: len(size) - most // 2]
    path = f"seg-{uuid.uuid4().hex}"
    at = f"{store}/{path}"
    own, lists, dead, lost = (_part(spark, store, old, kind) for kind in ("chunks", "lists", "dead", "lost"))
    alive = lambda rows: rows.join(dead, "chunk_id", "left_anti")
    others = lambda rows: rows.join(own.select("chunk_id"), "chunk_id", "left_anti")
    _write_chunks(alive(own).repartition("bucket"), f"{at}/chunks")
    left = stored(others(dead), "dead", f"{at}/dead")
    avgdl = now["tokens"] / now["n"] if now["n"] else 0.0
    sparse.write_lists(sparse.lists_of(alive(sparse.spread(lists)), avgdl), avgdl, at, stored(others(lost).select("term", "chunk_id", "tf", "dl"), "lost", f"{at}/lost"))
    done = dead.count() - left.count()
    for _ in range(attempts):
        version, latest = state(spark, store)
        if not set(old) <= set(latest["segments"]):
            return None  # another merge has taken them
        segments = [*(p for p in latest["segments"] if p not in old), path]
        try:
            commit(spark, store, version + 1, {**latest, "segments": segments, "dead": latest["dead"] - done})
            return version + 1
        except Conflict:
            continue
    raise Conflict(f"{store} changed {attempts} times meanwhile")
