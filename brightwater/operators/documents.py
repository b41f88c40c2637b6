"""The document store as tables: listings, rollups and changes. Chunk ids are stable; nothing is renumbered by a change."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import doc_key, preview
from .chunking import chunk_documents

#: Buckets of documents that new chunk ids are counted by, and folders that these are dealt to: the number of buckets is a multiple of theirs.
BUCKETS, FOLDERS = 1024, 64


def list_chunks(chunks: DataFrame, page: int = 1, size: int = 20, filename: str | None = None, query: str | None = None, is_internal: Column | None = None) -> DataFrame:
    """A page of chunks, filtered before it is cut: chunk_id, filename, chunk_index (from 0, per file, after the filters), char_count, preview, total.

    ``filename`` is the whole name, without regard to case and folders; ``query`` any part of the text, without regard to case.
    """
    kept = chunks.withColumn("doc_key", doc_key(F.col("filename")))
    if is_internal is not None:
        kept = kept.where(~is_internal)
    if filename:
        kept = kept.where(F.col("doc_key") == doc_key(F.lit(filename)))
    if query and query.strip():
        kept = kept.where(F.contains(F.lower("text"), F.lit(query.strip().lower())))
    in_file = F.row_number().over(Window.partitionBy("doc_key").orderBy("chunk_id")) - 1
    shown = kept.select("chunk_id", "filename", in_file.alias("chunk_index"), F.length("text").alias("char_count"), preview(F.col("text")).alias("preview"))
    return paged(shown, ["chunk_id"], page, size)


def paged(rows: DataFrame, order: list, page: int = 1, size: int = 20) -> DataFrame:
    """One page (from 1; page and size are 1 at least) in this order, with the count of all rows as ``total``. The rows of the page are
    found by an ordered limit, which each task applies to its own rows first."""
    page, size = max(1, page), max(1, size)
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset((page - 1) * size).limit(size).crossJoin(F.broadcast(total))  # one row


def list_documents(chunks: DataFrame, newest_first: bool = True, files: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """Per document: chunk_count, char_count, last_chunk_id; the latest written first, or by name. ``files`` (filename, modificationTime): among
    documents of one last id the latest file first. ``name``: only documents that have it in theirs, without regard to case."""
    out = chunks.groupBy("filename").agg(F.count("*").alias("chunk_count"), F.sum(F.length("text")).alias("char_count"), F.max("chunk_id").alias("last_chunk_id"))
    if name and name.strip():
        out = out.where(F.contains(F.lower("filename"), F.lit(name.strip().lower())))
    if not newest_first:
        return out.orderBy(F.lower("filename"), "filename")
    if files is not None:
        out = out.join(files.select("filename", "modificationTime"), "filename", "left")
        return out.orderBy(F.desc("last_chunk_id"), F.desc_nulls_last("modificationTime"), "filename")
    return out.orderBy(F.desc("last_chunk_id"), "filename")


def corpus_summary(chunks: DataFrame) -> DataFrame:
    """One row: documents, chunks, dimension."""
    return chunks.agg(F.count_distinct("filename").alias("documents"), F.count("*").alias("chunks"), F.coalesce(F.max(F.size("embedding")), F.lit(0)).alias("dimension"))


def text_summary(rows: DataFrame, text_col: str = "text") -> DataFrame:
    n = F.length(text_col)
    return rows.agg(F.count("*").alias("count"), F.coalesce(F.floor(F.avg(n)), F.lit(0)).alias("avg_len"), F.coalesce(F.max(n), F.lit(0)).alias("max_len"))


def remove_documents(chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Chunks of no document in ``targets`` (filename)."""
    gone = targets.select(doc_key(F.col("filename")).alias("doc_key")).distinct()
    return chunks.withColumn("doc_key", doc_key(F.col("filename"))).join(gone, "doc_key", "left_anti").drop("doc_key").select(*chunks.columns)


def numbered_chunks(documents: DataFrame, chunk_size: int = 800, overlap: int = 120, by_folder: bool = False) -> DataFrame:
    """Documents (filename, text) cut into chunks: folder, place (from 1: by folder, bucket, document and place in it), filename, text.

    Counts are summed to offsets over the buckets, so the one task that numbers everything sees a row per bucket; texts are shuffled once. ``by_folder``: the chunks of a
    folder come in one partition, so that writing them by folder shuffles nothing again.
    """
    key = doc_key(F.col("filename"))
    keyed = chunk_documents(documents.select("filename", "text"), chunk_size, overlap).withColumn("doc_key", key).where("doc_key is not null").withColumn("bucket", F.pmod(F.xxhash64("doc_key"), F.lit(BUCKETS)))
    keyed = keyed.withColumn("folder", F.col("bucket") % FOLDERS)
    earlier = Window.orderBy("folder", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = keyed.groupBy("folder", "bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))  # BUCKETS rows at most
    place = F.row_number().over(Window.partitionBy("folder", "bucket").orderBy("doc_key", "filename", "chunk_index"))
    dealt = (keyed.repartition("folder") if by_folder else keyed).withColumn("place", place).join(F.broadcast(before), "bucket")
    return dealt.select("folder", (F.col("before") + F.col("place")).alias("place"), "filename", "text")


def upsert_documents(chunks: DataFrame, documents: DataFrame, chunk_size: int = 800, overlap: int = 120) -> DataFrame:
    """Documents (filename, text) cut into chunks, in place of what the store had under their names; new ids follow the last one."""
    last = chunks.agg(F.coalesce(F.max("chunk_id"), F.lit(-1)).alias("last"))
    numbered = numbered_chunks(documents, chunk_size, overlap).crossJoin(F.broadcast(last))  # one row
    new = numbered.select((F.col("last") + F.col("place")).alias("chunk_id"), "filename", "text")
    return remove_documents(chunks, documents).select("chunk_id", "filename", "text").unionByName(new)


def update_chunk(chunks: DataFrame, chunk_id, text: str) -> DataFrame:
    """One chunk's text changed. Its vector, if the table has them, is null until it is made anew (``models.refresh``)."""
    own = F.col("chunk_id") == chunk_id
    out = chunks.withColumn("text", F.when(own, F.lit(text)).otherwise(F.col("text")))
    return out.withColumn("embedding", F.when(~own, F.col("embedding"))) if "embedding" in chunks.columns else out


def delete_chunk(chunks: DataFrame, chunk_id) -> DataFrame:
    return chunks.where(F.col("chunk_id") != chunk_id)


def rebuild_document(chunks: DataFrame, filename: str, chunk_size: int = 800, overlap: int = 120) -> DataFrame:
    """A document's chunks joined by newlines and cut again, behind all others."""
    own = chunks.where(doc_key(F.col("filename")) == doc_key(F.lit(filename)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_id", "text"))), lambda x: x["text"]), "\n")
    whole = own.groupBy(doc_key(F.col("filename")).alias("k")).agg(F.min("filename").alias("filename"), text.alias("text")).drop("k")
    return upsert_documents(chunks, whole, chunk_size, overlap)


def clear(chunks: DataFrame) -> DataFrame:
    return chunks.limit(0)


def resync_internal(chunks: DataFrame, internal: DataFrame, chunk_size: int = 800, overlap: int = 120) -> DataFrame:
    """Internal documents (filename, text, is_active): all of these names go, active ones come back anew."""
    return upsert_documents(remove_documents(chunks, internal), internal.where("is_active"), chunk_size, overlap)
