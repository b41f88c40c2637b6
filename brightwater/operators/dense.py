"""Exact inner-product search over batches of query vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_key
from ..functions.vectors import inner_product
from ..sources.scratch import new_folder, stored
from .sparse import top_n

#: Most bytes of query vectors that one scan of the chunks takes along, and of similarities that a task holds at a time.
BLOCK_BYTES, PRODUCT_BYTES = 16 << 20, 32 << 20


def search(queries: DataFrame, chunks: DataFrame, n: int = 10) -> DataFrame:
    """queries (query_id, vector) against chunks (chunk_id, embedding): (query_id, chunk_id, vector_similarity, vector_rank), exact.

    Queries go out in blocks of a checked size, one after the other: if there are several, the answers to one are written before the next
    goes out, so the driver and the executors hold one. A task multiplies parts of its chunks with parts of the block, so
    that no product exceeds ``PRODUCT_BYTES``, and passes on the best ``n`` of a part per query: what shuffles is the size of the answer and
    not the product. Null vectors and those of another length than the query match nothing.
    """
    asked = queries.select("query_id", "vector").where("vector is not null")
    size = asked.agg(F.sum(F.size("vector") * 8 + 16).alias("b")).first()
    blocks = max(1, -(-(size.b or 0) // BLOCK_BYTES))
    spark, kind, chunk_kind = chunks.sparkSession, queries.schema["query_id"].dataType, chunks.schema["chunk_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("chunk_id", chunk_kind), T.StructField("vector_similarity", T.DoubleType())])
    found, folder = None, new_folder(spark, "dense") if blocks > 1 else None
    for block in range(blocks):
        rows = [(r.query_id, r.vector) for r in asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toLocalIterator()]
        held = spark.sparkContext.broadcast(rows)
        part = chunks.select("chunk_id", "embedding").where("embedding is not null").mapInArrow(_best(held, n, kind, PRODUCT_BYTES), schema)
        if folder:
            part = stored(part, "dense", f"{folder}/block={block}").drop("block")
            held.destroy()
        found = part if found is None else found.union(part)
    return top_n(found, "vector_similarity", n, "vector_rank")


def _best(held, n: int, kind, product_bytes: int):
    from pyspark.sql.pandas.types import to_arrow_type

    query_type = to_arrow_type(kind)

    def run(batches):
        rows = held.value
        by_dim: dict[int, list[int]] = {}
        for i, (_, v) in enumerate(rows):
            by_dim.setdefault(len(v), []).append(i)
        blocks = {d: np.array([rows[i][1] for i in at], np.float64) for d, at in by_dim.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                vectors = part.column(1).to_pylist()
                lengths = np.array([len(v) for v in vectors])
                for dim, at in by_dim.items():
                    some = np.flatnonzero(lengths == dim)
                    if not len(some):
                        continue
                    ids, own = part.column(0).take(pa.array(some)), np.array([vectors[i] for i in some], np.float64)
                    step = max(1, product_bytes // (8 * len(some)))
                    for low in range(0, len(at), step):
                        sims = own @ blocks[dim][low : low + step].T
                        k = min(n, len(some))
                        if k < len(some):  # keep ties with the last one in
                            least = np.partition(sims, len(some) - k, axis=0)[len(some) - k]
                            where, query = np.nonzero(sims >= least - 1e-9)
                        else:
                            where, query = np.nonzero(np.ones_like(sims, bool))
                        names = [rows[at[low + q]][0] for q in query.tolist()]
                        yield pa.RecordBatch.from_arrays([pa.array(names, query_type), ids.take(pa.array(where)), pa.array(sims[where, query])], names=["query_id", "chunk_id", "vector_similarity"])

    return run


def consistency(chunks: DataFrame, current: str, model_col: str = "model") -> DataFrame:
    """One row (state): empty without vectors, verified if all were made by the current model, else unverified."""
    key = model_key(F.col(model_col))
    return chunks.where("embedding is not null").agg(
        F.when(F.count("*") == 0, "empty").when((F.count_distinct(key) == 1) & (F.max(key) == model_key(F.lit(current))) & (F.max(key) != ""), "verified").otherwise("unverified").alias("state")
    )


def fill_missing(candidates: DataFrame, chunks: DataFrame, queries: DataFrame, verified: bool) -> DataFrame:
    """Candidates that only the lexical channel found get the cosine of their stored vector, if the model is the query's own; else they stay null."""
    if not verified:
        return candidates.withColumn("vector_score_source", F.lit(None).cast("string"))
    vectors = candidates.join(chunks.select("chunk_id", "embedding"), "chunk_id", "left").join(queries.select("query_id", "vector"), "query_id", "left")
    computed = F.when(F.size("embedding") == F.size("vector"), inner_product(F.col("embedding"), F.col("vector")))
    missing = F.col("vector_similarity").isNull() & computed.isNotNull()
    return vectors.withColumn("vector_score_source", F.when(missing, "computed")).withColumn("vector_similarity", F.coalesce("vector_similarity", computed)).drop("embedding", "vector")
