"""Fusion of ranked channels, diversification, combination and the final ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import combine, rerank_probability, to_distance

RRF_K = 60


def rrf(*channels: DataFrame, k: int = RRF_K, n: int | None = None, rank_col: str = "rank", id_col: str = "chunk_id") -> DataFrame:
    """Any number of ranked lists (query_id, id, rank from 1) as one: score = sum of 1 / (k + rank). Equal scores in order of the first list, then the next."""
    out = None
    names = [f"rank_{i}" for i in range(len(channels))]
    for i, channel in enumerate(channels):
        part = channel.select("query_id", id_col, *[F.col(rank_col).alias(n) if j == i else F.lit(None).cast("int").alias(n) for j, n in enumerate(names)])
        out = part if out is None else out.unionByName(part)
    total = sum((F.coalesce(1.0 / (k + F.col(n)), F.lit(0.0)) for n in names), F.lit(0.0))
    one = out.groupBy("query_id", id_col).agg(*[F.min(n).alias(n) for n in names]).withColumn("rrf_score", total)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("rrf_score", 12)), *[F.asc_nulls_last(n) for n in names], id_col)
    one = one.withColumn("fusion_pos", F.row_number().over(order))
    return one.where(F.col("fusion_pos") <= n) if n else one


def fuse(vector_hits: DataFrame, bm25_hits: DataFrame, top_n: int, k: int = RRF_K) -> DataFrame:
    """Candidates of both channels, each with its own scores and nulls where a channel gave none. A query with one channel
    keeps that channel's order and has no rrf_score. Also: channels, channel (hybrid_rrf, vector_only, bm25_only)."""
    both = vector_hits.select("query_id", "chunk_id", "vector_similarity", "vector_rank").join(bm25_hits.select("query_id", "chunk_id", "bm25_score", "bm25_rank"), ["query_id", "chunk_id"], "full")
    per_query = Window.partitionBy("query_id")
    has_v, has_b = F.count("vector_rank").over(per_query) > 0, F.count("bm25_rank").over(per_query) > 0
    score = F.coalesce(1.0 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1.0 / (k + F.col("bm25_rank")), F.lit(0.0))
    scored = both.withColumn("channel", F.when(has_v & has_b, "hybrid_rrf").when(has_v, "vector_only").otherwise("bm25_only"))
    scored = scored.withColumn("rrf_score", F.when(F.col("channel") == "hybrid_rrf", score))
    scored = scored.withColumn("channels", F.array_compact(F.array(F.when(F.col("vector_rank").isNotNull(), "vector"), F.when(F.col("bm25_rank").isNotNull(), "bm25"))))
    order = per_query.orderBy(F.desc(F.round(score, 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"), "chunk_id")
    return scored.withColumn("fusion_pos", F.row_number().over(order)).where(F.col("fusion_pos") <= top_n)


def diversify(candidates: DataFrame, cap: int, per_file: int = 3, file_col: str = "doc_key", pos_col: str = "fusion_pos") -> DataFrame:
    """The best ``cap`` per query: each file has ``per_file`` places first, and places left over go to the next in order. A file's first ``cap`` stand before its others, so these
    go before a query's rows are ordered."""
    in_file = F.row_number().over(Window.partitionBy("query_id", file_col).orderBy(pos_col))
    first = candidates.withColumn("in_file", in_file).where(F.col("in_file") <= cap)
    late = first.withColumn("late", (F.col("in_file") > max(1, per_file)).cast("int")).drop("in_file")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("late", pos_col))
    return late.withColumn("place", place).where(F.col("place") <= cap).drop("late", "place")


def rerank_scores(candidates: DataFrame, raw_col: str = "rerank_raw") -> DataFrame:
    """Add rerank_similarity and rerank_status from raw scores; a query with a score missing counts as failed and has none."""
    lost = F.max(F.col(raw_col).isNull().cast("int")).over(Window.partitionBy("query_id")) == 1
    marked = candidates.withColumn("rerank_status", F.when(lost, "failed").otherwise("ok"))
    return marked.withColumn("rerank_similarity", F.when(F.col("rerank_status") == "ok", rerank_probability(F.col(raw_col), ["query_id"])))


def rank_results(candidates: DataFrame, k: int, threshold: float | None = None, vector_weight: float = 0.35, rerank_weight: float = 0.65, relax: bool = False) -> DataFrame:
    """Sort by the combined score, drop distances over ``threshold``, keep a document's best chunk, take ``k``: in this order.

    ``relax``: a query of which nothing passes the threshold is ranked without it, and its rows say so (relaxed).
    """
    score = combine(F.col("vector_similarity"), F.col("rerank_similarity"), vector_weight, rerank_weight)
    scored = candidates.withColumn("final_similarity", score).withColumn("distance", to_distance(F.col("final_similarity")))
    per_query = Window.partitionBy("query_id")
    passed = F.lit(True) if threshold is None else F.col("distance") <= threshold
    scored = scored.withColumn("relaxed", ~F.max(passed).over(per_query) if relax and threshold is not None else F.lit(False))
    kept = scored.where(passed | F.col("relaxed"))
    order = [F.desc("final_similarity"), "fusion_pos"]
    best = kept.withColumn("in_doc", F.row_number().over(Window.partitionBy("query_id", "doc_key").orderBy(*order))).where("in_doc = 1").drop("in_doc")
    return best.withColumn("result_rank", F.row_number().over(per_query.orderBy(*order))).where(F.col("result_rank") <= k)


def effective_k(k: int, max_results: int = 10, n_chunks: int | None = None) -> int:
    return min(max(1, k), max_results, n_chunks if n_chunks is not None else max_results)


def candidate_depth(k: int, multiplier: int = 4, least: int = 16, n_chunks: int | None = None) -> int:
    depth = max(k * multiplier, least, k)
    return depth if n_chunks is None else min(depth, n_chunks)
