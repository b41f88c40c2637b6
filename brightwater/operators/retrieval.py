"""From queries to sources, for batches of queries as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import band, clamp, relative, to_similarity
from ..functions.text import doc_key, preview, strip_ws
from . import dense, sparse
from .evidence import EvidencePolicy, gate
from .fusion import candidate_depth, diversify, effective_k, fuse, rank_results

REFUSAL = "根据当前知识库无法确定"


def candidates(queries: DataFrame, chunks: DataFrame, k: int = 5, hybrid: bool = True, verified: bool = True, index: sparse.Index | None = None) -> DataFrame:
    """Both channels to the candidate depth, fused, with missing cosines filled. queries: query_id, query, vector; chunks: chunk_id, filename, text, embedding.

    Chunks without a vector are found by their words alone, and so are queries without one. ``index``: that of the chunks, if there is one.
    """
    depth = candidate_depth(k)
    by_vector = dense.search(queries, chunks, depth)
    if hybrid:
        by_word = sparse.search(queries, index or chunks, depth)
    else:
        by_word = by_vector.select("query_id", "chunk_id", F.col("vector_similarity").alias("bm25_score"), F.col("vector_rank").alias("bm25_rank")).where(F.lit(False))
    fused = fuse(by_vector, by_word, depth)
    return dense.fill_missing(fused, chunks, queries, verified)


def search(queries: DataFrame, chunks: DataFrame, k: int = 5, threshold: float | None = None, cap: int = 8, per_file: int = 3, hybrid: bool = True, verified: bool = True, reranked=None, index: sparse.Index | None = None) -> DataFrame:
    """The whole search: channels, fusion, diversification before the costly ``reranked`` step (a function of the candidates
    with their text that adds rerank_similarity and rerank_status), combination, threshold with fallback, one chunk per document, k rows."""
    k = effective_k(k)
    found = candidates(queries, chunks, k, hybrid, verified, index)
    text = found.join(chunks.select("chunk_id", "filename", "text"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    text = diversify(text.withColumn("doc_key", doc_key(F.col("filename"))), max(k, cap), per_file)
    if reranked is None:
        text = text.withColumn("rerank_similarity", F.lit(None).cast("double")).withColumn("rerank_status", F.lit("disabled"))
    else:
        text = reranked(text)
    return rank_results(text, k, threshold, relax=True)


def gated_search(queries: DataFrame, chunks: DataFrame, policy: EvidencePolicy, k: int = 5, min_similarity: float = 0.0, **how) -> DataFrame:
    """From queries to the sources that the evidence gate admits, numbered: the whole search with its fallback, assembly, gate. ``how``: see ``search``."""
    return sources(search(queries, chunks, k, **how), policy, min_similarity)


def first_of_files(ranked: DataFrame, n: int) -> DataFrame:
    """(query_id, rank, filename): each file once, at its first place, numbered anew; ``n`` per query."""
    places = ranked.groupBy("query_id", "filename").agg(F.min("rank").alias("at"))
    numbered = places.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at", "filename")))
    return numbered.where(F.col("rank") <= n).select("query_id", "rank", "filename")


def internal_context(queries: DataFrame, chunks: DataFrame, prefix: str, k: int = 8) -> DataFrame:
    """What internal documents have on the queries, for routing: (query_id, filename, text, similarity at four digits)."""
    found = search(queries, chunks.where(F.col("filename").startswith(prefix)), k)
    return found.select("query_id", "filename", "text", F.round("final_similarity", 4).alias("similarity"), "result_rank")


def assemble(results: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """Source rows: similarity, its band, the share of the best, rank and preview."""
    shown = results.withColumn("shown", to_similarity(F.col("distance"))).where(F.col("shown") >= min_similarity).drop("shown")
    shown = shown.withColumn("similarity", F.round("final_similarity", 4)).withColumn("score_label", band(F.col("final_similarity"))).withColumn("preview_text", preview(F.col("text")))
    return renumber(shown)


def renumber(sources: DataFrame) -> DataFrame:
    ranked = sources.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("result_rank")))
    return ranked.withColumn("relative_similarity", relative(F.col("similarity"), ["query_id"]))


def sources(results: DataFrame, policy: EvidencePolicy, min_similarity: float = 0.0) -> DataFrame:
    """Assembled sources that the gate admits, numbered anew."""
    return renumber(gate(assemble(results, min_similarity), policy).where("passed"))


def context(ranked: DataFrame, max_chars: int = 5000) -> DataFrame:
    """(query_id, context): numbered blocks while they fit; the first always does, blank texts keep their number and take no room."""
    text, name = strip_ws(F.coalesce("text", F.lit(""))), strip_ws(F.coalesce("filename", F.lit("")))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.when(name == "", F.concat(F.lit("doc_"), F.col("rank").cast("string"))).otherwise(name), F.lit("\n"), text)
    blocks = ranked.withColumn("block", block).where(text != "").select("query_id", "rank", "block")
    order = Window.partitionBy("query_id").orderBy("rank")
    fitted = blocks.withColumn("n", F.row_number().over(order)).withColumn("room", F.sum(F.length("block")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fitted = fitted.where((F.col("n") == 1) | (F.col("room") <= max_chars))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda x: x["block"])
    return fitted.groupBy("query_id").agg(F.array_join(ordered, "\n\n").alias("context"))


def shown_sources(admitted: DataFrame, statuses: DataFrame, least: float = 0.0) -> DataFrame:
    """What a client shows: sources of a similarity of ``least`` or more, none of queries whose status is insufficient."""
    return admitted.join(statuses.where("status <> 'insufficient'").select("query_id"), "query_id", "left_semi").where(F.col("similarity") >= least)


def answers_or_refusals(queries: DataFrame, admitted: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """(query_id, n_sources, status, refusal): queries without a source get the fixed refusal. ``tools`` (query_id): queries that a tool has
    answered; without a source their status is mcp_only and they are not refused."""
    n = admitted.groupBy("query_id").agg(F.count("*").alias("n_sources"))
    joined = queries.select("query_id").join(n, "query_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)))
    called = F.lit(False)
    if tools is not None:
        joined = joined.join(tools.select("query_id", F.lit(True).alias("called")).distinct(), "query_id", "left")
        called = F.coalesce("called", F.lit(False))
    status = F.when(F.col("n_sources") > 0, "sufficient").when(called, "mcp_only").otherwise("insufficient")
    return joined.withColumn("status", status).drop("called").withColumn("refusal", F.when(F.col("status") == "insufficient", REFUSAL))


def prompts(queries: DataFrame, contexts: DataFrame, with_context: str, without: str, system: str | None = None, deep: str | None = None) -> DataFrame:
    """(query_id, system_prompt, user_prompt, grounded) from templates of the caller's; {question} and {context} are filled in.

    ``deep``: what the system prompt of queries with ``deep_think`` has in addition, behind an empty line.
    """
    joined = queries.join(contexts, "query_id", "left")
    filled = F.replace(F.replace(F.lit(with_context), F.lit("{context}"), F.coalesce("context", F.lit(""))), F.lit("{question}"), F.col("query"))
    user = F.when(F.col("context").isNotNull(), filled).otherwise(F.replace(F.lit(without), F.lit("{question}"), F.col("query")))
    deeper = F.coalesce("deep_think", F.lit(False)) if deep and "deep_think" in queries.columns else F.lit(False)
    head = F.when(deeper, F.concat_ws("\n\n", F.lit(system), F.lit(deep))).otherwise(F.lit(system).cast("string"))
    return joined.select("query_id", head.alias("system_prompt"), user.alias("user_prompt"), F.col("context").isNotNull().alias("grounded"))


def min_similarity(override: float | None, configured: float | None) -> float:
    for value in (override, configured):
        if value is not None:
            return max(0.0, min(1.0, float(value)))
    return 0.0


__all__ = ["answers_or_refusals", "assemble", "candidates", "clamp", "context", "min_similarity", "prompts", "renumber", "search", "sources"]
