"""Evaluation runs: a golden set through a search, its report, its dashboard and its gates."""

from __future__ import annotations

import argparse
import importlib
import sys
import time
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import golden
from ..sources.files import read_store
from . import evaluation, models, retrieval, sparse
from .evidence import EvidencePolicy

Search = Callable[[DataFrame, int], DataFrame]


def depth(top_k: int, ks: Sequence[int], ndcg_k: int) -> int:
    return max(top_k, ndcg_k, *ks)


def run(cases: DataFrame, search: Search, top_k: int = 10, ks: Sequence[int] = (1, 3, 5, 10), ndcg_k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(per case, summary): all cases in one batch. ``search`` maps (query_id, query) and a depth to (query_id, rank, filename), and perhaps ``error``:
    a case with one has no results, counts as failed and doesn't stop the others. If the search itself can't be planned, all cases have its error."""
    queries = cases.select(F.col("case_id").alias("query_id"), "query")
    try:
        found = search(queries, depth(top_k, ks, ndcg_k))
    except Exception as e:  # noqa: BLE001  a failed search is a result of the evaluation
        found = queries.select("query_id", F.lit(1).alias("rank"), F.lit(None).cast("string").alias("filename"), F.lit(f"{type(e).__name__}: {e}"[:300]).alias("error"))
    if "error" not in found.columns:
        found = found.withColumn("error", F.lit(None).cast("string"))
    errors = found.where("error is not null").groupBy(F.col("query_id").alias("case_id")).agg(F.min("error").alias("error"))
    good = found.where("error is null").select(F.col("query_id").alias("case_id"), "rank", F.col("filename").alias("doc")).join(errors.select("case_id"), "case_id", "left_anti")
    per_case = evaluation.case_metrics(evaluation.flags(good, cases), cases, ks, ndcg_k).join(errors, "case_id", "left")
    return per_case, evaluation.summary(per_case, ks, ndcg_k)


def bm25_search(chunks: DataFrame, index: sparse.Index | None = None) -> Search:
    """Documents by their best chunk."""
    index = index or sparse.index(chunks)
    files = chunks.select("chunk_id", "filename")

    def search(queries: DataFrame, n: int) -> DataFrame:
        scored = sparse.best(sparse.query_terms(queries), index, n, files).join(files, "chunk_id")
        best = scored.groupBy("query_id", "filename").agg(F.max("bm25_score").alias("bm25_score"), F.min("chunk_id").alias("chunk_id"))
        return sparse.top_n(best, "bm25_score", n, "rank")

    return search


def gated_search(chunks: DataFrame, embed: models.EmbedderFactory, policy: EvidencePolicy, rerank: models.RerankerFactory | None = None, hybrid: bool = True, **how) -> Search:
    """The whole search behind the evidence gate, each file once at its first place. chunks: chunk_id, filename, text, embedding."""
    index = sparse.index(chunks) if hybrid else None

    def search(queries: DataFrame, n: int) -> DataFrame:
        with_vectors = models.embed(queries, embed, "query", text_col="query", out_col="vector").drop("model")
        found = retrieval.gated_search(with_vectors, chunks, policy, n, hybrid=hybrid, index=index, reranked=models.reranker(rerank) if rerank else None, **how)
        return retrieval.first_of_files(found, n)

    return search


def request_times(cases: DataFrame, search: Search, n: int, top_k: int = 10, warm_up: int = 0) -> DataFrame:
    """(ms) of ``n`` cases asked one by one, the first in order of their ids, after ``warm_up`` more that don't count: what one user waits for."""
    some = cases.select(F.col("case_id").alias("query_id"), "query").orderBy("query_id").limit(n + warm_up)
    spark, times = cases.sparkSession, []
    for r in some.collect():  # as many as are asked for
        began = time.perf_counter()
        search(spark.createDataFrame([r], some.schema), top_k).collect()
        times.append((1000 * (time.perf_counter() - began),))
    return spark.createDataFrame(times[warm_up:], "ms double")


def report(summary: DataFrame, dataset: str, batch_seconds: float, times: DataFrame | None = None) -> DataFrame:
    """A report row: when, what, how long the batch took, the summary's figures under their usual names, and latency_avg_ms, _p50_ms, _p95_ms and
    _max_ms of single requests (``times``; null if none were timed)."""
    names = {c: c.replace("_", "@", 1) for c in summary.columns if c.startswith(("recall_", "precision_", "hit_", "ndcg_"))}
    now = datetime.now(timezone.utc).isoformat(timespec="seconds")
    row = summary.select(F.lit(now).alias("generated_at"), F.lit(dataset).alias("dataset_path"), F.lit(batch_seconds).alias("batch_seconds"), *[F.col(c).alias(names.get(c, c)) for c in summary.columns])
    figures = ("avg_ms", "p50_ms", "p95_ms", "max_ms")
    if times is None:
        return row.select("*", *[F.lit(None).cast("double").alias(f"latency_{x}") for x in figures])
    return row.crossJoin(evaluation.latency(times, "ms").select(*[F.col(x).alias(f"latency_{x}") for x in figures]))  # one row each


def dashboard(spark: SparkSession, folder: str, schema: str, history: int = 20) -> tuple[bool, DataFrame | None, DataFrame]:
    """(is there a report, its indicators, the latest reports)."""
    rows = golden.reports(spark, folder, schema).limit(max(1, min(200, history)))
    latest = golden.latest_report(spark, folder, schema)
    there = latest.count() > 0
    return there, evaluation.kpis(spark, latest) if there else None, rows


def named(path: str):
    """What ``module:name`` stands for: a factory of an embedder or a reranker."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: Sequence[str] | None = None) -> int:
    """Evaluate a search over a stored corpus: BM25, or with --embedder the whole gated search. Exit 1 if a gate fails."""
    p = argparse.ArgumentParser(description=main.__doc__)
    p.add_argument("--dataset", required=True)
    p.add_argument("--store")
    p.add_argument("--reports")
    p.add_argument("--ks", default="1,3,5,10")
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--embedder", help="module:factory; the store's chunks have vectors of the same model")
    p.add_argument("--reranker", help="module:factory")
    p.add_argument("--no-rerank", action="store_true")
    p.add_argument("--no-hybrid", action="store_true", help="vectors alone")
    p.add_argument("--latency-cases", type=int, default=0, help="cases that are timed one by one")
    p.add_argument("--warm-up", type=int, default=3, help="cases before these that don't count")
    p.add_argument("--validate-only", action="store_true")
    for gate in ("recall@3", "recall@5", "ndcg@10"):
        p.add_argument(f"--min-{gate}", type=float)
    p.add_argument("--max-p95", type=float, help="milliseconds")
    p.add_argument("--max-false-recall", type=float)
    args = p.parse_args(argv)
    ks = sorted({int(k) for k in args.ks.split(",") if k.strip()})
    spark = SparkSession.builder.getOrCreate()
    cases = golden.load_cases(spark, args.dataset)
    print(f"{cases.count()} cases, tags: {', '.join(r.tag for r in golden.tags(cases).collect()) or '-'}")
    if args.validate_only:
        return 0
    chunks = read_store(spark, args.store)
    if args.embedder:
        rerank = named(args.reranker) if args.reranker and not args.no_rerank else None
        search = gated_search(chunks, named(args.embedder), EvidencePolicy(), rerank, not args.no_hybrid)
    else:
        search = bm25_search(chunks)
    began = time.perf_counter()
    _, summary = run(cases, search, args.top_k, ks)
    summary = spark.createDataFrame(summary.collect(), summary.schema)  # one row
    took = round(time.perf_counter() - began, 3)
    row = report(summary, args.dataset, took, request_times(cases, search, args.latency_cases, args.top_k, args.warm_up) if args.latency_cases else None)
    if args.reports:
        golden.save_report(row, args.reports)
    limits = {g: ("min", v) for g in ("recall@3", "recall@5", "ndcg@10") if (v := getattr(args, f"min_{g}")) is not None and g in row.columns}
    limits |= {name: ("max", v) for name, v in (("latency_p95_ms", args.max_p95), ("false_recall_rate", args.max_false_recall)) if v is not None}
    row.show(truncate=False, vertical=True)
    failed = [r.name for r in evaluation.quality_gates(row, limits).collect() if r.passed is False] if limits else []
    print(f"gates failed: {', '.join(failed) or 'none'}")
    return int(bool(failed))


if __name__ == "__main__":
    sys.exit(main())
