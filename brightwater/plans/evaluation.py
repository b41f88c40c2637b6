"""Queries over ranking metrics, latencies and dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import index_tokens
from ..operators import evaluation, retrieval, sparse
from ..sources.scratch import stored
from .common import chunks, index, items, plain, sql, table
from .search import _BM, QUERY_VIEW, SEARCH, _gated


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Benchmark passages as cases, and (case_id, positive): the documents that hold one word for word; passages found nowhere are negatives.

    A document that holds a passage holds all its tokens but perhaps the outer two, which may be cut from longer words. So passages
    meet documents at their rarest inner token, through the index, and the texts are compared there.
    """
    asked, c, held = items(spark, sf_dir), chunks(spark, sf_dir), index(spark, sf_dir)
    tokens = index_tokens(F.col("query"))
    inner = asked.select("query_id", F.explode(F.array_distinct(F.slice(tokens, 2, F.greatest(F.size(tokens) - 2, F.lit(0))))).alias("term"))
    inner = stored(inner, "inner")  # tables whose sizes are known, so that neither the index nor the texts move if these are small
    rarest = stored(held.terms.join(inner, "term").groupBy("query_id").agg(F.min_by("term", F.struct("df", "term")).alias("term")), "rarest")
    met = stored(sparse.spread(held.lists.join(rarest, "term")).select("query_id", "chunk_id"), "met")
    found = c.join(met, "chunk_id").join(asked, "query_id").where(F.contains("text", F.col("query")))
    positives = found.select(F.col("query_id").alias("case_id"), F.col("filename").alias("positive"))
    n = positives.groupBy("case_id").agg(F.count("*").alias("n"))
    cases = asked.select(F.col("query_id").alias("case_id")).join(n, "case_id", "left").select("case_id", F.coalesce("n", F.lit(0)).alias("total"), F.col("n").isNull().alias("expect_no_source"))
    return cases, positives


def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best ten documents per passage; those with less than half the score of the best are not shown."""
    best = F.max("bm25_score").over(Window.partitionBy("query_id"))
    found = sparse.search(items(spark, sf_dir), index(spark, sf_dir), 10).withColumn("best", best).where("bm25_score >= best * 0.5")
    shown = found.join(chunks(spark, sf_dir).select("chunk_id", "filename"), "chunk_id")
    return shown.select(F.col("query_id").alias("case_id"), F.col("bm25_rank").alias("rank"), F.upper(F.replace("filename", F.lit("/"), F.lit("\\"))).alias("doc"))


def q_hit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(evaluation.flags(_retrieved(spark, sf_dir), *_cases(spark, sf_dir)).select("case_id", "rank", "hit"))


def _per_case(spark: SparkSession, sf_dir: str, retrieved=_retrieved) -> DataFrame:
    cases, positives = _cases(spark, sf_dir)
    return evaluation.case_metrics(evaluation.flags(retrieved(spark, sf_dir), cases, positives), cases)


def q_case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _per_case(spark, sf_dir)
    return plain(m.select("case_id", "expect_no_source", "n_returned", *[F.round(c, 6).alias(c) for c in m.columns[3:]]))


def _rounded(s: DataFrame) -> DataFrame:
    return plain(s.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes]))


def q_eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluation.summary(_per_case(spark, sf_dir)))


def _admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gate admits of the whole search, each file once."""
    found = retrieval.first_of_files(_gated(spark, sf_dir), 10)
    return found.select(F.col("query_id").alias("case_id"), "rank", F.col("filename").alias("doc"))


def q_gated_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the whole search behind the evidence gate."""
    return _rounded(evaluation.summary(_per_case(spark, sf_dir, _admitted)))


def q_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), "value", ["event_type"])


def q_latency_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.latency(table(spark, sf_dir, "events"), "value")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluation.summary(_per_case(spark, sf_dir)).select(F.round("recall_5", 6).alias("recall@5"), F.round("ndcg_10", 6).alias("ndcg@10"))
    return s.crossJoin(evaluation.latency(table(spark, sf_dir, "events"), "value").select(F.col("p95_ms").alias("latency_p95_ms")))  # one row each


def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report in long form against its targets; recall@3 is not in it."""
    return evaluation.kpis(spark, _report(spark, sf_dir), {"ndcg@10": 0.3})


def q_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"recall@5": ("min", 0.85), "ndcg@10": ("min", 0.99), "latency_p95_ms": ("max", 300)}
    return evaluation.quality_gates(_report(spark, sf_dir), limits)


def q_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean value per day as a polyline."""
    days = table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.avg("value").alias("v"))
    return evaluation.trend(days, "v", "day").select("day", F.round("x", 5).alias("x"), F.round("y", 5).alias("y"))


def q_label_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by price against urgent ones as positives: metrics per customer where a list holds each document once."""
    o = table(spark, sf_dir, "orders")
    ranked = o.withColumn("rank", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")))
    retrieved = ranked.where("rank <= 10").select(F.col("o_custkey").alias("case_id"), "rank", F.col("o_orderkey").cast("string").alias("doc"))
    urgent = o.groupBy("o_custkey").agg(F.collect_list(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey").cast("string"))).alias("positives"))
    cases = urgent.select(F.col("o_custkey").alias("case_id"), "positives", (F.size("positives") == 0).alias("expect_no_source"))
    m = evaluation.case_metrics(evaluation.flags(retrieved, cases), cases)
    return plain(m.select("case_id", F.round("recall_5", 6).alias("recall_5"), F.round("precision_5", 6).alias("precision_5"), F.round("ndcg_10", 6).alias("ndcg_10"), F.round("reciprocal_rank", 6).alias("reciprocal_rank")))


QUERIES = {f.__name__: f for f in (q_hit_flags, q_case_metrics, q_eval_summary, q_gated_evaluation, q_latency, q_latency_all, q_kpis, q_quality_gates, q_trend, q_label_ndcg)}

_ITEM_CASES = """
  cases AS (SELECT b.query_id AS case_id, count(c.chunk_id) AS total, count(c.chunk_id) = 0 AS expect_no_source FROM bq b LEFT JOIN chunks c ON contains(c.text, b.query) GROUP BY 1)"""
_CASES = f"""{QUERY_VIEW}, {_BM}, {_ITEM_CASES}, top AS (SELECT query_id, max(bm25_score) AS best FROM bmr GROUP BY 1),
  ret AS (SELECT r.query_id AS case_id, r.bm25_rank AS rank, contains(c.text, q.query) AS hit FROM bmr r JOIN chunks c USING (chunk_id) JOIN bq q ON q.query_id = r.query_id JOIN top t ON t.query_id = r.query_id WHERE bm25_rank <= 10 AND bm25_score >= best * 0.5)"""
_GATED = f"""{SEARCH}, {QUERY_VIEW}, {_ITEM_CASES},
  ret AS (SELECT query_id AS case_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank, contains(text, query) AS hit FROM gated)"""
_KS = (1, 3, 5, 10)
_METRICS = ", ".join(
    f"""CASE WHEN total > 0 THEN least(1.0::DOUBLE, h{k}::DOUBLE / total) ELSE 0.0 END AS recall_{k}, CASE WHEN n_returned > 0 THEN h{k}::DOUBLE / least({k}, n_returned) ELSE 0.0 END AS precision_{k}, CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END AS hit_{k}"""
    for k in _KS
)
_METRICS_OF = f"""hits AS (SELECT case_id, {", ".join(f"count(*) FILTER (hit AND rank <= {k}) AS h{k}" for k in _KS)}, min(rank) FILTER (hit) AS first_hit, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg, count(*) AS n FROM ret GROUP BY 1),
  j AS (SELECT c.case_id, total, expect_no_source, coalesce(n, 0) AS n_returned, {", ".join(f"coalesce(h{k}, 0) AS h{k}" for k in _KS)}, first_hit, coalesce(dcg, 0) AS dcg FROM cases c LEFT JOIN hits USING (case_id)),
  m AS (SELECT case_id, expect_no_source, n_returned, {_METRICS}, coalesce(1.0::DOUBLE / first_hit, 0) AS reciprocal_rank, CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(total, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0.0 END AS ndcg_10 FROM j)"""
_PER = f"{_CASES}, {_METRICS_OF}"
_NAMES = [f"{m}_{k}" for k in _KS for m in ("recall", "precision", "hit")] + ["reciprocal_rank", "ndcg_10"]
_SUMMARY_OF = f"""s AS (SELECT count(*) AS cases, count(*) FILTER (NOT expect_no_source) AS positive_cases, count(*) FILTER (expect_no_source) AS negative_cases, {", ".join(f"round(coalesce(avg({n}) FILTER (NOT expect_no_source), 0), 6) AS {n}" for n in _NAMES)},
  round(avg(CASE WHEN n_returned > 0 THEN 1.0 ELSE 0.0 END) FILTER (expect_no_source), 6) AS false_recall_rate, coalesce(string_agg(CASE WHEN expect_no_source AND n_returned > 0 THEN case_id::VARCHAR END, ',' ORDER BY case_id), '') AS false_recall_ids FROM m),
  l AS (SELECT round(quantile_cont(value, 0.95), 3) AS p95 FROM events)"""
_SUMMARY = f"{_PER}, {_SUMMARY_OF}"
_LAT = "round(avg(value), 3) AS avg_ms, round(quantile_cont(value, 0.5), 3) AS p50_ms, round(quantile_cont(value, 0.95), 3) AS p95_ms, round(max(value), 3) AS max_ms FROM events"
ORACLES = {
    "q_hit_flags": sql("chunks", f"{_CASES} SELECT * FROM ret"),
    "q_case_metrics": sql("chunks", f"{_PER} SELECT case_id, expect_no_source, n_returned, {', '.join(f'round({n}, 6) AS {n}' for n in _NAMES)} FROM m"),
    "q_eval_summary": sql("chunks", f"{_SUMMARY} SELECT * FROM s"),
    "q_gated_evaluation": sql("chunks vchunks items", f"{_GATED}, {_METRICS_OF}, {_SUMMARY_OF} SELECT * FROM s"),
    "q_latency": f"SELECT event_type, {_LAT} GROUP BY 1",
    "q_latency_all": f"SELECT {_LAT}",
    "q_kpis": sql("chunks", f"""{_SUMMARY}, k AS (SELECT 'recall@5' AS key, 'Recall@5' AS label, recall_5 AS value, 0.85::DOUBLE AS target, 'up' AS direction, '' AS unit FROM s UNION ALL SELECT 'recall@3', 'Recall@3', NULL, 0.75, 'up', ''
      UNION ALL SELECT 'ndcg@10', 'NDCG@10', ndcg_10, 0.3, 'up', '' FROM s UNION ALL SELECT 'latency_p95_ms', '检索 p95', p95, 300, 'down', 'ms' FROM l)
      SELECT *, CASE WHEN value IS NULL THEN '—' WHEN unit = 'ms' THEN printf('%.0f', value) || ' ms' ELSE printf('%.3f', value) END AS display, CASE WHEN direction = 'up' THEN '≥ ' ELSE '≤ ' END || CASE WHEN unit = 'ms' THEN printf('%.0f', target) || ' ms' ELSE printf('%.2f', target) END AS target_display,
      CASE WHEN value IS NULL THEN 'unknown' WHEN (direction = 'down' AND value <= target) OR (direction = 'up' AND value >= target) THEN 'pass' ELSE 'fail' END AS status FROM k"""),
    "q_quality_gates": sql("chunks", f"{_SUMMARY} SELECT 'recall@5' AS name, recall_5 AS value, 0.85::DOUBLE AS \"limit\", 'min' AS kind, recall_5 >= 0.85 AS passed FROM s UNION ALL SELECT 'ndcg@10', ndcg_10, 0.99, 'min', ndcg_10 >= 0.99 FROM s UNION ALL SELECT 'latency_p95_ms', p95, 300, 'max', p95 <= 300 FROM l"),
    "q_trend": "WITH d AS (SELECT strftime(ts, '%Y-%m-%d') AS day, avg(value) AS v FROM events GROUP BY 1), w AS (SELECT day, v, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n, min(v) OVER () AS lo, max(v) OVER () AS hi FROM d) SELECT day, round(CASE WHEN n > 1 THEN i * 100.0::DOUBLE / (n - 1) ELSE 0 END, 5) AS x, round(CASE WHEN hi = lo THEN 20.0 ELSE 40.0 - (v - lo) / (hi - lo) * 40.0 END, 5) AS y FROM w",
    "q_label_ndcg": """WITH r AS (SELECT o_custkey AS c, o_orderpriority = '1-URGENT' AS hit, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
      a AS (SELECT c, count(*) FILTER (hit) AS total, count(*) FILTER (hit AND rank <= 5) AS h5, count(*) FILTER (rank <= 10) AS n, min(rank) FILTER (hit AND rank <= 10) AS f, coalesce(sum(1 / log2(rank + 1)) FILTER (hit AND rank <= 10), 0) AS dcg FROM r GROUP BY 1)
      SELECT c AS case_id, round(CASE WHEN total > 0 THEN h5::DOUBLE / total ELSE 0 END, 6) AS recall_5, round(h5::DOUBLE / least(5, n), 6) AS precision_5, round(CASE WHEN total > 0 THEN dcg / list_sum(list_transform(range(1, least(total, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg_10, round(coalesce(1.0::DOUBLE / f, 0), 6) AS reciprocal_rank FROM a""",
}
