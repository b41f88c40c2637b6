"""Models as functions, evaluation runs, leak stripping, finished streams."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwater.functions import text
from brightwater.operators import documents, fusion, models, retrieval, runner
from brightwater.operators.evidence import EvidencePolicy
from brightwater.sources import files
from brightwater.streaming import channels


def letters():
    """A stand-in model: counts of letters."""
    return lambda texts: np.array([[t.count(c) + 1e-9 for c in "abc"] for t in texts])


def test_embedding(spark):
    rows = spark.createDataFrame([(i, "a" * i + "b") for i in range(40)] + [(99, None)], "id int, text string")
    out = {r.id: r for r in models.embed(rows, letters, "letters").collect()}
    assert out[99].embedding is None and out[3].model == "letters"
    assert out[3].embedding == pytest.approx([3 / 10**0.5, 1 / 10**0.5, 0], abs=1e-6)


def lengths():
    def score(query, texts):
        if query == "bad":
            raise RuntimeError
        return None if query == "none" else [len(t) / 10 for t in texts]

    return score


def test_reranking(spark):
    rows = spark.createDataFrame([("q", "abc"), ("q", "abcdef"), ("bad", "x"), ("none", "y")], "query string, text string").withColumn("query_id", F.col("query"))
    out = {(r.query, r.text): (r.rerank_similarity, r.rerank_status) for r in fusion.rerank_scores(models.rerank(rows, lengths)).collect()}
    assert out == {("q", "abc"): (0.3, "ok"), ("q", "abcdef"): (0.6, "ok"), ("bad", "x"): (None, "failed"), ("none", "y"): (None, "failed")}


def store(spark):
    rows = [(i, f"docs/{i % 5}.md", f"common topic{i % 5} text{i}") for i in range(15)]
    return models.embed(spark.createDataFrame(rows, "chunk_id long, filename string, text string"), letters, "letters").drop("model")


def test_search_with_a_reranker(spark):
    queries = models.embed(spark.createDataFrame([(1, "topic2 text7")], "query_id long, query string"), letters, "letters", text_col="query", out_col="vector").drop("model")
    out = retrieval.search(queries, store(spark), k=3, reranked=models.reranker(lengths)).collect()
    assert len(out) == 3 and all(r.rerank_status == "ok" for r in out)
    routed = retrieval.internal_context(queries, store(spark), "docs/2").collect()
    assert {r.filename for r in routed} == {"docs/2.md"}


def test_runs(spark, tmp_path):
    folder, golden = str(tmp_path / "store"), tmp_path / "g.jsonl"
    files.write_store(store(spark).select("chunk_id", "filename", "text"), folder)
    cases = [{"query": f"topic{i}", "positives": [f"docs/{i}.md"], "tags": ["t"]} for i in range(5)] + [{"query": "zzz", "expect_no_source": True}, {"query": "common", "expect_no_source": True}]
    golden.write_text("\n".join(map(json.dumps, cases)))
    args = ["--dataset", str(golden), "--store", folder, "--reports", str(tmp_path / "reports")]
    assert runner.main(["--dataset", str(golden), "--validate-only"]) == 0
    assert runner.main([*args, "--min-recall@5", "0.9"]) == 0
    assert runner.main([*args, "--max-false-recall", "0.1"]) == 1
    there, kpis, rows = runner.dashboard(spark, str(tmp_path / "reports"), "generated_at string, `recall@5` double, `ndcg@10` double")
    assert there and {r.key: r.status for r in kpis.collect()}["recall@5"] == "pass" and rows.count() == 2


def test_vectors_made_anew(spark):
    rows = models.embed(spark.createDataFrame([(1, "aab"), (2, "b"), (3, "c")], "chunk_id long, text string"), letters, "letters")
    changed = documents.update_chunk(rows, 2, "cc")
    assert {r.chunk_id: r.embedding is None for r in changed.collect()} == {1: False, 2: True, 3: False}
    other = changed.withColumn("model", F.when(F.col("chunk_id") == 3, "old").otherwise(F.col("model")))
    out = {r.chunk_id: (r.embedding, r.model) for r in models.refresh(other, letters, "Org/Letters", 3).collect()}
    assert out[2][0] == pytest.approx([0, 0, 1], abs=1e-6) and out[1][1] == "letters" and out[3][1] == "Org/Letters"


def test_gated_runs(spark, tmp_path):
    """The whole search behind the gate; a case with an error counts as failed and doesn't stop the others."""
    cases = spark.createDataFrame([(f"c{i}", f"topic{i}", [f"docs/{i}.md"], False) for i in range(3)] + [("n", "common", [], True)], "case_id string, query string, positives array<string>, expect_no_source boolean")
    policy = EvidencePolicy(min_vector_similarity=0.0, min_rerank_probability=0.0)
    search = runner.gated_search(store(spark), letters, policy, lengths)
    per_case, summary = runner.run(cases, search, top_k=5)
    s = summary.first()
    assert s.cases == 4 and s.failed == 0 and s.recall_10 > 0 and per_case.count() == 4

    def broken(queries, n):
        return search(queries, n).withColumn("error", F.when(F.col("query_id") == "c1", "lost"))

    rows = {r.case_id: r for r in runner.run(cases, broken, top_k=5)[0].collect()}
    assert rows["c1"].error == "lost" and rows["c1"].n_returned == 0 and rows["c0"].error is None
    assert runner.run(cases, lambda q, n: 1 / 0)[1].first().failed == 4
    times = runner.request_times(cases, search, 2, warm_up=1)
    row = runner.report(summary, "set", 1.0, times).first()
    assert times.count() == 2 and row.latency_p95_ms >= row.latency_p50_ms > 0 and runner.report(summary, "set", 1.0).first().latency_p95_ms is None


def test_leaks(spark):
    rows = ["plain", "x\nFinal answer: y", "Draft the Answer:\nkept", "so, the user question and constraint 1", "<think>t</think> a", "<thinking_summary>s</thinking_summary>b", None, "  ", "Final answer: first part\nmore of it\n答案: 42"]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, x string")
    assert [r.t for r in frame.select("i", text.strip_leak(F.col("x")).alias("t")).orderBy("i").collect()] == ["plain", "y", "kept", "", "a", "b", "", "", "first part\nmore of it\n答案: 42"]
    thought = spark.createDataFrame([("a\nWait, looking at the instruction again\nb",)], "x string")
    assert thought.select(text.clean_thinking(F.col("x"))).first()[0] == "a\n\nb"


def test_finished_streams(spark):
    rows = [("a", "thoughts first. Final answer: yes", "", None), ("b", "</think>x", "t<think>", "s"), ("c", "Final answer: z", "", None)]
    frame = spark.createDataFrame(rows, "request_id string, answer string, thinking string, summary string")
    out = {r.request_id: (r.answer, r.thinking, r.summary) for r in channels.finished(frame).collect()}
    assert out == {"a": ("yes", "thoughts first.", None), "b": ("x", "t", "s"), "c": ("z", "", None)}
    assert {r.request_id: r.answer for r in channels.finished(frame, mixed=False).collect()}["a"] == "thoughts first. Final answer: yes"
