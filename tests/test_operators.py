"""Operators on small tables."""

import itertools
import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brightwater.operators import chunking, configs, dense, documents, evaluation, evidence, fusion, history, retrieval, sparse


def test_rrf(spark):
    a = spark.createDataFrame([("q", 0, 1), ("q", 1, 2), ("q", 2, 3)], "query_id string, chunk_id int, rank int")
    b = spark.createDataFrame([("q", 1, 1), ("q", 3, 2), ("q", 0, 3)], "query_id string, chunk_id int, rank int")
    out = fusion.rrf(a, b).orderBy("fusion_pos").collect()
    assert [r.chunk_id for r in out] == [1, 0, 3, 2]
    assert out[0].rrf_score == pytest.approx(1 / 62 + 1 / 61)
    assert fusion.rrf(a.limit(0), b.limit(0)).collect() == []


def test_fusion_degrades_to_one_channel(spark):
    v = spark.createDataFrame([("a", 1, 0.9, 1), ("b", 1, 0.8, 1)], "query_id string, chunk_id int, vector_similarity double, vector_rank int")
    w = spark.createDataFrame([("b", 2, 5.0, 1), ("c", 3, 4.0, 1)], "query_id string, chunk_id int, bm25_score double, bm25_rank int")
    out = {(r.query_id, r.chunk_id): r for r in fusion.fuse(v, w, 10).collect()}
    assert {q: out[q, c].channel for q, c in out} == {"a": "vector_only", "b": "hybrid_rrf", "c": "bm25_only"}
    assert out["a", 1].rrf_score is None and out["b", 2].vector_similarity is None and out["b", 2].channels == ["bm25"]


def candidates(spark, files):
    return spark.createDataFrame([("q", i, f, i) for i, f in enumerate(files)], "query_id string, chunk_id int, doc_key string, fusion_pos int")


def test_diversify(spark):
    out = [r.doc_key for r in fusion.diversify(candidates(spark, "LLLLLLOT"), 4, 2).orderBy("fusion_pos").collect()]
    assert out == ["L", "L", "O", "T"]
    assert [r.fusion_pos for r in fusion.diversify(candidates(spark, "LLLLLL"), 4, 2).orderBy("fusion_pos").collect()] == [0, 1, 2, 3]


def test_failed_rerank_has_no_scores(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 0.5)], "query_id string, rerank_raw double")
    out = {(r.query_id, r.rerank_status): r.rerank_similarity for r in fusion.rerank_scores(rows).collect()}
    assert out == {("a", "failed"): None, ("b", "ok"): 0.5}


def test_threshold_falls_back(spark):
    rows = [("a", 1, "x", 0.9, 1), ("a", 2, "x", 0.8, 2), ("a", 3, "y", 0.1, 3), ("b", 4, "z", 0.2, 1)]
    frame = spark.createDataFrame(rows, "query_id string, chunk_id int, doc_key string, vector_similarity double, fusion_pos int").withColumn("rerank_similarity", F.lit(None).cast("double"))
    out = [(r.query_id, r.chunk_id, r.relaxed) for r in fusion.rank_results(frame, 5, threshold=1.0, relax=True).orderBy("query_id", "result_rank").collect()]
    assert out == [("a", 1, False), ("b", 4, True)]
    assert fusion.rank_results(frame, 5, threshold=1.0).count() == 1


def test_depths():
    assert (fusion.effective_k(0), fusion.effective_k(50), fusion.effective_k(5, 10, 3)) == (1, 10, 3)
    assert (fusion.candidate_depth(2), fusion.candidate_depth(10), fusion.candidate_depth(10, n_chunks=7)) == (16, 40, 7)


def truth(vector, rerank, status, matched, p):
    """The gate's rules, case by case."""
    ready = rerank is not None and (status or "ok") == "ok"
    if matched is False:
        if ready and rerank >= p.entity_miss_rerank_probability:
            return "rerank_strict"
        return "vector_strict" if not ready and vector is not None and vector >= p.strong_vector_similarity else evidence.ENTITY_ABSENT
    if ready:
        if rerank >= p.min_rerank_probability:
            return "rerank"
        return "vector_strong" if vector is not None and vector >= p.strong_vector_similarity else evidence.RERANK_SAYS_NO
    if vector is None:
        return evidence.NO_SCORE
    return "vector" if vector >= p.min_vector_similarity else evidence.WEAK_VECTOR


def test_gate_truth_table(spark):
    p = evidence.EvidencePolicy()
    cases = list(itertools.product([None, 0.3, 0.5, 0.62, 0.8, math.nan], [None, 0.2, 0.6, 0.83], [None, "ok", "failed", "disabled"], [None, True, False]))
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, v double, r double, s string, m boolean")
    out = frame.select("i", evidence.judge(F.col("v"), F.col("r"), F.col("s"), F.col("m"), p).alias("j")).orderBy("i").collect()
    for (v, r, s, m), row in zip(cases, out):
        basis = truth(None if v is not None and math.isnan(v) else v, r, s, m, p)
        assert (row.j.basis, row.j.passed) == (basis, basis in ("rerank_strict", "vector_strict", "rerank", "vector_strong", "vector"))


def test_gate(spark):
    rows = [("a", "PMP rules", "the pmp book", "f", None, 0.6, "ok"), ("a", "PMP rules", "other", "f", None, 0.6, "ok"), ("b", "rules", "x", "f", 0.1, None, None), ("c", "KB-10", "kb ten", "f", None, 0.6, "ok")]
    frame = spark.createDataFrame(rows, "query_id string, query string, text string, filename string, vector_similarity double, rerank_similarity double, rerank_status string")
    out = {(r.query_id, r.text): r for r in evidence.gate(frame, evidence.EvidencePolicy(aliases={"kb-10": ["kb ten"]})).collect()}
    assert {k: (r.passed, r.entity_matched, r.status) for k, r in out.items()} == {("a", "the pmp book"): (True, True, "sufficient"), ("a", "other"): (False, False, "sufficient"), ("b", "x"): (False, None, "insufficient"), ("c", "kb ten"): (True, True, "sufficient")}
    assert {r.basis for r in evidence.gate(frame, evidence.EvidencePolicy(enabled=False)).collect()} == {"disabled"}


def test_policy_from_config():
    p = evidence.EvidencePolicy.from_config({"enabled": "off", "min_rerank_probability": 7, "min_vector_similarity": "nan", "strong_vector_similarity": None, "aliases": {"A ": ["b", "B", "a"], "x": []}}, {"a": ["c"]})
    assert (p.enabled, p.min_rerank_probability, p.min_vector_similarity, p.strong_vector_similarity, p.aliases) == (False, 1.0, 0.5, 0.75, {"a": ["c", "b"]})
    assert evidence.EvidencePolicy.from_config(None) == evidence.EvidencePolicy()


def test_bm25_against_the_formula(spark):
    docs = ["apple banana apple", "banana cherry", "", "cherry cherry date"]
    chunks = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "chunk_id long, text string")
    queries = spark.createDataFrame([(1, "apple cherry cherry"), (2, "nothing"), (3, "")], "query_id long, query string")
    out = {r.chunk_id: r.bm25_score for r in sparse.search(queries, chunks).collect()}
    tokens = [d.split() for d in docs]
    mean = sum(map(len, tokens)) / 4
    expected = {}
    for i, t in enumerate(tokens):
        for w in ("apple", "cherry"):
            if n := t.count(w):
                df = sum(w in x for x in tokens)
                expected[i] = expected.get(i, 0) + math.log(1 + (4 - df + 0.5) / (df + 0.5)) * n * 2.5 / (n + 1.5 * (0.25 + 0.75 * len(t) / mean))
    assert out == pytest.approx(expected)


def test_pruned_search_is_exact(spark):
    """The best of a query by chunk and by file, with common words in every text, ties and fewer chunks than are asked for."""
    r = random.Random(3)
    word = lambda: "w" + str(min(int(r.expovariate(0.08)), 60))
    rows = [(i, f"f{i % 40}", " ".join(["the of", *(word() for _ in range(r.randint(0, 30)))])) for i in range(300)] + [(400 + i, "same", "the same text w3") for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, filename string, text string")
    queries = spark.createDataFrame([(q, " ".join(["the", "of", *(word() for _ in range(q % 7))])) for q in range(40)] + [(90, "w3 w3"), (91, "the same"), (92, None)], "query_id long, query string")
    index = sparse.index(chunks)
    terms, full = sparse.query_terms(queries), sparse.bm25(sparse.query_terms(queries), index.postings, index.stats)
    key = lambda f: [(r.query_id, r.rank, r.chunk_id, round(r.s, 7)) for r in f.orderBy("query_id", "rank").collect()]
    for n in (1, 5, 1000):
        pruned = sparse.best(terms, index, n)
        assert key(sparse.top_n(pruned.withColumnRenamed("bm25_score", "s"), "s", n, "rank")) == key(sparse.top_n(full.withColumnRenamed("bm25_score", "s"), "s", n, "rank"))
    files = chunks.select("chunk_id", "filename")
    by_file = lambda f: f.join(files, "chunk_id").groupBy("query_id", "filename").agg(F.max("bm25_score").alias("s")).withColumnRenamed("filename", "chunk_id")
    assert key(sparse.top_n(by_file(sparse.best(terms, index, 5, files)), "s", 5, "rank")) == key(sparse.top_n(by_file(full), "s", 5, "rank"))
    assert sparse.search(queries, chunks.limit(0)).collect() == []


def test_dense_products_are_cut(spark, monkeypatch):
    rows = [(i, [float(i % 13), float(i % 7), 1.0]) for i in range(200)]
    chunks, queries = spark.createDataFrame(rows, "chunk_id long, embedding array<float>"), spark.createDataFrame([(i, v) for i, v in rows[:30]] + [(99, None)], "query_id long, vector array<float>")
    whole = [tuple(r) for r in dense.search(queries, chunks, 4).orderBy("query_id", "vector_rank").collect()]
    monkeypatch.setattr(dense, "PRODUCT_BYTES", 3000)
    assert [tuple(r) for r in dense.search(queries, chunks, 4).orderBy("query_id", "vector_rank").collect()] == whole and len(whole) == 120


def test_dense_search_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "BLOCK_BYTES", 60)
    chunks = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(30)] + [(99, None), (98, [1.0])], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "query_id long, vector array<float>")
    out = dense.search(queries, chunks, 3).orderBy("query_id", "vector_rank").collect()
    assert [(r.query_id, r.chunk_id) for r in out] == [(1, 29), (1, 28), (1, 27), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2)]


def test_missing_cosines(spark):
    chunks = spark.createDataFrame([(1, [0.6, 0.8, 0.0, 0.0])], "chunk_id long, embedding array<float>")
    queries = spark.createDataFrame([("q", [0.0, 1.0, 0.0, 0.0])], "query_id string, vector array<float>")
    found = spark.createDataFrame([("q", 1, None)], "query_id string, chunk_id long, vector_similarity double")
    r = dense.fill_missing(found, chunks, queries, True).first()
    assert r.vector_similarity == pytest.approx(0.8) and r.vector_score_source == "computed"
    assert dense.fill_missing(found, chunks, queries, False).first().vector_similarity is None


def test_whole_search(spark):
    chunks = spark.createDataFrame([(i, f"d/{i % 4}.txt", f"word{i} common text", [float(i == 3), 1.0]) for i in range(12)], "chunk_id long, filename string, text string, embedding array<float>")
    queries = spark.createDataFrame([(1, "word5 common", [1.0, 0.0])], "query_id long, query string, vector array<float>")
    found = retrieval.search(queries, chunks, k=3)
    out = found.orderBy("result_rank").collect()
    assert len(out) == 3 and out[0].chunk_id == 3 and len({r.doc_key for r in out}) == 3
    shown = retrieval.assemble(found).orderBy("rank").collect()
    assert shown[0].relative_similarity == 1.0 and [r.rank for r in shown] == [1, 2, 3]
    only_words = retrieval.search(queries, chunks, k=3, hybrid=False)
    assert {r.channel for r in only_words.collect()} == {"vector_only"}


def test_context_budget(spark):
    rows = [(1, 1, "a", "x" * 50), (1, 2, "b", "  "), (1, 3, "", "y" * 30), (1, 4, "d", "z" * 50), (1, 5, "e", "w"), (2, 1, "big", "v" * 500)]
    out = {r.query_id: r.context for r in retrieval.context(spark.createDataFrame(rows, "query_id int, rank int, filename string, text string"), 100).collect()}
    assert out[1] == "[1] a\n" + "x" * 50 + "\n\n[3] doc_3\n" + "y" * 30 and out[2] == "[1] big\n" + "v" * 500


def test_prompts_and_refusals(spark):
    queries = spark.createDataFrame([(1, "why"), (2, "how")], "query_id int, query string")
    context = spark.createDataFrame([(1, "[1] a")], "query_id int, context string")
    out = {r.query_id: (r.user_prompt, r.grounded) for r in retrieval.prompts(queries, context, "Q: {question}\n{context}", "no: {question}").collect()}
    assert out == {1: ("Q: why\n[1] a", True), 2: ("no: how", False)}
    got = retrieval.answers_or_refusals(queries, context.select("query_id")).orderBy("query_id").collect()
    assert [(r.status, r.refusal) for r in got] == [("sufficient", None), ("insufficient", retrieval.REFUSAL)]
    tools = retrieval.answers_or_refusals(queries, context.select("query_id"), spark.createDataFrame([(1,), (2,)], "query_id int")).orderBy("query_id")
    assert [(r.status, r.refusal) for r in tools.collect()] == [("sufficient", None), ("mcp_only", None)]
    found = spark.createDataFrame([(1, 0.9), (1, 0.2), (2, 0.9)], "query_id int, similarity double")
    assert [tuple(r) for r in retrieval.shown_sources(found, retrieval.answers_or_refusals(queries, context.select("query_id")), 0.5).collect()] == [(1, 0.9)]
    deep = retrieval.prompts(queries.withColumn("deep_think", F.col("query_id") == 2), context, "c {question}", "{question}", "sys", "more").orderBy("query_id").collect()
    assert [r.system_prompt for r in deep] == ["sys", "sys\n\nmore"]


def metrics(spark, docs, positives, **k):
    retrieved = spark.createDataFrame([(1, i + 1, d) for i, d in enumerate(docs)], "case_id int, rank int, doc string")
    cases = spark.createDataFrame([(1, positives, not positives)], "case_id int, positives array<string>, expect_no_source boolean")
    flagged = evaluation.flags(retrieved, cases)
    return [r.hit for r in flagged.orderBy("rank").collect()], evaluation.case_metrics(flagged, cases, **k).first()


def test_rank_metrics(spark):
    assert metrics(spark, ["Docs\\A.MD", "b.md"], ["docs/a.md"])[0] == [True, False]
    hits, m = metrics(spark, ["a", "a", "b"], ["a", "b"])
    assert hits == [True, False, True] and m.recall_3 == 1.0 and m.reciprocal_rank == 1.0
    assert metrics(spark, ["a", "x", "y", "z"], ["a"], ks=(4,))[1].precision_4 == 0.25
    assert metrics(spark, ["a", "b", "x"], ["a", "b"])[1].ndcg_10 == pytest.approx(1.0)
    assert metrics(spark, [], ["a"])[1].recall_5 == 0.0
    assert metrics(spark, ["x"], [])[1].ndcg_10 == 0.0


def test_summary(spark):
    cases = spark.createDataFrame([(1, ["a"], False), (2, ["b"], False), (3, [], True), (4, [], True)], "case_id int, positives array<string>, expect_no_source boolean")
    got = spark.createDataFrame([(1, 1, "x"), (1, 2, "a"), (3, 1, "x")], "case_id int, rank int, doc string")
    s = evaluation.summary(evaluation.case_metrics(evaluation.flags(got, cases), cases)).first()
    assert (s.recall_1, s.recall_3, s.reciprocal_rank, s.false_recall_rate, s.false_recall_ids) == (0.0, 0.5, 0.25, 0.5, [3])
    positive = cases.where("not expect_no_source")
    assert evaluation.summary(evaluation.case_metrics(evaluation.flags(got, positive), positive)).first().false_recall_rate is None


def test_any_number_of_positives(spark):
    """Positives as rows and as arrays give the same; repeated documents count once."""
    cases = spark.createDataFrame([(1, ["x/a.md", "b.md", "c/B.MD"], False), (2, [], True)], "case_id int, positives array<string>, expect_no_source boolean")
    got = spark.createDataFrame([(1, 1, "A.md"), (1, 2, "y\\b.md"), (1, 3, "a.md"), (1, 4, "aa.md"), (2, 1, "a.md"), (3, 1, "a.md")], "case_id int, rank int, doc string")
    key = lambda f: [(r.case_id, r.rank, r.hit) for r in f.orderBy("case_id", "rank").collect()]
    out = key(evaluation.flags(got, cases))
    assert out == [(1, 1, True), (1, 2, True), (1, 3, False), (1, 4, False), (2, 1, False)]
    rows, bare = evaluation.positive_rows(cases), cases.select("case_id", F.size("positives").alias("total"), "expect_no_source")
    assert key(evaluation.flags(got, bare, rows)) == out
    assert sorted(map(tuple, evaluation.case_metrics(evaluation.flags(got, bare, rows), bare).collect())) == sorted(map(tuple, evaluation.case_metrics(evaluation.flags(got, cases), cases).collect()))


def test_trend(spark):
    rows = [(f"d{i:03d}", float((i * 7) % 11)) for i in range(50)]
    out = [tuple(r) for r in evaluation.trend(spark.createDataFrame(rows, "day string, v double"), "v", "day").orderBy("day").collect()]
    assert out == [(d, pytest.approx(i * 100 / 49), pytest.approx(40 - v * 4)) for i, (d, v) in enumerate(rows)]
    assert [tuple(r) for r in evaluation.trend(spark.createDataFrame([("a", 3.0)], "day string, v double"), "v", "day").collect()] == [("a", 0.0, 20.0)]


def test_percentiles(spark):
    frame = lambda v: spark.createDataFrame([(float(x),) for x in v], "v double")
    assert tuple(evaluation.latency(frame([10, 20, 30]), "v").first()) == (20.0, 20.0, 29.0, 30.0)
    assert tuple(evaluation.latency(frame([]), "v").first()) == (0.0, 0.0, 0.0, 0.0)
    assert evaluation.latency(frame([7]), "v").first().p95_ms == 7.0


def test_dashboard(spark):
    report = spark.createDataFrame([(0.9, 0.5, 310.4)], "`recall@5` double, `ndcg@10` double, latency_p95_ms double")
    out = {r.key: (r.status, r.display, r.target_display) for r in evaluation.kpis(spark, report).collect()}
    assert out == {"recall@5": ("pass", "0.900", "≥ 0.85"), "recall@3": ("unknown", "—", "≥ 0.75"), "ndcg@10": ("fail", "0.500", "≥ 0.70"), "latency_p95_ms": ("fail", "310 ms", "≤ 300 ms")}
    gates = evaluation.quality_gates(report.withColumn("x", F.lit(None).cast("double")), {"recall@5": ("min", 0.85), "x": ("max", 1)})
    assert {r.name: r.passed for r in gates.collect()} == {"recall@5": True, "x": None}


def chunk(spark, x, size, overlap):
    return [r.text for r in chunking.chunk_documents(spark.createDataFrame([(1, x)], "i int, text string"), size, overlap).orderBy("chunk_index").collect()]


def test_chunking(spark):
    assert chunk(spark, "", 10, 2) == [] == chunk(spark, None, 10, 2)
    assert chunk(spark, "　short ", 10, 2) == ["short"]
    assert chunk(spark, "aaaa\r\n\r\nbbbb\n\ncccc", 9, 0) == ["aaaa\nbbbb", "cccc"]
    assert chunk(spark, "line one\nline two\nline three", 18, 0) == ["line one\nline two", "line three"]
    assert chunk(spark, "一二三。四五六！七八九", 5, 0) == ["一二三。", "四五六！", "七八九"]
    assert chunk(spark, "abcdefghij. klmnop", 6, 0) == ["abcdef", "ghij.", "klmnop"]
    # the next chunk begins with what follows the first line's last terminator in the overlap
    assert chunk(spark, "aa。bb\n\ncccc", 6, 5) == ["aa。bb", "bb\ncccc"]


def test_chunks_are_bounded(spark):
    x = "\n\n".join("w" * n for n in (5, 90, 100, 33, 250, 99))
    assert all(len(c) <= 100 + 20 + 1 for c in chunk(spark, x, 100, 20))


def test_overlap_trim(spark):
    frame = spark.createDataFrame([("ab。cd",), ("a!b?c\nd;e",), ("none",), ("x\ny。z",)], "x string")
    assert [r.t for r in frame.select(chunking.trim_overlap(F.col("x")).alias("t")).collect()] == ["cd", "c\nd;e", "none", "z"]


def store(spark):
    return spark.createDataFrame([(0, "a.txt", "one"), (1, "b.txt", "two"), (5, "a.txt", "three")], "chunk_id long, filename string, text string")


def test_changes_to_the_store(spark):
    c = store(spark)
    new = spark.createDataFrame([("x/A.TXT", "four"), ("new.txt", "five")], "filename string, text string")
    out = documents.upsert_documents(c, new).orderBy("chunk_id").collect()
    assert (out[0].chunk_id, out[0].filename, out[0].text) == (1, "b.txt", "two") and [r.chunk_id for r in out] == [1, 6, 7]
    assert {(r.filename, r.text) for r in out[1:]} == {("x/A.TXT", "four"), ("new.txt", "five")}
    assert [r.chunk_id for r in documents.delete_chunk(c, 1).orderBy("chunk_id").collect()] == [0, 5]
    assert documents.update_chunk(c, 1, "2").where("chunk_id = 1").first().text == "2"
    rebuilt = documents.rebuild_document(c, "A.txt").orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.text) for r in rebuilt] == [(1, "two"), (6, "one\nthree")]
    assert documents.clear(c).count() == 0
    internal = spark.createDataFrame([("b.txt", "now", True), ("a.txt", "gone", False)], "filename string, text string, is_active boolean")
    assert [(r.filename, r.text) for r in documents.resync_internal(c, internal).collect()] == [("b.txt", "now")]
    assert documents.upsert_documents(c.limit(0), new).count() == 2


def test_listings(spark):
    page = documents.list_chunks(store(spark), page=0, size=1, filename="dir/A.TXT").collect()
    assert [(r.chunk_id, r.chunk_index, r.total) for r in page] == [(0, 0, 2)]
    assert documents.list_chunks(store(spark), filename="a").count() == 0
    assert [r.filename for r in documents.list_documents(store(spark)).collect()] == ["a.txt", "b.txt"]
    assert tuple(documents.text_summary(store(spark).limit(0)).first()) == (0, 0, 0)


def log(spark):
    rows = [(1, "s1", "u", "query", "q1", "a1", 10), (2, "s2", None, "query", "q2", None, 20), (3, "s1", "v", "search", "q3", "a3", 30), (4, None, "u", "query", "q4", "a4", 40)]
    return spark.createDataFrame(rows, "id long, session_id string, user_id string, action string, query string, answer string, ts long").withColumn("timestamp", F.timestamp_seconds("ts"))


def test_history(spark):
    m = log(spark)
    assert [r.id for r in history.messages(m, "query", 2).collect()] == [2, 4] and history.messages(m, limit=0).count() == 0
    assert [(r.session_id, r["count"], r.first_query, r.user_id) for r in history.sessions_of_messages(m).collect()] == [("s1", 2, "q1", "u"), ("s2", 1, "q2", None)]
    s = spark.createDataFrame([("s1", "u", "t1", 1), ("s9", "u", "t9", 9)], "session_id string, user_id string, title string, updated_at long")
    assert [(r.session_id, r.first_query, r["count"]) for r in history.sessions_with_messages(s, m, "search").orderBy("session_id").collect()] == [("s1", "q3", 1), ("s9", "t9", 0)]
    new = spark.createDataFrame([(9, "", "u", "query", "q")], "id long, session_id string, user_id string, action string, query string").withColumn("timestamp", F.timestamp_seconds(F.lit(2)))
    assert history.append(m, new).where("id = 9").first().session_id == "system_query_2000"
    assert history.delete_session(m, "s1").count() == 2 and history.delete_message(m, 4).count() == 3
    context = history.chat_context(m, 1).where("session_id = 's1'").orderBy("seq").collect()
    assert [(r.role, r.content) for r in context] == [("user", "q1"), ("assistant", "a1")]
    assert history.chat_context(m, 1, cut_first=True).count() == 5
    assert history.issue_session_ids(m.where("user_id = 'u'")).orderBy("id").first().session_id == "s_u_1_10"


def test_visible_sessions(spark):
    s = spark.createDataFrame([("system_x", "me", "a"), ("1", "me", "b" * 40), ("2", None, "c"), ("3", "you", "d")], "session_id string, user_id string, first_query string")
    shown = lambda u: sorted(r.session_id for r in history.visible_sessions(s, u).collect())
    assert shown("me") == ["1", "2"] and shown("") == ["1", "2", "3"]
    assert sorted(r.session_id for r in history.visible_sessions(s.where("session_id = '3'"), "me").collect()) == ["3"]
    assert history.visible_sessions(s, "me").where("session_id = '1'").first().title == "b" * 36 + "…"


def test_restored_answers(spark):
    rows = [("a", None, ["p"]), (None, '[{"role":"assistant","content":"x"},{"role":"user","content":"y"}]', ["p"]), (None, "bad", ["p", "q"]), ("", None, [])]
    frame = spark.createDataFrame(rows, "a string, m string, p array<string>")
    assert [r.x for r in frame.select(history.restored_answer(F.col("a"), F.col("m"), F.col("p")).alias("x")).collect()] == ["a", "x", "p\n\nq", ""]


def test_configs(spark):
    c = spark.createDataFrame([(1, "b", "chat", True, False), (2, "a", "chat", True, True), (3, "c", "rerank", False, True)], "id long, name string, kind string, is_active boolean, is_default boolean")
    assert [r.id for r in configs.list_configs(c, "is_default").collect()] == [2, 3, 1]
    assert configs.default_config(c, "chat").first().id == 2 and configs.default_config(c, "rerank").count() == 0
    assert {r.id: r.is_default for r in configs.set_default(c, 1, "chat").collect()} == {1: True, 2: False, 3: True}
    assert [r.id for r in configs.search_configs(c, " CHAT", ["name", "kind"]).orderBy("id").collect()] == [1, 2]
    results = spark.createDataFrame([("q", 1, "__tool_1.md"), ("q", 2, "x.md"), ("q", 3, "__tool_1.md"), ("q", 4, "__tool_3.md")], "query_id string, rank int, filename string")
    assert [(r.id, r.rank) for r in configs.configs_of_documents(results, c, r"__tool_(\d+)").collect()] == [(1, 1)]


def test_settings():
    s = configs.RetrievalSettings()
    assert s.updated({"default_k": "7", "chunk_size": None}).default_k == 7 and s.updated({"hybrid_enabled": "off"}).hybrid_enabled is False
    for bad in ({"default_k": 11}, {"chunk_overlap": 800}, {"rrf_k": 0}, {"default_k": True}, {"chunk_size": "x"}, {"hybrid_enabled": "maybe"}):
        with pytest.raises(ValueError):
            s.updated(bad)


def test_settings_snapshot_and_apply():
    """What is in force, bounded; and a configuration with the settings in its sections."""
    s = configs.RetrievalSettings.snapshot({"rrf_k": 999, "chunk_overlap": 0, "hybrid_enabled": False}, {"min_source_similarity": "high", "rrf_k": 5, "max_rerank_candidates": 500})
    assert (s.rrf_k, s.chunk_overlap, s.hybrid_enabled, s.min_source_similarity, s.max_rerank_candidates, s.default_k) == (200, 0, False, 0.0, 100, 5)
    assert configs.RetrievalSettings.snapshot({}, {"min_source_similarity": 3}).min_source_similarity == 1.0 and configs.RetrievalSettings.snapshot({}, None).hybrid_enabled
    config = {"search": {"other": 1, "rrf_k": 2}, "knowledge_base": {"chunking": "bad", "name": "x"}, "top": True}
    out = s.applied(config)
    assert out["top"] and out["search"]["other"] == 1 and out["search"]["rrf_k"] == 200 and config["search"]["rrf_k"] == 2
    assert out["knowledge_base"] == {"name": "x", "chunking": {"size": 800, "overlap": 0}, "retrieval": {"hybrid_enabled": False, "rrf_k": 200, "max_rerank_candidates": 100}}
    assert configs.RetrievalSettings.snapshot(s.applied({})["knowledge_base"]["retrieval"]).rrf_k == 200 and s.how()["search"]["threshold"] is None


def test_chunks_by_a_splitter(spark):
    def factory():
        def split(text, size, overlap):
            if "bad" in text:
                raise PermissionError("not allowed")
            return [] if "none" in text else text.split("|")

        return split

    rows = [(1, " short "), (2, "a|b|" + "c" * 40), (3, "bad " * 20), (4, "none. " * 12), (5, None)]
    frame = spark.createDataFrame(rows, "i int, text string")
    out = chunking.chunk_with(frame, factory, size=30, overlap=0).collect()
    fixed = {(r.i, r.chunk_index): r.text for r in chunking.chunk_documents(frame, 30, 0).collect()}
    assert [(r.i, r.chunk_index, r.text, r.split, r.error) for r in out if r.i < 3] == [(1, 0, "short", "whole", None), (2, 0, "a", "semantic", None), (2, 1, "b", "semantic", None), (2, 2, "c" * 40, "semantic", None)]
    assert {(r.i, r.chunk_index): r.text for r in out if r.i > 2} == {k: t for k, t in fixed.items() if k[0] > 2}
    assert {(r.i, r.split, r.error) for r in out if r.i > 2} == {(3, "fixed", "PermissionError: not allowed"), (4, "fixed", None)}


def test_mentions_of_many_names(spark):
    """100,000 aliases, in one scan and in several, against plain search; overlapping names, several entities of one name, odd rows."""
    r = random.Random(9)
    names = [(f"E{i % 30_000}", f"name {i:x} of") for i in range(100_000)] + [("X", "he"), ("Y", "she"), ("Z", "HERS"), ("W", "he"), ("V", " "), (None, "q"), ("U", None)]
    texts = [(1, "ushers say name 1F of things, and name ffff of", None), (2, None, "u"), (3, "", ""), (None, "Name 2a Of", "E7")] + [(9 + k, " ".join(r.choice(names[:200])[1] for _ in range(5)), "") for k in range(20)]
    frame, table = spark.createDataFrame(texts, "chunk_id int, text string, filename string"), spark.createDataFrame(names, "entity string, alias string")
    known = [(e.lower(), n) for e, a in names if e for n in {e.lower(), (a or "").strip().lower()} if n]
    want = sorted({(i or 0, e) for i, t, f in texts for e, n in known if n in (t or "").lower() or n in (f or "").lower()})
    for size in (evidence.ALIAS_BYTES, 3 << 20):
        out = evidence.mentions(frame, table, "chunk_id", ("text", "filename"), size).collect()
        assert sorted((x.chunk_id or 0, x.entity) for x in out) == want
    assert evidence.mentions(frame, table.limit(0)).collect() == []


def test_mentions_are_names_by_row(spark, monkeypatch):
    """What leaves the scan is names and not entities, however many share one; texts longer than a slice, names at cuts and row ends, two names of an entity in a text."""
    monkeypatch.setattr(evidence, "_SLICE", 64)
    texts = [(1, "x" * 61 + "needle in hay" + "y" * 100 + "NEEDLE", "f"), (2, None, "a needl"), (3, "e ü-Name", "needle"), (None, "ab", ""), (5, "e-9 and needle", "e-9")]
    frame = spark.createDataFrame(texts, "chunk_id long, text string, filename string").coalesce(1)
    table = spark.createDataFrame([(f"e-{i}", "Needle") for i in range(2000)] + [("U", "ü-name"), ("U", "e ü"), ("ab", "b"), ("z", " "), ("", "hay")], "entity string, alias string")
    for size in (evidence.ALIAS_BYTES, 1000):
        out = sorted(((r.chunk_id or 0, r.entity) for r in evidence.mentions(frame, table, "chunk_id", ("text", "filename"), size).collect()))
        every = [f"e-{i}" for i in range(2000)]
        assert out == sorted([(k, e) for k in (1, 3, 5) for e in every] + [(3, "u"), (0, "ab")])
    scanned = evidence._finder(type("Held", (), {"value": evidence._Names(pa.Table.from_batches(evidence._hashes([pa.RecordBatch.from_pydict({"name": ["needle"]})])))})(), 64)
    batch = pa.RecordBatch.from_pydict({"id": [1], "said": [["a needle, a needle"]], "row": [7]})
    assert [b.to_pylist() for b in scanned([batch])] == [[{"id": 1, "row": 7, "name": "needle"}]]


def test_mentions_of_a_name_are_dealt_out(spark, monkeypatch):
    """400 rows that hold a name of 400 entities: the pairs come from many tasks, each once."""
    monkeypatch.setattr(evidence, "_LIST", 32, raising=False)
    frame = spark.createDataFrame([(i, "a needle and pin" if i % 2 else "needle") for i in range(400)], "chunk_id long, text string")
    table = spark.createDataFrame([(f"e-{i}", "Needle") for i in range(400)] + [("f", "pin"), ("g", "absent")], "entity string, alias string")
    out = evidence.mentions(frame, table)
    made = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 400 * 400 + 200 and max(r["count"] for r in made) < 400 * 400 / 5
    assert sorted((r.chunk_id, r.entity) for r in out.collect()) == sorted([(i, f"e-{k}") for i in range(400) for k in range(400)] + [(i, "f") for i in range(1, 400, 2)])


def test_lists_without_a_shuffle(spark):
    """Lists are made within batches of rows: no exchange, whatever the ids' order and however many batches a range has."""
    rnd = random.Random(3)
    said = {i: " ".join(rnd.choice("ab c1 中文 D_e".split()) for _ in range(rnd.randrange(6))) for i in [*range(40), 2047, 2048, 5000]}
    frame = spark.createDataFrame(sorted(said.items(), key=lambda x: rnd.random()), "chunk_id long, text string").repartition(3).persist()
    for made in (sparse.lists(frame, 2.0), sparse.postings(frame)):
        assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString().split("InMemoryRelation")[0]
    tokens = {r.chunk_id: r.t for r in frame.select("chunk_id", sparse.index_tokens(F.col("text")).alias("t")).collect()}
    want = sorted((t, i, ts.count(t), len(ts)) for i, ts in tokens.items() for t in set(ts))
    assert sorted(tuple(r) for r in sparse.postings(frame).select("term", "chunk_id", "tf", "dl").collect()) == want
    for r in sparse.lists(frame, 2.0).collect():
        assert r.ids == sorted(r.ids) and {i // sparse.SHARD for i in r.ids} == {r.shard} and r.n == len(r.ids)
        assert r.top == pytest.approx(max(f * 2.5 / (f + 1.5 * (0.25 + 0.75 * d / 2.0)) for f, d in zip(r.tfs, r.dls)))


def test_slices_of_texts():
    """A task holds the parts of a slice and not of a batch, and loses no row."""
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "t": ["abc", "", "x" * 50, "é" * 4, "ab", "c", ""]})
    cut = list(chunking._slices(batch, 1, 10))
    assert [r for b in cut for r in b.to_pylist()] == batch.to_pylist()
    assert [b.column(0).to_pylist() for b in cut] == [[0, 1], [2], [3, 4], [5, 6]]
    assert list(chunking._slices(batch.slice(0, 0), 1, 10)) == []


def test_diversify_prunes_files_first(spark):
    """A file's rows behind its first ``cap`` go before a query's rows are ordered; the result is that of ordering all."""
    rnd = random.Random(5)
    rows = [(q, rnd.choice("abc"), p) for q in range(3) for p in range(40)]
    frame = spark.createDataFrame(rows, "query_id int, doc_key string, fusion_pos int")
    out = fusion.diversify(frame, 8, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("WindowGroupLimit") == 2  # by file, and by query
    for q in range(3):
        own, seen, marked = [r for r in rows if r[0] == q], {}, []
        for r in own:
            seen[r[1]] = seen.get(r[1], 0) + 1
            marked.append((seen[r[1]] > 2, r[2]))
        assert sorted(r.fusion_pos for r in out.where(F.col("query_id") == q).collect()) == sorted(p for _, p in sorted(marked)[:8])
