"""Column expressions on literal rows, most of all what the tables don't hold: CJK, tags, odd blanks."""

import duckdb
import pytest
from pyspark.sql import functions as F

from brightwater.functions import scores, text, vectors
from brightwater.plans.text import ORACLES, QUERIES


def values(spark, rows, make, schema="x string"):
    """The expression over each row, in order."""
    frame = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.out for r in frame.select("i", make.alias("out")).orderBy("i").collect()]


def test_index_tokens(spark):
    got = values(spark, ["KB-10 验收标准", "中a文", "中", "", None, "Éa_b c"], text.index_tokens(F.col("x")))
    assert got == [["kb", "10", "验", "收", "标", "准", "验收", "收标", "标准"], ["a", "中", "文", "中文"], ["中"], [], [], ["a_b", "c"]]


def test_query_tokens(spark):
    got = values(spark, ["PMP内容", "报销流程是什么", "中a文", "请问", "KB-10 验收标准", "", None, "验 收"], text.query_tokens(F.col("x")))
    assert got == [["pmp"], ["报", "销", "流", "程", "报销", "销流", "流程"], ["a", "中", "文"], [], ["kb", "10", "验收", "收标", "标准"], [], [], ["验", "收"]]
    assert values(spark, ["自定义词报销"], text.query_tokens(F.col("x"), ("自定义词",))) == [["报", "销", "报销"]]


def test_entities(spark):
    assert values(spark, ["PMP", "KB-10", "v1.1", "license", "A", "a_b", "12", "ÀB", None], text.is_entity(F.col("x"))) == [True, True, True, False, False, True, False, True, None]
    assert values(spark, ["PMP and kb-10, PMP: v1.1.3 license ISO_9001."], text.entities(F.col("x"))) == [["pmp", "kb-10", "v1.1.3", "iso_9001"]]
    assert values(spark, ["KB-10", "x"], text.entity_variants(F.col("x"), {"kb-10": ["kb ten"]})) == [["kb-10", "kb ten"], ["x"]]


def test_names(spark):
    assert values(spark, [" a/B.MD ", "B.md/", "", None], text.doc_key(F.col("x"))) == ["b.md", "b.md", "", None]
    assert values(spark, ["Docs\\A.MD"], text.eval_doc_id(F.col("x"))) == ["docs/a.md"]
    assert values(spark, [("a/b.md", "b.md"), ("b.md", "x/b.md"), ("xb.md", "b.md"), ("a", "a")], text.path_matches(F.col("x"), F.col("y")), "x string, y string") == [True, True, False, True]
    names = ["Qwen/Qwen3-Embedding-0.6B", "text-embedding-qwen3-embedding-0.6b", "/models/qwen3 embedding_0.6b/", "m@q4:1", "", None]
    assert values(spark, names, text.model_key(F.col("x"))) == ["qwen3-embedding-0.6b"] * 3 + ["m", "", ""]


def test_secrets_and_switches(spark):
    assert values(spark, ["", "12345678", "123456789", None], text.mask_secret(F.col("x"))) == ["", "****", "123****789", ""]
    assert values(spark, ["Yes", "0", None, " on "], text.lenient_bool(F.col("x"))) == [True, False, False, True]
    assert values(spark, ["embed", "Reranker", "llm", "?", None], text.model_kind(F.col("x"))) == ["embedding", "rerank", "chat", "chat", "chat"]
    assert values(spark, ["https://api.openai.com/v1", "http://localhost:11434", "http://127.0.0.1", "http://a.b", None], text.provider_of(F.col("x"))) == ["openai", "ollama", "lm_studio", "unknown", "unknown"]


def test_json(spark):
    assert values(spark, ['{"a": 1}', "[1]", "bad", None, '"s"'], text.lenient_json(F.col("x"))) == ['{"a": 1}', '{"value":[1]}', '{"raw":"bad"}', "{}", '{"value":"s"}']
    got = values(spark, ['{"a":1}', '```json\n{"a":1}\n```', 'so {"a":1} ok', "none {", "", None], text.first_json_object(F.col("x")))
    assert got == ['{"a":1}', '{"a":1}', '{"a":1}', None, None, None]


def test_thinking_sections(spark):
    got = values(spark, ["plain", "<think>t</think> a", "a <think>open", "<thinking_summary>s</thinking_summary>a", "<think>t</think><thinking_summary> s </thinking_summary>Final answer: b", "<thinking_summary>never closed", None], text.thinking_sections(F.col("x")))
    assert [tuple(r) for r in got] == [("plain", None, None), ("a", "t", None), ("a", "open", None), ("a", None, "s"), ("b", "t", "s"), ("<thinking_summary>never closed", None, None), ("", None, None)]


def test_cleaning(spark):
    assert values(spark, ["…。 答案", "最终答案： x", "- item", ".", None], text.clean_answer(F.col("x"))) == ["答案", "x", "item", ".", ""]
    assert values(spark, ["<think>a</think>\n\n\n\nb```"], text.clean_thinking(F.col("x"))) == ["a\n\nb"]
    assert values(spark, ["  a　", None], text.strip_ws(F.col("x"))) == ["a", None]
    assert values(spark, ["x [1][2] [9] [0]"], text.citations(F.col("x"), F.lit(2))) == [[1, 2]]
    cut = values(spark, ["x [1][2] y [9]", "[1]", "", None], text.answer_segments(F.col("x"), F.lit(2)))
    assert [[tuple(p) for p in x] for x in cut] == [[("x ", None), ("[1]", 1), ("[2]", 2), (" y ", None), ("[9]", None)], [("[1]", 1)], [], []]


def test_parts(spark):
    got = values(spark, ["abcdef", "ab", ""], text.split_by_lengths(F.col("x"), F.array(F.lit(2), F.lit(1))))
    assert got == [["ab", "c", "def"], ["ab"], []]
    assert values(spark, [0.0, 1024.0, 1536.0 * 1024, -1.0, None, 5e15], text.human_bytes(F.col("x")), "x double") == ["0.00 B", "1.00 KB", "1.50 MB", None, None, "4547.47 TB"]


def test_garbled(spark):
    assert values(spark, ["□" * 2 + "a" * 60, "a" * 60, "□" * 10, "�" + "a" * 60], text.looks_garbled(F.col("x"))) == [True, False, False, True]
    assert values(spark, ["a" * 60], text.looks_garbled(F.col("x"), F.lit("报告.pdf"))) == [True]


def test_tables(spark):
    rows = [([["h", "i"], ["", None], ["a\nb"]],), ([],)]
    assert values(spark, rows, text.table_markdown(F.col("x")), "x array<array<string>>") == ["| h | i |\n| --- | --- |\n| a b |  |", ""]


@pytest.mark.parametrize(("vector", "rerank", "expected"), [(0.6, None, 0.6), (None, 0.8, 0.8), (0.4, 0.8, 0.66), (None, None, 0.0), (-1.0, None, 0.0), (2.0, 2.0, 1.0)])
def test_combine(spark, vector, rerank, expected):
    got = values(spark, [(vector, rerank)], scores.combine(F.col("x"), F.col("y")), "x double, y double")
    assert got == [pytest.approx(expected)]


def test_rerank_probability(spark):
    rows = [("a", 0.02), ("a", 0.91), ("b", 0.0), ("b", 4.0), ("c", None)]
    got = values(spark, rows, scores.rerank_probability(F.col("y"), ["x"]), "x string, y double")
    assert got[:3] == [0.02, 0.91, 0.5] and got[3] > 0.98 and got[4] is None


def test_scores(spark):
    assert values(spark, [0.0, 0.5, 1.0], scores.to_distance(F.col("x")), "x double") == [1e12, 1.0, 0.0]
    assert values(spark, [-1.0, 1.0], scores.to_similarity(F.col("x")), "x double") == [1.0, 0.5]
    assert values(spark, [0.8, 0.66, 0.1], scores.band(F.col("x")), "x double") == ["较强", "一般", "较弱"]
    assert values(spark, [("q", 0.66), ("q", 0.33)], scores.relative(F.col("y"), ["x"]), "x string, y double") == [1.0, 0.5]
    assert values(spark, [-1000.0, 0.0, 1000.0], scores.sigmoid(F.col("x")), "x double") == [0.0, 0.5, 1.0]


def test_vectors(spark):
    assert values(spark, [([3.0, 4.0],), ([0.0, 0.0],)], vectors.normalise(F.col("x")), "x array<float>") == [[0.6, 0.8], [0.0, 0.0]]
    assert values(spark, [([0.6, 0.8], [0.0, 1.0])], vectors.inner_product(F.col("x"), F.col("y")), "x array<double>, y array<double>") == [0.8]
    with pytest.raises(Exception, match="expected 3 dimensions, got 2"):
        values(spark, [([1.0, 2.0],)], vectors.check_dimension(F.col("x"), 3), "x array<float>")


def test_parts_of_odd_texts(spark, tmp_path):
    """q_parts_of_text against its SQL: texts and ids that are null, empty, short or negative, sizes that are negative or beyond a double's digits."""
    texts = [None, "", "a", "abcdefghij", "abcdefghijk", "é" * 37, "😀" * 12, "x" * 400]
    rows = [(i, x, n) for i in (0, 5, 10, 300, -1, -13, -301, None) for x in texts for n in (7, -5, (1 << 62) + 12345, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    key = lambda r: tuple((v is None, v or 0 if not isinstance(v, str) else v) for v in r)
    got = sorted((tuple(r) for r in QUERIES["q_parts_of_text"](spark, str(tmp_path)).collect()), key=key)
    assert got == sorted(db.execute(ORACLES["q_parts_of_text"]).fetchall(), key=key)
    assert values(spark, ["abc", None], text.split_by_lengths(F.col("x"), F.array(F.lit(1), F.lit(None).cast("int")))) == [None, None]
    for digits in (0, 2, 3):
        wide = [s * (2.0**e + k * 2.0 ** (e - 52)) for e in (42, 43, 45, 46, 47, 49, 50, 51, 52, 53, 60) for k in (0, 1, 2, 3, 5, 8, 12, 77) for s in (1, -1)]
        assert values(spark, wide, text.fixed(F.col("x"), digits), "x double") == [f"{x:.{digits}f}" for x in wide]


def test_fixed_as_c_prints(spark):
    rows = [6.125, 30.625, 0.375, 1.005, 1.015, 2.675, 1023.999, 0.0, 123456789.125, 0.005, 1e-9, None]
    assert values(spark, rows, text.fixed(F.col("x"), 2), "x double") == [None if x is None else f"{x:.2f}" for x in rows]
    assert values(spark, [0.5, 1.5, 2.5, 299.5], text.fixed(F.col("x"), 0), "x double") == ["0", "2", "2", "300"]
    assert values(spark, [6.125 * 1024], text.human_bytes(F.col("x")), "x double") == ["6.12 KB"]
    assert values(spark, [2.5], scores.kpi_display(F.col("x"), F.lit("ms")), "x double") == ["2 ms"]
