"""The pipeline's stages on rows whose ids are null or repeat."""

import hashlib
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "A line that many documents share, long enough to count as one."


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))


def run(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, lang, source, len(t)) for i, t, lang, source in rows], COLUMNS)
    return sorted((tuple(r) for r in stage(spark, docs, SF).collect()), key=str)


def whole(rows):
    return sorted(((i, t, lang, source, len(t)) for i, t, lang, source in rows), key=str)


def test_shared_lines_keep_rows_and_their_columns(spark):
    rows = [(i, f"{LONG}\nrow {i}", "en", f"s{i}") for i in range(6)]
    odd = [(2, "other", "fr", "t"), (2, f"{LONG}\nmore", "de", "u"), (None, LONG, "it", "v"), (None, "x", "es", "w"), (None, "x", "es", "w")]
    cut = [(i, t if i in (None, 5) else t.replace(LONG + "\n", ""), lang, source) for i, t, lang, source in rows + odd]
    assert run(spark, corpus_pipeline.shared_lines, rows + odd) == whole(cut)


def test_near_copies_keep_one_row_of_a_group(spark):
    a, b, c = prose(1), prose(2), prose(3)
    nulls = [(None, a, "en", "n1"), (None, a, "en", "n1"), (None, c, "fr", "n2")]
    # id 1 is the root of two groups, a and b; its row of a stands twice, and c is alone
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (2, a, "de", "t"), (1, b, "fr", "u"), (3, b, "fr", "v"), (4, c, "it", "w")]
    assert run(spark, corpus_pipeline.near_copies, rows + nulls) == whole([rows[0], rows[3], rows[5], *nulls])


def test_leaks_go_by_row(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    leaking = [(1, f"{prose(4, 9)} {item} {prose(5, 9)}", "en", "s"), (None, item, "en", "s")]
    clean = [(1, prose(6), "de", "t"), (1, prose(6), "de", "t"), (None, prose(7), "fr", "u"), (2, prose(8), "fr", "u")]
    assert run(spark, corpus_pipeline.benchmark_leaks, leaking + clean) == whole(clean)


def test_contamination_carries_columns_through_several_indexes(spark):
    from brightwater.llm import decontamination

    items = spark.createDataFrame([(i, prose(100 + i, 12), "") for i in range(9)], "item_id long, question string, answer string")
    docs = spark.createDataFrame([(1, prose(100, 12), "a"), (1, prose(9), "b"), (1, prose(9), "b"), (None, prose(9), "c"), (None, prose(104, 12), "d")], "doc_id long, text string, lang string")
    for index_bytes in (1 << 20, 500):
        out = decontamination.find_contamination(docs, items, index_bytes=index_bytes, carry=("text", "lang"))
        assert sorted((r.lang, r.item_ids, r.text == prose(9)) for r in out.collect()) == [("a", [0], False), ("b", [], True), ("b", [], True), ("c", [], True), ("d", [4], False)]


def test_quality_and_tokens_keep_rows(spark):
    """Each row is judged and encoded by its own text, whatever its id; null texts count as empty."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [(1, prose(1)), (1, prose(2)), (1, prose(2)), (None, prose(3)), (None, None), (2, ""), (3, "junk | | | ! ! ! " * 30)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], COLUMNS)
    kept = [(r.doc_id, r.text) for r in corpus_pipeline.quality_classifier(spark, docs, SF).collect()]
    assert len(set(kept) - set(rows)) == 0 and kept.count((1, prose(2))) in (0, 2)
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = [(i, tok.encode(t or "", add_special_tokens=False).ids) for i, t in rows]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    expected = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(tok.decode(x, skip_special_tokens=False).encode())) for i, x in ids]
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, docs, SF).collect()), key=str) == sorted(expected, key=str)


def test_stages_of_empty_tables(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []
