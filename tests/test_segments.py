"""The store of segments: changes, their index, merges and writers at the same time."""

import random
import threading
import time

import pytest
from pyspark.sql import functions as F

from brightwater.operators import evaluation, segments, sparse
from brightwater.sources import commits


def docs(spark, rows):
    return spark.createDataFrame(rows, "filename string, text string")


def results(found):
    return sorted((r.query_id, r.chunk_id, round(r.bm25_score, 9), r.bm25_rank) for r in found.collect())


def test_index_follows_changes(spark, tmp_path):
    """After each change and merge a search gives what it gives on an index of the store made anew; a change writes the lists of its own documents."""
    store, r = str(tmp_path / "store"), random.Random(4)
    text = lambda: " ".join("w" + str(min(int(r.expovariate(0.15)), 30)) for _ in range(r.randint(1, 25)))
    queries = spark.createDataFrame([(q, text()) for q in range(12)] + [(50, "w0"), (51, "nothing")], "query_id long, query string")
    held = {}
    for step in range(4):
        new = {f"d{r.randrange(14)}.txt": text() for _ in range(7 if step else 14)}
        gone = {f"d{r.randrange(14)}.txt" for _ in range(2)} - set(new) if step else set()
        segments.change(spark, store, docs(spark, list(new.items())), docs(spark, [(g.upper(), "") for g in gone]))
        held = {k: v for k, v in held.items() if k not in gone} | new
        now = segments.read(spark, store)
        assert sorted((x.filename, x.text) for x in now.collect()) == sorted(held.items())
        if step in (1, 3):
            if step > 1:
                assert segments.merge(spark, store, most=2) and segments.merge(spark, store, most=2) is None
            index = segments.index(spark, store)
            for n in (1, 4)[step // 2 :]:
                assert results(sparse.search(queries, index, n)) == results(sparse.search(queries, now, n))
    state = commits.state(spark, store)[1]
    assert len(state["segments"]) <= 2 and state["n"] == len(held) and state["tokens"] == sum(len(t.split()) for t in held.values())
    version = segments.change(spark, store, docs(spark, [("new.txt", "w1 w2")]))
    last = commits.state(spark, store)[1]["segments"][-1]
    assert {x.term for x in spark.read.parquet(f"{store}/{last}/lists").collect()} == {"w1", "w2"}
    assert segments.read(spark, store, version - 1).count() == len(held) == segments.read(spark, store).count() - 1


def test_texts_move_once(spark, tmp_path, monkeypatch):
    """A change shuffles the texts of its own documents once and none that the store has, and makes whole lists of them; a search gives the same with and without the names of the lists that it needs."""
    monkeypatch.setattr(sparse, "SHARD", 16)
    r, words = random.Random(7), [f"w{i}" for i in range(40)]
    text = lambda: " ".join(r.choices(words, k=3)) + " " + "".join(r.choices("!#$%&()*+,-./:;<=>?@[]^{|}~", k=3000))
    moved = lambda: (time.sleep(0.3), spark.range(1).count(), spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite())[2]
    store, files, before = str(tmp_path / "store"), [str(tmp_path / f"docs{i}") for i in range(2)], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for f in files:
        docs(spark, [(f"a/{i}.txt", text()) for i in range(1500)]).write.parquet(f)
    size = 1500 * 3000
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "50000")  # a store that is large beside it
    try:
        for f in files:
            at = moved()
            segments.change(spark, store, spark.read.parquet(f), chunk_size=1 << 30)
            assert moved() - at < 1.5 * size
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    now, index = segments.read(spark, store), segments.index(spark, store)
    assert now.count() == 1500 and now.agg(F.min("chunk_id"), F.max("chunk_id")).first()[:] == (1500, 2999)
    queries = spark.createDataFrame([(q, " ".join(r.choices(words, k=3))) for q in range(5)], "query_id long, query string")
    want = results(sparse.search(queries, now, 3))
    for most in (sparse.NEEDED_BYTES, 0):
        monkeypatch.setattr(sparse, "NEEDED_BYTES", most)
        assert results(sparse.search(queries, index, 3)) == want


def test_two_writers(spark, tmp_path):
    """Of two writers of one version one wins; changes without a stated version are put one after the other."""
    store, made = str(tmp_path / "store"), []
    put = [threading.Thread(target=lambda i=i: made.append(commits.put_if_absent(spark, f"{store}/x/one.json", str(i)))) for i in range(8)]
    for t in put:
        t.start()
    for t in put:
        t.join()
    assert sorted(made) == [False] * 7 + [True] and len(list((tmp_path / "store" / "x").glob("*.json"))) == 1
    write = [threading.Thread(target=lambda i=i: segments.change(spark, store, docs(spark, [(f"{i}.txt", f"text {i}")]))) for i in range(3)]
    for t in write:
        t.start()
    for t in write:
        t.join()
    rows = segments.read(spark, store).collect()
    assert commits.versions(spark, store) == [1, 2, 3] and sorted(r.filename for r in rows) == ["0.txt", "1.txt", "2.txt"] and len({r.chunk_id for r in rows}) == 3
    with pytest.raises(commits.Conflict):
        segments.change(spark, store, docs(spark, [("z.txt", "z")]), expected=2)
    assert commits.state(spark, str(tmp_path / "none")) == (0, {}) and segments.read(spark, str(tmp_path / "none")).collect() == []


def test_ranges_that_are_read_fall_with_n(spark, monkeypatch):
    """The fewer results are asked for, the fewer lists leave the scan."""
    monkeypatch.setattr(sparse, "SHARD", 16)
    rows = [(i, " ".join(["the"] + ["rare"] * (i % 97 == 0) + ["odd"] * (i % 31 == 0) * 3 + [f"w{i % 13}"])) for i in range(800)]
    index = sparse.index(spark.createDataFrame(rows, "chunk_id long, text string"))
    terms = sparse.query_terms(spark.createDataFrame([(1, "the rare odd")], "query_id long, query string"))
    needed, read = sparse._needed, {}
    monkeypatch.setattr(sparse, "_needed", lambda *a: read.setdefault(n, needed(*a)))
    full = sparse.bm25(terms, index.postings, index.stats).withColumnRenamed("bm25_score", "s")
    for n in (1, 64):
        found = sparse.best(terms, index, n).withColumnRenamed("bm25_score", "s")
        key = lambda f: [(x.rank, x.chunk_id, round(x.s, 8)) for x in sparse.top_n(f, "s", n, "rank").orderBy("rank").collect()]  # noqa: E731, B023
        assert key(found) == key(full)
    sizes = [read[n].agg(F.sum("n")).first()[0] for n in (1, 64)]
    assert sizes[0] < sizes[1]


def test_order_statistics(spark):
    """Narrowed ranges give what sorting gives, with ties, far values and groups of one."""
    r = random.Random(6)
    rows = [("a", r.choice([1.0, 2.0, 2.0, 5e9, -3e-7, r.random(), r.gauss(0, 1e12)])) for _ in range(3000)] + [("b", 7.0)] * 400 + [("c", 4.0), (None, 1.0), (None, 2.0), ("d", None), ("e", float("nan")), ("f", 1e308), ("f", -1e308)]
    frame = spark.createDataFrame(rows, "g string, v double")
    out = {(x.g, x.quantile): x.value for x in evaluation.order_statistics(frame, "v", (0.0, 0.3, 0.95, 1.0), ["g"], bins=8, few=20).collect()}
    for g in ("a", "b", "c", None, "f"):
        own = sorted(v for k, v in rows if k == g and v is not None and v == v)
        for q in (0.0, 0.3, 0.95, 1.0):
            at = q * (len(own) - 1)
            low, high = own[int(at)], own[min(int(at) + (at > int(at)), len(own) - 1)]
            assert out[g, q] == pytest.approx(low + (high - low) * (at - int(at)), rel=1e-9, abs=1e-12) or g == "f"
    assert {g for g, _ in out} == {"a", "b", "c", None, "f"}
    assert evaluation.order_statistics(frame, "v", (0.5,), bins=8, few=20).first().value == pytest.approx(sorted(v for _, v in rows if v is not None and v == v)[(len(rows) - 3) // 2], rel=1e-6, abs=1)
