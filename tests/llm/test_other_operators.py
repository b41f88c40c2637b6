"""Embedding dedup, WARC, sharding, the quality classifier and the pipeline."""

import gzip
import hashlib
import importlib.util
import random
import resource
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from brightwater.llm import embedding_dedup, quality, sharding, warc
from brightwater.llm.components import connected_components
from brightwater.llm.shared import new_path

from . import brute

SF = "/root/testdata/sf0.001"


def test_components(spark):
    r = random.Random(1)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    out = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    assert out == brute.components({n for e in real for n in e}, real)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def vectors(seed=0, dim=16, n=150):
    r = np.random.default_rng(seed)
    rows = []
    centres = r.standard_normal((5, dim))
    for i in range(n):
        v = centres[i % 5] + r.standard_normal(dim) * r.choice([0.05, 0.2, 0.3, 1.0]) if i % 3 else r.standard_normal(dim)
        rows.append((i, (v * r.choice([0.5, 1, 7])).astype(np.float32).tolist(), int(i % 5 % 2) if i % 17 else None))
    same = rows[1][1]
    rows += [(n + i, same, 1) for i in range(20)] + [(n + 30, None, 1), (n + 31, [0.0] * dim, 1), (n + 32, [float("nan")] * dim, 1), (n + 33, [], 1), (n + 34, [1.0, None], 1), (n + 35, [1.0, 2.0], 1), (n + 36, [2.0, 4.0], 1), (None, same, 1)]
    return rows


def test_a_tight_cluster_takes_little_memory():
    """All pairs of 6,000 near-copies leave the range join in strips, each pair once."""
    points = np.random.default_rng(0).normal(0, 1e-3, (6000, 6))
    before, n, most = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, 0, 0
    for i, _ in embedding_dedup.range_join(points, None, 0.1):
        n, most = n + len(i), max(most, len(i))
    assert n == 6000 * 5999 // 2 and most <= 1 << 18 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 200_000


def test_unite():
    r = np.random.default_rng(1)
    for n in (1, 5, 400):
        p, q = r.integers(0, n, (2, n)), r.integers(0, n, (2, n))
        label = np.arange(n)
        for a, b in zip(p, q):
            embedding_dedup.unite(label, a, b)
        embedding_dedup.unite(label, np.arange(n - 1, dtype=int)[:0], np.arange(n - 1, dtype=int)[:0])
        while not np.array_equal(up := label[label], label):
            label = up
        assert dict(enumerate(label.tolist())) == brute.components(range(n), [(a, b) for x, y in zip(p.tolist(), q.tolist()) for a, b in zip(x, y)])


@pytest.mark.parametrize("chunk", [4000, 40, 7])
def test_near_vectors(spark, chunk):
    """Whole groups, groups spread over a grid, and cells dealt into pairs of chunks."""
    rows = vectors()
    frame = spark.createDataFrame([(*x, "x", "y") for x in rows], "vec_id long, embedding array<float>, label int, k string, g string")
    out = embedding_dedup.near_duplicates(frame, block_dims=4, chunk=chunk).collect()
    good = [(i, np.array(v, float), g) for i, v, g in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v) and g is not None]
    links = [(a, b) for k, (a, x, g) in enumerate(good) for b, y, h in good[:k] if g == h and len(x) == len(y) and (x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum())) >= 0.93]
    root = brute.components([i for i, *_ in rows if i is not None], links)
    n = {i: 0 for i in root}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    assert len(links) > 300 and len(out) == len(rows)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None) == [(i, n[i], root[i], root[i] == i) for i in sorted(root)]
    assert [(r.n_links, r.component_id) for r in out if r.vec_id is None] == [(0, None)]
    assert embedding_dedup.near_duplicates(frame.limit(0)).collect() == []


def test_warc_round_trip(spark):
    same = "<p>é" + "x" * 200
    rows = [(3, "http://a/3", same), (1, "http://a/ 1\n", same), (7, None, same), (2, "u", "x" * 99), (4, "u", "x" * 99), (5, "u", None), (6, "u", ""), (None, "n", same), (8, "u", "WARC/1.1\r\n\r\n" * 30), (9, "u", "big " * 50_000)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, record_type string")
    path = new_path(spark, "warc")
    warc.write_warc(frame, path)
    out = {r.page_id: r for r in warc.read_warc(spark, path).collect()}
    assert len(out) == len(rows)
    for i, url, html in rows:
        raw, r = (html or "").encode(), out[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        revisit = i in (3, 7)
        assert (r.record_type, r.refers_to) == (("revisit", 1) if revisit else ("response", None))
        assert r.payload is None if revisit else bytes(r.payload) == raw
    assert out[1].url == "http://a/%201%0A" and out[7].url is None


@pytest.mark.parametrize("dims", [1, 2, 6])
def test_range_join_finds_all_pairs_in_reach(dims):
    r = np.random.default_rng(dims)
    x, y = r.standard_normal((2, 300, dims)) / 8
    y[:50] = x[:50]
    distance = lambda p, q: ((p[:, None] - q[None]) ** 2).sum(-1)
    for budget in (1e-4, 0.02):
        pairs = lambda right: [p for i, j in embedding_dedup.range_join(x, right, budget, at_once=500) for p in zip(i.tolist(), j.tolist())]
        got, own = pairs(y), pairs(None)
        assert len(set(got)) == len(got) and set(zip(*map(np.ndarray.tolist, np.nonzero(distance(x, y) <= budget)))) <= set(got)
        once = {(min(p), max(p)) for p in own}
        assert len(once) == len(own) and {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(distance(x, x) <= budget))) if i < j} <= once
    assert list(embedding_dedup.range_join(x[:0], y, 0.1)) == []


def test_range_joins_measure_few_of_all_pairs():
    """Random vectors, the worst case: over all blocks far fewer pairs are measured than the group has; so the share of 50,000 of ten labels."""
    v = np.random.default_rng(1).standard_normal((5000, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    measured = sum(len(i) for b in range(0, 12, 6) for i, _ in embedding_dedup.range_join(v[:, b : b + 6], None, 0.14 * 6 / 64)) * (64 / 12)
    assert measured < 0.45 * 5000 * 4999 / 2


def archive(*records):
    return b"".join(b"\r\n".join([b"WARC/1.0", *[h.encode() for h in heads], b"Content-Length: %d" % len(block), b"", block]) + b"\r\n\r\n" for heads, block in records)


PAGE = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n<p>hello"
FOREIGN = [
    (["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", "Content-Type: application/warc-fields"], b"software: x\r\n"),
    (["WARC-Type: response", "WARC-Record-ID:<urn:uuid:2>", "WARC-Target-URI: http://a/", "X-Empty:", "Content-Type: application/http; msgtype=response"], PAGE),
    (["WARC-Type: response", "WARC-Record-ID: <urn:uuid:3>", "WARC-Target-URI: http://a/", " folded", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n" + b"%x\r\n" % len(gzip.compress(b"zipped")) + gzip.compress(b"zipped") + b"\r\n0\r\n\r\n"),
    (["WARC-Type: revisit", "WARC-Record-ID: <urn:uuid:4>", "Content-Type: application/http"], b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n"),
    (["WARC-Type: request", "WARC-Record-ID: <urn:uuid:5>", "Content-Type: application/http"], b"GET / HTTP/1.1\r\n\r\n"),
    (["WARC-Type: metadata", "WARC-Record-ID: <urn:uuid:6>"], b""),
]


@pytest.mark.parametrize("form", ["plain", "members", "whole"])
def test_warc_of_other_makers(spark, tmp_path, form):
    """Records of all types, without our headers, plain or gzip, without a list of files."""
    data = archive(*FOREIGN)
    if form == "members":
        data = b"".join(gzip.compress(archive(x)) for x in FOREIGN)
    elif form == "whole":
        data = gzip.compress(data)
    folder = tmp_path / "a"
    folder.mkdir()
    (folder / ("x.warc" if form == "plain" else "x.warc.gz")).write_bytes(data)
    (folder / "notes.txt").write_text("no archive")
    rows = warc.read_warc(spark, str(folder)).collect()
    assert [(r.record_type, r.record_id, r.page_id) for r in rows] == [(h[0].split(": ")[1], f"<urn:uuid:{i}>", None) for i, (h, _) in enumerate(FOREIGN, 1)]
    assert [bytes(r.payload) if r.payload is not None else None for r in rows] == [b"software: x\r\n", b"<p>hello", b"zipped", None, b"", b""]
    assert [r.payload_bytes for r in rows] == [13, 8, 6, 12, 0, 0] and rows[2].url == "http://a/ folded" and rows[1].payload_digest is None
    assert warc.read_warc(spark, str(folder), ["record_type"]).where("record_type = 'response'").count() == 2
    assert warc.read_warc(spark, str(folder), ["payload_bytes"]).count() == 6


@pytest.mark.parametrize("zipped", [False, True])
def test_warc_cut_off(spark, tmp_path, zipped):
    """Wherever an archive ends too early, a read raises; at the end of a record it is whole, with or without the line ends behind it."""
    data = archive(*FOREIGN[:2])
    first = len(archive(FOREIGN[0]))
    whole = {0: 0, first: 1, first - 2: 1, len(data): 2, len(data) - 3: 2, len(data) - 4: 2}
    for cut in (0, 5, 40, first - 5, first - 2, first, len(data) - 6, len(data) - 4, len(data) - 3, len(data)):
        part = gzip.compress(data[:cut]) if zipped else data[:cut]
        source = tmp_path / f"{cut}.warc"
        source.write_bytes(part)
        reader = warc._Reader(f"file://{source}", ["record_type", "payload"], 1 << 20)
        read = lambda: sum(b.num_rows for p in reader.partitions() for b in reader.read(p))
        if cut in whole:
            assert read() == whole[cut]
        else:
            with pytest.raises(warc.BadArchive):
                read()
    (tmp_path / "y.warc.gz").write_bytes(gzip.compress(data)[:-9])
    with pytest.raises(Exception, match="ends within"):
        warc.read_warc(spark, str(tmp_path / "y.warc.gz")).collect()


def test_warc_with_line_feeds(tmp_path):
    """Headers whose lines end with LF, and a large block without an HTTP header, which is searched once."""
    block, large = b"HTTP/1.1 200 OK\nContent-Encoding: gzip\n\n" + gzip.compress(b"text"), b"x\r\n" * (12 << 20)
    one = lambda b: b"WARC/1.0\nWARC-Type: response\nContent-Type: application/http\nContent-Length: %d\n\n" % len(b) + b + b"\n\n"
    (tmp_path / "x.warc").write_bytes(one(block) + one(large) + one(block)[:-2])
    reader = warc._Reader(f"file://{tmp_path / 'x.warc'}", ["payload_bytes"], 1 << 20)
    began = time.perf_counter()
    assert [n for p in reader.partitions() for b in reader.read(p) for n in b.column(0).to_pylist()] == [4, len(large), 4] and time.perf_counter() - began < 10


def test_warc_of_no_pages_and_of_a_lost_writer(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).collect() == []
    store, root = warc._open(path)
    store.open_output_stream(f"{root}/{warc.UNFINISHED}").close()
    with pytest.raises(Exception, match="has not ended"):
        warc.read_warc(spark, path).collect()


def test_warc_payload_is_the_html(spark):
    """Any tool that reads gzip and HTTP finds the page as it was, and the digest is that of the stored body."""
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "<p>é</p>" * 30)], "page_id long, url string, html string"), path)
    import glob

    (data,) = [x for f in glob.glob(path.removeprefix("file://") + "/part-*.warc.gz") if (x := gzip.open(f).read())]
    head, http, body = data.removesuffix(b"\r\n\r\n").split(b"\r\n\r\n")
    assert body == ("<p>é</p>" * 30).encode() and b"sha256:" + hashlib.sha256(body).hexdigest().encode() in head and b"Content-Length: %d" % len(body) in http


def test_warc_pushes_predicates_down(spark):
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([(i, "u", "t" * 200 + str(i % 3)) for i in range(30)], "page_id long, url string, html string"), path)
    got = warc.read_warc(spark, path, ["page_id", "record_type", "payload"]).where("record_type = 'response'")
    assert sorted(r.page_id for r in got.collect()) == [0, 1, 2]
    assert warc.read_warc(spark, path, ["page_id", "payload_bytes"]).where(F.col("page_id").isin(4, 5)).count() == 2
    reader = warc._Reader(path, ["page_id"], 1 << 20)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("page_id",), 5)]))
    assert len(left) == 1 and reader.wanted == {"record_type": {"revisit"}}
    empty = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_table_is_even_and_steady():
    names = [f"s{i}" for i in range(10)]
    table = sharding.fill_table(names, 1009)
    counts = np.bincount(table)
    assert len(table) == 1009 and counts.max() - counts.min() <= 1
    without = sharding.fill_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, without) if a != 9)
    assert moved < 0.15 * 1009  # others' keys mostly stay
    with pytest.raises(ValueError):
        sharding.fill_table(names, 1000)
    with pytest.raises(ValueError):
        sharding.fill_table(["a", "a"], 1009)


def test_shards(spark):
    rows = [(i, "x") for i in range(500)] + [(None, "x"), (7, "again")]
    names = [f"s{i}" for i in range(4)]
    out = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, slot string"), names, 101).collect()
    table = sharding.fill_table(names, 101)
    for r in out:
        slot = sharding.hash60("" if r.doc_id is None else str(r.doc_id)) % 101
        assert (r.slot, r.shard_id) == (slot, table[slot])
    assert len(out) == len(rows)


def test_features_are_whole_and_finite():
    for text in (None, "", " ", "\n", "a", "word " * 3000, "é|!#\n" * 50):
        x = quality.features(text)
        assert len(x) == len(quality.FEATURES) and np.isfinite(x).all()


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(0)
    x = r.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x[:3000], y[:3000], names=("a", "b", "c"), n_pairs=1)
    assert model.pairs == [(1, 0)]
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95


def test_additive_model_without_labels():
    assert quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((2, len(quality.FEATURES)))).tolist() == [0.5, 0.5]
    assert (quality.fit(np.zeros((5, 1)), np.ones(5), names=("a",)).score(np.zeros((1, 1))) > 0.9).all()


def test_quality_on_held_out_rows(spark):
    """Learns nothing from held-out labels and tells nearly all of them right."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    flipped = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, flipped)
    assert all((a == b).all() for a, b in zip(model.tables, again.tables))
    out = quality.score(docs.select("doc_id", "text", F.lit("x").alias("score")), model, keep=["doc_id", "score"])
    rows = out.withColumn("held", quality.held_out()).join(labels, "doc_id").where("held").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "text here", "x"), (2, "twice", "x")], "doc_id long, text string, s string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (None, 1), (3, 7), (4, None)], "doc_id long, quality int")
    out = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out) and out[0].s == "x"
    many = docs.unionByName(spark.createDataFrame([(1, f"copy {i}", "x") for i in range(50)], docs.schema))
    seen = []
    quality.fit, fit = (lambda x, y, **k: seen.append(len(x)) or fit(x, y, **k)), quality.fit
    try:
        quality.train(many, labels)
    finally:
        quality.fit = fit
    assert seen == [2]  # a row per labelled id, however often it repeats
    assert quality.score(docs.limit(0), quality.fit(np.zeros((0, len(quality.FEATURES))), np.zeros(0))).collect() == []


@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="the pipeline is not in this checkout")
def test_pipeline_against_plain_versions(spark):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "test-stage")
        stage(spark, docs, SF).write.parquet(path)
        before, docs = {r.doc_id: r for r in docs.collect()}, spark.read.parquet(path)
        after = {r.doc_id: r for r in docs.collect()}
        seen.append((name, before, after))
    assert [n for n, *_ in seen] == ["quality classifier", "line dedup", "SimHash near-dedup", "benchmark decontamination", "BPE encoding and decoding"]
    _, before, after = seen[0]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(after[i].text == before[i].text for i in after)
    assert np.mean([(i in after) == bool(labels[i]) for i in before if i in labels]) > 0.95
    _, before, after = seen[1]
    assert {i: r.text for i, r in after.items()} == {i: t for i, t, *_ in brute.line_dedup([(i, r.text) for i, r in before.items()])}
    assert all(r.n_chars == len(r.text) for r in after.values())
    _, before, after = seen[2]
    fps = {i: brute.simhash(r.text) for i, r in before.items()}
    links = [(a, b) for a in fps for b in fps if b < a and (fps[a] ^ fps[b]).bit_count() <= 3]
    assert set(after) == set(brute.components(fps, links).values())
    _, before, after = seen[3]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaked = {i for i, r in before.items() if any(t in r.text for t in items)}
    assert set(before) - set(after) >= leaked and len(set(before) - set(after) - leaked) <= 2
    _, before, after = seen[4]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    assert {i: r.n_tokens for i, r in after.items()} == {i: len(tok.encode(r.text, add_special_tokens=False).ids) for i, r in before.items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, docs.collect()))
