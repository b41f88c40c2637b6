"""Channel splitting and incremental ingest."""

import json
import os

import pytest

from pyspark.sql import functions as F

from brightwater.operators import models, segments, sparse
from brightwater.sources import commits
from brightwater.streaming import channels, ingest

TEXT = "a <b> <think>t < /think </think> mid<thinking_summary> s </thinking_summary>end <thi"


def run(pieces):
    mode, buffer, out = "answer", "", {"answer": "", "thinking": "", "summary": ""}
    for p in pieces:
        mode, buffer, events = channels.feed(mode, buffer, p)
        for channel, text in events:
            out[channel] += text
    out[mode] += buffer
    return out


def test_tags_may_come_in_parts():
    whole = run([TEXT])
    assert whole == {"answer": "a <b>  midend <thi", "thinking": "t < /think ", "summary": " s "}
    for i in range(len(TEXT)):
        for j in range(i, len(TEXT), 7):
            assert run([TEXT[:i], TEXT[i:j], TEXT[j:]]) == whole


def test_unclosed_tag_runs_to_the_end():
    assert run(["x<think>", "y"]) == {"answer": "x", "thinking": "y", "summary": ""}


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for n in range(3):  # three batches; the pieces of a batch are out of order
        rows = [{"request_id": r, "piece_no": i, "piece": TEXT[i : i + 1] if r == "x" else "plain ", "last": i == len(TEXT) - 1} for r in ("x", "y") for i in range(n * 28, min(len(TEXT), n * 28 + 28))]
        (source / f"{n}.json").write_text("\n".join(json.dumps(r) for r in reversed(rows)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))  # batches come in order of these times
    stream = spark.readStream.schema("request_id string, piece_no long, piece string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = channels.split_channels(stream).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    events = spark.read.parquet(str(out))
    got = {r.request_id: (r.answer, r.thinking, r.summary) for r in channels.joined(events).collect()}
    assert got == {"x": ("a <b>  midend <thi", "t < /think ", "s"), "y": ("plain " * len(TEXT), "", None)}
    sent = [r.event for r in channels.server_events(events.where("request_id = 'x'")).orderBy("n").collect()]
    assert sent[0] == "meta" and sent[-1] == "done" and set(sent[1:-1]) == {"delta", "thinking_delta"}


def _echo():
    def answer(prompt):
        for k, word in enumerate(prompt.split(" ")):
            if word == "fail":
                raise RuntimeError("no more")
            yield ("" if k == 0 else " ") + word

    return answer


def test_chat_from_prompts_to_events(spark, tmp_path):
    """Prompts as a stream, answers in pieces through the channels' state to server events; one request fails on its way, one has no prompt."""
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    prompts = [("a", "<think>why so</think> because of it"), ("b", "begins then fail here"), ("c", None), ("d", "plain")]
    (source / "0.json").write_text("\n".join(json.dumps({"request_id": r, "prompt": p}) for r, p in prompts))
    pieces = models.chat(spark.readStream.schema("request_id string, prompt string").json(str(source)), _echo)
    kept = pieces.writeStream.format("parquet").option("path", str(tmp_path / "pieces")).option("checkpointLocation", str(tmp_path / "c0")).trigger(availableNow=True).start()
    kept.awaitTermination(120)
    stored = spark.read.parquet(str(tmp_path / "pieces"))
    stream = spark.readStream.schema(stored.schema).parquet(str(tmp_path / "pieces"))
    channels.split_channels(stream.drop("error")).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start().awaitTermination(120)
    events = spark.read.parquet(str(out))
    got = {r.request_id: (r.answer, r.thinking) for r in channels.joined(events).collect()}
    assert got == {"a": (" because of it", "why so"), "b": ("begins then", ""), "d": ("plain", "")}
    errors = stored.where("error is not null").select("request_id", F.col("error").alias("message"))
    last = {r.request_id: (r.event, json.loads(r.data).get("message")) for r in channels.server_events(events, errors).groupBy("request_id").agg(F.max_by("event", "n").alias("event"), F.max_by("data", "n").alias("data")).collect()}
    assert last == {"a": ("done", None), "b": ("error", "RuntimeError: no more"), "c": ("error", "ValueError: there is no prompt"), "d": ("done", None)}
    whole = {r.request_id: (r.answer, r.error) for r in models.chat_once(spark.createDataFrame(prompts, "request_id string, prompt string"), _echo).collect()}
    assert whole["d"] == ("plain", None) and whole["b"] == (None, "RuntimeError: no more")


def test_server_event_texts(spark):
    frame = spark.createDataFrame([(1, 'event: delta\ndata: {"a":1}\n\ndata: x\ndata: y\r\n\r\nevent: cut\ndata: z')], "id int, text string")
    assert [(r.event, r.data) for r in channels.parse_server_events(frame).orderBy("n").collect()] == [("delta", '{"a":1}'), ("message", "x\ny")]


@pytest.mark.parametrize("rounds", [2])
def test_incremental_ingest(spark, tmp_path, rounds):
    source, store = tmp_path / "in", tmp_path / "store"
    source.mkdir()
    for n in range(rounds):
        (source / f"doc{n}.txt").write_text(f"text {n}")
        (source / "sub").mkdir(exist_ok=True)
        (source / "sub" / f"r{n}").mkdir()
        (source / "sub" / f"r{n}" / "same.txt").write_text(f"version {n}")
        ingest.ingest(ingest.stream_files(spark, str(source)), str(store), str(tmp_path / "c")).awaitTermination(120)
    last = ingest.read(spark, str(store)).collect()
    assert sorted((r.filename, r.text) for r in last) == [("doc0.txt", "text 0"), ("doc1.txt", "text 1"), ("same.txt", "version 1")]
    assert len({r.chunk_id for r in last}) == 3
    number, now = commits.state(spark, str(store))
    assert number == rounds and len(now["segments"]) == rounds
    assert spark.read.parquet(f"{store}/{now['segments'][1]}/chunks").count() == 2  # a batch writes its own files only


def test_streams_into_one_store(spark, tmp_path):
    """Another checkpoint replaces what it brings again and nothing else; a batch that is repeated changes nothing; a removal stays."""
    store = str(tmp_path / "store")
    bring = lambda folder, checkpoint: ingest.ingest(ingest.stream_files(spark, str(tmp_path / folder)), store, str(tmp_path / checkpoint)).awaitTermination(120)
    shown = lambda: sorted((r.filename, r.text) for r in ingest.read(spark, store).collect())
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / f"{name}.txt").write_text(f"words of {name}")
        bring(name, "c-" + name)
    assert shown() == [("a.txt", "words of a"), ("b.txt", "words of b")]
    segments.change(spark, store, remove=spark.createDataFrame([("A.txt",)], "filename string"))
    (tmp_path / "b" / "c.txt").write_text("words of c")
    bring("b", "c-b")
    assert shown() == [("b.txt", "words of b"), ("c.txt", "words of c")]
    version, now = commits.state(spark, store)
    name, batch = next((k, v) for k, v in now["streams"].items() if v == 1)
    again = spark.createDataFrame([("c.txt", "not again")], "filename string, text string")
    assert segments.change(spark, store, again, stream=(name, batch)) == version and shown()[1] == ("c.txt", "words of c")
    queries = spark.createDataFrame([(1, "words of c")], "query_id long, query string")
    assert [r.chunk_id for r in sparse.search(queries, segments.index(spark, store), 5).collect()][0] == ingest.read(spark, store).where("filename = 'c.txt'").first().chunk_id


def test_the_last_path_counts(spark, tmp_path):
    for folder, text in (("a", "zzz"), ("b", "aaa")):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "x.txt").write_text(text)
    ingest.ingest(ingest.stream_files(spark, str(tmp_path / "in")), str(tmp_path / "s"), str(tmp_path / "c")).awaitTermination(120)
    assert [r.text for r in ingest.read(spark, str(tmp_path / "s")).collect()] == ["aaa"]


def test_server_event_pieces(spark, tmp_path):
    """A stream of event text cut anywhere: the tail is carried on."""
    text = 'event: meta\r\ndata: {}\r\n\r\nevent: delta\ndata: x\ndata: y\n\ndata: z\n\nevent: cut\ndata: q'
    expected = [("meta", "{}"), ("delta", "x\ny"), ("message", "z")]
    for i in range(len(text)):
        for j in range(i, len(text), 5):
            tail, blocks = "", []
            for piece in (text[:i], text[i:j], text[j:]):
                more, tail = channels.take_blocks(tail, piece)
                blocks += more
            assert list(map(channels.read_block, blocks)) == expected
    source = tmp_path / "in"
    source.mkdir()
    for n in range(3):
        rows = [{"request_id": "x", "piece_no": i, "piece": text[i], "last": i == len(text) - 1} for i in range(n * 30, min(len(text), n * 30 + 30))]
        (source / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{n}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    stream = spark.readStream.schema("request_id string, piece_no long, piece string, last boolean").option("maxFilesPerTrigger", 1).json(str(source))
    query = channels.parse_server_pieces(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [(r.event, r.data) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect()] == expected


def test_error_events(spark):
    events = spark.createDataFrame([("a", 0, "answer", "x"), ("b", 0, "thinking", "t"), ("b", 1, "summary", "s")], "request_id string, seq long, channel string, text string")
    errors = spark.createDataFrame([("b", "lost"), ("c", "never began")], "request_id string, message string")
    sent = channels.server_events(events, errors)
    got = {}
    for r in sent.orderBy("request_id", "n").collect():
        got.setdefault(r.request_id, []).append((r.event, r.data))
    assert got == {"a": [("meta", "{}"), ("delta", '{"text":"x"}'), ("done", "{}")], "b": [("meta", "{}"), ("thinking_delta", '{"text":"t"}'), ("error", '{"message":"lost"}')], "c": [("meta", "{}"), ("error", '{"message":"never began"}')]}
    texts = {r.request_id: r.text for r in channels.event_texts(sent).collect()}
    assert texts["c"] == 'event: meta\ndata: {}\n\nevent: error\ndata: {"message":"never began"}\n\n'
