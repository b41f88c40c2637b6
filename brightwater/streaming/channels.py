"""Answer streams split into their channels, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.text import SUMMARY, THINK, clean_answer, clean_thinking

OPEN = {THINK[0]: "thinking", SUMMARY[0]: "summary"}
CLOSE = {"thinking": THINK[1], "summary": SUMMARY[1]}


def feed(mode: str, buffer: str, piece: str) -> tuple[str, str, list[tuple[str, str]]]:
    """One piece more: (mode, text held back, events). A tag may come in parts, so as much as could begin one is held back."""
    buffer, events = buffer + piece, []
    while buffer:
        tags = OPEN if mode == "answer" else {CLOSE[mode]: "answer"}
        at, tag = min(((i, t) for t in tags if (i := buffer.find(t)) >= 0), default=(-1, ""))
        if at < 0:
            cut = len(buffer) - (max(map(len, tags)) - 1)
            if cut > 0:
                events.append((mode, buffer[:cut]))
                buffer = buffer[cut:]
            break
        if at:
            events.append((mode, buffer[:at]))
        mode, buffer = tags[tag], buffer[at + len(tag) :]
    return mode, buffer, events


class _Splitter(StatefulProcessor):
    """Per request: its mode and the text held back. A row marked ``last`` flushes both."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("split", "mode string, buffer string, seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mode, buffer, seq = tuple(self.state.get()) if self.state.exists() else ("answer", "", 0)
        out, done = [], False
        for piece, last in sorted_pieces(rows):
            mode, buffer, events = feed(mode, buffer, piece or "")
            if last:
                done = True
                events += [(mode, buffer)] if buffer else []
                buffer = ""
            for channel, text in events:
                out.append((key[0], seq, channel, text))
                seq += 1
        if done:
            self.state.clear()
        else:
            self.state.update((mode, buffer, seq))
        yield pd.DataFrame(out, columns=["request_id", "seq", "channel", "text"])

    def close(self) -> None:
        pass


def sorted_pieces(rows: Iterator[pd.DataFrame]) -> list[tuple[str, bool]]:
    """One request's pieces of one batch, in order."""
    together = pd.concat(list(rows)).sort_values("piece_no")
    return list(zip(together["piece"], together["last"]))


def split_channels(pieces: DataFrame) -> DataFrame:
    """A stream of (request_id, piece_no, piece, last) as events (request_id, seq, channel, text): answer, thinking or summary.

    State per request lives in the state store and ends with the request's last piece.
    """
    return pieces.groupBy("request_id").transformWithStateInPandas(statefulProcessor=_Splitter(), outputStructType="request_id string, seq long, channel string, text string", outputMode="append", timeMode="None")


def joined(events: DataFrame) -> DataFrame:
    """Per request the whole text of each channel (batch), in order of the events; the summary trimmed."""
    ordered = lambda c: F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("seq", "channel", "text"))), lambda x: x["channel"] == c), lambda x: x["text"]), "")
    return events.groupBy("request_id").agg(ordered("answer").alias("answer"), ordered("thinking").alias("thinking"), F.nullif(F.trim(ordered("summary")), F.lit("")).alias("summary"))


def finished(texts: DataFrame, mixed: bool = True) -> DataFrame:
    """Whole channels (``joined``) as they are kept: residual tags gone, both cleaned. ``mixed``: an answer without thoughts
    that has a "final answer" heading inside is split there, what comes before it being the thoughts."""
    answer, thinking = F.col("answer"), F.col("thinking")
    for tag in (*THINK, *SUMMARY):
        answer, thinking = F.replace(answer, F.lit(tag), F.lit("")), F.replace(thinking, F.lit(tag), F.lit(""))
    plain = texts.select("request_id", answer.alias("answer"), thinking.alias("thinking"), "summary", (F.col("thinking") == "").alias("silent"))
    places = [F.nullif(F.instr(F.lower("answer"), m), F.lit(0)) for m in ("final answer", "最终答案", "【最终答案】")]
    at = F.least(*places)
    before, after = F.trim(F.substring(F.col("answer"), F.lit(1), at - 1)), F.substring(F.col("answer"), at, F.length("answer"))
    split = F.lit(mixed) & F.col("silent") & (at > 1) & (before != "")
    return plain.select(
        "request_id",
        clean_answer(F.when(F.coalesce(split, F.lit(False)), after).otherwise(F.col("answer"))).alias("answer"),
        clean_thinking(F.when(F.coalesce(split, F.lit(False)), before).otherwise(F.col("thinking"))).alias("thinking"),
        "summary",
    )


def server_events(events: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(request_id, n, event, data): meta first, then the deltas, then done, or an error for the requests of ``errors`` (request_id, message),
    which may have no deltas. Summaries are not sent."""
    delta = events.where("channel <> 'summary'").select("request_id", (F.col("seq") + 1).alias("n"), F.when(F.col("channel") == "answer", "delta").otherwise("thinking_delta").alias("event"), F.to_json(F.struct("text")).alias("data"))
    ends = events.groupBy("request_id").agg((F.max("seq") + 2).alias("n"))
    failed = F.lit(None).cast("string")
    if errors is not None:
        ends = ends.join(errors.groupBy("request_id").agg(F.min("message").alias("message")), "request_id", "full").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
        failed = F.col("message")
    meta = ends.select("request_id", F.lit(0).cast("long").alias("n"), F.lit("meta").alias("event"), F.lit("{}").alias("data"))
    last = ends.select("request_id", "n", F.when(failed.isNotNull(), "error").otherwise("done").alias("event"), F.when(failed.isNotNull(), F.to_json(F.struct(failed.alias("message")))).otherwise("{}").alias("data"))
    return meta.unionByName(delta).unionByName(last)


def event_texts(sent: DataFrame) -> DataFrame:
    """(request_id, text): the events of each request as one event-stream text."""
    block = F.concat(F.lit("event: "), F.col("event"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("block")))), lambda x: x["block"])
    return sent.groupBy("request_id").agg(F.array_join(ordered, "").alias("text"))


def write_events(events: DataFrame, path: str, checkpoint: str):
    """A stream's events as they come, each batch in a folder of its own, in order of request and number within its files; a batch that is repeated
    replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.repartition("request_id").sortWithinPartitions("request_id", "seq").write.mode("overwrite").json(f"{path}/batch={number}")

    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Tail(StatefulProcessor):
    """Per request: the text that has not ended with an empty line yet."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tail", "text string, n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, n = tuple(self.state.get()) if self.state.exists() else ("", 0)
        out, done = [], False
        for piece, last in sorted_pieces(rows):
            blocks, tail = take_blocks(tail, piece or "")
            done = done or bool(last)
            for block in blocks:
                out.append((key[0], n, *read_block(block)))
                n += 1
        if done:
            self.state.clear()
        else:
            self.state.update((tail, n))
        yield pd.DataFrame(out, columns=["request_id", "n", "event", "data"])

    def close(self) -> None:
        pass


def take_blocks(tail: str, piece: str) -> tuple[list[str], str]:
    """The blocks that a piece completes, and what is carried on. A CR at the end waits, as an LF may follow."""
    text = tail + piece
    held = "\r" if text.endswith("\r") else ""
    *blocks, rest = text.removesuffix(held).replace("\r\n", "\n").split("\n\n")
    return [b for b in blocks if b.strip()], rest + held


def read_block(block: str) -> tuple[str, str]:
    """(event, data): an event without a name is a message; lines of data are joined."""
    values = [(k, v.removeprefix(" ")) for k, v in (line.split(":", 1) for line in block.split("\n") if ":" in line)]
    return next((v for k, v in values if k == "event" and v), "message"), "\n".join(v for k, v in values if k == "data")


def parse_server_pieces(pieces: DataFrame) -> DataFrame:
    """A stream of (request_id, piece_no, piece, last), cut anywhere, as events (request_id, n, event, data). What follows the last empty
    line is carried to the next piece, and left out if none comes."""
    return pieces.groupBy("request_id").transformWithStateInPandas(statefulProcessor=_Tail(), outputStructType="request_id string, n long, event string, data string", outputMode="append", timeMode="None")


def parse_server_events(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole event streams as (.., n, event, data): blocks end with an empty line; what follows the last one is not complete and left out."""
    blocks = F.split(F.replace(F.col(text_col), F.lit("\r\n"), F.lit("\n")), "\n\n", -1)
    whole = F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0)))
    rows = texts.select(*[c for c in texts.columns if c != text_col], F.posexplode(whole).alias("n", "block"))
    data = F.array_join(F.regexp_extract_all("block", F.lit(r"(?m)^data: ?(.*)$"), 1), "\n")
    return rows.select(*[c for c in rows.columns if c != "block"], F.coalesce(F.nullif(F.regexp_extract("block", r"(?m)^event: ?(.*)$", 1), F.lit("")), F.lit("message")).alias("event"), data.alias("data"))


def stream_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces as they arrive in a folder of JSON lines."""
    return spark.readStream.schema("request_id string, piece_no long, piece string, last boolean").json(folder)
