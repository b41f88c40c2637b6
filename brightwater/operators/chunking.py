"""Chunking as column expressions: paragraphs, sentences, fixed lengths, then a greedy fold with overlap."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SENTENCE_ENDS, strip_ws

_ENDS = f"[{SENTENCE_ENDS}]"


def _bare(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip_ws), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    """Parts between blank lines; a text of one paragraph gives its lines."""
    t = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    blocks, lines = _bare(F.split(t, r"(?U)\n\s*\n", -1)), _bare(F.split(t, "\n", -1))
    return F.when((F.size(blocks) <= 1) & (F.size(lines) > 1), lines).otherwise(blocks)


def sentences(text: Column) -> Column:
    """Parts that end with a terminator, kept; a full stop is none."""
    return _bare(F.split(text, f"(?<={_ENDS})", -1))


def by_length(text: Column, size: int) -> Column:
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(max(1, size)))
    return _bare(F.transform(starts, lambda i: F.substring(text, i + 1, F.lit(max(1, size)))))


def trim_overlap(text: Column) -> Column:
    """What follows the last terminator of the first line that has one; all of it without any."""
    return strip_ws(F.regexp_replace(text, f"^[^{SENTENCE_ENDS}]*{_ENDS}(?:[^\\n]*{_ENDS})?", ""))


def segments(text: Column, size: int) -> Column:
    def cut(part: Column, smaller) -> Column:
        return F.when(F.length(part) <= size, F.array(part)).otherwise(smaller(part))

    return F.flatten(F.transform(paragraphs(text), lambda p: cut(p, lambda q: F.flatten(F.transform(sentences(q), lambda s: cut(s, lambda x: by_length(x, size)))))))


def pack(parts: Column, size: int, overlap: int) -> Column:
    """Segments joined by newlines while they fit; the next chunk begins with the end of the last one. A chunk may exceed
    ``size`` by the overlap and one."""
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def step(acc: Column, seg: Column) -> Column:
        out, cur = acc["out"], acc["cur"]
        tail = trim_overlap(F.right(cur, F.lit(overlap))) if overlap > 0 else F.lit("")
        opened = F.when(tail == "", seg).otherwise(strip_ws(F.concat(tail, F.lit("\n"), seg)))
        fits = F.length(cur) + 1 + F.length(seg) <= size
        return (
            F.when(cur == "", F.struct(out.alias("out"), seg.alias("cur")))
            .when(fits, F.struct(out.alias("out"), F.concat(cur, F.lit("\n"), seg).alias("cur")))
            .otherwise(F.struct(F.concat(out, F.array(strip_ws(cur))).alias("out"), opened.alias("cur")))
        )

    return F.aggregate(parts, empty, step, lambda acc: F.when(acc["cur"] == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(strip_ws(acc["cur"])))))


def chunks_of(text: Column, size: int = 800, overlap: int = 120) -> Column:
    """The chunks of a text as an array; one if it fits, none if it is blank."""
    t = strip_ws(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= size, F.array(t)).otherwise(pack(segments(t, size), size, overlap))


def chunk_documents(documents: DataFrame, size: int = 800, overlap: int = 120, text_col: str = "text") -> DataFrame:
    """Every row once per chunk: the other columns, chunk_index (from 0) and text.

    Segments are made in one step and packed in the next: each step's input is a column, computed once.
    """
    rest = [c for c in documents.columns if c != text_col]
    t = strip_ws(F.coalesce(F.col(text_col), F.lit("")))
    cut = documents.select(*rest, t.alias("t")).withColumn("parts", F.when(F.length("t") > size, segments(F.col("t"), size)))
    packed = F.when(F.col("t") == "", F.array().cast("array<string>")).when(F.col("parts").isNull(), F.array("t")).otherwise(pack(F.col("parts"), size, overlap))
    return cut.select(*rest, F.posexplode(packed).alias("chunk_index", "text"))


#: Bytes of text of which a task holds the parts at a time; a longer text goes alone.
SLICE_BYTES = 2 << 20


def _slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES):
    """The rows of a batch, in order, in slices of at most so many bytes of text."""
    ends = np.append(0, np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy().astype(np.int64)))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


#: Makes a function of (text, size, overlap) to the parts of a text. Called once per task, so a model loads there.
SplitterFactory = Callable[[], Callable[[str, int, int], Sequence[str]]]


def chunk_with(documents: DataFrame, factory: SplitterFactory, size: int = 800, overlap: int = 120, text_col: str = "text") -> DataFrame:
    """As ``chunk_documents``, with a splitter by meaning for texts over ``size``: the other columns, chunk_index, text, split ("whole", "semantic" or "fixed") and error.

    A text that the splitter fails for, or gives no parts for, is cut by lengths as ever; every chunk of it says what the error was (null if there were just no parts). The
    splitter runs in the tasks, on the texts that need it, an Arrow batch at a time; the rest stays in columns. Nothing is shuffled.
    """
    rest = [c for c in documents.columns if c != text_col]
    t = strip_ws(F.coalesce(F.col(text_col), F.lit("")))
    rows = documents.select(*rest, t.alias("t"))
    found = T.StructType([*rows.schema, T.StructField("parts", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])

    def run(batches):
        split = None
        for whole in batches:
            for batch in _slices(whole, len(rest)):
                parts, errors = [], []
                for text in batch.column(len(rest)).to_pylist():
                    got, error = None, None
                    if len(text) > size:
                        try:
                            split = split or factory()
                            got = [str(x) for x in split(text, size, overlap)] or None
                        except Exception as e:  # noqa: BLE001  a splitter that fails is no end of the job
                            error = f"{type(e).__name__}: {e}"
                    parts.append(got)
                    errors.append(error)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.list_(pa.string())), pa.array(errors, pa.string())], names=found.fieldNames())

    cut = rows.mapInArrow(run, found)
    long = F.length("t") > size
    kind = F.when(~long, "whole").when(F.col("parts").isNotNull(), "semantic").otherwise("fixed")
    cut = cut.select(*rest, "t", "parts", "error", kind.alias("split")).withColumn("segments", F.when(F.col("split") == "fixed", segments(F.col("t"), size)))
    packed = F.when(F.col("t") == "", F.array().cast("array<string>")).when(F.col("split") == "whole", F.array("t")).when(F.col("split") == "semantic", F.col("parts")).otherwise(pack(F.col("segments"), size, overlap))
    return cut.select(*rest, "split", "error", F.posexplode(packed).alias("chunk_index", "text")).select(*rest, "chunk_index", "text", "split", "error")
