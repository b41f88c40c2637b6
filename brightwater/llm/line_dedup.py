"""Line dedup: drop lines that many documents share."""

from __future__ import annotations

import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stored

BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased (only those: other letters keep their case)."""
    bare = F.btrim(line, F.lit(BLANKS))
    ascii_only = F.octet_length(bare) == F.length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 40,
    min_docs: int = 5,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per input row: id, kept_text, n_lines, n_dropped, and the row's own ``carry`` columns.

    Lines explode, their keys hash to 128 bits, and a hash counts each document once (distinct
    within the document before the shuffle, so counts combine on the map side however hot a line is).
    Keys of ``min_chars`` code points or more found in ``min_docs`` documents lose all their lines
    but those of the largest id that holds them; the positions that go are joined back to the texts,
    which are reassembled in order.

    Null and empty texts are one empty line. Rows with a null id are kept whole. Rows that repeat an id
    count as one document for a key, and each loses its own lines. Only the id, text and ``carry`` columns
    are read, so other columns of ``docs`` can have any names. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), *([F.struct(*carry).alias("carried")] if carry else []))
    lines = F.split("body", "\n", -1)
    keys = F.transform(lines, lambda x, i: F.struct(i.alias("pos"), line_key(x).alias("k")))
    hashed = F.transform(
        F.filter(keys, lambda x: F.length(x["k"]) >= min_chars),
        lambda x: F.struct(x["pos"].alias("pos"), F.md5(x["k"]).alias("h")),
    )
    known = rows.where("id is not null").select("id", hashed.alias("ks"))
    held = known.select("id", F.explode(F.array_distinct(F.transform("ks", lambda x: x["h"]))).alias("h"))
    unique = docs.select(id_col).where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count() == 0
    if not unique:
        held = held.distinct()
    common = stored(held.groupBy("h").agg(F.count("*").alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs).drop("n"), "lines")
    at = known.select("id", F.explode("ks").alias("x")).select("id", "x.pos", "x.h")
    gone = at.join(common, "h").where("id <> keeper").groupBy("id").agg(F.collect_set("pos").alias("drop"))
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    if not unique:  # positions belong to a row, not to an id: mark rows by their text as well
        at = known.join(rows, "id", "leftsemi")
        texts = rows.where("id is not null").select("id", "body", F.md5("body").alias("m"))
        at = texts.select("id", "m", F.explode(hashed).alias("x")).select("id", "m", "x.pos", "x.h")
        gone = at.join(common, "h").where("id <> keeper").groupBy("id", "m").agg(F.collect_set("pos").alias("drop"))
        joined = rows.withColumn("m", F.md5("body")).join(gone, ["id", "m"], "left").drop("m")
    else:
        joined = rows.join(gone, "id", "left")
    if not carry:
        return joined.select("id", "body", "drop").mapInArrow(_reassemble, T.StructType(fields)).withColumnRenamed("id", id_col)
    out = joined.select("id", "body", "drop", "carried").mapInArrow(_reassemble, T.StructType([*fields, rows.schema["carried"]]))
    return out.select(F.col("id").alias(id_col), "kept_text", "n_lines", "n_dropped", "carried.*")


def _reassemble(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            part = batch.slice(start, 512)
            kept, n, k = [], [], []
            for body, drop in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                lines = body.split("\n")
                gone = set(drop or ())
                kept.append("\n".join([x for i, x in enumerate(lines) if i not in gone]) if gone else body)
                n.append(len(lines))
                k.append(len(gone))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(k, pa.int64()), *part.columns[3:]], names=["id", "kept_text", "n_lines", "n_dropped", "carried"][: 1 + part.num_columns])
