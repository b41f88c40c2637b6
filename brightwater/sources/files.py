"""Documents from files, and the tables of the store."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import merge_aliases
from . import commits
from .parsers import PARSERS, local_file_text, uploaded_text

EXTENSIONS = ("txt", "md", "docx", "doc", "pdf", "xlsx", "xls", "ofd", "wps", "html", "htm")


def read_files(spark: SparkSession, paths: str | Sequence[str], extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(path, filename, modificationTime, length, content) of the files of these types under the paths, folders included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.where(kind.isin(*extensions)).select("path", name.alias("filename"), "modificationTime", "length", "content")


def parse_files(files: DataFrame, uploads: bool = False, parsers=PARSERS) -> DataFrame:
    """(filename, text, error): each file parsed by its type; one that fails keeps its row, with the error in place of the text.

    ``uploads``: the rules for uploads (a column ``encoding`` may give the encoding), else those for local files.
    """
    encoding = F.col("encoding") if "encoding" in files.columns else F.lit(None).cast("string")

    def run(batches):
        for batch in batches:
            texts, errors = [], []
            for name, data, enc in zip(*(batch.column(i).to_pylist() for i in range(3))):
                try:
                    texts.append(uploaded_text(name, data or b"", enc, parsers) if uploads else local_file_text(name, data or b"", parsers))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a file's error is its result
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], names=["filename", "text", "error"])

    return files.select("filename", "content", encoding.alias("encoding")).mapInArrow(run, "filename string, text string, error string")


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, modificationTime, length) without the contents."""
    return read_files(spark, path).select("filename", "modificationTime", "length")


def original(spark: SparkSession, folder: str, filename: str) -> DataFrame:
    """One stored file by base name: filename, length, content and whether it is text."""
    base = filename.replace("\\", "/").rsplit("/", 1)[-1]
    if base in ("", ".", ".."):
        raise ValueError("not a file name")
    found = spark.read.format("binaryFile").option("pathGlobFilter", base.translate(str.maketrans({c: "\\" + c for c in "*?[]{}\\"}))).load(folder)
    kind = F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))
    return found.select(F.lit(base).alias("filename"), "length", "content", kind.isin("txt", "md", "csv", "json", "log", "html", "xml").alias("is_text"))


def read_aliases(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The alias table of a small JSON file, under ``aliases`` or bare; a missing or bad file gives none."""
    try:
        raw = json.loads(spark.read.text(path, wholetext=True).first().value)
    except Exception:  # noqa: BLE001  a bad file is an empty table
        return {}
    table = raw.get("aliases", raw) if isinstance(raw, dict) else None
    return merge_aliases(table)


def write_store(chunks: DataFrame, path: str, buckets: int = 16, expected: int | None = None) -> int:
    """The chunk table, dealt by a hash of the document, as the version after ``expected`` (default: the latest now); returns its number.

    Data goes to a folder of its own, and one small file, which only one writer can put, makes it the version: of two writers of one version the later one gets ``Conflict``, and
    what it wrote is no version's. Versions that are there stay as they are, so ``chunks`` may come of one, and readers are not disturbed.
    """
    spark = chunks.sparkSession
    number = (max(store_versions(spark, path), default=0) if expected is None else expected) + 1
    data = f"data-{uuid.uuid4().hex}"
    dealt = chunks.withColumn("bucket", F.pmod(F.xxhash64("filename"), F.lit(buckets)))
    dealt.write.partitionBy("bucket").parquet(f"{path}/{data}")
    commits.commit(spark, path, number, {"data": data})
    return number


def store_versions(spark: SparkSession, path: str) -> list[int]:
    """The numbers of a store's versions."""
    return commits.versions(spark, path)


def read_store(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the store, the latest unless told otherwise."""
    number, now = commits.state(spark, path, version)
    if not number:
        raise FileNotFoundError(f"no store in {path}")
    return spark.read.parquet(f"{path}/{now['data']}").drop("bucket")


def export_csv(rows: DataFrame, path: str) -> None:
    """Quoted CSV, quotes doubled, lines ended by CRLF. Each part file is whole in itself: a byte-order mark in front, then the header."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *[quoted(F.col(f"`{c}`").cast("string")) for c in rows.columns])
    header = "\ufeff" + ",".join('"' + c.replace('"', '""') + '"' for c in rows.columns)

    def headed(batches):
        first = True
        for batch in batches:
            lines = [*([header] if first else []), *batch.column(0).to_pylist()]
            first = False
            yield pa.RecordBatch.from_arrays([pa.array([x + "\r" for x in lines], pa.string())], names=["value"])

    rows.select(line.alias("value")).mapInArrow(headed, "value string").write.mode("overwrite").option("lineSep", "\n").text(path)
