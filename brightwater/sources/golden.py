"""Golden sets and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Names of the fields, and the mark of a report.
LIST_FIELDS = ("positives", "positive_filenames", "expected_filenames")
SCALAR_FIELDS = ("expected_filename", "filename")
REPORT_SCHEMA = "kb-eval-report/1"


class DatasetError(ValueError):
    """A golden set that cannot be used; names the line."""


def parse_cases(lines: DataFrame) -> DataFrame:
    """lines (lineno, value) to cases: case_id, query, positives, tags, note, expect_no_source, lineno, problem (null if the line is good). Blank lines and comments are left out."""
    text = F.trim("value")
    kept = lines.where((text != "") & ~text.startswith("#"))
    arrays = ", ".join(f"{n} array<string>" for n in LIST_FIELDS)
    scalars = ", ".join(f"{n} string" for n in SCALAR_FIELDS)
    j = F.from_json("value", f"id string, query string, {arrays}, {scalars}, tags array<string>, note string, expect_no_source boolean, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    p = kept.select("lineno", "value", j.alias("j"))
    none = F.array().cast("array<string>")

    def bare(a: Column) -> Column:
        return F.filter(F.transform(F.coalesce(a, none), lambda x: F.trim(x)), lambda x: x != "")

    answers = none
    for name in LIST_FIELDS:
        answers = F.concat(answers, bare(F.col(f"j.{name}")))
    for name in SCALAR_FIELDS:
        answers = F.concat(answers, bare(F.array(F.coalesce(F.col(f"j.{name}"), F.lit("")))))
    query, negative = F.trim(F.coalesce("j.query", F.lit(""))), F.coalesce("j.expect_no_source", F.lit(False))
    case_id = F.coalesce(F.nullif(F.trim("j.id"), F.lit("")), F.format_string("case-%04d", "lineno"))
    cases = p.select("lineno", case_id.alias("case_id"), query.alias("query"), F.array_distinct(answers).alias("positives"), bare(F.col("j.tags")).alias("tags"), F.coalesce("j.note", F.lit("")).alias("note"), negative.alias("expect_no_source"), (F.try_parse_json("value").isNull() | ~F.trim("value").startswith("{")).alias("bad"))
    twice = F.count("*").over(Window.partitionBy("case_id")) > 1
    problem = (
        F.when(F.col("bad"), "not a JSON object")
        .when(F.col("query") == "", "no query")
        .when(F.col("expect_no_source") & (F.size("positives") > 0), "both expect_no_source and an answer")
        .when(~F.col("expect_no_source") & (F.size("positives") == 0), "no answer")
        .when(twice, "duplicate id")
    )
    return cases.withColumn("problem", problem).drop("bad")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(lineno, value): the lines of each file, numbered from 1. Lines are counted within the parts that the file is read in, and the counts of
    earlier parts added, so no task needs the whole file."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("part"), F.monotonically_increasing_id().alias("at"), "value")
    earlier = Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lines.groupBy("file", "part").agg(F.count("*").alias("n")).select("file", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("file", "part").orderBy("at"))
    return lines.withColumn("i", within).join(sizes, ["file", "part"]).select((F.col("i") + F.col("before")).alias("lineno"), "value")


def load_cases(spark: SparkSession, path: str) -> DataFrame:
    """A golden set of a JSONL file, strictly: the first bad line raises with its number, and so does an empty set."""
    cases = parse_cases(numbered_lines(spark, path))
    bad = cases.where("problem is not null").orderBy("lineno").select("lineno", "problem").first()
    if bad:
        raise DatasetError(f"line {bad.lineno}: {bad.problem}")
    if cases.limit(1).count() == 0:
        raise DatasetError("the set is empty")
    return cases.drop("problem", "lineno")


def tags(cases: DataFrame) -> DataFrame:
    return cases.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def save_report(report: DataFrame, folder: str) -> None:
    """Append a report (columns: generated_at, summary ...) to the folder's table."""
    report.withColumn("schema", F.lit(REPORT_SCHEMA)).write.mode("append").json(folder)


def reports(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Reports of the folder, the latest first; files that are no reports are left out."""
    rows = spark.read.schema(f"schema string, {schema}").json(folder)
    return rows.where(F.col("schema") == REPORT_SCHEMA).orderBy(F.desc("generated_at"))


def latest_report(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return reports(spark, folder, schema).limit(1)
