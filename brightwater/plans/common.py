"""What the registered queries share: tables, chunk and query views, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import sparse
from ..sources.scratch import exists, new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks of a store: chunk_id, filename (source/doc_id.txt), text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")


def vector_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All chunks with their vectors: those of ``embeddings`` by id, null where there is none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return chunks(spark, sf_dir).join(vectors, "chunk_id", "left")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries: query_id, query."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def known_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages as queries with vectors: that of the same id, null where there is none."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return items(spark, sf_dir).join(vectors, "query_id", "left")


_indexes: dict[tuple, str] = {}


def _files(spark: SparkSession, df: DataFrame) -> tuple:
    """A table's files with their lengths and times: other contents, other files."""
    conf, path = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs.Path
    found = [path(f) for f in sorted(df.inputFiles())]
    return tuple((s.getPath().toString(), s.getLen(), s.getModificationTime()) for s in (f.getFileSystem(conf).getFileStatus(f) for f in found))


def index(spark: SparkSession, sf_dir: str) -> sparse.Index:
    """The stored index of the documents, built when a session first asks for it, and again when the table's files have changed."""
    key = (spark.sparkContext.applicationId, _files(spark, table(spark, sf_dir, "documents")))
    if key not in _indexes or not exists(spark, _indexes[key]):
        path = new_folder(spark, "index")
        sparse.index(chunks(spark, sf_dir), path)
        _indexes[key] = path
    return sparse.read_index(spark, _indexes[key])


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as a message log: id, session_id, user_id, action, query, answer, timestamp (seconds)."""
    c = table(spark, sf_dir, "conversations")
    number = F.col("conv_id") * 1000 + F.col("turn")
    user = F.concat(F.lit("u"), (F.col("conv_id") % 7).cast("string"))
    return c.select(
        number.alias("id"), F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"), user.alias("user_id"),
        F.when(F.col("turn") % 3 == 2, "search").otherwise("query").alias("action"), F.when(F.col("role") != "assistant", F.col("text")).alias("query"),
        F.when(F.col("role") == "assistant", F.col("text")).alias("answer"), (1_700_000_000 + number).alias("timestamp"),
    )


#: The same views in SQL.
VIEWS = {
    "chunks": "SELECT doc_id AS chunk_id, source || '/' || doc_id || '.txt' AS filename, text FROM documents",
    "vchunks": "SELECT c.*, e.embedding FROM chunks c LEFT JOIN embeddings e ON e.vec_id = c.chunk_id",
    "items": "SELECT b.item_id AS query_id, b.text AS query, e.embedding AS vector FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id",
    "messages": "SELECT conv_id * 1000 + turn AS id, 's' || conv_id AS session_id, 'u' || (conv_id % 7) AS user_id, CASE WHEN turn % 3 = 2 THEN 'search' ELSE 'query' END AS action, CASE WHEN role <> 'assistant' THEN text END AS query, CASE WHEN role = 'assistant' THEN text END AS answer, 1700000000 + conv_id * 1000 + turn AS timestamp FROM conversations",
}


def sql(views: str, rest: str) -> str:
    """A statement over some of ``VIEWS``. ``rest`` may begin with further views and a comma."""
    return "WITH " + ", ".join(f"{v} AS ({VIEWS[v]})" for v in views.split()) + (", " if " AS (" in rest.split("SELECT", 1)[0] else " ") + rest


def plain(df: DataFrame) -> DataFrame:
    """Integers as longs and arrays as text, so that results compare by value."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
        out.append(c.alias(f.name))
    return df.select(*out)
