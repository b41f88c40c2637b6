"""Where models come in: embedders and rerankers as functions of batches, one instance per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import model_key

#: Makes a function of texts to rows of numbers. Called once per task, so a model loads there.
EmbedderFactory = Callable[[], Callable[[Sequence[str]], np.ndarray]]
#: Makes a function of (query, texts) to one score per text; None where it could not score.
RerankerFactory = Callable[[], Callable[[str, Sequence[str]], "Sequence[float] | None"]]


def embed(rows: DataFrame, factory: EmbedderFactory, model: str, text_col: str = "text", out_col: str = "embedding", batch: int = 16) -> DataFrame:
    """Rows with a unit vector of their text and the name of the model that made it. Null texts have no vector."""
    schema = T.StructType([*rows.drop(out_col, "model").schema, T.StructField(out_col, T.ArrayType(T.FloatType())), T.StructField("model", T.StringType())])
    kept, at = rows.drop(out_col, "model"), rows.drop(out_col, "model").columns.index(text_col)

    def run(batches):
        make = factory()
        for b in batches:
            texts = b.column(at).to_pylist()
            out: list = [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t is not None]
            for lo in range(0, len(known), batch):
                part = known[lo : lo + batch]
                v = np.asarray(make([texts[i] for i in part]), np.float64)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                for i, x in zip(part, v.astype(np.float32)):
                    out[i] = x.tolist()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.float32())), pa.array([model] * len(texts), pa.string())], names=schema.fieldNames())

    return kept.mapInArrow(run, schema)


def refresh(rows: DataFrame, factory: EmbedderFactory, model: str, dim: int, text_col: str = "text", batch: int = 16) -> DataFrame:
    """Rows (with embedding and model) whose vector is missing, of another length than ``dim`` or of another model get one anew; the others keep theirs."""
    good = F.col("embedding").isNotNull() & (F.size("embedding") == dim) & (model_key(F.col("model")) == model_key(F.lit(model)))
    good = F.coalesce(good, F.lit(False))
    return rows.where(good).unionByName(embed(rows.where(~good), factory, model, text_col, "embedding", batch))


def rerank(candidates: DataFrame, factory: RerankerFactory, query_col: str = "query", text_col: str = "text", batch: int = 8) -> DataFrame:
    """Candidates with rerank_raw: texts of a query scored in batches. A query that the model fails for has nulls, which ``fusion.rerank_scores`` marks as failed."""
    rest = [c for c in candidates.columns if c != "rerank_raw"]
    schema = T.StructType([*candidates.select(*rest).schema, T.StructField("rerank_raw", T.DoubleType())])
    q, t = rest.index(query_col), rest.index(text_col)

    def run(batches):
        score = factory()
        for b in batches:
            queries, texts = b.column(q).to_pylist(), b.column(t).to_pylist()
            out: list = [None] * len(texts)
            lo = 0
            while lo < len(texts):
                hi = lo
                while hi < len(texts) and queries[hi] == queries[lo] and hi - lo < batch:
                    hi += 1
                try:
                    got = score(queries[lo], texts[lo:hi])
                except Exception:  # noqa: BLE001  a failed model is a status and not the end of the job
                    got = None
                if got is not None and len(got) == hi - lo:
                    out[lo:hi] = [float(x) for x in got]
                lo = hi
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], names=schema.fieldNames())

    return candidates.select(*rest).mapInArrow(run, schema)


def reranker(factory: RerankerFactory):
    """For ``retrieval.search(reranked=...)``: raw scores, then probabilities and status per query."""
    from .fusion import rerank_scores

    return lambda candidates: rerank_scores(rerank(candidates, factory))


#: Makes a function of a prompt to its answer, in pieces as they come. Called once per task.
ChatFactory = Callable[[], Callable[[str], "Iterator[str]"]]
CHAT_PIECES = "request_id string, piece_no long, piece string, last boolean, error string"


def chat(prompts: DataFrame, factory: ChatFactory, id_col: str = "request_id", prompt_col: str = "prompt") -> DataFrame:
    """(request_id, piece_no, piece, last, error): the answers to prompts in pieces, as ``channels.split_channels`` takes them; for tables and for streams.

    A piece leaves the task in a batch of its own as soon as the model gives it; the answer ends with an empty one marked ``last``. A request that fails ends with its error there, after the
    pieces that it had, and does not stop the others; a null prompt is an error.
    """
    rows = prompts.select(F.col(id_col).cast("string").alias("request_id"), F.col(prompt_col).alias("prompt"))
    schema = pa.schema([("request_id", pa.string()), ("piece_no", pa.int64()), ("piece", pa.string()), ("last", pa.bool_()), ("error", pa.string())])

    def run(batches):
        answer = None
        one = lambda *row: pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
        for batch in batches:
            for request, prompt in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, error = 0, None
                try:
                    if prompt is None:
                        raise ValueError("there is no prompt")
                    answer = answer or factory()
                    for piece in answer(prompt):
                        yield one(request, n, str(piece), False, None)
                        n += 1
                except Exception as e:  # noqa: BLE001  a failed request is a result
                    error = f"{type(e).__name__}: {e}"
                yield one(request, n, "", True, error)

    return rows.mapInArrow(run, CHAT_PIECES)


def chat_once(prompts: DataFrame, factory: ChatFactory, id_col: str = "request_id", prompt_col: str = "prompt") -> DataFrame:
    """(request_id, answer, error): whole answers; null for requests that failed."""
    pieces = chat(prompts, factory, id_col, prompt_col)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("piece_no", "piece"))), lambda x: x["piece"]), "")
    out = pieces.groupBy("request_id").agg(text.alias("answer"), F.max("error").alias("error"))
    return out.select("request_id", F.when(F.col("error").isNull(), F.col("answer")).alias("answer"), "error")


def model_lists(offered: DataFrame) -> DataFrame:
    """(provider, n, models): what each provider offers, names once each in order."""
    one = offered.where("name is not null").select("provider", "name").distinct()
    order = Window.partitionBy("provider").orderBy(F.lower("name"), "name")
    return one.withColumn("n", F.row_number().over(order))
