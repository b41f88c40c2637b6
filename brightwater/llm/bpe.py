"""BPE encoding and decoding through a table of distinct words."""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .shared import discard, parts, stored

#: Bytes of the most frequent words and their ids that go to every executor, and the longest word among them; fixed bounds, whatever
#: the corpus. All other words join by position.
HEAD_BYTES, LONG_WORD = 20 << 20, 64


def read_tokenizer(spark: SparkSession, path: str) -> str:
    """The tokenizer file's JSON: read on the driver (a few MB) and sent along, so executors need no file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


#: What ends a word here, and the white space besides that ``str.split`` would also end one at.
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


#: What lower-cases otherwise than letter by letter, or composes with its neighbours.
_BEYOND = re.compile("[^\x00-\u012f\u0131-\u024f]")


def split_words(text: str, fold: bool) -> list[str]:
    """Runs without ASCII white space. The tokenizer never joins letters across it, so each run can be encoded on its own.

    ``fold``: the tokenizer lower-cases, so Latin texts do beforehand, for fewer distinct words; not where a
    special token may stand, which is told by its case.
    """
    if fold and "<|" not in text and not _BEYOND.search(text):
        text = text.lower()
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def lower_cases(tokenizer_json: str) -> bool:
    """Whether the tokenizer lower-cases. Raises for tokenizers that don't normalise letter by letter and drop white space as they split, or that have a decoder or template."""
    spec = json.loads(tokenizer_json)
    norms = {n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])}
    pre = spec["pre_tokenizer"]["pretokenizers"][0]
    drops = pre["type"] == "Split" and pre["behavior"] == "Removed" and pre["invert"] and "\\s" in pre["pattern"]["Regex"]
    spaced = any(re.search(r"\s", t["content"]) for t in spec["added_tokens"])
    if not norms <= {"NFC", "Replace", "Lowercase"} or not drops or spaced or spec.get("decoder") or spec.get("post_processor"):
        raise ValueError("words of this tokenizer can't be encoded one by one")
    return "Lowercase" in norms and all(t["content"].startswith("<|") for t in spec["added_tokens"])


def distinct_words(texts: DataFrame, fold: bool) -> DataFrame:
    """(word, n): each distinct word of column ``body`` and how often it occurs."""

    def run(batches):
        seen, held = Counter(), 0

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for part in parts(batch, 0):
                for text in part.column(0).to_pylist():
                    seen.update(split_words(text, fold))
                    held += len(text)
                if len(seen) > 400_000 or held > 64 << 20:
                    yield from out()
                    seen.clear()
                    held = 0
        yield from out()

    return texts.select("body").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _encode_words(tokenizer_json: str):
    def run(batches):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        tok = Tokenizer.from_str(tokenizer_json)
        for batch in batches:
            for part in parts(batch, 0, 8192):
                ids = [little_endian(x.ids) for x in tok.encode_batch_fast(part.column(0).to_pylist(), add_special_tokens=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["word", "n", "ids"])

    return run


#: What ``encode_decode`` returns of each text unless told otherwise.
WHOLE = {
    "ids": (T.ArrayType(T.IntegerType()), lambda ids, text: ids),
    "decoded": (T.StringType(), lambda ids, text: text()),
}


def encode_decode(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    outputs: dict[str, tuple[T.DataType, Callable]] = WHOLE,
    head_bytes: int = HEAD_BYTES,
) -> DataFrame:
    """One row per input row: id and ``outputs``, each made from (ids as an array of unsigned 32-bit integers, a function that gives the decoded text).

    1. Split all texts to words and count them: one row per distinct word of the corpus.
    2. Encode each distinct word once; store the table (word, n, ids).
    3. The frequent words go to every executor, in a table of ``head_bytes`` at most, so hot words shuffle nowhere. Each other word of a
       text joins the table on the word and returns to its text by position. That table may be of any size; words that are long or
       stand only once are never in the head, however few words the corpus has.
    4. A text's ids are those of its words in order. Decode them: each joins its piece in the id-to-piece table (``decoded``).
    Texts cross the one shuffle to their positions zstd-compressed.

    Null texts count as empty and have no ids. Rows with null or repeated ids are each encoded by their own
    text. Only the id and text columns are read. An empty table gives an empty table.
    """
    fold = lower_cases(tokenizer_json)
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    body = F.coalesce(F.col(text_col), F.lit(""))
    unique = docs.select(F.col(id_col).alias("id")).groupBy("id").count().where("count > 1").limit(1).count() == 0
    rk = F.lit(0).cast("long") if unique else F.xxhash64(F.col(id_col).cast("string"), body)
    rows = docs.select(F.col(id_col).alias("id"), rk.alias("rk"), body.alias("body"))
    table = stored(distinct_words(rows, fold).mapInArrow(_encode_words(tokenizer_json), "word string, n long, ids binary"), "words")
    head = spark.sparkContext.broadcast(_head(table, head_bytes))

    def rest(batches):
        known = head.value[0]
        for batch in batches:
            for part in parts(batch, 2):
                at, pos, word = [], [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    words = split_words(text, fold)
                    rare = set(words).difference(known)
                    if rare:
                        here = [p for p, w in enumerate(words) if w in rare]
                        at += [i] * len(here)
                        pos += here
                        word += [words[p] for p in here]
                where = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(where), part.column(1).take(where), pa.array([p.to_bytes(4, "little") for p in pos], pa.binary()), pa.array(word, pa.string())], names=["id", "rk", "pos", "word"])

    places = T.StructType([T.StructField("id", kind), T.StructField("rk", T.LongType()), T.StructField("pos", T.BinaryType()), T.StructField("word", T.StringType())])
    found = rows.mapInArrow(rest, places).join(table.select("word", "ids"), "word")
    found = stored(found.groupBy("id", "rk").agg((F.collect_list if unique else F.collect_set)(F.concat("pos", "ids")).alias("tail")), "tails")
    discard(table)
    found = found.select(F.col("id").alias("id_"), F.col("rk").alias("rk_"), "tail")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for part in parts(batch, 2, 512):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([squeeze(x.encode()) for x in part.column(2).to_pylist()], pa.binary())], names=["id", "rk", "z"])

    packed = rows.mapInArrow(pack, T.StructType([T.StructField("id", kind), T.StructField("rk", T.LongType()), T.StructField("z", T.BinaryType())]))
    joined = packed.join(found, F.col("id").eqNullSafe(F.col("id_")) & (F.col("rk") == F.col("rk_")), "left")
    names, made = list(outputs), [f for _, f in outputs.values()]
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, outputs[n][0]) for n in names)])

    def finish(batches):
        (slot, start, flat), pieces = head.value, _pieces(tokenizer_json)
        known, unzip = slot.get, zstandard.ZstdDecompressor().decompress
        size = np.append(np.diff(start), 0)  # the last one, -1: words that come by position
        types = pa.schema([("id", pa.null()), *((n, _arrow(outputs[n][0])) for n in names)])
        for batch in batches:
            for part in parts(batch, 1, 256, 4 << 20):
                ids = []
                for z, tail in zip(part.column(1).to_pylist(), part.column(2)):
                    words = split_words(unzip(z).decode(), fold)
                    at = np.fromiter(map(known, words, itertools.repeat(-1)), np.int64, len(words))
                    n = size[at]
                    done = np.cumsum(n) - n
                    own = flat[np.repeat(start[at] - done, n) + np.arange(n.sum())]
                    if tail.is_valid and len(tail):
                        own = _filled(own, done, tail.as_py())
                    ids.append(own)
                decode = _Decoded(ids, pieces)
                cols = [[f(x, functools.partial(decode, i)) for i, x in enumerate(ids)] for f in made]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, types.field(n).type) for n, c in zip(names, cols))], names=[id_col, *names])

    return joined.select("id", "z", "tail").mapInArrow(finish, schema)


class _Decoded:
    """The texts of some lists of ids, decoded together when the first is asked for."""

    def __init__(self, ids: list[np.ndarray], pieces: pa.Array) -> None:
        self.ids, self.pieces, self.texts = ids, pieces, None

    def __call__(self, i: int) -> str:
        if self.texts is None:
            self.texts = decoded(self.ids, self.pieces)
        return self.texts[i].as_py()


def _filled(ids: np.ndarray, start: np.ndarray, found: list[bytes]) -> np.ndarray:
    """A text's ids with those of its other words. Each of ``found`` is a word's position (32 bits) and its ids; ``start``: where the ids of
    each word begin."""
    found = sorted((int.from_bytes(x[:4], "little"), x[4:]) for x in found)
    each = [np.frombuffer(x, "<u4") for _, x in found]
    return np.insert(ids, np.repeat(start[[p for p, _ in found]], [len(x) for x in each]), np.concatenate(each))


def _pieces(tokenizer_json: str) -> pa.Array:
    """The id-to-piece table, by id; as large as the vocabulary."""
    by_id = {i: s for s, i in Tokenizer.from_str(tokenizer_json).get_vocab(with_added_tokens=True).items()}
    return pa.array([by_id.get(i, "") for i in range(max(by_id, default=-1) + 1)], pa.large_string())


def decoded(ids: list[np.ndarray], pieces: pa.Array) -> pa.Array:
    """The texts of several lists of ids: all ids join their pieces at once, by index, and each text is its pieces in order."""
    ends = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))
    joined = pieces.take(pa.array(np.concatenate([*ids, np.zeros(0, "<u4")]).astype(np.int64)))
    return pc.binary_join(pa.LargeListArray.from_arrays(ends, joined), pa.scalar(" ", pa.large_string()))


def _head(table: DataFrame, most_bytes: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """(slot of each word, where a slot's ids start, all ids) of the most frequent words that take no more than ``most_bytes``.

    Down from the highest count, by sixteenths of its logarithm, so no task sorts the table. Words that stand only once or are
    long don't count as frequent.
    """
    step, size = F.floor(F.log2("n") * 16), F.octet_length("word") + F.octet_length("ids") + 16
    usual = table.where((F.col("n") > 1) & (F.octet_length("word") <= LONG_WORD))
    total, least = 0, 0
    for r in sorted(usual.groupBy(step.alias("step")).agg(F.sum(size).alias("size")).collect(), reverse=True):
        total += r["size"]
        if total > most_bytes:
            least = r["step"] + 1
            break
    found = usual.where(step >= least).select("word", "ids").toArrow()
    ids = found.column("ids").to_pylist()
    start = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int64)
    return {w: i for i, w in enumerate(found.column("word").to_pylist())}, start, np.frombuffer(b"".join(ids), "<u4")


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def decode_ids(encoded: DataFrame, tokenizer_json: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text that a column of ids stands for (see ``decoded``).

    The id-to-piece table is made in the tasks from the tokenizer, so nothing but that is sent. Null ids give a null text, no ids an empty one.
    """
    before = [c for c in encoded.columns if c != out_col]

    def run(batches):
        pieces = _pieces(tokenizer_json)
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            ids = [np.asarray(x.values) if x.is_valid else np.zeros(0, np.int64) for x in column]
            texts = decoded(ids, pieces).cast(pa.string())
            texts = pc.if_else(column.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*before, out_col])

    rows = encoded.select(*[F.col(f"`{c}`") for c in before], F.col(f"`{ids_col}`").cast("array<long>").alias("_ids"))
    return rows.mapInArrow(run, T.StructType([*rows.schema[:-1], T.StructField(out_col, T.StringType())]))


def little_endian(ids) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return np.asarray(ids, "<u4").tobytes()
