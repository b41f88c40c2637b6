"""Rows packed to bundles: what a bundle's texts share is combined before it is shuffled, and answers return by position."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import parts, stored_by

#: Text in one bundle, and for each bucket of hashes that one task holds.
BUNDLE_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: Text in each file of the table of bundles, while there are no more files than these.
FILE_BYTES, MOST_FILES = 16 << 20, 50_000


def bundled(docs: DataFrame, id_col: str, text_col: str, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """(bundle, ids, sizes, z, bytes), stored: some rows' ids, sizes (32 bits each) and texts in UTF-8, compressed. A null text is empty.

    A bundle has about ``bundle_bytes`` of text, one row at least. As the table is stored, a bundle is the same whenever it is read; it is
    dealt out by the bundle's number, so what returns to the bundles moves to the texts and not they to it.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))

    def run(batches):
        task, number = TaskContext.get().partitionId(), 0
        ids: list[pa.Array] = []
        raws: list[bytes] = []
        held = 0

        def out():
            owner = pa.ListArray.from_arrays([0, len(raws)], pa.concat_arrays(ids))
            sizes = np.array([len(x) for x in raws], "<i4").tobytes()
            return pa.RecordBatch.from_arrays([pa.array([(task << 32) + number]), owner, pa.array([sizes], pa.binary()), pa.array([pack(b"".join(raws))], pa.binary()), pa.array([held])], names=["bundle", "ids", "sizes", "z", "bytes"])

        for batch in batches:
            for part in parts(batch, 1, 256, bundle_bytes):
                ids.append(part.column(0))
                more = [x.encode() for x in part.column(1).to_pylist()]
                raws += more
                held += sum(map(len, more))
                if held >= bundle_bytes or len(raws) >= 1 << 16:
                    yield out()
                    number += 1
                    ids, raws, held = [], [], 0
        if raws:
            yield out()

    fields = [T.StructField("bundle", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)), T.StructField("sizes", T.BinaryType()), T.StructField("z", T.BinaryType()), T.StructField("bytes", T.LongType())]
    total = rows.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    return stored_by(rows.mapInArrow(run, T.StructType(fields)), "bundle", max(1, min(MOST_FILES, -(-total // FILE_BYTES))), "bundles")


def bucket_count(bundles: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(1, -(-(bundles.agg(F.sum("bytes")).first()[0] or 0) // bucket_bytes))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of 64-bit hashes, in their order."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def rows_of(batch, *names: str):
    """Rows as tuples of Python values; ids stay an Arrow array."""
    at = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
    for i in range(batch.num_rows):
        yield tuple(at[n][i].values if n == "ids" else at[n][i].as_py() for n in names)


def ranks(ids: pa.Array) -> np.ndarray:
    """Dense ranks of the values from 0; nulls have -1."""
    order = np.asarray(pc.rank(ids, sort_keys="ascending", null_placement="at_end", tiebreaker="dense"), np.int64) - 1
    return np.where(np.asarray(pc.is_valid(ids)), order, -1)


def cut_up(raw: bytes, sizes: bytes) -> list[bytes]:
    """A bundle's texts."""
    ends = np.frombuffer(sizes, "<i4").astype(np.int64).cumsum().tolist()
    return [raw[a:e] for a, e in zip([0, *ends], ends)]
