"""SimHash near-dedup by ball hashing."""

from __future__ import annotations

import re
import string

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Fingerprints whose variants, some 65 each, one task makes and combines.
FINGERPRINTS_IN_TASK = 1 << 13
#: Pairs of a key that are compared outright; keys with more meet by the block left out as well.
CROWD = 1 << 20
#: The three blocks of bits of which one at a time is left out, low bit and width.
BLOCKS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: str | None, words_in_shingle: int = 3, step: int = 1 << 16) -> int:
    """64-bit SimHash: a bit is 1 if it is set in over half of the shingles' XXH64 (seed 42), repeats included.

    Fewer words than a shingle: one shingle of them all. No word (null, empty, blank): 0.
    Long texts go through in steps, so memory stays bounded by the text itself.
    """
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return 0
    joined = " ".join(words).encode("utf-8", "surrogatepass")
    ends = np.fromiter((len(w.encode("utf-8", "surrogatepass")) + 1 for w in words), np.int64, len(words)).cumsum()
    n = max(1, len(words) - words_in_shingle + 1)
    first, last = np.concatenate([[0], ends[: n - 1]]), ends[len(words) - n :] - 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, n, step):
        h = np.array([digest(joined[i:j], 42) for i, j in zip(first[at : at + step].tolist(), last[at : at + step].tolist())], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((2 * counts > n).astype(np.uint64) @ (np.uint64(1) << np.arange(64, dtype=np.uint64)))


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str, words_in_shingle: int = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the ``carry`` columns: the fingerprint as a signed 64-bit long."""
    kind = docs.schema[id_col].dataType

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                fps = np.array([fingerprint(x, words_in_shingle) for x in part.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64)), *part.columns[2:]], names=["id", "fp", *carry])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"), *carry)
    return rows.mapInArrow(run, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType()), *[docs.schema[c] for c in carry]]))


def _bit(i: int) -> Column:
    """One bit as a signed long."""
    return F.lit(1 << i if i < 63 else -(1 << 63))


def _ball(fps: DataFrame) -> DataFrame:
    """(key, fp): every variant within one bit of each fingerprint."""
    fp = F.col("fp")
    return fps.select(F.explode(F.array(fp, *[fp.bitwiseXOR(_bit(i)) for i in range(64)])).alias("key"), "fp")


def _odd_ball(comps: DataFrame) -> DataFrame:
    """(block, key, parity, fp, comp), for pairs that differ in exactly three bits: keys with one block of bits left out and at most one bit flipped.

    With three blocks, leaving out the block with most differing bits leaves at most one in each of the other
    two. Fingerprints of even parity flip a bit of the first block kept, those of odd parity one of the second;
    a pair at an odd distance has one of each, so both reach a common key.
    """
    keys: dict[int, list[Column]] = {0: [], 1: []}
    for out, (low, width) in enumerate(BLOCKS):
        left = ((1 << 64) - 1) ^ (((1 << width) - 1) << low)
        kept = F.col("fp").bitwiseAND(F.lit(left - (1 << 64) if left >> 63 else left))
        flipped = [b for i, b in enumerate(BLOCKS) if i != out]
        for parity, (at, bits) in enumerate(flipped):
            keys[parity] += [F.struct(F.lit(out).cast("byte").alias("block"), k.alias("key")) for k in (kept, *[kept.bitwiseXOR(_bit(at + i)) for i in range(bits)])]
    parity = F.bit_count("fp") % 2
    each = F.when(parity == 0, F.array(*keys[0])).otherwise(F.array(*keys[1]))
    return comps.select(F.explode(each).alias("k"), parity.cast("byte").alias("parity"), "fp", "comp").select("k.block", "k.key", "parity", "fp", "comp")


def _in_block(met: DataFrame, flips: int) -> DataFrame:
    """``met`` once per variant (``sub``) of at most ``flips`` bits of the block that was left out."""
    each = F.lit(None).cast("array<bigint>")
    for out, (low, width) in enumerate(BLOCKS):
        own = F.col("fp").bitwiseAND(_bits(((1 << width) - 1) << low))
        masks = [0, *(1 << low + i for i in range(width)), *((1 << low + i) | (1 << low + j) for i in range(width) for j in range(i) if flips > 1)]
        each = F.when(F.col("block") == out, F.array(*[own.bitwiseXOR(_bits(m)) for m in masks])).otherwise(each)
    return met.withColumn("sub", F.explode(each))


def _bits(mask: int) -> Column:
    return F.lit(mask - (1 << 64) if mask >> 63 else mask)


def _far(met: DataFrame, crowd: int) -> DataFrame:
    """(a, b): pairs of components with fingerprints of 3 bits' distance, of those that meet under a key.

    Under a key of few fingerprints all of one parity meet all of the other. A crowded key (its pairs are more than ``crowd``) is split by the
    block left out, in which they differ by 3 bits at most: one side flips one bit there, the other two, and they meet where these agree.
    """
    n = met.groupBy("block", "key").agg(F.count_if(F.col("parity") == 0).alias("n"), F.count_if(F.col("parity") == 1).alias("m"))
    crowded = stored(n.where(F.col("n") * F.col("m") > crowd).select("block", "key"), "crowded")
    few, many = met.join(crowded, ["block", "key"], "left_anti"), met.join(crowded, ["block", "key"], "left_semi")
    out = None
    for left_rows, right_rows, on in ((few, few, ["block", "key"]), (_in_block(many.where("parity = 0"), 1), _in_block(many.where("parity = 1"), 2), ["block", "key", "sub"])):
        left = left_rows.where("parity = 0").select(*on, F.col("fp").alias("a"), F.col("comp").alias("ca"))
        right = right_rows.where("parity = 1").select(*on, F.col("fp").alias("b"), F.col("comp").alias("cb"))
        one = left.join(right, on).where("ca <> cb").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 3).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        out = one if out is None else out.union(one)
    return out.distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3, crowd: int = CROWD) -> DataFrame:
    """One row per document: id, fp (signed long), component_id (the smallest id reachable over links of 3 or fewer bits).

    Meet in the middle on distinct fingerprints, so exact copies cost one fingerprint.
    1. Every fingerprint emits the 65 variants within half the radius (one bit). Two that share a variant
       differ in two bits at most, so the collision itself is the proof: each variant's members link to
       its least member, a minimum that combines before the shuffle, however large the group.
    2. The radius is odd, so pairs at exactly three bits remain. Each fingerprint emits 66 variants of one flipped
       bit with a block of bits left out (see ``_odd_ball``); only keys on which different components of step 1
       meet are kept, and those pairs are verified by their exact distance; crowded keys are split (see ``_far``).
    Components come from the links of both steps; no table of all pairs of a group is made.

    Null texts count as empty: fingerprint 0, which links like any other. Rows with a null id form no
    links and get a null component_id. Rows that repeat an id are judged each by its own text. Other
    columns are not read, and an empty table gives an empty table.
    """
    rows = stored(with_fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
    out = rows.join(_classes(rows, crowd).select("fp", "component_id"), "fp", "left")
    return out.select(F.col("id").alias(id_col), "fp", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """One row of each group of ``simhash_groups``, with all columns of ``docs``, and every row with a null id.

    The row is one of those with the group's smallest id; where several rows have it, the one whose columns
    hash least. Ids may repeat, within a group and across groups: rows are told apart by a key stored with them.
    """
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("digest"), doc), "keyed")
    texts = keyed.select(F.col("doc")[id_col].alias("id"), F.col("doc")[text_col].alias("body"), "row", "digest")
    rows = stored(with_fingerprints(texts, "id", "body", words_in_shingle, ("row", "digest")), "fingerprints")
    roots = rows.join(_classes(rows), "fp").where("id = component_id")
    first = roots.groupBy("comp").agg(F.min(F.struct("digest", "row")).alias("first")).select("first.row")
    return keyed.join(first.union(rows.where("id is null").select("row")), "row", "left_semi").select("doc.*")


def _classes(rows: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(fp, comp, component_id) of the fingerprints of rows with an id: comp is the group's own, while groups that share an id may share component_id."""
    per = stored(rows.where("id is not null").groupBy("fp").agg(F.min("id").alias("least")), "distinct")
    tasks = max(1, -(-per.count() // FINGERPRINTS_IN_TASK))
    fps = per.select("fp").repartition(tasks, "fp")
    ball = _ball(fps)
    least = stored(ball.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key", "a"), "balls")
    near = ball.join(least, "key").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()
    near = stored(near, "near")
    first = connected_components(near)
    comp = stored(per.select("fp").join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("comp")), "comps")
    odd = _odd_ball(comp.repartition(tasks, "fp"))
    mixed = stored(odd.groupBy("block", "key").agg(F.min("comp").alias("c"), F.max("comp").alias("d"), F.min("parity").alias("p"), F.max("parity").alias("q")).where("c <> d and p <> q").select("block", "key"), "mixed")
    met = stored(odd.join(mixed, ["block", "key"]), "met")
    far = _far(met, crowd)
    second = connected_components(far)
    comp = comp.join(second.withColumnRenamed("node", "comp"), "comp", "left").select("fp", F.coalesce("component", "comp").alias("comp"))
    member = stored(comp.join(per, "fp"), "members")
    root = stored(member.groupBy("comp").agg(F.min("least").alias("component_id")), "roots")
    return stored(member.join(root, "comp").select("fp", "comp", "component_id"), "classes")
