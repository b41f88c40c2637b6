"""License scans by banded MinHash over overlapping windows. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .shared import stored

#: Most bytes of template text in one scan; more templates go through in several, so what goes to executors, and the set of shingles in the plan, stay bounded.
PART_BYTES = 512 << 10


def default_templates(spark: SparkSession) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(n).alias("license"), F.lit(t).alias("text")) for i, n, t in TEMPLATES])
    return spark.range(1).select(F.inline(rows))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda x: x != "")


def with_shingles(rows: DataFrame, text_col: str, n: int, out: str = "s") -> DataFrame:
    """Add ``n_words`` and the hash of each run of ``n`` words, made of the hashes of its words; fewer words: one run of them all; none: none.

    Column by column: what a lambda refers to is then a column, which is not computed again for each element.
    """
    hashed = rows.withColumn("n_words", tokens(F.col(text_col))).withColumn("n_words", F.transform("n_words", lambda w: F.xxhash64(w)))
    hashed = hashed.withColumnRenamed("n_words", "w").withColumn("n_words", F.size("w"))
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("w"), i + j) for j in range(n)]))
    return hashed.withColumn(out, F.when(F.size("w") > 0, runs).otherwise(F.array().cast("array<bigint>"))).drop("w")


def bands_needed(similarity: float, miss: float) -> int:
    """Single-row bands until a pair of this Jaccard similarity collides in some band but for a chance of ``miss``."""
    return 1 if similarity >= 1 else math.ceil(math.log(miss) / math.log(1 - similarity))


def _minhash(shingles: Column, band: Column) -> Column:
    """The shingle that is least under the hash function of a band."""
    least = F.array_min(F.transform(shingles, lambda s: F.struct(F.xxhash64(s, band).alias("h"), s.alias("s"))))
    return least["s"]


def scan_licenses(
    docs: DataFrame,
    templates: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    containment: float = 0.8,
    miss: float = 1e-6,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per match: id, template_id, license, first_word, last_word (the window's place in the text, from 0), containment.

    Templates are classed by length, rounded up to a power of two; a class's windows are twice as long and
    overlap by half, so each occurrence lies whole in a window. A window and a template collide in a band when
    the band's hash is least at the same shingle. From the lowest Jaccard similarity that a sufficient
    containment can have in such a window follows the number of bands that leaves a chance below ``miss``
    to miss it. Colliding pairs are then verified by exact containment of the template's shingles.

    A band can only collide at a shingle that is least in the template. The set of these goes to every executor and meets the shingles of
    the texts: only windows around such places are made, each once and with its own slice of the text, so the work grows with a text's length however often it repeats a license; no text is shuffled before that. Tables of templates of more than
    ``part_bytes`` are dealt by hash to as many scans as that takes. Templates of fewer words than a shingle are one run of their own length.

    Null and empty texts match nothing; nor do templates without words. Repeated rows each match. Rows with a null id are scanned like
    others. Only the named columns are read from either table. Empty tables give an empty table.
    """
    t = templates.select("template_id", "license", F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n_words", F.size(tokens(F.col("text")))).where("n_words > 0").withColumn("run", F.least("n_words", F.lit(shingle)))
    sizes = t.groupBy("run").agg(F.sum(F.octet_length("text")).alias("bytes")).orderBy("run").collect()  # a row per length of a run
    found = None
    for r in sizes:
        parts = -(-r["bytes"] // part_bytes)
        for part in range(parts):
            own = t.where((F.col("run") == r["run"]) & (F.pmod(F.xxhash64("template_id", "text"), F.lit(parts)) == part))
            one = _scan(docs, own, id_col, text_col, r["run"], containment, miss)
            found = one if found is None else found.union(one)
    if found is None:
        kinds = {f.name: f.dataType for f in t.schema}
        none = [F.lit(None).cast(kinds["template_id"]).alias("template_id"), F.lit(None).cast("string").alias("license"), *[F.lit(0).alias(c) for c in ("first_word", "last_word")], F.lit(0.0).alias("containment")]
        return docs.select(F.col(id_col), *none).limit(0)
    return found


def _scan(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str, shingle: int, containment: float, miss: float) -> DataFrame:
    """One table of templates, of a checked size, with runs of one length."""
    known = with_shingles(templates.select("template_id", "license", "text"), "text", shingle, "ts").withColumn("ts", F.array_distinct("ts"))
    known = known.withColumn("half", F.greatest(F.lit(8), F.pow(2, F.ceil(F.log2("n_words")))).cast("int")).select("template_id", "license", "half", "ts")
    known = stored(known, "templates")
    bands = {}
    for r in known.groupBy("half").agg(F.min(F.size("ts")).alias("least")).collect():  # a row per power of two
        need = math.ceil(containment * r["least"])
        bands[r["half"]] = bands_needed(need / (2 * r["half"] - shingle + 1 + r["least"] - need), miss)
    n_bands = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])[F.col("half")]
    band = F.sequence(F.lit(1), n_bands)
    signature = stored(known.select("template_id", "half", F.posexplode(F.transform(band, lambda b: _minhash(F.col("ts"), b))).alias("band", "least")), "signatures")
    # the shingles at which a band can collide, by length of the windows: fewer than the templates have words
    seeds = signature.groupBy("half").agg(F.collect_set("least").alias("x")).collect()

    texts = with_shingles(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text", shingle).withColumn("row", F.monotonically_increasing_id())

    def own(half: int, some: list) -> Column:
        """The windows around the places of these shingles, each with its own slice: a place at i lies in the windows that begin at the multiples of half around it."""
        places = F.array_compact(F.transform("s", lambda x, i: F.when(x.isin(*some), i)))
        k = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(F.floor(i / half).cast("int"), F.floor(i / half).cast("int") - 1))))
        begins = F.transform(F.filter(k, lambda x: x >= 0), lambda x: x * half)
        slices = F.transform(begins, lambda x: F.struct(F.lit(half).alias("half"), x.alias("first_word"), F.slice("s", x + 1, 2 * half - shingle + 1).alias("s")))
        return F.filter(slices, lambda w: F.size(w["s"]) > 0)

    if not seeds:
        return texts.select(F.col("id").alias(id_col), *[F.lit(None).cast(t).alias(c) for c, t in known.drop("half", "ts").dtypes], *[F.lit(0).alias(c) for c in ("first_word", "last_word")], F.lit(0.0).alias("containment")).limit(0)
    near = texts.select("id", "row", "n_words", F.explode(F.concat(*[own(r["half"], r["x"]) for r in seeds])).alias("w"))
    windows = near.select("row", "id", "n_words", "w.half", "w.first_word", "w.s")
    signed = windows.select("*", F.posexplode(F.transform(band, lambda b: _minhash(F.col("s"), b))).alias("band", "least"))
    hits = signed.join(F.broadcast(signature), ["half", "band", "least"])
    pairs = hits.groupBy("row", "template_id", "half", "first_word").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.first("s").alias("s"))
    checked = pairs.join(F.broadcast(known.select("template_id", "license", "ts", "half")), ["template_id", "half"])
    share = F.size(F.array_intersect("ts", "s")) / F.size("ts")
    last = F.least(F.col("first_word") + 2 * F.col("half"), F.col("n_words")) - 1
    found = checked.select(F.col("id").alias(id_col), "template_id", "license", "first_word", last.alias("last_word"), share.alias("containment"))
    return found.where(F.col("containment") >= containment)
