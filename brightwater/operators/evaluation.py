"""Ranking metrics over batches of cases, dashboards and gates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import KPI_TARGETS, kpi_display, kpi_status, target_display
from ..functions.text import eval_doc_id, path_matches
from ..sources.scratch import stored

#: Parts that a range of values is counted in, and values of a group that one task may sort.
BINS, FEW = 4096, 100_000


def positive_rows(cases: DataFrame) -> DataFrame:
    """(case_id, positive): one row per document that a case expects."""
    return cases.select("case_id", F.explode("positives").alias("positive"))


def flags(retrieved: DataFrame, cases: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """retrieved (case_id, rank, doc) against cases: each row with ``hit``, true for the first mention of a document that matches a positive.

    ``positives`` (case_id, positive) where a case may have any number of them; else the cases have an array of that name. Both sides meet
    by case and base name, which two names that match share.
    """
    base = lambda c: F.regexp_extract(c, "([^/]*)$", 1)
    rows = retrieved.withColumn("doc_id_", eval_doc_id(F.col("doc"))).join(cases.select("case_id"), "case_id", "left_semi")
    wanted = (positive_rows(cases) if positives is None else positives).select("case_id", eval_doc_id(F.col("positive")).alias("wanted_"))
    found = rows.select("case_id", "doc_id_", base(F.col("doc_id_")).alias("base_")).distinct().join(wanted.withColumn("base_", base(F.col("wanted_"))), ["case_id", "base_"])
    found = found.where(path_matches(F.col("doc_id_"), F.col("wanted_"))).select("case_id", "doc_id_", F.lit(True).alias("match_")).distinct()
    first = F.row_number().over(Window.partitionBy("case_id", "doc_id_").orderBy("rank")) == 1
    return rows.join(found, ["case_id", "doc_id_"], "left").withColumn("hit", F.coalesce("match_", F.lit(False)) & first).drop("doc_id_", "match_")


def ideal_dcg(positives: Column, k: int) -> Column:
    m = F.least(positives, F.lit(k))
    return F.when(m >= 1, F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))).otherwise(0.0)


def case_metrics(flagged: DataFrame, cases: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), ndcg_k: int = 10) -> DataFrame:
    """One row per case, also for those without results: recall, precision and hit at each k, reciprocal rank, NDCG, n_returned. Cases have
    an array of positives or their number, ``total``."""
    hit, rank = F.col("hit"), F.col("rank")
    at = flagged.groupBy("case_id").agg(
        *[F.sum(F.when(hit & (rank <= k), 1).otherwise(0)).alias(f"hits_{k}") for k in ks],
        F.min(F.when(hit, rank)).alias("first_hit"),
        F.sum(F.when(hit & (rank <= ndcg_k), 1 / F.log2(rank + 1.0)).otherwise(0.0)).alias("dcg"),
        F.count("*").alias("n_returned"),
    )
    total = F.col("total") if "total" in cases.columns else F.size("positives")
    joined = cases.select("case_id", total.alias("total"), "expect_no_source").join(at, "case_id", "left")
    n = F.coalesce("n_returned", F.lit(0))
    columns = []
    for k in ks:
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        within = F.least(F.lit(k), n)
        columns += [
            F.when(F.col("total") > 0, F.least(F.lit(1.0), hits / F.col("total"))).otherwise(0.0).alias(f"recall_{k}"),
            F.when(within > 0, hits / within).otherwise(0.0).alias(f"precision_{k}"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
        ]
    ideal = ideal_dcg(F.col("total"), ndcg_k)
    return joined.select(
        "case_id", "expect_no_source", n.alias("n_returned"), *columns, F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank"),
        F.when(ideal > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias(f"ndcg_{ndcg_k}"),
    )


def summary(per_case: DataFrame, ks: Sequence[int] = (1, 3, 5, 10), ndcg_k: int = 10) -> DataFrame:
    """One row: macro means over positive cases (0 without any), the share of negative cases that returned something (null
    without any) and their ids, counts; ``failed`` where cases have an ``error``."""
    negative = F.col("expect_no_source")
    names = [f"{m}_{k}" for k in ks for m in ("recall", "precision", "hit")] + ["reciprocal_rank", f"ndcg_{ndcg_k}"]
    return per_case.agg(
        F.count("*").alias("cases"), F.count_if(~negative).alias("positive_cases"), F.count_if(negative).alias("negative_cases"),
        *([F.count_if(F.col("error").isNotNull()).alias("failed")] if "error" in per_case.columns else []),
        *[F.coalesce(F.avg(F.when(~negative, F.col(n))), F.lit(0.0)).alias(n) for n in names],
        F.avg(F.when(negative, (F.col("n_returned") > 0).cast("double"))).alias("false_recall_rate"),
        F.array_sort(F.collect_set(F.when(negative & (F.col("n_returned") > 0), F.col("case_id")))).alias("false_recall_ids"),
    )


def order_statistics(rows: DataFrame, value_col: str, quantiles: Sequence[float], by: Sequence[str] = (), bins: int = BINS, few: int = FEW) -> DataFrame:
    """(by, quantile, value): exact quantiles, interpolated between neighbours, by selection: no task holds more than ``few`` values of a group, however many it has.

    A wanted place of a group lies between the least and the greatest value. While more than ``few`` values do, they are counted in ``bins`` equal parts of that range, which combines before
    the shuffle, and the part with the place, from its own least to its greatest value, becomes the range. Values that are null or not finite are left out; groups without values have no row.
    """
    keys = [f"b{i}" for i in range(len(by))]
    value = F.col(value_col).cast("double")
    held = rows.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], value.alias("v")).where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    place = lambda q: q * (F.col("n") - 1)
    wanted = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in quantiles])))
    counted = stored(held.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    now = counted.select(*keys, F.explode(wanted).alias("place"), F.lit(0).cast("long").alias("below"), "lo", "hi", F.col("n").alias("inside"))

    def within(targets: DataFrame) -> DataFrame:
        """The values in the ranges of targets, a small table."""
        t = targets.select(*[F.col(k).alias("t" + k) for k in keys], "place", "below", "lo", "hi")
        own = [held[k].eqNullSafe(t["t" + k]) for k in keys]
        out = held.join(t, own, "inner") if own else held.crossJoin(F.broadcast(t))  # without groups: a row for each place
        return out.where("v between lo and hi").drop(*["t" + k for k in keys])

    wide = (F.col("inside") > few) & (F.col("lo") < F.col("hi"))
    while True:
        now = stored(now, "ranges")
        if not now.where(wide).limit(1).count():
            break
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        part = F.least(F.floor(share * bins), F.lit(bins - 1))
        found = within(now.where(wide)).groupBy(*keys, "place", "below", part.alias("part")).agg(F.count("*").alias("inside"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        before = F.coalesce(F.sum("inside").over(Window.partitionBy(*keys, "place").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("below")
        next_ = found.withColumn("below", before).where((F.col("below") <= F.col("place")) & (F.col("place") < F.col("below") + F.col("inside")))
        now = now.where(~wide).unionByName(next_.select(*now.columns))
    plain = now.where("lo = hi").select(*keys, "place", F.col("lo").alias("v"))
    last = within(now.where("lo < hi")).groupBy(*keys, "place").agg(F.get(F.sort_array(F.collect_list("v")), (F.first("place") - F.first("below")).cast("int")).alias("v"))
    at = stored(plain.unionByName(last), "places")
    out = counted.select(*keys, F.explode(F.array(*[F.struct(F.lit(float(q)).alias("quantile"), place(q).alias("at")) for q in quantiles])).alias("q")).select(*keys, "q.quantile", "q.at")
    for name, edge in (("low", F.floor("at")), ("high", F.ceil("at"))):
        side = at.select(*[F.col(k).alias("s" + k) for k in keys], F.col("place").alias("p"), F.col("v").alias(name))
        out = out.join(side, [*[F.col(k).eqNullSafe(F.col("s" + k)) for k in keys], edge == F.col("p")]).drop("p", *["s" + k for k in keys])
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "quantile", F.when(F.floor("at") == F.ceil("at"), F.col("low")).otherwise(F.col("low") * (F.ceil("at") - F.col("at")) + F.col("high") * (F.col("at") - F.floor("at"))).alias("value"))


def latency(requests: DataFrame, value_col: str, by: Sequence[str] = ()) -> DataFrame:
    """avg, p50, p95 (interpolated, exact) and max, 3 digits; 0 without values."""
    shown = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 3)
    found = order_statistics(requests, value_col, (0.5, 0.95), by)
    found = found.groupBy(*[F.col(c).alias("k_" + c) for c in by]).agg(*[F.max(F.when(F.col("quantile") == q, F.col("value"))).alias(n) for q, n in ((0.5, "p50"), (0.95, "p95"))])
    out = requests.groupBy(*by).agg(F.avg(value_col).alias("a"), F.max(value_col).alias("m"))
    out = out.join(found, [F.col(c).eqNullSafe(F.col("k_" + c)) for c in by], "left") if by else out.crossJoin(F.broadcast(found))  # one row each
    return out.select(*by, shown(F.col("a")).alias("avg_ms"), shown(F.col("p50")).alias("p50_ms"), shown(F.col("p95")).alias("p95_ms"), shown(F.col("m")).alias("max_ms"))


def kpis(spark: SparkSession, report: DataFrame, targets: dict | None = None) -> DataFrame:
    """A report row (columns named as the keys of ``KPI_TARGETS``) in long form: value, display, target, status. Targets can be overridden by number."""
    rows = []
    for key, (label, target, direction, unit) in KPI_TARGETS.items():
        target = float((targets or {}).get(key, target))
        value = F.col(f"`{key}`").cast("double") if key in report.columns else F.lit(None).cast("double")
        rows.append(F.struct(F.lit(key).alias("key"), F.lit(label).alias("label"), value.alias("value"), F.lit(target).alias("target"), F.lit(direction).alias("direction"), F.lit(unit).alias("unit")))
    long = report.select(F.inline(F.array(*rows)))
    return long.select("*", kpi_display(F.col("value"), F.col("unit")).alias("display"), target_display(F.col("target"), F.col("direction"), F.col("unit")).alias("target_display"), kpi_status(F.col("value"), F.col("target"), F.col("direction")).alias("status"))


def quality_gates(report: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(name, value, limit, passed): ``limits`` maps a column to ("min" or "max", number); a null value is skipped (passed null)."""
    rows = [F.struct(F.lit(n).alias("name"), F.col(f"`{n}`").cast("double").alias("value"), F.lit(float(x)).alias("limit"), F.lit(kind).alias("kind")) for n, (kind, x) in limits.items()]
    long = report.select(F.inline(F.array(*rows)))
    return long.withColumn("passed", F.when(F.col("kind") == "min", F.col("value") >= F.col("limit")).otherwise(F.col("value") <= F.col("limit")))


def trend(history: DataFrame, value_col: str, order_col: str, width: float = 100.0, height: float = 40.0) -> DataFrame:
    """(order, x, y): the polyline of a metric over its history, scaled to the least and greatest value; a flat line lies in the middle.

    Points are numbered within ranges of the order, whose sizes add up to offsets, so no task sees them all.
    """
    ranged = history.select(order_col, value_col).repartitionByRange(F.col(order_col)).select("*", F.spark_partition_id().alias("part_"))
    numbered = ranged.withColumn("i_", F.row_number().over(Window.partitionBy("part_").orderBy(order_col)) - 1)
    sizes = numbered.groupBy("part_").agg(F.count("*").alias("n_"), F.min(value_col).alias("low_"), F.max(value_col).alias("high_"))
    everything, earlier = Window.partitionBy(), Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    sizes = sizes.select("part_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("before_"), F.sum("n_").over(everything).alias("n_"), F.min("low_").over(everything).alias("low_"), F.max("high_").over(everything).alias("high_"))
    placed = numbered.join(F.broadcast(sizes), "part_")
    x = F.when(F.col("n_") > 1, (F.col("i_") + F.col("before_")) * width / (F.col("n_") - 1)).otherwise(0.0)
    y = F.when(F.col("high_") == F.col("low_"), F.lit(height / 2)).otherwise(height - (F.col(value_col) - F.col("low_")) / (F.col("high_") - F.col("low_")) * height)
    return placed.select(order_col, x.alias("x"), y.alias("y"))
