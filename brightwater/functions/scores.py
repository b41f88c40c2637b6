"""Score expressions. Null means that a channel gave no score; nothing here turns it into 0 but ``combine``."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .text import fixed

# Fixed values that results depend on.
LABELS = ((0.75, "较强"), (0.60, "一般"), (None, "较弱"))
KPI_TARGETS = {
    "recall@5": ("Recall@5", 0.85, "up", ""),
    "recall@3": ("Recall@3", 0.75, "up", ""),
    "ndcg@10": ("NDCG@10", 0.70, "up", ""),
    "latency_p95_ms": ("检索 p95", 300.0, "down", "ms"),
}


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def to_distance(similarity: Column) -> Column:
    return F.when(similarity <= 1e-12, 1e12).otherwise(1.0 / similarity - 1.0)


def to_similarity(distance: Column) -> Column:
    return 1.0 / (1.0 + F.greatest(distance, F.lit(0.0)))


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def rerank_probability(raw: Column, batch: list[str]) -> Column:
    """Scores of a batch that all lie in 0 to 1 are probabilities already; else each goes through the sigmoid."""
    inside = F.min(F.when(raw.isNotNull(), raw.between(0, 1).cast("int"))).over(Window.partitionBy(*batch))
    return F.when(inside == 1, raw).otherwise(sigmoid(raw))


def combine(vector: Column, rerank: Column, vector_weight: float = 0.35, rerank_weight: float = 0.65) -> Column:
    """The weighted mean of the parts there are; 0 without any."""
    total = vector_weight + rerank_weight
    w1, w2 = (vector_weight / total, rerank_weight / total) if total > 0 else (0.5, 0.5)
    rerank = rerank if rerank_weight > 0 else F.lit(None).cast("double")
    weight = F.when(vector.isNotNull(), w1).otherwise(0.0) + F.when(rerank.isNotNull(), w2).otherwise(0.0)
    score = w1 * F.coalesce(clamp(vector), F.lit(0.0)) + w2 * F.coalesce(clamp(rerank), F.lit(0.0))
    return F.when(weight > 0, clamp(score / weight)).otherwise(0.0)


def band(similarity: Column) -> Column:
    out = F.when(similarity >= LABELS[0][0], LABELS[0][1])
    return out.when(similarity >= LABELS[1][0], LABELS[1][1]).otherwise(LABELS[2][1])


def relative(similarity: Column, batch: list[str]) -> Column:
    """The share of the batch's best, 4 digits; 1 if that is nothing."""
    peak = F.max(similarity).over(Window.partitionBy(*batch))
    return F.round(F.when(peak <= 1e-12, 1.0).otherwise(clamp(similarity / peak)), 4)


def kpi_status(value: Column, target: Column, direction: Column) -> Column:
    good = F.when(direction == "down", value <= target).otherwise(value >= target)
    return F.when(value.isNull(), "unknown").when(good, "pass").otherwise("fail")


def kpi_display(value: Column, unit: Column) -> Column:
    return F.when(value.isNull(), "—").when(unit == "ms", F.concat(fixed(value, 0), F.lit(" ms"))).otherwise(fixed(value, 3))


def target_display(target: Column, direction: Column, unit: Column) -> Column:
    sign = F.when(direction == "up", "≥ ").otherwise("≤ ")
    return F.concat(sign, F.when(unit == "ms", F.concat(fixed(target, 0), F.lit(" ms"))).otherwise(fixed(target, 2)))
