"""Configuration tables: listings, defaults, settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def list_configs(table: DataFrame, flag_col: str, name_col: str = "name", **equal) -> DataFrame:
    """Rows that equal every given value (None: any), flagged ones first, then by name."""
    for column, value in equal.items():
        if value is not None:
            table = table.where(F.col(column) == value)
    return table.orderBy(F.desc(flag_col), name_col)


def search_configs(table: DataFrame, text: str | None, columns: Sequence[str], kind: str | None = None, active: bool | None = None) -> DataFrame:
    """Rows of a kind and state of which the joined columns contain the text, whatever the case."""
    if kind:
        table = table.where(F.col("kind") == kind)
    if active is not None:
        table = table.where(F.col("is_active") == active)
    if text and text.strip():
        table = table.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))
    return table


def counts_by_kind(table: DataFrame, kinds: Sequence[str], kind_col: str = "kind") -> DataFrame:
    """One row: how many of each kind, and ``total``."""
    return table.agg(*[F.count_if(F.col(kind_col) == k).alias(k) for k in kinds], F.count("*").alias("total"))


def default_config(table: DataFrame, kind: str) -> DataFrame:
    """The first active default of a kind."""
    return table.where((F.col("kind") == kind) & F.col("is_active") & F.col("is_default")).orderBy("id").limit(1)


def set_default(table: DataFrame, config_id, kind: str) -> DataFrame:
    """One default within a kind; other kinds stay."""
    return table.withColumn("is_default", F.when(F.col("kind") == kind, F.col("id") == config_id).otherwise(F.col("is_default")))


def latest_settings(log: DataFrame) -> DataFrame:
    """The last written value of each key of an append-only log (setting_key, setting_value, updated_at)."""
    return log.groupBy("setting_key").agg(F.max_by("setting_value", "updated_at").alias("setting_value"), F.max("updated_at").alias("updated_at"))


def merge_providers(builtin: DataFrame, offered: DataFrame, preferred: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Built-in providers overlaid by offered rows of the same name (nulls don't overlay), preferred names first, then by name."""
    a, b = builtin.alias("a"), offered.where("name is not null").alias("b")
    merged = a.join(b, F.col("a.name") == F.col("b.name"), "full").select(F.coalesce("b.name", "a.name").alias("name"), *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in columns])
    rank = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, preferred)), F.col("name")), F.lit(0)), F.lit(len(preferred) + 1))
    return merged.orderBy(rank, "name")


def with_cache_flag(presets: DataFrame, cached: DataFrame, key: str = "name") -> DataFrame:
    have = cached.select(key).distinct().withColumn("cached", F.lit(True))
    return presets.join(have, key, "left").withColumn("cached", F.coalesce("cached", F.lit(False)))


def configs_of_documents(results: DataFrame, configs: DataFrame, pattern: str, n: int = 4) -> DataFrame:
    """Active configs whose id stands in a result's filename, each once per query, the first ``n`` by rank."""
    found = results.withColumn("id", F.regexp_extract("filename", pattern, 1).try_cast("long")).where("id is not null")
    first = found.groupBy("query_id", "id").agg(F.min("rank").alias("rank")).join(configs.where("is_active"), "id")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank", "id"))
    return first.withColumn("place", place).where(F.col("place") <= n)


def distinct_names(rows: DataFrame, name_col: str = "name") -> DataFrame:
    return rows.select(name_col).where(F.col(name_col).isNotNull()).distinct().orderBy(F.lower(name_col), name_col)


def internal(filename: Column, prefix: str) -> Column:
    """Whether a stored name has the prefix of internal documents."""
    return filename.startswith(prefix)


# Bounds of the settings.
BOUNDS = {
    "default_k": (1, 50), "max_search_results": (1, 100), "min_source_similarity": (0.0, 1.0), "chunk_size": (100, 8000),
    "chunk_overlap": (0, 7999), "rrf_k": (1, 200), "max_rerank_candidates": (1, 100),
}


@dataclass(frozen=True)
class RetrievalSettings:
    default_k: int = 5
    max_search_results: int = 10
    min_source_similarity: float = 0.6
    chunk_size: int = 800
    chunk_overlap: int = 120
    hybrid_enabled: bool = True
    rrf_k: int = 60
    max_rerank_candidates: int = 8

    def updated(self, payload: Mapping | None) -> RetrievalSettings:
        """These settings with the payload's values (null: as before), checked: a value out of bounds or of another kind raises with its name."""
        known = {f.name for f in fields(self)}
        new = replace(self, **{k: v for k, v in (payload or {}).items() if k in known and v is not None})
        return new.checked()

    @classmethod
    def snapshot(cls, now: Mapping, search: Mapping | None = None) -> RetrievalSettings:
        """The settings in force: ``now`` first, then the configuration's ``search`` section, then the defaults. Values that can't be read are the defaults, those out of bounds the nearest in bounds."""
        search, default = search if isinstance(search, Mapping) else {}, cls(min_source_similarity=0.0)

        def number(name: str, kind, *places):
            raw = next((p[name] for p in places if p.get(name) is not None), None)
            try:
                value = kind(raw or getattr(default, name))
            except (TypeError, ValueError):
                value = getattr(default, name)
            low, high = BOUNDS[name]
            return max(low, min(high, value))

        flag = next((p["hybrid_enabled"] for p in (now, search) if p.get("hybrid_enabled") is not None), True)
        overlap = now.get("chunk_overlap", default.chunk_overlap)
        return cls(
            default_k=int(now.get("default_k") or default.default_k), max_search_results=int(now.get("max_search_results") or default.max_search_results), chunk_size=int(now.get("chunk_size") or default.chunk_size),
            chunk_overlap=int(overlap or 0), min_source_similarity=number("min_source_similarity", float, search), hybrid_enabled=bool(flag),
            rrf_k=number("rrf_k", int, now, search), max_rerank_candidates=number("max_rerank_candidates", int, now, search),
        )

    def applied(self, config: Mapping) -> dict:
        """The configuration with these settings in its sections (search; knowledge_base.chunking and .retrieval); what else it has stays, and it is not changed itself."""
        part = lambda c, name: dict(c[name]) if isinstance(c.get(name), Mapping) else {}
        shared = {"hybrid_enabled": self.hybrid_enabled, "rrf_k": self.rrf_k, "max_rerank_candidates": self.max_rerank_candidates}
        base = part(config, "knowledge_base")
        search = {**part(config, "search"), "default_k": self.default_k, "max_search_results": self.max_search_results, "min_source_similarity": self.min_source_similarity, **shared}
        base |= {"chunking": {**part(base, "chunking"), "size": self.chunk_size, "overlap": self.chunk_overlap}, "retrieval": {**part(base, "retrieval"), **shared}}
        return {**config, "search": search, "knowledge_base": base}

    def how(self) -> dict:
        """These settings as arguments of ``retrieval.search`` (k, threshold, hybrid) and of the chunker (chunk_size, overlap), in one table."""
        return {"search": {"k": self.default_k, "threshold": self.min_source_similarity or None, "hybrid": self.hybrid_enabled}, "chunking": {"size": self.chunk_size, "overlap": self.chunk_overlap}}

    def checked(self) -> RetrievalSettings:
        values = {}
        for name, (low, high) in BOUNDS.items():
            raw = getattr(self, name)
            if isinstance(raw, bool):
                raise ValueError(f"{name} must be a number")
            try:
                value = float(raw) if name == "min_source_similarity" else int(raw)
            except (TypeError, ValueError):
                raise ValueError(f"{name} must be a number") from None
            if name == "chunk_overlap":
                high = min(high, values["chunk_size"] - 1)
            if not low <= value <= high:
                raise ValueError(f"{name} must be between {low} and {high}")
            values[name] = value
        if values["max_search_results"] < values["default_k"]:
            raise ValueError("max_search_results must be default_k at least")
        flag = self.hybrid_enabled
        if not isinstance(flag, bool):
            text = str(flag).strip().lower()
            if text not in {"1", "true", "yes", "on", "0", "false", "no", "off"}:
                raise ValueError("hybrid_enabled must be true or false")
            flag = text in {"1", "true", "yes", "on"}
        return RetrievalSettings(**values, hybrid_enabled=flag)
