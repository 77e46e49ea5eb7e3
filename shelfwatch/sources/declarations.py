"""Source and target declarations: loading, the compliance gate, and choosing a source for a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import clamped_ttl

DECLARATION_SCHEMA = (
    "sources array<struct<id string, adapter string, enabled boolean, display_name string, compliance string, "
    "compliance_note string, host string, endpoint string, api string, qps double, burst bigint, daily_quota bigint, "
    "dedupe_ttl_seconds bigint>>, targets array<struct<item_id string, title string, role string, priority bigint>>"
)


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """Enabled sources of a JSON declaration, in declared order (``ord``), defaults filled in."""
    raw = spark.read.schema(DECLARATION_SCHEMA).json(path, multiLine=True)
    declared = raw.select(F.posexplode("sources").alias("ord", "s")).select("ord", "s.*")
    filled = declared.withColumns({
        "enabled": F.coalesce("enabled", F.lit(False)),
        "compliance": F.coalesce("compliance", F.lit("")),
        "qps": F.coalesce("qps", F.lit(0.5)),
        "burst": F.coalesce("burst", F.lit(3)),
        "daily_quota": F.coalesce("daily_quota", F.lit(1000)),
        "dedupe_ttl_seconds": F.coalesce("dedupe_ttl_seconds", F.lit(7200)),
    })
    return filled.where("enabled").withColumnRenamed("id", "source_id")


_TYPED = {  # member -> type it must have where it is present, as JSON tells types
    "enabled": ("BOOLEAN", "enabled is not a boolean"),
    "qps": ("BIGINT|DOUBLE|FLOAT|DECIMAL.*", "qps is not a number"),
    "burst": ("BIGINT", "burst is not a whole number"),
    "daily_quota": ("BIGINT", "daily_quota is not a whole number"),
    "dedupe_ttl_seconds": ("BIGINT", "dedupe_ttl_seconds is not a whole number"),
}


def checked_declarations(documents: DataFrame, text: str = "declaration") -> DataFrame:
    """Every source declared in JSON documents (one, or a list of them under ``sources``), valid or not.

    Adds ``place`` in the document, the typed members with their defaults, and ``reason``: null for a
    valid declaration, otherwise the first thing wrong with it. Nothing that was declared is lost: a
    document that is no JSON gives one row, an element that is no object too. Split by ``reason`` into
    what to load and what to report.
    """
    kept = [c for c in documents.columns if c != text]
    parsed = documents.select(*kept, F.try_parse_json(text).alias("_doc"))
    listed = F.coalesce(F.try_variant_get("_doc", "$.sources", "array<variant>"), F.array("_doc"))
    each = parsed.select(*kept, F.posexplode(listed).alias("place", "_s"))
    member = lambda name, kind: F.try_variant_get("_s", f"$.{name}", kind)
    wrong = F.when(F.col("_s").isNull(), "not JSON").when(~F.schema_of_variant("_s").startswith("OBJECT"), "not an object")
    wrong = wrong.when(F.coalesce(member("id", "string"), F.lit("")) == "", "no id")
    for name, (kinds, reason) in _TYPED.items():
        kind = F.schema_of_variant(member(name, "variant"))
        wrong = wrong.when(kind.isNotNull() & (kind != "VOID") & ~kind.rlike(f"^({kinds})$"), reason)
    is_flag = F.schema_of_variant(member("enabled", "variant")) == "BOOLEAN"  # the text "yes" is none
    enabled, compliance = F.coalesce(is_flag & member("enabled", "boolean"), F.lit(False)), F.coalesce(member("compliance", "string"), F.lit(""))
    wrong = wrong.when(enabled & (compliance == ""), "no compliance declared")
    wrong = wrong.when(enabled & _rejected(compliance), "compliance not in the allowed list")
    return each.select(
        *kept, "place", member("id", "string").alias("source_id"), enabled.alias("enabled"), compliance.alias("compliance"),
        F.coalesce(member("qps", "double"), F.lit(V.DEFAULT_QPS)).alias("qps"),
        *[F.coalesce(member(c, "bigint"), F.lit(d)).alias(c) for c, d in (("burst", V.DEFAULT_BURST), ("daily_quota", V.DEFAULT_DAILY_QUOTA), ("dedupe_ttl_seconds", 7200))],
        wrong.alias("reason"),
    )


def load_targets(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(DECLARATION_SCHEMA).json(path, multiLine=True)
    return raw.select(F.explode("targets").alias("t")).select("t.*").withColumns({
        "role": F.coalesce("role", F.lit("self")), "priority": F.coalesce("priority", F.lit(3)),
    })


def _rejected(compliance: Column) -> Column:
    return ~F.coalesce(compliance, F.lit("")).isin(*V.COMPLIANCE)


def compliance_rejects(sources: DataFrame) -> DataFrame:
    """Enabled sources that may not run, with the reason."""
    blank = F.coalesce(F.col("compliance"), F.lit("")) == ""
    return sources.where(F.col("enabled") & _rejected(F.col("compliance"))).withColumn(
        "reason", F.when(blank, "no compliance declared").otherwise("compliance not in the allowed list")
    )


def require_compliance(sources: DataFrame) -> DataFrame:
    """Fail before any work starts when an enabled source is not allowed."""
    rejected = compliance_rejects(sources).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.slice(F.collect_list("source_id"), 1, 20)).alias("some")).first()
    if rejected["n"]:
        raise ValueError(f"{rejected['n']} sources without a valid compliance declaration, among them {rejected['some']}")
    return sources


def reject_noncompliant(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop rows that come from sources which may not run."""
    return rows.join(compliance_rejects(sources).select("source_id"), "source_id", "left_anti")


def resolve_source(targets: DataFrame, sources: DataFrame) -> DataFrame:
    """Source each target is read from: the first enabled real one, or the first synthetic one for
    sample items and where no real source exists. Null marks an unresolved target."""
    enabled = sources.where("enabled")
    synthetic = F.coalesce(F.col("compliance"), F.lit("")) == "synthetic"

    def first(kind: Column) -> Column:
        return enabled.where(kind).agg(F.min_by("source_id", "ord")).scalar()

    real, sample = first(~synthetic), first(synthetic)
    is_sample = F.col("item_id").cast("string").startswith(V.SYNTHETIC_ID_PREFIX)
    return targets.withColumn("source_id", F.when(is_sample | real.isNull(), sample).otherwise(real))


def with_clamped_ttl(sources: DataFrame, interval_seconds: int = V.CYCLE_SECONDS, override: int | None = None) -> DataFrame:
    forced = None if override is None else F.lit(override)
    return sources.withColumn("ttl_seconds", clamped_ttl(F.col("dedupe_ttl_seconds"), F.lit(interval_seconds), forced))
