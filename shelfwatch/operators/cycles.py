"""Per-cycle counters and the cycle report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import role_or_unknown

COUNTERS = ("fetched", "cached", "skipped", "saved", "events")


def cycle_of(ts: Column) -> Column:
    """Name of the daily cycle a moment belongs to."""
    return F.date_format(ts, "yyyy-MM-dd")


def cycle_report(attempts: DataFrame, versions: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """One row per cycle: attempts and their span, counters with running totals, most severe grade.

    ``attempts`` needs ts, ok and cached; ``versions`` the kept versions with ``event_count`` and
    ``top_severity`` (see ``summarized``). Each side is read once and counted down to one row per
    cycle before anything is merged, so the running totals read cycles, not rows.
    """
    ok, cached = F.col("ok"), F.col("cached")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    tried = attempts.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("results"),
        F.count_if(ok & ~cached).alias("fetched"),
        F.count_if(ok & cached).alias("cached"),
        F.count_if(~ok).alias("skipped"),
        F.floor((F.max(micros) - F.min(micros)) / 1000).alias("elapsed_ms"),
    )
    changed = versions.groupBy(cycle).agg(
        F.count(F.lit(1)).alias("saved"), F.sum("event_count").alias("events"), F.min("top_severity").alias("top_severity")
    )
    merged = tried.unionByName(changed, allowMissingColumns=True).groupBy(cycle).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("results", *COUNTERS)],
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.coalesce(F.min("top_severity"), F.lit(V.LOWEST_SEVERITY)).alias("top_severity"),
    )
    so_far = Window.orderBy(cycle).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return merged.select("*", *[F.sum(c).over(so_far).alias(f"{c}_total") for c in COUNTERS])


def cycle_results(attempts: DataFrame, targets: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """What each attempt of a cycle brought for its target: item, role, ok, and why not.

    The rows behind a report's counters; its events are the change events of the cycle, its health the
    health report at the cycle's end.
    """
    known = targets.select("item_id", "role")
    ok = F.col("outcome") == "ok"
    began = F.substring(F.coalesce(F.col("body"), F.lit("")), 1, V.AUDIT_BODY_CHARS)
    message = F.when(ok, "").otherwise(F.concat_ws(":", "outcome", began))
    met = attempts.join(known, "item_id", "left")
    return met.select(cycle, "item_id", role_or_unknown(F.col("role")).alias("role"), "source_id", "seq", "ts", ok.alias("ok"), message.alias("msg"))


def cycle_stats(report: DataFrame, cycle: str = "cycle_id") -> DataFrame:
    """The counters of a report, per cycle and cumulative."""
    return report.select(cycle, *COUNTERS, *[f"{c}_total" for c in COUNTERS])
