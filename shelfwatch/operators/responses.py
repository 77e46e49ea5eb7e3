"""Event documents for an outside scorer, tolerant parsing of its answers, and alert routing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import role_or_unknown
from .classify import event_category
from .ordered import Cuts, OrderedScan, position

_EVENT_MEMBERS = (
    "struct<item_id string, role string, severity string, field string, old_value variant, new_value variant, event string>"
)


def _as_number(value: Column) -> Column:
    """The value of a JSON number (booleans count as 0 and 1), null for any other type."""
    kind = F.schema_of_variant(value)
    flag = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("int").cast("double"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(value, "$", "double"))
    return F.coalesce(flag, number)


def parse_events_json(documents: DataFrame, text: str = "diff_events") -> DataFrame:
    """Explode event documents to rows with role and category; broken or non-list text gives no rows.

    Elements that are not objects are skipped. Whether a value is a number is decided by its JSON
    type, as the category rules ask: the text "0" is not the number 0.
    """
    kept = [c for c in documents.columns if c != text]
    listed = F.try_variant_get(F.try_parse_json(F.col(text)), "$", "array<variant>")
    elements = documents.select(*kept, F.posexplode(listed).alias("pos", "_e"))
    objects = elements.select(*kept, "pos", F.try_variant_get("_e", "$", _EVENT_MEMBERS).alias("_m")).where("_m IS NOT NULL")
    typed = objects.select(
        *kept, "pos", "_m.item_id", "_m.severity", "_m.field", "_m.event",
        F.try_variant_get("_m.old_value", "$", "string").alias("old_value"),
        F.try_variant_get("_m.new_value", "$", "string").alias("new_value"),
        role_or_unknown(F.col("_m.role")).alias("role"),
        _as_number(F.col("_m.old_value")).alias("old_num"),
        _as_number(F.col("_m.new_value")).alias("new_num"),
    )
    category = event_category(*[F.col(c) for c in ("role", "field", "new_value", "old_num", "new_num")])
    return typed.withColumn("category", category)


BUNDLED = ("item_id", "role", "severity", "field", "old_value", "new_value", "event", "category")


def events_bundle(
    events: DataFrame,
    cycle: str = "cycle_id",
    order: Sequence[str] = ("item_id", "seq", "check_no"),
    max_events: int = 200,
    cuts: Cuts | None = None,
) -> DataFrame:
    """JSON documents of at most ``max_events`` events each: (cycle, part_no, event_count, events_json).

    A busy cycle becomes several parts, so no document and no task grows with the cycle; every event
    is in exactly one part.
    """
    numbered = OrderedScan(events, [cycle], order, cuts).add(_nth=position()).result()
    parted = numbered.withColumn("part_no", F.floor((F.col("_nth") - 1) / max_events))
    # short texts are cheaper to gather and to sort than structs of eight members
    entry = F.struct(F.col("_nth"), F.to_json(F.struct(*BUNDLED)).alias("e"))
    grouped = parted.groupBy(cycle, "part_no").agg(
        F.count(F.lit(1)).alias("event_count"), F.sort_array(F.collect_list(entry)).alias("_events")
    )
    return grouped.select(
        cycle, "part_no", "event_count", F.concat(F.lit("["), F.array_join(F.col("_events")["e"], ","), F.lit("]")).alias("events_json")
    )


def prompt_rows(bundles: DataFrame, template: str, slot: str = "{events}") -> DataFrame:
    return bundles.withColumn("prompt", F.replace(F.lit(template), F.lit(slot), F.col("events_json")))


# what the scorer says about an event besides its grade
ADVICE = ("attribution", "action", "priority_reason")


def parse_response(responses: DataFrame, text: str = "response") -> DataFrame:
    """Tolerant parse of a scorer's answer into ``events`` and ``summary``.

    The text from the first '{' to the last '}' is read as JSON, or the whole text if it has no
    braces. Anything unreadable gives no events and an empty summary. Elements without an item id
    are not events; a summary hidden in one of them is used when the top level has none.
    """
    answer = F.trim(F.coalesce(F.col(text), F.lit("")))
    braced = F.regexp_extract(answer, r"(?s)\{.*\}", 0)
    doc = F.try_parse_json(F.when(braced != "", braced).otherwise(answer))
    rows = responses.withColumn("_doc", doc)
    listed = F.coalesce(F.try_variant_get("_doc", "$.events", "array<variant>"), F.array().cast("array<variant>"))

    def field(e: Column, name: str) -> Column:
        return F.nullif(F.try_variant_get(e, f"$.{name}", "string"), F.lit(""))

    def flat(e: Column) -> Column:
        keep = F.try_variant_get(e, "$.priority_keep", "variant")
        return F.struct(
            field(e, "item_id").alias("item_id"),
            field(e, "severity").alias("severity"),
            field(e, "category").alias("category"),
            field(e, "summary").alias("summary"),
            *[field(e, name).alias(name) for name in ADVICE],
            # only a JSON boolean counts; null, numbers and the text "false" do not
            F.when(F.schema_of_variant(keep) == "BOOLEAN", F.try_variant_get(e, "$.priority_keep", "boolean")).alias("priority_keep"),
        )

    rows = rows.withColumn("_all", F.transform(listed, flat))
    stray = F.filter("_all", lambda e: e["item_id"].isNull() & e["summary"].isNotNull())
    own_summary = F.nullif(F.try_variant_get("_doc", "$.summary", "string"), F.lit(""))
    events = F.transform(
        F.filter("_all", lambda e: e["item_id"].isNotNull()),
        lambda e: F.struct(
            e["item_id"].alias("item_id"), e["severity"].alias("severity"), e["category"].alias("category"),
            *[e[name].alias(name) for name in ADVICE],
            e["priority_keep"].alias("priority_keep"),
            need_push(e["severity"], e["priority_keep"]).alias("need_push"),
        ),
    )
    summary = F.coalesce(own_summary, F.get(stray, F.lit(0))["summary"], F.lit(""))
    # out of a generator: Spark would push a filter on the events below a projection and parse there once more
    return rows.select(*responses.columns, F.inline(F.array(F.struct(events.alias("events"), summary.alias("summary")))))


def need_push(severity: Column, priority_keep: Column) -> Column:
    """Push what is P0, and what the scorer explicitly regraded (keep is exactly false)."""
    return F.coalesce(F.upper(severity) == "P0", F.lit(False)) | F.coalesce(~priority_keep, F.lit(False))


def push_rollup(parsed: DataFrame) -> DataFrame:
    """Per answer: event count, whether anything must be pushed, pushed items in answer order.

    Works on the array inside the row; no shuffle and nothing to collect.
    """
    pushed = F.filter("events", lambda e: e["need_push"])
    return parsed.select(
        *[c for c in parsed.columns if c != "events"],
        F.size("events").cast("bigint").alias("event_count"),
        (F.size(pushed) > 0).alias("need_push"),
        F.transform(pushed, lambda e: e["item_id"]).alias("pushed_items"),
    )


def alerts(rollup: DataFrame) -> DataFrame:
    return rollup.where("need_push").drop("need_push", "event_count")


def digest(rollup: DataFrame) -> DataFrame:
    return rollup.where(~F.col("need_push")).drop("need_push", "pushed_items")


def rule_alerts(events: DataFrame) -> DataFrame:
    """Routing by rule alone, for events no scorer has seen."""
    return events.where(need_push(F.col("severity"), F.lit(None).cast("boolean")))
