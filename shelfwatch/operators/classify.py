"""Business category of a change event and the action that goes with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V


def event_category(role: Column, field: Column, new_value: Column, old_num: Column, new_num: Column) -> Column:
    """First matching rule wins; any role that is neither ours nor unknown counts as a competitor."""
    own = role.eqNullSafe(F.lit("self"))
    deep_cut = F.coalesce(F.try_divide(old_num - new_num, old_num) >= V.PRICE_P0_RATIO, F.lit(False))
    rating_fell = F.coalesce(old_num - new_num >= V.RATING_DROP, F.lit(False))
    off_sale = ~new_value.eqNullSafe(F.lit("on_sale"))
    no_stock = new_num.eqNullSafe(F.lit(0.0))
    return (
        F.when(role == "unknown", V.CATEGORY_UNKNOWN_ROLE)
        .when((field == "price") & own & deep_cut, V.CATEGORY_SELF_PRICE_ALARM)
        .when((field == "price") & own, V.CATEGORY_SELF_PRICE)
        .when(field == "price", V.CATEGORY_RIVAL_PRICE)
        .when((field == "listing_status") & off_sale & own, V.CATEGORY_SELF_OFF)
        .when((field == "listing_status") & off_sale, V.CATEGORY_RIVAL_OFF)
        .when((field == "stock") & no_stock & own, V.CATEGORY_SELF_NO_STOCK)
        .when((field == "stock") & no_stock, V.CATEGORY_RIVAL_NO_STOCK)
        .when(field == "main_image", V.CATEGORY_IMAGE)
        .when(field == "title", V.CATEGORY_TITLE)
        .when(field == "promotion", V.CATEGORY_PROMOTION)
        .when((field == "rating") & rating_fell, V.CATEGORY_RATING)
        .otherwise("")
    )


def with_category(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "category",
        event_category(*[F.col(c) for c in ("role", "field", "new_value", "old_num", "new_num")]),
    )


def action_templates(spark) -> DataFrame:
    entry = lambda t: F.struct(F.lit(t[0]).alias("category"), F.lit(t[1]).alias("action"))
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*[entry(t) for t in V.ACTION_TEMPLATES])))


def with_action(events: DataFrame, templates: DataFrame) -> DataFrame:
    """Standard action per category; no category means human review. Spark picks the join by the templates' size."""
    joined = events.join(templates, "category", "left")
    return joined.withColumn("action", F.coalesce("action", F.lit(V.CATEGORY_FOR_REVIEW)))
