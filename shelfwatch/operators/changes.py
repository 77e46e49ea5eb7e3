"""Field-by-field change detection between an item version and the one before it.

All eight checks are evaluated in one pass over the pairs, and the numbers of those that hit are
exploded. No self-joins and no union of eight scans.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as V
from ..functions.scalars import relative_change, role_or_unknown, signed_percent, word_changes, word_list_text

FIELDS = (
    "listing_status", "price", "stock", "main_image", "title", "promotion", "review_count", "rating",
)
KEPT = ("item_id", "source_id", "fetched_at", "seq")
TIME = "fetched_at"


def _number(column: Column) -> Column:
    return column.try_cast("double")


@dataclass(frozen=True)
class Check:
    """What one check says about a pair: whether the field changed, and the columns of its event."""

    changed: Column
    severity: Column | str
    event: Column | str
    old_value: Column
    new_value: Column
    old_num: Column | None = None
    new_num: Column | None = None
    ratio: Column | None = None


def _listing_status(old: Column, new: Column, exact: bool) -> Check:
    text = F.when(new.eqNullSafe(F.lit("on_sale")), V.TEXT_ON_SALE).otherwise(V.TEXT_OFF_SALE)
    return Check(~old.eqNullSafe(new), "P0", text, old, new)


def _price(old: Column, new: Column, exact: bool) -> Check:
    was, now = _number(old), _number(new)
    ratio = relative_change(was, now)
    step = ratio
    if exact:
        # cents as decimals: a cut of exactly a tenth is a tenth
        cents_was, cents_now = was.cast("decimal(18,2)"), now.cast("decimal(18,2)")
        step = F.coalesce(F.try_divide(cents_now - cents_was, F.abs(cents_was)), F.lit(0).cast("decimal(38,18)"))
    severity = (
        F.when(step <= -_limit(V.PRICE_P0_RATIO, exact), "P0")
        .when((step <= -_limit(V.PRICE_P1_RATIO, exact)) | (step >= _limit(V.PRICE_P0_RATIO, exact)), "P1")
        .otherwise("P2")
    )
    text = F.concat(F.lit(V.TEXT_PRICE), signed_percent(ratio))
    return Check(was != now, severity, text, was, now, was, now, ratio)


def _stock(old: Column, new: Column, exact: bool) -> Check:
    was, now = _number(old), _number(new)
    ratio = relative_change(was, now)
    severity = F.when(now == 0, "P0").when(ratio <= -V.STOCK_CRASH_RATIO, "P1").otherwise("P3")
    return Check(was != now, severity, V.TEXT_STOCK, was.cast("bigint"), now.cast("bigint"), was, now, ratio)


def _main_image(old: Column, new: Column, exact: bool) -> Check:
    shown = F.lit(V.TEXT_OLD_IMAGE), F.lit(V.TEXT_NEW_IMAGE)
    return Check(~old.eqNullSafe(new), "P1", V.TEXT_IMAGE, *shown)


def _title(old: Column, new: Column, exact: bool) -> Check:
    was, now = F.coalesce(old, F.lit("")), F.coalesce(new, F.lit(""))
    gained, lost = word_changes(was, now)
    text = F.concat(
        F.lit(V.TEXT_TITLE_GAINED), word_list_text(gained), F.lit(V.TEXT_TITLE_LOST), word_list_text(lost)
    )
    shown = F.substring(was, 1, V.TITLE_SHOWN_CHARS), F.substring(now, 1, V.TITLE_SHOWN_CHARS)
    return Check(was != now, "P2", text, *shown)


def _promotion(old: Column, new: Column, exact: bool) -> Check:
    return Check(~old.eqNullSafe(new), "P1", V.TEXT_PROMOTION, old, new)


def _review_count(old: Column, new: Column, exact: bool) -> Check:
    was, now = _number(old), _number(new)
    return Check(now > was, "P3", V.TEXT_REVIEWS, was.cast("bigint"), now.cast("bigint"), was, now)


def _rating(old: Column, new: Column, exact: bool) -> Check:
    was, now = _number(old), _number(new)
    fall = was - now if not exact else was.cast("decimal(18,2)") - now.cast("decimal(18,2)")
    return Check(fall >= _limit(V.RATING_DROP, exact), "P1", V.TEXT_RATING, was, now, was, now)


def _limit(value: float, exact: bool) -> Check:
    return F.lit(value) if not exact else F.lit(f"{value:.2f}").cast("decimal(4,2)")


CHECKS = {
    "listing_status": _listing_status,
    "price": _price,
    "stock": _stock,
    "main_image": _main_image,
    "title": _title,
    "promotion": _promotion,
    "review_count": _review_count,
    "rating": _rating,
}


def _checks(fields: Sequence[str], exact: bool) -> dict[int, Check]:
    return {FIELDS.index(f) + 1: CHECKS[f](F.col("prev")[f], F.col(f), exact) for f in fields}


def diff_events(
    pairs: DataFrame, fields: Sequence[str] = FIELDS, kept: Sequence[str] = KEPT, exact: bool = False, as_of: datetime | None = None
) -> DataFrame:
    """One row per changed field, in check order; an item's first version gives none.

    ``detected_at`` is ``as_of``, or when the newer version was fetched.

    Only check numbers are exploded. The columns of an event are worked out behind the explode, so
    columns nobody selects cost nothing.
    """
    checks = _checks(fields, exact)
    found = F.array(*[F.when(check.changed, F.lit(no)) for no, check in checks.items()])
    moment = F.col(TIME) if as_of is None else F.lit(as_of.isoformat(sep=" ")).cast(pairs.schema[TIME].dataType)
    carried = [c for c in dict.fromkeys([*kept, *fields, TIME]) if c in kept or c in fields or as_of is None]
    hits = (
        pairs.where(F.col("prev").isNotNull())
        .select(*carried, "prev", F.explode(found).alias("check_no"))
        .where(F.col("check_no").isNotNull())
    )

    def pick(part: str, kind: str) -> Column:
        chosen = F.lit(None).cast(kind)
        for no, check in reversed(checks.items()):
            value = getattr(check, part)
            if value is not None:
                value = value if isinstance(value, Column) else F.lit(value)
                chosen = F.when(F.col("check_no") == no, value.cast(kind)).otherwise(chosen)
        return chosen.alias(part)

    return hits.select(
        *kept,
        "check_no",
        F.element_at(F.array(*[F.lit(f) for f in FIELDS]), F.col("check_no")).alias("field"),
        *[pick(part, "string") for part in ("severity", "old_value", "new_value")],
        *[pick(part, "double") for part in ("old_num", "new_num", "ratio")],
        pick("event", "string"),
        moment.alias("detected_at"),
    )


def summarized(pairs: DataFrame, fields: Sequence[str] = FIELDS, exact: bool = False) -> DataFrame:
    """Versions with their ``event_count`` and the worst grade among the events their ``role`` shows.

    For counts and grades alone: nothing is exploded. An item's first version brings no event.
    """
    count, shown = F.lit(0).cast("bigint"), []
    rival, paired = F.col("role") == "competitor", F.col("prev").isNotNull()
    for check in _checks(fields, exact).values():
        changed = paired & F.coalesce(check.changed, F.lit(False))
        severity = check.severity if isinstance(check.severity, Column) else F.lit(check.severity)
        count = count + changed.cast("bigint")
        shown.append(F.when(changed & (rival | severity.isin("P0", "P1")), severity))
    return pairs.withColumns({"event_count": count, "top_severity": F.array_min(F.array(*shown))})


def baselines(pairs: DataFrame, kept: Sequence[str] = KEPT) -> DataFrame:
    """The silent first-sight event of each item."""
    return pairs.where(F.col("prev").isNull()).select(
        *kept,
        F.lit("init").alias("field"),
        F.lit(V.LOWEST_SEVERITY).alias("severity"),
        F.lit(None).cast("string").alias("old_value"),
        F.coalesce(F.col("listing_status"), F.lit("unknown")).alias("new_value"),
        F.lit(V.TEXT_BASELINE).alias("event"),
    )


def silent_versions(pairs: DataFrame, kept: Sequence[str] = KEPT) -> DataFrame:
    """Versions stored because the content differs, though no checked field does (skus, list price)."""
    quiet = F.lit(True)
    for check in _checks(FIELDS, exact=False).values():
        quiet = quiet & ~F.coalesce(check.changed, F.lit(False))
    return pairs.where(F.col("prev").isNotNull()).where(quiet).select(*kept)


def with_role(events: DataFrame, targets: DataFrame) -> DataFrame:
    """Attach role and priority. Targets grow with the catalogue, so Spark picks the join by size."""
    known = targets.select("item_id", "role", "priority")
    return events.join(known, "item_id", "left").withColumn("role", role_or_unknown(F.col("role")))


def visible_events(events: DataFrame) -> DataFrame:
    """Competitor items keep every event, all others only P0 and P1."""
    return events.where((F.col("role") == "competitor") | F.col("severity").isin("P0", "P1"))


def top_severity(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Most severe grade, overall (P3 when there is no event) or per ``by``."""
    worst = F.coalesce(F.min("severity"), F.lit(V.LOWEST_SEVERITY)).alias("top_severity")
    return events.groupBy(*by).agg(worst)


def severity_rollup(events: DataFrame) -> DataFrame:
    """Reporting extension: event counts per role and severity with subtotals."""
    return events.rollup("role", "severity").agg(F.count(F.lit(1)).alias("events"))
