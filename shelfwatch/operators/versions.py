"""Content versions of items: first-seen dedupe, predecessor pairs, latest, as-of, history, retention.

Every operator takes ``order``: columns that order one item's rows totally (time first, then a
unique arrival number), so results do not depend on how the input is partitioned.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import content_fp
from .ordered import Cuts, OrderedScan, last_known, previous
from .request_dedupe import request_dedupe

ITEM = "item_id"
FP = "content_fp"
ORDER = ("fetched_at", "seq")


def with_content_fp(records: DataFrame) -> DataFrame:
    return records.withColumn(FP, content_fp())


def first_versions(records: DataFrame, order: Sequence[str] = ORDER, cuts: Cuts | None = None) -> DataFrame:
    """Keep a record only if its content was never seen before for that item.

    Without hot items one exchange on the item serves this step and the predecessor window after it;
    the fingerprint is taken behind the exchange, so it is not shuffled. With hot items the rows
    spread by (item, fingerprint); Spark then keeps the best row per group before the exchange, so
    even copies of one single content reach a task pre-reduced.
    """
    rows = records.repartition(ITEM) if cuts is None else records
    rows = rows if FP in rows.columns else with_content_fp(rows)
    by_content = Window.partitionBy(ITEM, FP).orderBy(*order)
    return rows.withColumn("_nth", F.row_number().over(by_content)).where("_nth = 1").drop("_nth")


def changed_versions(records: DataFrame, order: Sequence[str] = ORDER, cuts: Cuts | None = None) -> DataFrame:
    """The other dedupe: keep a record if its content differs from the record just before it."""
    rows = records.repartition(ITEM) if cuts is None else records
    rows = rows if FP in rows.columns else with_content_fp(rows)
    scan = OrderedScan(rows, [ITEM], order, cuts).add(_before=previous(F.struct(FP)))
    return scan.result().where(~F.col(FP).eqNullSafe(F.col("_before")[FP])).drop("_before")


def versions_within(records: DataFrame, days: int, order: Sequence[str] = ORDER, cuts: Cuts | None = None) -> DataFrame:
    """``first_versions`` with forgetting: a content counts as new again ``days`` after it was last stored.

    Repeats do not refresh a stored version, so this is the anchored rule of request dedupe with the
    item as source and the content as request. ``cuts`` are positions per (source_id, request_fp).
    """
    time, tie = order
    rows = records if FP in records.columns else with_content_fp(records)
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    asked = rows.select(
        F.col(ITEM).cast("string").alias("source_id"), F.col(FP).alias("request_fp"),
        micros.alias("ts_us"), F.col(tie).cast("bigint").alias("seq"), F.lit(True).alias("ok"),
    )
    stored = request_dedupe(asked, days * 86400, cuts).where(~F.col("hit"))
    keys = stored.select(F.col("source_id").alias("_item"), F.col("request_fp").alias(FP), F.col("ts_us").alias("_us"), F.col("seq").alias("_tie"))
    same = (
        (F.col(ITEM).cast("string") == F.col("_item")) & (rows[FP] == keys[FP])
        & (micros == F.col("_us")) & (F.col(tie) == F.col("_tie"))
    )
    return rows.join(keys, same, "left_semi")


def new_versions(
    batch: DataFrame, known: DataFrame, order: Sequence[str] = ORDER, cuts: Cuts | None = None
) -> DataFrame:
    """Incremental form of ``first_versions``: drop contents already stored, then those repeated in the batch."""
    return first_versions(batch.join(known.select(ITEM, FP), [ITEM, FP], "left_anti"), order, cuts)


def version_pairs(
    versions: DataFrame,
    fields: Sequence[str],
    order: Sequence[str] = ORDER,
    cuts: Cuts | None = None,
) -> DataFrame:
    """Each version with the one before it in ``prev STRUCT<fields>`` (null for an item's first version)."""
    return OrderedScan(versions, [ITEM], order, cuts).add(prev=previous(F.struct(*fields))).result()


def latest(snapshots: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest row of each item; an aggregate, so hot items are reduced before the exchange."""
    whole = F.struct(*[F.col(c) for c in snapshots.columns])
    newest = snapshots.groupBy(ITEM).agg(F.max_by(whole, F.struct(*order)).alias("_row"))
    return newest.select(*[F.col("_row")[c].alias(c) for c in snapshots.columns])


def previous_before(
    probes: DataFrame,
    snapshots: DataFrame,
    before: str,
    fields: Sequence[str],
    order: Sequence[str] = ORDER,
    cuts: Cuts | None = None,
) -> DataFrame:
    """For each probe, the item's newest snapshot strictly older than the probe's time (as-of join).

    Probes and snapshots become one history; a probe sorts ahead of snapshots of the same instant.
    ``cuts`` are positions over (time, *order).
    """
    time, rest = order[0], list(order[1:])
    found = F.struct(*[F.col(c) for c in fields])
    held = snapshots.select(
        ITEM, F.col(time).alias("_time"), F.lit(1).alias("_kind"), *rest, found.alias("_snap"), F.lit(None).alias("_probe")
    )
    asked_columns = F.struct(*[F.col(c) for c in probes.columns])
    asked = probes.select(
        ITEM, F.col(before).alias("_time"), F.lit(0).alias("_kind"),
        *[F.lit(None).cast(snapshots.schema[c].dataType).alias(c) for c in rest],
        F.lit(None).alias("_snap"), asked_columns.alias("_probe"),
    )
    scan = OrderedScan(held.unionByName(asked), [ITEM], ["_time", "_kind", *rest], cuts)
    hits = scan.add(_last=last_known(F.col("_snap"))).result().where(F.col("_probe").isNotNull())
    return hits.select("_probe.*", *[F.col("_last")[c].alias(f"prev_{c}") for c in fields])


def history(snapshots: DataFrame, n: int = 30, order: Sequence[str] = ORDER) -> DataFrame:
    """The newest ``n`` rows of each item; Spark limits each group before the exchange as well."""
    newest_first = Window.partitionBy(ITEM).orderBy(*[F.col(c).desc() for c in order])
    return snapshots.withColumn("nth", F.row_number().over(newest_first)).where(F.col("nth") <= n)


def recent(events: DataFrame, n: int = 100, order: Sequence[str] = ("detected_at", "seq")) -> DataFrame:
    return events.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def retained(rows: DataFrame, as_of: datetime, days: int, time: str = "fetched_at") -> DataFrame:
    """Rows not older than ``days`` at ``as_of``; a plain comparison, so it reaches the scan."""
    return rows.where(F.col(time) >= _cutoff(rows, as_of, days, time))


def expired_count(rows: DataFrame, as_of: datetime, days: int, time: str = "fetched_at") -> DataFrame:
    return rows.where(F.col(time) < _cutoff(rows, as_of, days, time)).agg(F.count(F.lit(1)).alias("expired"))


def _cutoff(rows: DataFrame, as_of: datetime, days: int, time: str):
    moment = F.lit(as_of.isoformat(sep=" ")).cast(rows.schema[time].dataType)
    return moment - F.make_dt_interval(F.lit(days))
