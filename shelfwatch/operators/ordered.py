"""Ordered per-key scans (previous row, running totals, last known value) without a one-task key.

A Spark window sends every row of a key to one task. Item, source and URL histories are skewed: one
key may hold a third of the table. ``OrderedScan`` therefore cuts the history of a *hot* key into
slices of consecutive rows. Each slice is an ordinary window partition; what has to cross a slice
border (the last row, a running total) is one small aggregate per slice, scanned once per key and
joined back. Results equal those of the plain window.

``find_cuts`` decides, from a sample of positions, which keys are hot and where to cut. The sample
only places the borders; no row is left out. Sizes are bounded whatever the data: at most about
``max_slices`` cuts exist in total, so the cut table and the per-slice aggregates can be broadcast
(tens of thousands of rows at 10^12 input rows, where a slice then holds some 30 million).
With no hot key the scan is the plain window, with nothing added to its plan. With hot keys the rows are
written once before each ``add``, so that the log itself is read once and the work grows with the number
of ``add`` calls.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..plans.shared import durable

SLICE = "_slice"
_SAMPLE_PER_SLICE = 64


@dataclass(frozen=True)
class Slicing:
    """When a key is cut: slices hold about ``slice_rows`` rows, and there are about ``max_slices`` of them."""

    slice_rows: int = 1_000_000
    max_slices: int = 32_768


@dataclass(frozen=True)
class Cuts:
    """Cut positions of the hot keys: columns ``keys`` and ``cuts ARRAY<STRUCT<order>>``, sorted."""

    table: DataFrame
    keys: tuple[str, ...]


def find_cuts(rows: DataFrame, keys: Sequence[str], order: Sequence[str], slicing: Slicing = Slicing()) -> Cuts | None:
    """Cut positions for the keys too big for one task, or None when there is no such key.

    ``rows`` may be any superset of the rows to scan (a raw table whose footers give the count is
    cheapest); only ``keys`` and ``order`` are read. Runs two small jobs while the plan is built.
    """
    total = rows.count()
    target = max(slicing.slice_rows, -(-total // slicing.max_slices))
    if total <= 2 * target:
        return None
    one_in = max(1, target // _SAMPLE_PER_SLICE)
    per_slice = target // one_in
    # positions differ within a key, so hashing them alone samples each key evenly, and a key that is
    # costly to work out (a fingerprint) is only computed for the sampled rows
    sample = (
        rows.select(*keys, *order)
        .where(F.pmod(F.xxhash64(*order), F.lit(one_in)) == 0)
        .select(*keys, F.struct(*order).alias("pos"))
    )
    hot = (
        sample.groupBy(*keys)
        .agg(F.array_sort(F.collect_list("pos")).alias("pos"))
        .where(F.size("pos") >= 2 * per_slice)
        .select(*keys, F.filter("pos", lambda p, i: (i > 0) & (i % per_slice == 0)).alias("cuts"))
    )
    # bounded: about one cut per `target` rows, so at most about `max_slices` structs over all keys
    found = hot.collect()
    if not found:
        return None
    return Cuts(rows.sparkSession.createDataFrame(found, hot.schema), tuple(keys))


def with_slice(rows: DataFrame, order: Sequence[str], cuts: Cuts) -> DataFrame:
    """Add the slice number: how many cuts lie at or before the row (null for keys that are not hot)."""
    here = F.struct(*order)
    # binary search over the sorted cuts: jump ahead by 2^k while the cut reached is not past the row
    jumps = F.array(*[F.lit(1 << k) for k in reversed(range(16))])
    number = F.aggregate(
        jumps,
        F.lit(0),
        lambda at, jump: F.when(
            (at + jump <= F.size("_cuts")) & (F.get(F.col("_cuts"), at + jump - 1) <= here), at + jump
        ).otherwise(at),
    )
    marked = rows.join(F.broadcast(cuts.table.withColumnRenamed("cuts", "_cuts")), list(cuts.keys), "left")
    # the coalesce tells the optimizer that only the cuts decide whether there is a slice
    return marked.withColumn(SLICE, F.when(F.col("_cuts").isNotNull(), F.coalesce(number, F.lit(0)))).drop("_cuts")


@dataclass(frozen=True)
class Scan:
    """One scanned column: its value inside a slice, a slice's summary, and how a summary carries on."""

    local: Callable[[WindowSpec], Column]
    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    merge: Callable[[Column, Column], Column]


def _so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def running_sum(value: Column) -> Scan:
    return Scan(
        local=lambda w: F.sum(value).over(_so_far(w)),
        summary=lambda pos: F.sum(value),
        carry=lambda c, w: F.sum(c).over(w),
        merge=lambda here, before: here + F.coalesce(before, F.lit(0)),
    )


def position() -> Scan:
    """Rank in the key's history, from 1."""
    return Scan(
        local=lambda w: F.row_number().over(w).cast("bigint"),
        summary=lambda pos: F.count(F.lit(1)),
        carry=lambda c, w: F.sum(c).over(w),
        merge=lambda here, before: here + F.coalesce(before, F.lit(0)),
    )


def running_min(value: Column) -> Scan:
    return Scan(
        local=lambda w: F.min(value).over(_so_far(w)),
        summary=lambda pos: F.min(value),
        carry=lambda c, w: F.min(c).over(w),
        merge=lambda here, before: F.least(here, before),
    )


def running_max(value: Column) -> Scan:
    return Scan(
        local=lambda w: F.max(value).over(_so_far(w)),
        summary=lambda pos: F.max(value),
        carry=lambda c, w: F.max(c).over(w),
        merge=lambda here, before: F.greatest(here, before),
    )


def previous(row: Column) -> Scan:
    """The row before this one; ``row`` must be a struct (never null itself)."""
    return Scan(
        local=lambda w: F.lag(row).over(w),
        summary=lambda pos: F.max_by(row, pos),
        carry=lambda c, w: F.last(c, ignorenulls=True).over(w),
        merge=lambda here, before: F.coalesce(here, before),
    )


def last_known(value: Column) -> Scan:
    """The newest non-null value up to and including this row."""
    return Scan(
        local=lambda w: F.last(value, ignorenulls=True).over(_so_far(w)),
        summary=lambda pos: F.max_by(value, F.when(value.isNotNull(), pos)),
        carry=lambda c, w: F.last(c, ignorenulls=True).over(w),
        merge=lambda here, before: F.coalesce(here, before),
    )


class OrderedScan:
    """Rows grouped by ``keys`` and totally ordered by ``order``; ``add`` computes scanned columns."""

    def __init__(self, rows: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Cuts | None = None):
        self.keys, self.order, self.hot = list(keys), list(order), cuts is not None
        self._columns = rows.columns
        self.rows = with_slice(rows, order, cuts) if cuts is not None else rows

    def add(self, **scans: Scan) -> OrderedScan:
        parts = self.keys + ([SLICE] if self.hot else [])
        inside = Window.partitionBy(*parts).orderBy(*self.order)
        if self.hot:  # read twice below; left lazy, every further ``add`` would double the plan
            self.rows = durable(self.rows)
        local = self.rows.select("*", *[s.local(inside).alias(name) for name, s in scans.items()])
        if self.hot:
            local = self._carried(local, parts, scans)
        self.rows = local
        return self

    def _carried(self, local: DataFrame, parts: list[str], scans: dict[str, Scan]) -> DataFrame:
        pos = F.struct(*self.order)
        summaries = (
            self.rows.where(F.col(SLICE).isNotNull())
            .groupBy(*parts)
            .agg(*[s.summary(pos).alias(name) for name, s in scans.items()])
        )
        earlier = Window.partitionBy(*self.keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        carry = summaries.select(
            *parts, *[s.carry(F.col(name), earlier).alias(f"_before_{name}") for name, s in scans.items()]
        )
        # one row per slice: bounded by the number of cuts
        joined = local.join(F.broadcast(carry), parts, "left")
        merged = {name: s.merge(F.col(name), F.col(f"_before_{name}")) for name, s in scans.items()}
        return joined.withColumns(merged).drop(*[f"_before_{name}" for name in scans])

    def result(self) -> DataFrame:
        """The input columns in their order, then the added ones."""
        have = [c for c in self.rows.columns if c != SLICE]
        return self.rows.select(*[c for c in self._columns if c in have], *[c for c in have if c not in self._columns])
