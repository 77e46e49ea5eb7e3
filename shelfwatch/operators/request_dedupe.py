"""Request dedupe within a TTL that is anchored at the last real fetch.

A request is a hit when the last *fetched* success of the same fingerprint at the same source is
less than ``ttl`` old; hits do not extend the window and failures are not remembered. The fetched
successes ("anchors") form a chain: each is the first success at least ``ttl`` after the one before.

Two ways to find the anchors, with equal results:

* keys of ordinary size: one ordered pass per partition (``mapInPandas``), constant memory;
* hot keys (see ``find_cuts``): the chain by pointer doubling. Every success points at the first
  success ``ttl`` later; joining the pointers with themselves doubles their reach, so a chain of n
  anchors takes log2(n) rounds of evenly spread joins and never meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable, stored
from .ordered import Cuts, OrderedScan, last_known

KEY = ("source_id", "request_fp")
ORDER = ("ts_us", "seq")
_COLUMNS = (*KEY, *ORDER, "ok")
_SCHEMA = "source_id string, request_fp string, ts_us bigint, seq bigint, ok boolean, hit boolean"


def dedupe_input(log: DataFrame, fp: str = "request_fp") -> DataFrame:
    """The five columns the rule needs; times as whole microseconds."""
    return log.select(
        "source_id", F.col(fp).alias("request_fp"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("seq").cast("bigint").alias("seq"), "ok",
    )


def request_dedupe(requests: DataFrame, ttl_seconds: int, cuts: Cuts | None = None) -> DataFrame:
    """``requests`` (see ``dedupe_input``) with ``hit``; ``cuts`` are positions per (source_id, request_fp)."""
    ttl_us = int(ttl_seconds * 1_000_000)
    rows = requests.select(*_COLUMNS)
    if ttl_us <= 0:
        return rows.withColumn("hit", F.lit(False))
    if cuts is None:
        return _ordered_pass(rows, ttl_us)
    rows = stored(rows)  # read three times below; a fingerprint is costly
    hot_keys = F.broadcast(cuts.table.select(*KEY))
    cold = _ordered_pass(rows.join(hot_keys, list(KEY), "left_anti"), ttl_us)
    return cold.unionByName(_chained(rows.join(hot_keys, list(KEY), "left_semi"), ttl_us, cuts))


def fold_hits(ts: np.ndarray, ok: np.ndarray, ttl_us: int, anchor: int | None) -> tuple[np.ndarray, int | None]:
    """Hit flags of one key's ordered requests, given the anchor so far; returns the new anchor too.

    Steps from anchor to anchor: everything before anchor + ttl is a hit, the next success after it
    is the next anchor.
    """
    hit = np.zeros(len(ts), dtype=bool)
    successes = np.flatnonzero(ok)
    at = 0
    while at < len(ts):
        if anchor is not None:
            fresh_until = int(np.searchsorted(ts, anchor + ttl_us, side="left"))
            hit[at:fresh_until] = True
            at = max(at, fresh_until)
        ahead = int(np.searchsorted(successes, at, side="left"))
        if ahead == len(successes):
            break
        anchor, at = int(ts[successes[ahead]]), int(successes[ahead]) + 1
    return hit, anchor


def _ordered_pass(rows: DataFrame, ttl_us: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = None, None
        for batch in batches:
            if batch.empty:
                continue
            names = [batch[c].to_numpy() for c in KEY]
            changes = np.logical_or.reduce([n[1:] != n[:-1] for n in names])
            starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
            ends = np.append(starts[1:], len(batch))
            ts, ok = batch["ts_us"].to_numpy(), batch["ok"].to_numpy(dtype=bool)
            hit = np.zeros(len(batch), dtype=bool)
            for begin, end, *here in zip(starts.tolist(), ends.tolist(), *[n[starts] for n in names], strict=True):
                if here != key:
                    key, anchor = here, None
                    if end - begin == 1:
                        anchor = int(ts[begin]) if ok[begin] else None
                        continue
                hit[begin:end], anchor = fold_hits(ts[begin:end], ok[begin:end], ttl_us, anchor)
            yield batch.assign(hit=hit)

    ordered = rows.repartition(*KEY).sortWithinPartitions(*KEY, *ORDER)
    return ordered.mapInPandas(run, _SCHEMA)


def _chained(rows: DataFrame, ttl_us: int, cuts: Cuts) -> DataFrame:
    anchors = _anchors(rows, ttl_us, cuts).withColumn("_anchor", F.lit(True))
    marked = rows.join(anchors, [*KEY, *ORDER], "left")
    is_anchor = F.coalesce(F.col("_anchor"), F.lit(False))
    scan = OrderedScan(marked, list(KEY), list(ORDER), cuts)
    scan = scan.add(_last=last_known(F.when(is_anchor, F.col("ts_us"))))
    fresh = F.coalesce(F.col("ts_us") - F.col("_last") < ttl_us, F.lit(False))
    return scan.result().select(*_COLUMNS, (fresh & ~is_anchor).alias("hit"))


def _anchors(rows: DataFrame, ttl_us: int, cuts: Cuts) -> DataFrame:
    """Anchor rows (key, ts_us, seq) of the hot keys."""
    nodes = durable(rows.where("ok").groupBy(*KEY, "ts_us").agg(F.min("seq").alias("seq")))
    jump = durable(_next_success(nodes, ttl_us, cuts))
    reached = nodes.groupBy(*KEY).agg(F.min("ts_us").alias("ts_us"))
    while not jump.isEmpty():
        step = reached.join(jump, [*KEY, "ts_us"]).select(*KEY, F.col("to_us").alias("ts_us"))
        reached = durable(reached.unionByName(step))
        further = jump.select(*KEY, F.col("ts_us").alias("to_us"), F.col("to_us").alias("_to"))
        jump = durable(jump.join(further, [*KEY, "to_us"]).select(*KEY, "ts_us", F.col("_to").alias("to_us")))
    return nodes.join(reached, [*KEY, "ts_us"], "left_semi")


def _next_success(nodes: DataFrame, ttl_us: int, cuts: Cuts) -> DataFrame:
    """Each success time with the first success time at least one TTL later (``to_us``)."""
    # read backwards in time the wanted row is the last one known; the cut positions turn round with it
    back = F.lit(0) - F.col("ts_us")
    offered = nodes.select(*KEY, back.alias("_back"), F.lit(0).alias("_kind"), F.col("ts_us").alias("_node"), F.lit(None).cast("bigint").alias("_ask"))
    asked = nodes.select(
        *KEY, (back - F.lit(ttl_us)).alias("_back"), F.lit(1).alias("_kind"), F.lit(None).cast("bigint").alias("_node"),
        F.col("ts_us").alias("_ask"),
    )
    turned = cuts.table.withColumn(
        "cuts",
        F.array_sort(F.array_distinct(F.transform("cuts", lambda c: F.struct((F.lit(0) - c["ts_us"]).alias("_back"), F.lit(0).alias("_kind"))))),
    )
    scan = OrderedScan(offered.unionByName(asked), list(KEY), ["_back", "_kind"], Cuts(turned, cuts.keys))
    found = scan.add(to_us=last_known(F.col("_node"))).result()
    return found.where(F.col("_ask").isNotNull() & F.col("to_us").isNotNull()).select(
        *KEY, F.col("_ask").alias("ts_us"), "to_us"
    )


def cached_requests(deduped: DataFrame, ttl_seconds: int) -> DataFrame:
    """Fingerprints each source still remembers after its last fetched success."""
    ttl_us = int(ttl_seconds * 1_000_000)
    fetched = deduped.where(F.col("ok") & ~F.col("hit"))
    newest = fetched.groupBy(*KEY).agg(F.max("ts_us").alias("at_us"))
    ends = newest.groupBy("source_id").agg(F.max("at_us").alias("_end"))
    # one row per source on the right; Spark picks the join by its size
    alive = newest.join(ends, "source_id").where(F.col("_end") - F.col("at_us") <= ttl_us)
    return alive.groupBy("source_id").agg(F.count(F.lit(1)).alias("cached_requests"))
