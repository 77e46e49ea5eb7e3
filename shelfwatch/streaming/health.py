"""Source health on a stream of attempts that come out of order, micro-batch by micro-batch.

Attempts wait in a table until the watermark (the newest time seen less the allowed lateness) has
passed them. Those it passes are released in time order and continue the breaker log from the states
the batch before left, one row per source; attempts that come behind the watermark go to a table of
late ones. The watermark is also the clock: a breaker whose cooldown it passes goes from open to
degraded then and there, whether the source sends anything or not.

Everything a batch needs of the one before is in committed tables, so a replayed batch starts from the
same rows. The work inside a batch is the batch operator, so a source that sends most of the rows is
sliced like anywhere else, and no attempt passes through Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fetchlog import LOG_ORDER, SOURCE
from ..operators.health import STATE, BreakerPolicy, breaker_log, last_state
from ..operators.ordered import Cuts, OrderedScan, Slicing, find_cuts, previous
from ..sources.committed import CommittedTables, one_row

_NEVER = -(2**62)


@dataclass(frozen=True)
class HealthBatch:
    """What one micro-batch brings: the breaker log of the released attempts, transitions by the clock,
    late attempts; and what the next one needs: states, attempts still waiting, the clock (one row)."""

    attempts: DataFrame
    transitions: DataFrame
    late: DataFrame
    states: DataFrame
    waiting: DataFrame
    clock: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self.__dataclass_fields__}


def _us(ts: str = "ts"):
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _states_after(log: DataFrame, before: DataFrame | None) -> DataFrame:
    """``last_state`` with the time of the source's last attempt; sources without a row keep theirs."""
    times = log.groupBy(F.col(SOURCE).alias("_source")).agg(F.max(_us()).alias("last_us"))
    states = last_state(log).join(times, F.col(SOURCE) == F.col("_source")).select(SOURCE, *STATE, "last_us")
    if before is None:
        return states
    return states.unionByName(before.join(states.select(SOURCE), SOURCE, "left_anti"))


def clock_moves(log: DataFrame, before: DataFrame | None, states: DataFrame, passed: int, now: int, cuts: Cuts | None = None) -> DataFrame:
    """The breakers whose cooldown ended after ``passed`` and not after ``now`` while they were open:
    source_id, at_us, from_state, to_state.

    ``log`` holds every attempt of that time, so what the state was when the cooldown ended is known: it
    ends before the source's next attempt, or the source has none up to ``now``.
    """
    scan = OrderedScan(log.withColumn("_us", _us()), [SOURCE], LOG_ORDER, cuts)
    rows = scan.add(_last=previous(F.struct("breaker", "open_until_us", "_us"))).result()
    start = (before if before is not None else states.limit(0)).select(
        F.col(SOURCE).alias("_source"), F.struct("breaker", "open_until_us", F.col("last_us").alias("_us")).alias("_start")
    )
    rows = rows.join(start, F.col(SOURCE) == F.col("_source"), "left").withColumn("_last", F.coalesce("_last", "_start"))
    def ended(state: Column, until: Column, since: Column) -> Column:
        return (state == "open") & (since < until) & (until > passed) & (until <= now)

    last = F.col("_last")
    inside = rows.where(ended(last["breaker"], last["open_until_us"], last["_us"]) & (last["open_until_us"] <= F.col("_us")))
    quiet = states.where(ended(F.col("breaker"), F.col("open_until_us"), F.col("last_us")))
    moved = inside.select(SOURCE, last["open_until_us"].alias("at_us")).unionByName(quiet.select(SOURCE, F.col("open_until_us").alias("at_us")))
    return moved.select(SOURCE, "at_us", F.lit("open").alias("from_state"), F.lit("degraded").alias("to_state"))


def health_of_batch(
    batch: DataFrame,
    before: dict[str, DataFrame] | None,
    lateness_seconds: float = 0,
    policy: BreakerPolicy = BreakerPolicy(),
    slicing: Slicing = Slicing(),
    last: bool = False,
) -> HealthBatch:
    """One micro-batch, from the tables of the one before (None for the first).

    ``last`` releases all that waits, up to and including the newest time seen. ``attempts`` is persisted,
    as most of the other tables come from it; unpersist it when they are written.
    """
    passed = newest = None
    waiting, states_before = batch.limit(0), None
    if before is not None:
        clock = before["clock"].first()  # one row
        passed, newest = clock["passed_us"], clock["newest_us"]
        waiting, states_before = before["waiting"], before["states"]
    seen = batch.agg(F.max(_us()).alias("newest")).first()["newest"]
    newest = max((x for x in (newest, seen) if x is not None), default=None)
    passed = _NEVER if passed is None else passed
    now = passed
    if newest is not None:
        now = newest + 1 if last else max(passed, newest - int(lateness_seconds * 1_000_000))
    pool = batch.where(_us() >= passed).unionByName(waiting.select(*batch.columns))
    ready = pool.where(_us() < now)
    cuts = find_cuts(ready, [SOURCE], LOG_ORDER, slicing)
    log = breaker_log(ready, policy, cuts, states_before).persist()
    states = _states_after(log, states_before)
    moves = clock_moves(log, states_before, states, passed, now, cuts)
    clock = one_row(batch.sparkSession, passed_us=now, newest_us=newest)
    return HealthBatch(log, moves, batch.where(_us() < passed), states, pool.where(_us() >= now), clock)


def start_source_health(
    attempts: DataFrame, out: str, checkpoint: str, policy: BreakerPolicy = BreakerPolicy(), lateness_seconds: float = 0
):
    """Start the query; its tables are ``HealthBatch.tables`` as ``CommittedTables`` under ``out``."""
    tables = CommittedTables(attempts.sparkSession, out)

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        before = None
        if batch_id > 0:
            before = {name: tables.read_batch(name, batch_id - 1) for name in ("states", "waiting", "clock")}
        done = health_of_batch(rows, before, lateness_seconds, policy)
        tables.write(batch_id, done.tables())
        done.attempts.unpersist()
        rows.unpersist()

    return (
        attempts.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def finish_source_health(tables: CommittedTables, policy: BreakerPolicy = BreakerPolicy()) -> None:
    """After the end of the stream: release what still waits as one more batch."""
    last = tables.commits()[-1].last
    before = {name: tables.read_batch(name, last) for name in ("states", "waiting", "clock")}
    nothing = before["waiting"].limit(0)
    done = health_of_batch(nothing, before, 0, policy, last=True)
    tables.write(last + 1, done.tables())
    done.attempts.unpersist()
