"""Embedding whitening on the leading principal components.

Entries become whole numbers, x = floor(256 c), and each distinct vector counts once. Spark sums the
vectors exactly, then their centred outer products, one matrix per task; the driver sees sums of
fixed size (the dimension, and its square), never vectors. The eigenpairs come from ``spectrum``.
A last pass projects every row; a second moment of the projections, again summed by task, shows how
far their covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..plans.shared import durable
from . import spectrum

GRID, COMPONENTS = 256, 4
_PLAIN = 1 << 20  # entries up to this size are summed as 64-bit numbers; others as Python's


def _vectors(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), dtype=np.int64)


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows of ``vec_id, embedding`` whose vector is whole and of the usual length.

    A null vector, or one with null or non-finite entries, goes. Vectors can only be centred with others
    of their length: of several lengths the most frequent one stays (the smaller of equals).
    """
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    double = F.transform("embedding", lambda c: c.cast("double"))
    whole = rows.select("vec_id", double.alias("e")).where(F.col("e").isNotNull() & F.forall("e", finite))
    x = whole.select("vec_id", F.transform("e", lambda c: F.floor(c * GRID)).alias("x"))
    lengths = x.groupBy(F.size("x").alias("d")).count().orderBy(F.col("count").desc(), "d").limit(1).collect()
    return x.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """(number of vectors, exact sum by dimension)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _vectors(batch, "x")
            if len(x):
                plain = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) <= _PLAIN
                part = x.sum(axis=0).tolist() if plain else [sum(column) for column in x.T.tolist()]
                total = part if total is None else [a + b for a, b in zip(total, part, strict=True)]
                n += len(x)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": pa.array([[str(t) for t in total]], pa.list_(pa.string()))})

    n, total = 0, []
    for r in distinct.select("x").mapInArrow(add, "n bigint, sums array<string>").toLocalIterator():  # one row per task
        part = [int(t) for t in r["sums"]]
        total = [a + b for a, b in zip(total, part, strict=True)] if total else part
        n += r["n"]
    return n, total


def _second_moment(rows: DataFrame, centre: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    """The sum of outer products of x - centre, or of their projections, over the rows."""
    d = len(centre) if project is None else project.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _vectors(batch, "x")
            if len(x):
                gap = x - centre
                gap = gap if project is None else gap @ project
                total += gap.T @ gap
        i, j = np.divmod(np.arange(d * d), d)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total.ravel())], ["i", "j", "v"])

    parts = rows.select("x").mapInArrow(add, "i bigint, j bigint, v double")
    out = np.zeros((d, d))
    for r in parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # d * d sums
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def whiten(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row of ``vec_id, embedding`` and component.

    vec_id, component (from 1), n, deviation, whitened, explained, identity_error as described in the
    package's query; deviation is null where it exceeds a long. Components whose variance is nothing
    but rounding (see ``spectrum.leading``) cannot be whitened and give no rows, so equal vectors, a
    single vector or an empty table give none. Repeated rows and ids keep their rows; null ids too.
    Other columns are ignored.
    """
    kind = dict(rows.dtypes)["vec_id"]
    schema = StructType.fromDDL(
        f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    )
    kept = quantised(rows)
    distinct = durable(kept.select("x").distinct())
    n, sums = _sums(distinct)
    if not n or not sums:
        return rows.sparkSession.createDataFrame([], schema)
    centre = np.array([float(s // n) + (s % n) / n for s in sums])
    covariance = _second_moment(distinct, centre) / n
    values, vectors = spectrum.leading(covariance, components)
    if not len(values):
        return rows.sparkSession.createDataFrame([], schema)
    explained = values / np.trace(covariance)
    project = vectors.T / np.sqrt(values)
    error = float(np.abs(_second_moment(distinct, centre, project) / n - np.eye(len(values))).max())
    arrow = to_arrow_schema(schema)
    k = len(values)

    def deviations(x: np.ndarray) -> list[int | None]:
        top = max(max(map(abs, sums)), n * max(abs(int(x.max())), abs(int(x.min()))))
        if (2 * top) ** 2 * x.shape[1] < 2**63:
            gap = n * x - np.array(sums, dtype=np.int64)
            return (gap * gap).sum(axis=1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _vectors(batch, "x")
            if len(x):
                at = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)),
                    pa.array(deviations(x), pa.int64()).take(at), pa.array(((x - centre) @ project).ravel()),
                    pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ], schema=arrow)

    return kept.mapInArrow(score, schema)
