"""A uniform shuffle into shards of exact sizes through a hypergeometric communication matrix.

The rows are written to the shared folder; a written file is a partition and a row's place in it is
fixed, so a lost task finds the same rows again however the files are split for reading. The matrix
says how many rows of each file go to each shard: its rows are drawn one after the other from the
multivariate hypergeometric distribution, so file counts and shard sizes are met exactly. Each file
then deals its shard labels in a random order (the local permutation), the rows are exchanged, and
every shard permutes again: random positions, cut into blocks by their leading bits so that no task
sorts a whole shard, with the blocks' row counts carried over.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..plans.shared import durable, shared_dir
from .text import free_name

BLOCK_ROWS = 50_000
_NUMPY_LIMIT = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws from ``good + bad`` are good; beyond numpy's range by inversion from the mode."""
    if not good or not n:
        return 0
    if not bad:
        return n
    if good < _NUMPY_LIMIT and bad < _NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, n))
    low, high = max(0, n - bad), min(n, good)
    log_choose = lambda a, b: math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))
    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    left = rng.random() - at_mode
    up, down, p_up, p_down = mode, mode, at_mode, at_mode
    while left > 0 and (up < high or down > low):
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(counts: list[int], capacities: list[int], seed: int) -> np.ndarray:
    """Rows per (partition, shard), drawn uniformly among all ways to meet both margins."""
    rng = np.random.default_rng(seed)
    left = list(capacities)
    matrix = np.zeros((len(counts), len(capacities)), dtype=np.int64)
    for i, n in enumerate(counts):
        others = sum(left)
        for j in range(len(left)):
            others -= left[j]
            matrix[i, j] = got = hypergeometric(rng, left[j], others, n)
            left[j] -= got
            n -= got
    return matrix


def shard(rows: DataFrame, shards: int = 8, seed: int = 2) -> DataFrame:
    """``rows`` with ``shard`` (0 to shards - 1) and ``slot`` (0, 1, ... within the shard), in a uniform order.

    Shard sizes differ by one row at most. Columns of those names are replaced. Texts, nulls, ties and
    repeated rows play no part: every row is dealt on its own. An empty table gives no rows.
    The driver sees one count per written file, never rows.
    """
    rows = rows.drop("shard", "slot")
    spark, columns = rows.sparkSession, rows.columns
    folder = f"{shared_dir(spark)}/shard-{uuid.uuid4().hex}"
    # a column of this name would hide the files' own
    rows = rows.withColumnsRenamed({c: f"{free_name(columns, '_own')}{k}" for k, c in enumerate(columns) if c.lower() == "_metadata"})
    rows.write.parquet(folder)
    names = {x: free_name(rows.columns, x) for x in ("_file", "_at", "_u", "_block")}
    file, at, u, block = names.values()
    stored = spark.read.schema(rows.schema).parquet(folder)
    # the file's name tells its number; its own folder is the same for all
    placed = stored.withColumns({file: F.col("_metadata.file_name"), at: F.col("_metadata.row_index")})
    found = sorted((r[0], r[1]) for r in placed.groupBy(file).count().collect())
    counts, total = [n for _, n in found], sum(n for _, n in found)
    capacities = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix(counts, capacities, seed)
    plan = {name: (i, matrix[i].tolist()) for i, (name, _) in enumerate(found)}

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, labels, draws = None, None, None
        for batch in batches:
            out = []
            for this, part in batch.groupby(file, sort=False):
                if this != name:
                    number, row = plan[this]
                    rng = np.random.default_rng([seed, number])
                    labels = rng.permutation(np.repeat(np.arange(len(row), dtype=np.int32), row))
                    draws, name = rng.integers(0, 2**62, size=len(labels)), this
                where = part[at].to_numpy()
                out.append(pd.DataFrame({file: this, at: where, "shard": labels[where], u: draws[where]}))
            yield pd.concat(out) if out else pd.DataFrame({file: [], at: [], "shard": [], u: []})

    labels = durable(placed.select(file, at).mapInPandas(deal, f"`{file}` string, `{at}` bigint, shard int, `{u}` bigint"))
    bits = max(0, math.ceil(math.log2(max(1, total / shards / BLOCK_ROWS))))
    labels = labels.withColumn(block, F.shiftright(u, 62 - bits))
    ahead = W.partitionBy("shard").orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    starts = labels.groupBy("shard", block).agg(F.count(F.lit(1)).alias("n")).select("shard", block, F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    nth = F.row_number().over(W.partitionBy("shard", block).orderBy(u, file, at)) - 1
    slots = labels.withColumn("nth", nth).join(starts, ["shard", block]).select(file, at, "shard", (F.col("start") + F.col("nth")).alias("slot"))
    return placed.join(slots, [file, at]).drop(file, at).toDF(*columns, "shard", "slot")
