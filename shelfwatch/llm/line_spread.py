"""Line dedup by distinct-site spread: HyperLogLog sketches per line, exact counts near the threshold.

Each line's hash gathers a sketch of its sites; sketches merge by aggregation. Lines whose estimate is
clearly beyond the threshold are boilerplate, clearly below are not, and those in between (within
``MARGIN`` relative standard errors) get an exact distinct count. Boilerplate lines are then removed
from every document, whatever its site.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.shared import durable
from .text import SPACES, free_name, whole

LOG_BUCKETS = 10
MARGIN = 4.0
LEAST_SITES = 8


def _line(x: Column) -> Column:
    """A line as compared: without white space at its ends."""
    return F.trim(x, F.lit(SPACES))


def _hashes(text: Column) -> Column:
    """Two hashes per line that has a word."""
    lines = F.filter(F.transform(F.split(text, "\n"), _line), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h1"), F.xxhash64(F.lit(1), x).alias("h2")))


def boilerplate(docs: DataFrame, site: str, text: str, least_sites: int = LEAST_SITES) -> DataFrame:
    """(h1, h2, sites) of the lines that at least ``least_sites`` distinct sites have."""
    lines = docs.select(F.col(site).alias("site"), F.explode(F.array_distinct(_hashes(whole(text)))).alias("l")).where("site IS NOT NULL")
    lines = lines.select("site", "l.h1", "l.h2")
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LOG_BUCKETS)).alias("estimate"))
    error = MARGIN * 1.04 / math.sqrt(1 << LOG_BUCKETS)
    wide = durable(spread.where(F.col("estimate") >= least_sites * (1 - error) - 1))
    near = wide.where(F.col("estimate") <= least_sites * (1 + error) + 1)
    pairs = lines.join(near.select("h1", "h2"), ["h1", "h2"]).distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites")).where(F.col("sites") >= least_sites)
    sure = wide.where(F.col("estimate") > least_sites * (1 + error) + 1).select("h1", "h2", F.col("estimate").alias("sites"))
    return sure.unionByName(exact)


def line_dedup(docs: DataFrame, key: str = "doc_id", site: str = "source", text: str = "text", least_sites: int = LEAST_SITES) -> DataFrame:
    """``docs`` with the cross-site lines taken out of ``text``, and ``n_lines``, ``n_removed``.

    Lines are split at \\n and compared without white space at their ends; lines without a word are
    never removed. A null text stays null and has no lines, an empty one has one; a null site spreads
    nothing but its lines are removed all the same. Equal rows are treated alike and all stay. Columns
    named like the two counts are replaced. An empty table gives an empty one.
    """
    docs = docs.drop("n_lines", "n_removed")
    common = durable(boilerplate(docs, site, text, least_sites))
    names = [free_name(docs.columns, x) for x in ("_k1", "_k2", "_out", "_left")]
    k1, k2, out, left = names
    ids = [F.xxhash64(key, text).alias(k1), F.xxhash64(F.lit(1), text, key).alias(k2)]
    lines = docs.select(*ids, F.explode(F.array_distinct(_hashes(whole(text)))).alias("l")).select(k1, k2, "l.h1", "l.h2").distinct()
    met = lines.join(common.select("h1", "h2"), ["h1", "h2"]).groupBy(k1, k2).agg(F.collect_set(F.struct("h1", "h2")).alias(out))
    marked = docs.withColumns({k1: ids[0], k2: ids[1]}).join(met, [k1, k2], "left")
    split = F.split(F.col(text), "\n")
    stays = F.filter(split, lambda x: (_line(x) == "") | ~F.array_contains(out, F.struct(F.xxhash64(_line(x)).alias("h1"), F.xxhash64(F.lit(1), _line(x)).alias("h2"))))
    cleaned = marked.withColumn(left, F.when(F.col(out).isNotNull(), stays).otherwise(split))
    return cleaned.select(
        *[F.when(F.col(out).isNull(), F.col(c)).otherwise(F.array_join(left, "\n")).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.coalesce(F.size(split), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size(split) - F.size(left), F.lit(0)).cast("bigint").alias("n_removed"),
    )
