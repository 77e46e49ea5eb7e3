"""Connected components of a link table by minimum labels and pointer jumping."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.shared import shared_dir


def written(rows: DataFrame) -> DataFrame:
    """``rows`` as a table in the shared folder: lineage is cut, and Spark knows the size when it picks a join."""
    spark = rows.sparkSession
    path = f"{shared_dir(spark)}/links-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _both_ways(links: DataFrame) -> DataFrame:
    links = links.select("a", "b").where("a <> b")
    return links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def _first_labels(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("root"))


def _near_labels(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, near): the smallest label among the node's neighbours."""
    told = labels.select(F.col("node").alias("b"), "root")
    return edges.join(told, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))


def neighbourhoods(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root): the smallest id within two links of the node.

    Nodes with one root are connected, so a star becomes one class; longer chains may keep several.
    """
    edges = written(_both_ways(links))
    labels = _first_labels(edges)
    near = _near_labels(edges, labels)
    return written(labels.join(near, "node").select("node", F.least("root", "near").alias("root")))


def components(links: DataFrame) -> DataFrame:
    """(a, b) links of comparable ids -> (node, root): the smallest id of the node's component.

    Every round takes the smallest label among the neighbours and then the label's own label, so
    chains shrink by powers. Labels are written to the shared folder each round; a star's centre is
    pre-aggregated before the shuffle. No links give no rows.
    """
    edges = written(_both_ways(links))
    labels = written(_first_labels(edges))
    while True:
        closer = labels.join(_near_labels(edges, labels), "node").select("node", "root", F.least("root", "near").alias("near"))
        jump = closer.select(F.col("node").alias("_n"), F.col("near").alias("_far"))
        after = written(closer.join(jump, closer["near"] == jump["_n"]).select("node", F.col("root").alias("was"), F.least("near", "_far").alias("root")))
        moved = not after.where("root <> was").isEmpty()
        labels = after.select("node", "root")
        if not moved:
            return labels
