"""Connected components of links, by least labels and pointer jumping over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm.shared import keep

#: A key with more than a HOT-th of all rows is looked up by broadcast; there are fewer than HOT such keys.
HOT = 1000


def hot_keys(rows: DataFrame, key: str, number: int) -> list:
    """The keys, fewer than HOT, that hold more than a HOT-th of the rows, of which there are so many at most (and more than a few)."""
    least = max(32, number // HOT)
    return [r[0] for r in rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least).select(key).collect()]


def looked_up(rows: DataFrame, key: str, table: DataFrame, hot: list) -> DataFrame:
    """rows with the other columns of table (one row a key), without the rows whose key it lacks; the rows of hot keys stay where they are."""
    names = [*rows.columns, *(c for c in table.columns if c != key)]
    if not hot:
        return rows.join(table, key).select(*names)
    is_hot = F.col(key).isin(hot)
    near = rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key).select(*names)
    return near.unionByName(rows.where(~is_hot).join(table, key).select(*names))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """For each node of a link: node, label (the least node that links reach). Counts and fewer than HOT keys come to the driver.

    A link of a node with itself names the node; null ends are no nodes; repeated links count once.
    """
    rows = 2 * links.count()
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    edges = keep(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges", rows)
    hubs = hot_keys(edges, "u", rows)
    labels = keep(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("v", "node").alias("label")), "labels", rows)
    while True:
        near = looked_up(edges, "u", labels.withColumnRenamed("node", "u"), hubs).groupBy(F.col("v").alias("node")).agg(F.min("label").alias("near"))
        step = keep(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")), "steps", rows)
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = keep(looked_up(step, "label", jump, hot_keys(step, "label", rows)).select("node", "old", F.least("label", "far").alias("label")), "labels", rows)
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")
