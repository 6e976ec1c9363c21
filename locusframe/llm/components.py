"""Connected components by alternating large-star and small-star steps (union-find for a cluster)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusframe.llm.scratch import Scratch


#: A key of 1 / HOT_SHARE of the rows, and HOT_LEAST rows, or more is hot: there are HOT_SHARE such keys at most.
HOT_SHARE, HOT_LEAST = 1000, 200


def with_value(rows: DataFrame, key: str, found: DataFrame, times: str | None = None) -> DataFrame:
    """rows with the columns of ``found``, which has one row a key, or nulls; times is a column of it with the rows of
    each key, if there is one (keys it lacks are no hot ones then).

    The values of hot keys, a bounded number, are broadcast, so the rows of such a key stay where they are; no other
    key can fill a task of the join.
    """
    spark = rows.sparkSession
    by = found.select(key, F.col(times).alias("count")) if times else rows.groupBy(key).count()
    total = by.agg(F.sum("count")).first()[0] or 0
    hot = by.where(F.col("count") > max(total // HOT_SHARE, HOT_LEAST)).drop("count").collect()
    if not hot:
        return rows.join(found, key, "left")
    known = F.broadcast(spark.createDataFrame(hot, rows.select(key).schema)).join(found, key, "left").withColumn("hot", F.lit(True))
    known = spark.createDataFrame(known.collect(), known.schema)
    tagged = rows.join(F.broadcast(known), key, "left")
    cold = tagged.where("hot is null").select(*rows.columns).join(found, key, "left")
    return tagged.where("hot").drop("hot").unionByName(cold)


#: Nodes whose links a task unites at a time; a bound of its memory only.
LOCAL_NODES = 1 << 18


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the links of one task: each node but the least of its component here, with that least one."""
    parent: dict = {}
    schema = None

    def root(x):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    def stars():
        pairs = [(x, r) for x in parent if (r := root(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], schema.field(i).type) for i in (0, 1)], schema=schema)

    for batch in batches:
        schema = batch.schema
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) >= LOCAL_NODES:
            yield from stars()
            parent.clear()
    if parent:
        yield from stars()


def connected(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """(node, root) of every node in ``edges(a, b)``; root is the least node of the component.

    Each step gives every link the least neighbour of one of its ends: a combined aggregation and a join in which the
    links of a hub are not gathered (``with_value``); edges only move towards smaller nodes and their number does not
    grow.  Before each step every task unites the links that it reads anyway (``_unite``), which saves steps and sends
    nothing.  The table of links is cut to shared storage after each step.  Loops and repeated links are allowed; null
    ends are dropped.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = _united(edges, scratch, label)
    while not _stars(now):
        # large star: the larger neighbours of a node b go to the least neighbour of b, which is b or an a of it
        least = now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m"))
        large = scratch.cut(with_value(now, "b", least).select("a", F.coalesce("m", "b").alias("b")).distinct(), label)
        # small star: the smaller neighbours of a go to the least of them
        small = with_value(large, "a", large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("times")), "times")
        small = small.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = _united(small.select("e.a", "e.b").where("a <> b").distinct(), scratch, label)
        scratch.drop(now)
        scratch.drop(large)
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _united(edges: DataFrame, scratch: Scratch, label: str) -> DataFrame:
    """edges(a, b) cut to shared storage, the links of each task that reads them united, and cut again."""
    whole = scratch.cut(edges, label)
    out = scratch.cut(whole.mapInArrow(_unite, whole.schema), label)
    scratch.drop(whole)
    return out


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one link to its root and no root has a link itself: one combined aggregation."""
    ends = edges.select(F.col("a").alias("n"), F.lit(1).alias("links"), F.lit(0).alias("root")).unionByName(edges.select(F.col("b").alias("n"), F.lit(0).alias("links"), F.lit(1).alias("root")))
    node = ends.groupBy("n").agg(F.sum("links").alias("links"), F.max("root").alias("root"))
    return node.where("links > 1 or (links = 1 and root = 1)").limit(1).isEmpty()
