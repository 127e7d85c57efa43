"""Connected components of a link table, as Spark jobs.

Each round shortens all paths by large-star and small-star steps; rounds end when the links no
longer change. Before the first round every task reduces its own links to a spanning forest, so hot
groups of links shrink before anything is shuffled by node.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.scratch import saved


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) for the nodes that aren't the least themselves."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = ends[:len(a)], ends[len(a):]
    root = np.arange(len(nodes))
    while len(left):
        low, high = np.minimum(root[left], root[right]), np.maximum(root[left], root[right])
        differ = low != high
        left, right, low, high = left[differ], right[differ], low[differ], high[differ]
        np.minimum.at(root, high, low)
        while True:
            above = root[root]
            if (above == root).all():
                break
            root = above
    child = root != np.arange(len(nodes))
    return nodes[child], nodes[root[child]]


def _forests(batches):
    a, b, held = [], [], 0

    def out():
        node, root = forest(np.concatenate(a), np.concatenate(b))
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], ["a", "b"])

    for batch in batches:
        a.append(batch.column("a").to_numpy())
        b.append(batch.column("b").to_numpy())
        held += batch.num_rows
        if held > 2_000_000:
            less = out()
            a, b, held = [less.column("a").to_numpy()], [less.column("b").to_numpy()], 0
            if less.num_rows > 1_000_000:
                yield less
                a, b = [], []
    if a:
        yield out()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b: long); the root is the least node reachable.

    Null ends and links of a node with itself are ignored; repeated links are harmless; without any
    link the result is empty.
    """
    links = links.where("a <> b").mapInArrow(_forests, "a long, b long")
    now = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("at"), F.least("u", "m").alias("m"))
        large = (both.join(least, F.col("u") == F.col("at")).where("v > u")
                 .select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        large = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "at")
        small = (large.join(least, F.col("a") == F.col("at"))
                 .select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.a", "e.b").where("a <> b").distinct())
        now = saved(small, "links")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.countDistinct("a")).first()
        if tuple(state) == seen or state[0] == 0:
            break
        seen = tuple(state)
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
