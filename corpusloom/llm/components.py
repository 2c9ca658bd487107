"""Distributed union-find: connected components of an edge table by local forests and star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: (node, root) for each node, root being the least node of its tree."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        while parent[y] != y:
            parent[y] = parent[parent[y]]
            y = parent[y]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    root = np.array(parent, dtype=np.int64)
    while len(root) and (root[root] != root).any():
        root = root[root]
    return nodes, nodes[root] if len(nodes) else nodes


def _local(batches):
    got = [b for b in batches if b.num_rows]
    if got:
        t = pa.Table.from_batches(got)
        node, root = forest(t["a"].to_numpy(), t["b"].to_numpy())
        loose = node != root
        yield pa.RecordBatch.from_arrays([pa.array(node[loose]), pa.array(root[loose])], ["a", "b"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """edges: a, b BIGINT. Result: (node, root) for each node that has an edge to another; root is the least node of the component.

    Each partition first reduces its edges to a spanning forest by union-find (memory: the partition's nodes). Then large-star
    and small-star steps alternate until nothing changes, in a number of rounds logarithmic in the diameter. Each round is
    written to the shared folder, so the lineage stays short and a lost executor costs one round at most.
    """
    now = scratch.table(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).mapInArrow(_local, "a bigint, b bigint"), f"{name}0")
    last, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("near")).withColumn("m", F.least("a", "m"))
        large = least.select("m", "a", F.explode("near").alias("v")).where("v > a").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")
        # small star: every node's smaller neighbours and itself go to the least of them
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.collect_set("b").alias("near"))
        small = small.select("m", F.explode(F.array_union("near", F.array("a"))).alias("v")).where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        k += 1
        now = scratch.table(small, f"{name}{k}")
        scratch.drop(f"{name}{k - 1}")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h"), F.count_distinct("a").alias("d")).first()
        if tuple(seen) == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = tuple(seen)
