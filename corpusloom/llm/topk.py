"""Exact top-k search over vectors by columnar branch-and-bound."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, pick, save_arrays

#: Vectors per stored block.
BLOCK = 8192
#: Every row whose id is divisible by this is a query.
EVERY = 50
#: Queries of one task: at least and at most.
QUERIES = 64, 2048
#: Queries that share one accumulation, and dimensions added between two prunings.
GROUP, STEP = 64, 16


def _slack(worst: float) -> float:
    """A squared distance up to which a candidate can still equal worst once both are rounded to nine decimals."""
    return worst + 1e-8 * (1 + worst)


class Nearest:
    """The k nearest columns of each query so far; blocks are added one after another, and what is known prunes the next.

    Within a block distances grow dimension block by block over its vertical layout. After each, a candidate's squared
    distance lies between partial + (|q'| - |x'|)^2 and partial + (|q'| + |x'|)^2, with q' and x' the dimensions still to come;
    candidates whose lower bound exceeds the k-th smallest upper bound, or the k-th distance of the blocks before, are dropped
    and the survivors compacted.
    """

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int, step: int = STEP):
        self.q, self.ids, self.k, self.step = queries, ids, k, step
        self.rest = np.sqrt(np.maximum(np.cumsum((queries**2)[:, ::-1], axis=1)[:, ::-1], 0))
        self.distance, self.neighbor = [np.zeros(0)] * len(queries), [np.zeros(0, np.int64)] * len(queries)
        self.bound = np.full(len(queries), np.inf)

    def add(self, columns: np.ndarray, ids: np.ndarray, rest: np.ndarray) -> None:
        """columns (d, n): one row per dimension; ids of the n vectors, sorted; rest (d, n): norms over dimensions i and on."""
        d, n = columns.shape
        own = np.searchsorted(ids, self.ids)
        own[(own == n) | (ids[np.minimum(own, n - 1)] != self.ids)] = -1
        for lo in range(0, len(self.q), GROUP):
            q = self.q[lo : lo + GROUP]
            # the first block of dimensions for the group at once, then each query on its own survivors
            first = columns[: self.step]
            part = (q[:, : self.step] ** 2).sum(1)[:, None] + (first**2).sum(0)[None, :] - 2 * (q[:, : self.step] @ first)
            for i in range(len(q)):
                self._one(lo + i, np.maximum(part[i], 0), columns, ids, rest, int(own[lo + i]))

    def _one(self, i: int, acc: np.ndarray, columns: np.ndarray, ids: np.ndarray, rest: np.ndarray, own: int) -> None:
        d, k, q, at = len(columns), self.k, self.q[i], min(self.step, len(columns))
        alive = np.arange(len(ids))
        if own >= 0:
            alive = np.delete(alive, own)
            acc = acc[alive]
        while at < d and len(alive):
            rq, rx = self.rest[i, at], rest[at][alive]
            worst = self.bound[i]
            if len(acc) > k:
                worst = min(worst, np.partition(acc + (rq + rx) ** 2, k - 1)[k - 1])
            if worst < np.inf:
                keep = np.flatnonzero(acc + (rq - rx) ** 2 <= _slack(worst))
                acc, alive = acc[keep], alive[keep]
            upto = min(d, at + self.step)
            acc = acc + ((columns[at:upto][:, alive] - q[at:upto, None]) ** 2).sum(0)
            at = upto
        # exact distances of the survivors, added in one order so that equal vectors tie
        exact = ((columns[:, alive] - q[:, None]) ** 2).sum(0)
        near = np.concatenate([self.distance[i], np.sqrt(exact).round(9)])
        who = np.concatenate([self.neighbor[i], ids[alive]])
        best = np.lexsort((who, near))[:k]
        self.distance[i], self.neighbor[i] = near[best], who[best]
        if len(best) == k:
            self.bound[i] = near[best[-1]] ** 2


def exact_top_k(vectors: DataFrame, k: int = 10, every: int = EVERY, block: int = BLOCK) -> DataFrame:
    """The k nearest other vectors by L2 distance, among all rows, of each row whose id is divisible by every: (vec_id, neighbor_id, rank, distance).

    Rank 1 is the nearest; equal distances (to nine decimals) go by neighbor_id; distance has six decimals. A row is not its own
    neighbour, but another row with the same values is, at distance 0. Vectors are compared with those of their own length.

    Defined results: rows whose vector is null, empty or holds a null or a value that is not finite are left out, as queries
    and as neighbours; so are rows with a null vec_id. Rows with the same vec_id count as one vector, that with the least values.
    With fewer than k others, all are returned. An empty table gives an empty result.

    At scale: vectors are shuffled once, into blocks that are stored column by column in the shared folder. A task holds some
    queries and walks all blocks of their length as mapped files, one in memory at a time, each pruned by the k-th distances of those before; its
    queries are then done, so candidates are never shuffled and nothing is broadcast. Exact search is work in proportion to
    queries times vectors; the bounds cut dimensions, not pairs.
    """
    spark = vectors.sparkSession
    rows = pick(vectors, "vec_id", "embedding").where("vec_id is not null and size(embedding) > 0").select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    scratch = Scratch(spark, "topk")
    rows = scratch.table(rows, "vectors")
    n_of = {r["d"]: (r["n"], r["q"] or 0) for r in rows.groupBy("d").agg(F.count("*").alias("n"), F.sum((F.col("vec_id") % every == 0).cast("bigint")).alias("q")).collect()}
    folder = f"{scratch.path}/blocks"

    def by_length(f) -> F.Column:
        made = F.lit(1)
        for d, (n, q) in n_of.items():
            made = F.when(F.col("d") == d, f(n, q)).otherwise(made)
        return made

    def store(key, table):
        d = key[0].as_py()
        x, ids = table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d), table["vec_id"].to_numpy()
        order = np.argsort(ids)
        columns = np.ascontiguousarray(x[order].T)
        rest = np.sqrt(np.maximum(np.cumsum((columns**2)[::-1], axis=0)[::-1], 0))[::STEP]
        return pa.table({"d": pa.array([d], pa.int32()), "file": [save_arrays(folder, {"columns": columns, "ids": ids[order], "rest": rest})]})

    placed = rows.withColumn("block", F.pmod(F.xxhash64("vec_id"), by_length(lambda n, _: -(-n // block))))
    files: dict[int, list[str]] = {}
    for r in placed.groupBy("d", "block").applyInArrow(store, "d int, file string").collect():  # one row per block
        files.setdefault(r["d"], []).append(r["file"])

    def search(key, table):
        d = key[0].as_py()
        ids = table["vec_id"].to_numpy()
        found = Nearest(table["v"].combine_chunks().flatten().to_numpy().reshape(-1, d), ids, k)
        for f in files[d]:
            rest = np.load(f"{folder}/{f}.rest.npy", mmap_mode="r")
            found.add(np.load(f"{folder}/{f}.columns.npy", mmap_mode="r"), np.load(f"{folder}/{f}.ids.npy"), _Every(rest))
        n = np.array([len(x) for x in found.distance])
        rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
        return pa.table({"vec_id": pa.array(np.repeat(ids, n), pa.int64()), "neighbor_id": pa.array(np.concatenate(found.neighbor), pa.int64()), "rank": pa.array(rank.astype(np.int32)), "distance": pa.array(np.concatenate(found.distance).round(6))})

    cores = spark.sparkContext.defaultParallelism
    parts_of = lambda q: max(1, -(-q // min(QUERIES[1], max(QUERIES[0], -(-q // (4 * cores))))))
    per = by_length(lambda _, q: parts_of(q))
    # as many tasks as parts: a part is little to send but much to search
    tasks = sum(parts_of(q) for _, q in n_of.values())
    asked = rows.where(F.col("vec_id") % every == 0).withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(1)), per)).repartition(max(1, tasks), "d", "part")
    out = scratch.table(asked.groupBy("d", "part").applyInArrow(search, "vec_id bigint, neighbor_id bigint, rank int, distance double"), "found")
    for done in ("blocks", "vectors"):
        scratch.drop(done)
    return out


class _Every:
    """Norms of the rest at each STEP dimensions, asked for by dimension."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def __getitem__(self, at: int) -> np.ndarray:
        return self.rows[at // STEP]
