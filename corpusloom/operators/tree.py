"""Trees of summaries over documents: greedy grouping by similarity, or k-means, level by level."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import settled
from .nearest import Vectors, dots, nearest, stored

#: Levels of at most so many free rows are grouped on the driver.
LOCAL = 4096
#: Rows whose nearest are looked up in one round, and how many nearest each gets for each member of a group.
HEAD, NEAREST = 20_000, 16


def greedy_groups(vectors: np.ndarray, size: int) -> list[int]:
    """Group of each row: the first free row takes the size - 1 most similar free ones, of equal ones the first."""
    group, n = np.full(len(vectors), -1), 0
    at, left = np.arange(len(vectors)), vectors  # rows that were free when they were last gathered
    for i in range(len(vectors)):
        if group[i] >= 0:
            continue
        group[i] = n
        free = group[at] < 0
        most = min(size - 1, int(free.sum()))
        if most > 0:
            sims = np.where(free, dots(left, vectors[i]), -np.inf)
            least = np.partition(sims, len(sims) - most)[len(sims) - most]
            above = np.flatnonzero(free & (sims > least))
            group[at[[*above, *np.flatnonzero(free & (sims == least))[: most - len(above)]]]] = n
        if 2 * free.sum() < len(at):
            at = at[group[at] < 0]
            left = vectors[at]
        n += 1
    return group.tolist()


def groups_by_rounds(v: Vectors, size: int, look_up: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]) -> np.ndarray:
    """greedy_groups without all products at hand. look_up(queries, k, bits): the k nearest free rows of each query.

    A round looks up the nearest of the next HEAD free rows, equal vectors once. A list stays right while rows are taken: what it holds comes
    before all that it doesn't hold. So rows are grouped in their order until one's list runs out; that one and others whose lists are
    short are looked up again. The last LOCAL free rows are grouped directly.
    """
    n, most = v.rows, size - 1
    free, group = np.ones(n, bool), np.full(n, -1, np.int32)
    flag = memoryview(free.view(np.uint8))
    lists: dict[int, list] = {}  # row: [nearest, place of the first that may be free, whether it holds all free rows]
    at = done = 0
    left = n
    while left > LOCAL:
        ahead = at + np.flatnonzero(free[at:])[: min(HEAD, max(1024, left // 6))]
        need, short = [], {}  # equal rows share a list, which is judged once
        for r in ahead.tolist():
            known = lists.get(r)
            if known is not None and id(known) not in short:
                short[id(known)] = not known[2] and sum(flag[c] for c in known[0][known[1] :]) < 2 * size
            if known is None or short[id(known)]:
                need.append(r)
        if need:
            need = np.array(need)
            q, same = np.unique(v.take(need).view(np.dtype((np.void, v.width * v.kind.itemsize))).ravel(), return_inverse=True)
            k = np.minimum(size * (NEAREST + np.bincount(same)), left)
            found = look_up(q.view(v.kind).reshape(len(q), v.width), k, np.packbits(free))
            own = [[c.tolist(), 0, len(c) == left] for c in found]
            lists.update(zip(need.tolist(), (own[g] for g in same.tolist()), strict=True))
        for r in ahead.tolist():
            if not flag[r]:
                lists.pop(r, None)
                continue
            near = lists[r]
            c, i = near[0], near[1]
            flag[r] = 0
            while i < len(c) and not flag[c[i]]:
                i += 1
            near[1], taken, want = i, [], min(most, left - 1)
            while i < len(c) and len(taken) < want:
                if flag[c[i]]:
                    taken.append(c[i])
                i += 1
            if len(taken) < want:
                flag[r] = 1
                at = r
                break
            group[r] = done
            for x in taken:
                flag[x] = 0
                group[x] = done
            left -= 1 + len(taken)
            done += 1
            del lists[r]
            at = r + 1
            if left <= LOCAL:
                break
    rest = np.flatnonzero(free)
    if len(rest):
        group[rest] = np.array(greedy_groups(v.take(rest), size)) + done
    return group


def _spread(spark: SparkSession, v: Vectors) -> Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]]:
    """nearest over tasks: each has some of the queries and reads all free vectors."""
    tasks = 2 * max(1, spark.sparkContext.defaultParallelism)

    def look_up(q: np.ndarray, k: np.ndarray, bits: np.ndarray) -> list[np.ndarray]:
        name = f"{v.folder}/round-{uuid.uuid4().hex}"
        order = np.argsort(k, kind="stable")  # queries with long lists together
        np.savez(name, q=q[order], k=k[order], bits=bits)
        edges = [0]
        share = max(1, -(-len(q) // tasks))
        total = np.cumsum(k[order])
        while edges[-1] < len(q):
            a = edges[-1]
            long = int(np.searchsorted(total, (total[a - 1] if a else 0) + 1_000_000, side="right"))
            edges.append(max(a + 1, min(a + share, a + 1024, long, len(q))))

        def run(batches):
            for b in batches:
                for i in b["id"].to_pylist():
                    with np.load(f"{name}.npz") as z:
                        lo, hi = edges[i], edges[i + 1]
                        found, _ = nearest(v, z["q"][lo:hi], z["k"][lo:hi], z["bits"])
                    yield pa.RecordBatch.from_pydict({"i": pa.array(range(lo, hi), pa.int32()), "near": pa.array([c.astype(np.int32).tobytes() for c in found], pa.binary())})

        n = len(edges) - 1
        out: list = [None] * len(q)
        for r in spark.range(0, n, 1, n).mapInArrow(run, "i int, near binary").collect():
            out[order[r.i]] = np.frombuffer(r.near, np.int32)
        os.remove(f"{name}.npz")
        return out

    return look_up


def _grouped(level: DataFrame, size: int) -> DataFrame:
    """A level (row, node_id, vector, ...) with g, the group of each row, and pos, its place by node_id."""
    spark = level.sparkSession
    v = stored(level, ["node_id", "row"], "row")
    rows = v.ids(np.arange(v.rows)).to_numpy()
    group = groups_by_rounds(v, size, _spread(spark, v))
    counts = {r.part: r.n for r in level.groupBy(F.shiftright("row", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    first = np.zeros(max(counts) + 2, np.int64)
    np.cumsum([counts.get(p, 0) for p in range(max(counts) + 1)], out=first[1:])
    index = first[rows >> 33] + (rows & ((1 << 33) - 1))
    table = np.empty((len(rows), 2), np.int32)
    table[index, 0], table[index, 1] = group, np.arange(len(rows))
    path = f"{v.folder}/groups.npy"
    np.save(path, table)

    def look(batches):
        t = np.load(path, mmap_mode="r")
        for b in batches:
            row = b["row"].to_numpy()
            g = t[first[row >> 33] + (row & ((1 << 33) - 1))]
            yield b.append_column("g", pa.array(g[:, 0])).append_column("pos", pa.array(g[:, 1]))

    slim = level.select("row", "level", "node_id", "content")
    return slim.mapInArrow(look, "row bigint, level int, node_id string, content string, g int, pos int")


def summary_tree(nodes: DataFrame, summarise: Callable[[list[str]], str], embed: Callable[[str], np.ndarray], size: int = 4, levels: int = 2) -> DataFrame:
    """(node_id, level, content, vector, child_ids): the nodes (doc_id STRING, content, vector) at level 0 and their summaries above.

    Stops when a level has one node. Groups are found over a whole level, by node_id. The greedy rule is sequential: the driver follows it over
    lists of nearest rows, which tasks find in rounds; neither holds the level's vectors. Groups are summarised independently.
    Each level is written to the shared folder, so that its vectors are made once.
    """
    last = nodes.select(F.col("doc_id").cast("string").alias("node_id"), F.lit(0).alias("level"), "content", F.col("vector").cast("array<double>").alias("vector"), F.array().cast("array<string>").alias("child_ids"))
    out = []

    def build(batches):
        made: list[tuple] = []

        def summary(g: int, level: int, ids: list[str], texts: list[str]) -> None:
            text = summarise(texts)
            made.append((f"L{level + 1}-{g}", level + 1, text, np.asarray(embed(text), float).tolist(), ids))

        def batch() -> pa.RecordBatch:
            cols = [list(c) for c in zip(*made, strict=True)]
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["node_id", "level", "content", "vector", "child_ids"])

        kinds = [pa.string(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.string())]
        now, ids, texts = None, [], []
        for b in batches:
            for g, level, i, t in zip(*(b[c].to_pylist() for c in ("g", "level", "node_id", "content")), strict=True):
                if now != (g, level):
                    if now is not None:
                        summary(*now, ids, texts)
                    now, ids, texts = (g, level), [], []
                ids.append(i)
                texts.append(t)
            if made:
                yield batch()
        if now is not None:
            summary(*now, ids, texts)
            yield batch()

    for k in range(levels + 1):
        last = settled(last.withColumn("row", F.monotonically_increasing_id()), f"tree-{k}")
        out.append(last.drop("row"))
        if k == levels or last.count() <= 1:
            break
        parts = _grouped(last, size).repartition("g").sortWithinPartitions("g", "pos").select("g", "level", "node_id", "content")
        last = parts.mapInArrow(build, "node_id string, level int, content string, vector array<double>, child_ids array<string>")
    return reduce(DataFrame.unionByName, out)


def cluster_level(nodes: DataFrame, branching: int = 4, least: int = 2, seed: int = 42) -> DataFrame:
    """nodes with cluster_id by k-means, k = min(branching, max(2, n // least))."""
    n = nodes.count()
    k = min(branching, max(2, n // least))
    if n <= k:
        return nodes.withColumn("cluster_id", F.lit(0))
    v = nodes.withColumn("__features", array_to_vector(F.col("vector").cast("array<double>")))
    model = KMeans(k=k, seed=seed, featuresCol="__features", predictionCol="cluster_id").fit(v)
    return model.transform(v).drop("__features")


def level_counts(tree: DataFrame) -> DataFrame:
    return tree.groupBy("level").agg(F.count("*").alias("n"))
