"""Best-fit decreasing packing of documents into fixed-length training sequences."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pick

#: Pieces packed together; a shard's waste is about one bin, so a few hundred thousand pieces make it negligible.
SHARD_PIECES = 250_000
#: Copies of one row that are written out at once.
COPIES = 4096


class TightestFit:
    """Open bins by remaining capacity, with a segment tree over the capacities 0..size.

    A leaf counts the open bins with exactly that much room, a node the bins below it; the tightest bin with
    room for n is the leftmost non-empty leaf at or right of n, found by one climb and one descent.
    """

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[deque[int]] = [deque() for _ in range(size + 1)]

    def add(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        if len(self.bins[room]) == 1:
            self._mark(room, 1)

    def _mark(self, room: int, by: int) -> None:
        i, count = room + self.leaves, self.count
        while i:
            count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, bin) of the tightest open bin with room for need, which is taken out; of equals the one opened to this room first."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i <<= 1
                if not count[i]:
                    i += 1
        room = i - self.leaves
        bin_no = self.bins[room].popleft()
        if not self.bins[room]:
            self._mark(room, -1)
        return room, bin_no


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; lengths must already fall, and lie in 1..capacity."""
    tree = TightestFit(capacity)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int32)
    opened = 0
    for k, n in enumerate(lengths.tolist()):
        if n == capacity:
            bins[k], offsets[k] = opened, 0
            opened += 1
            continue
        got = tree.take(n)
        if got is None:
            room, b = capacity, opened
            opened += 1
        else:
            room, b = got
        bins[k], offsets[k] = b, capacity - room
        if room > n:
            tree.add(room - n, b)
    return bins, offsets


def pack_documents(docs: DataFrame, capacity: int = 2048, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Packs whole documents into sequences of at most capacity tokens (whitespace-separated words).

    Result, one row per sequence: (bin_id STRING, used INT, doc_ids ARRAY<BIGINT>, starts ARRAY<BIGINT>,
    lengths ARRAY<INT>); piece i of a sequence is tokens starts[i] .. starts[i]+lengths[i]-1 of doc_ids[i], and
    pieces are laid out in that order. A document longer than capacity is cut into full sequences and a rest;
    every other document stays in one piece. Pieces are packed by best-fit decreasing: longest first, each into
    the open sequence that leaves the least room.

    Defined results: null, empty and blank texts have no tokens and are in no sequence. Pieces of equal length go
    by doc_id (null first), then by start; repeated rows are packed once each, and bin_id is unique all the same. An empty table
    gives an empty result.

    At scale: rows are counted by id and length first, with map-side combine; full sequences need no packing and never leave the
    JVM's explode; rests are spread by a hash, and repeats of one row evenly, over
    shards of about shard_pieces rows, each packed on its own, so the number of tasks grows with the corpus and a
    task's memory does not. Only (doc_id, start, length) is shuffled, never text.
    """
    word = F.filter(F.split(F.coalesce(F.col("text"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), lambda x: x != "")
    sized = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size(word).alias("n"))
    # rows with the same id and length are interchangeable: one row with their number
    sized = sized.where("n > 0").groupBy("doc_id", "n").agg(F.count("*").alias("c")).withColumn("full", F.floor(F.col("n") / capacity).cast("int")).withColumn("rest", F.col("n") % capacity)
    # copies in two steps, so that no array grows with them
    full = sized.where("full > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("c") - 1) / COPIES))))
    full = full.withColumn("copy", F.explode(F.sequence(F.col("block") * COPIES + 1, F.least("c", (F.col("block") + 1) * COPIES)))).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    full = full.select(
        F.concat_ws(".", F.concat(F.lit("f"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))), F.col("n").cast("string"), F.col("copy").cast("string"), F.col("k").cast("string")).alias("bin_id"),
        F.lit(capacity).alias("used"),
        F.array("doc_id").alias("doc_ids"),
        F.array((F.col("k") * capacity).cast("bigint")).alias("starts"),
        F.array(F.lit(capacity)).alias("lengths"),
    )
    rests = sized.where("rest > 0").select("doc_id", (F.col("full").cast("bigint") * capacity).alias("start"), F.col("rest").alias("length"), "c")
    count = pick(docs, "doc_id").count()
    shards = max(1, -(-count // shard_pieces))
    # repeats are dealt evenly to the shards, beginning at a place by hash
    home = F.xxhash64(F.coalesce("doc_id", F.lit(0)), "start", "length", F.lit(77))
    rests = rests.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least("c", F.lit(shards)) - 1)))
    rests = rests.withColumn("shard", F.pmod(home + F.col("turn"), F.lit(shards)).cast("int")).withColumn("c", F.floor((F.col("c") - F.col("turn") - 1) / shards) + 1)
    schema = "bin_id string, used int, doc_ids array<bigint>, starts array<bigint>, lengths array<int>"

    def pack(key, table):
        ids = table["doc_id"].to_pandas(integer_object_nulls=True)
        null = ids.isna().to_numpy()
        num = ids.fillna(0).to_numpy().astype(np.int64)
        times = table["c"].to_numpy()
        num, null, start, length = (np.repeat(x, times) for x in (num, null, table["start"].to_numpy(), table["length"].to_numpy()))
        order = np.lexsort((start, num, ~null, -length))
        bins, offsets = best_fit_decreasing(length[order], capacity)
        rank = np.lexsort((offsets, bins))
        order, bins = order[rank], bins[rank]
        heads = np.flatnonzero(np.concatenate([[True], bins[1:] != bins[:-1]])) if len(bins) else np.zeros(0, np.int64)
        edges = pa.array(np.append(heads, len(bins)).astype(np.int32))
        used = np.add.reduceat(length[order], heads) if len(bins) else length
        made = lambda values, kind: pa.ListArray.from_arrays(edges, pa.array(values, kind))
        return pa.table(
            {
                "bin_id": [f"s{key[0].as_py()}.{b}" for b in bins[heads]],
                "used": pa.array(used.astype(np.int32)),
                "doc_ids": pa.ListArray.from_arrays(edges, pa.array(num[order], pa.int64(), mask=null[order])),
                "starts": made(start[order], pa.int64()),
                "lengths": made(length[order].astype(np.int32), pa.int32()),
            }
        )

    return full.unionByName(rests.groupBy("shard").applyInArrow(pack, schema))
