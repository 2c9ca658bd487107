"""Exact search among vectors that lie in files of the shared folder: tasks read them by pieces, none of them is shuffled."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import shared_path

#: Rows of vectors that a task multiplies at once.
TILE = 4096


def dots(x: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Row-wise products in double precision; equal rows give equal bits, wherever they are."""
    return (x.astype(np.float64, copy=False) * v.astype(np.float64, copy=False)).sum(1)


class Vectors:
    """Vectors of a level in the order of its rows, in files of the shared folder, read by pieces."""

    def __init__(self, folder: str, files: list[tuple[str, int]], single: bool, width: int, norm: float):
        self.folder, self.files, self.kind, self.width, self.norm = folder, files, np.dtype("f4" if single else "f8"), width, norm
        self.end = ".single" if single else ""
        self.rows = sum(n for _, n in files)

    def pieces(self, rows: int) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, vectors) of all rows, one piece after another."""
        first = 0
        for name, n in self.files:
            with open(f"{self.folder}/{name}{self.end}", "rb") as f:
                for at in range(0, n, rows):
                    m = min(rows, n - at)
                    yield first + at, np.fromfile(f, self.kind, m * self.width).reshape(m, self.width)
            first += n

    def take(self, rows: np.ndarray) -> np.ndarray:
        """The vectors of some rows, which are in ascending order."""
        out, done = np.empty((len(rows), self.width), self.kind), 0
        first = 0
        for name, n in self.files:
            hi = int(np.searchsorted(rows, first + n))
            if hi > done:
                with open(f"{self.folder}/{name}{self.end}", "rb") as f:
                    for lo in range(0, n, 8 * TILE):
                        to = int(np.searchsorted(rows, first + min(lo + 8 * TILE, n)))
                        if to > done:
                            f.seek(lo * self.width * self.kind.itemsize)
                            x = np.fromfile(f, self.kind, min(8 * TILE, n - lo) * self.width).reshape(-1, self.width)
                            out[done:to] = x[rows[done:to] - first - lo]
                            done = to
            first += n
        return out

    def ids(self, rows: np.ndarray) -> pa.Array:
        """The ids of some rows, which are in ascending order."""
        out, first = [], 0
        for name, n in self.files:
            some = rows[np.searchsorted(rows, first) : np.searchsorted(rows, first + n)] - first
            if len(some):
                with pa.ipc.open_file(f"{self.folder}/{name}.ids") as f:
                    out += f.read_all()["id"].take(pa.array(some)).chunks
            first += n
        return pa.concat_arrays(out)

    def free(self, bits: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, vectors in single precision) of the rows whose bit is set, about TILE at once."""
        held, m = [], 0
        for first, x in self.pieces(8 * TILE):
            at = np.flatnonzero(np.unpackbits(bits[first // 8 : (first + len(x)) // 8 + 1])[first % 8 : first % 8 + len(x)])
            for lo in range(0, len(at), TILE):
                some = at[lo : lo + TILE]
                held.append((some + first, x[some].astype(np.float32, copy=False)))
                m += len(some)
                if m >= TILE:
                    yield tuple(np.concatenate(p) for p in zip(*held, strict=True))
                    held, m = [], 0
        if held:
            yield tuple(np.concatenate(p) for p in zip(*held, strict=True))


def _ranked(i: np.ndarray, p: np.ndarray, s: np.ndarray, k: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, place): candidates (query, row, similarity) by query and falling similarity, and the place of each in its query."""
    order = np.lexsort((p, -s, i) if ties else (-s, i))
    head = np.searchsorted(i[order], np.arange(len(k)))
    return order, np.arange(len(order)) - head[i[order]]


def nearest(v: Vectors, q: np.ndarray, k: np.ndarray, bits: np.ndarray, digits: int | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each query its k[.] nearest free rows and their similarities, rounded to digits; ties by row.

    Products in single precision choose candidates, with room for their error; double precision ranks them.
    """
    q32, most = q.astype(np.float32), int(k.max())
    room = (2 * (v.width + 2) * 2.0**-24 * v.norm * np.linalg.norm(q.astype(np.float64), axis=1) + (1e-30 if digits is None else 2.0 * 10.0**-digits)).astype(np.float32)
    least = np.full(len(q), -np.inf, np.float32)
    held: list[tuple[np.ndarray, ...]] = []
    pending = 0

    def shrink():
        nonlocal held, pending
        i, p, s = (np.concatenate(x) for x in zip(*held, strict=True))
        order, place = _ranked(i, p, s, k, False)
        i, p, s = i[order], p[order], s[order]
        last = place == k[i] - 1
        least[i[last]] = np.maximum(least[i[last]], s[last] - room[i[last]])
        use = s >= least[i]
        held, pending = [(i[use], p[use], s[use])], int(use.sum())

    wide = max(2_000_000, 4 * int(k.sum()))
    for p, x in v.free(bits):
        s = q32 @ x.T
        if np.isneginf(least[0]) and not held and len(p) > most:
            least = np.partition(s, len(p) - most, axis=1)[:, len(p) - most] - room
        i, j = np.divmod(np.flatnonzero(s >= least[:, None]), len(p))
        held.append((i.astype(np.int32), p[j].astype(np.int32), s[i, j]))
        pending += len(i)
        if pending > wide:
            shrink()
    if not held:
        return [np.empty(0, np.int32)] * len(q), [np.empty(0)] * len(q)
    shrink()
    i, p, _ = held[0]
    rows, where = np.unique(p, return_inverse=True)
    x = v.take(rows)
    exact = np.concatenate([dots(x[where[a : a + 20_000]], q[i[a : a + 20_000]]) for a in range(0, len(i), 20_000)]) if len(i) else np.empty(0)
    if digits is not None:
        exact = np.round(exact, digits)
    order, place = _ranked(i, p, exact, k, True)
    order = order[place < k[i[order]]]
    cuts = np.searchsorted(i[order], np.arange(1, len(q)))
    return np.split(p[order], cuts), np.split(exact[order], cuts)


def stored(rows: DataFrame, order: list[str], id_col: str) -> Vectors:
    """The vectors of rows (id_col, vector, ...) by order as files of the shared folder, with their ids as Arrow data."""
    folder = f"{shared_path(rows.sparkSession)}/vectors-{uuid.uuid4().hex[:12]}"

    def write(batches):
        os.makedirs(folder, exist_ok=True)
        name, n, width, norm, single, ids = uuid.uuid4().hex, 0, 0, 0.0, True, None
        with open(f"{folder}/{name}", "wb") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(b.num_rows, -1)
                n, width, norm = n + len(x), x.shape[1], max(norm, float(np.linalg.norm(x, axis=1).max()))
                single = single and bool((x.astype(np.float32) == x).all())
                x.tofile(f)
                ids = ids or pa.ipc.new_file(f"{folder}/{name}.ids", pa.schema([("id", b["id"].type)]))
                ids.write_batch(pa.RecordBatch.from_arrays([b["id"]], ["id"]))
        if ids:
            ids.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "name": [name], "n": [n], "width": [width], "norm": [norm], "single": [single]})

    def narrow(batches):
        for b in batches:
            for name in b["name"].to_pylist():
                np.fromfile(f"{folder}/{name}", np.float64).astype(np.float32).tofile(f"{folder}/{name}.single")
            yield b

    made = rows.orderBy(*order).select(F.col(id_col).alias("id"), "vector").mapInArrow(write, "part int, name string, n bigint, width bigint, norm double, single boolean").collect()
    made = sorted((r for r in made if r.n), key=lambda r: r.part)
    if len({r.width for r in made}) > 1:
        raise ValueError("vectors must be of one length")
    single = bool(made) and all(r.single for r in made)  # then nothing is lost in single precision
    if single:
        names = rows.sparkSession.createDataFrame(pa.table({"name": [r.name for r in made]}))
        names.repartition(len(made)).mapInArrow(narrow, "name string").collect()
        for r in made:
            os.remove(f"{folder}/{r.name}")
    return Vectors(folder, [(r.name, r.n) for r in made], single, made[0].width if made else 0, max((r.norm for r in made), default=0.0))
