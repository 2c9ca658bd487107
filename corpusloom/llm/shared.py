"""The shared folder, written tables in it, and sorted hash arrays that workers map into memory.

The folder is the one in ``spark.checkpoint.dir``. It is read from the session; only a local session
without the setting gets a folder of its own (as in tests). Files get a fresh name per task attempt and
count only once the attempt's row is back, so retries and lost executors leave nothing half written in use.
"""

from __future__ import annotations

import json
import math
import mmap
import os
import shutil
import sys
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder as the session names it; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        at = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = at.get() if at.isDefined() else None
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(root)
    elif not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


class Scratch:
    """A folder of one operator's call inside the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.uri = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        at = urlparse(self.uri)
        if at.scheme not in ("", "file"):
            raise ValueError(f"memory-mapped arrays need spark.checkpoint.dir on a mounted file system, not {at.scheme}")
        self.path = at.path
        os.makedirs(self.path, exist_ok=True)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Writes df as Parquet here and reads it back: cuts the lineage at the size of a columnar file."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.uri}/{name}")
        return self.spark.read.parquet(f"{self.uri}/{name}")

    def drop(self, name: str = "") -> None:
        shutil.rmtree(os.path.join(self.path, name) if name else self.path, ignore_errors=True)


def shard_bits(entries: int, per_shard: int = 2_000_000) -> int:
    """Bits of the hash that name its shard, so that a shard holds about per_shard entries at any input size."""
    return max(0, int(np.ceil(np.log2(max(1, entries) / per_shard)))) if entries > per_shard else 0


def shard_of(key: np.ndarray, bits: int) -> np.ndarray:
    return (key >> U64(64 - bits)).astype(np.int32) if bits else np.zeros(len(key), np.int32)


def shard_column(key: str, bits: int):
    """shard_of as a Spark column over a BIGINT that holds the hash's bits."""
    return F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)


def save_arrays(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes arrays under a new name and returns it."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    for k, a in arrays.items():
        np.save(f"{folder}/{name}.{k}.npy", a)
    return name


def save_blobs(folder: str, blobs: list[bytes]) -> tuple[str, np.ndarray, np.ndarray]:
    """Writes blobs one after another into one file under a new name: (name, places, sizes)."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    with open(f"{folder}/{name}.blobs", "wb") as f:
        f.writelines(blobs)
    size = np.array([len(b) for b in blobs], np.int64)
    return name, np.cumsum(size) - size, size


def load_blobs(folder: str, table: pa.Table):
    """The bytes of each row (file, at, size) of a table, one after another, so that only one is held."""
    for name, at, size in zip(*(table[c].to_pylist() for c in ("file", "at", "size")), strict=True):
        with open(f"{folder}/{name}.blobs", "rb", buffering=0) as f:
            yield os.pread(f.fileno(), size, at)


def _map(f) -> mmap.mmap:
    """The bytes of a file, mapped until the last array over them is gone."""
    return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))


def mapped(path: str) -> np.ndarray:
    """A saved array, mapped; unlike np.load's, it keeps no file open, of which a process may have some thousands only."""
    with open(path, "rb") as f:
        major, _ = np.lib.format.read_magic(f)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if major == 1 else np.lib.format.read_array_header_2_0)(f)
        if not math.prod(shape):
            return np.zeros(shape, kind)
        return np.frombuffer(_map(f), kind, math.prod(shape), f.tell()).reshape(shape, order="F" if fortran else "C")


def save_packed(folder: str, arrays: dict[str, np.ndarray]) -> str:
    """Writes one-dimensional or wider arrays one after another into one file under a new name and returns it."""
    os.makedirs(folder, exist_ok=True)
    name = uuid.uuid4().hex
    at, kinds = 0, {}
    for k, a in arrays.items():
        kinds[k] = (a.dtype.str, a.shape, at)
        at += -(-a.nbytes // 8) * 8
    head = json.dumps(kinds).encode()
    head += b" " * (-len(head) % 8)
    with open(f"{folder}/{name}.packed", "wb") as f:
        f.write(np.int64(len(head)).tobytes() + head)
        for a in arrays.values():
            f.write(np.ascontiguousarray(a).tobytes() + bytes(-a.nbytes % 8))
    return name


def unpacked(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file of save_packed, by one map."""
    with open(path, "rb") as f:
        data = _map(f)
    n = 8 + int.from_bytes(data[:8], "little")
    return {k: np.frombuffer(data, kind, math.prod(shape), n + at).reshape(shape) for k, (kind, shape, at) in json.loads(data[8:n]).items()}


class Maps:
    """Mapped arrays by path, the latest OPEN of them; those not used for longest are let go."""

    OPEN = 20_000

    def __init__(self, load=None):
        self._open, self._load = OrderedDict(), load or mapped

    def __getstate__(self):
        return self._load

    def __setstate__(self, load):
        self.__init__(load)

    def get(self, path: str):
        a = self._open.pop(path, None)
        if a is None:
            a = self._load(path)
            if len(self._open) >= self.OPEN:
                self._open.popitem(last=False)
        self._open[path] = a
        return a


class HashTable:
    """Sorted 64-bit keys with value arrays, one set of files per shard, mapped on first use."""

    def __init__(self, folder: str, bits: int, files: dict[int, str], values: list[str]):
        self.folder, self.bits, self.files, self.values, self.maps = folder, bits, files, values, Maps()

    def shard(self, s: int) -> dict[str, np.ndarray] | None:
        name = self.files.get(s)
        return name and {k: self.maps.get(f"{self.folder}/{name}.{k}.npy") for k in ["key", *self.values]}

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(found, values): a mask over keys, and for each value an array aligned with keys (0 where not found)."""
        found = np.zeros(len(keys), dtype=bool)
        out: dict[str, np.ndarray] = {}
        if not len(keys) or not self.files:
            return found, {v: np.zeros(len(keys), np.int64) for v in self.values}
        order = np.argsort(keys)
        ordered = keys[order]
        edges = np.searchsorted(shard_of(ordered, self.bits), np.arange((1 << self.bits) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            part = self.shard(int(s))
            if part is None or not len(part["key"]):
                continue
            mine = ordered[edges[s] : edges[s + 1]]
            at = np.searchsorted(part["key"], mine)
            at[at == len(part["key"])] = 0
            hit = part["key"][at] == mine
            to = order[edges[s] : edges[s + 1]][hit]
            found[to] = True
            for v in self.values:
                if v not in out:
                    out[v] = np.zeros(len(keys), part[v].dtype)
                out[v][to] = part[v][at[hit]]
        return found, {v: out.get(v, np.zeros(len(keys), np.int64)) for v in self.values}


def build_table(df: DataFrame, scratch: Scratch, name: str, bits: int, values: list[str]) -> HashTable:
    """df: columns key (BIGINT, unique) and values (BIGINT or INT). One shuffle by shard, one set of files per shard."""
    folder = f"{scratch.path}/{name}"

    def write(batches):
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got)
        key = t["key"].to_numpy().view(U64)
        order = np.argsort(key)
        key = key[order]
        cols = {v: t[v].to_numpy()[order] for v in values}
        shard = shard_of(key, bits)
        for s in np.unique(shard):
            a, b = np.searchsorted(shard, [s, s + 1])
            file = save_arrays(folder, {"key": key[a:b], **{v: c[a:b] for v, c in cols.items()}})
            yield pa.RecordBatch.from_pydict({"shard": pa.array([int(s)], pa.int32()), "file": [file]})

    parts = df.repartition(min(1 << bits, 4096), shard_column("key", bits)) if bits else df.coalesce(1) if df.rdd.getNumPartitions() == 1 else df.repartition(1)
    files = {r.shard: r.file for r in parts.select("key", *values).mapInArrow(write, "shard int, file string").collect()}
    return HashTable(folder, bits, files, values)


def name_numbers(spark: SparkSession, names: list[str], kind: pa.DataType) -> DataFrame:
    """(name, file): each name with its place, handed over as Arrow data: a list of tuples would pass through Python workers of another pool."""
    return spark.createDataFrame(pa.table({"name": pa.array(names, pa.string()), "file": pa.array(range(len(names)), kind)}))


def plus(schema: T.StructType, name: str, kind: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField(name, kind)])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns, whatever other columns are there: an exact name first, else one that differs in case only."""
    safe = df.toDF(*[f"__c{i}" for i in range(len(df.columns))])
    out = []
    for n in names:
        at = [i for i, c in enumerate(df.columns) if c == n] or [i for i, c in enumerate(df.columns) if c.lower() == n.lower()]
        if not at:
            raise ValueError(f"no column {n} among {df.columns}")
        out.append(F.col(f"__c{at[0]}").alias(n))
    return safe.select(*out)


def position(df: DataFrame, name: str) -> int:
    """Where pick finds a column."""
    at = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not at:
        raise ValueError(f"no column {name} among {df.columns}")
    return at[0]
