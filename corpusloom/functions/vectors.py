"""Vector functions and the hashing embedder."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSION = 384


def dot(a: Column, b: Column) -> Column:
    """Sum of products, added from the first dimension on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity within -1..1; 0 if either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 1e-12, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / size))).otherwise(0.0)


def hash_terms(terms: list[str], dimension: int) -> np.ndarray:
    """Signed feature hashing of the terms and of their neighbours in pairs, at length 1."""
    return hash_lists([terms], dimension)[0]


def hash_lists(lists: Iterable[list[str]], dimension: int) -> np.ndarray:
    """hash_terms of each list: digests one by one, their sums for all lists at once."""
    digests, sizes, fresh = [], [], hashlib.blake2b(digest_size=8)
    for terms in lists:
        w = [t.encode() for t in terms]
        sizes.append(max(2 * len(w) - 1, 0))
        pairs, n = [a + b" " + b for a, b in zip(w, w[1:], strict=False)], (len(w) + 1) // 2
        again = n - 1 if w[n:] == pairs[: n - 1] else 0  # tokens: words and then their pairs, which come again as pairs of neighbours
        for t in (*w, *pairs[again:]):
            d = fresh.copy()
            d.update(t)
            digests.append(d.digest())
        digests += digests[len(digests) - len(pairs) + again - (len(w) - n) :][:again] if again else []
    d = np.frombuffer(b"".join(digests), np.dtype([("at", "<u4"), ("sign", "u1"), ("rest", "V3")]))
    at = np.repeat(np.arange(len(sizes)) * dimension, sizes) + d["at"] % dimension
    out = np.bincount(at, 1.0 - 2.0 * (d["sign"] & 1), len(sizes) * dimension).astype(np.float32).reshape(len(sizes), dimension)
    for v in out:
        size = float(np.linalg.norm(v))
        if size > 0:
            v /= size
    return out


def embed_terms(terms: Column, dimension: int = DIMENSION) -> Column:
    """Hashing embedding of a token array (BLAKE2b buckets), in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda t: hash_terms([] if t is None else list(t), dimension).tolist())

    return run(terms)


def mean_vector(rows: DataFrame, by: list[str], vector: str) -> DataFrame:
    """The mean of the vectors of each group, at length 1."""
    each = rows.select(*by, F.posexplode(vector).alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    packed = each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))
    return packed.withColumn(vector, unit(F.col(vector)))
