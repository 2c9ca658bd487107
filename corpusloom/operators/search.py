"""Sparse, dense and hybrid scoring with top-k, for many queries at once.

A query frame has (query_id, query), a hits frame (query_id, doc_id, score, rank). Ties go by doc_id.
"""

from __future__ import annotations

from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

from ..functions.text import tokens, words
from ..functions.vectors import dot, hash_lists
from ..sources.store import settled, shared_folder
from .nearest import nearest, stored

K1, B = 1.5, 0.75
#: Vectors per block of an exact search; the shuffle is vectors times blocks of queries.
BLOCK = 4096
#: Tables of terms or queries that were counted to have at most so many rows are broadcast.
BROADCAST_ROWS = 500_000
#: At most so many queries, with at most BROADCAST_ROWS words, are handed to all tasks.
BROADCAST_QUERIES = 20_000


def top_k(scored: DataFrame, k: int, score: str = "score", by: str = "query_id", ties: str = "doc_id") -> DataFrame:
    """The k best rows of each query, with their rank. Spark prunes to k before the shuffle (WindowGroupLimit)."""
    turn = F.row_number().over(W.partitionBy(by).orderBy(F.col(score).desc_nulls_last(), ties))
    return scored.withColumn("rank", turn).where(F.col("rank") <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(doc_id, dl, terms): the tokens of each document and their number."""
    t = docs.select(F.col(id_col).alias("doc_id"), tokens(F.coalesce(F.col(text_col), F.lit("")), **how).alias("terms"))
    return t.withColumn("dl", F.size("terms"))


def term_statistics(docs: DataFrame, **how) -> DataFrame:
    """(term, df, idf) over all documents."""
    t = postings(docs, **how)
    n = t.agg(F.count("*").alias("n"))
    df = t.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))  # one row


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, to be broadcast if it was counted to have at most so many rows."""
    return F.broadcast(df) if df.count() <= rows else df


def bm25(docs: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """(query_id, doc_id, score) of all documents that share a term with the query. A query's repeated terms count each time.

    One scan tokenises each document once and writes the query terms that it holds, a row per document, to the shared folder; a second
    pass over that table scores whole documents, so nothing is shuffled. Many query terms, or ids that several documents have, go by joins.
    """
    found = Matches.of(docs, queries, **how)
    return _bm25_by_joins(docs, queries, **how) if found is None else found.scores()


def bm25_top_k(docs: DataFrame, queries: DataFrame, k: int = 10, **how) -> DataFrame:
    found = Matches.of(docs, queries, **how)
    return top_k(_bm25_by_joins(docs, queries, **how) if found is None else found.scores(k), k)


def _best(s: np.ndarray, seen: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the cells that can be among the k best of their column once scores are rounded; least holds the k-th best so far."""
    s = np.where(seen, s, -np.inf)
    if len(s) > k:
        np.maximum(least, np.partition(s, len(s) - k, axis=0)[len(s) - k], out=least)
    return np.nonzero(seen & (s >= least - 2e-6))


class Matches:
    """Query terms and, for each document, which of them it holds how often: (doc_id, dl, t, f) in the shared folder."""

    def __init__(self, table: DataFrame, ids: pa.Array, terms: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.table, self.ids, (self.first, self.query, self.times) = table, ids, terms
        n, length = table.agg(F.count("*"), F.sum("dl")).first()
        self.average = float(length or 0) / n if n else 0.0
        df = np.zeros(len(self.first) - 1)
        for r in table.select(F.explode("t").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
            df[r.t] = r.df
        self.idf = np.log(1 + (n - df + 0.5) / (df + 0.5))

    @staticmethod
    def of(docs: DataFrame, queries: DataFrame, ngram_max: int = 2, id_col: str = "doc_id", text_col: str = "text", dimension: int | None = None, **how) -> Matches | None:
        """None where the general way is needed. With dimension the table has a hashing embedding of the tokens, too, as vector."""
        if ngram_max > 2:
            return None
        text = lambda c: words(F.coalesce(F.col(c), F.lit("")), **how)
        asked = queries.select("query_id", text("query").alias("w")).where(F.size("w") > 0).limit(BROADCAST_QUERIES + 1).toArrow()
        kind = asked.schema.field("query_id").type
        own = [(b["query_id"], b["w"]) for b in asked.to_batches()]
        lists = pa.concat_arrays([w for _, w in own]) if own else pa.array([], pa.list_(pa.string()))
        size = pa.compute.list_value_length(lists).to_numpy()
        if asked.num_rows > BROADCAST_QUERIES or size.sum() > BROADCAST_ROWS:
            return None
        # words by number; a pair of words is a term, too, and both of its words are terms of that query
        coded = lists.flatten().dictionary_encode()
        known, w = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        named = (pa.concat_arrays([i for i, _ in own]) if own else pa.array([], kind)).dictionary_encode(null_encoding="encode")
        ids, q = named.dictionary, np.repeat(named.indices.to_numpy().astype(np.int64), size)
        starts = np.zeros(len(w) + 1, bool)
        starts[np.cumsum(size)] = True
        v = max(1, len(known))
        follows = np.flatnonzero(~starts[1:]) if ngram_max == 2 else np.zeros(0, np.int64)
        pairs, second = np.unique(w[follows] * v + w[follows + 1], return_inverse=True)
        term = np.concatenate([w, len(known) + second])
        keys, times = np.unique(term * max(1, len(ids)) + np.concatenate([q, q[follows]]), return_counts=True)
        n_terms = len(known) + len(pairs)
        first = np.searchsorted(keys, np.arange(n_terms + 1) * max(1, len(ids)))
        both = ngram_max == 2

        def match(batches):
            for b in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
                lists = b["w"]
                edges = lists.offsets.to_numpy().astype(np.int64)
                flat = pa.compute.fill_null(pa.compute.index_in(lists.values, value_set=known), -1).to_numpy().astype(np.int64)
                flat = flat[edges[0] : edges[-1]]
                edges = edges - edges[0]
                size = np.diff(edges)
                row = np.repeat(np.arange(len(size)), size)
                at = np.flatnonzero(flat >= 0)
                r, t = row[at], flat[at]
                if both and len(pairs):
                    p = at[:-1][(np.diff(at) == 1) & (r[1:] == r[:-1])]
                    code = flat[p] * v + flat[p + 1]
                    place = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
                    ok = pairs[place] == code
                    r, t = np.concatenate([r, row[p[ok]]]), np.concatenate([t, len(known) + place[ok]])
                cell, tf = np.unique(r * n_terms + t, return_counts=True) if n_terms else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                cuts = pa.array(np.searchsorted(cell, np.arange(len(size) + 1) * max(1, n_terms)).astype(np.int32))
                dl = size + np.maximum(size - 1, 0) if both else size
                out = [b["doc_id"]]
                if dimension:
                    texts = ([*t, *(f"{x} {y}" for x, y in zip(t, t[1:], strict=False))] for t in lists.to_pylist())
                    out.append(pa.FixedSizeListArray.from_arrays(hash_lists(texts, dimension).ravel(), dimension).cast(pa.list_(pa.float32())))
                out += [pa.array(dl.astype(np.int32)), pa.ListArray.from_arrays(cuts, pa.array((cell % max(1, n_terms)).astype(np.int32))), pa.ListArray.from_arrays(cuts, pa.array(tf.astype(np.int32)))]
                yield pa.RecordBatch.from_arrays(out, [f.name for f in kept.fields])

        rows = docs.select(F.col(id_col).alias("doc_id"), text(text_col).alias("w"))
        kept = T.StructType([rows.schema["doc_id"]])
        if dimension:
            kept = kept.add("vector", T.ArrayType(T.FloatType()))
        for name, kind in (("dl", T.IntegerType()), ("t", T.ArrayType(T.IntegerType())), ("f", T.ArrayType(T.IntegerType()))):
            kept = kept.add(name, kind)
        table = settled(rows.mapInArrow(match, kept), "matches")
        if not table.groupBy("doc_id").count().where("count > 1").isEmpty():
            return None
        return Matches(table, ids, (first, keys % max(1, len(ids)), times))

    def kernel(self):
        """A function of a batch: for slices of its rows (first row, scores, mask of shared terms), rows by queries; nothing else of self goes along."""
        first, query, times, weights, average, n = self.first, self.query, self.times, self.idf, self.average if self.average > 0 else 1.0, len(self.ids)

        def run(b: pa.RecordBatch):
            t, f, edges = (x.to_numpy() for x in (b["t"].flatten(), b["f"].flatten(), b["t"].offsets))
            edges, tf, dl = edges.astype(np.int64) - edges[0], f.astype(np.float64), b["dl"].to_numpy()
            step = max(1, 2_000_000 // max(1, n))
            for lo in range(0, b.num_rows, step):
                hi = min(b.num_rows, lo + step)
                some = slice(edges[lo], edges[hi])
                row = np.repeat(np.arange(hi - lo), np.diff(edges[lo : hi + 1]))
                x = tf[some]
                w = weights[t[some]] * (x * (K1 + 1)) / (x + K1 * (1 - B + B * (dl[lo:hi][row] / average)))
                many = first[t[some] + 1] - first[t[some]]
                ends = np.cumsum(many)
                at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[t[some]] - (ends - many), many)
                s = np.bincount(np.repeat(row, many) * n + query[at], np.repeat(w, many) * times[at], (hi - lo) * n).reshape(hi - lo, n)
                yield lo, s, s > 0

        return run

    def scores(self, k: int | None = None) -> DataFrame:
        """(query_id, doc_id, score); with k at least those that can be among a query's k best."""
        run, ids = self.kernel(), self.ids

        def score(batches):
            least = np.full(len(ids), -np.inf)
            for b in batches:
                for lo, s, seen in run(b) if len(ids) else ():
                    i, j = np.nonzero(seen) if k is None else _best(s, seen, k, least)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(j)), b["doc_id"].take(pa.array(i + lo)), pa.array(s[i, j])], ["query_id", "doc_id", "score"])

        kinds = self.kinds()
        return self.table.mapInArrow(score, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double").withColumn("score", F.round("score", 6))

    def kinds(self) -> tuple[str, str]:
        """SQL types of query_id and doc_id."""
        return from_arrow_type(self.ids.type).simpleString(), dict(self.table.dtypes)["doc_id"]

    def hybrid(self, query_vectors: DataFrame, k: int, alpha: float, keep: DataFrame | None = None) -> DataFrame:
        """hybrid_top_k over a table that keeps vector, for the queries (query_id, query_vector): one pass finds the ends of both scores, the next one the best."""
        asked = query_vectors.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).toArrow()
        run, kind = self.kernel(), dict(query_vectors.dtypes)["query_id"]
        every = asked["query_id"].combine_chunks() if asked.num_rows else pa.array([], asked.schema.field("query_id").type)
        matrix = np.array([v.values.to_numpy() for v in asked["query_vector"]]) if asked.num_rows else np.zeros((0, 1))
        place = np.array([-1 if x is None else x for x in pa.compute.index_in(every, value_set=self.ids).to_pylist()], np.int64)

        def both(b: pa.RecordBatch):
            x = b["vector"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(b.num_rows, -1)
            for lo, s, _ in run(b):
                sparse = np.zeros((len(s), len(every)))
                sparse[:, place >= 0] = np.round(s[:, place[place >= 0]], 6)
                yield lo, np.round(x[lo : lo + len(s)] @ matrix.T, 6), sparse

        def ends(batches):
            low, high = np.full((2, len(every)), np.inf), np.full((2, len(every)), -np.inf)
            for b in batches:
                for _, *pair in both(b):
                    for i, s in enumerate(pair):
                        np.minimum(low[i], s.min(0), out=low[i])
                        np.maximum(high[i], s.max(0), out=high[i])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(every))), *map(pa.array, (low[0], high[0], low[1], high[1]))], ["i", "d0", "d1", "b0", "b1"])

        span = self.table.mapInArrow(ends, "i bigint, d0 double, d1 double, b0 double, b1 double").groupBy("i").agg(F.min("d0"), F.max("d1"), F.min("b0"), F.max("b1")).collect()
        d0, d1, b0, b1 = np.array(sorted(map(tuple, span)), float).reshape(-1, 5).T[1:]

        def scale(s: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            return np.divide(s - low, high - low, out=np.zeros_like(s), where=high - low >= 1e-12)

        def score(batches):
            least = np.full(len(every), -np.inf)
            for b in batches:
                for lo, dense, sparse in both(b) if len(every) else ():
                    dense, sparse = scale(dense, d0, d1), scale(sparse, b0, b1)
                    s = alpha * dense + (1 - alpha) * sparse
                    i, j = _best(s, np.ones(s.shape, bool), k, least)
                    yield pa.RecordBatch.from_arrays([every.take(pa.array(j)), b["doc_id"].take(pa.array(i + lo)), pa.array(dense[i, j]), pa.array(sparse[i, j])], ["query_id", "doc_id", "dense_score", "bm25_score"])

        rows = self.table if keep is None else self.table.join(keep, "doc_id", "left_semi")
        best = rows.mapInArrow(score, f"query_id {kind}, doc_id {self.kinds()[1]}, dense_score double, bm25_score double")
        return top_k(best.withColumn("score", F.round(alpha * F.col("dense_score") + (1 - alpha) * F.col("bm25_score"), 6)), k)


def _bm25_by_joins(docs: DataFrame, queries: DataFrame, **how) -> DataFrame:
    """bm25 for any number of queries. Terms that no query holds leave the plan before any shuffle; a row without a term carries the document's length.

    What is left, frequencies of query terms, is written to the shared folder, as both document frequencies and weights need it.
    """
    t = postings(docs, **how)
    q = queries.select("query_id", F.explode(tokens(F.coalesce(F.col("query"), F.lit("")), **how)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    q = settled(q, "query-terms")
    wanted = small(q.select("term").distinct().withColumn("wanted", F.lit(True)))
    each = t.select("doc_id", "dl", F.explode(F.concat("terms", F.array(F.lit(None).cast("string")))).alias("term"))
    each = each.join(wanted, "term", "left").where("wanted or term is null")
    tf = settled(each.groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")), "term-frequencies")
    n, length = tf.where("term is null").agg(F.sum("tf"), F.sum(F.col("dl") * F.col("tf"))).first()
    average = float(length or 0) / n if n else 0.0
    found = tf.where("term is not null")
    df = found.groupBy("term").agg(F.count("*").alias("df"))
    terms = small(settled(q.join(df, "term"), "terms"))
    relative = F.col("dl") / F.lit(average if average > 0 else 1.0)
    weight = idf(F.lit(n or 0), F.col("df")) * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * relative))
    return found.join(terms, "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(weight * F.col("qtf")), 6).alias("score"))


def dense_scores(vectors: DataFrame, queries: DataFrame, where: Column | None = None, k: int | None = None) -> DataFrame:
    """Dot products of all query vectors (query_id, query_vector) with all vectors (doc_id, vector) that pass where; with k only those that can be among a query's k best.

    Filter first, then score. Both sides are dealt into blocks, and each pair of blocks meets in one group; there a
    matrix product does the work and, with k, each query keeps its k best of the block, so pairs don't leave it.
    """
    v = vectors if where is None else vectors.where(where)
    n_v, n_q = v.count(), queries.count()
    blocks_v, blocks_q = max(1, -(-n_v // BLOCK)), max(1, -(-n_q // BLOCK))
    left = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("qv"), F.pmod(F.xxhash64("query_id"), F.lit(blocks_q)).cast("int").alias("a")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks_v - 1))))
    right = v.select("doc_id", F.col("vector").cast("array<double>").alias("v"), F.pmod(F.xxhash64("doc_id"), F.lit(blocks_v)).cast("int").alias("vb")).withColumn("va", F.explode(F.sequence(F.lit(0), F.lit(blocks_q - 1))))
    kinds = dict(left.dtypes)["query_id"], dict(right.dtypes)["doc_id"]
    types = to_arrow_type(left.schema["query_id"].dataType), to_arrow_type(right.schema["doc_id"].dataType)

    def best(s: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) of each query's k best scores, ties by doc_id; place: rank of each doc_id."""
        worst = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
        i, j = np.nonzero(s >= worst[:, None])
        order = np.lexsort((place[j], -s[i, j], i))
        i, j = i[order], j[order]
        head = np.searchsorted(i, np.arange(len(s)))
        use = np.arange(len(i)) - head[i] < k
        return i[use], j[use]

    def run(a, b):
        if not a.num_rows or not b.num_rows:
            return pa.table({"query_id": pa.array([], types[0]), "doc_id": pa.array([], types[1]), "score": pa.array([], pa.float64())})
        q = np.array(a["qv"].combine_chunks().flatten()).reshape(a.num_rows, -1)
        x = np.array(b["v"].combine_chunks().flatten()).reshape(b.num_rows, -1)
        if k is None or k >= len(x):
            i, j = np.repeat(np.arange(len(q)), len(x)), np.tile(np.arange(len(x)), len(q))
            score = np.round(q @ x.T, 6).ravel()
        else:
            place = np.empty(len(x), np.int64)
            place[np.array(pa.compute.sort_indices(b["doc_id"]))] = np.arange(len(x))
            some = []
            for lo in range(0, len(q), 256):
                s = np.round(q[lo : lo + 256] @ x.T, 6)
                i, j = best(s, place)
                some.append((i + lo, j, s[i, j]))
            i, j, score = (np.concatenate(p) for p in zip(*some, strict=True))
        return pa.table({"query_id": a["query_id"].take(pa.array(i)), "doc_id": b["doc_id"].take(pa.array(j)), "score": pa.array(score)})

    return left.groupBy("a", "b").cogroup(right.groupBy("va", "vb")).applyInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double")


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, where: Column | None = None) -> DataFrame:
    """The k best vectors (doc_id, vector) that pass where by dot product for each query (query_id, query_vector).

    The vectors are written once to the shared folder, by doc_id; tasks have some of the queries each and read all vectors by pieces, so
    what moves grows with vectors and hits only. Where workers can't read that folder as files, blocks meet in a shuffle.
    """
    if urlparse(shared_folder(vectors.sparkSession)).scheme not in ("", "file"):
        return top_k(dense_scores(vectors, queries, where, k), k)
    v = stored((vectors if where is None else vectors.where(where)).select("doc_id", F.col("vector").cast("array<double>").alias("vector")), ["doc_id"], "doc_id")
    kinds = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["doc_id"]
    most = min(k, v.rows)
    bits = np.packbits(np.ones(v.rows, bool))

    def run(batches):
        for b in (whole.slice(at, 1024) for whole in batches for at in range(0, whole.num_rows if most > 0 else 0, 1024)):
            q = b["query_vector"].flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            near, score = nearest(v, q, np.full(len(q), most), bits, 6)
            rows, at = np.unique(np.concatenate(near), return_inverse=True)
            query = np.repeat(np.arange(len(q)), [len(x) for x in near])
            yield pa.RecordBatch.from_arrays([b["query_id"].take(pa.array(query)), v.ids(rows).take(pa.array(at)), pa.array(np.concatenate(score))], ["query_id", "doc_id", "score"])

    asked = queries.select("query_id", F.col("query_vector").cast("array<double>").alias("query_vector")).repartition(2 * max(1, vectors.sparkSession.sparkContext.defaultParallelism))
    return top_k(asked.mapInArrow(run, f"query_id {kinds[0]}, doc_id {kinds[1]}, score double"), k)


def inverse_distance(distance: Column) -> Column:
    """Similarity score of a distance, 1 at 0."""
    return 1 / (1 + distance)


def min_max(scored: DataFrame, score: str, by: str = "query_id") -> DataFrame:
    """score scaled to 0..1 within each query; all 0 where its range is below 1e-12. Two numbers per query are joined back; scored is made once."""
    scored = settled(scored, "scores")
    ends = small(scored.groupBy(by).agg(F.min(score).alias("__low"), F.max(score).alias("__high")))
    low, high = F.col("__low"), F.col("__high")
    return scored.join(ends, by).withColumn(score, F.when(high - low < 1e-12, 0.0).otherwise((F.col(score) - low) / (high - low))).select(*scored.columns)


def hybrid_top_k(dense: DataFrame, sparse: DataFrame, k: int = 10, alpha: float = 0.5, keep: DataFrame | None = None) -> DataFrame:
    """alpha * dense + (1 - alpha) * sparse, each scaled over the whole corpus first; only then keep (doc_id) filters.

    dense has a row for every query and document; documents without a term match have sparse score 0 and count in its minimum.
    """
    both = dense.withColumnRenamed("score", "dense_score").join(sparse.withColumnRenamed("score", "bm25_score"), ["query_id", "doc_id"], "left").fillna(0.0, ["bm25_score"])
    both = settled(both, "both")
    span = lambda c: F.max(c) - F.min(c)
    ends = small(both.groupBy("query_id").agg(F.min("dense_score").alias("d0"), span("dense_score").alias("d1"), F.min("bm25_score").alias("b0"), span("bm25_score").alias("b1")))
    scaled = lambda c, least, most: F.when(F.col(most) < 1e-12, 0.0).otherwise((F.col(c) - F.col(least)) / F.col(most))
    both = both.join(ends, "query_id").withColumn("dense_score", scaled("dense_score", "d0", "d1")).withColumn("bm25_score", scaled("bm25_score", "b0", "b1")).drop("d0", "d1", "b0", "b1")
    both = both.withColumn("score", F.round(alpha * F.col("dense_score") + (1 - alpha) * F.col("bm25_score"), 6))
    return top_k(both if keep is None else both.join(keep, "doc_id", "left_semi"), k)


def min_score(hits: DataFrame, least: float) -> DataFrame:
    """Hits without a score or with one of at least least."""
    return hits.where(F.col("score").isNull() | (F.col("score") >= least))


def nearest_in_text(vectors: DataFrame, queries: DataFrame, texts: DataFrame, k: int, fetch: int) -> DataFrame:
    """Search over derived texts (questions, propositions, windows): (query_id, doc_id, score, matched) with the best text of each document.

    vectors: (text_id, vector); texts: (text_id, doc_id, matched). fetch candidates are taken before documents are told apart.
    """
    hits = dense_top_k(vectors.withColumnRenamed("text_id", "doc_id"), queries, fetch).withColumnRenamed("doc_id", "text_id")
    best = hits.join(texts, "text_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.max_by("matched", F.struct("score", F.col("text_id").cast("string"))).alias("matched"))
    return top_k(best, k)


def vector_query(query_vector: Column) -> Column:
    return dot(F.col("vector"), query_vector)
