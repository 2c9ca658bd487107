"""Quality of retrieval and of generated answers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.citations import answer_relevance, citation_accuracy, citation_coverage, groundedness
from ..sources.store import settled
from .search import BROADCAST_QUERIES

#: Bytes of a passage that are looked up at every place of a text.
SPAN = 8
METRICS = ("hit", "reciprocal_rank", "precision", "recall", "ndcg", "context_precision")


def candidate_ids(schema_names: set[str]):
    """All ids that a hit answers to: its own, its document's (before "#"), its parent's, its source's."""
    c = F.col("doc_id").cast("string")
    extra = [F.col(n).cast("string") for n in ("parent_doc_id", "source_doc_id", "source", "filename") if n in schema_names]
    return F.array_distinct(F.array_compact(F.array(c, F.substring_index(c, "#", 1), *extra)))


def labels_by_passage(docs: DataFrame, queries: DataFrame, chars: int = 40) -> DataFrame:
    """(query_id, doc_id, gain) of the documents (doc_id, text) that hold the first chars characters of a query: gain 2 where they hold all of it, else 1.

    Each text is read once for all queries: its places that begin with SPAN bytes of a query are found by a table of their hashes, then
    compared. Shorter queries, or very many, go by a join on contains.
    """
    q = queries.select("query_id", "query", F.substring("query", 1, chars).alias("head"))
    asked = q.where(F.octet_length("head") >= SPAN).limit(BROADCAST_QUERIES + 1).toArrow().combine_chunks()
    many = asked.num_rows > BROADCAST_QUERIES
    rest = q if many else q.where(F.octet_length("head") < SPAN)
    joined = rest.join(docs.select("doc_id", "text"), F.col("text").contains(F.col("head")))
    joined = joined.select("query_id", "doc_id", F.when(F.col("text").contains(F.col("query")), 2.0).otherwise(1.0).alias("gain"))
    if many or not asked.num_rows:
        return joined
    ids = asked["query_id"].combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    heads, whole = ([x.encode() for x in asked[c].to_pylist()] for c in ("head", "query"))

    def spans(data: np.ndarray) -> np.ndarray:
        """The SPAN bytes from each place on as a number."""
        return np.ndarray((max(0, len(data) - SPAN + 1),), "<u8", data, strides=(1,))

    def places(x: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, key) of the places whose number is one of the sorted keys."""
        mix = lambda a: (a * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)
        table = np.zeros(1 << 18, bool)
        table[mix(keys)] = True
        at = np.flatnonzero(table[mix(x)])
        near = np.minimum(np.searchsorted(keys, x[at]), len(keys) - 1)
        same = keys[near] == x[at]
        return at[same], near[same]

    def find(batches):
        keys = owners = None
        for b in (big.slice(at, 500) for big in batches for at in range(0, big.num_rows, 500)):
            text = b["text"]
            edges = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
            edges = edges - edges[0]
            x = spans(data)
            if keys is None and len(x):  # of each query's spans the one that is rarest in the first texts
                parts = [spans(np.frombuffer(h, np.uint8)) for h in heads]
                every = np.unique(np.concatenate(parts))
                seen = np.bincount(places(x, every)[1], minlength=len(every))
                skip = [int(np.argmin(seen[np.searchsorted(every, p)])) for p in parts]
                keys = np.unique(np.array([p[i] for p, i in zip(parts, skip, strict=True)], np.uint64))
                owners = [[] for _ in keys]
                for n, (p, i) in enumerate(zip(parts, skip, strict=True)):
                    owners[int(np.searchsorted(keys, p[i]))].append((n, i))
            if not len(x):
                continue
            at, key = places(x, keys)
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            out: list[tuple[int, int, float]] = []
            for k in np.unique(key):
                some = at[np.searchsorted(key, k) : np.searchsorted(key, k, side="right")]
                for n, skip_n in owners[k]:
                    head = np.frombuffer(heads[n], np.uint8)
                    start = some - skip_n
                    row = np.searchsorted(edges, start, side="right") - 1
                    inside = (start >= 0) & (start + len(head) <= edges[np.minimum(row + 1, len(edges) - 1)])
                    start, row = start[inside], row[inside]
                    row = np.unique(row[(data[start[:, None] + np.arange(len(head))] == head).all(1)])
                    out += [(n, r, 2.0 if whole[n] in data[edges[r] : edges[r + 1]].tobytes() else 1.0) for r in row.tolist()]
            if out:
                n, r, gain = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(n)), b["doc_id"].take(pa.array(r)), pa.array(gain)], ["query_id", "doc_id", "gain"])

    kinds = dict(queries.dtypes)["query_id"], dict(docs.dtypes)["doc_id"]
    found = docs.select("doc_id", "text").mapInArrow(find, f"query_id {kinds[0]}, doc_id {kinds[1]}, gain double")
    return found if rest.isEmpty() else found.unionByName(joined)


def evaluate_retrieval(hits: DataFrame, qrels: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """Per-query metrics at k of hits (query_id, doc_id, rank) against qrels (query_id, doc_id, gain), for all queries (query_id).

    precision divides by k; recall is 1 where nothing is expected; ndcg takes its ideal from the labels, so several chunks
    of one document can exceed 1; context_precision is average precision over min(labels, k).
    """
    top = hits.where(F.col("rank") <= k).select("query_id", "rank", F.explode(candidate_ids(set(hits.columns))).alias("cid"))
    labels = qrels.select("query_id", F.col("doc_id").cast("string").alias("cid"), F.col("gain").cast("double").alias("gain"))
    found = settled(top.join(labels, ["query_id", "cid"]), "found")
    covered = found.groupBy("query_id").agg(F.count_distinct("cid").alias("covered"))
    per_hit = found.groupBy("query_id", "rank").agg(F.max("gain").alias("rel")).where("rel > 0")
    seen = F.row_number().over(W.partitionBy("query_id").orderBy("rank"))
    per_query = per_hit.withColumn("seen", seen).groupBy("query_id").agg(
        F.count("*").alias("n_hit"), F.min("rank").alias("first"), F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("rank") + 1)).alias("dcg"), F.sum(F.col("seen") / F.col("rank")).alias("ap")
    )
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("gain"), "cid"))
    ideal = labels.withColumn("p", place).groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("p") <= k, (F.pow(F.lit(2.0), "gain") - 1) / F.log2(F.col("p") + 1))).alias("idcg"))
    all_q = queries.select("query_id").distinct().join(ideal, "query_id", "left").join(per_query, "query_id", "left").join(covered, "query_id", "left").fillna(0)
    r = lambda c: F.round(c, 6)
    return all_q.select(
        "query_id",
        F.when(F.col("n_hit") > 0, 1).otherwise(0).alias("hit"),
        r(F.when(F.col("first") > 0, 1 / F.col("first")).otherwise(0.0)).alias("reciprocal_rank"),
        r(F.col("n_hit") / k).alias("precision"),
        r(F.when(F.col("n") > 0, F.col("covered") / F.col("n")).otherwise(1.0)).alias("recall"),
        r(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("ndcg"),
        r(F.when(F.col("n") > 0, F.col("ap") / F.least("n", F.lit(k))).otherwise(0.0)).alias("context_precision"),
    )


def summarise_retrieval(per_query: DataFrame) -> DataFrame:
    """Means over all queries, one row."""
    return per_query.agg(*[F.coalesce(F.round(F.avg(m), 6), F.lit(0.0)).alias(m) for m in METRICS])


def evaluate_generation(rows: DataFrame) -> DataFrame:
    """Four metrics of each answer: rows (query, answer, context, source_ids)."""
    r = lambda c: F.round(c, 6)
    a, s = F.col("answer"), F.col("source_ids")
    return rows.withColumns({
        "citation_accuracy": r(citation_accuracy(a, s)), "citation_coverage": r(citation_coverage(a, s)),
        "groundedness": r(groundedness(a, F.col("context"))), "answer_relevance": r(answer_relevance(a, F.col("query"))),
    })


def to_markdown(rows: list[dict], columns: list[str], most: int = 20, total: int | None = None) -> str:
    """A Markdown table of rows already on the driver; pipes escaped, line breaks as spaces."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    lines += ["| " + " | ".join(cell(r.get(c)) for c in columns) + " |" for r in rows[:most]]
    return "\n".join(lines) + (f"\n\nShowing {most} rows." if (total or len(rows)) > most else "")
