"""Rank fusion and merges of hits frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .search import top_k

RRF_K = 60


def tagged(lists: dict[str, DataFrame]) -> DataFrame:
    """One frame of several ranked lists, with the list's name and place."""
    parts = [d.select("query_id", "doc_id", "score", "rank", F.lit(n).alias("list"), F.lit(i).alias("list_no")) for i, (n, d) in enumerate(lists.items())]
    return reduce(DataFrame.unionByName, parts)


def reciprocal_rank_fusion(lists: dict[str, DataFrame], k: int = 10, weights: dict[str, float] | None = None, constant: int = RRF_K) -> DataFrame:
    """Sum of weight / (constant + rank) over the lists; original_score is that of the first list that has the document.

    A weight of 0 leaves a list out; negative weights are an error.
    """
    weights = weights or {}
    if any(w < 0 for w in weights.values()):
        raise ValueError("weights must not be negative")
    all_hits = tagged({n: d for n, d in lists.items() if weights.get(n, 1.0) > 0})
    weight = F.coalesce(*[F.when(F.col("list") == n, F.lit(float(w))) for n, w in weights.items()], F.lit(1.0))
    fused = all_hits.groupBy("query_id", "doc_id").agg(
        F.round(F.sum(weight / (constant + F.col("rank"))), 6).alias("score"),
        F.min_by("score", F.struct("list_no", "rank")).alias("original_score"),
        F.array_sort(F.collect_set("list")).alias("lists"),
    )
    return top_k(fused, k)


def merge_variants(hits: DataFrame, k: int = 10, variant: str | None = None) -> DataFrame:
    """Hits of several variants of a query: the best score of each document, and with variant which of them matched."""
    extra = [F.array_sort(F.collect_set(variant)).alias("matched_variants")] if variant else []
    return top_k(hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), *extra), k)


def merge_step_back(original: DataFrame, wider: DataFrame, k: int = 10) -> DataFrame:
    """Hits of a query and of its wider form: those of both first, then the original's, then the wider one's; the original's score stays."""
    a = original.select("query_id", "doc_id", F.col("score").alias("s0"))
    b = wider.select("query_id", "doc_id", F.col("score").alias("s1"))
    both = a.join(b, ["query_id", "doc_id"], "full_outer")
    origin = F.when(F.col("s0").isNotNull() & F.col("s1").isNotNull(), "both").when(F.col("s0").isNotNull(), "original").otherwise("stepback")
    order = F.when(F.col("origin") == "both", 0).when(F.col("origin") == "original", 1).otherwise(2)
    both = both.withColumn("origin", origin).withColumn("score", F.coalesce("s0", "s1"))
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(order, F.col("score").desc(), "doc_id"))
    return both.withColumn("rank", turn).where(F.col("rank") <= k).select("query_id", "doc_id", "score", "origin", "rank")


def merge_federated(sources: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """Hits of several sources side by side: no document is merged across sources; a hit without a score gets 1 / rank."""
    hits = tagged(sources).withColumn("score", F.round(F.coalesce("score", 1 / F.col("rank")), 6))
    hits = hits.select("query_id", F.concat_ws(":", "list", F.col("doc_id").cast("string")).alias("doc_id"), F.col("list").alias("source_name"), "score")
    return top_k(hits, k).withColumnRenamed("rank", "federated_rank")


def merge_graph(graph_hits: DataFrame, fallback: DataFrame, k: int = 10, boost: float = 0.15) -> DataFrame:
    """Documents found through the graph (scored with boost) and those of another search; on both sides the higher score wins, the graph's at a tie."""
    a = graph_hits.select("query_id", "doc_id", (F.coalesce("score", F.lit(0.0)) + boost).alias("score"), F.lit("graph").alias("method"), F.lit(1).alias("pref"))
    b = fallback.select("query_id", "doc_id", "score", F.lit("graph+fallback").alias("method"), F.lit(0).alias("pref"))
    best = a.unionByName(b).groupBy("query_id", "doc_id").agg(F.max_by(F.struct("score", "method"), F.struct(F.coalesce("score", F.lit(0.0)), "pref")).alias("b"))
    return top_k(best.select("query_id", "doc_id", "b.score", "b.method"), k)


def to_parents(child_hits: DataFrame, children: DataFrame, k: int = 5, most: int = 5) -> DataFrame:
    """Hits on children (query_id, doc_id, score) as hits on their parents, scored by the best child. children: (doc_id, parent_id); without a parent, a child is its own."""
    known = children.select("doc_id", F.coalesce("parent_id", "doc_id").alias("parent_id"))
    grouped = child_hits.join(known, "doc_id").groupBy("query_id", "parent_id").agg(F.max("score").alias("score"), F.count("*").alias("matched_child_count"), F.array_sort(F.collect_set("doc_id")).alias("child_matches"))
    return top_k(grouped, min(k, most), ties="parent_id")


def parent_of(section_id, parent_doc_id, parent_id, doc_id):
    """The parent's id of a child: the first of its parent columns that is not empty, else its own id before "#child-"."""
    return F.coalesce(F.nullif(section_id, F.lit("")), F.nullif(parent_doc_id, F.lit("")), F.nullif(parent_id, F.lit("")), F.substring_index(doc_id, "#child-", 1))


def with_orphans(parents: DataFrame, children: DataFrame) -> DataFrame:
    """parents (parent_id, content) with a parent made from the joined contents of the children whose parent is missing. children: (doc_id, parent_id, chunk_index, content)."""
    lost = children.join(parents, "parent_id", "left_anti")
    made = lost.groupBy("parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda s: s["content"]), "\n\n").alias("content"))
    return parents.select("parent_id", "content").unionByName(made)
