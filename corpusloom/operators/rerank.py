"""Reranking, diversification and compression of hits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import content_terms, coverage, jaccard, sentences, tokens


def keyword_rerank(hits: DataFrame, k: int = 5, query: str = "query", content: str = "content") -> DataFrame:
    """Hits (query_id, doc_id, rank, query, content) by the Jaccard similarity of their token sets with the query; ties keep their order."""
    scored = hits.withColumn("rerank_score", F.round(jaccard(tokens(F.col(query)), tokens(F.col(content))), 6)).withColumnRenamed("rank", "first_rank")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "first_rank"))
    return scored.withColumn("rank", turn).where(F.col("rank") <= k)


def mmr(hits: DataFrame, k: int = 5, balance: float = 0.5) -> DataFrame:
    """Maximal marginal relevance over fetched hits (query_id, doc_id, score, vector): (query_id, doc_id, score, mmr_rank).

    Greedy within a query: the next is the one with the greatest balance * score - (1 - balance) * similarity to the nearest
    chosen one; at a tie the earlier one, by score and doc_id. A group is the fetched hits of one query.
    """
    kinds = dict(hits.dtypes)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "doc_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        v, rel = np.array(pdf["vector"].tolist(), dtype=float), pdf["score"].to_numpy()
        sim, near, chosen = v @ v.T, np.full(len(pdf), -np.inf), []
        while len(chosen) < min(k, len(pdf)):
            value = balance * rel - (1 - balance) * (near if chosen else np.zeros(len(pdf)))
            value[chosen] = -np.inf
            chosen.append(int(np.argmax(value)))
            near = np.maximum(near, sim[chosen[-1]])
        out = pdf.loc[chosen, ["query_id", "doc_id", "score"]]
        return out.assign(mmr_rank=np.arange(1, len(chosen) + 1))

    return hits.select("query_id", "doc_id", "score", "vector").groupBy("query_id").applyInPandas(pick, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, score double, mmr_rank int")


def drop_redundant(hits: DataFrame, threshold: float = 0.86, min_tokens: int = 8, content: str = "content") -> DataFrame:
    """Hits without those whose token set is at least threshold-similar to that of a hit kept before, in rank order. Short texts always stay, and count as comparators."""
    kinds = dict(hits.dtypes)
    prepared = hits.select("query_id", "doc_id", "rank", F.array_distinct(tokens(F.col(content))).alias("t"))

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, sets = [], []
        for i, t in enumerate(map(set, pdf.sort_values("rank")["t"])):
            if len(t) < min_tokens or not any(o and len(t & o) / max(len(t | o), 1) >= threshold for o in sets):
                kept.append(i)
                sets.append(t)
        return pdf.sort_values("rank").iloc[kept][["query_id", "doc_id", "rank"]]

    return prepared.groupBy("query_id").applyInPandas(keep, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, rank int")


def compress(hits: DataFrame, most: int = 3, max_chars: int = 900, min_chars: int = 20) -> DataFrame:
    """Hits (query_id, doc_id, query, content) cut to the sentences that cover most of the query's tokens, in their own order.

    All within the row: sentences, their scores and the choice are array expressions.
    """
    q = F.array_distinct(tokens(F.col("query")))
    scored = F.transform(sentences(F.col("content")), lambda s, i: F.struct((-F.when(F.size(q) > 0, F.size(F.array_intersect(tokens(s), q)) / F.size(q)).otherwise(0.0)).alias("s"), i.alias("i"), s.alias("t")))
    ranked = F.array_sort(F.filter(scored, lambda x: F.length(x["t"]) >= min_chars))
    best = F.array_sort(F.transform(F.slice(ranked, 1, most), lambda x: F.struct(x["i"].alias("i"), x["t"].alias("t"))))
    text = F.when(F.size(ranked) > 0, F.array_join(F.transform(best, lambda x: x["t"]), " ")).otherwise(F.col("content"))
    return hits.withColumn("compressed", F.substring(text, 1, max_chars)).withColumn("original_chars", F.length("content")).withColumn("compressed_chars", F.length("compressed"))


def grade_retrieval(hits: DataFrame, min_overlap: float = 0.08) -> DataFrame:
    """(query_id, score, passed, reason) of each query's hits (query, content, score): the greater of word overlap and half the best score."""
    each = hits.groupBy("query_id").agg(F.first("query").alias("query"), F.array_distinct(F.flatten(F.collect_list(content_terms(F.col("content"))))).alias("d"), F.max(F.coalesce("score", F.lit(0.0))).alias("best"))
    q = content_terms(F.col("query"))
    overlap = coverage(F.col("d"), q)
    score = F.when(F.size(q) == 0, 1.0).otherwise(F.greatest(overlap, F.least(F.greatest("best", F.lit(0.0)), F.lit(1.0)) * 0.5))
    graded = each.withColumn("score", F.round(score, 6)).withColumn("passed", F.col("score") >= min_overlap)
    reason = F.when(F.size(q) == 0, "empty_query_terms").when(F.col("passed"), "lexical_overlap").otherwise("low_overlap")
    return graded.withColumn("reason", reason).select("query_id", "score", "passed", "reason")


def parse_notes(raw) -> dict:
    """Columns of a reading note with tagged fields: its relevance label (relevant, partly, irrelevant; partly by default) and its summary."""
    label = F.lower(F.regexp_extract(raw, r"(?is)(?:pertinence|relevance)\s*:\s*([^\n]+)", 1))
    value = F.when(label.rlike("non|not|irrelevant"), "non pertinent").when(label.rlike("partiel|partial"), "partiellement pertinent").when(label.rlike("pertinent|relevant"), "pertinent").otherwise("partiellement pertinent")
    return {"label": value, "note": F.trim(F.regexp_extract(raw, r"(?is)note\s*:\s*(.*?)(?:\n\w+\s*:|$)", 1)), "evidence": F.trim(F.regexp_extract(raw, r"(?is)(?:preuve|evidence)\s*:\s*(.*?)(?:\n\w+\s*:|$)", 1))}
