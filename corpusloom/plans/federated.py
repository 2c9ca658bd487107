"""Questions to several sources at once, and sources of different kinds as retrievers."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import citations
from ..functions.models import Generate
from ..operators.fusion import merge_federated
from .engine import Retriever, extractive_answer


def as_frame(value: Any, queries: DataFrame) -> DataFrame:
    """What a source gives as (query_id, doc_id, content, score, rank, answer): a frame of hits or answers, a text, a list of texts, or a dict with documents and answer; the last three hold for every question."""
    spark = queries.sparkSession
    if isinstance(value, DataFrame):
        has = lambda c, t: F.col(c).cast(t) if c in value.columns else F.lit(None).cast(t)
        return value.select("query_id", has("doc_id", "string").alias("doc_id"), has("content", "string").alias("content"), has("score", "double").alias("score"), has("rank", "int").alias("rank"), has("answer", "string").alias("answer"))
    if isinstance(value, Mapping):
        texts, answer = [str(x) for x in value.get("documents") or value.get("docs") or []], value.get("answer")
    elif isinstance(value, (list, tuple)):
        texts, answer = [str(x) for x in value], None
    else:
        texts, answer = [], str(value)
    rows = [(None, t, None, i + 1, None) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, str(answer))] if answer is not None else []
    given = spark.createDataFrame(rows, "doc_id string, content string, score double, rank int, answer string")
    return queries.select("query_id").crossJoin(F.broadcast(given))  # a list written by hand


def ask_source(source: Any, queries: DataFrame, k: int) -> DataFrame:
    """Hits or answers of a source: its retrieve, that of its retriever, its ask, or the source itself if it is a function."""
    for holder, name in ((source, "retrieve"), (getattr(source, "retriever", None), "retrieve"), (source, "ask")):
        if callable(f := getattr(holder, name, None)):
            return as_frame(f(queries, k), queries)
    if callable(source):
        try:
            return as_frame(source(queries, k), queries)
        except TypeError:
            return as_frame(source(queries), queries)
    raise TypeError(f"not a source: {source!r}")


def federated_hits(sources: Mapping[str, Any], queries: DataFrame, k: int = 8, per_source: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, answers): the merged hits of all sources with their content, and their own answers (query_id, source_name, answer). A source that gives an answer but no document counts as a hit with score 0.5."""
    if not sources:
        raise ValueError("at least one source is needed")
    found = {n: ask_source(s, queries, per_source) for n, s in sources.items()}
    lists, answers = {}, None
    for n, f in found.items():
        said = f.where("answer is not null").select("query_id", F.lit(n).alias("source_name"), "answer").dropDuplicates(["query_id"])
        answers = said if answers is None else answers.unionByName(said)
        docs = f.where("content is not null or doc_id is not null").select("query_id", F.coalesce("doc_id", "content").alias("doc_id"), "score", F.coalesce("rank", F.lit(1)).alias("rank"), "content")
        alone = said.join(docs.select("query_id").distinct(), "query_id", "left_anti").select("query_id", F.lit(":answer").alias("doc_id"), F.lit(0.5).alias("score"), F.lit(1).alias("rank"), F.col("answer").alias("content"))
        lists[n] = docs.unionByName(alone)
    hits = merge_federated(lists, k)
    content = None
    for n, f in lists.items():
        c = f.select("query_id", F.concat_ws(":", F.lit(n), "doc_id").alias("doc_id"), "content")
        content = c if content is None else content.unionByName(c)
    return hits.join(content.dropDuplicates(["query_id", "doc_id"]), ["query_id", "doc_id"], "left"), answers


def federated_ask(sources: Mapping[str, Any], queries: DataFrame, generate: Generate | None = None, k: int = 8, per_source: int = 5) -> DataFrame:
    """One row per question: (query_id, query, answer, source_ids, sources_queried, prompt, check). Answers of single sources stand below the documents in the context."""
    hits, answers = federated_hits(sources, queries, k, per_source)
    part = F.concat(F.lit("[source: "), F.col("doc_id"), F.lit("]\n"), F.coalesce("content", F.lit("")))
    ctx = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("federated_rank", part.alias("p"), F.col("doc_id").alias("d")))).alias("h"))
    ctx = ctx.select("query_id", F.array_join(F.transform("h", lambda x: x["p"]), "\n\n---\n\n").alias("documents"), F.transform("h", lambda x: x["d"]).alias("source_ids"))
    said = answers.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("["), "source_name", F.lit("] "), "answer"))), "\n").alias("said"))
    rows = queries.join(ctx, "query_id", "left").join(said, "query_id", "left")
    below = F.concat(F.lit("Réponses intermédiaires par source:\n"), "said")
    rows = rows.withColumn("context", F.when(F.col("documents").isNull(), F.coalesce("said", F.lit(""))).otherwise(F.concat_ws("\n\n", "documents", below)))
    rows = rows.withColumn("prompt", F.concat(F.lit("Contexte:\n"), F.col("context"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nRéponse:")))
    rows = rows.withColumn("answer", generate(F.col("prompt")) if generate else extractive_answer(F.col("context"))).withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))
    rows = rows.withColumn("sources_queried", F.array(*[F.lit(n) for n in sources])).withColumn("check", citations.validate(F.col("answer"), F.col("source_ids"), False))
    return rows.select("query_id", "query", "answer", "source_ids", "sources_queried", "prompt", "check")


def graph_ask(graph: DataFrame, hits: DataFrame, docs: DataFrame, queries: DataFrame, generate: Generate | None = None, most: int = 20) -> DataFrame:
    """(query_id, query, answer, source_ids, triples): an answer from graph hits (query_id, doc_id, score), with up to most triples of their documents as metadata."""
    turn = F.row_number
    from pyspark.sql import Window as W

    ranked = hits.withColumn("rank", turn().over(W.partitionBy("query_id").orderBy(F.col("score").desc_nulls_last(), "doc_id")))
    near = ranked.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")
    part = F.concat(F.lit("[source: "), F.col("doc_id").cast("string"), F.lit("]\n"), F.col("content"))
    ctx = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p"), F.col("doc_id").cast("string").alias("d")))).alias("h"))
    ctx = ctx.select("query_id", F.array_join(F.transform("h", lambda x: x["p"]), "\n\n---\n\n").alias("context"), F.transform("h", lambda x: x["d"]).alias("source_ids"))
    t = graph.join(ranked.select("query_id", "doc_id", "rank"), "doc_id").select("query_id", "rank", F.concat_ws(" - ", "subject", "relation", "object").alias("t"))
    t = t.withColumn("n", turn().over(W.partitionBy("query_id").orderBy("rank", "t"))).where(F.col("n") <= most).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "t"))), lambda x: x["t"]).alias("triples"))
    rows = queries.join(ctx, "query_id", "left").join(t, "query_id", "left")
    prompt = F.concat(F.lit("Contexte:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nRéponse:"))
    answer = generate(prompt) if generate else extractive_answer(F.coalesce("context", F.lit("")))
    return rows.select("query_id", "query", answer.alias("answer"), "source_ids", F.coalesce("triples", F.array().cast("array<string>")).alias("triples"))


def of_hits(hits: DataFrame) -> Retriever:
    """A retriever over hits that are known already."""
    return lambda queries, k: hits.join(queries.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= k)
