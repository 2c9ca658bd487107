"""Retrieval that asks a model: filters, gates, routers and bounded loops. A loop's rounds run over all questions that are still open, as one batch each."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.models import Generate, first_line, gate_label, json_block, quality_label
from ..operators.filters import filter_metadata
from ..operators.rerank import parse_notes
from ..sources.store import settled
from .engine import Retriever, context

PROMPT = "Question : {q}\n\nDocument :\n{d}\n\n{ask}"


def _prompt(ask: str, query: str | Column = "query", document: str | Column | None = "content") -> Column:
    q = F.col(query) if isinstance(query, str) else query
    d = F.col(document) if isinstance(document, str) else document
    parts = [F.lit("Question : "), q, *([F.lit("\n\nDocument :\n"), d] if d is not None else []), F.lit("\n\n" + ask)]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def _with_content(hits: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    return hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def relevance_filter(search: Retriever, docs: DataFrame, queries: DataFrame, annotate: Generate, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, label, note, rank): of twice k hits those that the reading note does not call irrelevant, the relevant ones first, then by score."""
    rows = _with_content(search(queries, 2 * k), docs, queries)
    notes = parse_notes(F.col("raw"))
    rows = rows.withColumn("raw", annotate(_prompt("Donne la pertinence, une note et une preuve."))).withColumns({"label": notes["label"], "note": notes["note"]})
    rows = _ranked(rows.where("label != 'non pertinent'"), k, F.when(F.col("label") == "pertinent", 0).otherwise(1), F.col("score").desc_nulls_last(), F.col("doc_id"))
    return rows.select("query_id", "doc_id", "score", "label", "note", "rank")


def compress_with_model(search: Retriever, docs: DataFrame, queries: DataFrame, extract: Generate, k: int = 5, min_chars: int = 20, drop_empty: bool = True) -> DataFrame:
    """(query_id, doc_id, score, content, was_compressed, rank): of twice k hits the first k whose extract is not NO_OUTPUT and has min_chars characters; without drop_empty such hits keep their text."""
    rows = _with_content(search(queries, 2 * k), docs, queries).withColumnRenamed("rank", "first_rank")
    rows = rows.withColumn("short", F.trim(F.coalesce(extract(_prompt("Extrais les passages utiles, ou NO_OUTPUT.")), F.lit(""))))
    rows = rows.withColumn("was_compressed", ~F.col("short").contains("NO_OUTPUT") & (F.length("short") >= min_chars))
    rows = rows.where("was_compressed") if drop_empty else rows
    rows = rows.withColumn("content", F.when(F.col("was_compressed"), F.col("short")).otherwise(F.col("content")))
    return _ranked(rows, k, F.col("first_rank")).select("query_id", "doc_id", "score", "content", "was_compressed", "rank")


def corrective_retrieval(search: Retriever, docs: DataFrame, queries: DataFrame, evaluate: Generate, rewrite: Generate, k: int = 5, max_retries: int = 1, min_correct: int = 1, include_ambiguous: bool = True) -> DataFrame:
    """(query_id, doc_id, score, label, attempt, rank): hits that the evaluator calls correct, then ambiguous ones that are not among them.

    Questions with fewer than min_correct correct hits are rewritten and searched again, max_retries times at most.
    """
    now, graded = queries.select("query_id", "query"), []
    for attempt in range(max_retries + 1):
        hits = _with_content(search(now, 2 * k), docs, now)
        seen = hits.withColumn("label", quality_label(evaluate(_prompt("Ce document est-il correct, ambigu ou incorrect ?", document=F.substring("content", 1, 2000)))))
        graded.append(settled(seen.where("label != 'incorrect'").select("query_id", "doc_id", "score", "label", F.col("rank").alias("at"), F.lit(attempt).alias("attempt")), "graded"))
        if attempt == max_retries:
            break
        enough = reduce(DataFrame.unionByName, graded).where("label = 'correct'").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_correct)
        open_ = now.join(enough, "query_id", "left_anti")
        new = first_line(rewrite(_prompt("Réécris la question.", document=None)))
        now = settled(open_.select("query_id", F.coalesce(F.nullif(new, F.lit("")), "query").alias("query")), "rewritten")
        if not now.limit(1).count():
            break
    rows = reduce(DataFrame.unionByName, graded)
    correct = rows.where("label = 'correct'")
    if include_ambiguous:
        rows = correct.unionByName(rows.where("label = 'ambiguous'").join(correct.select("query_id", "doc_id").distinct(), ["query_id", "doc_id"], "left_anti"))
    else:
        rows = correct
    rows = _ranked(rows, k, F.when(F.col("label") == "correct", 0).otherwise(1), F.col("attempt"), F.col("at"), F.col("doc_id"))
    return rows.select("query_id", "doc_id", "score", "label", "attempt", "rank")


def adaptive_retrieval(search: Retriever, queries: DataFrame, decide: Generate, rephrase: Generate | None = None, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank, gate_decision, used_query): a gate decides for each question whether to search, to search with another wording, or not at all."""
    gated = queries.withColumn("gate_decision", gate_label(decide(_prompt("RETRIEVE, NO_RETRIEVE ou REPHRASE ?", document=None))))
    used = F.col("query") if rephrase is None else F.when(F.col("gate_decision") == "REPHRASE", F.coalesce(F.nullif(first_line(rephrase(_prompt("Reformule.", document=None))), F.lit("")), "query")).otherwise(F.col("query"))
    gated = settled(gated.withColumn("used_query", used).where("gate_decision != 'NO_RETRIEVE'").select("query_id", "gate_decision", "used_query"), "gated")
    return search(gated.select("query_id", F.col("used_query").alias("query")), k).join(gated, "query_id").select("query_id", "doc_id", "score", "rank", "gate_decision", "used_query")


def routed_retrieval(routes: Mapping[str, Retriever], queries: DataFrame, choose: Generate, descriptions: Mapping[str, str], default: str | None = None, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank, route_used): each question goes to the retriever that the model names; an unknown name means the default, the first."""
    if not routes:
        raise ValueError("at least one route is needed")
    if missing := set(routes) - set(descriptions):
        raise ValueError(f"routes without a description: {sorted(missing)}")
    if default is not None and default not in routes:
        raise ValueError(f"no route {default}")
    listed = "\n".join(f"- {n}: {descriptions[n]}" for n in routes)
    said = F.lower(first_line(choose(_prompt(f"Routes :\n{listed}\nRoute :", document=None))))
    name = F.lit(default or next(iter(routes)))
    for n in reversed(list(routes)):
        name = F.when(said.contains(n.lower()), n).otherwise(name)
    chosen = settled(queries.select("query_id", "query", name.alias("route_used")), "routed")
    found = [r(chosen.where(F.col("route_used") == n).select("query_id", "query"), k).select("query_id", "doc_id", "score", "rank", F.lit(n).alias("route_used")) for n, r in routes.items()]
    return reduce(DataFrame.unionByName, found)


def self_query(search_in: Callable[[DataFrame], Retriever], docs: DataFrame, queries: DataFrame, generate: Generate, k: int = 5) -> DataFrame:
    """(query_id, doc_id, score, rank, cleaned_query, applied_filters): the model gives a question's wording and its filters as JSON {cleaned_query, filters}; the filter comes first, then the search.

    Questions with equal filters share a plan, so there is one plan for each distinct set of filters. Answers without JSON mean no filter.
    """
    block = json_block(generate(_prompt("JSON :", document=None)))
    cleaned = F.coalesce(F.nullif(F.get_json_object(block, "$.cleaned_query"), F.lit("")), "query")
    parsed = settled(queries.select("query_id", cleaned.alias("query"), F.coalesce(F.get_json_object(block, "$.filters"), F.lit("{}")).alias("applied_filters")), "self-query")
    found = []
    for r in parsed.select("applied_filters").distinct().collect():
        rules = json.loads(r.applied_filters) or {}
        mine = parsed.where(F.col("applied_filters") == r.applied_filters)
        kept = filter_metadata(docs, rules, "self_query") if rules else docs
        found.append(search_in(kept)(mine.select("query_id", "query"), k).join(mine.withColumnRenamed("query", "cleaned_query"), "query_id"))
    if not found:
        return queries.sparkSession.createDataFrame([], "query_id bigint, doc_id bigint, score double, rank int, cleaned_query string, applied_filters string")
    return reduce(DataFrame.unionByName, found).select("query_id", "doc_id", "score", "rank", "cleaned_query", "applied_filters")


def flare(search: Retriever, docs: DataFrame, queries: DataFrame, draft: Generate, final: Generate, rounds: int = 8, k: int = 3, min_draft: int = 20) -> DataFrame:
    """(query_id, query, answer, source_ids, rounds): a sentence is drafted, searched for and written again with what was found, until the model says [DONE], concludes, or rounds are over."""
    done = r"(?i)\[done\]"
    now = queries.select("query_id", "query", F.lit("").alias("answer"), F.array().cast("array<string>").alias("source_ids"), F.lit(0).alias("rounds"))
    ended: list[DataFrame] = []
    for n in range(1, rounds + 1):
        said = F.concat(F.lit("Question : "), F.col("query"), F.lit("\nRéponse partielle : "), F.when(F.col("answer") == "", "(rien encore)").otherwise(F.col("answer")))
        now = settled(now.withColumn("draft", F.trim(F.coalesce(draft(said), F.lit("")))), "drafts")
        over = F.col("draft").rlike(done) | (F.col("draft") == "")
        ended.append(now.where(over).drop("draft"))
        open_ = now.where(~over)
        asked = open_.where(F.length("draft") >= min_draft).select("query_id", F.concat_ws("\n", "query", "draft").alias("query"))
        hits = settled(_with_content(search(asked, k), docs, asked), "found")
        written = open_.join(context(hits).withColumnRenamed("source_ids", "new_ids"), "query_id", "left")
        sentence = F.when(F.col("context").isNull(), F.col("draft")).otherwise(F.trim(F.coalesce(final(F.concat(said, F.lit("\nContexte :\n"), F.col("context"))), F.lit(""))))
        written = settled(written.withColumn("sentence", sentence), "sentences")
        stop = F.col("sentence").rlike(done) | (F.col("sentence") == "")
        ended.append(written.where(stop).select("query_id", "query", "answer", "source_ids", "rounds"))
        grown = written.where(~stop).select("query_id", "query", F.trim(F.concat_ws(" ", "answer", "sentence")).alias("answer"), F.array_distinct(F.concat("source_ids", F.coalesce("new_ids", F.array().cast("array<string>")))).alias("source_ids"), F.lit(n).alias("rounds"), F.lower("sentence").rlike("en conclusion|en résumé").alias("last"))
        ended.append(grown.where("last").drop("last"))
        now = grown.where("not last").drop("last")
        if not now.limit(1).count():
            break
    return reduce(DataFrame.unionByName, [*ended, now])
