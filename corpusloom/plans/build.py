"""Engines built from files and settings, their parts by name, and steps for workflows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.models import Generate
from ..functions.text import STOPWORDS
from ..operators import chunkers, evaluate
from ..operators.rerank import compress, drop_redundant, keyword_rerank
from ..sources.files import load_documents, load_docx, load_pdf_pages
from . import engine

CHUNKERS: dict[str, Callable[..., DataFrame]] = {
    "recursive": chunkers.recursive_chunks, "token": chunkers.token_windows, "word": chunkers.word_windows, "sentence": chunkers.sentence_chunks,
    "markdown": chunkers.markdown_chunks, "hierarchical": chunkers.hierarchical_chunks, "table": chunkers.table_chunks, "layout": chunkers.layout_chunks,
}


def chunker(name: str, **how) -> Callable[[DataFrame], DataFrame]:
    if name not in CHUNKERS:
        raise ValueError(f"no chunker {name}; there are {sorted(CHUNKERS)}")
    return partial(CHUNKERS[name], **how)


def tokenizer(use_default_stopwords: bool = True, stopwords: frozenset[str] = frozenset(), **how) -> dict[str, Any]:
    """Keywords of the token functions: the default stop words and more, or only the given ones."""
    return {"stopwords": (STOPWORDS if use_default_stopwords else frozenset()) | frozenset(stopwords), **how}


def model_rerank(hits: DataFrame, score: Callable[[Column, Column], Column], k: int = 5) -> DataFrame:
    """Hits (query_id, doc_id, rank, query, content) by a model's score of query and content (a pandas UDF around a cross-encoder or a service, say); ties keep their order."""
    scored = hits.withColumn("rerank_score", score(F.col("query"), F.col("content")).cast("double")).withColumnRenamed("rank", "first_rank")
    turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "first_rank"))
    return scored.withColumn("rank", turn).where(F.col("rank") <= k)


def reranker(kind: str | Callable[[Column, Column], Column] | None) -> Callable[[DataFrame, int], DataFrame]:
    """By name ("keyword", "none") or by the score function of a model."""
    if callable(kind):
        return lambda hits, k: model_rerank(hits, kind, k)
    if kind in (None, "none"):
        return lambda hits, k: hits.where(F.col("rank") <= k)
    if kind == "keyword":
        return keyword_rerank
    raise ValueError(f"no reranker {kind}")


def ingest(spark: SparkSession, path: str, chunk: Callable[[DataFrame], DataFrame] | None = None, pdf: bool = False, docx: bool = True, **how) -> DataFrame:
    """Chunks (doc_id, text, parent_doc_id, ...) of the text, HTML, DOCX and, with pdf, PDF files below a path or of one file."""
    docs = load_documents(spark, path, **how).select("doc_id", "text", "source")
    if docx:
        docs = docs.unionByName(load_docx(spark, path, **how).withColumn("source", F.lit(None).cast("string")))
    if pdf:
        docs = docs.unionByName(load_pdf_pages(spark, path, **how).drop("page", "metadata").withColumn("source", F.lit(None).cast("string")))
    made = (chunk or chunker("recursive"))(docs.select("doc_id", "text"))
    text = "content" if "content" in made.columns else "text"
    key = F.concat_ws("#", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return made.select(key.alias("doc_id"), F.col(text).alias("text"), F.col("doc_id").alias("parent_doc_id"), "chunk_index")


@dataclass(frozen=True)
class Engine:
    """Documents with settings; asking is a plan over all questions."""

    docs: DataFrame
    settings: engine.Settings = engine.PRESETS["simple"]
    search: engine.Retriever | None = None
    generate: Generate | None = None

    @classmethod
    def from_path(cls, spark: SparkSession, path: str, preset: str = "simple", chunk: Callable[[DataFrame], DataFrame] | None = None, **parts) -> Engine:
        return cls(ingest(spark, path, chunk), engine.preset(preset), **parts)

    @classmethod
    def from_config(cls, spark: SparkSession, config: dict[str, dict[str, Any]], **parts) -> Engine:
        """An engine of checked settings (see sources.tables.checked_config)."""
        c = dict(config.get("chunking", {}))
        name = c.pop("chunker", "recursive")
        sizes = {to: c[k] for k, to in (("chunk_size", "size"), ("chunk_overlap", "overlap"), ("min_chunk_size", "least")) if k in c}
        made = engine.PRESETS["simple"]
        r, q, z, g = (config.get(s, {}) for s in ("retrieval", "query", "compression", "generation"))
        changes = {"top_k": r.get("top_k"), "alpha": r.get("alpha"), "least_score": r.get("min_score"), "transform": q.get("transform"), "variants": q.get("variants"), "rerank_from": config.get("reranker", {}).get("candidates"), "redundancy": z.get("redundancy"), "compress": z.get("extractive"), **g}
        made = replace(made, **{k: v for k, v in changes.items() if v is not None})
        return cls(ingest(spark, config["index"]["source"], chunker(name, **sizes)), made, **parts)

    def ask(self, queries: DataFrame) -> DataFrame:
        return engine.ask(self.docs, queries, self.settings, self.search, self.generate)

    def retrieve(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        found = engine.retrieve(self.docs, queries, self.settings if k is None else replace(self.settings, top_k=k), self.search)
        return found.select("query_id", "doc_id", "score", "rank", "content")


def evaluate_pipeline(hits: DataFrame, qrels: DataFrame, queries: DataFrame, answers: DataFrame, k: int = 5) -> DataFrame:
    """One row with the means of the retrieval metrics of hits and of the generation metrics of answers (query, answer, context, source_ids)."""
    found = evaluate.summarise_retrieval(evaluate.evaluate_retrieval(hits, qrels, queries, k))
    names = ("citation_accuracy", "citation_coverage", "groundedness", "answer_relevance")
    said = evaluate.evaluate_generation(answers).agg(*[F.round(F.avg(n), 6).alias(n) for n in names])
    return found.crossJoin(said)  # one row each


# steps of a workflow: from the state, a dict of frames by name, to a frame


def function_step(f: Callable[..., Any], *inputs: str) -> Callable[[dict[str, Any]], Any]:
    """f of the named parts of the state; of the whole state if none is named."""
    return lambda state: f(*(state[n] for n in inputs)) if inputs else f(state)


def transform_step(settings: engine.Settings, queries: str = "queries") -> Callable[[dict[str, Any]], DataFrame]:
    """The forms of the questions as questions of their own: (query_id, query), query_id being that of the form and parent_id that of the question."""
    made = lambda q: engine.expand(q, settings).select(F.concat_ws("#", F.col("query_id").cast("string"), F.col("variant").cast("string")).alias("query_id"), F.col("query_id").alias("parent_id"), "query")
    return lambda state: made(state[queries])


def retrieve_step(search: engine.Retriever, docs: DataFrame, k: int = 5, queries: str = "queries") -> Callable[[dict[str, Any]], DataFrame]:
    def run(state):
        q = state[queries].select("query_id", "query")
        return search(q, k).join(q, "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")

    return run


def compress_step(hits: str = "hits", redundancy: bool = True) -> Callable[[dict[str, Any]], DataFrame]:
    def run(state):
        h = state[hits]
        if redundancy:
            h = h.join(drop_redundant(h).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        return compress(h).withColumn("content", F.col("compressed")).drop("compressed")

    return run


def generate_step(generate: Generate | None = None, hits: str = "hits", queries: str = "queries") -> Callable[[dict[str, Any]], DataFrame]:
    def run(state):
        rows = state[queries].select("query_id", "query").join(engine.context(state[hits]), "query_id", "left")
        prompt = F.concat(F.lit("Contexte:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nRéponse:"))
        return rows.withColumn("answer", generate(prompt) if generate else engine.extractive_answer(F.coalesce("context", F.lit(""))))

    return run
