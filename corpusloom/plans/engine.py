"""Retrieval pipelines over many questions: variants, retrieval, merge, score filter, compression, prompt, answer, citation check.

Everything is one lazy plan; an engine is a bundle of parameters and functions between frames.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..functions import citations
from ..functions.text import normalise_lines, query_variants, sentences, step_back, sub_queries
from ..functions.vectors import DIMENSION, hash_terms
from ..functions.text import tokens
from ..operators.fusion import merge_variants
from ..operators.rerank import compress, drop_redundant, grade_retrieval, keyword_rerank
from ..operators.search import Matches, bm25, dense_scores, hybrid_top_k, min_score, small, top_k
from ..sources.store import settled

Retriever = Callable[[DataFrame, int], DataFrame]
NO_ANSWER = "Je ne sais pas : aucun document pertinent n'a été trouvé."


@dataclass(frozen=True)
class Settings:
    """Parameters of a pipeline; transform is none, multi_query, step_back or decompose."""

    top_k: int = 5
    alpha: float = 0.45
    transform: str = "none"
    variants: int = 4
    rerank_from: int | None = None
    least_score: float | None = None
    redundancy: bool = False
    compress: bool = False
    strict: bool = False
    require_citations: bool = False
    policy: tuple | None = field(default=None)


PRESETS = {
    "simple": Settings(),
    "vector": Settings(alpha=1.0),
    "strict": Settings(least_score=0.05, strict=True, require_citations=True),
    "production": Settings(top_k=6, alpha=0.55, transform="multi_query", rerank_from=40, least_score=0.03, redundancy=True, compress=True),
}


def preset(name: str, **changes) -> Settings:
    if name not in PRESETS:
        raise ValueError(f"no preset {name}; there are {sorted(PRESETS)}")
    return replace(PRESETS[name], **changes)


def embed_frame(rows: DataFrame, text: str, name: str, dimension: int = DIMENSION) -> DataFrame:
    """rows with the hashing embedding of a text column; Arrow batches pass through once."""
    made = rows.withColumn(name, tokens(F.coalesce(F.col(text), F.lit(""))))

    def run(batches):
        for b in batches:
            at = b.schema.get_field_index(name)
            vectors = [hash_terms(t or [], dimension) for t in b.column(at).to_pylist()]
            yield b.set_column(at, name, pa.array(vectors, pa.list_(pa.float32())))

    kinds = [T.StructField(name, T.ArrayType(T.FloatType())) if f.name == name else f for f in made.schema.fields]
    return made.mapInArrow(run, T.StructType(kinds))


def hybrid_retriever(docs: DataFrame, alpha: float = 0.45, dimension: int = DIMENSION, keep: DataFrame | None = None) -> Retriever:
    """Search over docs (doc_id, text) with hashing embeddings and BM25."""
    vectors = embed_frame(docs, "text", "vector", dimension).select("doc_id", "vector")

    def run(queries: DataFrame, k: int) -> DataFrame:
        q = embed_frame(queries, "query", "query_vector", dimension)
        if alpha < 1 and queries.groupBy("query_id").count().where("count > 1").isEmpty():
            found = Matches.of(docs, queries, dimension=dimension)
            if found is not None:
                return found.hybrid(q, k, alpha, keep)
        dense = dense_scores(vectors, q)
        if alpha >= 1:
            return top_k(dense if keep is None else dense.join(keep, "doc_id", "left_semi"), k)
        return hybrid_top_k(dense, bm25(docs, queries), k, alpha, keep)

    return run


def hypothetical_retriever(vectors: DataFrame, hypotheses: DataFrame, k: int) -> DataFrame:
    """Search by the mean vector of a query's hypothetical answers (query_id, hypothesis)."""
    from ..functions.vectors import mean_vector

    q = mean_vector(embed_frame(hypotheses, "hypothesis", "v").select("query_id", "v"), ["query_id"], "v")
    return top_k(dense_scores(vectors, q.withColumnRenamed("v", "query_vector")), k)


def expand(queries: DataFrame, settings: Settings) -> DataFrame:
    """(query_id, variant, query): the forms of each question that are searched."""
    q = F.col("query")
    made = {"none": F.array(q), "multi_query": query_variants(q, settings.variants), "step_back": step_back(q), "decompose": sub_queries(q, settings.variants)}[settings.transform]
    return queries.select("query_id", F.posexplode(made).alias("variant", "query"))


def retrieve(docs: DataFrame, queries: DataFrame, settings: Settings, search: Retriever | None = None) -> DataFrame:
    """Hits (query_id, doc_id, score, rank, query, content) after variants, merge, reranking, score filter and compression."""
    search = search or hybrid_retriever(docs, settings.alpha)
    first = max(30, settings.top_k) if settings.rerank_from is None else settings.rerank_from
    if settings.transform == "none":
        hits = search(queries.select("query_id", "query"), first if settings.rerank_from else settings.top_k)
    else:
        forms = expand(queries, settings).withColumn("q2", F.concat_ws("\u0001", F.col("query_id").cast("string"), F.col("variant").cast("string")))
        found = search(forms.select(F.col("q2").alias("query_id"), "query"), first).select(F.col("query_id").alias("q2"), "doc_id", "score")
        hits = merge_variants(found.join(forms.select("q2", "query_id"), "q2"), first if settings.rerank_from else settings.top_k)
    hits = small(settled(hits, "hits"))
    hits = hits.join(queries.select("query_id", "query"), "query_id").join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content")), "doc_id")
    if settings.rerank_from:
        hits = keyword_rerank(hits, settings.top_k).withColumn("score", F.col("rerank_score"))
    if settings.least_score is not None:
        hits = min_score(hits, settings.least_score)
    if settings.redundancy:
        hits = hits.join(drop_redundant(hits).select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
    if settings.compress:
        hits = compress(hits).withColumn("content", F.col("compressed")).drop("compressed")
    return hits


def context(hits: DataFrame) -> DataFrame:
    """(query_id, context, source_ids): hits in rank order, each under its source line."""
    part = F.concat(F.lit("[source: "), F.col("doc_id").cast("string"), F.lit("]\n"), F.col("content"))
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("p"), F.col("doc_id").cast("string").alias("d")))).alias("h"))
    return rows.select("query_id", F.array_join(F.transform("h", lambda x: x["p"]), "\n\n---\n\n").alias("context"), F.transform("h", lambda x: x["d"]).alias("source_ids"))


def extractive_answer(ctx: Column, most: int = 1200) -> Column:
    """The first four lines of a context that are no questions."""
    lines = F.filter(F.transform(F.split(normalise_lines(ctx), "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.endswith("?"))
    return F.substring(F.array_join(F.slice(lines, 1, 4), "\n"), 1, most)


def ask(docs: DataFrame, queries: DataFrame, settings: Settings = PRESETS["simple"], search: Retriever | None = None, generate: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per question: (query_id, query, answer, source_ids, prompt, check), check being the citation validation.

    generate makes an answer column of the prompt column (a pandas UDF around a model, say); without it the answer is extractive.
    """
    found = queries.join(context(retrieve(docs, queries, settings, search)), "query_id", "left")
    ids = F.coalesce("source_ids", F.array().cast("array<string>"))
    prompt = F.concat(F.lit("Contexte:\n"), F.coalesce("context", F.lit("")), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nRéponse:"))
    answer = generate(F.col("prompt")) if generate else extractive_answer(F.coalesce("context", F.lit("")))
    if settings.strict:
        answer = F.when(F.size(ids) == 0, NO_ANSWER).otherwise(answer)
    rows = found.withColumn("prompt", prompt).withColumn("source_ids", ids).withColumn("answer", answer)
    return rows.withColumn("check", citations.validate(F.col("answer"), F.col("source_ids"), settings.require_citations)).select("query_id", "query", "answer", "source_ids", "prompt", "check")


def corrective(attempts: list[DataFrame], least: float = 0.08) -> DataFrame:
    """Of several attempts (hits with query and content), each question's first that passes the grade, else its first."""
    graded = [grade_retrieval(a, least).withColumn("attempt", F.lit(i)) for i, a in enumerate(attempts)]
    every = graded[0]
    for g in graded[1:]:
        every = every.unionByName(g)
    best = every.groupBy("query_id").agg(F.min(F.struct((~F.col("passed")).alias("failed"), "attempt")).alias("b")).select("query_id", F.col("b.attempt").alias("attempt"), (~F.col("b.failed")).alias("passed"))
    hits = attempts[0].withColumn("attempt", F.lit(0))
    for i, a in enumerate(attempts[1:], 1):
        hits = hits.unionByName(a.withColumn("attempt", F.lit(i)), allowMissingColumns=True)
    return hits.join(best, ["query_id", "attempt"])


def multi_hop(docs: DataFrame, queries: DataFrame, search: Retriever, hops: int = 2, k: int = 4, snippets: int = 3, most: int = 700) -> DataFrame:
    """Hits of all hops (query_id, hop, doc_id, score, rank); from the second on, the question carries the last snippets found so far: 360 characters of the two best documents of a hop. One batched search per hop."""
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    now, out, seen = queries.select("query_id", "query"), None, None
    for hop in range(hops):
        # the next hop asks with what this one found, so that a search that is made again would double with each hop
        hits = settled(search(now, k).withColumn("hop", F.lit(hop)).select("query_id", "hop", "doc_id", "score", "rank"), "hits")
        out = hits if out is None else out.unionByName(hits)
        if hop == hops - 1:
            break
        found = small(hits.where("rank <= 2")).join(text, "doc_id").select("query_id", "hop", "rank", F.substring("content", 1, 360).alias("s"))
        seen = found if seen is None else seen.unionByName(found)
        turn = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("hop"), F.desc("rank")))
        best = seen.withColumn("t", turn).where(F.col("t") <= snippets).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("t"), "s"))), lambda x: x["s"]), " ").alias("e"))
        now = queries.join(settled(best, "snippets"), "query_id", "left").select("query_id", F.concat_ws("\nÉléments: ", "query", F.substring("e", 1, most)).alias("query"))
    return out


def first_sentence(text: Column) -> Column:
    return F.coalesce(F.try_element_at(sentences(text), F.lit(1)), F.lit(""))
