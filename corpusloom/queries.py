"""Registered queries over the driver's tables, each with the DuckDB SQL for its rows where SQL can express it."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import citations as cite
from .functions import models
from .functions import text as tx
from .functions.routing import route
from .functions.vectors import cosine, dot
from .operators import chunkers, evaluate, filters, fusion, graph, rerank, search, sessions, structured, tree
from .plans import engine, federated, loops
from .sources import index
from .sources.store import settled
from .streaming import logs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# SQL fragments

_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOPWORDS))


def _words_sql(x: str) -> str:
    folded = f"strip_accents(lower(replace({x}, '’', '''')))"
    raw = f"list_transform(regexp_extract_all({folded}, '[\\p{{L}}\\p{{N}}_]+(?:[\\-''][\\p{{L}}\\p{{N}}_]+)*'), lambda a: regexp_replace(a, '^[_\\-'']+|[_\\-'']+$', '', 'g'))"
    flat = f"flatten(list_transform({raw}, lambda b: CASE WHEN regexp_matches(b, '[\\-'']') THEN list_concat([b], list_filter(string_split_regex(b, '[\\-'']+'), lambda p: p <> '')) ELSE [b] END))"
    return f"list_filter(list_transform({flat}, lambda c: regexp_replace(c, '^_+|_+$', '', 'g')), lambda d: d <> '' AND (length(d) >= 2 OR regexp_matches(d, '^\\p{{Nd}}+$')) AND d NOT IN ({_STOP}))"


def _tokens_sql(source: str, key: str, text: str, more: str = "") -> str:
    """Rows (key, w, t): words and words with pairs."""
    return f"SELECT {key}{more}, w, list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS t FROM (SELECT *, {_words_sql(text)} AS w FROM {source})"


_BM25 = f"""
d AS ({_tokens_sql('documents', 'doc_id', 'text')}),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(t) AS term FROM ({_tokens_sql('benchmark', 'item_id', 'text')})) GROUP BY ALL),
c AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM d),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS dl, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT doc_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5) / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) AS w FROM (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM tf), c),
bm AS (SELECT query_id, doc_id, round(sum(w * qtf), 6) AS score FROM w JOIN q USING (term) GROUP BY ALL),
bmk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm) WHERE rank <= 20)"""
_JACCARD = "CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b}))) ELSE 0.0 END"


def _ranked(spark: SparkSession, d: str, k: int = 20) -> DataFrame:
    return search.bm25_top_k(table(spark, d, "documents"), questions(spark, d), k)


def _with_text(hits: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return search.small(settled(hits, "hits")).join(questions(spark, d), "query_id").join(table(spark, d, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")


# sources

_HTML = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x},
 '<\s*script.*?>.*?<\s*/\s*script\s*>', ' ', 'gis'), '<\s*style.*?>.*?<\s*/\s*style\s*>', ' ', 'gis'), '<\s*(br|p|div|li|h[1-6]|tr)\b[^>]*>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'),
 '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9) || chr(13))"""


@query("html_to_text", "SELECT page_id, " + _HTML.format(x="html") + " AS text FROM pages")
def _(s, d):
    return table(s, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("text"))


_HEADING = "(?is)<h([1-6])\\b[^>]*>(.*?)</h[1-6]>"


@query(
    "html_sections",
    f"""WITH p AS (SELECT page_id, string_split(regexp_replace(coalesce(html, ''), '{_HEADING}', chr(1) || '\\0', 'g'), chr(1)) AS p FROM pages),
    h AS (SELECT page_id, i - 2 AS section, p[i] AS h FROM (SELECT page_id, p, unnest(range(2, len(p) + 1)) AS i FROM p WHERE len(p) > 1)),
    t AS (SELECT page_id, section::INT AS section, regexp_extract(h, '{_HEADING}', 1)::INT AS level, {_HTML.format(x=f"regexp_extract(h, '{_HEADING}', 2)")} AS title, {_HTML.format(x="h")} AS content FROM h)
    SELECT page_id, section, level, CASE WHEN title = '' THEN 'section' ELSE title END AS title, content FROM t WHERE content <> ''
    UNION ALL SELECT page_id, 0, 0, 'document', {_HTML.format(x="p[1]")} FROM p WHERE len(p) = 1 AND {_HTML.format(x="p[1]")} <> ''""",
)
def _(s, d):
    return chunkers.html_sections(table(s, d, "pages"))


@query("stable_file_ids", "SELECT page_id, 'file-' || substr(sha1(url), 1, 12) AS file_id FROM pages")
def _(s, d):
    from .sources.files import stable_id

    return table(s, d, "pages").select("page_id", stable_id(F.col("url")).alias("file_id"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS sha256, octet_length(encode(text))::BIGINT AS size_bytes FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size_bytes"))


@query(
    "manifest_diff",
    """WITH cur AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS now FROM documents WHERE doc_id % 11 <> 3),
    prev AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS before FROM documents WHERE doc_id % 7 <> 2)
    SELECT path, CASE WHEN now IS NULL THEN 'deleted' WHEN now = before THEN 'unchanged' ELSE 'changed' END AS status FROM cur FULL JOIN prev USING (path)""",
)
def _(s, d):
    t = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    now = t.where("doc_id % 11 != 3").select("path", F.sha2("text", 256).alias("sha256"))
    before = t.where("doc_id % 7 != 2").select("path", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return index.diff(now, before)


@query(
    "manifest_diff_all",
    """WITH cur AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS now FROM documents),
    prev AS (SELECT CASE WHEN doc_id % 7 = 2 THEN 'old-' ELSE '' END || doc_id AS path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS before FROM documents)
    SELECT path, CASE WHEN now IS NULL THEN 'deleted' WHEN before IS NULL OR now <> before THEN 'changed' ELSE 'unchanged' END AS status FROM cur FULL JOIN prev USING (path)""",
)
def _(s, d):
    """All documents on both sides: a renamed path stands for a deletion and an addition."""
    t = table(s, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), "text")
    path = F.concat(F.when(F.col("doc_id") % 7 == 2, "old-").otherwise(""), "path").alias("path")
    before = t.select(path, F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return index.diff(t.select("path", F.sha2("text", 256).alias("sha256")), before)


@query("index_statistics", "SELECT count(*) AS documents, count(DISTINCT source) AS files, sum(n_chars)::BIGINT AS total_bytes, 3 AS schema_version FROM documents")
def _(s, d):
    t = table(s, d, "documents")
    return index.inspect(t, t.select(F.col("source").alias("path"), F.col("n_chars").alias("size_bytes")))


@query(
    "index_upsert",
    "SELECT vec_id AS doc_id, CASE WHEN vec_id % 3 = 0 THEN label + 1000 ELSE label END AS label FROM embeddings UNION ALL SELECT vec_id + 1000000, label FROM embeddings WHERE vec_id % 3 = 1",
)
def _(s, d):
    t = table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")
    new = t.where("doc_id % 3 = 0").withColumn("label", F.col("label") + 1000).unionByName(t.where("doc_id % 3 = 1").withColumn("doc_id", F.col("doc_id") + 1000000))
    return index.upsert(t, new)


# text functions


@query("tokens", f"SELECT doc_id, len(w) AS n_words, len(t) AS n_tokens, len(list_distinct(t)) AS n_distinct, array_to_string(w, ' ') AS words FROM ({_tokens_sql('documents', 'doc_id', 'text')})")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", tx.words(F.col("text")).alias("w"))
    both = F.concat("w", tx.ngrams(F.col("w"), 2))
    return t.select("doc_id", F.size("w").alias("n_words"), F.size(both).alias("n_tokens"), F.size(F.array_distinct(both)).alias("n_distinct"), F.array_join("w", " ").alias("words"))


@query(
    "term_statistics",
    f"""WITH d AS ({_tokens_sql('documents', 'doc_id', 'text')}), n AS (SELECT count(*) AS n FROM d), f AS (SELECT term, count(*) AS df FROM (SELECT doc_id, unnest(list_distinct(t)) AS term FROM d) GROUP BY term)
    SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM f, n""",
)
def _(s, d):
    return search.term_statistics(table(s, d, "documents")).withColumn("idf", F.round("idf", 6))


_SENT = "list_filter(string_split(regexp_replace(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '([.!?。！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda z: trim(z) <> '')"


@query("sentences", f"SELECT doc_id, len(s) AS n, list_max(list_transform(s, lambda y: length(y))) AS longest, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {_SENT.format(x='text')} AS s FROM documents)")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", tx.sentences(F.col("text")).alias("s"))
    return t.select("doc_id", F.size("s").alias("n"), F.array_max(F.transform("s", F.length)).alias("longest"), F.md5(F.array_join("s", "|").cast("binary")).alias("digest"))


@query("token_estimate", "SELECT doc_id, greatest(1, round_even(length(text) / 4, 0))::INT AS tokens FROM documents")
def _(s, d):
    return table(s, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"))


def _distinct_sql(items: str) -> str:
    clean = f"list_filter(list_transform({items}, lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda y: y <> '')"
    return f"list_filter({clean}, lambda z, i: list_position(list_transform({clean}, lambda v: lower(v)), lower(z)) = i)"


_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_VARIANTS = _distinct_sql(f"[text, trim(regexp_replace({_FLAT}, '(?i)\\b(quel|quelle|quels|quelles|comment|pourquoi|est-ce que|what|how|why|which)\\b', '', 'g')), array_to_string(list_slice(regexp_extract_all(lower({_FLAT}), '[\\p{{L}}\\p{{N}}_]+'), 1, 12), ' ')]")
_WIDER = _distinct_sql("[text, 'contexte général ' || array_to_string(list_slice(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), 1, 10), ' ')]")


@query("query_variants", f"SELECT item_id AS query_id, array_to_string(list_slice({_VARIANTS}, 1, 4), '|') AS variants, array_to_string({_WIDER}, '|') AS step_back FROM benchmark")
def _(s, d):
    return questions(s, d).select("query_id", F.array_join(tx.query_variants(F.col("query")), "|").alias("variants"), F.array_join(tx.step_back(F.col("query")), "|").alias("step_back"))


@query("query_parts")
def _(s, d):
    return questions(s, d).select("query_id", F.array_join(tx.sub_queries(F.col("query")), "|").alias("parts"))


@query("routes")
def _(s, d):
    r = route(F.col("text"), ["qa", "summary", "sql", "analytics", "multi_step", "fallback"], {"qa": "facts of the corpus"})
    return table(s, d, "conversations").select("conv_id", "turn", r.alias("r")).select("conv_id", "turn", "r.*")


# chunkers


@query(
    "word_windows",
    """WITH w AS (SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents)
    SELECT doc_id, k::INT AS chunk_index, array_to_string(list_slice(w, k * 160 + 1, k * 160 + 200), ' ') AS content
    FROM (SELECT doc_id, w, unnest(range(0, greatest(ceil((len(w) - 200) / 160.0), 0)::BIGINT + 1)) AS k FROM w WHERE len(w) > 0)""",
)
def _(s, d):
    return chunkers.word_windows(table(s, d, "documents"))


@query(
    "sentence_windows",
    f"""WITH s AS (SELECT doc_id, {_SENT.format(x='text')} AS s FROM documents), c AS (SELECT doc_id, k::INT AS chunk_index, (k * 4)::INT AS sentence_start, array_to_string(list_slice(s, k * 4 + 1, k * 4 + 5), ' ') AS content
    FROM (SELECT doc_id, s, unnest(range(0, (len(s) - 1) // 4 + 1)) AS k FROM s WHERE len(s) > 0)) SELECT * FROM c WHERE length(content) >= 20""",
)
def _(s, d):
    return chunkers.sentence_chunks(table(s, d, "documents"))


@query(
    "sentence_contexts",
    f"""WITH s AS (SELECT doc_id, {_SENT.format(x='text')} AS s FROM documents)
    SELECT doc_id, i::INT AS i, greatest(i - 3, 0)::INT AS first, least(i + 3, len(s) - 1)::INT AS last, md5(array_to_string(list_slice(s, greatest(i - 3, 0) + 1, least(i + 3, len(s) - 1) + 1), ' ')) AS digest
    FROM (SELECT doc_id, s, unnest(range(0, len(s))) AS i FROM s)""",
)
def _(s, d):
    t = chunkers.sentence_contexts(table(s, d, "documents"))
    return t.select("doc_id", "i", "first", "last", F.md5(F.col("window").cast("binary")).alias("digest"))


@query(
    "token_windows",
    """WITH d AS (SELECT doc_id, text, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w, regexp_extract_all(text, '\\s+') AS s, CASE WHEN regexp_matches(text, '^\\s') THEN 1 ELSE 0 END AS l FROM documents),
    t AS (SELECT doc_id, text, len(w) AS n, i, length(w[i]) AS c, CASE WHEN i - 1 + l > 0 THEN length(s[i - 1 + l]) ELSE 0 END AS g FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)),
    p AS (SELECT doc_id, text, n, i, c, (sum(c + g) OVER (PARTITION BY doc_id ORDER BY i) - c)::INT AS a FROM t),
    b AS (SELECT doc_id, text, n, (i - 1) // 210 AS k, a FROM p WHERE (i - 1) % 210 = 0)
    SELECT b.doc_id, b.k::INT AS chunk_index, substr(b.text, b.a + 1, e.a + e.c - b.a) AS content, b.a AS "start", (e.a + e.c)::INT AS "end", b.doc_id || '#tok-' || b.k AS chunk_id
    FROM b JOIN p e ON e.doc_id = b.doc_id AND e.i = least(b.k * 210 + 250, b.n)""",
)
def _(s, d):
    return chunkers.token_windows(table(s, d, "documents"))


@query("recursive_chunks")
def _(s, d):
    return chunkers.recursive_chunks(table(s, d, "documents"))


@query("markdown_chunks")
def _(s, d):
    return chunkers.markdown_chunks(table(s, d, "documents"))


@query("hierarchical_chunks")
def _(s, d):
    return chunkers.hierarchical_chunks(table(s, d, "documents"))


@query("code_chunks")
def _(s, d):
    return chunkers.code_chunks(table(s, d, "documents"), "text")


@query("table_chunks")
def _(s, d):
    return chunkers.table_chunks(table(s, d, "documents"))


@query("layout_chunks")
def _(s, d):
    return chunkers.layout_chunks(table(s, d, "documents"))


def _embed_all(texts: list[str]) -> np.ndarray:
    from corpusloom.functions.vectors import hash_lists

    return hash_lists([t.lower().split() for t in texts], 64)


@query("semantic_chunks")
def _(s, d):
    return chunkers.semantic_chunks(table(s, d, "documents"), _embed_all, threshold=0.1)


@query(
    "percentile_breaks",
    """WITH x AS (SELECT label AS doc_id, vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT doc_id, row_number() OVER w - 1 AS i, round(1 - list_dot_product(v, lead(v) OVER w), 6) AS distance FROM x WINDOW w AS (PARTITION BY doc_id ORDER BY vec_id)),
    q AS (SELECT * FROM p WHERE distance IS NOT NULL), l AS (SELECT doc_id, quantile_cont(distance, 0.95) AS l FROM q GROUP BY doc_id) SELECT q.doc_id, i::BIGINT AS i, distance FROM q JOIN l USING (doc_id) WHERE distance > l""",
)
def _(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("label").orderBy("vec_id")
    t = table(s, d, "embeddings").select(F.col("label").alias("doc_id"), (F.row_number().over(w) - 1).cast("bigint").alias("i"), F.round(1 - dot(F.col("embedding"), F.lead("embedding").over(w)), 6).alias("distance"))
    return chunkers.percentile_cuts(t.where("distance IS NOT NULL"))


# search


@query("bm25_top_k", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bmk")
def _(s, d):
    return _ranked(s, d)


_DENSE = """v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM v a, v b)"""


@query("dense_top_k", f"WITH {_DENSE} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10")
def _(s, d):
    v = table(s, d, "embeddings")
    return search.dense_top_k(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")))


@query(
    "dense_filtered",
    """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_dot_product(a.v, b.v), 6) AS score FROM v a, v b WHERE b.label % 2 = 0)
    SELECT query_id, doc_id, round(1 / (1 + (1 - score)), 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 5""",
)
def _(s, d):
    v = table(s, d, "embeddings")
    q = v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    hits = search.dense_top_k(v.select(F.col("vec_id").alias("doc_id"), "label", F.col("embedding").alias("vector")), q, 5, F.col("label") % 2 == 0)
    return hits.withColumn("score", F.round(search.inverse_distance(1 - F.col("score")), 6))


@query("hybrid_search")
def _(s, d):
    docs = table(s, d, "documents")
    return engine.hybrid_retriever(docs, 0.5, 128)(questions(s, d), 10)


@query("min_max_scores", f"WITH {_BM25} SELECT query_id, doc_id, round(CASE WHEN max(score) OVER w - min(score) OVER w < 1e-12 THEN 0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END, 6) AS score FROM bm WINDOW w AS (PARTITION BY query_id)")
def _(s, d):
    return search.min_max(search.bm25(table(s, d, "documents"), questions(s, d)), "score").withColumn("score", F.round("score", 6))


@query("mmr")
def _(s, d):
    v = table(s, d, "embeddings")
    hits = QUERIES["dense_top_k"](s, d).drop("rank")
    return rerank.mmr(hits.join(v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id"))


@query(
    "cosine_neighbours",
    """SELECT vec_id, round(CASE WHEN sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(n, n)) > 1e-12 THEN greatest(-1.0, least(1.0, list_dot_product(v, n) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(n, n))))) ELSE 0 END, 6) AS cosine
    FROM (SELECT vec_id, embedding::DOUBLE[] AS v, lead(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS n FROM embeddings) WHERE n IS NOT NULL""",
)
def _(s, d):
    from pyspark.sql import Window as W

    t = table(s, d, "embeddings").select("vec_id", "embedding", F.lead("embedding").over(W.partitionBy("label").orderBy("vec_id")).alias("n"))
    return t.where("n IS NOT NULL").select("vec_id", F.round(cosine(F.col("embedding"), F.col("n")), 6).alias("cosine"))


# fusion

_KEYWORD = f""", kw AS (SELECT query_id, doc_id, score, rank AS first_rank, round({_JACCARD.format(a='qt', b='dt')}, 6) AS rerank_score FROM (SELECT bmk.*, x.t AS qt, d.t AS dt FROM bmk JOIN ({_tokens_sql('benchmark', 'item_id', 'text')}) x ON x.item_id = query_id JOIN d USING (doc_id))),
kwk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, first_rank) AS rank FROM kw) WHERE rank <= 10)"""


@query("keyword_rerank", f"WITH {_BM25}{_KEYWORD} SELECT query_id, doc_id, score, first_rank, rerank_score, rank FROM kwk")
def _(s, d):
    return rerank.keyword_rerank(_with_text(_ranked(s, d), s, d), 10).drop("query", "content")


def _lists(s: SparkSession, d: str) -> dict[str, DataFrame]:
    ranked = settled(_ranked(s, d), "ranked")
    by_words = rerank.keyword_rerank(_with_text(ranked, s, d), 10).select("query_id", "doc_id", F.col("rerank_score").alias("score"), "rank")
    return {"bm25": ranked, "keywords": by_words}


_TWO = _KEYWORD + ", l AS (SELECT query_id, doc_id, score, rank, 'bm25' AS list, 0 AS list_no FROM bmk UNION ALL SELECT query_id, doc_id, rerank_score, rank, 'keywords', 1 FROM kwk)"


def _rrf_sql(weight: str) -> str:
    return f"""WITH {_BM25}{_TWO}, f AS (SELECT query_id, doc_id, round(sum({weight} / (60 + rank)), 6) AS score, arg_min(score, list_no * 1000 + rank) AS original_score, array_to_string(list_sort(list(DISTINCT list)), ',') AS lists FROM l GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10"""


@query("reciprocal_rank_fusion", _rrf_sql("1.0"))
def _(s, d):
    return fusion.reciprocal_rank_fusion(_lists(s, d)).withColumn("lists", F.array_join("lists", ","))


@query("weighted_fusion", _rrf_sql("(CASE list WHEN 'bm25' THEN 0.3 ELSE 0.7 END)"))
def _(s, d):
    return fusion.reciprocal_rank_fusion(_lists(s, d), weights={"bm25": 0.3, "keywords": 0.7}).withColumn("lists", F.array_join("lists", ","))


@query("merge_variants", f"WITH {_BM25}{_TWO}, f AS (SELECT query_id, doc_id, max(score) AS score, array_to_string(list_sort(list(DISTINCT list)), ',') AS matched FROM l GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10")
def _(s, d):
    merged = fusion.merge_variants(fusion.tagged(_lists(s, d)), 10, "list")
    return merged.select("query_id", "doc_id", "score", F.array_join("matched_variants", ",").alias("matched"), "rank")


@query(
    "merge_step_back",
    f"""WITH {_BM25}{_KEYWORD}, b AS (SELECT query_id, doc_id, a.score AS s0, k.rerank_score AS s1 FROM (SELECT * FROM bmk WHERE rank > 3) a FULL JOIN kwk k USING (query_id, doc_id)),
    f AS (SELECT query_id, doc_id, coalesce(s0, s1) AS score, CASE WHEN s0 IS NOT NULL AND s1 IS NOT NULL THEN 'both' WHEN s0 IS NOT NULL THEN 'original' ELSE 'stepback' END AS origin FROM b)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE origin WHEN 'both' THEN 0 WHEN 'original' THEN 1 ELSE 2 END, score DESC, doc_id) AS rank FROM f) WHERE rank <= 10""",
)
def _(s, d):
    two = _lists(s, d)
    return fusion.merge_step_back(two["bm25"].where("rank > 3"), two["keywords"])


@query("merge_federated", f"WITH {_BM25}{_TWO}, f AS (SELECT query_id, list || ':' || doc_id AS doc_id, list AS source_name, round(score, 6) AS score FROM l) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS federated_rank FROM f) WHERE federated_rank <= 10")
def _(s, d):
    return fusion.merge_federated(_lists(s, d))


@query("parent_child", f"WITH {_BM25}, p AS (SELECT query_id, source AS parent_id, max(score) AS score, count(*) AS matched_child_count FROM bmk JOIN documents USING (doc_id) GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, parent_id) AS rank FROM p) WHERE rank <= 5")
def _(s, d):
    children = table(s, d, "documents").select("doc_id", F.col("source").alias("parent_id"))
    hits = _ranked(s, d).select("query_id", F.col("doc_id").cast("string").alias("doc_id"), "score")
    return fusion.to_parents(hits, children.withColumn("doc_id", F.col("doc_id").cast("string"))).drop("child_matches")


@query("min_score", f"WITH {_BM25} SELECT query_id, doc_id, score, rank FROM bmk WHERE score >= 20")
def _(s, d):
    return search.min_score(_ranked(s, d), 20.0)


# compression and grading


@query("drop_redundant")
def _(s, d):
    return rerank.drop_redundant(_with_text(_ranked(s, d), s, d))


_COVER = "len(list_intersect(z.t, q.t)) / len(list_distinct(q.t))"


@query(
    "compress",
    f"""WITH {_BM25}, r AS (SELECT query_id, doc_id FROM bmk WHERE rank <= 5),
    s AS (SELECT doc_id, s[i] AS s, i FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM (SELECT doc_id, {_SENT.format(x='text')} AS s FROM documents WHERE doc_id IN (SELECT doc_id FROM r)))),
    z AS ({_tokens_sql('(SELECT *, row_number() OVER () AS sid FROM s)', 'sid', 's', ', doc_id, s, i')}), qt AS ({_tokens_sql('benchmark', 'item_id', 'text')}),
    cc AS (SELECT query_id, r.doc_id, s, i, row_number() OVER (PARTITION BY query_id, r.doc_id ORDER BY CASE WHEN len(q.t) > 0 THEN {_COVER} ELSE 0 END DESC, i) AS p FROM r JOIN z USING (doc_id) JOIN qt q ON q.item_id = query_id WHERE length(s) >= 20),
    b AS (SELECT query_id, doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM cc WHERE p <= 3 GROUP BY ALL)
    SELECT query_id, doc_id, substr(coalesce(t, text), 1, 900) AS compressed, length(text)::INT AS original_chars, length(substr(coalesce(t, text), 1, 900))::INT AS compressed_chars FROM r JOIN documents USING (doc_id) LEFT JOIN b USING (query_id, doc_id)""",
)
def _(s, d):
    return rerank.compress(_with_text(_ranked(s, d, 5), s, d)).select("query_id", "doc_id", "compressed", "original_chars", "compressed_chars")


_TERMS = "list_distinct(list_filter(regexp_extract_all(lower({x}), '[A-Za-zÀ-ÖØ-öø-ÿ0-9_]{{3,}}'), lambda w: w NOT IN ('the','and','for','with','that','this','what','which','who','how','est','une','des','les','dans','pour','que','qui','quoi','comment','quelle','quel','quels','quelles','sur','avec','aux','du','de','la','le')))"


@query(
    "grade_retrieval",
    f"""WITH {_BM25}, g AS (SELECT query_id, {_TERMS.format(x="any_value(b.text)")} AS q, flatten(list({_TERMS.format(x="d0.text")})) AS t, max(score) AS best FROM bmk JOIN benchmark b ON b.item_id = query_id JOIN documents d0 ON d0.doc_id = bmk.doc_id WHERE rank <= 5 GROUP BY query_id),
    s AS (SELECT query_id, q, round(CASE WHEN len(q) = 0 THEN 1 ELSE greatest(len(list_intersect(q, t)) / len(q), least(greatest(best, 0), 1) * 0.5) END, 6) AS score FROM g)
    SELECT query_id, score, score >= 0.08 AS passed, CASE WHEN len(q) = 0 THEN 'empty_query_terms' WHEN score >= 0.08 THEN 'lexical_overlap' ELSE 'low_overlap' END AS reason FROM s""",
)
def _(s, d):
    return rerank.grade_retrieval(_with_text(_ranked(s, d, 5), s, d))


# predicates and access


@query("metadata_filter", "SELECT doc_id FROM documents WHERE lang IN ('en', 'fr') AND n_chars >= 500 AND n_chars < 3000 AND source <> 'src0' AND contains(text, 'th')")
def _(s, d):
    rules = {"lang": ["en", "fr"], "n_chars": {"$gte": 500, "$lt": 3000}, "source": {"$ne": "src0"}, "text": {"$contains": "th"}}
    return filters.filter_metadata(table(s, d, "documents"), rules).select("doc_id")


@query("self_query_filter", "SELECT doc_id FROM documents WHERE n_chars > 1000 AND lang IN ('de', 'es')")
def _(s, d):
    rules = {"tenant": {"$ne": "x"}, "n_chars": {"$gt": 1000, "$near": 3}, "lang": {"$in": ["de", "es"]}}
    return filters.filter_metadata(table(s, d, "documents"), rules, "self_query").select("doc_id")


_ACL = """SELECT doc_id, source AS tenant_id, lang AS collection_id, CASE doc_id % 6 WHEN 0 THEN 'public' WHEN 1 THEN 'internal' WHEN 2 THEN 'confidential' WHEN 3 THEN 'secret' WHEN 4 THEN 'odd' END AS classification FROM documents"""


@query(
    "access_control",
    f"""SELECT doc_id, CASE WHEN doc_id % 10 = 7 THEN 'user_explicitly_denied' WHEN doc_id % 10 = 8 THEN 'role_not_allowed' WHEN tenant_id NOT IN ('src0', 'src1', 'src2') THEN 'tenant_mismatch'
    WHEN collection_id NOT IN ('en', 'fr') THEN 'collection_mismatch' WHEN classification IN ('secret') THEN 'classification_too_high' ELSE 'allowed' END AS reason FROM ({_ACL})""",
)
def _(s, d):
    m = F.col("doc_id") % 6
    label = F.when(m == 0, "public").when(m == 1, "internal").when(m == 2, "confidential").when(m == 3, "secret").when(m == 4, "odd")
    t = table(s, d, "documents").select("doc_id", F.col("source").alias("tenant_id"), F.col("lang").alias("collection_id"), label.alias("classification"))
    t = t.withColumn("denied_users", F.when(F.col("doc_id") % 10 == 7, F.array(F.lit("ana")))).withColumn("allowed_roles", F.when(F.col("doc_id") % 10 == 8, F.array(F.lit("auditor"))))
    who = filters.Principal("ana", frozenset({"reader"}), frozenset({"src0", "src1", "src2"}), frozenset({"en", "fr"}), "confidential")
    return t.select("doc_id", filters.access_reason(t.schema, who, filters.Policy(collection_match=True)).alias("reason"))


@query("tenant_statistics", "SELECT source AS tenant_id, count(*) AS documents, array_to_string(list_sort(list(DISTINCT lang)), ',') AS collections FROM documents GROUP BY source")
def _(s, d):
    t = sessions.tenant_statistics(table(s, d, "documents").select(F.col("source").alias("tenant_id"), F.col("lang").alias("collection_id")))
    return t.withColumn("collections", F.array_join("collections", ","))


# evaluation and citations

_EVAL = f"""WITH {_BM25}, r AS (SELECT item_id AS query_id, doc_id, CASE WHEN contains(d.text, b.text) THEN 2.0 ELSE 1.0 END AS gain FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 40))),
h AS (SELECT b.query_id, b.rank, r.gain FROM bmk b JOIN r USING (query_id, doc_id) WHERE b.rank <= 10), hs AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seen FROM h),
p AS (SELECT query_id, count(*) AS nh, min(rank) AS first, sum((pow(2, gain) - 1) / log2(rank + 1)) AS dcg, sum(seen / rank) AS ap FROM hs GROUP BY query_id),
i AS (SELECT query_id, count(*) AS n, sum(CASE WHEN p <= 10 THEN (pow(2, gain) - 1) / log2(p + 1) END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY gain DESC, doc_id::VARCHAR) AS p FROM r) GROUP BY query_id),
e AS (SELECT b.item_id AS query_id, CASE WHEN nh > 0 THEN 1 ELSE 0 END AS hit, round(CASE WHEN first > 0 THEN 1.0 / first ELSE 0 END, 6) AS reciprocal_rank, round(coalesce(nh, 0) / 10, 6) AS precision,
round(CASE WHEN n > 0 THEN coalesce(nh, 0) / n ELSE 1 END, 6) AS recall, round(CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0 END, 6) AS ndcg, round(CASE WHEN n > 0 THEN coalesce(ap, 0) / least(n, 10) ELSE 0 END, 6) AS context_precision
FROM benchmark b LEFT JOIN i ON i.query_id = b.item_id LEFT JOIN p ON p.query_id = b.item_id)"""


def _evaluated(s: SparkSession, d: str) -> DataFrame:
    q, docs = questions(s, d), table(s, d, "documents").select("doc_id", "text")
    labels = settled(evaluate.labels_by_passage(docs, q), "labels")
    return evaluate.evaluate_retrieval(_ranked(s, d), labels, q, 10)


@query("evaluate_retrieval", _EVAL + " SELECT * FROM e")
def _(s, d):
    return _evaluated(s, d)


@query("evaluation_summary", _EVAL + " SELECT round(avg(hit), 6) AS hit, round(avg(reciprocal_rank), 6) AS reciprocal_rank, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(ndcg), 6) AS ndcg, round(avg(context_precision), 6) AS context_precision FROM e")
def _(s, d):
    return evaluate.summarise_retrieval(_evaluated(s, d))


_ANSWER = "text || ' [source: ' || conv_id || '] [Source: x' || (turn % 3) || ']'"


@query(
    "citations",
    f"""WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer, [conv_id::VARCHAR, 'x1', 'y'] AS known FROM conversations), c AS (SELECT *, list_transform(regexp_extract_all(answer, '(?i)\\[source:\\s*([^\\]]+)\\]', 1), lambda z: trim(z)) AS c FROM a)
    SELECT conv_id, turn, array_to_string(c, ',') AS cited, array_to_string(list_filter(c, lambda y: NOT list_contains(known, y)), ',') AS unknown, round(len(list_intersect(c, known)) / 3, 6) AS coverage,
    round(len(list_filter(c, lambda u: list_contains(known, u))) / len(c), 6) AS accuracy FROM c""",
)
def _(s, d):
    answer = F.concat("text", F.lit(" [source: "), F.col("conv_id").cast("string"), F.lit("] [Source: x"), (F.col("turn") % 3).cast("string"), F.lit("]"))
    t = table(s, d, "conversations").select("conv_id", "turn", answer.alias("a"), F.array(F.col("conv_id").cast("string"), F.lit("x1"), F.lit("y")).alias("k"))
    a, k = F.col("a"), F.col("k")
    return t.select("conv_id", "turn", F.array_join(cite.citations(a), ",").alias("cited"), F.array_join(cite.unknown_citations(a, k), ",").alias("unknown"), F.round(cite.citation_coverage(a, k), 6).alias("coverage"), F.round(cite.citation_accuracy(a, k), 6).alias("accuracy"))


@query(
    "evaluate_generation",
    f"""WITH t AS ({_tokens_sql('conversations', 'conv_id', 'text', ', turn, role')}), p AS (SELECT a.conv_id, a.turn, a.t AS ans, q.t AS qt FROM t a JOIN t q ON a.conv_id = q.conv_id AND q.turn = a.turn - 1 AND q.role = 'user' WHERE a.role = 'assistant')
    SELECT conv_id, turn, round(CASE WHEN len(ans) = 0 THEN 1 WHEN len(qt) = 0 THEN 0 ELSE len(list_intersect(ans, qt)) / len(list_distinct(ans)) END, 6) AS groundedness, round(CASE WHEN len(qt) = 0 THEN 1 ELSE len(list_intersect(ans, qt)) / len(list_distinct(qt)) END, 6) AS relevance FROM p""",
)
def _(s, d):
    t = table(s, d, "conversations")
    a, q = t.where("role = 'assistant'").alias("a"), t.where("role = 'user'").alias("q")
    p = a.join(q, (F.col("a.conv_id") == F.col("q.conv_id")) & (F.col("q.turn") == F.col("a.turn") - 1)).select("a.conv_id", "a.turn", F.col("a.text").alias("answer"), F.col("q.text").alias("query"), F.col("q.text").alias("context"), F.array().cast("array<string>").alias("source_ids"))
    return evaluate.evaluate_generation(p).select("conv_id", "turn", "groundedness", F.col("answer_relevance").alias("relevance"))


# sessions and feedback

_RATING = "CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'click' THEN 'positive' WHEN 'error' THEN 'negative' ELSE 'neutral' END"


def _feedback(s: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("event_type").isin("purchase", "click"), "Good").when(F.col("event_type") == "error", "down").otherwise("meh")
    ids = lambda *c: F.array(*[F.concat(F.lit("s"), x.cast("string")) for x in c])
    u, e = F.col("user_id"), F.col("event_id")
    return table(s, d, "events").select(e.alias("feedback_id"), sessions.rating(raw).alias("rating"), ids(u % 7, e % 11, u % 5).alias("correct_source_ids"), ids(e % 4, u % 3).alias("retrieved_source_ids"))


@query("feedback_summary", f"SELECT {_RATING} AS rating, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1")
def _(s, d):
    return sessions.feedback_summary(_feedback(s, d))


@query(
    "missing_sources",
    """WITH f AS (SELECT event_id, ['s' || (user_id % 7), 's' || (event_id % 11), 's' || (user_id % 5)] AS c, ['s' || (event_id % 4), 's' || (user_id % 3)] AS r FROM events),
    m AS (SELECT event_id, unnest(list_distinct(list_filter(c, lambda x: NOT list_contains(r, x)))) AS source_id FROM f) SELECT source_id, count(*) AS n FROM m GROUP BY 1 ORDER BY n DESC, source_id LIMIT 10""",
)
def _(s, d):
    return sessions.missing_sources(_feedback(s, d))


@query("last_turns", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS p FROM conversations) WHERE p <= 3")
def _(s, d):
    return sessions.last_turns(table(s, d, "conversations"), 3).select("conv_id", "turn", "role")


@query(
    "exchanges",
    """SELECT conv_id, turn, text AS question, answer FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'""",
)
def _(s, d):
    return sessions.exchanges(table(s, d, "conversations"))


_FOLLOW = "^(" + "|".join(tx.FOLLOW_UP) + ")"


@query(
    "standalone_queries",
    f"""WITH x AS (SELECT conv_id, turn, text AS question, coalesce(answer, '') AS a FROM (SELECT *, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS answer FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'),
    h AS (SELECT *, list('Utilisateur: ' || question || chr(10) || 'Assistant: ' || substr(a, 1, 500)) OVER v AS h, last_value(question) OVER v AS lq, last_value(a) OVER v AS la FROM x WINDOW v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING)),
    f AS (SELECT *, len(list_filter(string_split_regex(lower(trim(question)), '\\s+'), lambda w: w <> '')) <= 8 OR regexp_matches(lower(trim(question)), '{_FOLLOW}') OR regexp_matches(lower(trim(question)), ' ce document| ce contrat| cette clause| above| previous') AS is_follow_up FROM h)
    SELECT conv_id, turn, is_follow_up, CASE WHEN h IS NULL OR len(h) = 0 THEN question WHEN is_follow_up THEN array_to_string(h, chr(10)) || chr(10) || 'Question de suivi: ' || question
    ELSE 'Contexte conversationnel récent: utilisateur=' || lq || '; assistant=' || substr(la, 1, 300) || chr(10) || 'Question: ' || question END AS query FROM f""",
)
def _(s, d):
    return sessions.standalone_queries(table(s, d, "conversations"))


@query("usage_costs", "SELECT doc_id, greatest(1, round_even(length(text) / 4, 0))::INT AS prompt_tokens, 1 AS answer_tokens, round(greatest(1, round_even(length(text) / 4, 0)) / 1000 * 0.5 + 1 / 1000 * 1.5, 8) AS cost FROM documents")
def _(s, d):
    t = table(s, d, "documents").select("doc_id", F.col("text").alias("prompt"), F.lit("abcd").alias("answer"))
    return sessions.usage(t, 0.5, 1.5).select("doc_id", "prompt_tokens", "answer_tokens", "cost")


# graph and tree


@query("entities")
def _(s, d):
    return graph.entity_documents(table(s, d, "documents"))


@query("triples")
def _(s, d):
    return graph.triples(table(s, d, "documents"))


@query(
    "graph_reach",
    """WITH e AS (SELECT DISTINCT 'c' || o_custkey % 50 AS s, 'p' || o_orderkey % 97 AS o FROM orders), b AS (SELECT s AS a, o AS b FROM e UNION SELECT o, s FROM e), s0 AS (SELECT c_custkey AS query_id, 'c' || c_custkey % 50 AS entity FROM customer WHERE c_custkey <= 20),
    s1 AS (SELECT query_id, entity FROM s0 UNION SELECT query_id, b FROM s0 JOIN b ON entity = a), s2 AS (SELECT query_id, entity FROM s1 UNION SELECT query_id, b FROM s1 JOIN b ON entity = a) SELECT DISTINCT query_id, entity FROM s2""",
)
def _(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("s"), F.concat(F.lit("p"), F.col("o_orderkey") % 97).alias("o")).distinct()
    seeds = table(s, d, "customer").where("c_custkey <= 20").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), F.col("c_custkey") % 50).alias("entity"))
    return graph.reachable(o, seeds, 2)


@query(
    "graph_reach_all",
    """WITH e AS (SELECT 'c' || o_custkey AS s, 'p' || o_orderkey AS o FROM orders), b AS (SELECT s AS a, o AS b FROM e UNION SELECT o, s FROM e), s0 AS (SELECT c_custkey AS query_id, 'c' || c_custkey AS entity FROM customer),
    s1 AS (SELECT query_id, entity FROM s0 UNION SELECT query_id, b FROM s0 JOIN b ON entity = a), s2 AS (SELECT query_id, entity FROM s1 UNION SELECT query_id, b FROM s1 JOIN b ON entity = a) SELECT DISTINCT query_id, entity FROM s2""",
)
def _(s, d):
    o = table(s, d, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("s"), F.concat(F.lit("p"), "o_orderkey").alias("o"))
    seeds = table(s, d, "customer").select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("c"), "c_custkey").alias("entity"))
    return graph.reachable(o, seeds, 2)


@query("graph_hits")
def _(s, d):
    docs = table(s, d, "documents")
    seeds = graph.entity_documents(table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")).select(F.col("doc_id").alias("query_id"), "entity")
    return graph.graph_hits(graph.triples(docs), graph.entity_documents(docs), seeds)


def _central_sentences(parts: list[str]) -> str:
    """Of each part the sentence that shares most with the words of all parts, for its length; every word is read."""
    counts = Counter(w for p in parts for w in p.lower().split())

    def weight(sentence: str) -> float:
        words = set(sentence.lower().split())
        return sum(counts[w] for w in words) / len(words) ** 0.5

    split = [[x for x in re.split(r"(?<=[.!?])\s+|\n+", p) if x.strip()] for p in parts]
    return " ".join(max(x, key=weight) for x in split if x)


def _embed_one(text: str) -> np.ndarray:
    from corpusloom.functions.vectors import hash_terms

    return hash_terms(text.lower().split(), 64)


@query("summary_tree")
def _(s, d):
    embed = F.pandas_udf(lambda texts: texts.map(lambda t: _embed_one(t).tolist()), "array<float>")
    v = table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content")).withColumn("vector", embed("content"))
    return tree.summary_tree(v, _central_sentences, _embed_one).select("node_id", "level", "content", "child_ids")


# engines


@query("ask_simple")
def _(s, d):
    return engine.ask(table(s, d, "documents"), questions(s, d), search=lambda q, k: search.bm25_top_k(table(s, d, "documents"), q, k)).select("query_id", "answer", "source_ids", "check.grounded_score")


@query("ask_production")
def _(s, d):
    docs = table(s, d, "documents")
    return engine.ask(docs, questions(s, d), engine.preset("production"), search=lambda q, k: search.bm25_top_k(docs, q, k)).select("query_id", "answer", "source_ids")


@query("multi_hop")
def _(s, d):
    docs = table(s, d, "documents")
    return engine.multi_hop(docs, questions(s, d), lambda q, k: search.bm25_top_k(docs, q, k))


# loops with a scripted model: its answers depend on what the prompt holds


def _search(s: SparkSession, d: str) -> Callable[[DataFrame, int], DataFrame]:
    return lambda q, k: search.bm25_top_k(table(s, d, "documents"), q, k)


@query(
    "adaptive_retrieval",
    f"""WITH {_BM25}, g AS (SELECT item_id AS query_id, CASE WHEN contains(text, 'ei') THEN 'NO_RETRIEVE' ELSE 'RETRIEVE' END AS gate_decision, text AS used_query FROM benchmark)
    SELECT query_id, doc_id, score, rank, gate_decision, used_query FROM bmk JOIN g USING (query_id) WHERE rank <= 5 AND gate_decision <> 'NO_RETRIEVE'""",
)
def _(s, d):
    return loops.adaptive_retrieval(_search(s, d), questions(s, d), models.scripted_model({"ei": "NO_RETRIEVE"}, "RETRIEVE"))


@query(
    "routed_retrieval",
    f"""WITH {_BM25}{_KEYWORD}, ch AS (SELECT item_id AS query_id, contains(text, 'ou') AS k FROM benchmark)
    SELECT query_id, doc_id, score, rank, 'bm25' AS route_used FROM bmk JOIN ch USING (query_id) WHERE NOT k AND rank <= 5 UNION ALL SELECT query_id, doc_id, rerank_score, rank, 'keywords' FROM kwk JOIN ch USING (query_id) WHERE k AND rank <= 5""",
)
def _(s, d):
    def choose(prompt):
        return F.when(F.regexp_extract(prompt, "(?s)^Question : (.*)\\n\\nRoutes", 1).contains("ou"), "keywords").otherwise("bm25")

    two = _lists(s, d)
    routes = {n: federated.of_hits(h.select("query_id", "doc_id", "score", "rank")) for n, h in two.items()}
    return loops.routed_retrieval(routes, questions(s, d), choose, {"bm25": "by terms", "keywords": "by overlap"})


@query(
    "relevance_filter",
    f"""WITH {_BM25}, n AS (SELECT query_id, doc_id, score, CASE WHEN contains(d0.text, 'ção') OR n_chars % 3 = 0 THEN NULL WHEN contains(d0.text, 'the') THEN 'pertinent' ELSE 'partiellement pertinent' END AS label FROM bmk JOIN documents d0 USING (doc_id) WHERE rank <= 10)
    SELECT * FROM (SELECT query_id, doc_id, score, label, row_number() OVER (PARTITION BY query_id ORDER BY CASE label WHEN 'pertinent' THEN 0 ELSE 1 END, score DESC, doc_id) AS rank FROM n WHERE label IS NOT NULL) WHERE rank <= 5""",
)
def _(s, d):
    def note(prompt):
        text = F.regexp_extract(prompt, "(?s)\n\nDocument :\n(.*)\n\nDonne la pertinence", 1)
        label = F.when(text.contains("ção") | (F.length(text) % 3 == 0), "non pertinent").when(text.contains("the"), "pertinent").otherwise("partiel")
        return F.concat(F.lit("Pertinence: "), label)

    return loops.relevance_filter(_search(s, d), table(s, d, "documents"), questions(s, d), note).drop("note")


# streaming


@query("event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(round(value * 10000)::BIGINT) / 10000, 4) AS total FROM events GROUP BY ALL")
def _(s, d):
    return logs.event_windows(table(s, d, "events"))


@query("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM k GROUP BY user_id, k")
def _(s, d):
    return logs.sessions(table(s, d, "events"))


# guarded SQL: the same statement runs here through the guard and in DuckDB

SQL = {
    "sql_pricing_summary": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_extendedprice), 4) AS avg_price, count(*) AS n
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "sql_revenue_by_nation": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name""",
    "sql_top_orders": """SELECT o_orderkey, o_custkey, o_totalprice, rk FROM (SELECT o_orderkey, o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) t WHERE rk <= 3""",
    "sql_semi_anti": """SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""",
    "sql_set_operations": """(SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL (SELECT n_nationkey FROM nation EXCEPT SELECT s_nationkey FROM supplier)""",
    "sql_left_join_counts": """SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey""",
    "sql_running_total": """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders""",
    "sql_cte": """WITH big AS (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_partkey), top AS (SELECT l_partkey, q FROM big WHERE q > (SELECT avg(q) FROM big)) SELECT p_brand, count(*) AS n FROM top JOIN part ON l_partkey = p_partkey GROUP BY p_brand""",
    "sql_rollup": """SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)""",
    "sql_conditional": """SELECT o_orderpriority, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS finished, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY o_orderpriority""",
    "sql_recursive": """WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 25) SELECT n, n_name FROM t JOIN nation ON n - 1 = n_nationkey""",
    "sql_full_join": """SELECT coalesce(c_nationkey, s_nationkey) AS nation, c.n AS customers, s.n AS suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY s_nationkey) s ON c_nationkey = s_nationkey""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def _guarded(sql: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        return structured.run_sql(s, sql, structured.register(s, d, TABLES))

    return run


for _name, _sql in SQL.items():
    query(_name, _sql)(_guarded(_sql))

ASKED = {
    "ask_count": ("how many orders are there in orders?", "SELECT count(*) AS count FROM orders"),
    "ask_total": ("what is the total o_totalprice of orders?", "SELECT round(sum(o_totalprice), 2) AS total_o_totalprice FROM orders"),
    "ask_average": ("average s_acctbal of supplier", "SELECT round(avg(s_acctbal), 4) AS average_s_acctbal FROM supplier"),
}


def _asked(question: str) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        rows, _ = structured.ask(s, question, structured.register(s, d, TABLES))
        return rows.select(*[F.round(c, 4 if c.startswith("average") else 2).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])

    return run


for _name, (_question, _sql) in ASKED.items():
    query(_name, _sql)(_asked(_question))
