"""Steps that must not grow faster than their input, against the plain way to do the same."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import evaluate, graph, nearest, search


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def texts(spark):
    rng = np.random.default_rng(5)
    some = ["alpha", "béta", "gamma", "l'eau", "semi-dur", "delta", "x1", "the", "de"]
    rows = [(i, " ".join(rng.choice(some, rng.integers(0, 30)))) for i in range(300)] + [(300, None), (301, ""), (302, "Alpha alpha ALPHA"), (None, "alpha gamma")]
    asked = [(1, "alpha beta gamma"), (2, "l'eau semi-dur"), (3, None), (4, "zz nothing"), (5, "alpha alpha"), (None, "delta x1"), (6, "gamma"), (6, "delta gamma")]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(asked, "query_id bigint, query string")


def same(a, b) -> None:
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


@pytest.mark.parametrize("n", [1, 2, 3])
def test_bm25_scores_documents_whole(texts, n):
    """No pair of query and document is shuffled, and the scores are those of the joins."""
    docs, queries = texts
    got, want = search.bm25(docs, queries, ngram_max=n), search._bm25_by_joins(docs, queries, ngram_max=n)
    assert n > 2 or "Exchange" not in plan(got)
    same(got, want)
    same(search.bm25_top_k(docs, queries, 7, ngram_max=n), search.top_k(want, 7))


def test_bm25_of_repeated_ids_and_of_nothing(texts, monkeypatch):
    docs, queries = texts
    twice = docs.unionByName(docs.where("doc_id < 20"))
    same(search.bm25(twice, queries), search._bm25_by_joins(twice, queries))
    assert search.bm25(docs.limit(0), queries).isEmpty() and search.bm25(docs, queries.limit(0)).isEmpty() and search.bm25_top_k(docs, queries.limit(0), 3).isEmpty()
    want = search.bm25(docs, queries).collect()
    monkeypatch.setattr(search, "BROADCAST_QUERIES", 3)
    assert sorted(map(str, search.bm25(docs, queries).collect())) == sorted(map(str, want))


@pytest.mark.parametrize("alpha", [0.0, 0.4])
def test_hybrid_makes_no_row_for_each_pair(texts, alpha):
    """Both scores of a document are made together; the result is that of the joined frames, with and without a filter."""
    from corpusloom.plans.engine import embed_frame, hybrid_retriever

    docs, queries = texts[0].where("doc_id is not null"), texts[1].where("query_id < 6")
    dense = search.dense_scores(embed_frame(docs, "text", "vector", 32).select("doc_id", "vector"), embed_frame(queries, "query", "query_vector", 32))
    for keep in (None, docs.where("doc_id % 3 = 0").select("doc_id")):
        got = hybrid_retriever(docs, alpha, 32, keep)(queries, 6)
        assert "SortMergeJoin [query_id" not in plan(got)
        same(got, search.hybrid_top_k(dense, search.bm25(docs, queries), 6, alpha, keep).select(*got.columns))


def test_dense_top_k_shuffles_no_vectors(spark):
    """The vectors are in no plan, ties go by doc_id, and the scores are all products."""
    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, size=(500, 6)).astype(float)
    v = spark.createDataFrame([(f"d{i:03d}", r.tolist()) for i, r in enumerate(x)], "doc_id string, vector array<double>")
    q = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x[:40] / 3)], "query_id int, query_vector array<double>")
    got = search.dense_top_k(v, q, 9)
    assert "CoGroup" not in plan(got)
    same(got, search.top_k(search.dense_scores(v, q), 9))
    assert search.dense_top_k(v.limit(0), q, 3).isEmpty()
    same(search.dense_top_k(v, q, 600), search.top_k(search.dense_scores(v, q), 600))


def test_nearest_keeps_rows_that_single_precision_confuses(spark):
    x = np.ones((300, 4)) + np.arange(300)[:, None] * 1e-9
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "row bigint, vector array<double>")
    near, _ = nearest.nearest(nearest.stored(v, ["row"], "row"), np.ones((1, 4)), np.array([5]), np.packbits(np.ones(300, bool)))
    assert near[0].tolist() == [299, 298, 297, 296, 295]


def test_names_of_a_long_text_are_made_once(spark):
    """4,000 names: their work grew with the square of their number."""
    names = [f"Ab{i % 2000:04d}x" for i in range(4000)]
    docs = spark.createDataFrame([(i, ", ".join(names)) for i in range(8)], "doc_id int, text string")
    began = time.time()
    rows = graph.entity_documents(docs).collect()
    assert time.time() - began < 20
    assert {r.entity for r in rows} == {n.lower() for n in names[:20]} and len(rows) == 160


def test_graph_hits_makes_triples_once(spark):
    docs = spark.createDataFrame([(1, "Ann works with Bob. Carl likes Dora and Emil")], "doc_id int, text string")
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(i):
        reads.add(1)
        return i

    triples = graph.triples(docs).withColumn("doc_id", counted.asNondeterministic()("doc_id"))
    n = graph.triples(docs).count()
    seeds = spark.createDataFrame([(7, "bob")], "query_id int, entity string")
    assert [r.doc_id for r in graph.graph_hits(triples, graph.entity_documents(docs), seeds).collect()] == [1]
    assert reads.value == n


def test_labels_read_each_text_once(spark):
    """No join of all documents with all queries; passages at both ends, over several texts, in part only, short ones and none."""
    long = "Éa passage of words that is longer than forty characters, really"
    asked = [(1, long), (2, "short"), (3, None), (4, "é" * 8), (5, long[:40] + " but not so"), (6, "the end of one and start")]
    texts = ["xx" + long, long, long[:45], "a short one", None, "", "é" * 9, "é" * 7, "the end of one", " and start", "the end of one and start" * 2]
    docs = spark.createDataFrame(list(enumerate(texts * 3)), "doc_id int, text string").coalesce(1)
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = queries.join(docs, F.col("text").contains(F.substring("query", 1, 40))).select("query_id", "doc_id", F.when(F.col("text").contains(F.col("query")), 2.0).otherwise(1.0).alias("gain"))
    got = evaluate.labels_by_passage(docs, queries)
    same(got, want)
    assert "NestedLoop" not in plan(evaluate.labels_by_passage(docs, queries.where("query_id in (1, 5, 6)")))
    same(evaluate.labels_by_passage(docs, queries.where("query_id = 2")), want.where("query_id = 2"))


def test_multi_hop_searches_once_for_each_hop(spark):
    from corpusloom.plans.engine import multi_hop

    runs = spark.sparkContext.accumulator(0)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id int, text string")

    @F.udf("double")
    def counted(i):
        runs.add(1)
        return 1.0

    def search_all(q, k):
        return q.crossJoin(docs).select("query_id", "doc_id", counted.asNondeterministic()("doc_id").alias("score"), (F.col("doc_id") + 1).alias("rank")).where(F.col("rank") <= k)

    rows = multi_hop(docs, spark.createDataFrame([(1, "what")], "query_id int, query string"), search_all, hops=3).collect()
    assert len(rows) == 12 and runs.value == 12
