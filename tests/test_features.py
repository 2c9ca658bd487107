"""Ingestion, tables, records, tenants, federated questions and loops with scripted models, on small inputs."""

import json
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import models
from corpusloom.operators import tenants
from corpusloom.operators.filters import Principal
from corpusloom.operators.search import bm25_top_k
from corpusloom.plans import build, engine, federated, loops
from corpusloom.plans.workflow import Workflow
from corpusloom.sources import records, tables

DOCS = [(1, "sales grew in the north with new clients"), (2, "risk of late payment rose in the south"), (3, "the north office hired a sales manager"), (4, "weather report for the coast")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id bigint, text string").cache()


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(10, "sales in the north"), (11, "late payment risk"), (12, "hello")], "query_id bigint, query string").cache()


@pytest.fixture(scope="module")
def search(docs):
    return lambda q, k: bm25_top_k(docs, q, k)


def pairs(df):
    return {(r.query_id, r.doc_id) for r in df.collect()}


def test_parsers(spark):
    raw = '1. First item\n- second\n* FIRST ITEM\n\n  3) third\n'
    row = spark.createDataFrame([(raw, 'so {"a": {"b": 1}} there', "none", "NO retrieval", "Mostly INCORRECT")], "l string, j string, n string, g string, q string").select(
        models.listed_lines(F.col("l")).alias("l"), models.json_block(F.col("j")).alias("j"), models.json_block(F.col("n")).alias("n"), models.gate_label(F.col("g")).alias("g"), models.quality_label(F.col("q")).alias("q"),
        models.from_json_safe(models.json_safe(F.array(F.lit(1), F.lit(2))), "array<int>").alias("safe"),
    ).first()
    assert row.l == ["First item", "second", "third"] and json.loads(row.j) == {"a": {"b": 1}} and row.n is None
    assert (row.g, row.q, row.safe) == ("NO_RETRIEVE", "incorrect", [1, 2])
    made = spark.createDataFrame([("x",), (None,)], "p string").select(models.callable_model(lambda p: p + "!")(F.col("p")).alias("a"), models.static_model("k")(F.col("p")).alias("b")).collect()
    assert [(r.a, r.b) for r in made] == [("x!", "k"), (None, None)]


def test_relevance_filter_and_compression(docs, queries, search):
    note = models.scripted_model({"weather": "Pertinence: non pertinent", "sales manager": "Pertinence: partiel\nNote: about hiring", "grew": "Pertinence: pertinent\nNote: growth"}, "Pertinence: pertinent")
    rows = loops.relevance_filter(search, docs, queries, note, 2).where("query_id = 10").orderBy("rank").collect()
    assert [(r.doc_id, r.label) for r in rows] == [(1, "pertinent"), (3, "partiellement pertinent")] and rows[0].note == "growth"
    cut = loops.compress_with_model(search, docs, queries, models.scripted_model({"sales grew": "sales grew in the north", "hired": "NO_OUTPUT"}, "short"), 2)
    assert [(r.doc_id, r.content, r.was_compressed) for r in cut.where("query_id = 10").collect()] == [(1, "sales grew in the north", True)]


def test_corrective_retrieval(docs, queries, search):
    judge = models.scripted_model({"Question : rewritten sales": "correct", "late payment rose": "ambigu", "Question : late": "incorrect"}, "incorrect")
    rows = loops.corrective_retrieval(search, docs, queries, judge, models.scripted_model({"sales in the north": "rewritten sales\nmore", "late payment risk": ""}), k=2)
    rows = rows.collect()
    assert {(r.doc_id, r.label, r.attempt) for r in rows if r.query_id == 10} == {(1, "correct", 1), (3, "correct", 1)}
    # an ambiguous document that two attempts find is there for each
    assert sorted((r.doc_id, r.label, r.attempt, r["rank"]) for r in rows if r.query_id == 11) == [(2, "ambiguous", 0, 1), (2, "ambiguous", 1, 2)]
    assert not [r for r in rows if r.query_id == 12]


def test_gate_and_routes(docs, queries, search):
    rows = loops.adaptive_retrieval(search, queries, models.scripted_model({"hello": "NO_RETRIEVE", "late": "REPHRASE"}, "RETRIEVE"), models.static_model("weather coast"), 1)
    got = {r.query_id: (r.doc_id, r.gate_decision, r.used_query) for r in rows.collect()}
    assert got[11] == (4, "REPHRASE", "weather coast") and got[10][1] == "RETRIEVE" and set(got) == {10, 11}
    routes = {"all": search, "weather": federated.of_hits(docs.sparkSession.createDataFrame([(11, 4, 1.0, 1)], "query_id bigint, doc_id bigint, score double, rank int"))}
    rows = loops.routed_retrieval(routes, queries, models.scripted_model({"Question : late": "the WEATHER route"}, "nowhere"), {"all": "everything", "weather": "weather"}, k=1)
    assert {(r.query_id, r.doc_id, r.route_used) for r in rows.collect()} >= {(11, 4, "weather")} and {r.route_used for r in rows.where("query_id = 10").collect()} == {"all"}
    with pytest.raises(ValueError):
        loops.routed_retrieval(routes, queries, models.static_model("all"), {"all": "x"})


def test_self_query(docs, queries):
    answer = models.scripted_model({"late": 'Voici: {"cleaned_query": "payment", "filters": {"doc_id": {"$gt": 1}}}'}, "no json")
    rows = loops.self_query(lambda kept: lambda q, k: bm25_top_k(kept, q, k), docs, queries, answer, 3).collect()
    assert {(r.doc_id, r.cleaned_query) for r in rows if r.query_id == 11} == {(2, "payment")}
    assert {r.doc_id for r in rows if r.query_id == 10} == {1, 3}


def test_flare(docs, queries, search):
    draft = models.scripted_model({"grew. En conclusion": "[DONE]", "Question : sales": "sales grew in the north strongly", "Question : late": "[done]"}, "tiny")
    rows = {r.query_id: r for r in loops.flare(search, docs, queries, draft, models.static_model("It grew. En conclusion, yes."), rounds=3, k=1).collect()}
    assert rows[10].answer == "It grew. En conclusion, yes." and rows[10].source_ids == ["1"] and rows[10].rounds == 1
    assert rows[11].answer == "" and rows[12].answer == "tiny tiny tiny" and rows[12].rounds == 3 and len(rows) == 3


def test_federated(docs, queries, search):
    class Store:
        def retrieve(self, q, k):
            return search(q, k).join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")

    class Holder:
        retriever = Store()

    sources = {"store": Holder(), "wiki": lambda q: {"documents": ["a page"], "answer": "from wiki"}, "note": lambda q: "a remark"}
    rows = {r.query_id: r for r in federated.federated_ask(sources, queries, k=6).collect()}
    assert "store:1" in rows[10].source_ids and "note::answer" in rows[10].source_ids and "wiki:a page" in rows[12].source_ids
    assert "[wiki] from wiki" in rows[10].prompt and rows[10].sources_queried == ["store", "wiki", "note"]
    with pytest.raises(TypeError):
        federated.ask_source(3, queries, 1)


def test_tenants(spark, docs, queries):
    acl = docs.withColumn("tenant_id", F.lit("t1")).withColumn("denied_users", F.when(F.col("doc_id") == 1, "ana")).withColumn("allowed_roles", F.lit(""))
    assert dict(tenants.with_lists(acl).dtypes)["denied_users"] == "array<string>"
    r = tenants.Registry()
    r.add_collection("t1", "main", acl)
    r.add_collection("t1", "other", acl.limit(0))
    r.add_tenant("t2", enabled=False)
    ana = tenants.principal_of({"user_id": "ana", "roles": "reader", "tenant_ids": ["x"]})
    found = r.retrieve(lambda kept: lambda q, k: bm25_top_k(kept, q, k), queries, "t1", ana)
    assert pairs(found.where("query_id = 10")) == {(10, 3)} and found.select("collection_id").distinct().collect()[0][0] == "main"
    assert ana == Principal("ana", frozenset({"reader"}), frozenset({"x"}))  # asking does not widen it
    assert r.stats()["collection_count"] == 2
    with pytest.raises(PermissionError):
        r.find("t2")
    with pytest.raises(KeyError):
        r.find("t1", "none")


def test_ingest_and_ask(spark, queries, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("sales grew in the north. " * 60)
    (tmp_path / "sub" / "b.html").write_text("<h1>Risk</h1><p>late payment risk in the south</p>")
    (tmp_path / "bin.txt").write_bytes(b"a\0b")
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>hello from a letter</w:t></w:p></w:document>')
    chunks = build.ingest(spark, str(tmp_path), build.chunker("recursive", size=300, overlap=40))
    rows = chunks.collect()
    assert len({r.parent_doc_id for r in rows}) == 3 and len(rows) > 5
    e = build.Engine.from_config(spark, tables.checked_config({"index": {"source": str(tmp_path)}, "retrieval": {"top_k": 2, "alpha": 0.3}, "chunking": {"chunk_size": 300, "chunk_overlap": 40}}))
    answers = {r.query_id: r for r in e.ask(queries).collect()}
    assert "late payment" in answers[11].answer and len(answers[11].source_ids) == 2
    single = build.Engine.from_path(spark, str(tmp_path / "a.txt"), "vector")
    assert {r.query_id for r in single.retrieve(queries, 1).collect()} == {10, 11, 12}


def test_tables(spark, tmp_path):
    (tmp_path / "my sales.csv").write_text('client,"revenue (k)",note\nAna,10,"two\nlines"\nBo,2.5,\n')
    got = tables.csv_table(spark, str(tmp_path / "my sales.csv"))
    assert got.columns == ["client", "revenue_k", "note"] and spark.sql("SELECT sum(revenue_k) FROM my_sales").first()[0] == 12.5
    with sqlite3.connect(tmp_path / "x.db") as con:
        con.execute("CREATE TABLE t (a INTEGER, b TEXT, c REAL)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, None if i % 3 else f"n{i}", i / 2) for i in range(100)])
    df = tables.sqlite_table(spark, str(tmp_path / "x.db"), "t", 4)
    assert df.dtypes == [("a", "bigint"), ("b", "string"), ("c", "double")] and df.agg(F.sum("a"), F.sum("c"), F.count("b")).first() == (4950, 2475.0, 34)
    (tmp_path / "e.jsonl").write_text('{"query": "q1", "expected_doc_ids": ["a", "b"], "relevance": {"a": 3}}\n{"query": "q2", "expected": "c"}\n{"query": "q3"}\n')
    q, rels = tables.eval_set(spark, str(tmp_path / "e.jsonl"))
    assert q.count() == 3 and {(r.doc_id, r.gain) for r in rels.collect()} == {("a", 3.0), ("b", 1.0), ("c", 1.0)}


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{"retrieval": {"top_k": 3, "alpha": 1}}')
    assert tables.load_config(str(tmp_path / "c.json")) == {"retrieval": {"top_k": 3, "alpha": 1.0}}
    for bad in ({"x": {}}, {"retrieval": {"k": 1}}, {"retrieval": {"top_k": "3"}}, {"retrieval": {"alpha": 2.0}}, {"retrieval": {"top_k": True}}, {"chunking": {"chunk_size": 10, "chunk_overlap": 10}}):
        with pytest.raises(ValueError):
            tables.checked_config(bad)


def test_records(spark, tmp_path):
    answers = spark.createDataFrame([(1, "q", "a", ["d1"], "p" * 9, "good")], "query_id bigint, query string, answer string, source_ids array<string>, prompt string, rating string")
    for _ in range(2):
        records.log_feedback(answers, str(tmp_path / "fb"))
        records.log_traces(answers, str(tmp_path / "tr"))
    fb = spark.read.json(str(tmp_path / "fb"))
    assert fb.count() == 2 and fb.first().rating == "positive" and fb.first().retrieved_source_ids == ["d1"]
    assert spark.read.json(str(tmp_path / "tr")).first().prompt_chars == 9
    assert records.load_manifest(spark, str(tmp_path / "m")).count() == 0
    files = spark.createDataFrame([("a", "h", 3)], "path string, sha256 string, size_bytes bigint")
    records.save_manifest(files, str(tmp_path / "m"))
    assert records.load_manifest(spark, str(tmp_path / "m")).collect() == files.collect()
    with records.writer_lock(str(tmp_path / "lock")), pytest.raises(TimeoutError), records.writer_lock(str(tmp_path / "lock"), 0.1):
        pass
    with records.writer_lock(str(tmp_path / "lock"), 0.1):
        pass


def test_answer_cache(spark, tmp_path):
    now = [100.0]
    make = lambda m: m.select("key", F.upper("prompt").alias("payload"))
    cache = lambda **k: records.AnswerCache(spark, str(tmp_path / "cache"), "llm", k.pop("fingerprint", "m1"), "secret", 10, lambda: now[0], **k)
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id int, prompt string")
    c = cache()
    assert {(r.id, r.answer) for r in c.get_or_set(rows, "answer", make).collect()} == {(1, "A"), (2, "B"), (3, "A")}
    assert (c.hits, c.misses) == (0, 2)
    c.get_or_set(rows, "answer", make)
    assert (c.hits, c.misses) == (2, 2) and c.stats()["hit_rate"] == 0.5 and c.stats()["entries"] == 2
    assert cache(fingerprint="m2").get_or_set(rows, "answer", make).count() == 3
    row = spark.read.parquet(str(tmp_path / "cache")).first()
    assert records.verified("secret", f"{row.key}\0{row.payload}".encode(), row.signature) and not records.verified("other", b"x", row.signature)
    bad = records.AnswerCache(spark, str(tmp_path / "cache"), "llm", "m1", "wrong", 10, lambda: now[0])
    assert bad.live().count() == 0
    now[0] = 111.0
    assert c.live().count() == 0
    c.cleanup()
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 0


def test_workflow_steps(docs, queries, search):
    w = Workflow().add("hits", build.retrieve_step(search, docs, 2)).add("short", build.compress_step(), ("hits",)).add("answers", build.generate_step(hits="short"), ("short",))
    w.add("n", build.function_step(lambda a: a.count(), "answers"), ("answers",))
    out = w.run({"queries": queries})
    assert out["n"] == 3 and "sales" in out["answers"].where("query_id = 10").first().answer
    forms = build.transform_step(engine.preset("simple", transform="multi_query"))({"queries": queries})
    assert forms.columns == ["query_id", "parent_id", "query"] and forms.count() >= 3


def test_evaluation_and_rerankers(spark, docs, queries, search):
    hits = search(queries, 2)
    qrels = spark.createDataFrame([(10, "1", 1.0), (11, "2", 1.0)], "query_id bigint, doc_id string, gain double")
    answers = spark.createDataFrame([("sales", "sales grew [source: 1]", "sales grew", ["1"])], "query string, answer string, context string, source_ids array<string>")
    row = build.evaluate_pipeline(hits, qrels, queries.where("query_id < 12"), answers).first()
    assert row.hit == 1.0 and row.recall == 1.0 and row.citation_accuracy == 1.0 and row.groundedness == 1.0
    full = hits.join(queries, "query_id").join(docs.select("doc_id", F.col("text").alias("content")), "doc_id")
    best = build.reranker(lambda q, c: F.when(c.contains("manager"), 2.0).otherwise(1.0))(full, 1)
    assert pairs(best.where("query_id = 10")) == {(10, 3)}
    assert build.reranker("none")(full, 1).count() == build.reranker("keyword")(full, 1).count() == 2
    with pytest.raises(ValueError):
        build.reranker("other")
    assert "the" not in build.tokenizer(False, frozenset({"x"}))["stopwords"]


def test_graph_ask(spark, docs, queries, search):
    graph = spark.createDataFrame([(1, "Ana", "works with", "Bo"), (2, "Cy", "is", "Di")], "doc_id bigint, subject string, relation string, object string")
    rows = {r.query_id: r for r in federated.graph_ask(graph, search(queries, 2), docs, queries).collect()}
    assert rows[10].triples == ["Ana - works with - Bo"] and rows[12].triples == [] and rows[11].source_ids == ["2"]
