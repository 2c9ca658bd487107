"""Every registered query with SQL against DuckDB on the smallest tables; the others must give rows."""

import decimal
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from corpusloom.queries import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
EMPTY_ALLOWED = {"code_chunks", "table_chunks", "entities", "triples", "multi_hop"}


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, duck):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    res = duck.execute(ORACLES[name])
    named = [d[0] for d in res.description]
    assert sorted(named) == cols
    at = [named.index(c) for c in cols]
    assert got == sorted(repr([plain(r[i]) for i in at]) for r in res.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(name, spark):
    rows = QUERIES[name](spark, SF).collect()
    assert rows or name in EMPTY_ALLOWED


def test_tokens_without_text(spark):
    from pyspark.sql import functions as F

    from corpusloom.functions.text import tokens

    rows = spark.createDataFrame([(1, "Le chat noir dort"), (2, ""), (3, None)], "i int, t string").select("i", tokens(F.col("t")).alias("t")).orderBy("i").collect()
    assert rows[0].t == ["chat", "noir", "dort", "chat noir", "noir dort"]
    assert rows[1].t == [] and rows[2].t is None


def test_graph_covers_all_seeds(spark):
    """Every customer is a seed over whole keys, and hits over triples equal a walk by hand."""
    from pyspark.sql import functions as F

    from corpusloom.operators import graph

    customers = spark.read.parquet(f"{SF}/customer.parquet").count()
    assert QUERIES["graph_reach_all"](spark, SF).agg(F.countDistinct("query_id")).first()[0] == customers
    docs = spark.createDataFrame([(1, "Alice Martin met Bob Stone. Bob Stone works with Carol White."), (2, "Carol White met Dan Brown."), (3, "Eve Black met Fay Green."), (4, "nobody here")], "doc_id bigint, text string")
    triples, named = graph.triples(docs), graph.entity_documents(docs)
    seeds = spark.createDataFrame([(1, "bob stone"), (2, "eve black"), (3, "unknown")], "query_id bigint, entity string")
    near = {(r.s, r.o) for r in triples.collect()}
    for depth in (1, 2):
        want = set()
        for q, e in ((1, "bob stone"), (2, "eve black"), (3, "unknown")):
            seen = {e}
            for _ in range(depth):
                seen |= {b for a, b in near if a in seen} | {a for a, b in near if b in seen}
            want |= {(q, r.doc_id) for r in triples.collect() if r.s in seen or r.o in seen} | {(q, r.doc_id) for r in named.collect() if r.entity == e}
        assert {(r.query_id, r.doc_id) for r in graph.graph_hits(triples, named, seeds, depth).collect()} == want


def test_tree_groups_over_the_whole_level(spark):
    """2,400 nodes, more than one of the former blocks: each seed takes the nearest free nodes of all."""
    import numpy as np

    from corpusloom.operators.tree import summary_tree

    x = np.random.default_rng(6).normal(size=(2400, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = [f"{i:05d}" for i in range(len(x))]
    nodes = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in zip(ids, x, strict=True)], "doc_id string, content string, vector array<double>")
    rows = summary_tree(nodes, " ".join, lambda t: np.ones(4), levels=1).where("level = 1").collect()
    free, want = list(range(len(x))), set()
    while free:
        seed, rest = free[0], free[1:]
        near = sorted(rest, key=dict(zip(rest, -(x[rest] @ x[seed]), strict=True)).get)[:3]
        want.add(tuple(ids[i] for i in sorted([seed, *near])))
        free = [i for i in rest if i not in near]
    assert {tuple(r.child_ids) for r in rows} == want
    assert all(r.content == " ".join(f"t{c}" for c in r.child_ids) for r in rows)


def test_tree_reads_whole_documents(spark):
    texts = {str(r.doc_id): r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["summary_tree"](spark, SF).collect()
    assert {r.node_id: r.content for r in rows if r.level == 0} == texts
    assert sorted(c for r in rows if r.level == 1 for c in r.child_ids) == sorted(texts)


def test_windows_of_the_reference(spark):
    """Words 241 to 360 of the two best documents reach the next hop, four documents come per hop, a follow-up gets six exchanges."""
    from pyspark.sql import functions as F

    from corpusloom.operators.sessions import standalone_queries
    from corpusloom.plans.engine import multi_hop

    docs = spark.createDataFrame([(i, "x" * 300 + f" needle{i} " + "y" * 300) for i in range(1, 7)], "doc_id bigint, text string")
    asked = []

    def search(q, k):
        asked.append({r.query for r in q.select("query").collect()})
        return q.crossJoin(docs.select("doc_id", F.col("doc_id").cast("int").alias("rank"), F.lit(1.0).alias("score"))).where(F.col("rank") <= k).drop("query")

    hits = multi_hop(docs, spark.createDataFrame([(1, "what")], "query_id bigint, query string"), search).collect()
    assert sorted((r.hop, r.doc_id) for r in hits) == [(h, i) for h in (0, 1) for i in (1, 2, 3, 4)]
    (second,) = asked[1]
    assert second.index("needle1") < second.index("needle2") and "needle3" not in second
    turns = [(1, 2 * i + j, role, f"{'et ' if j == 0 else ''}t{i}") for i in range(9) for j, role in enumerate(("user", "assistant"))]
    rows = standalone_queries(spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")).orderBy("turn").collect()
    assert rows[-1].is_follow_up and [r.query.count("Utilisateur: ") for r in rows] == [0, 1, 2, 3, 4, 5, 6, 6, 6]


def test_manifest_diff_judges_all_documents(spark):
    ids = {str(r.doc_id) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    rows = QUERIES["manifest_diff_all"](spark, SF).collect()
    assert {r.path for r in rows if r.status != "deleted"} == ids
    assert {r.path for r in rows if r.status == "deleted"} == {f"old-{i}" for i in ids if int(i) % 7 == 2}


def test_tree_groups_by_rounds(spark, monkeypatch):
    """Rounds of a few rows, with equal and zero vectors whose lists run out: the same groups as by all products."""
    import numpy as np

    from corpusloom.operators import tree

    monkeypatch.setattr(tree, "LOCAL", 100)
    monkeypatch.setattr(tree, "HEAD", 300)
    monkeypatch.setattr(tree, "NEAREST", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[rng.choice(900, 300)] = x[0]
    x[rng.choice(900, 100)] = 0
    x[::9] = np.eye(8)[rng.integers(0, 8, len(x[::9]))]
    ids = [f"{i:05d}" for i in range(len(x))]
    nodes = spark.createDataFrame([(i, f"t{i}", v.tolist()) for i, v in zip(ids, x, strict=True)], "doc_id string, content string, vector array<float>")
    rows = tree.summary_tree(nodes, " ".join, lambda t: np.ones(8), levels=1).where("level = 1").collect()
    want: dict[int, list[str]] = {}
    for i, g in zip(ids, tree.greedy_groups(x, 4), strict=True):
        want.setdefault(g, []).append(i)
    assert {r.node_id: r.child_ids for r in rows} == {f"L1-{g}": c for g, c in want.items()}


def test_hash_lists_sums_each_list_alone():
    import hashlib

    import numpy as np

    from corpusloom.functions.vectors import hash_lists

    lists = [["a", "b", "a"], [], ["é"], ["x"] * 50]
    for terms, got in zip(lists, hash_lists(lists, 16), strict=True):
        v = np.zeros(16, np.float32)
        for t in [*terms, *(f"{a} {b}" for a, b in zip(terms, terms[1:], strict=False))]:
            d = hashlib.blake2b(t.encode(), digest_size=8).digest()
            v[int.from_bytes(d[:4], "little") % 16] += -1.0 if d[4] & 1 else 1.0
        assert (got == (v / np.linalg.norm(v) if v.any() else v)).all()
