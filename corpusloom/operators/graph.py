"""Knowledge graph of entities and relations, and its expansion."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalise_lines
from ..sources.store import settled
from .search import small

_CAP, _REST = "A-ZÀ-ÖØ-Þ", r"[\wÀ-ÿ&']*"
ENTITY = rf"(?U)\b[{_CAP}]{_REST}(?:[ -][{_CAP}0-9]{_REST}){{0,4}}\b"
NOT_ENTITIES = ["Le", "La", "Les", "Un", "Une", "Des", "The", "This", "That", "Question", "Contexte", "Résumé", "Resume"]
_EDGE = r"""^[ ,;:.!?()\[\]{}"']+|[ ,;:.!?()\[\]{}"']+$"""


def clean(entity: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(entity, _EDGE, ""), r"\s+", " ")
    return F.substring(F.regexp_replace(t, r"(?iU)\s+(est|sont|is|are|contient|inclut|includes|contains)\b.*$", ""), 1, 80)


def key(entity: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(entity)), r"\s+", " ")


def entities(text: Column, most: int = 20) -> Column:
    """Capitalised names of up to five words, each once whatever its case, in order. Native."""
    found = F.transform(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)), clean)
    found = F.filter(found, lambda x: (F.length(x) >= 2) & ~x.isin(NOT_ENTITIES))

    def once(found: Column, keys: Column) -> Column:
        return F.transform(F.slice(F.array_distinct(keys), 1, most), lambda k: F.get(found, (F.array_position(keys, k) - 1).cast("int")))

    # as lambdas' arguments the names and their keys are made once, not again for each name
    return _given(found, lambda names: _given(F.transform(names, key), lambda keys: once(names, keys)))


def _given(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def entity_documents(docs: DataFrame) -> DataFrame:
    """(entity, doc_id), each once."""
    return docs.select("doc_id", F.explode(entities(F.coalesce("text", F.lit("")))).alias("e")).select(key(F.col("e")).alias("entity"), "doc_id").distinct()


_NAME = rf"[{_CAP}][\wÀ-ÿ&' -]{{1,60}}"
_RELATIONS = [
    (re.compile(rf"(?P<s>{_NAME})\s+(?:est|sont|is|are)\s+(?P<rel>[^.]{{2,40}}?)(?:\s+(?:de|du|des|pour|for|of)\s+)(?P<o>{_NAME})"), "est lié à"),
    (re.compile(rf"(?P<s>{_NAME})\s+(?:travaille avec|collabore avec|works with|partners with)\s+(?P<o>{_NAME})"), "collabore avec"),
    (re.compile(rf"(?P<s>{_NAME})\s+(?:contient|inclut|includes|contains)\s+(?P<o>{_NAME})"), "contient"),
]
_TRIM = " ,;:.!?()[]{}\"'"


def _clean(value: str) -> str:
    value = re.sub(r"\s+", " ", value.strip(_TRIM))
    return re.sub(r"\s+(est|sont|is|are|contient|inclut|includes|contains)\b.*$", "", value, flags=re.I)[:80]


def stated_relations(sentence: str) -> list[tuple[str, str, str]]:
    """(subject, relation, object) that a sentence states in one of the known forms."""
    out = []
    for rule, name in _RELATIONS:
        for m in rule.finditer(sentence):
            s, o = _clean(m["s"]), _clean(m["o"])
            rel = re.sub(r"\s+", " ", (m.groupdict().get("rel") or name).strip(_TRIM))[:80] or "lié à"
            if s and o and s.lower() != o.lower():
                out.append((s, rel, o))
    return out


def triples(docs: DataFrame) -> DataFrame:
    """(doc_id, subject, relation, object, s, o), each once per document: stated relations, and co-mention of a sentence's first entity with the next three."""
    parts = docs.select("doc_id", F.explode(F.split(normalise_lines(F.coalesce("text", F.lit(""))), r"(?<=[.!?])\s+|\n+")).alias("t"))
    pair = lambda e: F.transform(F.slice(e, 2, 3), lambda x: F.struct(e[0].alias("subject"), x.alias("object")))
    mentions = parts.select("doc_id", F.explode(_given(entities(F.col("t")), pair)).alias("m")).select("doc_id", "m.subject", F.lit("co-mention").alias("relation"), "m.object")
    kind = dict(docs.dtypes)["doc_id"]

    def stated(batches):
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf["doc_id"], pdf["t"], strict=True) for r in stated_relations(t)]
            yield pd.DataFrame(rows, columns=["doc_id", "subject", "relation", "object"])

    # only sentences that hold one of the verbs leave the JVM
    likely = parts.where(F.col("t").rlike(r"\s(est|sont|is|are|travaille avec|collabore avec|works with|partners with|contient|inclut|includes|contains)\s"))
    found = likely.mapInPandas(stated, f"doc_id {kind}, subject string, relation string, object string")
    every = found.unionByName(mentions).withColumn("s", key(F.col("subject"))).withColumn("o", key(F.col("object"))).where("s != o")
    return every.withColumn("r", F.lower("relation")).dropDuplicates(["doc_id", "s", "r", "o"]).drop("r")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(query_id, entity) within depth undirected steps over edges (s, o) from seeds (query_id, entity); one join for each step."""
    both = edges.select(F.col("s").alias("a"), F.col("o").alias("b")).unionByName(edges.select(F.col("o").alias("a"), F.col("s").alias("b"))).distinct()
    seen = edge = seeds.select("query_id", "entity").distinct()
    for _ in range(depth):
        edge = edge.join(both, edge.entity == both.a).select("query_id", F.col("b").alias("entity")).distinct().join(seen, ["query_id", "entity"], "left_anti")
        seen = seen.unionByName(edge)
    return seen


def graph_hits(graph: DataFrame, entity_docs: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """(query_id, doc_id) of triples with either end reachable, and of documents that name a seed."""
    graph, seeds = settled(graph.select("doc_id", "s", "o"), "triples"), small(settled(seeds, "seeds"))
    near = small(settled(reachable(graph, seeds, depth), "near"))
    by_end = [graph.join(near, graph[c] == near.entity).select("query_id", "doc_id") for c in ("s", "o")]
    named = entity_docs.join(seeds, "entity").select("query_id", "doc_id")
    return by_end[0].unionByName(by_end[1]).unionByName(named).distinct()
