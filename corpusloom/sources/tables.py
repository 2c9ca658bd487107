"""Tables, evaluation sets and settings from files."""

from __future__ import annotations

import json
import os
import sqlite3
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.structured import identifier


def csv_table(spark: SparkSession, path: str, name: str | None = None) -> DataFrame:
    """A CSV file with a header as a view of inferred types; its name and columns are made identifiers. Multi-line cells are read whole."""
    df = spark.read.csv(path, header=True, inferSchema=True, multiLine=True, escape='"')
    seen: dict[str, int] = {}
    columns = []
    for c in df.columns:
        base = identifier(c)
        seen[base] = seen.get(base, 0) + 1
        columns.append(base if seen[base] == 1 else f"{base}_{seen[base]}")
    df = df.toDF(*columns)
    df.createOrReplaceTempView(identifier(name or os.path.splitext(os.path.basename(path))[0]))
    return df


_KINDS = {"INT": T.LongType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType()}


def sqlite_table(spark: SparkSession, path: str, name: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file as a view. The file is opened read-only, by tasks that each read a range of row ids, so it must be on a shared file system."""
    uri = f"file:{os.path.abspath(path)}?mode=ro"
    quoted = '"' + name.replace('"', '""') + '"'
    with sqlite3.connect(uri, uri=True) as con:
        columns = [(r[1], next((t for k, t in _KINDS.items() if k in (r[2] or "").upper()), T.StringType())) for r in con.execute(f"PRAGMA table_info({quoted})")]
        if not columns:
            raise ValueError(f"no table {name}")
        low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {quoted}").fetchone()
    schema = T.StructType([T.StructField(identifier(c), t) for c, t in columns])
    makes = [int if isinstance(t, T.LongType) else float if isinstance(t, T.DoubleType) else str for _, t in columns]

    def read(batches):
        import pandas as pd

        for b in batches:
            with sqlite3.connect(uri, uri=True) as own:
                for lo, hi in zip(b["lo"], b["hi"], strict=True):
                    cursor = own.execute(f"SELECT * FROM {quoted} WHERE rowid >= ? AND rowid < ?", (int(lo), int(hi)))
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame([[None if v is None else f(v) for v, f in zip(r, makes, strict=True)] for r in rows], columns=schema.names, dtype=object)

    step = 1 if low is None else -(-(high - low + 1) // parts)
    ranges = [] if low is None else [(a, a + step) for a in range(low, high + 1, step)]
    df = spark.createDataFrame(ranges, "lo bigint, hi bigint").repartition(max(1, len(ranges))).mapInPandas(read, schema)
    df.createOrReplaceTempView(identifier(name))
    return df


def eval_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(queries, qrels) of JSON lines: query, expected_doc_ids (or expected: a list or one id) and graded_relevance (or relevance: gains by id). Expected ids without a gain have 1.0; query_id is a hash of the query."""
    raw = spark.read.schema("query string, expected_doc_ids string, expected string, graded_relevance string, relevance string").json(path).where("query is not null")
    ids = F.coalesce("expected_doc_ids", "expected")
    listed = F.when(ids.startswith("["), F.from_json(ids, "array<string>")).when(ids.isNotNull(), F.array(ids)).otherwise(F.array().cast("array<string>"))
    gains = F.coalesce(F.from_json(F.coalesce("graded_relevance", "relevance"), "map<string,double>"), F.create_map().cast("map<string,double>"))
    rows = raw.select(F.xxhash64("query").alias("query_id"), "query", listed.alias("ids"), gains.alias("gains")).dropDuplicates(["query_id"])
    every = rows.select("query_id", F.explode(F.array_distinct(F.concat("ids", F.map_keys("gains")))).alias("doc_id"), "gains")
    return rows.select("query_id", "query"), every.select("query_id", "doc_id", F.coalesce(F.try_element_at("gains", F.col("doc_id")), F.lit(1.0)).alias("gain"))


SECTIONS = {
    "retrieval": {"top_k": int, "alpha": float, "min_score": float},
    "query": {"transform": str, "variants": int},
    "reranker": {"name": str, "candidates": int},
    "compression": {"redundancy": bool, "extractive": bool},
    "chunking": {"chunker": str, "chunk_size": int, "chunk_overlap": int, "min_chunk_size": int},
    "generation": {"strict": bool, "require_citations": bool},
    "index": {"path": str, "source": str},
    "tokenizer": {"ngram_max": int, "min_length": int, "use_default_stopwords": bool},
}


def checked_config(raw: dict[str, Any]) -> dict[str, dict[str, Any]]:
    """Settings by section: unknown sections and keys, wrong types and impossible combinations are a ValueError."""
    out: dict[str, dict[str, Any]] = {}
    for section, values in raw.items():
        if section not in SECTIONS:
            raise ValueError(f"unknown section: {section}")
        if not isinstance(values, dict):
            raise ValueError(f"{section} must hold keys")
        for k, v in values.items():
            kind = SECTIONS[section].get(k)
            if kind is None:
                raise ValueError(f"unknown key: {section}.{k}")
            if kind is float and isinstance(v, int) and not isinstance(v, bool):
                v = float(v)
            if not isinstance(v, kind) or (kind is int and isinstance(v, bool)):
                raise ValueError(f"{section}.{k} must be of type {kind.__name__}")
            out.setdefault(section, {})[k] = v
    r, c = out.get("retrieval", {}), out.get("chunking", {})
    if not 0 <= r.get("alpha", 0.5) <= 1:
        raise ValueError("retrieval.alpha must lie in 0..1")
    if r.get("top_k", 1) < 1:
        raise ValueError("retrieval.top_k must be positive")
    if c.get("chunk_overlap", 0) >= c.get("chunk_size", 800):
        raise ValueError("chunking.chunk_overlap must be less than chunk_size")
    return out


def load_config(path: str) -> dict[str, dict[str, Any]]:
    """checked_config of a JSON file, or of a YAML file if a YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.lower().endswith((".yaml", ".yml")):
        try:
            import yaml  # an optional reader
        except ModuleNotFoundError as e:
            raise ValueError("YAML settings need PyYAML; use JSON") from e
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    return checked_config(raw)
