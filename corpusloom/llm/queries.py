"""The registered queries of the ten operators, with their production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .classifier import classify_quality
from .kneserney import score_documents
from .linededup import dedup_lines
from .linerules import clean_lines
from .mixing import mix_sources
from .ngramjoin import similar_documents
from .packing import pack_documents
from .suffixes import repeated_passages
from .topk import exact_top_k
from .urlrules import apply_url_rules

#: Rules of the URL filter: top-level and registered domains, hosts and paths, nested, with both actions.
URL_RULES = [
    (i, pattern, action)
    for i, (pattern, action) in enumerate(
        [
            ("example.net", "block"), ("example.net/public", "keep"), ("tionsh.example.net", "block"), ("tionsh.example.net/en", "keep"),
            ("tionsh.example.net/en/1", "block"), ("tionsh.example.net/fr", "keep"), ("https://tionsh.example.net/de/", "block"), ("blog.example.net", "keep"),
            ("example.com", "keep"), ("ththon.example.com", "block"), ("ththon.example.com/es", "keep"), ("tionble.example.com", "block"),
            ("blog.tionble.example.com/en", "keep"), ("m.tiontion.example.com", "block"), ("m.tiontion.example.com/en/", "keep"), ("shop.example.com", "block"),
            ("example.org/ads", "block"), ("m.thther.example.org", "block"), ("m.thther.example.org/en", "keep"), ("m.thther.example.org/en/7", "block"),
            ("ththth.example.org", "keep"), ("blog.ththth.example.org/fr", "block"), ("ththre.example.org", "block"), ("blog.ththre.example.org", "keep"),
            ("invalid", "block"), ("localhost", "block"), ("test", "block"), ("onion", "block"), ("example.com/login", "block"), ("example.org", "keep"),
        ]
    )
]


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def url_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(f"r{i:03d}", p, a) for i, p, a in URL_RULES], "rule_id string, pattern string, action string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": lambda s, d: mix_sources(_read(s, d, "documents")),
    "op2_pack_documents": lambda s, d: pack_documents(_read(s, d, "documents")),
    "op3_kneser_ney": lambda s, d: score_documents(_read(s, d, "documents")),
    "op4_repeated_passages": lambda s, d: repeated_passages(_read(s, d, "documents")),
    "op5_ngram_jaccard": lambda s, d: similar_documents(_read(s, d, "documents")),
    "op6_url_rules": lambda s, d: apply_url_rules(_read(s, d, "pages"), url_rules(s)),
    "op7_clean_lines": lambda s, d: clean_lines(_read(s, d, "documents")),
    "op8_line_dedup": lambda s, d: dedup_lines(_read(s, d, "documents")),
    "op9_exact_top_k": lambda s, d: exact_top_k(_read(s, d, "embeddings")),
    "op10_quality": lambda s, d: classify_quality(_read(s, d, "documents"), _read(s, d, "labels")),
}
