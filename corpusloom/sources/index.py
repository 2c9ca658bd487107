"""Indexes as Parquet tables, manifests and incremental maintenance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SCHEMA_VERSION = 3


def save_index(chunks: DataFrame, path: str) -> None:
    """Chunks with their vectors, one row each; count and schema version travel in the table itself."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/chunks")


def upsert(current: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """current with the rows of new added or put in place of those with the same key; of equal keys in new the last by content wins."""
    turn = F.row_number().over(W.partitionBy(key).orderBy(*[F.col(c).desc() for c in new.columns if c != key]))
    once = new.withColumn("__n", turn).where("__n = 1").drop("__n")
    return current.join(once.select(key), key, "left_anti").unionByName(once)


def diff(current: DataFrame, previous: DataFrame) -> DataFrame:
    """(path, status) by content hash: changed (new ones too), unchanged or deleted. Both sides: path, sha256."""
    both = current.select("path", F.col("sha256").alias("now")).join(previous.select("path", F.col("sha256").alias("before")), "path", "full_outer")
    status = F.when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return both.select("path", status.alias("status"))


def update_index(chunks: DataFrame, files: DataFrame, manifest: DataFrame, chunk: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, manifest, plan) after an incremental run: chunks of unchanged files stay, only changed files are chunked (and embedded, if chunk embeds).

    files: path, sha256, size_bytes, text; chunks: source and others; manifest: path, sha256, size_bytes.
    """
    plan = diff(files, manifest)
    kept = chunks.join(plan.where("status = 'unchanged'").select(F.col("path").alias("source")), "source", "left_semi")
    fresh = chunk(files.join(plan.where("status = 'changed'").select("path"), "path", "left_semi"))
    return kept.unionByName(fresh), files.select("path", "sha256", "size_bytes"), plan


def inspect(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """(documents, files, total_bytes, schema_version), one row."""
    return chunks.agg(F.count("*").alias("documents")).crossJoin(manifest.agg(F.count_distinct("path").alias("files"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def embed_missing(texts: DataFrame, cache: DataFrame, embed: Callable[[DataFrame], DataFrame], fingerprint: str) -> tuple[DataFrame, DataFrame]:
    """(vectors, cache): each text's vector, embedding only texts whose hash is not in the cache (key, vector) of this model's fingerprint."""
    keyed = texts.withColumn("key", F.sha2(F.concat(F.lit(fingerprint + "\u0000"), F.coalesce("text", F.lit(""))), 256))
    fresh = embed(keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti"))
    grown = cache.select("key", "vector").unionByName(fresh.select("key", "vector"))
    return keyed.join(grown, "key").drop("key"), grown


def live_entries(cache: DataFrame, now: float, namespace: str | None = None) -> DataFrame:
    """Entries (namespace, key, payload, created_at, expires_at) that have not run out."""
    live = cache.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    return live if namespace is None else live.where(F.col("namespace") == namespace)


def cache_key(*columns: str):
    """Hash of the canonical JSON of columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
