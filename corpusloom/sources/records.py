"""What a running engine writes: feedback, traces, manifests and cached answers, as appended or replaced tables."""

from __future__ import annotations

import hashlib
import hmac
import os
import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import rating

SCHEMA_VERSION = 3


def log_feedback(answers: DataFrame, path: str) -> None:
    """Appends feedback as JSON lines. answers has query and rating, and any of answer, source_ids (kept as retrieved_source_ids), correct_answer, correct_source_ids, comment, user_id, tenant_id, collection_id."""
    has = lambda c, t="string": F.col(c).cast(t) if c in answers.columns else F.lit(None).cast(t)
    none = F.array().cast("array<string>")
    rows = answers.select(
        F.uuid().alias("feedback_id"), "query", rating(F.col("rating").cast("string")).alias("rating"), has("answer").alias("answer"), has("comment").alias("comment"), has("correct_answer").alias("correct_answer"),
        F.coalesce(has("correct_source_ids", "array<string>"), none).alias("correct_source_ids"), F.coalesce(has("source_ids", "array<string>"), none).alias("retrieved_source_ids"),
        has("user_id").alias("user_id"), has("tenant_id").alias("tenant_id"), has("collection_id").alias("collection_id"), F.current_timestamp().alias("created_at"),
    )
    rows.write.mode("append").json(path)


def log_traces(answers: DataFrame, path: str, include_prompt: bool = False) -> None:
    """Appends a trace per answer (query_id, query, answer, source_ids, prompt) as JSON lines; without include_prompt only the prompt's length."""
    prompt = F.col("prompt").alias("prompt") if include_prompt else F.length("prompt").alias("prompt_chars")
    answers.select(F.uuid().alias("trace_id"), "query_id", "query", "answer", "source_ids", prompt, F.current_timestamp().alias("created_at")).write.mode("append").json(path)


def save_manifest(files: DataFrame, path: str) -> None:
    """Replaces the manifest of an index: path, sha256, size_bytes and, where there, mtime and doc_ids."""
    kept = [c for c in ("path", "sha256", "size_bytes", "mtime", "doc_ids", "status") if c in files.columns]
    files.select(*kept, F.lit(SCHEMA_VERSION).alias("schema_version")).write.mode("overwrite").parquet(path)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest; an older schema is an error, a missing one an empty manifest."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at):
        return spark.createDataFrame([], "path string, sha256 string, size_bytes bigint")
    found = spark.read.parquet(path)
    if found.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count():
        raise ValueError("the manifest has another schema version")
    return found.drop("schema_version")


@contextmanager
def writer_lock(folder: str, timeout: float = 10.0, pause: float = 0.05):
    """Holds an index's lock file while the block runs; a TimeoutError if another writer keeps it for longer than timeout seconds."""
    path, until = os.path.join(folder, ".write.lock"), time.monotonic() + timeout
    os.makedirs(folder, exist_ok=True)
    while True:
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            break
        except FileExistsError:
            if time.monotonic() >= until:
                raise TimeoutError(f"another writer holds {path}") from None
            time.sleep(pause)
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.unlink(path)


class AnswerCache:
    """A table of model answers by namespace and key, with expiry. A batch asks the model only for keys that are not there.

    Keys are hashes of the namespace, a fingerprint of the model or corpus, and the input, so two corpora never share an entry.
    Payloads are signed: an entry whose signature does not fit the secret counts as missing.
    """

    SCHEMA = "namespace string, key string, payload string, signature string, created_at double, expires_at double"

    def __init__(self, spark: SparkSession, path: str, namespace: str, fingerprint: str, secret: str = "", ttl: float | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.path, self.namespace, self.fingerprint, self.secret, self.ttl, self.clock = spark, path, namespace, fingerprint, secret, ttl, clock
        self.hits = self.misses = 0

    def _entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception:  # no entry was written yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def key(self, *values: Column) -> Column:
        return F.sha2(F.concat_ws("\u0000", F.lit(self.namespace), F.lit(self.fingerprint), F.to_json(F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)]))), 256)

    def signature(self, key: Column, payload: Column) -> Column:
        """HMAC-SHA-256 of key and payload, in the JVM."""
        block = hashlib.sha256(self.secret.encode()).digest() if len(self.secret.encode()) > 64 else self.secret.encode()
        block = block.ljust(64, b"\0")
        inner, outer = (F.lit(bytearray(b ^ x for b in block)) for x in (0x36, 0x5C))
        body = F.concat_ws("\u0000", key, F.coalesce(payload, F.lit(""))).cast("binary")
        return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, body), 256))), 256)

    def live(self) -> DataFrame:
        """Entries of this namespace that have not run out and whose signature fits; of repeated keys the latest."""
        good = self._entries().where((F.col("namespace") == self.namespace) & (F.col("expires_at").isNull() | (F.col("expires_at") > self.clock())) & (F.col("signature") == self.signature(F.col("key"), F.col("payload"))))
        return good.groupBy("key").agg(F.max_by("payload", "created_at").alias("payload"))

    def get_or_set(self, rows: DataFrame, column: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """rows (prompt, ...) with the answer as column; make (frame with key and prompt -> key, payload) answers the missing ones once for each distinct key."""
        from .store import settled

        keyed = settled(rows.withColumn("key", self.key(F.col("prompt"))), "asked")
        known = settled(self.live(), "live")
        missing = keyed.select("key", "prompt").dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti")
        now = self.clock()
        fresh = settled(make(missing).select("key", F.col("payload").cast("string").alias("payload")), "fresh")
        new = fresh.select(F.lit(self.namespace).alias("namespace"), "key", "payload", self.signature(F.col("key"), F.col("payload")).alias("signature"), F.lit(float(now)).alias("created_at"), F.lit(None if self.ttl is None else float(now + self.ttl)).cast("double").alias("expires_at"))
        n, m = keyed.select("key").distinct().count(), fresh.count()
        self.misses, self.hits = self.misses + m, self.hits + n - m
        if m:
            new.write.mode("append").parquet(self.path)
        return keyed.join(known.unionByName(fresh), "key", "left").withColumnRenamed("payload", column).drop("key")

    def rewrite(self, keep: Column) -> None:
        """Leaves only the entries that keep holds for."""
        from .store import settled

        settled(self._entries().where(keep), "kept").write.mode("overwrite").parquet(self.path)

    def invalidate(self) -> None:
        self.rewrite(F.col("namespace") != self.namespace)

    def cleanup(self) -> None:
        self.rewrite(F.col("expires_at").isNull() | (F.col("expires_at") > self.clock()))

    def stats(self) -> dict[str, float]:
        asked = self.hits + self.misses
        return {"hits": self.hits, "misses": self.misses, "requests": asked, "hit_rate": self.hits / asked if asked else 0.0, "entries": self.live().count()}


def sign(secret: str, payload: bytes) -> str:
    """Hex HMAC-SHA-256 of a payload."""
    return hmac.new(secret.encode(), payload, hashlib.sha256).hexdigest()


def verified(secret: str, payload: bytes, signature: str) -> bool:
    return hmac.compare_digest(sign(secret, payload), signature)
