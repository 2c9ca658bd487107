"""URL filters: prefix rules as intervals of reversed-host keys, joined by one sorted sweep with a stack."""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import pick

#: Keys drawn per bucket to place the bucket bounds.
DRAWN_PER_BUCKET = 60
#: Pages per bucket of the sweep.
BUCKET_PAGES = 200_000


def surt(url: Column) -> Column:
    """Canonical key of a URL: host labels reversed, each with a comma, then ")" and the path with its query.

    Scheme, user, port, fragment and a final dot of the host are dropped, the host is lower-cased, an empty path
    is "/". https://A.example.net:443/x#y -> net,example,a,)/x. Null or blank urls have no key (null).
    """
    s = F.trim(url)
    s = F.regexp_replace(F.regexp_replace(s, "^[A-Za-z][A-Za-z0-9+.\\-]*://", ""), "#.*$", "")
    authority = F.regexp_extract(s, "^([^/?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(authority, "^.*@", "")), ":[0-9]*$", ""), "\\.+$", "")
    path = F.substr(s, F.length(authority) + 1)
    path = F.when(path == "", "/").when(F.substring(path, 1, 1) == "?", F.concat(F.lit("/"), path)).otherwise(path)
    labels = F.array_join(F.reverse(F.split(host, "\\.")), ",")
    return F.when(F.length(F.trim(url)) > 0, F.concat(labels, F.lit(",)"), path))


def rule_prefix(pattern: Column) -> Column:
    """The key prefix of a rule: "example.net" holds for the host and all below it, "example.net/a" for that host's paths from /a on."""
    key = surt(pattern)
    return F.when(F.regexp_replace(F.trim(pattern), "^[A-Za-z][A-Za-z0-9+.\\-]*://", "").contains("/"), key).otherwise(F.regexp_replace(key, "\\)/$", ""))


def _after(prefix: str) -> str | None:
    """The least string above all that begin with prefix; None if there is none."""
    while prefix:
        c = ord(prefix[-1])
        if c < 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if c == 0xD7FF else c + 1)
        prefix = prefix[:-1]
    return None


def sweep(events):
    """events: (key, end or None, rule) in order of key, at equal keys the longer interval first. Yields (from_key, stack) whenever the stack of active rules changes."""
    stack: list[tuple[str | None, tuple]] = []
    for key, end, rule in events:
        while stack and stack[-1][0] is not None and stack[-1][0] <= key:
            gone, _ = stack.pop()
            yield gone, [r for _, r in stack]
        stack.append((end, rule))
        yield key, [r for _, r in stack]
    while stack:
        gone, _ = stack.pop()
        if gone is None:
            return
        yield gone, [r for _, r in stack]


def apply_url_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """Joins pages (page_id, url) with prefix rules (rule_id, pattern, action).

    Result, one row per page row: (page_id, url, rule_id, action, depth). The most specific rule that holds, i.e.
    the longest key prefix, decides; depth counts all rules that hold. Pages under no rule get rule_id null, action
    "keep" and depth 0.

    Defined results: a null or blank url has no key and no rule. Rules with a null or blank pattern hold for nothing.
    Of rules with the same prefix the one with the greatest rule_id decides, and each counts in depth. Repeated
    pages give repeated rows; empty tables of either kind are fine.

    At scale: prefixes are intervals of the sorted key space and are properly nested, so one pass over sorted keys
    with a stack finds all rules, whatever their number. Keys are cut into buckets at bounds drawn from the keys by
    hash (a fixed number per bucket); a rule goes to each bucket that its interval meets, so a bucket starts with the
    stack it needs. Pages are shuffled once, as (page_id, url, key); the rules' side may be of any size.
    """
    spark = pages.sparkSession
    keyed = pick(pages, "page_id", "url").withColumn("key", surt(F.col("url")))
    plain = keyed.where("key is null").select("page_id", "url", F.lit(None).cast("string").alias("rule_id"), F.lit("keep").alias("action"), F.lit(0).alias("depth"))
    keyed = keyed.where("key is not null")
    n = pick(pages, "page_id").count()
    buckets = max(1, min(-(-n // BUCKET_PAGES), 1 << 16))
    bounds: list[str] = []
    if buckets > 1:
        share = min(1.0, 2.0 * buckets * DRAWN_PER_BUCKET / n)
        drawn = keyed.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).select("key").distinct()
        got = sorted(r.key for r in drawn.collect())
        bounds = sorted({got[len(got) * i // buckets] for i in range(1, buckets)}) if got else []

    def place(batches):
        for b in batches:
            t = b.append_column("bucket", pa.array([bisect.bisect_right(bounds, k) for k in b.column("key").to_pylist()], pa.int32()))
            yield t

    def spread(batches):
        for b in batches:
            for r in b.to_pylist():
                p = r["prefix"]
                e = _after(p)
                last = len(bounds) if e is None else bisect.bisect_left(bounds, e)
                first = bisect.bisect_right(bounds, p)
                for k in range(first, last + 1):
                    yield pa.RecordBatch.from_pylist([{**r, "end": e, "bucket": k}], schema=pa.schema([("rule_id", pa.string()), ("action", pa.string()), ("prefix", pa.string()), ("end", pa.string()), ("bucket", pa.int32())]))

    rows = keyed.select("page_id", "url", "key").mapInArrow(place, f"page_id {dict(keyed.dtypes)['page_id']}, url string, key string, bucket int")
    known = pick(rules, "rule_id", "pattern", "action").select(F.col("rule_id").cast("string").alias("rule_id"), "action", rule_prefix(F.col("pattern")).alias("prefix")).where("prefix is not null")
    known = known.mapInArrow(spread, "rule_id string, action string, prefix string, end string, bucket int")
    kind = dict(keyed.dtypes)["page_id"]
    id_type = to_arrow_type(keyed.schema["page_id"].dataType)
    schema = f"page_id {kind}, url string, rule_id string, action string, depth int"

    def merge(pages_in, rules_in):
        # a longer interval sorts before the shorter ones it holds; equal ones by rule_id, so that the greatest ends on top
        if not pages_in.num_rows:
            return pa.table({"page_id": pa.array([], id_type), "url": pa.array([], pa.string()), "rule_id": pa.array([], pa.string()), "action": pa.array([], pa.string()), "depth": pa.array([], pa.int32())})
        nested = sorted(rules_in.to_pylist() if rules_in.num_rows else [], key=lambda r: (r["prefix"], r["rule_id"] is not None, r["rule_id"]))
        keys = pages_in["key"].to_pylist()
        order = sorted(range(len(keys)), key=keys.__getitem__)
        ordered = [keys[i] for i in order]
        out: list[tuple] = [(None, "keep", 0)] * len(keys)
        at, now = 0, (None, "keep", 0)
        for key, stack in sweep((r["prefix"], r["end"], (r["rule_id"], r["action"])) for r in nested):
            upto = bisect.bisect_left(ordered, key, lo=at)
            out[at:upto] = [now] * (upto - at)
            at, now = upto, ((*stack[-1], len(stack)) if stack else (None, "keep", 0))
        out[at:] = [now] * (len(keys) - at)
        sorted_pages = pages_in.take(pa.array(order, pa.int64()))
        return pa.table({"page_id": sorted_pages["page_id"], "url": sorted_pages["url"], "rule_id": pa.array([o[0] for o in out], pa.string()), "action": pa.array([o[1] for o in out], pa.string()), "depth": pa.array([o[2] for o in out], pa.int32())})

    joined = rows.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(merge, schema)
    return joined.unionByName(plain)
