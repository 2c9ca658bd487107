"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import Scratch, pick, position

#: Buckets of the rank key per source; only the bucket that holds the cut is ever sorted.
CUT_BUCKETS = 4096
NO_SOURCE = "(none)"
#: A table of sources beyond this many rows is joined by a shuffle instead of a broadcast.
BROADCAST_SOURCES = 50_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of key and seed."""
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f"#{seed}")).cast("binary")), 1, 12), 16, 10)
    return (bits.cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def quotas(per_source: DataFrame, total: Column | int | None, weights: dict[str, float] | None, temperature: float) -> DataFrame:
    """per_source(src, n, mass) -> + quota: whole draws per source that add up to total, by largest remainder.

    Sources without mass get no draws. weights: target shares by source (others get 0; they are rescaled to 1);
    if None, a source's share is proportional to n ** temperature.
    """
    alive = per_source.where("mass > 0")
    if weights is None:
        share = F.sqrt(F.col("n").cast("double")) if temperature == 0.5 else F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("src")), F.lit(0.0)) if weights else F.lit(0.0)
    # shares are whole millionths, so that their sum does not depend on the partitioning
    every = W.partitionBy()
    want = alive.withColumn("share", F.round(share * 1e6).cast("decimal(30,0)"))
    want = want.withColumn("total", (F.sum("n").over(every) if total is None else F.lit(total)).cast("bigint")).where("share > 0")
    want = want.withColumn("ideal", F.col("total").cast("double") * F.col("share").cast("double") / F.sum("share").over(every).cast("double"))
    want = want.withColumn("base", F.floor("ideal")).withColumn("rest", F.col("total") - F.sum("base").over(every))
    turn = F.row_number().over(W.orderBy((F.col("ideal") - F.col("base")).desc(), "src"))
    return want.select("src", "n", "mass", (F.col("base") + F.when(turn <= F.col("rest"), 1).otherwise(0)).cast("bigint").alias("quota"))


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: int | None = None,
    temperature: float = 0.5,
    seed: int = 17,
) -> DataFrame:
    """A fixed-size sample of documents in which each source has its target share.

    Result: (doc_id, source, certain, inclusion, copies), one row per selected document row; copies >= 1 is how
    often it goes into the mix. Each source s gets a whole quota of draws (see quotas); a document's expected
    number of copies is quota * m / sum(m) with m = sqrt(1 + characters), so longer texts count more, less than
    in proportion. Its whole part (certain) is always taken. The fractions are the inclusion probabilities p of
    a Pareto sample: rows are ranked by U/(1-U) * (1-p)/p and as many as the source's quota still lacks are
    taken, lowest first. So every source gets exactly its quota, and total (default: the number of rows) is met.

    Defined results: a null source is a source of its own, "(none)" (a real source of that name shares it). A null
    or empty text has m = 1. n_chars is used for the length; where it is null or negative, the text is measured.
    Rows that repeat a doc_id share U: they tie, and ties go by doc_id, then length, then a hash of the text; identical
    rows are interchangeable. An empty table gives an empty result.

    At scale: statistics are one aggregation per source with map-side combine. The cut is found by counting rank
    keys in buckets per source, and only the bucket that holds it is sorted, so no task ever sees a hot source.
    """
    rows = pick(docs, "doc_id", "source", "n_chars", "text")
    return _drawn(rows, weights, total, temperature, seed).select("doc_id", F.col("src").alias("source"), "certain", "inclusion", "copies")


def _drawn(rows: DataFrame, weights: dict[str, float] | None = None, total: int | None = None, temperature: float = 0.5, seed: int = 17) -> DataFrame:
    """The rows that are drawn, with src, certain, inclusion and copies. rows has doc_id, source, n_chars and text, and may carry others."""
    scratch = Scratch(rows.sparkSession, "mixing")
    rows = rows.withColumn("src", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    rows = rows.withColumn("len", F.coalesce(F.when(F.col("n_chars") >= 0, F.col("n_chars").cast("bigint")), F.length("text").cast("bigint"), F.lit(0).cast("bigint")))
    # the mass is summed as whole millionths: the sum is then the same in any order
    m = F.round(F.sqrt(F.lit(1.0) + F.col("len")) * 1e6).cast("bigint")
    rows = rows.withColumn("m", m)
    known = scratch.table(quotas(rows.groupBy("src").agg(F.count("*").alias("n"), F.sum("m").alias("mass")), total, weights, temperature).select("src", "mass", "quota"), "quotas")
    side = (lambda d: F.broadcast(d)) if known.count() <= BROADCAST_SOURCES else (lambda d: d)
    expected = rows.join(side(known), "src").withColumn("lam", F.col("quota").cast("double") * F.col("m").cast("double") / F.col("mass").cast("double"))
    ranked = (
        expected.withColumn("certain", F.floor("lam"))
        .withColumn("inclusion", F.col("lam") - F.col("certain"))
        .withColumn("u", uniform(F.col("doc_id"), seed))
        .withColumn("rank_key", F.when(F.col("inclusion") > 0, F.col("u") / (1.0 - F.col("u")) * ((1.0 - F.col("inclusion")) / F.col("inclusion"))))
        # rank_key / (1 + rank_key) grows with rank_key and lies in (0, 1)
        .withColumn("slot", F.least(F.floor(F.col("rank_key") / (1.0 + F.col("rank_key")) * CUT_BUCKETS), F.lit(CUT_BUCKETS - 1)).cast("int"))
    )
    # both counts in one aggregation: rows per (source, slot) and the certain copies
    counted = ranked.groupBy("src", "slot").agg(F.count("*").alias("c"), F.sum("certain").alias("whole"))
    by_source = W.partitionBy("src")
    upto = by_source.orderBy(F.col("slot").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.currentRow)
    need = F.first("quota").over(by_source) - F.sum("whole").over(by_source)
    cut = (
        counted.join(side(known), "src")
        .withColumn("need", need)
        .withColumn("upto", F.sum(F.when(F.col("slot").isNotNull(), F.col("c")).otherwise(0)).over(upto))
        .where("slot is not null and upto - c < need")
        .groupBy("src")
        .agg(F.max("slot").alias("cut"), F.max_by(F.col("need") - (F.col("upto") - F.col("c")), F.col("slot")).alias("left"))
    )
    cut = scratch.table(cut, "cut")
    marked = ranked.join(side(cut), "src", "left")
    sure = marked.where("slot is null or cut is null or slot != cut").withColumn("drawn", F.coalesce(F.col("slot") < F.col("cut"), F.lit(False)))
    # only the rows of the bucket that holds the cut are shuffled and sorted
    edge = marked.where("slot = cut")
    turn = F.row_number().over(W.partitionBy("src").orderBy("rank_key", "doc_id", "len", F.xxhash64("text")))
    edge = edge.withColumn("turn", turn).withColumn("drawn", F.col("turn") <= F.col("left")).drop("turn")
    return sure.unionByName(edge).withColumn("copies", F.col("certain") + F.col("drawn").cast("bigint")).where("copies > 0")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix with all their columns, each row as often as mix_sources draws it.

    Nulls, ties, repeats and empty tables: as for mix_sources. Every draw is one row here.
    """
    carried = [f"__c{i}" for i in range(len(docs.columns))]
    safe = docs.toDF(*carried)
    for name in ("doc_id", "source", "n_chars", "text"):
        safe = safe.withColumn(name, F.col(f"__c{position(docs, name)}"))
    out = _drawn(safe, **how).withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))))
    return out.select(*carried).toDF(*docs.columns)
