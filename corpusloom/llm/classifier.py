"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import NARROW, doc_of, lines, slices, span_hash, text_bytes, tokens, trim
from .shared import pick, position

#: Most labelled rows that a fit uses; they are drawn by a hash of doc_id. The fit's time and memory depend on it alone.
TRAIN_ROWS = 30_000
THRESHOLD = 0.5

FEATURES = (
    "log_chars", "log_tokens", "token_length", "token_spread", "longest_token", "distinct_share", "top_token_share", "repeat_next",
    "upper_share", "digit_share", "symbol_share", "bang_share", "pipe_share", "stop_share", "comma_share", "non_ascii_share",
    "log_lines", "line_length", "ended_lines", "tokens_per_stop", "caps_tokens",
)


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[list(chars)] = 1
    return t


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_SYMBOL, _STOP = _class(b"#$%&*~^=_<>{}[]@\\/+"), _class(b".?")
_HIGH = np.zeros(256, np.uint8)
_HIGH[192:] = 1  # lead bytes: one for each character beyond ASCII


def statistics(text: pa.Array) -> np.ndarray:
    """Statistics of each text, float64 (documents, len(FEATURES)), from its whole bytes. Empty and null texts give a row of zeros."""
    data, offsets = text_bytes(text)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in slices(offsets, NARROW):
        out[i:j] = _statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return out


def _statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1

    def per_doc(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1)
        np.cumsum(flags, out=sums[1:])
        return sums[first[1:]] - sums[first[:-1]]

    size = np.diff(offsets).astype(float)
    starts, ends, first = tokens(data, offsets)
    doc, length, h = doc_of(first), (ends - starts).astype(float), span_hash(data, starts, ends)
    count = np.diff(first).astype(float)
    c, b = np.maximum(count, 1), np.maximum(size, 1)
    mean = per_doc(length, first) / c
    order = np.lexsort((h, doc))
    d, s = doc[order], h[order]
    new = np.ones(len(s), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
    heads = np.flatnonzero(new)
    runs = np.diff(np.append(heads, len(s)))
    most, longest = np.zeros(n), np.zeros(n)
    np.maximum.at(most, d[heads], runs)
    np.maximum.at(longest, doc, length)
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    upper_sums = np.zeros(len(data) + 1)
    np.cumsum(_UPPER[data], out=upper_sums[1:])
    caps = (upper_sums[ends] - upper_sums[starts] >= 2) & (upper_sums[ends] - upper_sums[starts] >= 0.6 * length)
    ls, le, lfirst = lines(data, offsets)
    ts, te = trim(data, ls, le)
    full = te > ts
    last = data[np.maximum(te - 1, 0)] if len(data) else np.zeros(len(te), np.uint8)
    ended = full & np.isin(last, np.frombuffer(b".!?:;\"')", np.uint8))
    n_lines = np.maximum(per_doc(full, lfirst), 1)
    share = lambda table: per_doc(table[data], offsets) / b
    stops = per_doc(_STOP[data], offsets)
    cols = [
        np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(per_doc(length**2, first) / c - mean**2, 0)), longest,
        np.bincount(d[heads], minlength=n) / c, most / c, per_doc(again, first) / c,
        share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_class(b"!")), share(_class(b"|")), stops / b, share(_class(b",")), share(_HIGH),
        np.log1p(per_doc(full, lfirst)), size / n_lines, per_doc(ended, lfirst) / n_lines, count / (1 + stops), per_doc(caps, first) / c,
    ]
    return np.stack(cols, axis=1) * (size > 0)[:, None]


class Trees:
    """A boosted forest as arrays: feature and threshold of each inner node (trees, 2^depth - 1), value of each leaf (trees, 2^depth)."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, base: float):
        self.feature, self.threshold, self.value, self.base = feature, threshold, value, base

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of the label 1 for each row; every row walks down all trees, a level at a time."""
        score, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            score += v[node - inner]
        return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, least: float = 1.0, penalty: float = 1.0) -> Trees:
    """Fits logistic loss by second-order boosting on binned features. Labels of one class only give a constant."""
    prior = np.clip(y.mean() if len(y) else 1.0, 1e-4, 1 - 1e-4)
    base = float(np.log(prior / (1 - prior)))
    if len(y) < 10 or y.min() == y.max():
        return Trees(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), base)
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for k in range(m)]
    binned = np.stack([np.searchsorted(cuts[k], x[:, k], side="left") for k in range(m)])
    feature, threshold, value = [], [], []
    score = np.full(n, base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            base_node, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            choice = np.full((width, 2), -1)
            for k in range(m):
                slot = node * bins + binned[k]
                hg = np.bincount(slot, g, width * bins).reshape(width, bins).cumsum(1)
                hh = np.bincount(slot, h, width * bins).reshape(width, bins).cumsum(1)
                tg, th = hg[:, -1:], hh[:, -1:]
                gain = hg**2 / (hh + penalty) + (tg - hg) ** 2 / (th - hh + penalty) - tg**2 / (th + penalty)
                gain[(hh < least) | (th - hh < least)] = 0
                gain[:, len(cuts[k]) :] = 0
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                better = top > best
                best[better] = top[better]
                choice[better] = np.stack([np.full(width, k), at], 1)[better]
            for w in range(width):
                if choice[w, 0] >= 0:
                    f[base_node + w], t[base_node + w] = choice[w, 0], cuts[choice[w, 0]][choice[w, 1]]
            node = 2 * node + (x[np.arange(n), f[base_node + node]] > t[base_node + node])
        gs, hs = np.bincount(node, g, 2**depth), np.bincount(node, h, 2**depth)
        v = -rate * gs / (hs + penalty)
        score += v[node]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Trees(np.array(feature), np.array(threshold), np.array(value), base)


def train_quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Trees:
    """Fits on at most train_rows labelled documents, those with the least hash of doc_id.

    A doc_id with several labels counts as 0 if any is 0; null labels are no labels.
    """
    known = pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min(F.when(F.col("quality") > 0, 1).otherwise(0)).alias("y"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(train_rows)
    rows = pick(docs, "doc_id", "text").join(F.broadcast(drawn), "doc_id")  # at most train_rows pairs of numbers

    def measure(batches):
        for b in batches:
            s = statistics(b.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").cast(pa.int64()), "y": b.column("y").cast(pa.int32()), "s": pa.FixedSizeListArray.from_arrays(pa.array(s.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))})

    got = rows.select("doc_id", "text", "y").mapInArrow(measure, "doc_id bigint, y int, s array<double>")
    got = got.groupBy("doc_id").agg(F.min("y").alias("y"), F.min("s").alias("s")).toPandas()  # one row for each label drawn, however often the document repeats
    got = got.sort_values("doc_id", kind="stable")
    x = np.stack(got["s"].to_list()) if len(got) else np.zeros((0, len(FEATURES)))
    return fit(x, got["y"].to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: Trees) -> DataFrame:
    """(doc_id, quality_score) for each row of docs: the model's probability that the document is good. One scan, no shuffle."""

    def score(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.predict(statistics(b.column("text"))))], ["doc_id", "quality_score"])

    rows = pick(docs, "doc_id", "text")
    return rows.mapInArrow(score, f"doc_id {dict(rows.dtypes)['doc_id']}, quality_score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Trains on the labelled documents and judges every document: (doc_id, quality_score, keep).

    keep is quality_score >= threshold. Boosted trees (60 of depth 4 on 64-bin histograms) over FEATURES, flattened to
    arrays and walked level by level in numpy.

    Defined results: null, empty and blank texts have all statistics 0 and are judged like any other text. Without
    labels, or with labels of one class, every document gets that class's constant (1 without labels). Repeated rows get
    equal scores. An empty table gives an empty result.

    At scale: the fit is bounded by train_rows; scoring is one scan of the text with Arrow batches, without a shuffle.
    """
    return score_quality(docs, train_quality(docs, labels, train_rows)).withColumn("keep", F.col("quality_score") >= F.lit(threshold))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that classify_quality keeps, with all their columns, judged as they stream by."""
    model = train_quality(docs, labels, train_rows)
    at, safe = position(docs, "text"), docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])

    def keep(batches):
        for b in batches:
            yield b.filter(pa.array(model.predict(statistics(b.column(at))) >= threshold))

    return safe.mapInArrow(keep, safe.schema).toDF(*docs.columns)
