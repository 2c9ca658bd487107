"""Fuzzy line deduplication: MinHash signatures of character shingles, banding, exact verification, union-find."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .kernels import NARROW, doc_of, line_hash, lines, mix, slices, small_batches, text_bytes, trim
from .shared import U64, HashTable, Maps, Scratch, build_table, name_numbers, pick, plus, position, save_arrays, shard_bits, shard_of

#: A shingle is a run of so many UTF-8 bytes: one character each in ASCII text.
SHINGLE = 5
#: Bands of the signature and hashes per band. At Jaccard 0.7 a pair meets in some band with probability 0.990.
BANDS, ROWS = 25, 5
#: One substituted byte changes SHINGLE shingles: lines of 33 bytes or more stay similar.
SIMILARITY = 0.7
#: Entries that one task of the banding sorts, and that a map task gathers before it sends them.
BAND_ENTRIES = 1_200_000
#: Pairs that a task verifies, and pairs verified at once.
CHECK_PAIRS, CHECKED = 200_000, 1000
_NO_DOC = np.iinfo(np.int64).min
_PROBES = np.random.default_rng(7).integers(0, BANDS * ROWS, (64, BANDS * ROWS))


_MASK = U64((1 << 8 * SHINGLE) - 1)
_K = BANDS * ROWS
#: Bits of a sketch; the other 7 hold the number of filled bins.
SKETCH = 57
_BITS = U64((1 << SKETCH) - 1)
#: Columns of a fine sketch.
_FINE = ["f0", "f1", "f2", "f3"]


def _shingles(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(line, shingle) of every shingle position; a line shorter than a shingle is one shingle, bits of its own hash."""
    count = np.maximum(ends - starts - SHINGLE + 1, 0)
    line = np.repeat(np.arange(len(starts)), count)
    at = np.arange(len(line)) + np.repeat(starts - np.cumsum(count) + count, count)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(shape=(len(data) + 1,), dtype="<u8", buffer=padded, strides=(1,))[at] & _MASK
    short = np.flatnonzero(count == 0)
    if len(short):
        line = np.concatenate([line, short])
        words = np.concatenate([words, line_hash(data, starts[short], ends[short]) & _MASK])
    return line, words


def signatures(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """((lines, BANDS) keys, sketches, fine sketches). One-permutation MinHash: each shingle's hash falls into one of BANDS * ROWS bins, a bin keeps its least; empty bins copy the bin that a fixed probe sequence finds first.

    The sketch has the last bit of SKETCH bins: of two lines, (1 + Jaccard) / 2 of these bits agree on average. Above them stands
    the number of bins that were not empty. The fine sketch has the last two bits of all bins, as two words each: in (1 + 3 Jaccard) / 4
    of the bins both agree on average.
    """
    line, words = _shingles(data, starts, ends)
    h = words * U64(0x9E3779B97F4A7C15)
    h ^= h >> U64(32)
    h *= U64(0xD6E8FEB86659FD93)
    bins = ((h >> U64(40)) * U64(_K)) >> U64(24)
    none = U64(1 << 40)
    sig = np.full(len(starts) * _K, none, dtype=U64)
    np.minimum.at(sig, line * _K + bins.view(np.int64), (h >> U64(8)) & U64(0xFFFFFFFF))
    sig = sig.reshape(-1, _K)
    empty = sig == none
    filled = (_K - empty.sum(axis=1)).astype(np.uint8)
    rows, cols = np.nonzero(empty)
    source = sig.copy()
    for probe in _PROBES:
        if not len(rows):
            break
        got = source[rows, probe[cols]]
        ok = got != none
        sig[rows[ok], cols[ok]] = got[ok] + U64(1 << 33)
        rows, cols = rows[~ok], cols[~ok]
    if len(rows):
        sig[rows, cols] = source[rows].min(axis=1)
    bits = np.zeros((len(starts), 2, 128), np.uint8)
    bits[:, 0, :_K] = sig & U64(1)
    bits[:, 1, :_K] = (sig >> U64(1)) & U64(1)
    fine = np.packbits(bits.reshape(-1, 256), axis=1, bitorder="little").view("<u8")
    sketch = (fine[:, 0] & _BITS) | (filled.astype(U64) << U64(SKETCH))
    bands = sig.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=U64) * U64(0x9E3779B97F4A7C15), bands.shape[:2])
    for r in range(ROWS):
        key = (key ^ bands[:, :, r]) * U64(0xA24BAED4963EE407)
        key ^= key >> U64(29)
    return mix(key), sketch, fine


def _least(bins: int, p: float) -> np.ndarray:
    """By the number of filled bins, 3.7 standard deviations less than the mean of so many bins that each agree with probability p."""
    filled = np.maximum(np.arange(_K + 1), 1)
    own, copied = bins * filled / _K, bins * (1 - filled / _K) / filled
    spread = own * (1 + 3 * copied + copied**2) + (filled - own) * (copied + copied**2)
    return np.floor(bins * p - 3.7 * np.sqrt(p * (1 - p) * spread)).astype(np.int64)


def _least_agreement(similarity: float) -> np.ndarray:
    """By the number of filled bins, the agreeing sketch bits of two lines below which they are not compared.

    At the threshold similarity the agreement lies 3.7 standard deviations above this, so about one similar pair in 10,000 is
    not seen in a band. Copies of bins make the bits of short lines depend on one another, which widens the deviation.
    """
    return _least(SKETCH, (1 + similarity) / 2)


def _least_fine(similarity: float) -> np.ndarray:
    """_least_agreement of fine sketches, in bins."""
    return _least(_K, (1 + 3 * similarity) / 4)


#: Buckets of up to so many lines have their pairs compared distance by distance, larger ones line by line.
SMALL_BUCKET = 1024


def _comparable(s: np.ndarray, t: np.ndarray, similarity: float, agree: np.ndarray) -> np.ndarray:
    """Which pairs of sketches can belong to similar lines."""
    e, f = (s >> U64(SKETCH)).astype(np.int64), (t >> U64(SKETCH)).astype(np.int64)
    low, high = np.minimum(e, f), np.maximum(e, f)
    return (SKETCH - np.bitwise_count((s ^ t) & _BITS).astype(np.int64) >= agree[low]) & (low + 6 >= similarity * high)


def _finely(s: np.ndarray, t: np.ndarray, fine: np.ndarray, i: np.ndarray, j: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which pairs i, j have fine sketches of similar lines; s, t: their sketches."""
    if not len(i):
        return np.zeros(0, dtype=bool)
    x, y = fine[i], fine[j]
    differ = np.bitwise_count((x[:, :2] ^ y[:, :2]) | (x[:, 2:] ^ y[:, 2:])).sum(axis=1, dtype=np.int64)
    return _K - differ >= least[(np.minimum(s, t) >> U64(SKETCH)).astype(np.int64)]


def _grouped(key: np.ndarray, sketch: np.ndarray, similarity: float, fine: np.ndarray | None = None) -> np.ndarray:
    """For each entry the first of its group: entries of one key, linked by pairs that are comparable by sketch, and by fine sketch if there is one. key is sorted.

    In a bucket of more than SMALL_BUCKET entries each entry is compared with those that no group has yet: a large bucket of
    lines that are alike costs its size, not its square.
    """
    n, agree, finely = len(key), _least_agreement(similarity), _least_fine(similarity)

    def linked(i, j):
        good = np.flatnonzero(_comparable(sketch[i], sketch[j], similarity, agree))
        if fine is None:
            return good
        i, j = (x[good] if np.ndim(x) else np.full(len(good), x) for x in (i, j))
        return good[_finely(sketch[i], sketch[j], fine, i, j, finely)]

    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(head, n))
    label = np.arange(n)
    large = np.repeat(size > SMALL_BUCKET, size)
    for h, m in zip(head[size > SMALL_BUCKET].tolist(), size[size > SMALL_BUCKET].tolist(), strict=True):
        free = np.arange(h, h + m)
        while len(free):
            root, reached, free = free[0], [free[0]], free[1:]
            while reached and len(free):
                good = linked(reached.pop(), free)
                label[free[good]] = root
                reached.extend(free[good].tolist())
                free = np.delete(free, good)
    ends = np.repeat(head + size, size)
    at, d = np.flatnonzero(~large), 1
    while True:
        at = at[at + d < ends[at]]
        if not len(at):
            break
        good = at[linked(at, at + d)]
        _unite(label, good, good + d)
        d += 1
    return _roots(label, np.arange(n))


def _roots(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    while True:
        up = parent[at]
        if (up == at).all():
            return at
        at = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Union-find over links i - j; the root of a tree is its least entry."""
    while len(i):
        i, j = _roots(parent, i), _roots(parent, j)
        apart = i != j
        i, j = np.minimum(i[apart], j[apart]), np.maximum(i[apart], j[apart])
        np.minimum.at(parent, j, i)


def _each_slice(batch: pa.RecordBatch):
    """(data, line starts, line ends, line hash, line number, doc_id) of the lines that are not blank, for each slice of a (doc_id, text) batch."""
    ids = batch.column(0).cast(pa.int64()).fill_null(_NO_DOC).to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(batch.column(1))
    for i, j in slices(offsets, NARROW):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = lines(part, off)
        number = np.arange(len(starts)) - np.repeat(first[:-1], np.diff(first))
        doc = ids[i:j][doc_of(first)]
        starts, ends = trim(part, starts, ends)
        full = ends > starts
        starts, ends = starts[full], ends[full]
        yield part, starts, ends, line_hash(part, starts, ends), number[full], doc[full]


def _firsts(rows: DataFrame) -> DataFrame:
    """(key, doc, line): each distinct line's first occurrence by doc_id, then line number."""

    def hashed(batches):
        for b in batches:
            for _, _, _, h, number, doc in _each_slice(b):
                order = np.lexsort((number, doc, h))
                h, number, doc = h[order], number[order], doc[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = h[1:] != h[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(h[new].view(np.int64)), pa.array(doc[new]), pa.array(number[new])], ["key", "doc", "line"])

    found = rows.mapInArrow(hashed, "key bigint, doc bigint, line bigint")
    return found.groupBy("key").agg(F.min(F.struct("doc", "line")).alias("at")).select("key", "at.doc", "at.line")


def _is_first(first: HashTable, h: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
    _, at = first.find(h)
    return (at["doc"] == doc) & (at["line"] == number)


def _candidates(rows: DataFrame, first: HashTable, bits: int, similarity: float, scratch: Scratch) -> DataFrame:
    """(band, a, b, sketch, f0 .. f3): in each group of a bucket every line b but the least, with the least as a.

    Hashes and sketches of lines are written once to the shared folder; what is shuffled are keys of bands with places there.
    """
    folder = f"{scratch.path}/sketches"

    def send(parts):
        """For each shard its entries by bucket: gaps of 32 bits of the key, compressed, then places of lines in the file."""
        key, facts = (np.concatenate(x) for x in zip(*parts, strict=True))
        name = bytes.fromhex(save_arrays(folder, {"facts": facts}))
        order = np.argsort(key.ravel())
        at, key = (order // BANDS).astype("<u2" if len(facts) <= 1 << 16 else "<u4"), key.ravel()[order]
        edges = np.searchsorted(shard_of(key, bits), np.arange((1 << bits) + 1))
        low = (key << U64(bits)) >> U64(32)
        full = np.flatnonzero(np.diff(edges))
        blobs = []
        for s in full:
            mine = slice(edges[s], edges[s + 1])
            gaps = pa.compress(np.ascontiguousarray(np.diff(low[mine], prepend=U64(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), codec="zstd", asbytes=True)
            blobs.append(np.array([edges[s + 1] - edges[s], len(gaps), at.itemsize], np.int64).tobytes() + name + gaps + at[mine].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["shard", "blob"])

    def received(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
        n, size, width = np.frombuffer(blob[:24], np.int64).tolist()
        gaps = np.frombuffer(pa.decompress(blob[40 : 40 + size], decompressed_size=4 * n, codec="zstd"), np.uint8)
        key = np.cumsum(np.ascontiguousarray(gaps.reshape(4, n).T).view("<u4").ravel(), dtype=U64)
        return key.astype(np.uint32), np.frombuffer(blob, f"<u{width}", n, 40 + size).astype(np.uint32)

    def keyed(batches):
        held, n = [], 0
        for b in batches:
            for data, starts, ends, h, number, doc in _each_slice(b):
                mine = np.flatnonzero(_is_first(first, h, doc, number))
                if not len(mine):
                    continue
                k, sketch, fine = signatures(data, starts[mine], ends[mine])
                held.append((k, np.column_stack([h[mine], sketch, fine])))
                n += k.size
                if n >= BAND_ENTRIES:
                    yield send(held)
                    held, n = [], 0
        if held:
            yield send(held)

    maps = Maps()

    def bucketed(table):
        blobs = table["blob"].to_pylist()
        key, at = (np.concatenate(x) for x in zip(*map(received, blobs), strict=True))
        file = np.repeat(np.arange(len(blobs), dtype=np.uint32), [int.from_bytes(x[:8], "little") for x in blobs])
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        key, order = key[shared], order[shared]
        at, file = at[order], file[order]
        facts = np.empty((len(key), 6), U64)
        by_file = np.argsort(file, kind="stable")
        edges = np.searchsorted(file[by_file], np.arange(len(blobs) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            mine = by_file[edges[k] : edges[k + 1]]
            facts[mine] = maps.get(f"{folder}/{blobs[k][24:40].hex()}.facts.npy")[at[mine]]
        del at, file, by_file, order
        # rows that share a doc_id can send the same entry twice
        order = np.lexsort((facts[:, 0], key))
        key, facts = key[order], facts[order]
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (facts[1:, 0] != facts[:-1, 0])
        key, facts = key[once], facts[once]
        owner, sketch, fine = facts[:, 0], np.ascontiguousarray(facts[:, 1]), facts[:, 2:]
        label = _grouped(key, sketch, similarity, fine)
        rest = np.flatnonzero(label != np.arange(len(label)))
        band = mix((key[rest].astype(U64) << U64(32)) ^ mix(owner[label[rest]]) ^ U64(int(table["shard"][0].as_py())))
        cols = [band, owner[label[rest]], owner[rest], sketch[rest], *fine[rest].T]
        return pa.table({c: pa.array(np.ascontiguousarray(x).view(np.int64)) for c, x in zip(["band", "a", "b", "sketch", *_FINE], cols, strict=True)})

    shuffled = rows.mapInArrow(keyed, "shard int, blob binary")
    return shuffled.groupBy("shard").applyInArrow(bucketed, ", ".join(f"{c} bigint" for c in ("band", "a", "b", "sketch", *_FINE)))


class _Lines:
    """Texts of the candidate lines: files of bytes in the shared folder, mapped, and where each line is."""

    def __init__(self, table: HashTable, folder: str, files: list[str]):
        self.table, self.folder, self.files, self.maps = table, folder, files, Maps()

    def sets(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(edges, shingles): the sorted distinct shingles of line i are shingles[edges[i]:edges[i + 1]]."""
        _, at = self.table.find(keys)
        parts: list = [None] * len(keys)
        for k in np.lexsort((at["offset"], at["file"])).tolist():
            o = int(at["offset"][k])
            parts[k] = self.maps.get(f"{self.folder}/{self.files[int(at['file'][k])]}.bytes.npy")[o : o + int(at["length"][k])]
        ends = np.cumsum(at["length"])
        line, words = _shingles(np.concatenate(parts), ends - at["length"], ends)
        both = np.sort((line.astype(U64) << U64(8 * SHINGLE)) | words)
        both = both[np.concatenate([[True], both[1:] != both[:-1]])]
        return np.searchsorted(both >> U64(8 * SHINGLE), np.arange(len(keys) + 1)), both & _MASK


def _store(rows: DataFrame, first: HashTable, wanted: HashTable, scratch: Scratch) -> _Lines:
    folder = f"{scratch.path}/lines"

    def save(batches):
        keys, lengths, texts = [], [], []
        for b in batches:
            for data, starts, ends, h, number, doc in _each_slice(b):
                hit, _ = wanted.find(h)
                hit[hit] = _is_first(first, h[hit], doc[hit], number[hit])
                for k, s, e in zip(h[hit].tolist(), starts[hit].tolist(), ends[hit].tolist(), strict=True):
                    keys.append(k)
                    lengths.append(e - s)
                    texts.append(data[s:e].tobytes())
        if keys:
            name = save_arrays(folder, {"bytes": np.frombuffer(b"".join(texts), np.uint8)})
            n = np.array(lengths, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, U64).view(np.int64)), pa.array([name] * len(n)), pa.array(np.cumsum(n) - n), pa.array(n)], ["key", "name", "offset", "length"])

    found = scratch.table(rows.mapInArrow(save, "key bigint, name string, offset bigint, length bigint"), "places")
    names = sorted(r.name for r in found.select("name").distinct().collect())  # one for each task
    known = name_numbers(found.sparkSession, names, pa.int64())
    places = found.join(known, "name").groupBy("key").agg(F.min(F.struct("file", "offset", "length")).alias("p")).select("key", "p.*")
    return _Lines(build_table(places, scratch, "place", shard_bits(found.count()), ["file", "offset", "length"]), folder, names)


def _verified(pairs: DataFrame, store: _Lines, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least this Jaccard similarity."""

    def spread(edges: np.ndarray, shingles: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The shingles of the lines at, each with the number of its pair."""
        n = edges[at + 1] - edges[at]
        where = np.arange(n.sum()) + np.repeat(edges[at] - np.cumsum(n) + n, n)
        return (np.repeat(np.arange(len(at), dtype=U64), n) << U64(8 * SHINGLE)) | shingles[where]

    def check(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy().view(U64), batch.column(1).to_numpy().view(U64)
            order = np.argsort(a, kind="stable")
            for lo in range(0, len(order), CHECKED):
                part = order[lo : lo + CHECKED]
                keys, at = np.unique(np.concatenate([a[part], b[part]]), return_inverse=True)
                edges, shingles = store.sets(keys)
                i, j = at[: len(part)], at[len(part) :]
                n = np.diff(edges)
                both = np.sort(np.concatenate([spread(edges, shingles, i), spread(edges, shingles, j)]))
                common = np.bincount((both[1:][both[1:] == both[:-1]] >> U64(8 * SHINGLE)).astype(np.int64), minlength=len(part))
                good = common >= similarity * (n[i] + n[j] - common)
                yield pa.RecordBatch.from_arrays([pa.array(a[part][good].view(np.int64)), pa.array(b[part][good].view(np.int64))], ["a", "b"])

    tasks = max(4 * pairs.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // CHECK_PAIRS))
    return pairs.select("a", "b").repartition(tasks, "a").mapInArrow(check, "a bigint, b bigint")


class LineKeepers:
    """For each line the occurrence that stays: exact repeats by their first, similar lines by the first of their component."""

    def __init__(self, first: HashTable, moved: HashTable):
        self.first, self.moved = first, moved

    def stays(self, h: np.ndarray, doc: np.ndarray, number: np.ndarray) -> np.ndarray:
        _, at = self.first.find(h)
        changed, to = self.moved.find(h)
        return np.where(changed, to["doc"], at["doc"]).__eq__(doc) & np.where(changed, to["line"], at["line"]).__eq__(number)


def find_keepers(docs: DataFrame, scratch: Scratch, similarity: float = SIMILARITY) -> LineKeepers:
    """One keeper for each component of similar lines; see dedup_lines."""
    rows = pick(docs, "doc_id", "text")
    firsts = scratch.table(_firsts(rows), "firsts")
    n = firsts.count()
    first = build_table(firsts, scratch, "first", shard_bits(n), ["doc", "line"])
    star = scratch.table(_candidates(rows, first, shard_bits(n * BANDS, BAND_ENTRIES), similarity, scratch), "star")
    scratch.drop("sketches")
    touched = star.select(F.col("a").alias("key")).unionByName(star.select(F.col("b").alias("key"))).distinct()
    store = _store(rows, first, build_table(touched, scratch, "touched", shard_bits(n), []), scratch)
    edges = scratch.table(_verified(scratch.table(star.select("a", "b").distinct(), "pairs"), store, similarity), "edges")
    known = components(edges, scratch, "near")
    # Buckets that the stars have not joined up: test the pairs across their components too.
    labelled = lambda d, c: d.join(known.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    apart = labelled(labelled(star, "a"), "b")
    members = apart.select("band", F.col("b").alias("x"), F.col("rb").alias("rx"), F.col("sketch").alias("s"), *_FINE)
    open_bands = apart.groupBy("band").agg(F.max(F.col("ra") != F.col("rb")).alias("open"), F.count("*").alias("n")).where("open and n > 1").select("band")
    members = members.join(open_bands, "band")
    filled = [F.shiftrightunsigned(F.col(c), SKETCH).cast("int") for c in ("l.s", "r.s")]
    low, high = F.least(*filled), F.greatest(*filled)
    agree = F.lit(SKETCH) - F.bit_count(F.col("l.s").bitwiseXOR(F.col("r.s")).bitwiseAND(F.lit(int(_BITS)))) >= F.element_at(F.array(*[F.lit(int(x)) for x in _least_agreement(similarity)]), low + 1)
    differ = sum(F.bit_count(F.expr(f"(l.f{k} ^ r.f{k}) | (l.f{k + 2} ^ r.f{k + 2})")) for k in (0, 1))
    finely = F.lit(_K) - differ >= F.element_at(F.array(*[F.lit(int(x)) for x in _least_fine(similarity)]), low + 1)
    across = members.alias("l").join(members.alias("r"), "band").where("l.x < r.x and l.rx != r.rx").where((low + 6 >= similarity * high) & agree & finely)
    across = scratch.table(across.select(F.col("l.x").alias("a"), F.col("r.x").alias("b")).distinct(), "across")
    more = scratch.table(_verified(across, store, similarity), "more")
    if more.limit(1).count():
        known = components(edges.unionByName(more), scratch, "all")
    everyone = known.unionByName(known.select(F.col("root").alias("node"), "root").distinct())
    placed = everyone.join(firsts, everyone.node == firsts.key)
    best = placed.groupBy("root").agg(F.min(F.struct("doc", "line")).alias("to"))
    moved = placed.join(best, "root").select("key", "to.doc", "to.line")
    keepers = LineKeepers(first, build_table(moved, scratch, "moved", shard_bits(n), ["doc", "line"]))
    for done in ("firsts", "star", "touched", "lines", "places", "place", "pairs", "edges", "across", "more"):
        scratch.drop(done)
    return keepers


def _rewrite(ids: pa.Array, texts: pa.Array, keepers: LineKeepers) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(texts without their repeated lines, lines removed, lines that were not blank). Texts that lose nothing stay as they are."""
    doc_ids = ids.cast(pa.int64()).fill_null(_NO_DOC).to_numpy(zero_copy_only=False)
    data, offsets = text_bytes(texts)
    removed, solid = np.zeros(len(doc_ids), np.int64), np.zeros(len(doc_ids), np.int64)
    changed: dict[int, str] = {}
    for i, j in slices(offsets, NARROW):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        ls, le, first = lines(part, off)
        doc = doc_of(first)
        number = np.arange(len(ls)) - first[:-1][doc]
        ts, te = trim(part, ls, le)
        full = te > ts
        keep = np.ones(len(ls), dtype=bool)
        keep[full] = keepers.stays(line_hash(part, ts[full], te[full]), doc_ids[i:j][doc[full]], number[full])
        removed[i:j] = np.bincount(doc[~keep], minlength=j - i)
        solid[i:j] = np.bincount(doc[full], minlength=j - i)
        raw = part.tobytes()
        for k in np.flatnonzero(removed[i:j]).tolist():
            left = [raw[ls[x] : le[x]] for x in range(first[k], first[k + 1]) if keep[x]]
            changed[i + k] = b"\n".join(left).decode("utf-8", "replace") if removed[i + k] < solid[i + k] else ""
    if changed:
        values = texts.to_pylist()
        for k, v in changed.items():
            values[k] = v
        texts = pa.array(values, texts.type)
    return texts, removed, solid


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Removes repeated and near-repeated lines from all documents: (doc_id, text, n_lines, removed), one row per row of docs.

    Lines are split at line feeds and compared without ASCII whitespace at either end. Two lines are similar if the
    Jaccard similarity of their sets of 5-byte shingles (UTF-8) is at least similarity; a line shorter than that is
    similar to its equals only, and one of less than 33 bytes stays similar through changes near its ends only. Similar lines form components; of each component the first line stays, by doc_id and
    then by line number. Candidates come from MinHash banding, with a recall of 0.99 at the default threshold, and are
    verified exactly; of the pairs that meet in a band, those whose sketches of 57 or of 250 bits differ too much are not (one similar pair in
    10,000 is lost by either). n_lines counts the lines that are not blank.

    Defined results: blank lines are kept, except in a text that loses all its other lines: that text becomes "". Null
    texts stay null. Rows that share a doc_id count as one document with interchangeable rows (null is an id of its own,
    the least): equal lines at equal places in them stay or go together. An empty table gives an empty result.

    At scale: text itself is never shuffled. Line hashes are aggregated to first occurrences and stored as sorted hash
    arrays in the shared folder, which workers map; band keys of distinct lines are shuffled as binary blocks, with places of their
    sketches, which are written once for each line; only candidate lines have their bytes stored, for verification. In a bucket lines are grouped by their sketches, so lines that met
    by chance go no further. In a group each line is tested against the least one, and then only pairs across components
    are, so hot buckets cost their size, not its square, where their lines are alike.
    """
    scratch = Scratch(docs.sparkSession, "linededup")
    keepers = find_keepers(docs, scratch, similarity)
    rows = pick(docs, "doc_id", "text")

    def rewrite(batches):
        for b in small_batches(batches, 1):
            text, removed, solid = _rewrite(b.column(0), b.column(1), keepers)
            yield pa.RecordBatch.from_arrays([b.column(0), text, pa.array(solid), pa.array(removed)], ["doc_id", "text", "n_lines", "removed"])

    return rows.mapInArrow(rewrite, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_lines bigint, removed bigint")


def without_repeated_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with the texts of dedup_lines and n_chars to match, all other columns as they are; documents that lost all their lines are dropped."""
    scratch = Scratch(docs.sparkSession, "linededup")
    keepers = find_keepers(docs, scratch, similarity)
    at = {n: position(docs, n) for n in ("doc_id", "text", "n_chars")}
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])

    def rewrite(batches):
        for b in small_batches(batches, at["text"]):
            text, removed, solid = _rewrite(b.column(at["doc_id"]), b.column(at["text"]), keepers)
            b = b.set_column(at["text"], f"__c{at['text']}", text)
            yield b.append_column("__gone", pa.array(removed)).filter(pa.array((removed == 0) | (removed < solid)))

    out = safe.mapInArrow(rewrite, plus(safe.schema, "__gone", T.LongType()))
    chars = f"__c{at['n_chars']}"
    kind = safe.schema[chars].dataType
    out = out.withColumn(chars, F.when(F.col("__gone") > 0, F.length(f"__c{at['text']}").cast(kind)).otherwise(F.col(chars)))
    return out.drop("__gone").toDF(*docs.columns)
