"""Interpolated modified Kneser-Ney trigram model: counted in Spark, kept as sorted hash arrays that workers map."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import mix, slices, span_hash, text_bytes, tokens
from .ngramjoin import pack_sorted, summed, unpack_sorted
from .shared import U64, Maps, Scratch, pick, save_arrays, save_packed, shard_bits, shard_of, unpacked

#: Trigram entries that one task merges, and that a map task gathers before it sends them.
SHARD_ENTRIES, FLUSH = 1_500_000, 5_000_000
#: About so many documents, drawn by hash, tell which words are so frequent that their trigrams are spread over several tasks. This only places work.
HOT_SAMPLE = 4000
#: Bytes of text that are scored at once, at most.
SLICE = 1 << 23
_WORD = U64((1 << 48) - 1)
_START = U64(3)  # the two words before a document
_A, _B = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)


def pair_key(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return mix(x * _A + y)


def triple_key(xy: np.ndarray, z: np.ndarray) -> np.ndarray:
    return mix(xy * _B + z)


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(w, first): the words of all documents and, for each document, the number of its first."""
    starts, ends, first = tokens(data, offsets)
    return span_hash(data, starts, ends) & _WORD, first


def two_before(w: np.ndarray, first: np.ndarray, start) -> tuple[np.ndarray, np.ndarray]:
    """(u, v): the two words before each; start stands for those before a document."""
    v, u = np.empty_like(w), np.empty_like(w)
    v[1:], u[2:] = w[:-1], w[:-2]
    heads = first[:-1][np.diff(first) > 0]
    seconds = first[:-1][np.diff(first) > 1] + 1
    v[heads], u[heads], u[seconds] = start, start, start
    return u, v


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _bytes_of(values: np.ndarray) -> bytes:
    """Non-negative integers as one byte each; those of 255 or more follow, with their places."""
    wide = np.flatnonzero(values > 254)
    return np.int64(len(wide)).tobytes() + np.minimum(values, 255).astype(np.uint8).tobytes() + wide.astype("<u4").tobytes() + values[wide].astype("<u4").tobytes()


def _bytes_to(body: np.ndarray, at: int, n: int) -> tuple[np.ndarray, int]:
    """(values, where they end) of _bytes_of."""
    m = int(np.frombuffer(body[at : at + 8].tobytes(), np.int64)[0])
    out = body[at + 8 : at + 8 + n].astype(np.int64)
    at += 8 + n
    if m:
        out[np.frombuffer(body[at : at + 4 * m].tobytes(), "<u4")] = np.frombuffer(body[at + 4 * m : at + 8 * m].tobytes(), "<u4")
    return out, at + 8 * m


def _planes(x: np.ndarray, width: int) -> bytes:
    """The low width bytes of whole numbers, byte plane by byte plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(body: np.ndarray, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = body[at : at + n * width].reshape(width, n).T
    return out.view("<u8")[:, 0], at + n * width


def _encode(names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Entries u v w (ids into names, which are sorted) with counts c, compressed.

    Sorted by v, u, w: each v once, as the gap to the one before, with the length of its run; u as steps within a run. Words
    that u and w name more than once have codes by falling frequency; the others have code 0 and follow in order of use.
    """
    times = np.bincount(np.concatenate([u, w]), minlength=len(names))
    often = np.flatnonzero(times > 1)
    often = often[np.argsort(-times[often], kind="stable")]
    code = np.zeros(len(names), np.int64)
    code[often] = np.arange(1, len(often) + 1)
    order = _order(v, code[u], code[w], len(names) + 1)
    u, v, w, c = u[order], v[order], w[order], c[order]
    uc, wc = code[u], code[w]
    head = _runs(v)
    step = np.diff(uc, prepend=0)
    step[head] = uc[head]
    width = 2 if len(often) < 1 << 16 else 4
    body = _planes(np.diff(names[v[head]], prepend=U64(0)), 6) + _bytes_of(np.diff(np.append(head, len(v))))
    body += _planes(names[np.concatenate([often, u[uc == 0], w[wc == 0]])], 6) + _planes(wc, width) + _planes(step, width) + _bytes_of(c)
    return np.array([len(often), len(u), len(head), int((uc == 0).sum()), int((wc == 0).sum()), width, len(body)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def _decode(blob: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """(names, [u, v, w, counts]): ids into names, in which a word may be more than once."""
    m, n, runs, u_once, w_once, width, size = np.frombuffer(blob[:56], np.int64).tolist()
    body = np.frombuffer(pa.decompress(blob[56:], decompressed_size=size, codec="zstd"), np.uint8)
    gaps, at = _from_planes(body, 0, runs, 6)
    run, at = _bytes_to(body, at, runs)
    names, at = _from_planes(body, at, m + u_once + w_once, 6)
    wc, at = _from_planes(body, at, n, width)
    step, at = _from_planes(body, at, n, width)
    c, _ = _bytes_to(body, at, n)
    step = step.astype(np.int64)
    sums, head = np.cumsum(step), np.cumsum(run) - run
    u, w = sums - np.repeat(sums[head] - step[head], run) - 1, wc.astype(np.int64) - 1
    u[u < 0] = np.arange(m, m + u_once)
    w[w < 0] = np.arange(m + u_once, m + u_once + w_once)
    return np.concatenate([names, np.cumsum(gaps)]), [u, np.repeat(np.arange(len(names), len(names) + runs), run), w, c]


def _encode_part(names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """_encode over the words that are there only."""
    there, ids = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    u, v, w = ids.reshape(3, -1)
    return _encode(names[there], u, v, w, c)


def _encode_words(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> bytes:
    """Pairs of word hashes as entries v v w."""
    names, ids = np.unique(np.concatenate([v, w]), return_inverse=True)
    v, w = ids.reshape(2, -1)
    return _encode(names, v, v, w, c)


def _order(a: np.ndarray, b: np.ndarray, c: np.ndarray, top: int) -> np.ndarray:
    """The order by (a, b, c), all below top; one sort of packed keys where they fit 64 bits."""
    bits = max(1, int(top - 1).bit_length()) if top > 1 else 1
    if 3 * bits <= 63:
        key = a.astype(np.int64) << bits
        key |= b
        key <<= bits
        key |= c
        return np.argsort(key)
    return np.lexsort((c, b, a))


def _gathered(parts: list[tuple[np.ndarray, list[np.ndarray]]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(names, [u, v, w, counts]) of several decoded blobs, with one id per word and the counts of equal entries added up."""
    names, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    u, v, w = (np.concatenate([at[edges[k] : edges[k + 1]][p[1][i]] for k, p in enumerate(parts)]) for i in range(3))
    c = np.concatenate([p[1][3] for p in parts])
    order = _order(v, u, w, len(names))
    u, v, w, c = u[order], v[order], w[order], c[order]
    new = np.ones(len(u), dtype=bool)
    new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
    head = np.flatnonzero(new)
    return names, [u[head], v[head], w[head], np.add.reduceat(c, head)]


#: Bits of a packed key beside the code of its values; the code 7 sends to a list of exceptions.
_LOW_BITS, _RARE = 29, 7


def _table(name: str, keys: np.ndarray, values: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of one table: sorted keys as some bits of index, about 16 keys each, and 29 stored bits, 3 bits of code for the commonest values (n, k), and the places of the others."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    bits = min(16, max(0, len(keys).bit_length() - 5))
    index = np.searchsorted(keys >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64)).astype(np.uint32) if bits else np.array([0, len(keys)], np.uint32)
    small = (values < 1 << (60 // values.shape[1])).all(axis=1)
    code = np.zeros(len(keys), np.int64)
    for k in range(values.shape[1]):
        code = (code << (60 // values.shape[1])) | values[:, k]
    code[~small] = -1 - np.flatnonzero(~small)
    _, at, idx, times = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    turn = np.argsort(-times, kind="stable")
    rank = np.empty(len(turn), np.int64)
    rank[turn] = np.arange(len(turn))
    idx, at = rank[idx], at[turn]
    rare = np.flatnonzero(idx >= _RARE)
    kind = np.uint8 if len(at) <= 1 << 8 else np.uint16 if len(at) <= 1 << 16 else np.uint32
    low = (((keys >> U64(64 - bits - _LOW_BITS)) & U64((1 << _LOW_BITS) - 1)) << U64(3)) | np.minimum(idx, _RARE).astype(U64)
    return {f"{name}.index": index, f"{name}.low": low.astype(np.uint32), f"{name}.rare": rare.astype(np.uint32), f"{name}.idx": idx[rare].astype(kind), f"{name}.dict": values[at]}


class _Mapped:
    """Tables of one shard in a mapped file."""

    def __init__(self, path: str, maps: Maps):
        self.path, self.maps = path, maps

    def get(self, name: str) -> np.ndarray:
        return self.maps.get(f"{self.path}.packed")[name]

    def find(self, table: str, keys: np.ndarray) -> np.ndarray:
        """(n, k) values; a row of zeros where the key is not there."""
        low, index, rare, idx, values = (self.get(f"{table}.{x}") for x in ("low", "index", "rare", "idx", "dict"))
        out = np.zeros((len(keys), values.shape[1]), np.int64)
        if not len(low):
            return out
        bits = (len(index) - 1).bit_length() - 1
        bucket = (keys >> U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        # the stored bits of each key in their place, with a code of 0
        want = (keys >> U64(61 - bits - _LOW_BITS)).astype(np.uint32) & ~np.uint32(_RARE)
        at, end = index.take(bucket).astype(np.int64), index.take(bucket + 1).astype(np.int64)
        # how many of the bucket are less, power of two by power of two, for all keys at once
        step = 1 << int((end - at).max(initial=0)).bit_length() >> 1
        while step:
            probe = at + (step - 1)
            less = low.take(probe, mode="clip") < want
            less &= probe < end
            at += np.multiply(less, step, dtype=np.int64)
            step >>= 1
        got = low.take(at, mode="clip")
        hit = np.flatnonzero(((got ^ want) <= _RARE) & (at < end))
        code = (got[hit] & _RARE).astype(np.int64)
        far = np.flatnonzero(code == _RARE)
        code[far] = idx[np.searchsorted(rare, at[hit[far]])]
        out[hit] = values[code]
        return out


def discounts(n: list[int]) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from n[1..4], the numbers of n-grams of these counts; .5, 1, 1.5 where one of them is 0."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3 and n4):
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip(np.array([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]), 0.0, [0.0, 1.0, 2.0, 3.0])


def _tally(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _profile(key: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key: (sum of counts, how many are 1, 2, 3 or more)."""
    order = np.argsort(key, kind="stable")
    key, c = key[order], counts[order]
    head = _runs(key)
    cols = [np.add.reduceat(x.astype(np.int64), head) if len(head) else np.zeros(0, np.int64) for x in (c, c == 1, c == 2, c > 2)]
    return key[head], np.stack(cols, axis=1)


class KneserNey:
    """A trained model; find its arrays in folder, one file for each kind of table and shard."""

    def __init__(self, folder: str, bits: int, files: dict[str, dict[int, str]], unigram_bits: int, hot: np.ndarray, hot_profile: np.ndarray, d: list[np.ndarray], unigrams: int, words: int):
        self.folder, self.bits, self.files, self.unigram_bits = folder, bits, files, unigram_bits
        self.hot, self.hot_profile, self.d, self.unigrams, self.words, self.maps = hot, hot_profile, d, unigrams, words, Maps(unpacked)

    def _lookup(self, kind: str, table: str, shard: np.ndarray, keys: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros((len(keys), width), np.int64)
        # by shard only: a radix sort, if there are at most 1 << 16
        bits = self.unigram_bits if kind == "one" else self.bits
        order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")
        edges = np.cumsum(np.bincount(shard + 1, minlength=(1 << bits) + 1))
        for s in np.flatnonzero(np.diff(edges)):
            name = self.files[kind].get(int(s))
            if name is None:
                continue
            at = order[edges[s] : edges[s + 1]]
            out[at] = _Mapped(f"{self.folder}/{name}", self.maps).find(table, keys[at])
        return out

    def log_probabilities(self, names: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Natural logarithm of p(w | u v) for each position; u, v and w are ids into names, the different words. What belongs to a word is looked up once for all its positions."""
        d3, d2, d1 = self.d
        # where the shard is named by the first bits of a key, the key is looked up without these
        one = mix(names)
        c1 = self._lookup("one", "one", shard_of(one, self.unigram_bits), (one & ~U64(0xFFFF)) << U64(self.unigram_bits), 1)[:, 0]
        total = max(1, self.unigrams)
        weight = (d1[1:] * np.array(self.n_unigram)).sum() / total if self.unigrams else 1.0
        p = (np.maximum(c1 - d1[np.minimum(c1, 3)], 0) / total + weight / (self.words + 1))[w]
        hot, home = np.isin(names, self.hot), shard_of(one, self.bits)
        profile = np.zeros((len(names), 4), np.int64)
        profile[~hot] = self._lookup("main", "word", home[~hot], one[~hot] << U64(self.bits), 4)
        profile[hot] = self.hot_profile[np.searchsorted(self.hot, names[hot])]
        uv, vw = pair_key(names[u], names[v]), pair_key(names[v], names[w])
        # trigrams with the same middle word are in one shard; those of frequent ones in one for each context
        hot, home = hot[v], home[v]
        cold, warm = np.flatnonzero(~hot), np.flatnonzero(hot)
        c2 = np.zeros(len(w), np.int64)
        c2[cold] = self._lookup("main", "pair", home[cold], vw[cold], 1)[:, 0]
        c2[warm] = self._lookup("hot", "pair", shard_of(vw[warm], self.bits), vw[warm] << U64(self.bits), 1)[:, 0]
        home[warm] = shard_of(uv[warm], self.bits)
        p = _interpolate(c2, *(x[v] for x in _left(profile, d2)), d2, p)
        context = self._lookup("main", "context", home, uv, 4)
        c3 = self._lookup("main", "triple", home, triple_key(uv, names[w]), 1)[:, 0]
        return np.log(_interpolate(c3, *_left(context, d3), d3, p))


def _left(profile: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the counts, share of it that is discounted) of each context."""
    total = profile[:, 0]
    return total, (profile[:, 1] * d[1] + profile[:, 2] * d[2] + profile[:, 3] * d[3]) / np.maximum(total, 1)


def _interpolate(count: np.ndarray, total: np.ndarray, rest: np.ndarray, d: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Discounted share of the count, plus what was discounted in the context times the lower order. A context never seen is skipped."""
    share = np.maximum(count - d[np.minimum(count, 3)], 0) / np.maximum(total, 1)
    return np.where(total > 0, share + rest * lower, lower)


_SCHEMA = "kind string, shard int, file string, blob binary, stats array<bigint>"


def _rows(rows: list[tuple]) -> pa.Table:
    kinds = (("kind", pa.string()), ("shard", pa.int32()), ("file", pa.string()), ("blob", pa.binary()), ("stats", pa.list_(pa.int64())))
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(kinds)})


def _blobs(kind: str, shard: np.ndarray, bits: int, make) -> list[tuple]:
    order = np.argsort(shard, kind="stable")
    edges = np.searchsorted(shard[order], np.arange((1 << bits) + 1))
    return [(kind, int(s), None, make(order[edges[s] : edges[s + 1]]), None) for s in np.flatnonzero(np.diff(edges))]


def _kept(folder: str, blobs: list[tuple]) -> list[tuple]:
    """The blobs' rows with a place in one file of the shared folder instead of the bytes."""
    if not blobs:
        return []
    size = np.array([len(b[3]) for b in blobs])
    name = save_arrays(folder, {"blobs": np.frombuffer(b"".join(b[3] for b in blobs), np.uint8)})
    return [(kind, shard, name, None, [int(at), int(n)]) for (kind, shard, *_), at, n in zip(blobs, np.cumsum(size) - size, size, strict=True)]


def _read(folder: str, table: pa.Table) -> list[bytes]:
    """The bytes of rows of _kept."""
    return [np.load(f"{folder}/{f}.blobs.npy", mmap_mode="r")[at : at + n].tobytes() for f, (at, n) in zip(table["file"].to_pylist(), table["stats"].to_pylist(), strict=True)]


def train(docs: DataFrame, scratch: Scratch, shard_entries: int = SHARD_ENTRIES) -> KneserNey:
    """Counts all trigrams of all documents and stores the model in scratch; see score_documents."""
    spark = docs.sparkSession
    rows = pick(docs, "text")
    size, n_docs = rows.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = shard_bits((size or 0) // 7, shard_entries)
    folder, parts_folder = f"{scratch.path}/model", f"{scratch.path}/parts"

    def each(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            for i, j in slices(offsets):
                yield words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    def drawn_words(batches):
        for w, first in each(batches):
            word, n = np.unique(two_before(w, first, _START)[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], ["word", "n"])

    one_in = max(1, n_docs // HOT_SAMPLE)
    sample = rows.where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(one_in)) == 0).mapInArrow(drawn_words, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    drawn = sample.agg(F.sum("n")).first()[0] or 0 if bits else 0
    limit = drawn / (1 << bits) / 2
    hot = np.sort(np.array([r.word for r in sample.where(F.col("n") > limit).collect()] if drawn else [], np.int64).view(U64))

    def send(batches):
        held, n = [], 0

        def flush():
            words = np.concatenate([*(w for w, _ in held), np.array([_START], U64)])
            first = np.cumsum(np.concatenate([[0], *(np.diff(f) for _, f in held)]))
            held.clear()
            order = np.argsort(words)
            words = words[order]
            new = np.concatenate([[True], words[1:] != words[:-1]])
            names, w = words[new], np.empty(len(words), np.int32)
            del words
            w[order] = np.cumsum(new, dtype=np.int32) - 1
            del order, new
            start, w = w[-1], w[:-1]
            u, v = two_before(w, first, start)
            order = _order(v, u, w, len(names))
            u, v, w = u[order], v[order], w[order]
            new = np.ones(len(u), dtype=bool)
            new[1:] = (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(u)))
            u, v, w = u[head], v[head], w[head]
            del order, new, head
            # trigrams with the same middle word meet in one task; those of frequent ones in one for each context
            shard, spread = shard_of(mix(names), bits)[v], np.flatnonzero(np.isin(names, hot)[v])
            shard[spread] = shard_of(pair_key(names[u[spread]], names[v[spread]]), bits)
            return _rows(_blobs("count", shard, bits, lambda x: _encode_part(names, u[x], v[x], w[x], count[x])))

        for w, first in each(batches):
            held.append((w, first))
            n += len(w)
            if n >= FLUSH:
                yield from flush().to_batches()
                n = 0
        if n:
            yield from flush().to_batches()

    def after_pairs(v, w, n) -> tuple[dict, list[tuple]]:
        """Arrays and rows from complete continuation counts n of the pairs v w."""
        word, profile = _profile(v, n)
        ones, times = summed(mix(w), np.ones(len(w), np.int64))
        out = _blobs("one", shard_of(ones, unigram_bits), unigram_bits, lambda x: pack_sorted(ones[x] >> U64(16), times[x]))
        return (word, profile), [*_kept(parts_folder, out), ("pairs", 0, None, None, _tally(n))]

    unigram_bits = max(0, bits - 2)

    def merge(key, table):
        names, (u, v, w, c) = _gathered([_decode(x) for x in table["blob"].to_pylist()])
        # contexts and pairs by their ids: entries are sorted by (v, u, w)
        head = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1])]))
        part = np.diff(np.append(head, len(v)))
        uv = pair_key(names[u[head]], names[v[head]])
        triple = triple_key(np.repeat(uv, part), names[w])
        arrays = _table("triple", triple, c[:, None])
        rows = [("triples", 0, None, None, _tally(c))]
        profile = np.stack([np.add.reduceat(x.astype(np.int64), head) for x in (c, c == 1, c == 2, c > 2)], axis=1)
        arrays |= _table("context", uv, profile)
        del triple, uv, profile, c
        order = _order(np.zeros_like(v), v, w, len(names))
        v, w = v[order], w[order]
        at = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
        n = np.diff(np.append(at, len(v)))
        v, w = names[v[at]], names[w[at]]
        vw = pair_key(v, w)
        is_hot = np.isin(v, hot)
        cold = ~is_hot
        (word, profile), more = after_pairs(v[cold], w[cold], n[cold])
        arrays |= _table("pair", vw[cold], n[cold][:, None]) | _table("word", mix(word) << U64(bits), profile)
        rows += more
        v, w, n, vw = v[is_hot], w[is_hot], n[is_hot], vw[is_hot]
        rows += _kept(parts_folder, _blobs("hot", shard_of(vw, bits), bits, lambda x: _encode_words(v[x], w[x], n[x])))
        return _rows([("main", key[0].as_py(), save_packed(folder, arrays), None, None), *rows])

    def merge_hot(key, table):
        names, (_, v, w, n) = _gathered([_decode(x) for x in _read(parts_folder, table)])
        v, w = names[v], names[w]
        vw = pair_key(v, w)
        (word, profile), rows = after_pairs(v, w, n)
        rows += [("word", 0, None, None, [x, *p]) for x, p in zip(word.view(np.int64).tolist(), profile.tolist(), strict=True)]
        return _rows([("hot", key[0].as_py(), save_packed(folder, _table("pair", vw << U64(bits), n[:, None])), None, None), *rows])

    def merge_ones(key, table):
        parts = [unpack_sorted(x) for x in _read(parts_folder, table)]
        keys, n = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64))
        file = save_packed(folder, _table("one", (keys << U64(16)) << U64(unigram_bits), n[:, None]))
        return _rows([("one", key[0].as_py(), file, None, [*_tally(n), int((n > 2).sum()), int(n.sum()), len(n)])])

    counted = rows.mapInArrow(send, _SCHEMA).groupBy("shard").applyInArrow(merge, _SCHEMA)
    counted = scratch.table(counted, "counted")
    # rows that only name bytes in the shared folder are spread by number, as their size says nothing of the work
    spread = lambda rows, n: rows.repartition(min(1 << n, 4096), "shard").groupBy("shard")
    hot_rows = scratch.table(spread(counted.where("kind = 'hot'"), bits).applyInArrow(merge_hot, _SCHEMA), "hot")
    ones = spread(counted.where("kind = 'one'").unionByName(hot_rows.where("kind = 'one'")), unigram_bits).applyInArrow(merge_ones, _SCHEMA).drop("blob").collect()
    small = counted.where("kind in ('main', 'triples', 'pairs')").drop("blob").collect() + hot_rows.where("kind in ('hot', 'pairs')").drop("blob").collect()
    profile = {r.stats[0]: r.stats[1:] for r in hot_rows.where("kind = 'word'").groupBy(F.col("stats")[0].alias("w")).agg(F.array("w", *[F.sum(F.col("stats")[k]) for k in range(1, 5)]).alias("stats")).collect()}
    for done in ("counted", "hot", "parts"):
        scratch.drop(done)
    tally = lambda kind: [sum(r.stats[k] for r in small if r.kind == kind) for k in range(4)]
    unigram = [sum(r.stats[k] for r in ones) for k in range(7)] if ones else [0] * 7
    files = {"main": {r.shard: r.file for r in small if r.kind == "main"}, "hot": {r.shard: r.file for r in small if r.kind == "hot"}, "one": {r.shard: r.file for r in ones}}
    profiles = np.array([profile.get(int(x), [0, 0, 0, 0]) for x in hot.view(np.int64)], np.int64).reshape(-1, 4)
    model = KneserNey(folder, bits, files, unigram_bits, hot, profiles, [discounts(tally("triples")), discounts(tally("pairs")), discounts(unigram[:4])], unigram[5], unigram[6])
    model.n_unigram = [unigram[0], unigram[1], unigram[4]]
    return model


def score(docs: DataFrame, model: KneserNey) -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity) for each row of docs under a trained model; one scan, no shuffle."""
    rows = pick(docs, "doc_id", "text")
    # a slice asks every shard, so it grows with their number
    step = min(SLICE, max(1 << 21, 1 << (14 + model.bits)))

    def run(batches):
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            total, count = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
            for i, j in slices(offsets, step):
                w, first = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                names, w = np.unique(np.append(w, _START), return_inverse=True)
                p = model.log_probabilities(names, *two_before(w[:-1], first, w[-1]), w[:-1])
                count[i:j] = np.diff(first)
                full = np.flatnonzero(count[i:j])
                if len(full):
                    total[i + full] = np.add.reduceat(p, first[full])
            none = count == 0
            perplexity = np.exp(-total / np.maximum(count, 1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(count), pa.array(np.round(total, 4) + 0.0), pa.array(np.round(perplexity, 4), mask=none)], ["doc_id", "n_tokens", "log_prob", "perplexity"]
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_tokens bigint, log_prob double, perplexity double")


def score_documents(docs: DataFrame) -> DataFrame:
    """Trains an interpolated modified Kneser-Ney trigram model on all documents and scores each of them:
    (doc_id, n_tokens, log_prob, perplexity), logarithms natural, both figures to four decimals.

    Words are separated by ASCII whitespace; two start words precede each document. Trigrams use their counts, pairs and
    words the numbers of different words before them; each order has three discounts, from its own counts of counts. The
    last order is interpolated with a uniform distribution over all words and one unknown.

    Defined results: texts without words (null, empty, blank) have n_tokens 0, log_prob 0 and perplexity null. Repeated rows
    count as often as they occur. An empty table gives an empty result.

    At scale: trigrams go, as ids in small dictionaries, to the task of their middle word, where counts, contexts and
    continuations are all complete, so one shuffle serves the three orders; words too frequent for one task are spread by
    context and their continuations added up in a second, small step. Tables are sorted hash arrays in the shared folder,
    read by mapping: a worker needs no memory for the model, and nothing is broadcast. All of it grows with the corpus.
    """
    scratch = Scratch(docs.sparkSession, "kneserney")
    result = scratch.table(score(docs, train(docs, scratch)), "scores")
    scratch.drop("model")
    return result
