"""Similarity join of documents by word n-grams: rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .kernels import doc_of, inside, mix, slices, span_hash, text_bytes, tokens, window_hash
from .shared import U64, HashTable, Maps, Scratch, build_table, load_blobs, name_numbers, pick, plus, position, save_arrays, save_blobs, shard_bits, shard_of

#: Words per n-gram and the least Jaccard similarity of a pair.
N, SIMILARITY = 3, 0.5
#: n-gram entries that one task counts or indexes.
SHARD_ENTRIES = 4_000_000
#: Entries that a map task gathers before it sorts and sends them, or writes them.
FLUSH = 1_500_000
#: Ranges of keys that a task counts one after another.
RANGES = 16
#: n-grams of partners of one set that are compared at once.
CHECKED = 1_000_000
_LOW = U64((1 << 48) - 1)
_NO_DOC = np.iinfo(np.int64).min


def gram_sets(batch_text: pa.Array, n: int):
    """For each slice of a text column: (first document, its (document, gram) pairs, distinct and sorted, and the number of documents). A text of fewer than n words is one gram, a text without words has none."""
    data, offsets = text_bytes(batch_text)
    for i, j in slices(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends, first = tokens(part, off)
        h = span_hash(part, starts, ends)
        grams = window_hash(h, n)
        ok = inside(first, n, len(grams))
        doc = doc_of(first)[: len(grams)][ok]
        grams = grams[ok]
        count = np.diff(first)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            whole = [mix(np.array([np.bitwise_xor.reduce(mix(h[first[k] : first[k + 1]] + U64(97) * np.arange(1, count[k] + 1, dtype=U64)))], U64))[0] for k in short]
            doc, grams = np.concatenate([doc, short]), np.concatenate([grams, np.array(whole, U64)])
        grams = grams & _LOW
        order = np.lexsort((grams, doc))
        doc, grams = doc[order], grams[order]
        new = np.ones(len(doc), dtype=bool)
        new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
        yield i, doc[new], grams[new], j - i


def pack_sorted(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys as gaps, with their counts, compressed."""
    gaps = np.diff(keys, prepend=U64(0))
    wide = len(gaps) > 1 and int(gaps[1:].max()) >= 1 << 32
    head = np.array([len(keys), wide, int(keys[0]) if len(keys) else 0], np.int64).tobytes()
    body = gaps[1:].astype("<u8" if wide else "<u4").tobytes() + counts.astype("<u4").tobytes()
    return head + np.array([len(body)], np.int64).tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack_sorted(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide, head, size = np.frombuffer(blob[:32], np.int64)
    body = pa.decompress(blob[32:], decompressed_size=int(size), codec="zstd", asbytes=True)
    width = 8 if wide else 4
    gaps = np.frombuffer(body, "<u8" if wide else "<u4", count=n - 1)
    keys = np.cumsum(np.concatenate([np.array([head], np.int64).view(U64), gaps.astype(U64)]), dtype=U64)
    return keys, np.frombuffer(body, "<u4", count=n, offset=(n - 1) * width)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys with the sums of their counts."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts[order].astype(np.int64), head) if len(head) else np.zeros(0, np.int64)


#: Rows that name bytes in the shared folder.
_PLACES = "shard int, file string, at bigint, size bigint"


def _placed(folder: str, shards: np.ndarray, blobs: list[bytes]) -> pa.RecordBatch:
    """Rows of _PLACES for the blobs of some shards. The bytes are written to the folder: in a shuffle, the JVM would hold them several times."""
    name, at, size = save_blobs(folder, blobs)
    return pa.RecordBatch.from_arrays([pa.array(shards.astype(np.int32)), pa.array([name] * len(blobs), pa.string()), pa.array(at), pa.array(size)], ["shard", "file", "at", "size"])


def _by_shard(places: DataFrame, bits: int):
    """Rows of _PLACES in groups, spread by number, as their size says nothing of the work."""
    return places.repartition(min(1 << bits, 4096), "shard").groupBy("shard")


def _repeated(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the keys that several parts of one shard count twice or more; each part has sorted keys with counts. Only one of RANGES ranges of keys is merged at once."""
    low, high = min(int(k[0]) for k, _ in parts), max(int(k[-1]) for k, _ in parts)
    edges = np.array([low + (high - low) * i // RANGES for i in range(1, RANGES)], U64)
    cuts = [[0, *np.searchsorted(k, edges).tolist(), len(k)] for k, _ in parts]
    out = []
    for r in range(RANGES):
        keys, counts = summed(*(np.concatenate([p[i][c[r] : c[r + 1]] for p, c in zip(parts, cuts, strict=True)]) for i in (0, 1)))
        many = counts > 1
        out.append((keys[many], counts[many]))
    return np.concatenate([k for k, _ in out]), np.concatenate([c for _, c in out])


def count_repeated(rows: DataFrame, scratch: Scratch, n: int, bits: int) -> HashTable:
    """Document frequency of each n-gram that at least two rows hold: counted over all rows, by hash, and stored as sorted arrays."""
    folder, counted = f"{scratch.path}/frequency", f"{scratch.path}/counted"

    def count(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys = np.concatenate(held)
            held.clear()
            keys <<= U64(16)
            keys.sort()
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.append(head, len(keys)))
            keys = keys[head]
            edges = np.searchsorted(shard_of(keys, bits), np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            return _placed(counted, full, [pack_sorted(keys[edges[s] : edges[s + 1]] >> U64(16), counts[edges[s] : edges[s + 1]]) for s in full])

        for b in batches:
            for _, _, grams, _ in gram_sets(b.column(0), n):
                if len(grams):
                    held.append(grams)
                    size += len(grams)
                if size >= FLUSH:
                    yield flush()
                    size = 0
        if size:
            yield flush()

    def total(key, table):
        # counts are copied, so that no unpacked blob stays
        keys, counts = _repeated([(k, c.copy()) for k, c in map(unpack_sorted, load_blobs(counted, table))])
        name = save_arrays(folder, {"key": keys << U64(16), "df": np.minimum(counts, 65535).astype(np.uint16)})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": [name]})

    files = _by_shard(rows.select("text").mapInArrow(count, _PLACES), bits).applyInArrow(total, "shard int, file string").collect()
    scratch.drop("counted")
    return HashTable(folder, bits, {r.shard: r.file for r in files}, ["df"])


class _Sets:
    """Ordered n-gram arrays of documents in mapped files of the shared folder."""

    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files, self.maps = folder, files, Maps()

    def get(self, file: int, offset: int, n: int) -> np.ndarray:
        return self.maps.get(f"{self.folder}/{self.files[file]}.order.npy")[offset : offset + n]


def _ordered_sets(rows: DataFrame, frequency: HashTable, scratch: Scratch, n: int, similarity: float) -> tuple[DataFrame, _Sets]:
    """Rows (rid, doc_id, set_hash, size, kept, file, offset) of the documents that can have a partner, and their ordered arrays.

    The order is rare-first: by document frequency, then hash. n-grams of frequency 1 come first; they match nothing, so only
    their number counts. If they fill the prefix, the document has no partner.
    """
    folder = f"{scratch.path}/sets"

    def order_sets(batches):
        arrays, out, at = [], [], 0

        def flush():
            name = save_arrays(folder, {"order": np.concatenate(arrays)})
            for id_, h, size, k, offset in out:
                yield pa.RecordBatch.from_arrays([id_, pa.array(h), pa.array(size.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array([name] * len(h), pa.string()), pa.array(offset)], ["doc_id", "set_hash", "size", "kept", "name", "offset"])

        for b in batches:
            ids = b.column(0)
            for i, doc, grams, n_docs in gram_sets(b.column(1), n):
                size = np.bincount(doc, minlength=n_docs)
                found, f = frequency.find(grams << U64(16))
                doc, grams, df = doc[found], grams[found], f["df"][found].astype(U64)
                kept = np.bincount(doc, minlength=n_docs)
                able = (size > 0) & (kept >= np.ceil(similarity * size - 1e-9)) & (kept > 0)
                mine = able[doc]
                doc, key = doc[mine], (df[mine] << U64(48)) | grams[mine]
                order = np.lexsort((key, doc))
                key = key[order]
                arrays.append(key)
                k = kept[able]
                heads = np.cumsum(k) - k
                h = np.add.reduceat(mix(key), heads).view(np.int64) if len(k) else np.zeros(0, np.int64)
                out.append((ids.take(pa.array(i + np.flatnonzero(able))), h, size[able], k, at + heads))
                at += len(key)
                if at >= FLUSH:
                    yield from flush()
                    arrays, out, at = [], [], 0
        if at:
            yield from flush()

    kind = dict(rows.dtypes)["doc_id"]
    found = scratch.table(rows.select("doc_id", "text").mapInArrow(order_sets, f"doc_id {kind}, set_hash bigint, size int, kept int, name string, offset bigint"), "found")
    names = sorted(r.name for r in found.select("name").distinct().collect())  # one for each FLUSH entries
    known = name_numbers(found.sparkSession, names, pa.int32())
    numbered = found.join(F.broadcast(known) if len(names) < 100_000 else known, "name").drop("name")
    return numbered.withColumn("rid", F.shiftleft(F.col("file").cast("bigint"), 40) + F.col("offset")), _Sets(folder, names)


def _prefix(size: np.ndarray, kept: np.ndarray, similarity: float) -> np.ndarray:
    """How many of the stored n-grams belong to the prefix, whose length is size - ceil(t * size) + 1."""
    return np.minimum(size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1 - (size - kept), kept)


def _index(reps: DataFrame, sets: _Sets, scratch: Scratch, bits: int, similarity: float) -> tuple[str, dict[int, str]]:
    """Postings (rid, size, kept, position) of each n-gram of the sets' indexed prefixes, sorted by n-gram in mapped files.

    A set is found by sets of its size or larger only, which share 2t / (1 + t) of it at least: its prefix is that of this share.
    """
    folder, posted = f"{scratch.path}/index", f"{scratch.path}/posted"
    kinds = np.dtype([("gram", "<u8"), ("rid", "<i8"), ("size", "<i4"), ("kept", "<i4"), ("pos", "<i4")])

    def post(batches):
        for b in batches:
            rid, size, kept, file, offset = (b.column(i).to_numpy() for i in range(5))
            p = np.maximum(_prefix(size, kept, 2 * similarity / (1 + similarity)), 0)
            total = int(p.sum())
            rows = np.empty(total, kinds)
            at = 0
            for r, s, k, f, o, q in zip(rid.tolist(), size.tolist(), kept.tolist(), file.tolist(), offset.tolist(), p.tolist(), strict=True):
                mine = rows[at : at + q]
                mine["gram"] = sets.get(f, o, q)
                mine["rid"], mine["size"], mine["kept"] = r, s, k
                mine["pos"] = np.arange(s - k, s - k + q)
                at += q
            shard = shard_of(mix(rows["gram"]), bits)
            order = np.argsort(shard, kind="stable")
            rows, edges = rows[order], np.searchsorted(shard[order], np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            if len(full):
                yield _placed(posted, full, [_squeezed(rows[edges[s] : edges[s + 1]]) for s in full])

    def build(key, table):
        rows = np.concatenate([np.frombuffer(pa.decompress(memoryview(x)[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd"), kinds) for x in load_blobs(posted, table)])
        order = np.argsort(rows["gram"], kind="stable")
        grams, count = np.unique(rows["gram"], return_counts=True)
        name = save_arrays(folder, {"gram": grams, "start": np.cumsum(count) - count, "count": count, **{c: rows[c][order] for c in ("rid", "size", "kept", "pos")}})
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": [name]})

    found = _by_shard(reps.select("rid", "size", "kept", "file", "offset").mapInArrow(post, _PLACES), bits).applyInArrow(build, "shard int, file string")
    files = {r.shard: r.file for r in found.collect()}
    scratch.drop("posted")
    return folder, files


def _squeezed(rows: np.ndarray) -> bytes:
    raw = rows.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


class _Probe:
    """Finds and verifies the partners of one set after another."""

    def __init__(self, sets: _Sets, folder: str, files: dict[int, str], bits: int, similarity: float):
        self.sets, self.folder, self.files, self.bits, self.t, self.maps = sets, folder, files, bits, similarity, Maps()

    def _shard(self, s: int):
        name = self.files.get(s)
        return name and {c: self.maps.get(f"{self.folder}/{name}.{c}.npy") for c in ("gram", "start", "count", "rid", "size", "kept", "pos")}

    def _postings(self, grams: np.ndarray, rid: int, size: int):
        """(index into grams, rid, size, kept, pos) of the grams' postings of sets before (size, rid) that are not too small."""
        shard = shard_of(mix(grams), self.bits)
        out = []
        for s in np.unique(shard):
            part = self._shard(int(s))
            if not part or not len(part["gram"]):
                continue
            mine = np.flatnonzero(shard == s)
            at = np.searchsorted(part["gram"], grams[mine])
            at[at == len(part["gram"])] = 0
            hit = part["gram"][at] == grams[mine]
            at, mine = at[hit], mine[hit]
            start, count = part["start"][at], part["count"][at]
            n = int(count.sum())
            if n:
                where = np.arange(n) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
                other, osize = part["rid"][where], part["size"][where]
                ok = np.flatnonzero(((osize < size) | ((osize == size) & (other < rid))) & (osize >= self.t * size - 1e-9))
                where = where[ok]
                out.append((np.repeat(mine, count)[ok], other[ok], *(x.astype(np.int64) for x in (osize[ok], part["kept"][where], part["pos"][where]))))
        return [np.concatenate(x) for x in zip(*out, strict=True)] if out else None

    def partners(self, rid: int, size: int, kept: int, file: int, offset: int) -> list[tuple[int, float]]:
        """The sets (rid, similarity) that come before this one in the order of (size, rid) and are similar to it."""
        t, mine = self.t, self.sets.get(file, offset, kept)
        mine = np.array(mine)
        got = self._postings(mine[: int(_prefix(np.int64(size), np.int64(kept), t))], rid, size)
        if got is None:
            return []
        i, other, osize, okept, j = got
        # the first common n-gram of each pair; verified once
        if not len(i):
            return []
        order = np.argsort(i.astype(np.uint16) if kept < 1 << 16 else i, kind="stable")
        order = order[np.argsort(other[order], kind="stable")]
        other = other[order]
        new = np.ones(len(other), dtype=bool)
        new[1:] = other[1:] != other[:-1]
        take = order[new]
        other, i, osize, okept, j = other[new], i[take], osize[take], okept[take], j[take]
        need = np.ceil(t / (1 + t) * (size + osize) - 1e-9).astype(np.int64)
        # positional filter: what can still match from the first common n-gram on
        pos = i + size - kept
        ok = 1 + np.minimum(size - pos - 1, osize - j - 1) >= need
        other, i, osize, okept, j, need = (x[ok] for x in (other, i, osize, okept, j, need))
        # what of each partner is left from there on: its file's part, read at once for CHECKED n-grams
        skip = j - (osize - okept)
        rest = okept - skip
        out = []
        edges = np.searchsorted(np.cumsum(rest) - rest, np.arange(0, int(rest.sum()) + CHECKED, CHECKED))
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if lo == hi:
                continue
            o, m, at = other[lo:hi], rest[lo:hi], (other[lo:hi] & ((1 << 40) - 1)) + skip[lo:hi]
            right = np.concatenate([self.sets.get(f, x, k) for f, x, k in zip((o >> 40).tolist(), at.tolist(), m.tolist(), strict=True)])
            start = np.cumsum(m) - m
            # suffix filter: pivots cut both suffixes; pieces of unequal length cannot match in full
            cuts = np.stack([np.zeros_like(m), m // 4, m // 2, 3 * m // 4, m], axis=1)
            theirs = np.diff(cuts, axis=1)
            mids = np.searchsorted(mine, right[start[:, None] + cuts[:, 1:4]])
            ours = np.diff(np.column_stack([i[lo:hi], mids, np.full(len(m), len(mine))]), axis=1)
            able = (m < 8) | (np.minimum(theirs, ours).sum(axis=1) >= need[lo:hi])
            if not able.all():
                right, m = right[np.repeat(able, m)], m[able]
                start = np.cumsum(m) - m
            if not len(m):
                continue
            found = np.searchsorted(mine, right)
            found[found == len(mine)] = 0
            common = np.add.reduceat((mine[found] == right).astype(np.int64), start)
            good = common >= need[lo:hi][able]
            total = size + osize[lo:hi][able][good] - common[good]
            out.extend(zip(o[able][good].tolist(), (common[good] / total).tolist(), strict=True))
        return out


def _similar_sets(docs: DataFrame, scratch: Scratch, n: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members (doc_id, rid, root, alike) share root if they share all n-grams of frequency 2 or more and are as
    large, and that makes them similar; alike is their similarity. pairs (a, b, similarity) of roots, each once."""
    rows = pick(docs, "doc_id", "text")
    grams = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = shard_bits(grams // 6, SHARD_ENTRIES)
    frequency = count_repeated(rows, scratch, n, bits)
    numbered, sets = _ordered_sets(rows, frequency, scratch, n, similarity)
    # n-grams of frequency 1 are not in the hash: with too many of them equal hashes don't make a pair, and each set is its own root
    apart = F.col("kept") < F.ceil(F.lit(2 * similarity / (1 + similarity)) * F.col("size") - 1e-9)
    numbered = numbered.withColumn("set_hash", F.when(apart, F.xxhash64("set_hash", "rid")).otherwise(F.col("set_hash")))
    roots = numbered.groupBy("set_hash", "size", "kept").agg(F.min(F.struct("rid", "file", "offset")).alias("r"))
    roots = scratch.table(roots.select("set_hash", "size", "kept", "r.*"), "roots")
    members = numbered.select("doc_id", "rid", "set_hash", "size", "kept").join(roots.select("set_hash", "size", "kept", F.col("rid").alias("root")), ["set_hash", "size", "kept"])
    members = members.select("doc_id", "rid", "root", (F.col("kept") / (2 * F.col("size") - F.col("kept"))).alias("alike"))
    members = scratch.table(members, "members")
    scratch.drop("frequency")
    entries = roots.agg(F.sum("kept")).first()[0] or 0
    index_bits = shard_bits(entries, SHARD_ENTRIES)
    spread = roots.repartition(max(8, -(-entries // 400_000)), "rid")
    folder, files = _index(spread, sets, scratch, index_bits, similarity)
    probe = _Probe(sets, folder, files, index_bits, similarity)

    def search(batches):
        for b in batches:
            rid, size, kept, file, offset = (b.column(i).to_pylist() for i in range(5))
            a, other, score = [], [], []
            for r, s, k, f, o in zip(rid, size, kept, file, offset, strict=True):
                for q, x in probe.partners(r, s, k, f, o):
                    a.append(r)
                    other.append(q)
                    score.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(other, pa.int64()), pa.array(a, pa.int64()), pa.array(score, pa.float64())], ["a", "b", "similarity"])

    pairs = spread.select("rid", "size", "kept", "file", "offset").mapInArrow(search, "a bigint, b bigint, similarity double")
    pairs = scratch.table(pairs, "pairs")
    for done in ("index", "sets", "found", "roots"):
        scratch.drop(done)
    return members, pairs


def ngram_jaccard_pairs(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """All pairs of documents whose sets of word n-grams have at least this Jaccard similarity: (doc_a, doc_b, jaccard), doc_a <= doc_b, jaccard to six decimals.

    Words are separated by ASCII whitespace and compared as they are. A text of fewer than n words is one n-gram, all its
    words. The join is exact but for hash collisions of 48-bit n-grams.

    Defined results: null, empty and blank texts have no n-grams and no partner. Each row is a document: rows that share a
    doc_id, or have equal texts, pair up with one another (jaccard 1); a null doc_id is ordered first. An empty table gives
    an empty result.

    At scale: n-gram frequencies are counted over all documents in compressed blocks and stored as sorted hash arrays in the
    shared folder, which workers map. An n-gram of frequency 1 is never sent anywhere, so documents without partners cost one
    lookup. Documents with equal sets are joined once, for all of them. Postings of prefix n-grams are an inverted index of
    mapped arrays; each set probes it once and verifies each candidate once, with no shuffle of candidates or sets.
    """
    members, pairs = _similar_sets(docs, Scratch(docs.sparkSession, "ngramjoin"), n, similarity)
    side = lambda m, r: members.select(F.col("doc_id").alias(m), F.col("root").alias(r), F.col("rid").alias(f"{m}_rid"), F.col("alike").alias(f"{m}_alike"))
    across = pairs.join(side("x", "a"), "a").join(side("y", "b"), "b").select("x", "y", "similarity")
    alike = side("x", "a").join(side("y", "b"), F.col("a") == F.col("b")).where("x_rid < y_rid").select("x", "y", F.col("x_alike").alias("similarity"))
    swap = F.col("y").isNull() & F.col("x").isNotNull() | (F.col("x") > F.col("y"))
    return across.unionByName(alike).select(
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("doc_a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("doc_b"), F.round("similarity", 6).alias("jaccard")
    )


def similar_documents(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """The similarity join of ngram_jaccard_pairs by document: (doc_id, class_id, n_links, best), one row per row of docs that is similar to another.

    n_links counts the rows similar to it, equal texts among them; best is the greatest of their Jaccard similarities, to six
    decimals. Documents linked directly or through others share class_id, the least doc_id of them. A document that is similar
    to no other has no row.

    Defined results: as for ngram_jaccard_pairs; class_id is null only where all doc_ids of a class are.

    At scale: links are counted from pairs of different sets and the numbers of their copies, so a group of equal texts costs
    its size, and no pair of copies is ever made.
    """
    scratch = Scratch(docs.sparkSession, "ngramclasses")
    members, pairs = _similar_sets(docs, scratch, n, similarity)
    sizes = members.groupBy("root").agg(F.count("*").alias("c"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity"))
    links = both.join(sizes.withColumnRenamed("root", "b"), "b").groupBy("a").agg(F.sum("c").alias("other"), F.max("similarity").alias("near"))
    known = components(pairs.select("a", "b"), scratch, "classes")
    roots = sizes.join(links.withColumnRenamed("a", "root"), "root", "left").join(known.select(F.col("node").alias("root"), F.col("root").alias("class")), "root", "left")
    roots = roots.select("root", F.coalesce("class", "root").alias("class"), (F.col("c") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), "near", "c").where("n_links > 0")
    rows = members.join(roots, "root").withColumn("best", F.round(F.greatest("near", F.when(F.col("c") > 1, F.col("alike"))), 6))
    least = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"))
    out = scratch.table(rows.join(least, "class").select("doc_id", "class_id", "n_links", "best"), "linked")
    for done in ("members", "pairs"):
        scratch.drop(done)
    return out


def _hashed_ids(batches):
    for b in batches:
        key = mix(b.column(0).to_numpy().view(U64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(key), b.column(1), b.column(2)], ["key", "stay", "copies"])


def drop_near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document of each group of near duplicates (a component of the pairs): the one with the least doc_id. All columns stay.

    Documents without n-grams are in no group. Rows that share a doc_id are one document; if it stays in a group, one of its rows does.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    members, pairs = _similar_sets(docs, scratch, n, similarity)
    known = components(pairs.select("a", "b"), scratch, "groups")
    grouped = members.join(known, members.root == known.node, "left").select("doc_id", "rid", F.coalesce(known.root, members.root).alias("grp"))
    best = grouped.groupBy("grp").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("m"), F.count("*").alias("c")).where("c > 1").select("grp", F.col("m.doc_id").alias("keeper"))
    judged = grouped.join(best, "grp").select("doc_id", (F.col("doc_id").eqNullSafe(F.col("keeper"))).alias("stay"))
    verdicts = judged.groupBy("doc_id").agg(F.min("stay").alias("stay"), F.count("*").alias("copies"))
    verdicts = verdicts.where("not stay or copies > 1").select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_NO_DOC)).alias("doc_id"), F.when(F.col("stay"), 1).otherwise(0).alias("stay"), "copies")
    verdicts = scratch.table(verdicts.mapInArrow(_hashed_ids, "key bigint, stay int, copies bigint"), "verdicts")
    table = build_table(verdicts, scratch, "verdict", shard_bits(verdicts.count()), ["stay", "copies"])
    repeated = bool(verdicts.where("stay = 1").limit(1).count())
    at = position(docs, "doc_id")
    safe = docs.toDF(*[f"__c{i}" for i in range(len(docs.columns))])

    def judge(batches):
        for b in batches:
            found, v = table.find(mix(b.column(at).cast(pa.int64()).fill_null(_NO_DOC).to_numpy(zero_copy_only=False).view(U64)))
            b = b.append_column("__again", pa.array(found))
            yield b.filter(pa.array(~found | (v["stay"] == 1)))

    kept = safe.mapInArrow(judge, plus(safe.schema, "__again", T.BooleanType()))
    for done in ("members", "pairs", "verdicts"):
        scratch.drop(done)
    if repeated:  # keepers whose doc_id occurs more than once
        kept = kept.where("not __again").unionByName(kept.where("__again").dropDuplicates([f"__c{at}"]))
    return kept.drop("__again").toDF(*docs.columns)
