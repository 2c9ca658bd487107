"""Repeated passages: the interval tree of common prefixes over an enhanced suffix array, built in parts that no repeat crosses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .kernels import _powers, doc_of, inside, mix, slices, span_hash, text_bytes, tokens, window_hash
from .ngramjoin import FLUSH, pack_sorted, summed, unpack_sorted
from .shared import U64, HashTable, Maps, Scratch, pick, save_arrays, shard_bits, shard_of

#: Least length of a repeat in words.
MIN_WORDS = 50
#: Entries that one task sorts.
SHARD_ENTRIES = 4_000_000
#: Suffixes that one task of the last pass sorts and scans, copies counted.
TREE_ENTRIES = 100_000
_EDGE = U64(0)  # the left neighbour of a document's first word


def lcp_intervals(lcp: np.ndarray, least: int):
    """Intervals (length, first, last) of the interval tree with length >= least, from one stack scan. lcp[i]: words that suffixes i-1 and i share; lcp[0] = 0."""
    stack = [(0, 0)]  # (length, left end)
    n = len(lcp)
    for i in range(1, n + 1):
        v = int(lcp[i]) if i < n else 0
        left = i - 1
        while stack[-1][0] > v:
            length, left = stack.pop()
            if length >= least:
                yield length, left, i - 1
        if stack[-1][0] < v:
            stack.append((v, left))


def sorted_suffixes(texts: list[np.ndarray], text: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, lcp) of the suffixes texts[text[i]][offset[i]:]: the sorted order, and the words that each shares with the one before.

    Few suffixes of each text are copied and compared. Many, as in periodic text, are ranked by prefix doubling, whose ranks
    also give the common prefixes; both ways give the same lcp.
    """
    size = np.array([len(t) for t in texts])
    lcp = np.zeros(len(text), np.int64)
    if (size[text] - offset).sum() <= 4 * size.sum():
        suffixes = [texts[t][o:] for t, o in zip(text.tolist(), offset.tolist(), strict=True)]
        order = sorted(range(len(suffixes)), key=lambda i: suffixes[i].astype(">u4").tobytes())
        for k in range(1, len(order)):
            a, b = suffixes[order[k - 1]], suffixes[order[k]]
            m = min(len(a), len(b))
            differ = a[:m] != b[:m]
            at = int(differ.argmax()) if m else 0
            lcp[k] = at if m and differ[at] else m
        return np.array(order), lcp
    # each text ends in a sign of its own, so no common prefix passes an end
    joined = np.concatenate([np.append(t.astype(np.int64), -1 - k) for k, t in enumerate(texts)])
    at = (np.cumsum(size + 1) - size - 1)[text] + offset
    ranks = [np.unique(joined, return_inverse=True)[1].astype(np.int32)]  # ranks[k]: of the 2^k words from each place on
    while (1 << (len(ranks) - 1)) <= size.max():
        r, step = ranks[-1], 1 << (len(ranks) - 1)
        after = np.zeros(len(r), np.int64)
        after[:-step] = r[step:]
        ranks.append(np.unique(r * np.int64(len(r)) + after, return_inverse=True)[1].astype(np.int32))
    order = np.argsort(ranks[-1][at], kind="stable")
    a, b = at[order[:-1]].copy(), at[order[1:]].copy()
    for k in range(len(ranks) - 1, -1, -1):
        same = np.flatnonzero(ranks[k][a] == ranks[k][b])
        a[same] += 1 << k
        b[same] += 1 << k
    lcp[1:] = a - at[order[:-1]]
    return order, lcp


def maximal_repeats(texts: list[np.ndarray], text: np.ndarray, offset: np.ndarray, lefts: np.ndarray, copies: np.ndarray, varied: np.ndarray, least: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order, [(length, first, last)]): the sorted suffixes texts[text[i]][offset[i]:], which share a prefix, and the maximal repeats among them as intervals of that order.

    texts: word hashes to the end of the region; lefts: the word before each suffix (0 at a document's start). Suffix i stands
    for copies[i] places with the same words to the region's end; varied[i]: the words before these differ, or are starts of
    several documents. Sorts the suffixes, computes common prefixes of neighbours, scans the interval tree and keeps the
    intervals whose left extensions differ: two different words before, or a document's start.
    """
    order, lcp = sorted_suffixes(texts, text, offset)
    left = lefts[order]
    # changes[i]: how many of left[1..i] differ from the one before, or are a document's start
    change = np.zeros(len(order), np.int64)
    change[1:] = (left[1:] != left[:-1]) | (left[1:] == _EDGE)
    change, within = np.cumsum(change), np.cumsum(np.append(0, varied[order]))
    size = np.array([len(t) for t in texts])[text[order]] - offset[order]
    around = np.maximum(lcp, np.append(lcp[1:], 0))
    # places that share one suffix are an interval of their own, unless a neighbour goes on beyond them
    alone = np.flatnonzero((copies[order] > 1) & varied[order] & (size > around) & (size >= least))
    found = [(int(size[i]), int(i), int(i)) for i in alone]
    found += [(length, i, j) for length, i, j in lcp_intervals(lcp, least) if change[j] > change[i] or within[j + 1] > within[i]]
    return order, found


class _Slice:
    """Words of a slice of documents: 64-bit hashes, and windows of least words by their first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        starts, ends, self.first = tokens(data, offsets)
        self.words = span_hash(data, starts, ends)
        self.words[self.words == _EDGE] = U64(1)
        grams = window_hash(self.words, width)
        self.windows = grams
        self.ok = inside(self.first, width, len(grams))


def run_hash(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words starts..ends-1."""
    p, inv = _powers(len(words))
    sums = np.zeros(len(words) + 1, dtype=U64)
    np.cumsum(mix(words) * p[: len(words)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inv[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def _slide(a: np.ndarray, span: int, pick_of) -> np.ndarray:
    """pick_of (np.minimum or np.maximum) over each run of span entries, by doubling."""
    reach = 1
    while reach * 2 <= span:
        a = pick_of(a[: len(a) - reach], a[reach:])
        reach *= 2
    return pick_of(a[: len(a) - (span - reach)], a[span - reach :]) if reach < span else a


def _anchors(s: _Slice, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, chosen): for each window of width words the least hash of its half-width grams, 0 for windows across documents; and the hashes of all grams that are such a minimum, one entry for each place.

    The choice depends on the window's words alone, so equal windows have equal anchors.
    """
    half = width // 2
    grams = window_hash(s.words, half)
    span = width - half + 1  # half-width grams in a window
    if len(s.words) < width:
        return np.zeros(0, U64), np.zeros(0, U64)
    low = np.where(s.ok, _slide(grams, span, np.minimum), U64(0))
    pad = np.zeros(span - 1, U64)
    # a gram is a minimum if the greatest of the minima around it is its own hash
    return low, grams[_slide(np.concatenate([pad, low, pad]), span, np.maximum) == grams]


def _count(rows: DataFrame, folder: str, bits: int, gather, least_diverse: bool) -> HashTable:
    """Counts hashes that gather(slice) yields as (hash, left), and stores those that occur twice or more; with least_diverse only if their lefts differ (or one is a document's start)."""

    def send(batches):
        held, before, size = [], [], 0

        def flush():
            key, left = np.concatenate(held), np.concatenate(before)
            if not least_diverse:
                key = np.sort(key)
                key, weight = summed(key, np.ones(len(key), np.int64))
            else:
                # (hash, left) once each; a start or a second left marks the hash diverse
                order = np.lexsort((left, key))
                key, left = key[order], left[order]
                new = np.ones(len(key), dtype=bool)
                new[1:] = (key[1:] != key[:-1]) | (left[1:] != left[:-1])
                count = np.diff(np.append(np.flatnonzero(new), len(key)))
                key, left = key[new], left[new]
                head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                variety = np.diff(np.append(head, len(key)))
                total = np.add.reduceat(count, head)
                start = np.add.reduceat((left == _EDGE).astype(np.int64), head)
                # weight: diverse (1), more than one occurrence (2), a start (4); side: the only left, if it is needed
                weight = ((variety > 1).astype(np.int64)) | (2 * (total > 1)) | (4 * (start > 0))
                key, side = key[head], np.where((variety > 1) | (start > 0), _EDGE, left[head])
            edges = np.searchsorted(shard_of(key, bits), np.arange((1 << bits) + 1))
            full = np.flatnonzero(np.diff(edges))
            blobs = [pack_sorted(key[edges[s] : edges[s + 1]] >> U64(16), weight[edges[s] : edges[s + 1]]) for s in full]
            sides = [side[edges[s] : edges[s + 1]].tobytes() if least_diverse else b"" for s in full]
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary()), pa.array(sides, pa.binary())], ["shard", "blob", "sides"])

        for b in batches:
            for key, left in gather(b):
                if len(key):
                    held.append(key & ~U64(0xFFFF))
                    before.append(left)
                    size += len(key)
                if size >= FLUSH:
                    yield flush()
                    held, before, size = [], [], 0
        if size:
            yield flush()

    def total(key, table):
        parts = [unpack_sorted(x) for x in table["blob"].to_pylist()]
        keys, weight = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]).astype(np.int64)
        if not least_diverse:
            keys, weight = summed(keys, weight)
            good = keys[weight > 1]
        else:
            side = np.concatenate([np.frombuffer(x, U64) for x in table["sides"].to_pylist()])
            order = np.lexsort((side, keys))
            keys, weight, side = keys[order], weight[order], side[order]
            head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            flags = np.bitwise_or.reduceat(weight, head)
            differ = np.zeros(len(keys), np.int64)
            differ[1:] = (side[1:] != side[:-1]) & (keys[1:] == keys[:-1])
            many = (np.diff(np.append(head, len(keys))) > 1) | ((flags & 2) > 0)
            good = keys[head][many & (((flags & 5) > 0) | (np.add.reduceat(differ, head) > 0))]
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "file": [save_arrays(folder, {"key": good << U64(16)})]})

    files = rows.mapInArrow(send, "shard int, blob binary, sides binary").groupBy("shard").applyInArrow(total, "shard int, file string").collect()
    return HashTable(folder, bits, {r.shard: r.file for r in files}, [])


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All maximal repeats of at least min_words words, with all their occurrences, as the intervals of a suffix array and its entries.

    Result: (group_id BIGINT, kind STRING, first INT, last INT, words INT, n BIGINT, doc_id BIGINT, start INT). A row of kind
    'occurrence' is a place where a maximal repeat begins: word start of document doc_id, with its rank (first = last) in
    the sorted order of its group; words is the length of the longest maximal repeat there. A row of kind 'repeat' is a
    maximal repeat: words words with n occurrences, which are the occurrence rows of its group with ranks first..last; its
    doc_id and start name one of them. So nested repeats share the rows of their occurrences, and the result is linear in
    the text, where lists for each repeat can be quadratic; repeat_occurrences writes them out.

    A repeat is a word sequence with two occurrences or more, in one document or several; it is maximal if the occurrences do
    not all go on with the same word, nor all have the same word before (a document's ends count as words of their own).
    Occurrences may overlap, as in periodic text. Words are separated by ASCII whitespace and compared as they are.

    Defined results: null, empty and short texts have no repeats. Each row is a document: repeated rows repeat all their
    words; rows that share a doc_id appear under it more than once. An empty table gives an empty result.

    How: all suffixes with a repeat of min_words at their start share their first min_words words, so the suffix array is built
    in groups, one for each such window, and no interval of the tree crosses groups. A group in which every suffix has the
    same word before it holds no maximal repeat and is never built: what is left are the places where repeats begin. (1)
    Anchors, the least half-window in each window, are counted over all documents. (2) Windows with a repeated anchor are
    counted with the words before them. (3) Runs of repeated windows are written to mapped files, once for each distinct run of
    a task; runs with equal words form a class. (4) The suffixes of classes are grouped, sorted and scanned, with the number
    of their copies; last, the occurrences of a class are joined to its suffixes.

    At scale: passes 1 and 2 shuffle compressed hashes, of about one word in thirteen, and of repeated text only; pass 4
    shuffles a fixed number of bytes for each begin of a repeat in distinct text, never words, and copies are counted with
    map-side combine, so a passage with very many copies is one suffix to its task. Unrepeated text never leaves its task.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffixes")
    rows = pick(docs, "doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    words = size // 6
    low_bits, bits = shard_bits(words // 10, SHARD_ENTRIES), shard_bits(words // 2, SHARD_ENTRIES)

    def each(batch):
        data, offsets = text_bytes(batch.column("text"))
        for i, j in slices(offsets):
            yield i, _Slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], min_words)

    def anchor_hashes(batch):
        for _, s in each(batch):
            _, chosen = _anchors(s, min_words)
            yield chosen, chosen

    anchors = _count(rows.select("text"), f"{scratch.path}/anchors", low_bits, anchor_hashes, False)

    def repeated(s: _Slice, table: HashTable) -> np.ndarray:
        """Which windows have a repeated anchor."""
        low, _ = _anchors(s, min_words)
        use = np.flatnonzero(s.ok[: len(low)])
        found, _ = table.find(low[use] & ~U64(0xFFFF))
        return use[found]

    def lefts(s: _Slice, at: np.ndarray) -> np.ndarray:
        before = s.words[np.maximum(at - 1, 0)].copy()
        before[np.isin(at, s.first)] = _EDGE
        return before

    def window_hashes(batch):
        for _, s in each(batch):
            at = repeated(s, anchors)
            yield s.windows[at], lefts(s, at)

    begins = _count(rows.select("text"), f"{scratch.path}/begins", bits, window_hashes, True)

    stored = f"{scratch.path}/regions"

    def regions(batches):
        """The runs of repeated windows that hold the begin of a repeat; their words and begins are written once for each task's distinct runs."""
        held, rows_out, known, size = [], [], {}, [0, 0]

        def flush():
            name = save_arrays(stored, {k: np.concatenate([h[i] for h in held]) for i, k in enumerate(("words", "at", "part", "left"))})
            r = list(zip(*rows_out, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(r[0], pa.int64()), pa.array(r[1], pa.int64()), *(pa.array(np.array(x, np.int32)) for x in r[2:4]), pa.array(r[4], pa.int64()), pa.array([name] * len(r[0]), pa.string()), *(pa.array(np.array(x, np.int64)) for x in r[5:7]), pa.array(np.array(r[7], np.int32))],
                ["region", "doc_id", "start", "n", "left", "file", "words_at", "begins_at", "begins"],
            )

        for b in batches:
            ids = b.column("doc_id").cast(pa.int64()).to_pylist()
            for i, s in each(b):
                at = repeated(s, anchors)
                if not len(at):
                    continue
                hit, _ = begins.find(s.windows[at] & ~U64(0xFFFF))
                if not hit.any():
                    continue
                doc = doc_of(s.first)
                head = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (doc[at[1:]] != doc[at[:-1]])]))
                tail = np.append(head[1:], len(at))
                upto = np.concatenate([[0], np.cumsum(hit)])
                use = upto[tail] > upto[head]
                head, tail = head[use], tail[use]
                x, end = at[head], at[tail - 1] + min_words
                narrow = mix(s.words) >> U64(32)
                names = run_hash(s.words, x, end).view(np.int64)
                before = np.where(np.isin(x, s.first), _EDGE, (narrow[np.maximum(x - 1, 0)] << U64(1)) + U64(1)).astype(np.int64)
                for name, x0, x1, h, t, lf in zip(names.tolist(), x.tolist(), end.tolist(), head.tolist(), tail.tolist(), before.tolist(), strict=True):
                    if name not in known:
                        begin = at[h:t][hit[h:t]]
                        inner = np.where(begin > x0, (narrow[np.maximum(begin - 1, 0)] << U64(1)) + U64(1), U64(0))
                        held.append((narrow[x0:x1].astype(np.uint32), (begin - x0).astype(np.int32), s.windows[begin] & ~U64(0xFFFF), inner))
                        known[name] = (size[0], size[1], len(begin))
                        size[0] += x1 - x0
                        size[1] += len(begin)
                    d = int(doc[x0])
                    rows_out.append((name, ids[i + d], x0 - int(s.first[d]), x1 - x0, lf, *known[name]))
            if size[0] >= FLUSH:
                yield flush()
                held, rows_out, known, size = [], [], {}, [0, 0]
        if rows_out:
            yield flush()

    places = scratch.table(rows.mapInArrow(regions, "region bigint, doc_id bigint, start int, n int, left bigint, file string, words_at bigint, begins_at bigint, begins int"), "places")
    # equal runs of words are one class, however many places have them
    classes = places.groupBy("region", "n").agg(
        F.count("*").alias("copies"), F.min("left").alias("left"), F.max("left").alias("left2"), F.sum((F.col("left") == 0).cast("bigint")).alias("edges"),
        F.min(F.struct("file", "words_at", "begins_at", "begins")).alias("at"), F.min(F.struct("doc_id", "start")).alias("one"),
    )
    varied = (F.col("left") != F.col("left2")) | (F.col("edges") > 1)
    classes = classes.select("region", "n", "copies", "left", varied.alias("varied"), "at.*", F.col("one.doc_id").alias("doc_id"), F.col("one.start").alias("start"))

    def entries(batches):
        """A row for each begin in each class: the suffixes of which the array is made."""
        maps = Maps()
        for b in batches:
            c = b.to_pydict()
            turn = sorted(range(b.num_rows), key=lambda k: (c["file"][k], c["begins_at"][k]))
            part, at, left = [], [], []
            for k in turn:
                path, lo = f"{stored}/{c['file'][k]}", c["begins_at"][k]
                hi = lo + c["begins"][k]
                part.append(maps.get(f"{path}.part.npy")[lo:hi])
                at.append(maps.get(f"{path}.at.npy")[lo:hi])
                left.append(np.array(maps.get(f"{path}.left.npy")[lo:hi]))
                if len(at[-1]) and at[-1][0] == 0:
                    left[-1][0] = c["left"][k]
            n = np.array([len(x) for x in at])
            if not n.sum():
                continue
            at = np.concatenate(at)
            wide = np.repeat(np.array([c["varied"][k] for k in turn]), n) & (at == 0)
            again = pa.array(np.repeat(turn, n))
            of = lambda name: b.column(name).take(again)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(part).view(np.int64)), of("region"), of("n"), pa.array(at), of("copies"), pa.array(np.concatenate(left).view(np.int64)), pa.array(wide), of("file"), of("words_at"), of("doc_id"), of("start")],
                ["part", "region", "n", "at", "copies", "left", "varied", "file", "words_at", "doc_id", "start"],
            )

    def tree(batches):
        """Parts come sorted, so each is a run of rows, possibly over several batches."""
        maps = Maps()

        def scan(held: list[pa.RecordBatch]):
            t = pa.Table.from_batches(held).combine_chunks()
            region, at, n = (t[x].to_numpy() for x in ("region", "at", "n"))
            copies, left, wide = t["copies"].to_numpy(), t["left"].to_numpy().view(U64), t["varied"].to_numpy()
            if len(at) == 1 and not wide[0]:
                return None
            # one text for each class, from its first suffix on: rows are sorted by class and place
            head = np.flatnonzero(np.concatenate([[True], (region[1:] != region[:-1]) | (n[1:] != n[:-1])]))
            files, words_at = t["file"].take(pa.array(head)).to_pylist(), t["words_at"].to_numpy()
            texts = [maps.get(f"{stored}/{f}.words.npy")[words_at[h] + at[h] : words_at[h] + n[h]] for f, h in zip(files, head.tolist(), strict=True)]
            text = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
            order, found = maximal_repeats(texts, text, at - at[head][text], left, copies, wide, min_words)
            deepest = np.zeros(len(order), np.int32)
            found.sort(key=lambda x: -x[0])
            for length, i, j in found:
                inside_it = deepest[i : j + 1]
                inside_it[inside_it == 0] = length
            total = np.append(0, np.cumsum(copies[order]))
            length, first, last = (np.array(x, np.int64) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 3
            used = np.flatnonzero(deepest)
            rank = np.concatenate([first, used]).astype(np.int32)
            row = order[rank]
            flag = np.arange(len(rank)) < len(first)
            return pa.RecordBatch.from_arrays(
                [
                    t["part"].combine_chunks().take(pa.array(row)), pa.array(flag), pa.array(rank), pa.array(np.concatenate([last, used]).astype(np.int32)), pa.array(np.concatenate([length, deepest[used]]).astype(np.int32)),
                    pa.array(np.concatenate([total[last + 1] - total[first], copies[order[used]]])), t["region"].combine_chunks().take(pa.array(row)), t["n"].combine_chunks().take(pa.array(row)), pa.array(at[row]), t["doc_id"].combine_chunks().take(pa.array(row)), pa.array(t["start"].to_numpy()[row] + at[row]),
                ],
                ["group_id", "repeat", "first", "last", "words", "n", "region", "size", "at", "doc_id", "start"],
            )

        def parts():
            held: list[pa.RecordBatch] = []
            for b in batches:
                part = b.column("part").to_numpy()
                edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
                for x, y in zip(edges, edges[1:], strict=False):
                    if y == x:
                        continue
                    if held and held[0].column("part")[0].as_py() != int(part[x]):
                        yield held
                        held = []
                    held.append(b.slice(x, y - x))
            if held:
                yield held

        out, weight = [], 0
        for part in parts():
            made = scan(part)
            if made is not None and made.num_rows:
                out.append(made)
                weight += made.num_rows
            if weight > 50_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out, weight = [], 0
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    suffixes = classes.mapInArrow(entries, "part bigint, region bigint, n int, at int, copies bigint, left bigint, varied boolean, file string, words_at bigint, doc_id bigint, start int")
    # by work, not by bytes: a small row can stand for a long comparison
    begun = places.agg(F.sum("begins")).first()[0] or 0
    suffixes = suffixes.repartition(max(4 * spark.sparkContext.defaultParallelism, -(-begun // TREE_ENTRIES)), "part").sortWithinPartitions("part", "region", "n", "at")
    found = scratch.table(suffixes.mapInArrow(tree, "group_id bigint, repeat boolean, first int, last int, words int, n bigint, region bigint, size int, at int, doc_id bigint, start int"), "tree")
    for done in ("anchors", "begins", "regions"):
        scratch.drop(done)
    repeats = found.where("repeat").select("group_id", F.lit("repeat").alias("kind"), "first", "last", "words", "n", "doc_id", "start")
    where = places.select("region", F.col("n").alias("size"), "doc_id", F.col("start").alias("from"))
    each_place = found.where("not repeat").drop("doc_id", "start").join(where, ["region", "size"])
    each_place = each_place.select("group_id", F.lit("occurrence").alias("kind"), "first", "last", "words", F.lit(1).cast("bigint").alias("n"), "doc_id", (F.col("from") + F.col("at")).alias("start"))
    return repeats.unionByName(each_place)


def repeat_occurrences(found: DataFrame) -> DataFrame:
    """Each repeat of repeated_passages with all its occurrences written out: (group_id, first, last, words, n, doc_id, start), one row per occurrence of each repeat."""
    r = found.where("kind = 'repeat'").select("group_id", "first", "last", "words", "n")
    o = found.where("kind = 'occurrence'").select("group_id", F.col("first").alias("rank"), "doc_id", "start")
    return r.join(o, "group_id").where("rank between first and last").drop("rank")
