"""Vectorised text kernels: whole Arrow batches of UTF-8 text as numpy arrays, no Python object per token.

Tokens are runs of bytes other than ASCII whitespace (9-13 and 32). Hashes are 64-bit; a polynomial over
a random byte table gives the hash of any span from prefix sums, then a finaliser mixes it.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from xxhash import xxh3_64_intdigest

try:
    # large arrays go back to the system once they are freed, so that idle workers hold little memory
    _libc = ctypes.CDLL(None)
    for _option, _value in ((-3, 8 << 20), (-1, 16 << 20), (-8, 2)):  # mmap and trim thresholds, arenas
        _libc.mallopt(_option, _value)
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pools keep what is freed
    _libc.malloc_trim.argtypes = [ctypes.c_size_t]

    def _give_back(phase: str, info: dict) -> None:
        if phase == "stop" and info["generation"] == 2:
            _libc.malloc_trim(0)

    gc.callbacks.append(_give_back)  # a worker collects its garbage after each task; freed memory between what is in use goes back then
except (OSError, AttributeError):  # another C library
    pass

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_BYTES = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64)
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_POWERS: dict[str, np.ndarray] = {}
#: Bytes of a slice of text for kernels whose temporaries take tens of bytes for each byte of text.
NARROW = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**0..n and its inverses, modulo 2**64; grown on demand and kept by the worker."""
    if len(_POWERS.get("p", ())) <= n:
        size = max(n + 1, 1 << 20)
        for name, base in (("p", _BASE), ("i", _BASE_INV)):
            a = np.full(size, base, dtype=U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
    return _POWERS["p"], _POWERS["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, elementwise."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 1 << 20):
    """Ranges of documents of about limit bytes each (one document at least), so temporaries stay small."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def small_batches(batches, column: int, limit: int = 4 << 20):
    """The batches in pieces of about limit bytes of a text column, so that what is made of a piece stays small."""
    for b in batches:
        text = b.column(column)
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
        for i, j in slices(offsets, limit):
            yield b.slice(i, j - i)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of tokens and, for each document, the number of its first token (len(docs)+1 entries)."""
    n = len(data)
    word = np.zeros(n + 2, dtype=bool)
    word[1:-1] = ~_WS[data]
    begin = word[1:-1] & ~word[:-2]
    end = word[1:-1] & ~word[2:]
    heads = offsets[:-1]
    heads = heads[heads < n]
    begin[heads] = word[heads + 1]
    tails = offsets[1:]
    tails = tails[tails > 0] - 1
    end[tails] = word[tails + 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the lines of each document, split at line feeds; a document of n feeds has n+1 lines, an empty one has one empty line."""
    n_docs = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    doc_of_feed = np.searchsorted(offsets, feeds, side="right") - 1
    per_doc = np.bincount(doc_of_feed, minlength=n_docs) + 1 if n_docs else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(per_doc)]).astype(np.int64)
    starts = np.empty(first[-1], dtype=np.int64)
    ends = np.empty(first[-1], dtype=np.int64)
    is_head = np.zeros(first[-1], dtype=bool)
    is_head[first[:-1]] = True
    starts[is_head] = offsets[:-1]
    starts[~is_head] = feeds + 1
    is_tail = np.zeros(first[-1], dtype=bool)
    is_tail[first[1:] - 1] = True
    ends[is_tail] = offsets[1:]
    ends[~is_tail] = feeds
    return starts, ends, first


def trim(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without ASCII whitespace at either end (empty if there is nothing else)."""
    starts, ends = starts.copy(), ends.copy()
    for edge, step, behind in ((starts, 1, 0), (ends, -1, 1)):
        open_ = np.flatnonzero(starts < ends)
        for _ in range(64):
            open_ = open_[_WS[data[edge[open_] - behind]]]
            if not len(open_):
                break
            edge[open_] += step
            open_ = open_[starts[open_] < ends[open_]]
        if len(open_):  # long runs of whitespace: by the next byte, or the last, that is none
            solid = np.flatnonzero(~_WS[data])
            if step > 0:
                at = np.searchsorted(solid, starts[open_])
                ends_at = np.append(solid, len(data))[at]
                starts[open_] = np.minimum(ends_at, ends[open_])
            else:
                at = np.searchsorted(solid, ends[open_]) - 1
                ends[open_] = np.maximum(np.append(solid + 1, 0)[at], starts[open_])
    return starts, ends


def line_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, one call of a native hash for each: for spans of tens of bytes and more."""
    raw = data.tobytes()
    return np.fromiter((xxh3_64_intdigest(raw[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), U64, len(starts))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span."""
    p, inv = _powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTES[data] * p[: len(data)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    h += (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93)
    return mix(h)


def window_hash(tok: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of width tokens of one array, wherever documents end; len(tok)-width+1 entries, or none."""
    n = len(tok)
    if n < width:
        return np.zeros(0, U64)
    if width == 1:
        return tok.copy()
    if width <= 6:
        h = tok[: n - width + 1] * U64(0x9FB21C651E98DF25)
        for k in range(1, width):
            h = (h ^ (h >> U64(29))) * U64(0xA24BAED4963EE407) + tok[k : n - width + 1 + k]
        return mix(h)
    p, inv = _powers(n)
    sums = np.zeros(n + 1, dtype=U64)
    np.cumsum(tok * p[:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * inv[: n - width + 1])


def inside(first: np.ndarray, width: int, n_windows: int) -> np.ndarray:
    """Which windows of width tokens lie in one document."""
    ok = np.ones(n_windows, dtype=bool)
    for k in range(1, width):
        at = first[1:-1] - k
        at = at[(at >= 0) & (at < n_windows)]
        ok[at] = False
    return ok


def doc_of(first: np.ndarray) -> np.ndarray:
    """The document of each token (or line)."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
