"""Word and n-gram hashes of many texts at once, over the UTF-8 bytes.

A chunk is the bytes of consecutive documents. A word's hash adds one random 64-bit value
for each byte, from a table by the byte and its place in the word (tabulation hashing), so
any two given words collide with probability 2^-64 over the tables; words longer than
``PLACES`` bytes are cut into blocks, whose hashes are hashed in the same way. An n-gram
is a tree of such values, mixed at each node. Bytes are worked on a bounded number at a
time, so a long text costs a few bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes of a chunk, unless one document is longer; bytes that are hashed at once.
CHUNK_BYTES, STEP_BYTES = 1 << 20, 1 << 18
#: Places of a word that have values of their own.
PLACES = 32
_M64 = (1 << 64) - 1


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Table:
    """Values by place and byte; those of blocks of longer words come from further tables of the seed."""

    def __init__(self, seed: int, lower: bool = False):
        t = np.random.default_rng(seed).integers(1, _M64, (PLACES, 256), dtype=np.uint64)
        if lower:
            t[:, 65:91] = t[:, 97:123]
        self.seed, self.values = seed, t.ravel()

    def above(self) -> Table:
        return Table(self.seed + 1_000_003)


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, bytes, offsets) from batches (id, text); a null text is empty."""
    for batch in batches:
        ids = np.asarray(batch.column(0).fill_null(0))
        text = batch.column(1).fill_null("").cast(pa.large_binary())
        off = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
            yield ids[a:b], data[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and per document the index of its first word (one more at the end)."""
    starts, ends = [], []
    for a in range(0, len(data), CHUNK_BYTES):
        b = min(len(data), a + CHUNK_BYTES)
        word = ~SPACE[data[a:b]]
        before = np.append(a > 0 and not SPACE[data[a - 1]], word[:-1])
        # a document's first byte follows nothing
        bounds = off[(off >= a) & (off < b)] - a
        before[bounds] = False
        starts.append(np.flatnonzero(word & ~before) + a)
        after = np.append(word[1:], b < len(data) and not SPACE[data[b]])
        bounds = off[(off > a) & (off <= b)] - a - 1
        after[bounds] = False
        ends.append(np.flatnonzero(word & ~after) + a + 1)
    none = np.empty(0, np.int64)
    first, last = (np.concatenate(x) if x else none for x in (starts, ends))
    return first, last, np.searchsorted(first, off)


def runs(starts: np.ndarray, ends: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Words a to b at a time, of about size bytes together unless one is longer."""
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + size, "right")))
        yield a, b
        a = b


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Table) -> np.ndarray:
    out = np.empty(len(starts), np.uint64)
    for a, b in runs(starts, ends):
        s, e = starts[a:b] - starts[a], ends[a:b] - starts[a]
        if b == a + 1 and e[0] > PLACES:
            continue
        own = data[starts[a] : ends[b - 1]]
        place = np.arange(len(own), dtype=np.int32) - np.repeat(s.astype(np.int32), np.diff(np.append(s, len(own))))
        total = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(table.values[((place & (PLACES - 1)) << 8) | own], out=total[1:])
        out[a:b] = mix(total[e] - total[s])
    long = np.flatnonzero(ends - starts > PLACES)
    if len(long):
        out[long] = _long_words(data, starts[long], ends[long], table)
    return out


def _long_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: Table) -> np.ndarray:
    """Words as the bytes of the hashes of their blocks, and so on until one block is left."""
    n = -(-(ends - starts) // PLACES)
    word = np.repeat(np.arange(len(n)), n)
    a = starts[word] + PLACES * (np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n))
    blocks = word_hashes(data, a, np.minimum(a + PLACES, ends[word]), table)
    last = 8 * np.cumsum(n)
    return word_hashes(blocks.view(np.uint8), last - 8 * n, last, table.above())


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """The hash of h[i : i + n] for each i that has so many after it; the caller drops those across documents."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out, done, level, width = None, 0, h, 1
    while True:
        if n & width:
            out = level if out is None else _pair(out, level[done:], salt)
            done += width
        if 2 * width > n:
            return out if n > 1 else mix(out ^ np.uint64(salt))
        level, width = _pair(level, level[width:], salt), 2 * width


def _pair(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    n = min(len(a), len(b))
    return mix(mix(a[:n] ^ np.uint64(salt + 1)) + b[:n])
