"""Sets of hashed word shingles, and what can be told from them, in numpy.

Words are runs of anything but ASCII white space after lower-casing A-Z; a shingle is five consecutive words, or the whole
sequence of a text with fewer.  Words and shingles are 64-bit hashes; two shingles of one comparison that collide are not
told apart, which for sets of a million has a chance under one in ten million.
"""

from __future__ import annotations

import numpy as np

WIDTH = 5
U = np.uint64
#: Bytes hashed at once; a longer text is cut at white space.
PIECE = 1 << 19
_ODD = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, size=256, dtype=np.uint64)
_PLACE = _rng.integers(1, 2**63, size=WIDTH, dtype=np.uint64) | U(1)
_SHORT = _rng.integers(1, 2**63, size=WIDTH + 1, dtype=np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd number and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 4096)
        inverse = pow(_ODD, -1, 2**64)
        for name, base in (("up", _ODD), ("down", inverse)):
            steps = np.full(size, base, dtype=U)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def _hash_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words in bytes, and where they start."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap, [True])).astype(np.int8)))
    start, end = edge[0::2], edge[1::2]
    up, down = _power(len(data))
    sums = np.concatenate((np.zeros(1, U), np.cumsum(_BYTE[data] * up[: len(data)], dtype=U)))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U)), start


def _long_words(raw: bytes) -> np.ndarray:
    """Word hashes of one long text, piece by piece; a piece ends at white space, or where the text does."""
    out, at = [], 0
    while at < len(raw):
        stop = min(len(raw), at + PIECE)
        while stop < len(raw) and raw[stop] not in b" \t\n\v\f\r":
            found = [p for p in (raw.find(c, stop, stop + PIECE) for c in (b" ", b"\n", b"\t", b"\v", b"\f", b"\r")) if p >= 0]
            stop = min(found) if found else min(len(raw), stop + PIECE)
        out.append(_hash_words(np.frombuffer(raw, np.uint8, stop - at, at))[0])
        at = stop
    return np.concatenate(out) if out else np.zeros(0, U)


def _sets(words: np.ndarray, doc: np.ndarray, count: int) -> list[np.ndarray]:
    """The sorted set of each document, from the hashes of words in order and the document of each."""
    n = np.bincount(doc, minlength=count)
    if len(words) >= WIDTH:
        m = len(words) - WIDTH + 1
        grams = sum((words[k : k + m] * _PLACE[k] for k in range(WIDTH)), np.zeros(m, U))
        full = doc[:m] == doc[WIDTH - 1 :]
        grams, owner = mix(grams[full]), doc[:m][full]
    else:
        grams, owner = np.zeros(0, U), np.zeros(0, np.int64)
    first = np.cumsum(n) - n
    short = np.flatnonzero((n > 0) & (n < WIDTH))
    if len(short):
        size = n[short]
        whole = _SHORT[size]
        for k in range(WIDTH - 1):
            more = size > k
            whole[more] += words[first[short[more]] + k] * _PLACE[k]
        whole = mix(whole)
        grams, owner = np.concatenate((grams, whole)), np.concatenate((owner, short))
    order = np.lexsort((grams, owner))
    grams, owner = grams[order], owner[order]
    new = np.ones(len(grams), dtype=bool)
    new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
    grams, owner = grams[new], owner[new]
    return np.split(grams, np.cumsum(np.bincount(owner, minlength=count))[:-1]) if count else []


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted arrays of shingle hashes; empty for null texts and texts without words."""
    out: list[np.ndarray] = []
    raws, size = [], 0

    def flush() -> None:
        nonlocal raws, size
        if raws:
            lengths = np.array([len(r) + 1 for r in raws])
            words, start = _hash_words(np.frombuffer(b"\n".join(raws) + b"\n", np.uint8))
            doc = np.searchsorted(np.cumsum(lengths), start, side="right")
            out.extend(_sets(words, doc, len(raws)))
        raws, size = [], 0

    for t in texts:
        raw = t.encode("utf-8", "replace") if isinstance(t, str) else b""
        if len(raw) > PIECE:
            flush()
            words = _long_words(raw)
            out.extend(_sets(words, np.zeros(len(words), np.int64), 1))
            continue
        if size + len(raw) + 1 > PIECE:
            flush()
        raws.append(raw)
        size += len(raw) + 1
    flush()
    return out


def signature(grams: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    a, b = int(mix(grams + U(0x1234567 + salt)).sum(dtype=U)), int(mix(grams ^ U(0xABCDEF987654321 + salt)).sum(dtype=U))
    return a - (1 << 64) if a >> 63 else a, b - (1 << 64) if b >> 63 else b


def bitmap(grams: np.ndarray) -> bytes:
    """Hashed bitmap of a set: a power of two of bits, over four times as many as members, 256 to 2^20."""
    bits = 1 << min(20, max(8, int(4 * len(grams)).bit_length()))
    flags = np.zeros(bits, dtype=np.uint8)
    flags[(grams & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags).tobytes()


def fold(bits: np.ndarray, size: int) -> np.ndarray:
    """A bitmap of fewer bytes: halves are joined, as bits are taken modulo the width."""
    while len(bits) > size:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


class Bitmaps:
    """Bitmaps of the sets of a block, to bound the overlap of one with many others from above.

    Every bit of one that the other lacks stands for a member not shared.  Sets that may be similar have bitmaps of one
    width or of neighbouring ones, so each is held at its own width and at half of it.
    """

    def __init__(self, sizes: np.ndarray, bits: list[bytes]):
        self.sizes = sizes
        self.width = np.array([len(b) for b in bits], dtype=np.int64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in set(self.width.tolist()):
            own = np.flatnonzero((self.width == w) | (self.width == 2 * w))
            at = np.full(len(bits), -1)
            at[own] = np.arange(len(own))
            self.tables[w] = at, np.stack([fold(np.frombuffer(bits[k], np.uint8), w) for k in own])

    def most_shared(self, i: int, others: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlap of set i with others of similar size."""
        out = np.empty(len(others), dtype=np.int64)
        narrow = np.minimum(self.width[i], self.width[others])
        for w in set(narrow.tolist()):
            some = np.flatnonzero(narrow == w)
            at, table = self.tables[w]
            x, y = table[at[i]], table[at[others[some]]]
            lack_x, lack_y = (np.bitwise_count(m).sum(1, dtype=np.int64) for m in (x & ~y, y & ~x))
            out[some] = np.minimum(self.sizes[i] - lack_x, self.sizes[others[some]] - lack_y)
        return out


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Exact overlap of two sorted sets."""
    return int(shared_with(a, [b])[0])


def shared_with(a: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Exact overlaps of a sorted set with each of others."""
    if not others or not len(a):
        return np.zeros(len(others), dtype=np.int64)
    every = np.concatenate(others)
    at = np.searchsorted(a, every)
    at[at == len(a)] = len(a) - 1
    ends = np.cumsum([len(x) for x in others])
    hits = np.concatenate(([0], np.cumsum(a[at] == every)))
    return hits[ends] - np.concatenate(([0], hits[ends[:-1]]))


def similar(overlap, n_a, n_b, percent: int):
    return 100 * overlap >= percent * (n_a + n_b - overlap)
