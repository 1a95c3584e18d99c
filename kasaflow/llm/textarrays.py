"""Texts as flat byte arrays: words, their 64-bit hashes and n-grams, in numpy.

A batch of texts is joined into one byte array; every step then works on whole
arrays. Hashes are polynomial in a table of random-looking 64-bit numbers (a
fixed rule, alike on every machine) and mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE_BYTES = 2_000_000
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply, shift, xor), in place where it can be."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
BASE = 0x5851F42D4C957F2D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SALTS = mix64(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def slices(texts: list, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of ``texts`` (bytes) of about ``limit`` bytes; a longer text is alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def as_bytes(text, lower: str = "") -> bytes:
    """UTF-8 of a text (None: empty); lower: "" as it is, "ascii" A-Z only, "all" any letter."""
    if text is None:
        return b""
    if lower == "all":
        return text.lower().encode("utf-8", "surrogatepass")
    b = text.encode("utf-8", "surrogatepass")
    return b.lower() if lower else b


class Flat:
    """Some texts in one byte array, each followed by ``gap`` (a byte that ends words and lines)."""

    def __init__(self, texts: list[bytes], gap: bytes = b"\n"):
        self.array = np.frombuffer(gap.join(texts) + gap, np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.sizes = sizes
        self.starts = np.cumsum(sizes + 1) - sizes - 1  # of the texts
        self.n = len(texts)
        self._prefix = None

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the runs of bytes whose class ``inside`` (a table of 256) is true."""
        on = inside[self.array]
        step = np.flatnonzero(on[1:] != on[:-1]) + 1
        if on[0]:
            step = np.concatenate(([0], step))
        if on[-1]:
            step = np.concatenate((step, [len(on)]))
        return step[0::2], step[1::2]

    def owner(self, starts: np.ndarray) -> np.ndarray:
        """Index of the text that each position lies in."""
        return np.searchsorted(self.starts, starts, "right") - 1

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each span."""
        n = len(self.array)
        if self._prefix is None:
            power = np.full(n, BASE, np.uint64)
            power[:1] = 1
            power = np.cumprod(power, dtype=np.uint64)
            power *= BYTE_CODES[self.array]
            prefix = np.zeros(n + 1, np.uint64)
            np.cumsum(power, out=prefix[1:])
            self._prefix = prefix
            inverse = np.full(n + 1, BASE_INVERSE, np.uint64)
            inverse[:1] = 1
            self._inverse = np.cumprod(inverse, dtype=np.uint64)
        h = self._prefix[ends] - self._prefix[starts]
        h *= self._inverse[starts]
        return mix64(h ^ (ends - starts).astype(np.uint64))

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of ``values`` (one a byte) in each text, its gap included."""
        return np.add.reduceat(values.astype(np.float64), self.starts) if self.n else np.zeros(0)


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its ``width``-word shingles
    (words: runs without ASCII white space); fewer words: the whole sequence as
    one; no words: empty."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        flat = Flat(texts[a:b])
        starts, ends = flat.runs(~SPACE)
        words = flat.hashes(starts, ends)
        bounds = np.searchsorted(starts, flat.starts, "left").tolist() + [len(starts)]
        grams = np.zeros(0, np.uint64)
        if len(words) >= width:
            grams = words[:len(words) - width + 1] * SALTS[0]
            for j in range(1, width):
                grams = grams + words[j:len(words) - width + 1 + j] * SALTS[j]
            grams = mix64(grams + np.uint64(width))
        for i in range(flat.n):
            lo, hi = bounds[i], bounds[i + 1]
            if hi - lo >= width:
                out.append(np.unique(grams[lo:hi - width + 1]))
            elif hi > lo:
                short = (words[lo:hi] * SALTS[:hi - lo]).sum(dtype=np.uint64) + np.uint64(hi - lo)
                out.append(mix64(np.array([short], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def word_bytes_table() -> np.ndarray:
    """Bytes that belong to words: ASCII letters and digits and every byte of a multi-byte character."""
    t = np.zeros(256, bool)
    t[0x80:] = True
    for lo, hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
        t[lo:hi] = True
    return t


WORD_BYTES = word_bytes_table()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i]+1, ... (lengths[i] of them), one after the other."""
    if not len(lengths) or not lengths.sum():
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    step = np.ones(int(ends[-1]), np.int64)
    keep = lengths > 0
    s, l = starts[keep], lengths[keep]
    step[0] = s[0]
    step[np.cumsum(l)[:-1]] = s[1:] - (s[:-1] + l[:-1]) + 1
    return np.cumsum(step)


def word_ngrams(flat: Flat, starts: np.ndarray, ends: np.ndarray, sizes: tuple[int, ...], bits: int):
    """Hashed byte n-grams of the given spans with a mark at both ends:
    (buckets, owner span) arrays, grouped by span."""
    lengths = ends - starts + 2
    idx = ragged(starts - 1, lengths)
    owner = np.repeat(np.arange(len(starts)), lengths)
    codes = BYTE_CODES[flat.array[np.clip(idx, 0, len(flat.array) - 1)]]
    first = np.cumsum(lengths) - lengths
    codes[first] = SALTS[60]
    codes[first + lengths - 1] = SALTS[61]
    left = np.repeat(first + lengths, lengths) - np.arange(len(codes))  # codes from here to the span's end
    got_b, got_o = [], []
    for n in sizes:
        if len(codes) < n:
            continue
        g = codes[:len(codes) - n + 1] * SALTS[0]
        for j in range(1, n):
            g = g + codes[j:len(codes) - n + 1 + j] * SALTS[j]
        ok = left[:len(g)] >= n
        got_b.append((mix64(g[ok] + np.uint64(n)) >> np.uint64(64 - bits)).astype(np.int64))
        got_o.append(owner[:len(g)][ok])
    if not got_b:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b, o = np.concatenate(got_b), np.concatenate(got_o)
    order = np.argsort(o, kind="stable")
    return b[order], o[order]
