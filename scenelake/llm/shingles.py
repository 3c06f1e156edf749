"""Distinct word shingles of texts as 64-bit fingerprints, computed for a whole batch of texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Words in a shingle.
WIDTH = 5
#: Bytes of text hashed at a time.
SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all of them."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Words are hashed over two prime fields; of hashes modulo a power of two, strings that collide are known.
_FIELDS = ((2147483647, 1_102_563_979), (2147483629, 807_914_911))


class FieldPowers:
    """Powers of a base modulo a prime and of its inverse, as far as the longest text needs them."""

    def __init__(self, prime: int, base: int) -> None:
        self.prime, self.bases = np.uint64(prime), (base, pow(base, -1, prime))
        self.tables = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def to(self, n: int) -> list[np.ndarray]:
        for which, base in enumerate(self.bases):
            table = self.tables[which]
            while len(table) < n:
                table = np.concatenate([table, table * np.uint64(pow(base, len(table), int(self.prime))) % self.prime])
            self.tables[which] = table
        return self.tables

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of each stretch of bytes; sums stay below 2**64 for texts of up to 2**24 bytes and are reduced beyond."""
        up, down = self.to(len(data) + 1)
        terms = (data.astype(np.uint64) + np.uint64(1)) * up[: len(data)]
        prefix = np.zeros(len(data) + 1, dtype=np.uint64)
        for at in range(0, len(data), 1 << 24):
            part = terms[at : at + (1 << 24)]
            np.cumsum(part, out=prefix[at + 1 : at + 1 + len(part)])
            prefix[at + 1 : at + 1 + len(part)] = (prefix[at + 1 : at + 1 + len(part)] + prefix[at]) % self.prime
        return (prefix[ends] + self.prime - prefix[starts]) % self.prime * down[starts] % self.prime


_WORDS = [FieldPowers(*field) for field in _FIELDS]


class Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, as far as the longest text needs them."""

    def __init__(self, base: int = _BASE) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size, one = max(2 * n, 1 << 16), np.ones(1, dtype=np.uint64)
            self.up = np.cumprod(np.concatenate([one, np.full(size, self.base, dtype=np.uint64)]))
            self.down = np.cumprod(np.concatenate([one, np.full(size, self.inverse, dtype=np.uint64)]))
        return self.up, self.down


_PLACES = mixed(np.arange(1, WIDTH + 1, dtype=np.uint64) * np.uint64(_BASE)) | np.uint64(1)


def spans(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts of about SPAN bytes: first and last row, the bytes and the offsets within them."""
    texts = texts.cast(pa.large_string()) if texts.null_count == 0 else texts.fill_null("").cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SPAN, side="right")) - 1)
        yield at, end, whole[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def fingerprints(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, fingerprint) of the distinct shingles of each text, sorted by both.

    A-Z are lower-cased. A text of fewer words than a shingle has, but of some, is one shingle.
    """
    data = _LOWER[data]
    word = np.concatenate([[False], ~_BLANK[data], [False]])
    edges = word[1:] != word[:-1]
    edges[offsets[(offsets > 0) & (offsets < len(data))]] |= True  # a word ends where its text does
    bounds = np.flatnonzero(edges)
    starts, ends = bounds[word[bounds + 1]], bounds[word[bounds]]
    if not len(starts):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    one, two = (field.words(data, starts, ends) for field in _WORDS)
    words = mixed((one << np.uint64(32) | two) + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    of = np.searchsorted(offsets, starts, side="right") - 1
    joined = [words[WIDTH - 1 :] * _PLACES[WIDTH - 1]] if len(words) >= WIDTH else []
    if joined:
        n = len(words) - WIDTH + 1
        total = joined[0]
        for place in range(WIDTH - 1):
            total = total + words[place : place + n] * _PLACES[place]
        full = of[:n] == of[WIDTH - 1 :]
        owner, value = of[:n][full], mixed(total[full])
    else:
        owner, value = of[:0], words[:0]
    counts = np.bincount(of, minlength=len(offsets) - 1)
    few = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(few):
        first = np.searchsorted(of, few)
        rest = []
        for text, at in zip(few, first, strict=True):
            own = words[at : at + counts[text]]
            rest.append((own * _PLACES[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own)))
        owner, value = np.concatenate([owner, few]), np.concatenate([value, mixed(np.array(rest, dtype=np.uint64))])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(owner), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]
