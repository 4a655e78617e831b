"""Word and shingle hashing on whole batches of texts with numpy; used inside Arrow tasks.

A word's hash is polynomial over its bytes (random byte table, odd base modulo 2**64), taken from prefix sums, and then
mixed; equal words have equal hashes wherever they stand. Shingle hashes combine consecutive word hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
PIECE = 1 << 18

#: Separators of words: white space only, or everything but ASCII letters, digits and bytes above 127.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PUNCT = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])

_pow = np.ones(1, U)
_inv = np.ones(1, U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) < n:
        n = max(n, 2 * PIECE)
        with np.errstate(over="ignore"):
            b, i = np.full(n, _BASE, U), np.full(n, _INVERSE, U)
            b[0] = i[0] = 1
            _pow, _inv = np.cumprod(b, dtype=U), np.cumprod(i, dtype=U)
    return _pow, _inv


def _bounds(buf: bytes, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = np.frombuffer(buf, np.uint8)
    sep = np.empty(len(a) + 2, bool)
    sep[0] = sep[-1] = True
    sep[1:-1] = separator[a]
    edge = np.flatnonzero(sep[1:] != sep[:-1])
    return a, edge[0::2], edge[1::2]


def _hash(a: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    power, inverse = _powers(len(a) + 1)
    with np.errstate(over="ignore"):
        c = np.zeros(len(a) + 1, U)
        np.cumsum(_TABLE[a] * power[: len(a)], dtype=U, out=c[1:])
        return mix((c[ends] - c[starts]) * inverse[starts] + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


def _pieces(raw: bytes, separator: np.ndarray) -> Iterator[bytes]:
    """Cut a long text at separators, so that memory stays bounded by the piece (or by one word)."""
    at = 0
    while len(raw) - at > PIECE:
        end = at + PIECE
        while end < len(raw) and not separator[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def strings(column) -> Iterator[str | None]:
    """The values of an Arrow column one after another, so that no second copy of a whole batch is held."""
    for value in column:
        yield value.as_py()


def word_hashes(texts: Iterable[str | None], separator: np.ndarray = SPACE, lower: bool = True) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; a null text has none."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        if not group:
            return
        buf = b" ".join(group)
        a, s, e = _bounds(buf, separator)
        h = _hash(a, s, e)
        cut = np.searchsorted(s, np.cumsum([len(g) + 1 for g in group])[:-1])
        yield from np.split(h, cut)

    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if lower:
            raw = raw.translate(_LOWER)
        if size + len(raw) > PIECE:
            yield from flush()
            group, size = [], 0
        if len(raw) > PIECE:
            yield np.concatenate([_hash(*_bounds(p, separator)) for p in _pieces(raw, separator)])
            continue
        group.append(raw)
        size += len(raw) + 1
    yield from flush()


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct, ascending k-word shingle hashes; a shorter text has its whole sequence as one, a text without words none."""
    n = len(words)
    if not n:
        return words
    with np.errstate(over="ignore"):
        if n < k:
            h = U(n)
            for w in words:
                h = mix(np.array([h * U(0x2545F4914F6CDD1D) + w], U))[0]
            return np.array([h], U)
        h = words[: n - k + 1]
        for j in range(1, k):
            h = mix(h * U(0x2545F4914F6CDD1D) + words[j : n - k + 1 + j])
    h = np.sort(h)
    keep = np.empty(len(h), bool)
    keep[0] = True
    np.not_equal(h[1:], h[:-1], out=keep[1:])
    return h[keep]
