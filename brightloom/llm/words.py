"""Word and shingle hashes of whole texts, computed for many texts at once."""

from __future__ import annotations

import numpy as np

from .common import batches_of, mix

#: Bytes that part words: space and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes that part words where only letters and digits count; bytes of non-ASCII letters are parts of words.
NON_WORD = np.array([not (c >= 128 or chr(c).isalnum()) for c in range(256)])
#: A-Z in lower case, all else as it is.
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)

#: Bytes of a long text that are hashed at a time.
STEP = 1 << 18
_ALL = (1 << 64) - 1
_BASE = 0x5851F42D4C957F2D | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for i, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _slice_hashes(data: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of a byte array; a separator must end it."""
    gap = apart[data]
    edge = np.diff(gap.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if len(start) and gap[0] == 0 and start[0] != 0:
        start = np.concatenate([[0], start])
    if len(end) < len(start):
        end = np.append(end, len(data))
    power, inverse = _tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * power[: len(data)], out=total[1:])
    h = (total[end] - total[start]) * inverse[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), start


def _long_word(data: np.ndarray, at: int, apart: np.ndarray) -> tuple[np.ndarray, int]:
    """(hash of the word that starts at a place, where it ends), in steps, so that a word of any length needs tables of one step only."""
    total, power, size = 0, 1, 0
    while at < len(data):
        piece = data[at : at + STEP]
        gaps = np.flatnonzero(apart[piece])
        piece = piece[: gaps[0]] if len(gaps) else piece
        own = ((LOWER[piece].astype(np.uint64) + np.uint64(1)) * _tables(STEP + 1)[0][: len(piece)]).sum(dtype=np.uint64)
        total = (total + power * int(own)) & _ALL
        power = power * pow(_BASE, len(piece), 1 << 64) & _ALL
        size, at = size + len(piece), at + len(piece)
        if len(gaps):
            break
    return mix(np.array([total ^ size * 0x9E3779B97F4A7C15 & _ALL], np.uint64)), at


def word_hashes(texts: list[str], apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, number of words of each text), A-Z lower-cased. Texts of any length are cut between words, words of any length in steps."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    hashes: list[np.ndarray] = []
    counts = np.zeros(len(raw), np.int64)
    for i, j in batches_of(raw):
        if j == i + 1 and len(raw[i]) > 2 * STEP:
            data, at = np.frombuffer(raw[i], np.uint8), 0
            while at < len(data):
                stop = min(len(data), at + STEP)
                gaps = np.flatnonzero(apart[data[at:stop]])
                if not len(gaps) and stop < len(data):
                    h, at = _long_word(data, at, apart)
                else:
                    stop = stop if stop == len(data) else at + int(gaps[-1]) + 1
                    h, _ = _slice_hashes(data[at:stop], apart)
                    at = stop
                hashes.append(h)
                counts[i] += len(h)
            continue
        data = np.frombuffer(b"\n".join(raw[i:j]) + b"\n", np.uint8)
        ends = np.cumsum([len(x) + 1 for x in raw[i:j]])
        h, start = _slice_hashes(data, apart)
        counts[i:j] = np.diff(np.searchsorted(start, ends), prepend=0)
        hashes.append(h)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its k-word shingles; with fewer words, of the whole sequence; without words, none."""
    h, counts = word_hashes(texts)
    n = len(h)
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled = rolled * np.uint64(0xA0761D6478BD642F) + h[i : n - k + 1 + i]
        rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= k:
            s = np.sort(rolled[at : at + c - k + 1])
            out.append(s[np.append(True, s[1:] != s[:-1])])
        elif c:
            x = np.uint64(0x2545F4914F6CDD1D * c & 0xFFFFFFFFFFFFFFFF)
            for w in h[at : at + c]:
                x = np.uint64((int(x) * 0xA0761D6478BD642F + int(w)) & 0xFFFFFFFFFFFFFFFF)
            out.append(mix(np.array([x], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out
