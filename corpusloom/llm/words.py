"""Words of whole batches as numpy arrays: runs of letters and digits, hashed without Python loops."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa

_WORD: np.ndarray | None = None
_SPACE: np.ndarray | None = None
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def is_word_char() -> np.ndarray:
    """For each code point, whether it is a letter or a digit."""
    global _WORD
    if _WORD is None:
        _WORD = np.frombuffer(bytes(chr(c).isalnum() for c in range(sys.maxunicode + 1)), np.bool_)
    return _WORD


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.empty(max(n, 1), np.uint64)
    out[0] = 1
    if n > 1:
        out[1:] = _BASE
        np.multiply.accumulate(out, out=out)
    return out


def is_space() -> np.ndarray:
    """For each code point, whether it is white space."""
    global _SPACE
    if _SPACE is None:
        _SPACE = np.frombuffer(bytes(chr(c).isspace() for c in range(sys.maxunicode + 1)), np.bool_)
    return _SPACE


def _runs(texts: list[str], chosen: np.ndarray, invert: bool = False) -> tuple[np.ndarray, ...]:
    """(hash, text, first character, end) of every run of chosen characters of the texts."""
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = chosen[code] != invert
    ends = np.cumsum(np.array([len(t) for t in texts], np.int64) + 1)
    inside[ends[:-1] - 1] = False  # the line ends between texts
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    where = np.flatnonzero(inside)
    length = end - begin
    place = np.arange(len(where)) - np.repeat(np.cumsum(length) - length, length)
    terms = (code[where].astype(np.uint64) + np.uint64(0x1F123BB5)) * _powers(int(length.max()))[place]
    hashes = mix(np.add.reduceat(terms, np.cumsum(length) - length) + length.astype(np.uint64))
    owner = np.searchsorted(ends, begin, side="right")
    shift = np.r_[0, ends[:-1]][owner]
    return hashes, owner, begin - shift, end - shift


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, index of the text each word is in); lower-cased."""
    return _runs([t.lower() for t in texts], is_word_char())[:2]


def token_hashes(texts: list[str]) -> tuple[np.ndarray, ...]:
    """(hash, text, first character, end) of every white-space separated token."""
    return _runs(texts, is_space(), True)


def run_hashes(words: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, position of the first word) of every run of ``width`` words of one text."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = mix(h * np.uint64(0xD6E8FEB86659FD93) + words[i : i + n])
    ok = np.flatnonzero(owner[:n] == owner[width - 1 :])
    return h[ok], owner[ok], ok


#: Characters of text handled at once in a worker, so that its arrays stay in the cache.
BLOCK_CHARS = 300_000


def shingle_sets(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, values, starts): the distinct hashed runs of the rows that have any, sorted in each."""
    texts = column.to_pylist()
    rows, values, counts = [], [], []
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end] or "") <= BLOCK_CHARS):
            size += len(texts[end] or "")
            end += 1
        h, owner, _ = run_hashes(*word_hashes([t or "" for t in texts[begin:end]]), width)
        if len(h):
            bounds = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1], True]).tolist()
            for a, b in zip(bounds, bounds[1:]):  # sets are small, so this beats one sort by text and hash
                h[a:b].sort()
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
            h, owner = h[new], owner[new]
            own, n = np.unique(owner, return_counts=True)
            rows.append(own + begin)
            values.append(h)
            counts.append(n)
        begin = end
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    n = np.concatenate(counts)
    return np.concatenate(rows), np.concatenate(values), np.cumsum(n) - n
