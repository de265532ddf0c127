"""Encoding of whole texts with a public byte-level BPE vocabulary.

Texts are split by the vocabulary's pattern, words are merged once per worker and remembered, and
a text's ids are the joined id bytes of its words. A short word is merged on a contiguous array of
the ranks between its parts: find the least, delete that boundary, refresh the two ranks beside
it. A word beyond ``LONG_WORD`` bytes would make that quadratic, so it keeps its parts in a linked
list with a heap of ranks, which merges in the same order.
"""

from __future__ import annotations

import base64
import heapq
import hashlib
import os
import shutil
import tempfile
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..runtime import spread

#: Folder of the public vocabularies on the driver; a parameter of every operator that needs one.
TOKENIZER_DIR = os.environ.get("CORPUSLOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"

#: Fixed value: how the vocabulary splits text before merging.
SPLIT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

LONG_WORD = 128
NONE = 1 << 30
#: Words a worker remembers; beyond it the memory starts anew, so it stays bounded.
REMEMBERED = 150_000
#: Id bytes after which a batch is handed on.
FLUSH_BYTES = 8 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}


def merge_short(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by repeated scans of its rank array."""
    cut = list(range(len(word) + 1))
    gap = [ranks.get(word[i : i + 2], NONE) for i in range(len(word) - 1)]
    while gap:
        low = min(gap)
        if low == NONE:
            break
        i = gap.index(low)
        del cut[i + 1], gap[i]
        if i < len(gap):
            gap[i] = ranks.get(word[cut[i] : cut[i + 2]], NONE)
        if i:
            gap[i - 1] = ranks.get(word[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[word[a:b]] for a, b in zip(cut, cut[1:])]


def merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for a word of any length, in n log n steps."""
    n = len(word)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = bytearray(b"\1") * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2], NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = 0
        end[i] = stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]], NONE)) != NONE:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop], NONE)) != NONE:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


class _Words(dict):
    """Word to the bytes of its ids as little-endian int32, filled on demand."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        raw = word.encode("utf-8")
        rank = self.ranks.get(raw)
        if rank is not None:
            ids = [rank]
        else:
            ids = (merge_short if len(raw) <= LONG_WORD else merge_long)(raw, self.ranks)
        packed = array("i", ids).tobytes()
        if len(raw) <= LONG_WORD:
            if len(self) >= REMEMBERED:
                self.clear()
            self[word] = packed
        return packed


class Encoder:
    """Text to ids; one per Python worker and vocabulary file."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        import regex

        self._split = regex.compile(SPLIT_PATTERN).findall
        self._words = _Words(load_ranks(path))

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def packed(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self._words.__getitem__, self._split(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()


_SHIPPED: dict[tuple[str, str], str] = {}


def _ship(spark: SparkSession, folder: str | None, vocabulary: str) -> str:
    """The name under which every executor has the driver's vocabulary file; it travels with the application."""
    path = os.path.abspath(os.path.join(folder or TOKENIZER_DIR, vocabulary))
    at = (spark.sparkContext.applicationId, path)
    if at not in _SHIPPED:
        # Files of one application are told apart by their names, so the name holds the path.
        name = f"{hashlib.md5(path.encode()).hexdigest()[:12]}-{vocabulary}"
        copy = shutil.copy(path, os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), name))
        spark.sparkContext.addFile(copy)
        _SHIPPED[at] = name
    return _SHIPPED[at]


def encode_column(
    df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """(key, ids): the token ids of every row's text, without special tokens.

    One row out for each row in, repeated keys included. A null and an empty text both have an
    empty list; names of special tokens are ordinary text; a text may have any length. Columns
    besides key and text are not read, so their names can't clash. An empty table gives none.
    """
    name = _ship(df.sparkSession, folder, vocabulary)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Encoder.of(SparkFiles.get(name)).packed
        names = [key, "ids"]

        def batch(keys: pa.Array, parts: list[bytes]) -> pa.RecordBatch:
            offsets = np.zeros(len(parts) + 1, np.int32)
            np.cumsum([len(p) >> 2 for p in parts], out=offsets[1:])
            values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(parts))])
            return pa.RecordBatch.from_arrays([keys, pa.ListArray.from_arrays(pa.array(offsets), values)], names=names)

        for b in batches:
            keys, texts = b.column(0), b.column(1)
            parts: list[bytes] = []
            begin = held = 0
            for i, value in enumerate(texts):
                parts.append(packed(value.as_py()))
                held += len(parts[-1])
                if held >= FLUSH_BYTES:
                    yield batch(keys.slice(begin, len(parts)), parts)
                    parts, begin, held = [], i + 1, 0
            if parts:
                yield batch(keys.slice(begin, len(parts)), parts)

    return spread(df.select(F.col(key), F.col(text))).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(
    df: DataFrame, text: str = "text", out: str = "n_tokens", folder: str | None = None, vocabulary: str = VOCABULARY
) -> DataFrame:
    """All columns but ``text``, with the number of its tokens in ``out`` (0 for null and empty).

    Raises ValueError if another column is called ``out``.
    """
    name = _ship(df.sparkSession, folder, vocabulary)
    kept = [c for c in df.columns if c != text]
    if out in kept:
        raise ValueError(f"the table has a column {out} already")
    schema = df.select(*[f"`{c}`" for c in kept]).schema.add(out, LongType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = Encoder.of(SparkFiles.get(name)).packed
        for b in batches:
            n = pa.array([len(packed(t.as_py())) >> 2 for t in b.column(len(kept))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], n], names=[*kept, out])

    return spread(df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))).mapInArrow(run, schema)
