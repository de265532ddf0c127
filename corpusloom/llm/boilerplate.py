"""Passages that recur on many pages of a host, found by suffix arrays over token streams.

The pages of a task are concatenated, page by page, into blocks. A block's suffix array (prefix
doubling over token ranks, as deep as the shortest passage looked for) brings equal passages of
distinct pages side by side. What is on enough of a block's pages is a candidate; a passage on
that share of all pages is on that share of some block's pages, so none is missed, and candidates
are then counted over all pages. A token is boilerplate if it lies in a passage that is frequent;
longer passages are covered by the frequent ones inside them. The runs between are kept as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ingest import first_rows
from ..runtime import Scratch
from .words import BLOCK_CHARS, mix, run_hashes, token_hashes

#: Tokens of the shortest passage, the share of a host's pages it must be on, and the least number of them.
LEAST_TOKENS, SHARE, LEAST_PAGES = 10, 0.02, 5
#: Tokens of a block's suffix array, about.
BLOCK_TOKENS = 2_000_000
#: Candidates one pass over the pages counts, of 16 bytes each; more take several passes.
SENT_CANDIDATES = 1_000_000


def suffix_order(tokens: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes in order of their first ``depth`` tokens, the rank of each suffix by them).

    Suffixes that share these tokens share the rank. Ranks of twice the length come from the pairs
    of those of the length, the last step from two lengths that overlap.
    """
    n = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    length = 1
    while length < depth:
        step = min(length, depth - length)
        after = np.full(n, -1, np.int64)
        after[: max(0, n - step)] = rank[step:]
        rank = np.unique(rank * (n + 1) + after + 1, return_inverse=True)[1].astype(np.int64)
        length += step
    return np.argsort(rank, kind="stable"), rank


def block_candidates(tokens: np.ndarray, page: np.ndarray, depth: int, share: float) -> np.ndarray:
    """Hashes of the passages of ``depth`` tokens on at least that share of a block's pages."""
    grams, owner, at = run_hashes(tokens, page, depth)
    if not len(at):
        return np.empty(0, np.uint64)
    order, rank = suffix_order(tokens, depth)
    inside = np.zeros(len(tokens), bool)
    inside[at] = True  # suffixes that don't leave their page
    order = order[inside[order]]
    # In one passage's run of the array the suffixes are in order of place, so pages come in order.
    first = np.r_[True, (rank[order[1:]] != rank[order[:-1]]) | (page[order[1:]] != page[order[:-1]])]
    kept = order[first]
    starts = np.flatnonzero(np.r_[True, rank[kept[1:]] != rank[kept[:-1]]])
    pages = np.diff(np.r_[starts, len(kept)])
    enough = pages >= max(1, math.ceil(share * len(np.unique(page))))
    of = np.searchsorted(at, kept[starts[enough]])
    return grams[of]


def _salted(grams: np.ndarray, host: str) -> np.ndarray:
    """Hashes of passages of one host; another host's equal passages have others."""
    return mix(grams ^ np.frombuffer(hashlib.blake2b(host.encode("utf-8", "surrogatepass"), digest_size=8).digest(), np.uint64))


def _hosts(column: pa.Array) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for i, h in enumerate(column.to_pylist()):
        out.setdefault("" if h is None else f"={h}", []).append(i)
    return out


def _candidates(pages: DataFrame, depth: int, share: float) -> DataFrame:
    """(gram): locally frequent passages; ``pages`` has _host and _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}  # tokens, pages, number of pages and of tokens of each host

        def flush(host: str) -> Iterator[pa.RecordBatch]:
            tokens, page, _, _ = held.pop(host)
            found = block_candidates(np.concatenate(tokens), np.concatenate(page), depth, share)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(_salted(found, host).view(np.int64))], names=["gram"])

        for b in batches:
            texts = b.column(1).to_pylist()
            for host, rows in _hosts(b.column(0)).items():
                for part in _parts([texts[i] or "" for i in rows]):
                    h, owner, _, _ = token_hashes(part)
                    if not len(h):
                        continue
                    own = held.setdefault(host, [[], [], 0, 0])
                    own[0].append(h)
                    own[1].append(owner + own[2])
                    own[2] += len(part)
                    own[3] += len(h)
                    if own[3] >= BLOCK_TOKENS:
                        yield from flush(host)
            # Many hosts in one task: the largest make room.
            while len(held) > 1 and sum(x[3] for x in held.values()) > 2 * BLOCK_TOKENS:
                yield from flush(max(held, key=lambda x: held[x][3]))
        for host in list(held):
            yield from flush(host)

    return pages.select("_host", "_text").mapInArrow(run, "gram bigint").distinct()


def _parts(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about BLOCK_CHARS characters."""
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK_CHARS):
            size += len(texts[end])
            end += 1
        yield texts[begin:end]
        begin = end


def _pages_of(pages: DataFrame, candidates: np.ndarray, depth: int) -> DataFrame:
    """(gram, n): on how many pages each candidate is, added up in each task."""
    sent = pages.sparkSession.sparkContext.broadcast(np.sort(candidates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        counts = np.zeros(len(wanted), np.int64)
        for b in batches:
            texts = b.column(1).to_pylist()
            for host, rows in _hosts(b.column(0)).items():
                for part in _parts([texts[i] or "" for i in rows]):
                    h, owner, _, _ = token_hashes(part)
                    grams, of, _ = run_hashes(h, owner, depth)
                    if len(grams):
                        place, hit = _lookup(wanted, _salted(grams, host).view(np.int64))
                        once = np.unique(place[hit] * len(part) + of[hit])
                        np.add.at(counts, once // len(part), 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(counts[some])], names=["gram", "n"])

    return pages.select("_host", "_text").mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def _lookup(wanted: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted ``wanted``, whether it is there) of each value."""
    if not len(wanted):
        return np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    place = np.minimum(np.searchsorted(wanted, values), len(wanted) - 1)
    return place, wanted[place] == values


def frequent_passages(
    pages: DataFrame, scratch: Scratch, text: str = "text", host: str | None = None, depth: int = LEAST_TOKENS, share: float = SHARE, least: int = LEAST_PAGES
) -> np.ndarray:
    """Sorted hashes of the passages of ``depth`` tokens on at least ``least`` and ``share`` of a host's distinct pages.

    There are at most the tokens of an average page by ``share`` of them for each host, however
    many pages it has. Pages with equal texts count once. Without ``host`` all pages are of one;
    a null host is a host. Null texts are no pages.
    """
    own = F.lit(None).cast("string") if host is None else F.col(host).cast("string")
    source = scratch.table(pages.where(F.col(text).isNotNull()).select(own.alias("_host"), F.col(text).alias("_text"), F.xxhash64(own, text).alias("_h")))
    distinct = scratch.table(first_rows(source, "_h", [], ["_host", "_text"], scratch))
    sizes = distinct.groupBy("_host").agg(F.count("*").alias("n"))
    found, n = scratch.counted(_candidates(distinct, depth, share))
    blocks = max(1, -(-n // SENT_CANDIDATES))
    out = []
    for b in range(blocks):
        part = found if blocks == 1 else found.where(F.pmod(F.xxhash64("gram"), F.lit(blocks)) == b)
        some = np.array([r["gram"] for r in part.collect()], np.int64)  # a block of them
        if not len(some):
            continue
        counted = _pages_of(distinct, some, depth)
        # The pages of a host differ in number, so the share is taken of the least a passage could need, then of its host.
        floor = least if host is not None else max(least, math.ceil(share * (sizes.first()["n"])))
        out += [r["gram"] for r in counted.where(F.col("n") >= floor).select("gram").collect()]
    frequent = np.sort(np.array(out, np.int64))
    if host is None or not len(frequent):
        return frequent
    return _by_host(distinct, sizes, frequent, depth, share, least)


def _by_host(distinct: DataFrame, sizes: DataFrame, frequent: np.ndarray, depth: int, share: float, least: int) -> np.ndarray:
    """Of passages on ``least`` pages those on the share of their own host's pages."""
    sent = distinct.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            for host, rows in _hosts(b.column(0)).items():
                counts: dict[int, int] = {}
                for part in _parts([texts[i] or "" for i in rows]):
                    h, owner, _, _ = token_hashes(part)
                    grams, of, _ = run_hashes(h, owner, depth)
                    if len(grams):
                        place, hit = _lookup(sent.value, _salted(grams, host).view(np.int64))
                        for g in np.unique(place[hit] * len(part) + of[hit]) // len(part):
                            counts[int(g)] = counts.get(int(g), 0) + 1
                if counts:
                    name = None if host == "" else host[1:]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(counts), pa.string()), pa.array(sent.value[list(counts)]), pa.array(list(counts.values()), pa.int64())], names=["_host", "gram", "n"]
                    )

    found = distinct.select("_host", "_text").mapInArrow(run, "_host string, gram bigint, n bigint").groupBy("_host", "gram").agg(F.sum("n").alias("n"))
    whole = sizes.select(F.col("_host").alias("_of"), F.col("n").alias("pages"))
    kept = found.join(whole, F.col("_host").eqNullSafe(F.col("_of"))).where((F.col("n") >= least) & (F.col("n") >= F.col("pages") * share))
    return np.sort(np.array([r["gram"] for r in kept.select("gram").collect()], np.int64))


def without_passages(text: str, covered: list[tuple[int, int]]) -> str:
    """The text less the given spans of characters; the runs between stay as they are.

    White space before a removed passage goes with it unless it is a line end.
    """
    out, at = [], 0
    for a, b in covered:
        kept = text[at:a]
        out.append(kept.rstrip(" \t") if a > at else "")
        at = b
    rest = text[at:]
    joined = "".join(out)
    if not joined or joined.endswith("\n"):
        rest = rest.lstrip(" \t")
    return re.sub(r"\n{3,}", "\n\n", joined + rest).strip("\n") if covered else text


def remove_passages(
    df: DataFrame, scratch: Scratch, text: str = "text", host: str | None = None, depth: int = LEAST_TOKENS, share: float = SHARE, least: int = LEAST_PAGES
) -> DataFrame:
    """All rows and columns of ``df``, its ``text`` less what is frequent boilerplate of its host.

    Tokens are separated by white space and compared as they are. Null and empty texts stay; a
    text that is boilerplate throughout becomes empty. Texts of any length are read whole. An
    empty table gives no rows.
    """
    stored = scratch.table(df)
    frequent = frequent_passages(stored, scratch, text, host, depth, share, least)
    if not len(frequent):
        return stored
    sent = df.sparkSession.sparkContext.broadcast(frequent)
    own = F.lit(None).cast("string") if host is None else F.col(host).cast("string")
    names = [c for c in stored.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            hosts = [(h, [i for i in rows if texts[i]]) for h, rows in _hosts(b.column(len(names) + 1)).items()]
            for name, rows in hosts:
                begin = 0
                for part in _parts([texts[i] for i in rows]):
                    h, owner, first, end = token_hashes(part)
                    grams, _, at = run_hashes(h, owner, depth)
                    hit = at[_lookup(sent.value, _salted(grams, name).view(np.int64))[1]] if len(grams) else at
                    if len(hit):
                        edge = np.zeros(len(h) + 1, np.int64)
                        np.add.at(edge, hit, 1)
                        np.add.at(edge, hit + depth, -1)
                        inside = np.cumsum(edge[:-1]) > 0
                        turn = np.flatnonzero(np.diff(inside, prepend=False, append=False) | np.r_[False, (owner[1:] != owner[:-1]) & inside[1:] & inside[:-1], False])
                        spans: dict[int, list[tuple[int, int]]] = {}
                        for a, z in zip(turn, turn[1:]):
                            if inside[a]:
                                spans.setdefault(int(owner[a]), []).append((int(first[a]), int(end[z - 1])))
                        for k, covered in spans.items():
                            texts[rows[begin + k]] = without_passages(part[k], covered)
                    begin += len(part)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(texts, pa.string())], names=[*names, text])

    schema = stored.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`")).schema
    made = stored.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`"), own.alias("_host")).mapInArrow(run, schema)
    return made.select(*[F.col(f"`{c}`") for c in stored.columns])
