"""Groups of near-duplicate texts by covering locality-sensitive hashing of their shingles.

A text is the set of its runs of ``width`` words. ``SKETCHES`` independent signatures of 15
min-hashes each stand for the set; two texts of similarity J agree in each position with chance J.
The positions of a signature are the non-zero vectors of four bits, and the masks are the 35 lines
{a, b, a xor b} among them: a table per line hashes the three positions of its mask. This covers a
radius: no nine positions are free of a line, so two signatures that differ in at most 6 of 15
positions always collide in some table, and mostly at larger distances too. All three signatures
miss 8 in 10,000 pairs of similarity 0.5, 1 in 10,000 at 0.55, 1 in 100,000 at 0.6 (exact counts
over all sets of agreeing positions).

Candidates are verified on the exact shingle sets, so no false link remains.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..runtime import Scratch
from .words import shingle_sets

SKETCHES = 3
POINTS = 15
LINES = [(a - 1, b - 1, (a ^ b) - 1) for a in range(1, 16) for b in range(a + 1, 16) if a ^ b > b]


def _routes() -> list[tuple[int, int, list[tuple[int, int, int]]]]:
    """(signature, point, five lines through it): every line once for each signature.

    Every line meets the plane of the points 1 to 7 in one or in all three of its points, so seven
    points reach all lines; each of the plane's own seven lines is given to a point of its own.
    """
    through: dict[int, list] = {h: [line for line in LINES if h in line and sum(x < 7 for x in line) == 1] for h in range(7)}
    inner = [line for line in LINES if all(x < 7 for x in line)]

    def match(i: int, used: tuple[int, ...]) -> tuple[int, ...] | None:
        if i == len(inner):
            return used
        for h in inner[i]:
            if h not in used and (rest := match(i + 1, (*used, h))):
                return rest
        return None

    for line, h in zip(inner, match(0, ())):
        through[h].append(line)
    return [(s, h, through[h]) for s in range(SKETCHES) for h in range(7)]


ROUTES = _routes()
EACH = len(ROUTES[0][2])
#: Min-hashes cut to four bits that thin out chance collisions before verification; the first are
#: those of the signatures.
NIBBLES = 64
#: Bytes of one part of the buckets, about; a task reads its parts one after another, so this and not
#: the table decides what it holds. A text has 21 rows of 61 bytes.
PART_BYTES = 8 << 20
TEXT_BYTES = 21 * 61
#: Tasks of one pass at most; beyond so many parts each task reads several.
MOST_TASKS = 20_000
#: Members of a bucket or group that meet in one task.
SALTED = 20_000
#: A bucket of more distinct texts than this is compared by leaders, not by all of its pairs.
SMALL_BUCKET = 128

_RNG = np.random.default_rng(20240131)
_MULT = (_RNG.integers(1, 2**63, NIBBLES, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_EACH_NIBBLE = np.uint64(0x1111111111111111)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


#: Shingles hashed at once, so that the arrays stay in a core's cache.
_AT_ONCE = 1 << 15


def min_hashes(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(min-hashes, sets); the sets lie one after another in ``values``, which are mixed hashes."""
    out = np.empty((NIBBLES, len(starts)), np.uint64)
    ends = np.r_[starts[1:], len(values)]
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _AT_ONCE, side="right")))
        own, at = values[starts[a] : ends[b - 1]], starts[a:b] - starts[a]
        scaled = np.empty_like(own)
        for i, m in enumerate(_MULT):
            np.multiply(own, m, out=scaled)
            out[i, a:b] = np.minimum.reduceat(scaled, at)
        a = b
    return out


def fingerprints(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set (values of a set are distinct)."""
    a = np.add.reduceat(_mix(values), starts)
    b = np.bitwise_xor.reduceat(_mix(values + np.uint64(0x9E3779B97F4A7C15)), starts)
    return _mix(a ^ (b * np.uint64(0xD1342543DE82EF95))).view(np.int64)


def table_keys(low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the min-hashes: (routes, sets) hashes that route, and (routes, sets, EACH) keys of lines."""
    send = np.empty((len(ROUTES), low.shape[1]), np.uint64)
    keys = np.empty((len(ROUTES), low.shape[1], EACH), np.uint32)
    for r, (s, h, lines) in enumerate(ROUTES):
        own = low[s * POINTS : (s + 1) * POINTS]
        send[r] = _mix(own[h] + np.uint64(0x632BE59BD9B4E019 + 2 * r))
        for j, (a, b, c) in enumerate(lines):
            x = _mix(own[a] + np.uint64(0x2545F4914F6CDD1D + 2 * (r * EACH + j)))
            x = _mix(x ^ own[b])
            keys[r, :, j] = (_mix(x + own[c]) >> np.uint64(32)).astype(np.uint32)
    return send, keys


def thin_sketches(low: np.ndarray) -> np.ndarray:
    """(sets, words of 64 bits): four bits of each min-hash."""
    out = np.zeros((low.shape[1], NIBBLES // 16), np.uint64)
    for i in range(NIBBLES):
        out[:, i // 16] |= (_mix(low[i]) & np.uint64(15)) << np.uint64(4 * (i % 16))
    return out


def agreement(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many of their min-hashes the sketches x and y agree, row by row."""
    d = x ^ y
    d |= d >> np.uint64(2)  # a nibble's lowest bit becomes the or of its four
    d |= d >> np.uint64(1)
    return NIBBLES - np.bitwise_count(d & _EACH_NIBBLE).sum(axis=1, dtype=np.int64)


def least_agreement(similarity: float) -> int:
    """The agreement of a pair of this similarity, less 3.5 standard deviations (2 in 10,000)."""
    p = similarity + (1 - similarity) / 16
    return int(NIBBLES * p - 3.5 * (NIBBLES * p * (1 - p)) ** 0.5)


def taken_in(similarity: float) -> int:
    """Agreement at which a leader takes a text in; three in 10,000 pairs of just this similarity reach it at 0.5."""
    p = similarity + (1 - similarity) / 16
    return min(NIBBLES, math.ceil(NIBBLES * p + 3.5 * (NIBBLES * p * (1 - p)) ** 0.5))


def _members(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, values, starts = shingle_sets(b.column(1), width)
            if len(keep):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(keep)), pa.array(fingerprints(values, starts))], names=["key", "fp"]
                )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"key {kind}, fp bigint")


_BLOB = ("part", "ids", "sketches", "routes", "keys")


def _bucket_blobs(df: DataFrame, text: str, width: int, parts: int) -> DataFrame:
    """(part, ids, sketches, routes, keys): the rows of every text, packed by bucket partition.

    A task packs each distinct text once; a row takes 61 bytes and a text has 21, whatever the
    number of partitions.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            keep, values, starts = shingle_sets(b.column(0), width)
            if not len(keep):
                continue
            fps = fingerprints(values, starts)
            _, first = np.unique(fps, return_index=True)
            first = np.array([i for i in first if int(fps[i]) not in seen], np.int64)
            if not len(first):
                continue
            if len(seen) > 1_000_000:
                seen.clear()
            fps = fps[first]
            seen.update(fps.tolist())
            low = min_hashes(values, starts)[:, first]
            (send, keys), sketch = table_keys(low), thin_sketches(low)
            part = (send % np.uint64(parts)).astype(np.int64).ravel()
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            keys = keys.reshape(-1, EACH)
            out: dict[str, list] = {c: [] for c in _BLOB}
            for p in range(parts):
                own = order[bounds[p] : bounds[p + 1]]
                if len(own):
                    at = own % len(first)
                    row = (fps[at], sketch[at], (own // len(first)).astype(np.uint8), keys[own])
                    out["part"].append(p)
                    for c, x in zip(_BLOB[1:], row):
                        out[c].append(x.tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[c], pa.int32() if c == "part" else pa.binary()) for c in _BLOB], names=list(_BLOB)
            )

    return df.select(text).mapInArrow(run, "part int, ids binary, sketches binary, routes binary, keys binary")


def _candidates(blobs: DataFrame, parts: int, similarity: float) -> DataFrame:
    """(run, a, b, hot, sketch): pairs of texts of one bucket whose sketches agree enough.

    A bucket of at most SMALL_BUCKET texts compares its pairs. In a larger one (copies of one
    text, or texts that share their rarest runs by chance) each text not taken in yet becomes a
    leader, meets all others, and takes in those that agree in :func:`taken_in` places, which needn't
    meet each other, as they are linked through the leader. All texts taken in, by one leader too,
    are listed (a = b, hot, run = the bucket, with their sketch) for :func:`_rest_of_hot`, which compares those that
    aren't connected in the end.
    """
    need, enough = least_agreement(similarity), taken_in(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows = None, []
        for batch in batches:
            for p, *row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if p != current and rows:
                    yield from compare(rows)
                    rows = []
                current = p
                rows.append(row)
        if rows:
            yield from compare(rows)

    def compare(rows: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        ids = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
        sketches = np.concatenate([np.frombuffer(r[1], np.uint64).reshape(-1, NIBBLES // 16) for r in rows])
        route = np.concatenate([np.frombuffer(r[2], np.uint8) for r in rows]).astype(np.int64)
        key = np.concatenate([np.frombuffer(r[3], np.uint32).reshape(-1, EACH) for r in rows]).astype(np.int64)
        key = (((route * EACH)[:, None] + np.arange(EACH)) << 32 | key).ravel()
        at = np.repeat(np.arange(len(ids)), EACH)
        order = np.lexsort((ids[at], key))
        key, at = key[order], at[order]
        new = np.ones(len(key), bool)  # equal texts of other tasks
        new[1:] = (key[1:] != key[:-1]) | (ids[at[1:]] != ids[at[:-1]])
        key, at = key[new], at[new]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        left, right = [], []
        for size in np.unique(sizes):
            if size < 2:
                continue
            of = starts[sizes == size]
            if size <= SMALL_BUCKET:
                i, j = np.triu_indices(size, 1)
                for block in np.array_split(of, max(1, len(of) * len(i) // 500_000)):
                    x, y = at[(block[:, None] + i).ravel()], at[(block[:, None] + j).ravel()]
                    ok = agreement(sketches[x], sketches[y]) >= need
                    left.append(ids[x[ok]])
                    right.append(ids[y[ok]])
            else:
                for s in of:
                    own = at[s : s + size]
                    x, y, led = _by_leaders(sketches[own], need, enough)
                    left.append(ids[own[x]])
                    right.append(ids[own[y]])
                    taken = own[led >= 0]
                    if len(taken) > 1:
                        yield _pairs(np.full(len(taken), key[s]), ids[taken], ids[taken], sketches[taken])
        if left:
            a, b = np.concatenate(left), np.concatenate(right)
            a, b = np.minimum(a, b), np.maximum(a, b)
            both = np.unique(np.stack([a, b], 1), axis=0)
            yield _pairs(np.zeros(len(both), np.int64), both[:, 0], both[:, 1], None)

    tasks = min(parts, MOST_TASKS)
    placed = blobs.repartitionById(tasks, F.pmod(F.col("part"), F.lit(tasks)))
    if tasks < parts:
        placed = placed.sortWithinPartitions("part")  # so that a task holds one part at a time
    return placed.mapInArrow(run, "run bigint, a bigint, b bigint, hot boolean, sketch binary")


def _by_leaders(sketches: np.ndarray, need: int, enough: int = NIBBLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, led): places that agree enough, and who took each text in, -1 for leaders."""
    n = len(sketches)
    led = np.full(n, -1)
    left, right = [], []
    for i in range(n):
        if led[i] >= 0:
            continue
        ag = agreement(sketches[i : i + 1], sketches)
        ok = ag >= need
        ok[: i + 1] &= led[: i + 1] >= 0  # earlier leaders have met this one
        found = np.flatnonzero(ok)
        left.append(np.full(len(found), i))
        right.append(found)
        new = found[(found > i) & (led[found] < 0) & (ag[found] >= enough)]
        led[new] = i
    return np.concatenate(left), np.concatenate(right), led


def _pairs(run, a, b, sketches: np.ndarray | None) -> pa.RecordBatch:
    n, hot = len(a), sketches is not None
    shown = pa.array([x.tobytes() for x in sketches], pa.binary()) if hot else pa.nulls(n, pa.binary())
    return pa.RecordBatch.from_arrays(
        [pa.array(run, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(np.full(n, hot)), shown],
        names=["run", "a", "b", "hot", "sketch"],
    )


def _verify(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose exact shingle sets reach the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i, (x, y) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                if common >= similarity * (len(x) + len(y) - common):
                    keep.append(i)
            if keep:
                at = pa.array(keep)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], names=["a", "b"])

    x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _sets(df: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """(fp, items): the sorted shingle hashes of each distinct text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, values, starts = shingle_sets(b.column(0), width)
            if len(keep):
                ends = np.r_[starts[1:], len(values)]
                items = [values[s:e].tobytes() for s, e in zip(starts, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(fingerprints(values, starts)), pa.array(items, pa.binary())], names=["fp", "items"])

    return df.select(text).mapInArrow(run, "fp bigint, items binary").dropDuplicates(["fp"])


#: Keys whose texts are verified are sent to every executor up to this many, and joined beyond.
SENT_KEYS = 400_000


def near_duplicate_groups(
    df: DataFrame, scratch: Scratch, key: str = "chunk_id", text: str = "text", width: int = 5, similarity: float = 0.8
) -> DataFrame:
    """(key, group): the group of every row that has a near duplicate, one row per key.

    Words are the longest runs of letters and digits, case ignored. Two texts are linked if their
    Jaccard similarity on distinct runs of ``width`` words is at least ``similarity``; a group is
    what links join, directly or through others, and is named by a number. Rows with a null key
    or text, or a text of fewer than ``width`` words, are in no group. Rows that repeat a key
    count once if their texts are equal; a key with several texts is a member by each of them and
    joins their groups. Other columns are not read. An empty table gives no rows.

    Equal sets are one node throughout, so a text with very many copies costs no more than one.
    Sets are told apart by 64-bit hashes; the chance that any two of n differ and share one is
    n squared by 2**65.
    """
    spark = df.sparkSession
    source = df.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    members, n = scratch.counted(_members(source, key, text, width).distinct())
    parts = max(spark.sparkContext.defaultParallelism, -(-n * TEXT_BYTES // PART_BYTES))
    found = scratch.table(_candidates(_bucket_blobs(source, text, width, parts), parts, similarity))
    pairs = scratch.table(found.where("not hot").select("a", "b").distinct())
    hot = found.where("hot").select("run", F.col("a").alias("fp"), "sketch")

    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp")))
    named = named.unionByName(hot.select("fp")).distinct()
    wanted = scratch.table(members.join(named, "fp", "left_semi").groupBy("fp").agg(F.min("key").alias(key)).select(key))
    few = wanted.count() <= SENT_KEYS
    texts = source.select(key, text).join(F.broadcast(wanted) if few else wanted, key, "left_semi")
    sets = scratch.table(_sets(texts, key, text, width))
    links = scratch.table(_verify(pairs, sets, similarity))

    several = members.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z").select("key")
    by_key = (
        members.join(several, "key").groupBy("key").agg(F.min("fp").alias("a")).join(members, "key").select("a", F.col("fp").alias("b"))
    )
    edges = links.unionByName(by_key)
    if not hot.isEmpty():
        part = connected_components(edges, scratch)
        extra = scratch.table(_verify(_rest_of_hot(hot, part, similarity), sets, similarity))
        edges = edges.unionByName(extra)
    roots = connected_components(edges, scratch)
    grouped = members.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        F.col("key").alias(key), F.coalesce("root", "fp").alias("group")
    )
    grouped = grouped.distinct()
    full = grouped.groupBy("group").agg(F.count("*").alias("n")).where("n > 1").select("group")
    return grouped.join(full, "group", "left_semi").select(key, "group")


def _rest_of_hot(hot: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs of a large bucket that the links so far leave apart, thinned by their sketches.

    Those listed were taken in by leaders, so nearly all of a bucket are in one component by now.
    The texts outside its largest component meet all others of the bucket; those inside never
    meet each other. Members meet in shares of at most SALTED, to which the outsiders are sent.
    """
    placed = hot.dropDuplicates(["run", "fp"]).join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left")
    placed = placed.select("run", "fp", "sketch", F.coalesce("root", "fp").alias("root"))
    parts = placed.groupBy("run", "root").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("run").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.count("*").alias("roots"))
    mixed = mixed.where("roots > 1").select("run", "main", F.ceil(F.col("n") / SALTED).cast("int").alias("shares"))
    placed = placed.join(mixed, "run")
    outside = placed.where("root <> main").select("run", F.col("fp").alias("a"), F.col("root").alias("ra"), F.col("sketch").alias("x"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    others = placed.select("run", F.col("fp").alias("b"), F.col("root").alias("rb"), "main", F.col("sketch").alias("y"), F.pmod(F.xxhash64("fp"), "shares").cast("int").alias("share"))
    met = outside.join(others, ["run", "share"]).where("ra <> rb and (rb = main or a < b)")
    need = least_agreement(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint64).reshape(-1, NIBBLES // 16) for c in (2, 3))
                at = pa.array(np.flatnonzero(agreement(x, y) >= need))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], names=["a", "b"])

    pairs = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "x", "y")
    return pairs.mapInArrow(run, "a bigint, b bigint").distinct()


def group_pairs(groups: DataFrame, key: str = "chunk_id") -> DataFrame:
    """(key_a, key_b) with key_a < key_b: each pair of one group.

    Large groups meet in shares of at most SALTED members, to each of which all members are sent,
    so a group of any size is spread over tasks. The pairs of a group grow with its square; the
    groups themselves are the smaller result.
    """
    own = groups.select("group", F.col(key).alias("_k")).distinct()
    shares = own.groupBy("group").agg(F.ceil(F.count("*") / SALTED).cast("int").alias("_shares"))
    placed = own.join(shares, "group")
    a = placed.select("group", F.col("_k").alias(f"{key}_a"), F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)).alias("_share"))
    b = placed.select("group", F.col("_k").alias(f"{key}_b"), F.pmod(F.xxhash64("_k"), "_shares").cast("int").alias("_share"))
    met = a.join(b, ["group", "_share"]).where(F.col(f"{key}_a") < F.col(f"{key}_b"))
    # A key with several texts is in one group by all of them, so a pair comes once.
    return met.select(f"{key}_a", f"{key}_b")
