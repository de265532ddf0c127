import itertools
import random
import re

from pyspark.sql import functions as F

from corpusloom.llm import neardup
from corpusloom.runtime import Scratch

WORD = re.compile(r"[^\W_]+")


def shingles(text, width):
    w = WORD.findall(text.lower())
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def brute(rows, width, similarity):
    sets = {}
    for k, t in rows:
        if k is not None and t is not None and (s := shingles(t, width)):
            sets[k] = s
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        common = len(sets[a] & sets[b])
        if common >= similarity * (len(sets[a]) + len(sets[b]) - common):
            parent[find(a)] = find(b)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if find(a) == find(b)}


def found(spark, rows, width, similarity, columns="chunk_id string, text string"):
    df = spark.createDataFrame(rows, columns)
    groups = neardup.near_duplicate_groups(df, Scratch(spark, "t"), width=width, similarity=similarity)
    return {tuple(r) for r in neardup.group_pairs(groups).collect()}


def corpus(seed, n_base=12, copies=5):
    rng = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 9 == 0 else f"w{i}" for i in range(400)]
    rows = []
    for b in range(n_base):
        base = [rng.choice(vocabulary) for _ in range(80)]
        rows.append((f"{b}-0", " ".join(base)))
        for c in range(1, copies):
            text = list(base)
            for _ in range(rng.randrange(0, 8)):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [rng.choice(vocabulary)] * rng.randrange(1, 3)
            rows.append((f"{b}-{c}", ", ".join(text).upper() if c % 2 else " ".join(text)))
    return rows


def test_equals_brute_force(spark):
    rows = corpus(1)
    assert found(spark, rows, 3, 0.5) == brute(rows, 3, 0.5)
    assert found(spark, rows, 5, 0.8) == brute(rows, 5, 0.8)


def test_dirt(spark):
    text = " ".join(f"word{i}" for i in range(30))
    rows = [("a", text), ("a", text), ("b", text), ("c", text + " more"), (None, text), ("d", None), ("e", ""), ("f", "two words"), ("g", "two words"), ("h", "x" * 200_000), ("i", "!!! ???")]
    assert found(spark, rows, 3, 0.5) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert found(spark, [], 3, 0.5) == set()
    wide = spark.createDataFrame([("a", text, 1, 2), ("b", text, 3, 4)], "chunk_id string, text string, `group` int, fp int")
    groups = neardup.near_duplicate_groups(wide, Scratch(spark, "t"), width=3, similarity=0.5)
    assert groups.columns == ["chunk_id", "group"] and groups.count() == 2


def test_large_bucket_of_edited_copies(spark):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(400):
        text = list(base)
        text[rng.randrange(120)] = f"edit{i}"
        rows.append((f"k{i:03d}", " ".join(text)))
    rows += [(f"o{i}", " ".join(f"z{i}x{j}" for j in range(60))) for i in range(5)]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    groups = neardup.near_duplicate_groups(df, Scratch(spark, "t"), width=3, similarity=0.5)
    sizes = [r["count"] for r in groups.groupBy("group").count().collect()]
    assert sizes == [400]


def test_lines_cover_the_radius():
    """Any nine positions hold a whole line, so six differing ones never hide a pair."""
    lines = [sum(1 << i for i in line) for line in neardup.LINES]
    assert len(lines) == 35
    for nine in itertools.combinations(range(15), 9):
        mask = sum(1 << i for i in nine)
        assert any(line & mask == line for line in lines)


def test_routes_hold_every_line_once():
    for signature in range(neardup.SKETCHES):
        lines = [line for s, h, own in neardup.ROUTES if s == signature for line in own]
        assert sorted(lines) == sorted(neardup.LINES)
    assert all(h in line for _, h, own in neardup.ROUTES for line in own)


def test_leaders_meet_all():
    import numpy as np

    rng = np.random.default_rng(2)
    s = rng.integers(0, 2**63, (40, neardup.NIBBLES // 16), dtype=np.uint64)
    s[10:20] = s[0]
    x, y, led = neardup._by_leaders(s, 20)
    got = {tuple(sorted(p)) for p in zip(x.tolist(), y.tolist())}
    full = {(i, j) for i in range(40) for j in range(i + 1, 40) if neardup.agreement(s[i : i + 1], s[j : j + 1])[0] >= 20}
    assert {(0, j) for j in range(10, 20)} <= got <= full
    assert full - got <= {(i, j) for i in range(10, 20) for j in range(i + 1, 20)}
    assert (led[10:20] == 0).all()


def test_followers_of_one_leader_are_listed(spark):
    import numpy as np

    n = neardup.SMALL_BUCKET + 2
    blob = (
        np.arange(n, dtype=np.int64).tobytes(), np.zeros((n, neardup.NIBBLES // 16), np.uint64).tobytes(),
        np.zeros(n, np.uint8).tobytes(), np.zeros((n, neardup.EACH), np.uint32).tobytes(),
    )
    blobs = spark.createDataFrame([(0, *map(bytearray, blob))], "part int, ids binary, sketches binary, routes binary, keys binary")
    found = neardup._candidates(blobs, 1, 0.8).collect()
    assert {r["a"] for r in found if r["hot"]} == set(range(1, n))


def test_large_bucket_at_the_usual_similarity(spark, monkeypatch):
    """A bucket beyond every bound: few of its texts are in reach of the leader, and shares are small."""
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 8)
    monkeypatch.setattr(neardup, "SALTED", 7)
    monkeypatch.setattr(neardup, "PART_BYTES", 2000)
    monkeypatch.setattr(neardup, "MOST_TASKS", 3)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.randrange(1, 7)):
            text[rng.randrange(150)] = f"edit{i}x{rng.randrange(9)}"
        rows.append((f"k{i:03d}", " ".join(text)))
    assert found(spark, rows, 5, 0.8) == brute(rows, 5, 0.8)
    assert found(spark, rows, 3, 0.5) == brute(rows, 3, 0.5)


def test_rest_of_hot_compares_across_components(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(neardup, "SALTED", 4)
    same, far = np.zeros(neardup.NIBBLES // 16, np.uint64).tobytes(), np.full(neardup.NIBBLES // 16, 2**64 - 1, np.uint64).tobytes()
    roots = {i: 0 for i in range(10)} | {10: 10, 11: 10, 13: 13}
    hot = [(7, i, bytearray(far if i in (3, 12) else same)) for i in range(13)] + [(8, i, bytearray(same)) for i in range(5)] + [(9, 13, bytearray(same)), (9, 1, bytearray(same))]
    got = neardup._rest_of_hot(
        spark.createDataFrame(hot, "run long, fp long, sketch binary"), spark.createDataFrame(list(roots.items()), "node long, root long"), 0.8
    ).collect()
    near = [i for i in range(10) if i != 3]
    assert {tuple(r) for r in got} == {(i, j) for i in near for j in (10, 11)} | {(3, 12), (1, 13)}


def test_leaders_take_in_by_similarity():
    assert neardup.taken_in(0.5) == 48 and neardup.taken_in(0.8) == 63 and neardup.taken_in(1.0) == 64
