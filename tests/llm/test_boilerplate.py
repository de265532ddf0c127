import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate
from corpusloom.llm.words import token_hashes
from corpusloom.runtime import Scratch


def brute(pages, depth, share, least):
    """Texts by key less the tokens that lie in a passage on enough distinct pages of the host."""
    out = {}
    for host in {h for _, h, _ in pages}:
        own = [(k, t) for k, h, t in pages if h == host]
        distinct = {t for _, t in own if t is not None}
        on = {}
        for t in distinct:
            w = t.split()
            for g in {tuple(w[i : i + depth]) for i in range(len(w) - depth + 1)}:
                on[g] = on.get(g, 0) + 1
        frequent = {g for g, n in on.items() if n >= least and n >= share * len(distinct)}
        for k, t in own:
            w = (t or "").split()
            covered = {i + j for i in range(len(w) - depth + 1) if tuple(w[i : i + depth]) in frequent for j in range(depth)}
            out[k] = [x for i, x in enumerate(w) if i not in covered]
    return out


def pages(seed, n=160, hosts=("a", "b", None)):
    rng = random.Random(seed)
    names = [f"w{i}" for i in range(60)]
    notices = [" ".join(rng.choice(names) for _ in range(size)) for size in (6, 9, 5, 4, 3)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choice(names) for _ in range(rng.randrange(0, 25))) for _ in range(3)]
        for k, notice in enumerate(notices):
            if rng.random() < 0.5 / (k + 1):
                parts.insert(rng.randrange(len(parts) + 1), notice)
        rows.append((i, rng.choice(hosts), rng.choice([" ", "\n", "\n\n", "  "]).join(parts)))
    rows += [(n + i, h, t) for i, (_, h, t) in enumerate(rows[:30])]  # copies of pages count once
    return rows + [(9000, "a", None), (9001, "a", ""), (9002, None, "w1")]


@pytest.mark.parametrize("host", [None, "host"])
@pytest.mark.parametrize("block, sent", [(boilerplate.BLOCK_TOKENS, boilerplate.SENT_CANDIDATES), (600, 40)])
def test_equals_brute_force(spark, monkeypatch, host, block, sent):
    """No unique run is lost and no frequent passage kept, whatever the blocks."""
    monkeypatch.setattr(boilerplate, "SENT_CANDIDATES", sent)
    monkeypatch.setattr(boilerplate, "BLOCK_TOKENS", block)
    rows = pages(3)
    df = spark.createDataFrame(rows, "k int, host string, text string").repartition(3).withColumn("gram", F.lit(1)).withColumn("_h", F.lit(2))
    found = boilerplate.remove_passages(df, Scratch(spark, "t"), "text", host, depth=5, share=0.1, least=4)
    assert found.columns == df.columns
    got = {r["k"]: r["text"] for r in found.collect()}
    want = brute(rows if host else [(k, "", t) for k, _, t in rows], 5, 0.1, 4)
    assert {k: (t or "").split() for k, t in got.items()} == want and got[9000] is None
    assert sum(len(w) for w in want.values()) < sum(len((t or "").split()) for _, _, t in rows)


def test_suffix_order():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 3, 300).astype(np.uint64)
    for depth in (1, 2, 3, 5, 8, 11):
        order, rank = boilerplate.suffix_order(tokens, depth)
        key = lambda i: [int(x) for x in tokens[i : i + depth]]
        assert all(key(a) <= key(b) for a, b in zip(order, order[1:]))
        assert all((key(a) == key(b)) == (rank[a] == rank[b]) for a in range(0, 300, 7) for b in range(300))


def test_lines_stay_apart(spark):
    notice = "This text is shared with all and may change before print."
    rows = [(i, f"# Head {i}\n\nBody with words{i}.\n\n{notice}\n{i}. item") for i in range(8)] + [(8, notice), (9, "alone")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r["k"]: r["text"] for r in boilerplate.remove_passages(df, Scratch(spark, "t"), depth=10, share=0.02, least=5).collect()}
    assert got[3] == "# Head 3\n\nBody with words3.\n\n3. item" and got[8] == "" and got[9] == "alone"
    assert boilerplate.remove_passages(df.limit(0), Scratch(spark, "t")).count() == 0
    few = boilerplate.remove_passages(df.where("k < 4"), Scratch(spark, "t"), depth=10)
    assert all(notice in r["text"] for r in few.collect())


def test_tokens_of_any_text():
    texts = ["a  b　c", "", "\n", "é\x1f日本 x"]
    h, owner, first, end = token_hashes(texts)
    assert [texts[o][a:b] for o, a, b in zip(owner, first, end)] == [t for x in texts for t in x.split()]
    assert owner.tolist() == [0, 0, 0, 3, 3, 3]
    assert not len(token_hashes(["", " "])[0])
