from collections import Counter

from corpusloom.llm import splits
from corpusloom.runtime import Scratch


def groups(spark, rows):
    df = spark.createDataFrame(rows, "qa_id long, source_arxiv_id string")
    return {r["qa_id"]: r["group_id"] for r in splits.paper_groups(df, Scratch(spark, "t")).collect()}


def test_groups_join_through_samples_and_spellings(spark):
    rows = [
        (1, "2001.00001v1"), (2, "arXiv:2001.00001V3, 2001.00002"), (3, " 2001.00002v2 ,2001.00003v1,"), (4, "https://x.y/abs/2001.00004v9"),
        (5, None), (6, ""), (7, "  "), (8, "2001.00005,2001.00005v2"), (9, "none"), (8, "2001.00005,2001.00005v2"), (None, "2001.00001"), (10, "2001.00004v1"),
    ]
    assert groups(spark, rows) == {1: "2001.00001", 2: "2001.00001", 3: "2001.00001", 4: "2001.00004", 10: "2001.00004", 8: "2001.00005"}
    assert groups(spark, []) == {}


def test_long_chain(spark):
    rows = [(i, f"2001.{i:05d},2001.{i + 1:05d}") for i in range(60)]
    assert set(groups(spark, rows).values()) == {"2001.00000"}


def test_splits_keep_groups_whole_and_near_the_shares(spark):
    rows = [(i, "hot") for i in range(400)] + [(1000 + i, f"g{i // 3}") for i in range(1200)] + [(5000 + i, None) for i in range(400)]
    df = spark.createDataFrame(rows, "qa_id long, group_id string")
    out = splits.split_groups(df, Scratch(spark, "t")).collect()
    assert len(out) == len(rows)
    of = {}
    for r in out:
        if r["group_id"] is not None:
            of.setdefault(r["group_id"], set()).add(r["split"])
    assert all(len(s) == 1 for s in of.values())
    n = Counter(r["split"] for r in out)
    assert abs(n["train"] - 1600) <= 4 and abs(n["validation"] - 200) <= 4 and abs(n["test"] - 200) <= 4
    again = {r["qa_id"]: r["split"] for r in splits.split_groups(df.repartition(7), Scratch(spark, "t")).collect()}
    assert again == {r["qa_id"]: r["split"] for r in out}
    assert splits.split_groups(df.limit(0), Scratch(spark, "t")).count() == 0
