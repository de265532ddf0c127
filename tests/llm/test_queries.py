import os

import pytest

from corpusloom.llm import defects, mixing
from corpusloom.llm.queries import ORACLE, QUERIES

from ..compare import duck, same_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, tables, name):
    same_rows(QUERIES[name](spark, SF), tables.sql(ORACLE[name]))


def test_near_duplicates_equal_brute_force(spark, tables):
    from .test_neardup import brute

    rows = tables.sql("select distinct chunk_id, text from chunks").fetchall()
    keys = [k for k, _ in rows]
    assert len(keys) == len(set(keys))
    assert {tuple(r) for r in QUERIES["p1_found"](spark, SF).collect()} == brute(rows, 3, 0.5)


def test_splits_are_whole_and_near_the_shares(spark, tables):
    rows = QUERIES["p2_split"](spark, SF).collect()
    assert sorted(r["qa_id"] for r in rows) == [r[0] for r in tables.sql("select distinct qa_id from qa_dataset order by 1").fetchall()]
    group = dict(tables.sql(ORACLE["p2_found"]).fetchall())
    assert all(r["group_id"] == group.get(r["qa_id"]) for r in rows)
    of = {}
    for r in rows:
        of.setdefault(r["group_id"] or r["qa_id"], set()).add(r["split"])
    assert all(len(x) == 1 for x in of.values())
    largest = max(sum(r["group_id"] == g for r in rows) for g in set(group.values()))
    n = {s: sum(r["split"] == s for r in rows) for s in ("train", "validation", "test")}
    assert abs(n["train"] - 0.8 * len(rows)) <= max(2, largest) and abs(n["test"] - 0.1 * len(rows)) <= max(2, largest)


def test_pieces_make_up_the_texts(spark, tables):
    rows = QUERIES["p5_pieces"](spark, SF).collect()
    long = dict(tables.sql(f"select chunk_id, any_value(text) from chunks where chunk_id in ({ORACLE['p5_found']}) group by 1").fetchall())
    assert {r["chunk_id"] for r in rows} == set(long) and long
    for key, text in long.items():
        own = sorted((r for r in rows if r["chunk_id"] == key), key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in own] == list(range(1, own[0]["n_pieces"] + 1)) and all(r["n_words"] == len(r["piece"].split()) <= 450 for r in own)
        assert [r["overlap_words"] for r in own] == [0] + [64] * (len(own) - 1)
        assert all(a["piece"].split()[-64:] == b["piece"].split()[:64] for a, b in zip(own, own[1:]))
        assert [w for r in own for w in r["piece"].split()[r["overlap_words"] :]] == text.split()


def test_defects_by_what_sql_can_tell(spark, tables):
    got = {(r["qa_id"], r["defect"]) for r in QUERIES["p6_found"](spark, SF).collect()}
    assert {d for _, d in got} <= set(defects.DEFECTS) and len({k for k, _ in got}) == len(got)
    blank = {r[0] for r in tables.sql(r"select distinct qa_id from qa_dataset where output is null or not regexp_matches(output, '[\p{L}\p{N}]')").fetchall()}
    assert blank <= {k for k, d in got if d == "empty"}
    refusals = {r[0] for r in tables.sql("select qa_id from qa_dataset where lower(trim(type)) = 'refusal' or type is null").fetchall()}
    assert not refusals & {k for k, d in got if d == "refusal"}


def test_encoding_equals_the_library(spark, tables):
    from .test_others import PATH, reference

    lib, got = reference(PATH), {r["doc_id"]: r["ids"] for r in QUERIES["p7_ids"](spark, SF).collect()}
    rows = tables.sql("select doc_id, text from documents").fetchall()
    assert got == {k: lib.encode_ordinary(t) if t else [] for k, t in rows}


@pytest.mark.parametrize("folder", [SF, "/root/testdata/sf0.1"])
def test_shares_of_the_mix(spark, folder):
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    goal = {s: (share, times) for s, share, times in duck(folder).sql("select source, target_share, max_repeats from mix_targets").fetchall()}
    mix = QUERIES["p8_mix"](spark, folder).collect()
    sizes, largest, used = {}, {}, {}
    for r in mix:
        s, n = r["source"], r["n_tokens"]
        sizes[s], largest[s], used[s] = sizes.get(s, 0) + n, max(largest.get(s, 0), n), used.get(s, 0) + n * r["copies"]
        assert 0 <= r["copies"] <= goal[s][1]
    assert len({r["doc_id"] for r in mix}) == len(mix)
    wanted = mixing.plan_amounts(sizes, goal)
    for s, n in used.items():
        assert abs(n - wanted.get(s, 0)) <= largest[s], s
    report = {r["source"]: r for r in QUERIES["p8_shares"](spark, folder).collect()}
    assert set(report) == set(goal)
    for s, r in report.items():
        assert (r["target_share"], r["max_repeats"]) == goal[s] and r["mix_tokens"] == used.get(s, 0)
        assert r["mix_share"] == pytest.approx(used.get(s, 0) / sum(used.values()))


def test_rates_add_up(spark, tables):
    found = {r["doc_id"] for r in QUERIES["p9_found"](spark, SF).collect()}
    of = dict(tables.sql("select doc_id, source from documents").fetchall())
    rates = {r["source"]: r for r in QUERIES["p9_rates"](spark, SF).collect()}
    assert {s: r["documents"] for s, r in rates.items()} == dict(tables.sql("select source, count(*) from documents group by 1").fetchall())
    for s, r in rates.items():
        assert r["truncated"] == sum(of[k] == s for k in found) and r["share"] == pytest.approx(r["truncated"] / r["documents"])
    assert sum(r["truncated"] for r in rates.values()) == len(found) > 0


def test_found_columns(spark):
    want = {
        "p1_found": [("chunk_id_a", "string"), ("chunk_id_b", "string")],
        "p2_found": [("qa_id", "bigint"), ("group_id", "string")],
        "p3_found": [("rec_table", "string"), ("rec_key", "string"), ("kind", "string")],
        "p4_found": [("qa_id", "bigint"), ("item_id", "bigint")],
        "p5_found": [("chunk_id", "string")],
        "p6_found": [("qa_id", "bigint"), ("defect", "string")],
        "p7_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p9_found": [("doc_id", "bigint")],
    }
    for name, columns in want.items():
        assert QUERIES[name](spark, SF).dtypes == columns, name


def test_clean_text_covers_both_tables(spark):
    df = QUERIES["p3_clean"](spark, SF)
    assert df.dtypes == [("rec_table", "string"), ("rec_key", "string"), ("kinds", "array<string>"), ("clean", "string")]
    rows = df.collect()
    for table, key in (("chunks", "chunk_id"), ("papers_parsed", "arxiv_id")):
        want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()} - {None}
        assert {r["rec_key"] for r in rows if r["rec_table"] == table} == want
    kinds = {(r["rec_table"], r["rec_key"], k) for r in rows for k in r["kinds"]}
    assert kinds == {tuple(r) for r in QUERIES["p3_found"](spark, SF).collect()}
