import os

import pytest

from corpusloom.plans.catalogue import ORACLE, QUERIES

from .compare import duck, same_rows

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def tables():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tables, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE:
        same_rows(df, tables.sql(ORACLE[name]))
    else:
        assert df.count() > 0


def plan(df):
    return df._jdf.queryExecution().toString()


def test_no_cartesian_products_and_pruned_scans(spark):
    for name in ("bm25_topk", "hybrid_search_top5", "chunk_records", "qa_pairs", "vector_topk", "rrf_fusion"):
        text = plan(QUERIES[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name
    scan = [line for line in plan(QUERIES["bm25_tokens"](spark, SF)).splitlines() if "ReadSchema" in line][-1]
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in scan and "IsNotNull(text)" in scan


def reads(spark, name):
    """Columns that the scans of a query read."""
    import re

    return {c for schema in re.findall(r"ReadSchema: struct<(.*)>", QUERIES[name](spark, SF)._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))) for c in re.findall(r"(?:^|,)(\w+):", schema)}


def test_first_rows_read_key_order_and_text_only(spark):
    assert reads(spark, "chunk_text_clean") <= {"chunk_id", "chunk_ord", "chunked_at", "text", "_tmp_metadata_row_index", "_key", "_first"} | {"file_path", "row_index"}
    assert "Sort" not in plan(QUERIES["chunk_text_clean"](spark, SF)).split("== Physical Plan ==")[1]


LARGE = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(LARGE), reason="no test tables")
@pytest.mark.parametrize("partitions", [4, 8])
def test_numbering_at_scale(spark, partitions):
    """Numbers over more rows than one sample of range bounds holds."""
    tables = duck(LARGE)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in ("index_metadata", "qa_sample_allocation", "qa_pairs", "qa_inputs", "qa_synthesis_inputs", "qa_dataset_union"):
            same_rows(QUERIES[name](spark, LARGE), tables.sql(ORACLE[name]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_top_k_stops_early(spark):
    assert "WindowGroupLimit" in plan(QUERIES["bm25_topk"](spark, SF))


def test_entry_is_stable(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["query_id", "doc", "arxiv_id", "section", "score", "rank"] and df.count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_cosine_contrast_compares_labels(spark, tmp_path):
    rows = [(1, "a", [1.0, 0.0]), (2, "a", [1.0, 0.2]), (3, "b", [0.0, 1.0]), (4, "b", [1.0, 0.1]), (5, "b", [0.1, 1.0]), (6, None, [1.0, 1.0])]
    spark.createDataFrame(rows, "vec_id long, label string, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["vec_id"]: r["is_nearer"] for r in QUERIES["cosine_contrast"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True}
