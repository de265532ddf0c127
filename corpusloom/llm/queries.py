"""Queries of this package over the tables of a folder, and SQL for those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, read_table
from . import bpe, defects, leakage, markup, mixing, neardup, pieces, splits, truncation


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_duplicate_groups(read_table(spark, sf_dir, "chunks"), Scratch(spark, "p1"), width=3, similarity=0.5)
    return neardup.group_pairs(groups)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.paper_groups(read_table(spark, sf_dir, "qa_dataset"), Scratch(spark, "p2"))


def p2_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "p2")
    samples = read_table(spark, sf_dir, "qa_dataset")
    groups = splits.paper_groups(samples, scratch)
    whole = samples.select("qa_id").where("qa_id is not null").distinct().join(groups, "qa_id", "left")
    return splits.split_groups(scratch.table(whole), scratch)


def _marked_up(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    return [
        ("chunks", read_table(spark, sf_dir, "chunks"), "chunk_id", "text"),
        ("papers_parsed", read_table(spark, sf_dir, "papers_parsed"), "arxiv_id", "full_text"),
    ]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.record_kinds(_marked_up(spark, sf_dir))


def p3_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.clean_records(_marked_up(spark, sf_dir), Scratch(spark, "p3"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, sf_dir, "qa_dataset"), read_table(spark, sf_dir, "eval_details"))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(read_table(spark, sf_dir, "chunks"), Scratch(spark, "p5"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece_no = 1").select("chunk_id").distinct()


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects.broken_pairs(read_table(spark, sf_dir, "qa_dataset"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_column(read_table(spark, sf_dir, "documents"))


def _mix(spark: SparkSession, sf_dir: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    targets = read_table(spark, sf_dir, "mix_targets")
    counted = bpe.count_tokens(read_table(spark, sf_dir, "documents").where("source is not null").select("doc_id", "source", "text"))
    return mixing.mix_sources(counted, targets, scratch), targets


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, Scratch(spark, "p8"))[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.share_report(*_mix(spark, sf_dir, Scratch(spark, "p8")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.truncated(read_table(spark, sf_dir, "documents"), Scratch(spark, "p9")).select("doc_id")


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents")
    return truncation.truncation_rates(documents, truncation.truncated(documents, Scratch(spark, "p9")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_split": p2_split,
    "p3_found": p3_found,
    "p3_clean": p3_clean,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
}

#: The code points Python counts as white space.
_SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

ORACLE: dict[str, str] = {
    "p2_found": r"""
        WITH RECURSIVE named AS (
            SELECT DISTINCT qa_id, unnest(regexp_extract_all(source_arxiv_id, '[0-9]{4}\.[0-9]{5}')) AS paper FROM qa_dataset
        ), reach(a, b) AS (
            SELECT DISTINCT paper, paper FROM named
            UNION
            SELECT r.a, y.paper FROM reach r JOIN named x ON x.paper = r.b JOIN named y ON y.qa_id = x.qa_id
        )
        SELECT n.qa_id, min(r.b) AS group_id FROM named n JOIN reach r ON r.a = n.paper GROUP BY n.qa_id
    """,
    "p4_found": r"""
        WITH texts AS (
            SELECT DISTINCT qa_id, unnest([input, output]) AS t FROM qa_dataset
        ), words AS (
            SELECT qa_id, ' ' || array_to_string(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), ' ') || ' ' AS w
            FROM texts WHERE t IS NOT NULL
        ), items AS (
            SELECT item_id, regexp_extract_all(lower(question), '[\p{L}\p{N}]+') AS q FROM eval_details WHERE question IS NOT NULL
        ), probes AS (
            SELECT DISTINCT item_id, ' ' || array_to_string(list_slice(q, i, i + least(8, len(q)) - 1), ' ') || ' ' AS p
            FROM items, unnest(generate_series(1, greatest(len(q) - 7, 1))) AS s(i) WHERE len(q) > 0
        )
        SELECT DISTINCT w.qa_id, p.item_id FROM words w JOIN probes p ON contains(w.w, p.p)
    """,
    "p5_found": rf"""
        SELECT DISTINCT chunk_id FROM chunks WHERE len(regexp_extract_all(text, '[^{_SPACE}]+')) > 450
    """,
}
