"""Schemas of the engine's tables and of the JSON envelopes it reads."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "papers": "arxiv_id STRING, title STRING, abstract STRING, authors ARRAY<STRING>, published STRING, updated STRING, categories ARRAY<STRING>, "
    "pdf_url STRING, primary_category STRING, query_source STRING, local_pdf_path STRING",
    "parsed": "arxiv_id STRING, title STRING, abstract STRING, authors ARRAY<STRING>, published STRING, categories ARRAY<STRING>, "
    "sections MAP<STRING, STRING>, full_text STRING, char_count INT, word_count INT",
    "chunks": "chunk_id STRING, arxiv_id STRING, title STRING, section STRING, text STRING, word_count INT, metadata STRUCT<authors: ARRAY<STRING>, "
    "published: STRING, categories: ARRAY<STRING>, chunk_index: INT, total_chunks_in_section: INT>",
    "qa": "type STRING, instruction STRING, input STRING, output STRING, source_arxiv_id STRING",
    "eval_items": "question STRING, expected_arxiv_ids ARRAY<STRING>, expected_keywords ARRAY<STRING>, topic STRING",
    "vectors": "id STRING, embedding ARRAY<FLOAT>, document STRING, metadata STRUCT<arxiv_id: STRING, title: STRING, section: STRING, word_count: INT, authors: STRING, published: STRING>",
}
def schema(name: str) -> StructType:
    """The schema of a table; needs a running session."""
    return StructType.fromDDL(_DDL[name])


#: The field of an envelope that holds its rows.
ROWS_FIELD = {"papers": "papers", "parsed": "papers", "chunks": "chunks", "qa": "data"}
