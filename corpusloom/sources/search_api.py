"""A batch source that runs search queries against a paper API, one partition each.

    spark.dataSource.register(PaperSearchSource)
    spark.read.format("paper_search").option("queries", json.dumps([...])).option("client", "package.module:function").load()

The client is a function (query, max_results) -> list of dicts of the schema's fields. What it
gave before an error is kept.
"""

from __future__ import annotations

import importlib
import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = (
    "arxiv_id string, title string, abstract string, authors array<string>, published string, updated string, "
    "categories array<string>, pdf_url string, primary_category string, query_source string"
)
FIELDS = [part.strip().split(" ")[0] for part in SCHEMA.split(",")]


class PaperSearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paper_search"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Query(InputPartition):
    def __init__(self, query: str):
        self.query = query


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.queries = json.loads(options["queries"])
        self.client = options["client"]
        self.most = int(options.get("max_results", 15))
        self.retries = int(options.get("retries", 5))
        self.wait = float(options.get("wait_seconds", 5))

    def partitions(self) -> list[InputPartition]:
        return [_Query(q) for q in self.queries]

    def read(self, partition: _Query) -> Iterator[tuple]:
        module, _, function = self.client.partition(":")
        search = getattr(importlib.import_module(module), function)
        rows: list[dict] = []
        for attempt in range(self.retries + 1):
            try:
                rows = list(search(partition.query, self.most))
                break
            except Exception:
                if attempt == self.retries:
                    break
                time.sleep(self.wait)
        for r in rows:
            r = {**r, "query_source": partition.query}
            if not r.get("arxiv_id") and r.get("entry_id"):
                r["arxiv_id"] = r["entry_id"].split("/")[-1]
            yield tuple(r.get(f) for f in FIELDS)
