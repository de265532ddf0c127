"""The engine behind one object: validated batches of questions, prompts, answers, health."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import __version__, models
from .config import SETTINGS, Settings
from .functions.text import strip_thinking
from .operators import bm25, hybrid, rag
from .runtime import Scratch


class InvalidRequest(ValueError):
    """A question or result count outside what is allowed."""


class ModelUnavailable(ConnectionError):
    """A model gave no answer."""


class ModelTimeout(TimeoutError):
    """A model took too long."""


@dataclass(frozen=True)
class Request:
    question: str
    top_k: int = SETTINGS.top_k

    def validated(self, settings: Settings = SETTINGS) -> Request:
        if len(self.question or "") < settings.min_question_chars:
            raise InvalidRequest(f"a question has at least {settings.min_question_chars} characters")
        if not 1 <= self.top_k <= settings.max_top_k:
            raise InvalidRequest(f"top_k is between 1 and {settings.max_top_k}")
        return self


@dataclass(frozen=True)
class Found:
    """A batch of questions (query_id, question, embedding) with its results."""

    queries: DataFrame
    results: DataFrame


class Engine:
    """Search over one corpus.

    ``corpus`` has doc, text, arxiv_id, section and title, ``vectors`` doc and embedding. ``index``
    is one that was stored and opened before; without it one is built in the shared folder when
    the engine is made. An engine keeps nothing of a batch, so callers don't meet.
    """

    def __init__(
        self, spark: SparkSession, corpus: DataFrame, vectors: DataFrame, embedder: models.Embedder, generator: models.Generator,
        settings: Settings = SETTINGS, index: bm25.Index | None = None,
    ):
        self.spark, self.corpus, self.vectors = spark, corpus, vectors
        self.embedder, self.generator, self.settings = embedder, generator, settings
        self.index = index or bm25.build_index(corpus, "doc", "text", Scratch(spark, "index").path(), settings.bm25_epsilon)

    @classmethod
    def open(cls, spark: SparkSession, path: str, embedder: models.Embedder, generator: models.Generator, settings: Settings = SETTINGS) -> Engine:
        """An engine over what ``jobs.index`` stored at ``path``: nothing is computed before the first question."""
        corpus, vectors = spark.read.parquet(f"{path}/corpus"), spark.read.parquet(f"{path}/vectors")
        return cls(spark, corpus, vectors, embedder, generator, settings, bm25.open_index(spark, f"{path}/bm25"))

    def search(self, questions: list[str], top_k: int | None = None, **how) -> Found:
        k = self.settings.top_k if top_k is None else top_k
        for q in questions:
            Request(q, k).validated(self.settings)
        vectors = self.embedder(questions)
        rows = [(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(questions, vectors))]
        return self.search_table(self.spark.createDataFrame(rows, "query_id int, question string, embedding array<float>"), k, **how)

    def search_table(self, queries: DataFrame, top_k: int | None = None, **how) -> Found:
        """The same for a table (query_id, question, embedding) of any size."""
        k = self.settings.top_k if top_k is None else top_k
        return Found(queries, hybrid.search(self.index, self.corpus, self.vectors, queries, k, self.settings, **how))

    def answers(self, found: Found, keep: list[str] | None = None) -> DataFrame:
        """(query_id, raw, error, seconds) of the generator for each query that found anything."""
        asked = rag.prompts(found.results, self.corpus, found.queries)
        return models.generate(asked, "query_id", "prompt", self.generator, rag.INSTRUCTION, keep=keep, traced=True)

    def query(self, question: str, top_k: int | None = None, **how) -> dict:
        """The answer to one question with its sources and the seconds it took."""
        began = time.time()
        found = self.search([question], top_k, **how)
        row = self.answers(found).select(strip_thinking(F.col("raw")).alias("answer"), "error").first()
        if row is not None and row["error"] == "timeout":
            raise ModelTimeout("the generator took too long")
        if row is not None and row["answer"] is None:
            raise ModelUnavailable("the generator gave no answer")
        sources = rag.sources(found.results, self.corpus).orderBy("pos")
        return {
            "query": question,
            "answer": row["answer"] if row else "",
            "sources": [r.asDict() for r in sources.collect()],  # at most top_k
            "seconds": round(time.time() - began, 2),
        }

    def health(self) -> dict:
        """Whether tables and models answer; healthy only if all do."""
        counts = {}
        for name, table in (("vectors", self.vectors), ("documents", self.corpus)):
            try:
                counts[name] = table.count()
            except Exception:
                counts[name] = 0
        up = {"embedder": models.is_ready(self.embedder, ["ready"]), "generator": models.is_ready(self.generator, "ready", "", 0.0)}
        return {"status": "healthy" if all(counts.values()) and all(up.values()) else "degraded", **up, **counts, "version": __version__}
