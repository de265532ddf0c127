"""Rank fusion, reranking and section-aware de-duplication of search results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SETTINGS, Settings
from ..functions.text import lexical_tokens, score_distance, words
from . import bm25, vector


def fuse_ranks(rankings: list[DataFrame], k: int = 60, limit: int | None = None) -> DataFrame:
    """(query_id, doc, rrf, rank) by reciprocal rank fusion of (query_id, doc, rank) tables.

    A union and one aggregate rather than full outer joins. The rankings of one query lie in one
    partition each, which the engine may take for a partitioning of their union; the few rows are
    placed anew, so that what follows doesn't rest on it. Ties go to the lesser document.
    """
    union = rankings[0].select("query_id", "doc", "rank")
    for r in rankings[1:]:
        union = union.unionByName(r.select("query_id", "doc", "rank"))
    scored = union.repartition("query_id", "doc").groupBy("query_id", "doc").agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("rrf"))
    order = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), "doc")
    ranked = scored.withColumn("rank", F.row_number().over(order))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def lexical_overlap(question: Column, text: Column) -> Column:
    """Stand-in for a cross-encoder: the share of the question's distinct tokens in the text."""
    q = F.array_distinct(lexical_tokens(question))
    hits = F.size(F.array_intersect(q, lexical_tokens(text)))
    return F.coalesce(F.try_divide(hits.cast("double"), F.size(q).cast("double")), F.lit(0.0))


def rerank(
    candidates: DataFrame, queries: DataFrame, corpus: DataFrame, text: str, scorer: Callable[[Column, Column], Column] = lexical_overlap, n_words: int = 200
) -> DataFrame:
    """(query_id, doc, score, rank): candidates by a scorer of (question, first words of the text).

    Candidates that aren't in the corpus fall out. ``scorer`` may be a built-in expression or a
    pandas UDF of a model. Ties keep the order of the candidates.
    """
    found = candidates.join(corpus.select("doc", F.array_join(F.slice(words(F.col(text)), 1, n_words), " ").alias("head")), "doc")
    scored = found.join(F.broadcast(queries.select("query_id", "question")), "query_id")
    scored = scored.select("query_id", "doc", F.col("rank").alias("old"), F.round(scorer(F.col("question"), F.col("head")), 9).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "old")
    return scored.withColumn("rank", F.row_number().over(order)).drop("old")


def best_per_group(ranked: DataFrame, corpus: DataFrame, groups: list[str], k: int) -> DataFrame:
    """The best document of each (query, group), re-ranked, ``k`` a query.

    Groups are ``["arxiv_id", "section"]``, or ``["arxiv_id"]`` for one result a paper; null
    values form a group of their own.
    """
    placed = ranked.join(corpus.select("doc", *groups), "doc")
    first = placed.groupBy("query_id", *groups).agg(F.min_by(F.struct("doc", *[c for c in ranked.columns if c not in ("query_id", "doc", "rank")]), "rank").alias("x"), F.min("rank").alias("old"))
    order = Window.partitionBy("query_id").orderBy("old")
    kept = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return kept.select("query_id", F.col("x.doc").alias("doc"), *groups, *[F.col(f"x.{c}").alias(c) for c in ranked.columns if c not in ("query_id", "doc", "rank")], "rank")


def search(
    index: bm25.Index,
    corpus: DataFrame,
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 5,
    settings: Settings = SETTINGS,
    mode: str = "hybrid",
    scorer: Callable[[Column, Column], Column] | None = None,
    dedup: str = "section",
) -> DataFrame:
    """(query_id, doc, arxiv_id, section, score, rank) of a batch of queries.

    ``corpus`` has doc, text, arxiv_id and section, ``vectors`` doc and embedding, ``queries``
    query_id, question and embedding. ``mode`` is dense, lexical or hybrid; without a ``scorer``
    the fused score decides; ``dedup`` is section, paper or none.
    """
    fetch = k * settings.fetch_factor
    rankings = []
    if mode in ("dense", "hybrid"):
        rankings.append(vector.top_k(queries, vectors, fetch, key="doc"))
    if mode in ("lexical", "hybrid"):
        rankings.append(bm25.search(index, queries, fetch, settings.bm25_k1, settings.bm25_b))
    fused = fuse_ranks(rankings, settings.rrf_k, fetch).withColumnRenamed("rrf", "score")
    if scorer is not None:
        fused = rerank(fused, queries, corpus, "text", scorer, settings.rerank_words)
    groups = {"section": ["arxiv_id", "section"], "paper": ["arxiv_id"], "none": ["doc"]}[dedup]
    if dedup == "none":
        out = fused.where(F.col("rank") <= k).join(corpus.select("doc", "arxiv_id", "section"), "doc")
        return out.select("query_id", "doc", "arxiv_id", "section", "score", "rank")
    best = best_per_group(fused, corpus, groups, k)
    if dedup == "paper":
        best = best.join(corpus.select("doc", "section"), "doc")
    return best.select("query_id", "doc", "arxiv_id", "section", "score", "rank")


def with_distance(results: DataFrame, score: str = "score") -> DataFrame:
    """Adds distance and relevance in percent of a reranked result."""
    d = score_distance(F.col(score))
    return results.withColumn("distance", d).withColumn("relevance", F.greatest(F.lit(0.0), (1 - d) * 100))
