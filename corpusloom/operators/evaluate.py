"""Retrieval and answer metrics, and the report they go into."""

from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions.text import strip_thinking, word_count
from . import rag

if TYPE_CHECKING:
    from ..api import Engine


def retrieval_scores(results: DataFrame, relevant: Column) -> DataFrame:
    """(query_id, hit, rr, precision) of ranked results; precision counts repeats of a paper."""
    rel = F.coalesce(relevant, F.lit(False))
    per = results.groupBy("query_id").agg(F.min(F.when(rel, F.col("rank"))).alias("first"), F.avg(rel.cast("double")).alias("precision"))
    return per.select("query_id", F.col("first").isNotNull().alias("hit"), F.coalesce(F.lit(1.0) / F.col("first"), F.lit(0.0)).alias("rr"), "precision")


def retrieval_metrics(scores: DataFrame) -> DataFrame:
    """One row: hit_rate, mrr, avg_precision, total_questions; rates are null without questions."""
    return scores.agg(
        F.round(F.avg(F.col("hit").cast("double")), 6).alias("hit_rate"),
        F.round(F.avg("rr"), 6).alias("mrr"),
        F.round(F.avg("precision"), 6).alias("avg_precision"),
        F.count("*").alias("total_questions"),
    )


def list_scores(details: DataFrame, found: str = "source_ids", expected: str = "expected_ids") -> DataFrame:
    """(item_id, hit, rr, precision) of stored result lists; an empty list scores 0."""
    ranks = F.transform(found, lambda x, i: F.when(F.array_contains(F.col(expected), x), i + 1))
    good = F.filter(ranks, lambda r: r.isNotNull())
    size = F.size(found)
    return details.select(
        "item_id",
        (F.size(good) > 0).alias("hit"),
        F.coalesce(F.lit(1.0) / F.array_min(good), F.lit(0.0)).alias("rr"),
        F.coalesce(F.try_divide(F.size(good).cast("double"), size.cast("double")), F.lit(0.0)).alias("precision"),
    )


def answer_details(answers: DataFrame, keywords: str = "keywords") -> DataFrame:
    """(item_id, words, found, total, coverage, substantive): keywords as substrings, case ignored.

    A substantive answer has more than 20 words and no "i don't".
    """
    low = F.lower(F.coalesce("answer", F.lit("")))
    n = word_count(F.col("answer"))
    hits = F.size(F.filter(F.col(keywords), lambda k: F.contains(low, F.lower(k))))
    return answers.select(
        "item_id",
        n.alias("words"),
        hits.alias("found"),
        F.size(keywords).alias("total"),
        F.try_divide(hits.cast("double"), F.size(keywords).cast("double")).alias("coverage"),
        ((n > 20) & ~F.contains(low, F.lit("i don't"))).alias("substantive"),
    )


def answer_summary(details: DataFrame, coverage: str, hit: str, substantive: str, n_words: str, latency: str) -> DataFrame:
    """One row of averages, with the total time rounded to two places."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return details.agg(
        rate(coverage).alias("avg_keyword_coverage"),
        rate(hit).alias("source_hit_rate"),
        rate(substantive).alias("substantive_rate"),
        rate(n_words).alias("avg_word_count"),
        rate(latency).alias("avg_latency"),
        F.round(F.sum(latency), 2).alias("total_time"),
        F.count("*").alias("total_questions"),
    )


def evaluate_items(engine: Engine, items: DataFrame, top_k: int = 5, **how) -> DataFrame:
    """One row of details per item (item_id, question, topic, expected_arxiv_ids, expected_keywords).

    Items are searched and answered as one batch; a failed answer counts as an empty one. The
    columns are those :func:`report` reads.
    """
    asked = items.select(F.col("item_id").alias("query_id"), "question")
    vectors = models.embed(asked, "query_id", "question", engine.embedder, engine.settings.embed_batch)
    queries = asked.join(vectors.where(F.col("embedding").isNotNull()).select("query_id", "embedding"), "query_id")
    found = engine.search_table(queries, top_k, **how)
    said = engine.answers(found).select(F.col("query_id").alias("item_id"), F.coalesce(strip_thinking(F.col("raw")), F.lit("")).alias("answer"), F.round("seconds", 2).alias("latency_seconds"))
    listed = rag.sources(found.results, engine.corpus)
    ids = listed.groupBy(F.col("query_id").alias("item_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "arxiv_id"))), lambda x: x["arxiv_id"]).alias("source_ids"))  # top_k of each
    rows = items.join(said, "item_id", "left").join(ids, "item_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
    rows = rows.withColumn("keywords", F.coalesce("expected_keywords", F.array().cast("array<string>")))
    scored = answer_details(rows)
    none = F.array().cast("array<string>")
    own = rows.select(
        "item_id", "question", "topic", "answer", F.coalesce("source_ids", none).alias("source_ids"),
        F.coalesce("expected_arxiv_ids", none).alias("expected_ids"), F.coalesce("latency_seconds", F.lit(0.0)).alias("latency_seconds"),
    )
    return own.join(scored, "item_id").select(
        "item_id", "question", "topic", "answer", F.col("words").alias("answer_word_count"), F.coalesce("coverage", F.lit(0.0)).alias("keyword_coverage"),
        F.col("found").alias("keywords_found"), F.col("total").alias("keywords_total"), F.arrays_overlap("source_ids", "expected_ids").alias("source_hit"),
        "source_ids", "expected_ids", F.col("substantive").alias("is_substantive"), "latency_seconds",
    )


#: Items whose details fit into the one document of a report; more go beside it.
NESTED_ITEMS = 10_000


def report(details: DataFrame, label: str, timestamp: str, top_k: int = 5) -> DataFrame:
    """One row (label, timestamp, config, retrieval, answer): the report on the items of ``details``.

    ``answer`` holds the summary and, for at most NESTED_ITEMS items, the details in order of
    item_id; of more items they are null and belong beside the report.
    """
    n = details.count()
    scores = retrieval_metrics(list_scores(details))
    summary = answer_summary(details, "keyword_coverage", "source_hit", "is_substantive", "answer_word_count", "latency_seconds")
    row = F.struct("item_id", *[c for c in details.columns if c != "item_id"])
    nested = details.agg(F.array_sort(F.collect_list(row)).alias("d")) if n <= NESTED_ITEMS else details.sparkSession.range(1).select(F.lit(None).alias("d"))
    one = lambda df, name: df.select(F.struct(*df.columns).alias(name))
    # Each side is one row, so these joins are no products.
    joined = one(scores, "retrieval").withColumn("_k", F.lit(1)).join(one(summary, "summary").withColumn("_k", F.lit(1)), "_k").join(nested.withColumn("_k", F.lit(1)), "_k")
    config = F.struct(F.lit(top_k).alias("top_k"), F.lit(n).alias("dataset_size"))
    return joined.select(F.lit(label).alias("label"), F.lit(timestamp).alias("timestamp"), config.alias("config"), "retrieval", F.struct("summary", F.col("d").alias("details")).alias("answer"))


def progress(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """(rate per minute, minutes left) of a run; null before the first second or the first item."""
    rate = F.try_divide(done.cast("double") * 60, seconds.cast("double"))
    return rate, F.try_divide((total - done).cast("double"), rate)


def length_stats(df: DataFrame, n: Column, limit: int) -> DataFrame:
    """One row: min, max, mean, how many rows are above the limit and their share in percent."""
    return df.select(n.alias("n")).agg(
        F.min("n").alias("n_min"),
        F.max("n").alias("n_max"),
        F.round(F.avg("n"), 6).alias("n_mean"),
        F.count_if(F.col("n") > limit).alias("n_over"),
        F.round(F.try_divide(F.count_if(F.col("n") > limit) * 100.0, F.count("*").cast("double")), 6).alias("pct_over"),
    )
