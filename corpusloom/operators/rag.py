"""Prompts and sources of a batch of answered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Our wording; what is fixed is the slots and their order.
INSTRUCTION = "You answer research questions from the passages below only. Name the paper behind each point, and say so when the passages are not enough."
PROMPT = ("Passages:\n\n", "\n\n----\n\nQuestion: ", "\n\nGive an answer that rests on the passages alone.")


def context(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, context): the results of each query by rank, numbered from 1, in one text."""
    rows = results.select("query_id", "doc", "rank").join(corpus.select("doc", "title", "section", "text"), "doc")
    part = F.concat(
        F.lit("["), F.col("rank").cast("string"), F.lit("] Paper: "), F.coalesce("title", F.lit("")),
        F.lit("\n    Section: "), F.coalesce("section", F.lit("")), F.lit("\n    Content: "), F.coalesce("text", F.lit("")), F.lit("\n"),
    )
    grouped = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))).alias("parts"))
    return grouped.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n").alias("context"))


def prompts(results: DataFrame, corpus: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, prompt): the context and question in the template."""
    asked = context(results, corpus).join(queries.select("query_id", "question"), "query_id")
    return asked.select("query_id", F.concat(F.lit(PROMPT[0]), "context", F.lit(PROMPT[1]), "question", F.lit(PROMPT[2])).alias("prompt"))


def sources(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, pos, arxiv_id, section, title): each source once, in the order of its best result."""
    rows = results.select("query_id", "doc", "rank").join(corpus.select("doc", "arxiv_id", "section", "title"), "doc")
    first = rows.groupBy("query_id", "arxiv_id", "section").agg(F.min("rank").alias("rank"), F.min_by("title", "rank").alias("title"))
    listed = first.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "arxiv_id", "section", "title"))).alias("s"))
    out = listed.select("query_id", F.posexplode("s").alias("pos", "x"))
    return out.select("query_id", (F.col("pos") + 1).alias("pos"), "x.arxiv_id", "x.section", "x.title")


def with_directive(prompt, thinking: bool = False):
    """The prompt for a model that would think aloud otherwise."""
    return prompt if thinking else F.concat(F.lit("/no_think\n"), prompt)
