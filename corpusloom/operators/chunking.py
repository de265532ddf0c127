"""Overlapping word windows over sections, with quality filters and stable identifiers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EXCLUDED_SECTIONS, SETTINGS, Settings
from ..functions.text import clean_chunk_text, is_quality, strip_references, word_count, words
from ..models import Tokenizer
from ..runtime import spread


def windows(df: DataFrame, keys: list[str], text: str, size: int = 450, overlap: int = 64, min_words: int = 10) -> DataFrame:
    """(keys, idx, total, start, text, n_words): the windows of each text, in order.

    A text of at most ``size`` words is its own single window, as it is. Else a window starts
    every ``size - overlap`` words, the tail included, and those under ``min_words`` are dropped.
    ``idx`` and ``total`` count the windows that are left. The words are split once a text.
    """
    stride = size - overlap
    split = spread(df.select(*keys, F.col(text).alias("_t"))).select(*keys, "_t", word_count(F.col("_t")).alias("_n"))
    split = split.select(*keys, "_t", "_n", F.when(F.col("_n") > size, words(F.col("_t"))).alias("_w"))
    whole = F.struct(F.lit(0).alias("start"), F.col("_t").alias("text"), F.col("_n").alias("n_words"))

    def cut(i: Column) -> Column:
        part = F.slice(F.col("_w"), i * stride + 1, F.lit(size))
        n = F.least(F.lit(size), F.col("_n") - i * stride)
        return F.struct((i * stride).cast("int").alias("start"), F.array_join(part, " ").alias("text"), n.cast("int").alias("n_words"))

    # The words are named a second time, outside the lambda, lest their projection be folded into it.
    steps = F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / stride).cast("int"))
    kept = F.filter(steps, lambda i: F.col("_n") - i * stride >= min_words)
    many = F.transform(kept, cut)
    made = split.select(*keys, F.when(F.col("_n") <= size, F.array(whole)).otherwise(many).alias("_x"))
    # An outer explode, as a plain one has all of the above computed again in a filter for empty arrays.
    rows = made.select(*keys, F.size("_x").alias("total"), F.posexplode_outer("_x").alias("idx", "_y")).where("idx is not null")
    return rows.select(*keys, "idx", "total", F.col("_y.start").alias("start"), F.col("_y.text").alias("text"), F.col("_y.n_words").alias("n_words"))


def token_windows(df: DataFrame, keys: list[str], text: str, tokenizer: Tokenizer, size: int = 450, overlap: int = 64, min_words: int = 10) -> DataFrame:
    """The same as :func:`windows`, but measured in tokens of ``tokenizer``.

    A text of at most ``size`` tokens is its own single window; else each window is decoded and
    stripped, and those under ``min_words`` words are dropped. ``start`` counts tokens. A null
    text gives no rows.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    schema = ", ".join([*filter(None, [fields]), "idx int, total int, start int, text string, n_words int"])

    def cut(value: str) -> list[tuple[int, str]]:
        ids = tokenizer.encode(value)
        if len(ids) <= size:
            return [(0, value)]
        made = ((i, tokenizer.decode(ids[i : i + size]).strip()) for i in range(0, len(ids), size - overlap))
        return [(i, t) for i, t in made if len(t.split()) >= min_words]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for *own, value in f.itertuples(index=False, name=None):
                found = cut(value)
                rows += [(*own, n, len(found), at, t, len(t.split())) for n, (at, t) in enumerate(found)]
            yield pd.DataFrame(rows, columns=[*keys, "idx", "total", "start", "text", "n_words"])

    return spread(df.where(F.col(text).isNotNull()).select(*keys, F.col(text).alias("_t"))).mapInPandas(run, schema)


def chunk_id(paper: Column, section: Column, index: Column) -> Column:
    return F.substring(F.md5(F.concat_ws(":", paper, section, index.cast("string")).cast("binary")), 1, 12)


def content_sections(parsed: DataFrame) -> DataFrame:
    """(arxiv_id, section, body): a paper's sections, or its text before the references.

    The text is taken where a paper has no sections or one called ``full_text``. Reference-like
    and empty sections are left out.
    """
    bare = F.col("sections").isNull() | (F.size("sections") == 0) | F.map_contains_key("sections", "full_text")
    text = F.array(F.struct(F.lit("full_text").alias("key"), strip_references(F.coalesce("full_text", F.lit(""))).alias("value")))
    rows = parsed.select("arxiv_id", F.explode_outer(F.when(bare, text).otherwise(F.map_entries("sections"))).alias("s"))
    return rows.select("arxiv_id", F.col("s.key").alias("section"), F.col("s.value").alias("body")).where(
        ~F.lower("section").isin(*EXCLUDED_SECTIONS) & (F.coalesce("body", F.lit("")) != "")
    )


def chunk_sections(sections: DataFrame, settings: Settings = SETTINGS, tokenizer: Tokenizer | None = None) -> DataFrame:
    """(arxiv_id, section, chunk_index, total_in_section, chunk_id, text, n_words).

    Sections are cleaned, short ones dropped, cut into windows, and windows of low quality left
    out; indexes and totals count the windows before that, so they have gaps. With a
    ``tokenizer`` windows are measured in its tokens, else in words.
    """
    # Out of a generator, as a filter on a projection is pushed below it and cleans every text twice.
    once = F.explode_outer(F.array(clean_chunk_text(F.col("body"))))
    cleaned = spread(sections).select("arxiv_id", "section", once.alias("body"))
    kept = cleaned.where(word_count(F.col("body")) >= settings.min_section_words)
    sizes = (settings.chunk_size, settings.chunk_overlap, settings.min_window_words)
    keys = ["arxiv_id", "section"]
    cut = token_windows(kept, keys, "body", tokenizer, *sizes) if tokenizer else windows(kept, keys, "body", *sizes)
    good = cut.where(is_quality(F.col("text"), settings.min_chunk_words, settings.min_alpha_share))
    return good.select(
        "arxiv_id",
        "section",
        F.col("idx").alias("chunk_index"),
        F.col("total").alias("total_in_section"),
        chunk_id(F.col("arxiv_id"), F.col("section"), F.col("idx")).alias("chunk_id"),
        "text",
        "n_words",
    )


def chunk_papers(parsed: DataFrame, settings: Settings = SETTINGS, tokenizer: Tokenizer | None = None) -> DataFrame:
    return chunk_sections(content_sections(parsed), settings, tokenizer)
