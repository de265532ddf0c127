"""Texts cut off before their end: strict prefixes of longer copies, and broken endings."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .endings import CLOSED, breaks_off

#: Characters that two texts must share at their start to be compared whole.
PREFIX_CHARS = 64
#: Characters of texts that one sorted range holds, about.
RANGE_CHARS = 64 << 20
#: Characters of the longer copy that are kept from where the shorter one ends.
REST_CHARS = 16

#: What stands after a break besides full stops and white space, as in ``endings.MARK``.
_MARK = r"(?iU)(?:&#?\w{0,8}|\[(?:\.\.\.|…|truncated|cut|more)\]|\((?:truncated|cut|more|continued)\))\z"
_TRIMMED = " \t\r\n.\u2026\ufffd\u200b"
#: Characters that may close a line or sentence sort behind all others, in exchange for noncharacters.
_CLOSING = "\n\r.!?。！？"
_LAST = "".join(chr(0x10FFF0 + i) for i in range(len(_CLOSING)))
_SWAP = str.maketrans(_CLOSING + _LAST, _LAST + _CLOSING)

LINE_ENDS = re.compile(r"[ \t]*[\r\n]")
STOPS = re.compile(r"[!?。！？؟।]|\.(?![\da-zà-ÿ])")


def goes_on(body: str, rest: str, stopped: bool = False, chars: int = PREFIX_CHARS) -> bool:
    """Whether a text that ends with ``body`` breaks off where its longer copy goes on with ``rest``.

    It does inside a word, and inside a line whose sentence isn't closed there. ``stopped``: the
    text has a full stop of its own. A body of less than ``chars`` characters must break off
    inside a word: whole titles and names often open other texts.
    """
    if not rest:
        return False
    if rest[0].isalnum() and body[-1].isalnum() or re.match(r"\.\d", rest) and body[-1].isdigit():
        return True
    if len(body) < chars or stopped or LINE_ENDS.match(rest):
        return False
    return not (STOPS.match(rest) or CLOSED.search(body))


def longer_copies(df: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", chars: int = PREFIX_CHARS) -> DataFrame:
    """(key, goes_on): the rows whose text, without a mark after the break, starts a longer text.

    ``goes_on`` is what :func:`goes_on` says of that place. A prefix of some text is in sorted
    order a prefix of the next different text as well, so it is enough to compare neighbours; as
    characters that close a line or sentence sort last, the next text is one that goes on without
    them if there is any. Texts whose first ``chars`` characters occur in several different texts
    are sorted whole, of the others as much as shorter texts need. They are sorted over range
    partitions, so a start shared by a third of all rows spreads over many tasks, and the last row
    of each partition meets the first of the next one in a window of two rows a partition.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    # Cutting single characters from the end, full stops among them, is cheap and changes no
    # relation; a pattern reads the last characters only.
    body = F.rtrim(F.col(text), F.lit(_TRIMMED))
    tail = F.regexp_replace(F.right(F.col("body"), F.lit(REST_CHARS)), _MARK, "")
    rows = (
        df.where(F.col(key).isNotNull())
        .select(F.col(key).alias("key"), body.alias("body"), F.right(F.rtrim(F.col(text), F.lit(" \t\r\n\u200b")), F.lit(2)).rlike(r"[^.]\.$").alias("stopped"))
        .select("key", "stopped", F.rtrim(F.concat(F.expr(f"left(body, length(body) - {REST_CHARS})"), tail), F.lit(_TRIMMED)).alias("body"))
        .where("body <> ''")
    )
    head = F.when(F.length("body") >= chars, F.xxhash64(F.substring("body", 1, chars)))
    hashed = scratch.table(rows.select("key", "stopped", head.alias("head"), F.xxhash64("body").alias("whole"), F.length("body").alias("chars")))
    shared = (
        hashed.where("head is not null").groupBy("head").agg(F.min("whole").alias("lo"), F.max("whole").alias("hi")).where("lo <> hi").select("head")
    )
    near = scratch.table(hashed.join(shared, "head", "left_semi").groupBy("whole").agg(F.min("key").alias("key")))
    some = rows.join(near.select("key"), "key", "left_semi").select("body")
    others = rows.select(head.alias("head"), F.substring("body", 1, chars + REST_CHARS).alias("body")).join(scratch.table(shared), "head", "left_anti").select("body")
    texts = some.unionByName(others).distinct().select(F.xxhash64("body").alias("whole"), F.translate("body", _CLOSING + _LAST, _LAST + _CLOSING).alias("body"))
    chars_in_all = hashed.agg(F.sum("chars")).first()[0] or 0
    parts = max(spark.sparkContext.defaultParallelism, -(-chars_in_all // RANGE_CHARS))
    names = ["whole", "body", "rest", "edge"]

    def neighbours(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: tuple | None = None
        for f in frames:
            out = []
            for row in zip(f["whole"], f["body"]):
                if last is None:
                    out.append((*row, None, "head"))
                elif row[1].startswith(last[1]):
                    out.append((*last, row[1][len(last[1]) :][:REST_CHARS], None))
                last = row
            yield pd.DataFrame(out, columns=names)
        if last is not None:
            yield pd.DataFrame([(*last, None, "tail")], columns=names)

    found = scratch.table(
        texts.repartitionByRange(parts, "body").sortWithinPartitions("body").mapInPandas(neighbours, "whole bigint, body string, rest string, edge string")
    )
    following = F.lead("body").over(Window.orderBy("body", "edge"))
    across = (
        found.where("edge is not null")
        .withColumn("longer", following)
        .where("edge = 'tail' and startswith(longer, body)")
        .select("whole", "body", F.expr(f"substring(longer, length(body) + 1, {REST_CHARS})").alias("rest"))
    )
    pairs = found.where("rest is not null").select("whole", "body", "rest").unionByName(across)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f["goes_on"] = [goes_on(b.translate(_SWAP), r.translate(_SWAP), s, chars) for b, r, s in zip(f["body"], f["rest"], f["stopped"])]
            yield f[["key", "goes_on"]]

    judged = hashed.select("key", "stopped", "whole").join(pairs, "whole").select("key", "stopped", "body", "rest").mapInPandas(judge, f"key {kind}, goes_on boolean")
    return judged.groupBy(F.col("key").alias(key)).agg(F.max("goes_on").alias("goes_on"))


def truncated(df: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, how): the rows whose text breaks off inside a word or a sentence.

    ``how`` is ``prefix`` if the text is a strict prefix of a longer one, which goes on within a
    word or (texts of at least PREFIX_CHARS characters only) within a line and sentence, ``mark`` if a mark or damage follows the break, ``open`` if the last block
    just ends. Without a longer copy a text that ends with a title, list, slide line, table, code, formula, address,
    name or reference is whole, as is one that closes its sentence, though longer copies may go
    on. Null, empty and blank texts, and null keys, are no cases. Rows that repeat a key count
    once. Other columns are not read. An empty table gives no rows.
    """
    kinds = [df.schema[c].dataType.simpleString() for c in (key, source)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            how = [breaks_off(t.as_py()) for t in b.column(2)]
            at = pa.array([i for i, h in enumerate(how) if h], pa.int64())
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(1).take(at), pa.array([h for h in how if h])], names=[key, source, "how"]
                )

    rows = df.select(key, source, text).where(F.col(key).isNotNull() & F.col(text).isNotNull())
    broken = rows.mapInArrow(run, f"`{key}` {kinds[0]}, `{source}` {kinds[1]}, how string")
    cut = longer_copies(rows, scratch, key, text).where("goes_on")
    copies = df.select(key, source).join(cut, key).select(key, source, F.lit("prefix").alias("how"))
    return broken.unionByName(copies).groupBy(key).agg(F.min(source).alias(source), F.max("how").alias("how"))


def truncation_rates(df: DataFrame, found: DataFrame, source: str = "source") -> DataFrame:
    """(source, documents, truncated, share) for each source, null among them."""
    whole = df.groupBy(source).agg(F.count("*").alias("documents"))
    cut = found.groupBy(source).agg(F.count("*").alias("truncated"))
    joined = whole.join(cut, whole[source].eqNullSafe(cut[source]), "left").select(whole[source], "documents", "truncated")
    return joined.select(
        source, "documents", F.coalesce("truncated", F.lit(0)).alias("truncated"),
        (F.coalesce("truncated", F.lit(0)) / F.col("documents")).alias("share"),
    )
