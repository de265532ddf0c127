"""Collection of paper records: de-duplication, resuming, usable files, counters."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import models
from ..functions.text import clean_text, strip, word_count
from ..runtime import Scratch
from . import sections

#: Rows that one range of a distributed row number holds, about.
ROWS_PER_RANGE = 1_000_000
#: Repeated keys that are sent to every executor, of some 100 bytes each.
SENT_KEYS = 200_000


def keep_first(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by ``order``, which should be total.

    An aggregate with a map-side part, so repeats meet in the mappers and a hot key costs no sort.
    All columns travel with their row, so tables with long texts take :func:`first_rows` instead.
    """
    keys = [key] if isinstance(key, str) else key
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*df.columns)


def first_rows(stored: DataFrame, key: str, order: list[Column], columns: list[str], scratch: Scratch) -> DataFrame:
    """(columns) of the first row of each key of a stored table, null keys counted as one key.

    Only the keys and their order are shuffled: a row is named by its place in its file, the
    winners among repeated keys are found from those, and other rows of such keys are filtered
    out of the scan. Rows that tie in ``order`` are told apart by their place. Repeated keys are
    broadcast up to :data:`SENT_KEYS` and joined by a hash table of theirs beyond, so no long
    column is sorted either way.
    """
    place = F.struct(*order, F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("_at")
    small = stored.select(F.col(key).alias("_key"), place)
    repeated = small.groupBy("_key").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("_key", "_first")
    repeated, n = scratch.counted(repeated)
    whole = stored.select(*columns, F.col(key).alias("_own"), place)
    if not n:
        return whole.select(*columns)
    side = F.broadcast(repeated) if n <= SENT_KEYS else repeated.hint("shuffle_hash")
    joined = whole.join(side, F.col("_own").eqNullSafe(F.col("_key")), "left")
    return joined.where(F.col("_first").isNull() | (F.col("_first") == F.col("_at"))).select(*columns)


def distinct_rows(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df.distinct()`` without a shuffle of rows that aren't repeated, for rows with long texts.

    Hashes are counted first; only rows whose hash occurs more than once are compared whole. The
    repeated hashes are broadcast up to :data:`SENT_KEYS` and joined by a hash table beyond.
    ``df`` must give the same rows when it is read again.
    """
    whole = df.withColumn("_row_hash", F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]))
    repeated, n = scratch.counted(whole.groupBy("_row_hash").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col("_row_hash").alias("_repeated")))
    if not n:
        return df
    side = F.broadcast(repeated) if n <= SENT_KEYS else repeated.hint("shuffle_hash")
    same = F.col("_row_hash") == F.col("_repeated")
    some = whole.join(side, same, "left_semi").drop("_row_hash").distinct()
    return whole.join(side, same, "left_anti").drop("_row_hash").unionByName(some)


def resume_union(existing: DataFrame, found: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """What exists, and of what was found the first of each key that doesn't exist yet."""
    new = keep_first(found, key, order).join(existing.select(key), key, "left_anti")
    return existing.unionByName(new)


def usable_papers(papers: DataFrame, texts: DataFrame) -> DataFrame:
    """Papers with a file path whose extraction gave a text: (arxiv_id, local_pdf_path)."""
    with_path = papers.where(F.col("local_pdf_path").isNotNull() & (F.col("local_pdf_path") != ""))
    extracted = texts.where(F.col("full_text").isNotNull() & (F.col("full_text") != "")).select("arxiv_id")
    return with_path.select("arxiv_id", "local_pdf_path").distinct().join(extracted, "arxiv_id", "left_semi")


def pending_downloads(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers whose file isn't among those listed: (arxiv_id, file_name)."""
    named = papers.select("arxiv_id", file_name(F.col("arxiv_id")).alias("file_name")).distinct()
    return named.join(files.select("file_name"), "file_name", "left_anti").select("arxiv_id", "file_name")


def download(papers: DataFrame, files: DataFrame, folder: str, fetch: Callable[[str, str], None], wait: float = 1.0) -> DataFrame:
    """(arxiv_id, local_pdf_path): the stored file of each paper, fetched if it isn't there, null where that fails.

    ``files`` (path, file_name) are those stored already; ``fetch`` stores an address at a path,
    both of the shared ``folder``. A file is fetched by one task and once a run, with ``wait``
    seconds between the fetches of a task.
    """
    named = papers.select("arxiv_id", "pdf_url", file_name(F.col("arxiv_id")).alias("file_name")).dropDuplicates(["arxiv_id"])
    placed = named.join(files.select("file_name", "path"), "file_name", "left")
    root = folder.rstrip("/")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            paths = []
            for url, name in zip(f["pdf_url"], f["file_name"]):
                path = f"{root}/{name}"
                try:
                    fetch(url, path)
                    paths.append(path)
                except Exception:
                    paths.append(None)
                time.sleep(wait)
            yield pd.DataFrame({"arxiv_id": f["arxiv_id"], "local_pdf_path": paths})

    fetched = placed.where("path is null").select("arxiv_id", "pdf_url", "file_name").mapInPandas(run, "arxiv_id string, local_pdf_path string")
    return placed.where("path is not null").select("arxiv_id", F.col("path").alias("local_pdf_path")).unionByName(fetched)


def parse_papers(papers: DataFrame, files: DataFrame, renderer: Callable[[bytes], str]) -> DataFrame:
    """Parsed records of the papers whose file (path, content) is there and gave a text.

    Files are matched by name; texts are cleaned and split into sections, ``sections`` is their map.
    Papers without a path, a file or a text fall out.
    """
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    having = papers.where(F.col("local_pdf_path").isNotNull() & (F.col("local_pdf_path") != "")).withColumn("_file", name("local_pdf_path"))
    # Only names travel to the files, so contents stay in the tasks that read them.
    wanted = files.withColumn("_file", name("path")).join(having.select("_file").distinct(), "_file", "left_semi")
    texts = models.render_documents(wanted, renderer).where("text is not null and text <> ''").select(name("path").alias("_file"), clean_text(F.col("text")).alias("full_text"))
    whole = sections.with_sections(texts, ["_file"])
    facts = having.select("_file", "arxiv_id", "title", "abstract", "authors", "published", "categories")
    return whole.join(facts, "_file").select(
        "arxiv_id", "title", "abstract", "authors", "published", "categories",
        F.map_from_entries("sections").alias("sections"), "full_text", F.length("full_text").alias("char_count"), word_count(F.col("full_text")).alias("word_count"),
    )


def file_name(paper_id: Column) -> Column:
    return F.concat(F.replace(paper_id, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def paper_record(papers: DataFrame) -> DataFrame:
    """Identifier from the address, file name, first authors, previews, abstract page."""
    short = F.element_at(F.split("pdf_url", "/"), -1)
    return papers.select(
        "arxiv_id",
        short.alias("short_id"),
        file_name(short).alias("file_name"),
        F.array_join(F.slice("authors", 1, 3), ", ").alias("first_authors"),
        F.substring("title", 1, 50).alias("title_preview"),
        F.concat(F.lit("https://preprints.example/abs/"), "arxiv_id").alias("abs_url"),
        F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss").alias("collected_iso"),
    ).distinct()


def parsed_record(parsed: DataFrame) -> DataFrame:
    """Counts of a parsed paper beside the stored ones."""
    return parsed.select(
        "arxiv_id",
        F.coalesce(F.length("full_text"), F.lit(0)).alias("chars"),
        word_count(F.col("full_text")).alias("words"),
        F.coalesce(F.col("char_count"), F.lit(-1)).alias("stored_chars"),
        F.coalesce(F.col("word_count"), F.lit(-1)).alias("stored_words"),
    ).distinct()


def index_records(chunks: DataFrame, min_chars: int = 10) -> DataFrame:
    """Rows of the vector index: texts long enough, with flat metadata."""
    kept = chunks.where(F.length(strip(F.col("text"))) > min_chars)
    return kept.select(
        "chunk_id",
        "arxiv_id",
        F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("section", F.lit("")).alias("section"),
        F.coalesce(F.array_join(F.slice("metadata.authors", 1, 3), ", "), F.lit("")).alias("authors"),
        F.coalesce("metadata.published", F.lit("")).alias("published"),
        "chunk_ord",
    )


def row_numbers(df: DataFrame, order: list[str], scratch: Scratch, out: str = "row_no", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds the place of each row in the given order, 0 to n - 1; ``order`` should be total.

    Rows are sorted over range partitions, as many as their number asks for, numbered inside and
    written once with that number. The counts before each range are taken from what was written,
    so they belong to the same ranges however the bounds were sampled, and a task that is done
    again changes neither.
    """
    n = df.count()
    ranges = max(1, -(-n // rows_per_range))
    inside = F.monotonically_increasing_id()  # the partition's number in the upper bits, the place in it in the lower 33
    placed = scratch.table(df.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_m", inside))
    part = F.shiftright("_m", 33)
    sizes = sorted((r["_p"], r["n"]) for r in placed.groupBy(part.alias("_p")).agg(F.count("*").alias("n")).collect())  # a row per range
    before, run = [], 0
    for p, size in sizes:
        before.append((p, run))
        run += size
    shift = df.sparkSession.createDataFrame(before, "_p bigint, _before bigint")
    numbered = placed.withColumn("_p", part).join(F.broadcast(shift), "_p")
    return numbered.withColumn(out, F.col("_before") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_before", "_m")


def batch_numbers(df: DataFrame, order: list[str], scratch: Scratch, batch: int = 32, out: str = "batch_no", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Adds the number of the batch of ``batch`` rows each row is in, in the given order."""
    numbered = row_numbers(df, order, scratch, "_n", rows_per_range)
    return numbered.withColumn(out, F.floor(F.col("_n") / batch).cast("bigint")).drop("_n")
