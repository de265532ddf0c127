"""Batch stages from the command line: ``python -m corpusloom.jobs STAGE --in DIR --out DIR``.

Models, clients and renderers are named as ``package.module:name``.
"""

from __future__ import annotations

import argparse
import time
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api, models
from .operators import bm25, chunking, evaluate, ingest, qa, rag
from .runtime import Scratch
from .sources import envelopes


#: Folders of files that one parse run may list.
MOST_FOLDERS = 1000


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def papers(spark: SparkSession, source: str, out: str) -> None:
    """Merges an envelope of found papers into the stored ones at ``out``; stored ones win."""
    found = envelopes.read_envelope(spark, source, "papers")
    stored = spark.read.parquet(out) if envelopes.path_exists(spark, out) else found.limit(0)
    merged = ingest.resume_union(stored, found, "arxiv_id", [F.col("pos")])
    envelopes.write_rows(merged, out, {"collected_at": _now()})


def download(spark: SparkSession, source: str, out: str, fetch, folder: str | None = None, wait: float = 1.0) -> None:
    """Papers with their stored files, those without one left out."""
    stored = spark.read.parquet(source)
    folder = (folder or out + "_files").rstrip("/")
    glob = f"{folder}/*.pdf"
    files = envelopes.list_files(spark, glob) if envelopes.path_exists(spark, glob) else spark.createDataFrame([], "path string, file_name string")
    made = ingest.download(stored, files, folder, fetch, wait)
    envelopes.write_rows(stored.drop("local_pdf_path").join(made.where("local_pdf_path is not null"), "arxiv_id"), out, {"collected_at": _now()})


def parse(spark: SparkSession, source: str, out: str, renderer) -> None:
    """Parsed records of the papers at ``source`` from the files they name."""
    stored = spark.read.parquet(source)
    folders = [r[0] for r in stored.where("local_pdf_path <> ''").select(F.regexp_extract("local_pdf_path", "^(.*)/", 1)).distinct().limit(MOST_FOLDERS + 1).collect()]
    if not 0 < len(folders) <= MOST_FOLDERS:
        raise ValueError(f"papers must name files in one to {MOST_FOLDERS} folders")
    files = spark.read.format("binaryFile").load([f + "/*" for f in folders])
    envelopes.write_rows(ingest.parse_papers(stored, files, renderer), out)
    made = spark.read.parquet(out)
    bare = F.map_contains_key("sections", "full_text")
    counts = made.agg(F.count("*").alias("total_parsed"), F.count_if(bare).alias("full_text_only"), F.count_if(~bare).alias("sectioned")).first()
    envelopes.write_facts(spark, out, {"parsed_at": _now(), **counts.asDict()})


def chunk(spark: SparkSession, source: str, out: str, tokenizer=None) -> None:
    parsed = spark.read.parquet(source)
    made = chunking.chunk_papers(parsed, tokenizer=tokenizer)
    envelopes.write_rows(made, out, {"chunked_at": _now(), "size": 450, "overlap": 64})


def index(spark: SparkSession, source: str, out: str, embedder: models.Embedder | None = None) -> dict[str, int]:
    """Embeds chunks and stores corpus, vectors and BM25 tables under ``out``; gives the counts by status.

    The stored vectors are replaced only once all chunks are embedded. ``api.Engine.open`` opens
    what is stored here.
    """
    chunks = spark.read.parquet(source)
    with Scratch(spark, "embed") as scratch:
        done = scratch.table(models.embed(chunks.where(F.length(F.trim("text")) > 10), "chunk_id", "text", embedder or models.HashEmbedder()))
        vectors = models.failed_out(done).select(F.col("chunk_id").alias("doc"), "embedding")
        title = "title" if "title" in chunks.columns else F.lit(None).cast("string").alias("title")
        corpus = chunks.select(F.col("chunk_id").alias("doc"), "text", "arxiv_id", "section", title)
        bm25.build_index(corpus, "doc", "text", f"{out}/bm25_next")
        envelopes.replace_table(corpus, f"{out}/corpus")
        envelopes.replace_table(vectors, f"{out}/vectors")
        envelopes.move_table(spark, f"{out}/bm25_next", f"{out}/bm25")
        return {r["status"]: r["count"] for r in done.groupBy("status").count().collect()}


def qa_samples(spark: SparkSession, source: str, out: str, generator: models.Generator | None = None) -> None:
    """Question and answer samples of the chunks at ``source``, in shuffled order, with their statistics."""
    chunks = spark.read.parquet(source)
    began = time.time()
    with Scratch(spark, "qa") as scratch:
        asked, n = scratch.counted(qa.requests(qa.allocate(chunks, scratch), chunks))
        made = qa.samples(asked, generator or models.EchoGenerator(), rag.INSTRUCTION)
        envelopes.write_rows(made.sort("order_key").drop("sample", "order_key"), out)
    stats = qa.sample_stats(spark.read.parquet(out)).first().asDict()
    seconds = time.time() - began
    rate, _ = evaluate.progress(F.lit(stats["total"]), F.lit(n), F.lit(seconds))
    rate = spark.range(1).select(F.round(rate, 1)).first()[0]
    envelopes.write_facts(spark, out, {**stats, "failed": n - stats["total"], "seconds": round(seconds, 1), "per_minute": rate})


def evaluation(spark: SparkSession, source: str, out: str, items: str, embedder=None, generator=None, label: str = "baseline", top_k: int = 5) -> None:
    """Answers the items of a table with the engine stored at ``source`` and reports on them."""
    engine = api.Engine.open(spark, source, embedder or models.HashEmbedder(), generator or models.EchoGenerator())
    envelopes.replace_table(evaluate.evaluate_items(engine, spark.read.parquet(items), top_k), f"{out}_items")
    report(spark, f"{out}_items", out, label, top_k)


def report(spark: SparkSession, source: str, out: str, label: str = "baseline", top_k: int = 5) -> None:
    """The report on a table of details as one JSON document; details of very many items stay in their table."""
    envelopes.write_report(evaluate.report(spark.read.parquet(source), label, _now(), top_k), out)


STAGES = {
    "papers": papers, "download": download, "parse": parse, "chunk": chunk, "index": index, "qa": qa_samples, "evaluate": evaluation, "report": report,
}
#: Options a stage takes besides --in and --out, and whether they name an object to be imported.
OPTIONS = {
    "fetch": True, "renderer": True, "tokenizer": True, "embedder": True, "generator": True, "items": False, "folder": False, "label": False,
}


def main(given: list[str] | None = None) -> None:
    args = argparse.ArgumentParser()
    args.add_argument("stage", choices=sorted(STAGES))
    args.add_argument("--in", dest="source", required=True)
    args.add_argument("--out", required=True)
    for name in OPTIONS:
        args.add_argument(f"--{name}")
    found = args.parse_args(given)
    extra = {n: models.load(getattr(found, n)) if imported else getattr(found, n) for n, imported in OPTIONS.items() if getattr(found, n) is not None}
    spark = SparkSession.builder.appName(f"corpusloom-{found.stage}").getOrCreate()
    STAGES[found.stage](spark, found.source, found.out, **extra)


if __name__ == "__main__":
    main()
