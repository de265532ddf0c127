"""Queries of the engine over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import models
from ..functions import text as T
from ..operators import bm25, chunking, evaluate, hybrid, ingest, qa, rag, sections, vector
from ..runtime import Scratch, read_table
from .oracle import ORACLE as ORACLE

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


#: Key and order of rows; the first row of a key counts.
FIRST = {
    "chunks": ("chunk_id", ["chunk_ord", "chunked_at"]),
    "papers_parsed": ("arxiv_id", ["parsed_at"]),
    "papers": ("arxiv_id", ["collected_at", "coalesce(query_source, '')", "coalesce(title, '')"]),
    "qa_dataset": ("qa_id", ["created_at"]),
}


def _first(spark: SparkSession, d: str, table: str, *columns: str) -> DataFrame:
    key, order = FIRST[table]
    return ingest.first_rows(read_table(spark, d, table), key, [F.expr(o) for o in order], list(columns), Scratch(spark, "first"))


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(spark, d, "chunks", *columns)


def _parsed(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(spark, d, "papers_parsed", *columns)


def _papers(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(spark, d, "papers", *columns)


def _qa(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return _first(spark, d, "qa_dataset", *columns)


def _corpus(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").where("text is not null").select(
        F.col("doc_id").alias("doc"), "text", "arxiv_id", "section", F.col("source").alias("title")
    )


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of the documents of the same number; the pairing is artificial."""
    return read_table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), "embedding")


def _questions(spark: SparkSession, d: str) -> DataFrame:
    """Every fiftieth evaluation question, with the vector of its number."""
    items = read_table(spark, d, "eval_details").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "question")
    return items.join(_vectors(spark, d).select(F.col("doc").alias("query_id"), "embedding"), "query_id")


_INDEXES: dict[tuple, str] = {}


def _index(spark: SparkSession, d: str) -> bm25.Index:
    """The stored index of the documents: built by the first query of a session that needs it, then opened."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    name = (spark.sparkContext.applicationId, d, changed)
    if name not in _INDEXES:
        where = Scratch(spark, "bm25").path()
        bm25.build_index(_corpus(spark, d), "doc", "text", where)
        _INDEXES[name] = where
    return bm25.open_index(spark, _INDEXES[name])


def _digest(c: str) -> list:
    return [F.length(c).alias("n_chars"), F.md5(c).alias("digest")]


@query
def paper_dedup_keep_first(spark, d):
    return _papers(spark, d, "arxiv_id", "title", "query_source", "primary_category")


@query
def resume_union_antijoin(spark, d):
    existing = _parsed(spark, d, "arxiv_id", "title")
    found = read_table(spark, d, "papers").select("arxiv_id", "title", "collected_at")
    order = [F.col("collected_at"), F.coalesce("title", F.lit(""))]
    return ingest.resume_union(existing.withColumn("collected_at", F.lit(None).cast("timestamp")), found, "arxiv_id", order).select("arxiv_id", "title")


@query
def usable_papers(spark, d):
    return ingest.usable_papers(read_table(spark, d, "papers"), read_table(spark, d, "papers_parsed"))


@query
def pending_downloads(spark, d):
    papers = read_table(spark, d, "papers")
    files = papers.where("local_pdf_path <> ''").select(F.element_at(F.split("local_pdf_path", "/"), -1).alias("file_name")).distinct()
    return ingest.pending_downloads(papers, files)


@query
def paper_record(spark, d):
    return ingest.paper_record(_papers(spark, d, "arxiv_id", "pdf_url", "authors", "title", "collected_at"))


@query
def word_char_counts(spark, d):
    return ingest.parsed_record(read_table(spark, d, "papers_parsed"))


@query
def defaults_and_iso(spark, d):
    return _papers(spark, d, "arxiv_id", "abstract", "title", "local_pdf_path", "published").select(
        "arxiv_id",
        F.coalesce(F.nullif(T.strip(F.col("abstract")), F.lit("")), F.col("title"), F.lit("")).alias("summary"),
        F.coalesce("local_pdf_path", F.lit("")).alias("path"),
        F.date_format(F.to_timestamp("published"), "yyyy-MM-dd HH:mm:ss").alias("published_utc"),
    )


@query
def text_clean(spark, d):
    cleaned = _parsed(spark, d, "arxiv_id", "full_text").select("arxiv_id", T.clean_text(F.col("full_text")).alias("t"))
    return cleaned.select("arxiv_id", *_digest("t"))


@query
def chunk_text_clean(spark, d):
    cleaned = _chunks(spark, d, "chunk_id", "text").select("chunk_id", T.clean_chunk_text(F.col("text")).alias("t"))
    return cleaned.select("chunk_id", *_digest("t"))


@query
def strip_references(spark, d):
    cut = _parsed(spark, d, "arxiv_id", "full_text").select("arxiv_id", T.strip_references(F.col("full_text")).alias("t"))
    return cut.select("arxiv_id", *_digest("t"))


@query
def citation_filter(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    f = T.citation_features(F.col("text"))
    return docs.select("doc_id", *[c.cast("bigint").alias(n) for n, c in f.items()], T.citation_score(f).cast("bigint").alias("score"), T.is_citation(F.col("text")).alias("is_citation"))


@query
def quality_filter(spark, d):
    return _chunks(spark, d, "chunk_id", "text").where("text is not null").select("chunk_id", T.is_quality(F.col("text")).alias("is_quality"))


@query
def section_split(spark, d):
    return sections.split_sections(_parsed(spark, d, "arxiv_id", "full_text")).select("arxiv_id", "pos", "section", *_digest("body"))


@query
def section_stats(spark, d):
    per = sections.split_sections(_parsed(spark, d, "arxiv_id", "full_text")).groupBy("arxiv_id").agg(F.bool_or(F.col("section") == "full_text").alias("bare"), F.count("*").alias("n"))
    return per.agg(F.count_if("bare").alias("full_text_papers"), F.count_if(~F.col("bare")).alias("sectioned_papers"), F.sum("n").alias("n_sections"))


@query
def content_sections(spark, d):
    return chunking.content_sections(_parsed(spark, d, "arxiv_id", "sections", "full_text")).select("arxiv_id", "section", *_digest("body"))


@query
def chunk_windows(spark, d):
    docs = read_table(spark, d, "documents").where("text is not null")
    rows = chunking.windows(docs, ["doc_id"], "text")
    return rows.select("doc_id", "idx", F.col("start").alias("start_word"), "n_words", F.md5("text").alias("digest"))


@query
def chunk_records(spark, d):
    made = chunking.chunk_papers(_parsed(spark, d, "arxiv_id", "sections", "full_text"))
    return made.select("arxiv_id", "section", "chunk_index", "total_in_section", "chunk_id", "n_words", F.md5("text").alias("digest"))


@query
def chunk_skipped_papers(spark, d):
    parsed = _parsed(spark, d, "arxiv_id", "sections", "full_text")
    return parsed.select("arxiv_id").join(chunking.chunk_papers(parsed).select("arxiv_id"), "arxiv_id", "left_anti")


@query
def index_metadata(spark, d):
    rows = ingest.index_records(_chunks(spark, d, "chunk_id", "arxiv_id", "title", "section", "text", "metadata", "chunk_ord"))
    return ingest.batch_numbers(rows, ["chunk_ord", "chunk_id"], Scratch(spark, "batches")).drop("chunk_ord")


@query
def index_counters(spark, d):
    status = F.when(F.col("text").isNull(), "null").when(F.length(T.strip(F.col("text"))) <= 10, "skipped").otherwise("indexed")
    return _chunks(spark, d, "text").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query
def bm25_tokens(spark, d):
    t = _corpus(spark, d).select("doc", T.lexical_tokens(F.col("text")).alias("t"))
    return t.select("doc", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query
def bm25_stats(spark, d):
    index = _index(spark, d)
    terms = index.terms.agg(F.count("*").alias("n_terms"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.sum("df").alias("sum_df"))
    return terms.select(F.lit(index.n_docs).cast("bigint").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), "n_terms", "mean_idf", "sum_df")


@query
def bm25_terms(spark, d):
    return _index(spark, d).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@query
def bm25_topk(spark, d):
    found = bm25.search(_index(spark, d), _questions(spark, d), 40)
    return found.select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query
def vector_topk(spark, d):
    vectors = read_table(spark, d, "embeddings")
    queries = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return vector.top_k(queries, vectors, 10)


@query
def cosine_contrast(spark, d):
    """Similarity of every labelled vector to the mean of its own label and to that of all vectors of other labels."""
    vectors = read_table(spark, d, "embeddings").where("label is not null")
    cells = vectors.select("label", F.posexplode("embedding").alias("i", "x"))
    sums = cells.groupBy("label", "i").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count("x").alias("n"))
    all_labels = Window.partitionBy("i")
    other = F.try_divide(F.sum("s").over(all_labels) - F.col("s"), F.sum("n").over(all_labels) - F.col("n"))
    cells = sums.select("label", F.struct("i", F.try_divide("s", "n").alias("own"), other.alias("other")).alias("cell"))
    means = cells.groupBy(F.col("label").alias("own")).agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    to = lambda name: vector.cosine(F.col("embedding"), F.col("cells")[name])
    found = vectors.join(F.broadcast(means), F.col("own") == F.col("label")).select("vec_id", to("own").alias("same"), to("other").alias("other"))
    return found.select("vec_id", F.round("same", 6).alias("same_label"), F.round("other", 6).alias("other_label"), (F.col("same") > F.col("other")).alias("is_nearer"))


@query
def rrf_fusion(spark, d):
    q = _questions(spark, d)
    lexical, dense = bm25.search(_index(spark, d), q, 40), vector.top_k(q, _vectors(spark, d), 40, key="doc")
    return hybrid.fuse_ranks([dense, lexical], 60, 40).select("query_id", "doc", F.round("rrf", 6).alias("rrf"), "rank")


def _search(spark, d, **how):
    return hybrid.search(_index(spark, d), _corpus(spark, d), _vectors(spark, d), _questions(spark, d), **how)


@query
def hybrid_search_top5(spark, d):
    return _search(spark, d).select("query_id", "doc", "arxiv_id", "section", F.round("score", 6).alias("score"), "rank")


@query
def dedup_paper_topk(spark, d):
    return _search(spark, d, dedup="paper").select("query_id", "doc", "arxiv_id", F.round("score", 6).alias("score"), "rank")


@query
def lexical_search_top5(spark, d):
    return _search(spark, d, mode="lexical", dedup="none").select("query_id", "doc", F.round("score", 6).alias("score"), "rank")


@query
def rerank_lexical(spark, d):
    found = hybrid.with_distance(_search(spark, d, scorer=hybrid.lexical_overlap))
    return found.select("query_id", "doc", F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"), "rank")


@query
def sigmoid_distance(spark, d):
    scored = read_table(spark, d, "events").select("event_id", ((F.col("value") - 50) / 25).alias("score"))
    return hybrid.with_distance(scored).select("event_id", F.round("distance", 6).alias("distance"), F.round("relevance", 6).alias("relevance"))


@query
def context_prompt(spark, d):
    made = rag.context(_search(spark, d), _corpus(spark, d))
    return made.select("query_id", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


@query
def sources_dedup(spark, d):
    return rag.sources(_search(spark, d), _corpus(spark, d))


@query
def rag_prompt_batch(spark, d):
    made = rag.prompts(_search(spark, d), _corpus(spark, d), _questions(spark, d))
    return made.select("query_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query
def think_strip(spark, d):
    raw = _qa(spark, d, "qa_id", "output").where("output is not null").select(
        "qa_id", F.concat(F.lit("<think>first\nthoughts</think>"), "output", F.lit("<think>cut")).alias("raw"), "output"
    )
    return raw.select("qa_id", F.md5(T.strip_thinking(F.col("raw"))).alias("digest"), F.md5(T.strip_thinking(F.col("output"))).alias("own_digest"))


def _generated(spark, d):
    asked = F.regexp_extract("input", r"(?s)Question: (.*)$", 1)
    made = _qa(spark, d, "qa_id", "input", "output").where("input is not null and output is not null")
    body = F.to_json(F.struct(asked.alias("question"), F.col("output").alias("answer")))
    return made.select("qa_id", F.concat(F.lit("Sure: "), body, F.lit(" done")).alias("raw"))


@query
def json_extract_valid(spark, d):
    found = qa.parse_generated(_generated(spark, d), "raw")
    return found.select("qa_id", F.col("question").isNotNull().alias("valid"), F.length("question").alias("n_question"), F.length("answer").alias("n_answer"))


@query
def group_chunks_by_paper(spark, d):
    return qa.group_by_paper(_chunks(spark, d, "arxiv_id", "chunk_id", "chunk_ord", "title"), Scratch(spark, "papers"))


def _allocated(spark, d):
    return qa.allocate(_chunks(spark, d, "chunk_id", "arxiv_id", "word_count"), Scratch(spark, "qa"))


def _sample_chunks(spark, d):
    return _chunks(spark, d, "chunk_id", "arxiv_id", "title", "section", "text")


@query
def qa_sample_allocation(spark, d):
    return _allocated(spark, d).select("chunk_id", "place", "kind")


@query
def qa_pairs(spark, d):
    return qa.pairs(_allocated(spark, d))


@query
def qa_topic_case(spark, d):
    return _papers(spark, d, "arxiv_id", "title").select("arxiv_id", T.topic_of(F.coalesce("title", F.lit(""))).alias("topic"))


@query
def qa_inputs(spark, d):
    made = qa.grounded_inputs(_allocated(spark, d), _sample_chunks(spark, d))
    return made.select("chunk_id", "kind", "topic", F.md5("context").alias("digest"))


@query
def qa_synthesis_inputs(spark, d):
    made = qa.synthesis_inputs(qa.pairs(_allocated(spark, d)), _sample_chunks(spark, d))
    return made.select("pair_no", "source_arxiv_id", F.md5("context").alias("digest"))


@query
def qa_requests(spark, d):
    """What a generator is asked for each sample of the three kinds."""
    made = qa.requests(_allocated(spark, d), _sample_chunks(spark, d))
    return made.select("sample", "type", F.md5("prompt").alias("prompt_digest"), F.md5("context").alias("context_digest"), "source_arxiv_id")


def _samples(spark, d):
    asked = qa.requests(_allocated(spark, d), _sample_chunks(spark, d))
    return qa.samples(asked, models.EchoGenerator(), rag.INSTRUCTION)


@query
def qa_samples(spark, d):
    """The samples themselves; question and answer are a stand-in's."""
    return _samples(spark, d).select("sample", "type", "instruction", F.md5("input").alias("input_digest"), "output", "source_arxiv_id", "order_key")


@query
def qa_sample_stats(spark, d):
    return qa.sample_stats(_samples(spark, d))


@query
def qa_dataset_union(spark, d):
    """The three kinds of samples in one table, in an order of hashes."""
    placed = _allocated(spark, d)
    single = placed.where("kind <> 'synthesis'").select("kind", F.col("chunk_id").alias("sample"), F.col("arxiv_id").alias("source"))
    double = qa.synthesis_inputs(qa.pairs(placed), _sample_chunks(spark, d)).select(F.lit("synthesis").alias("kind"), F.concat(F.lit("pair-"), "pair_no").alias("sample"), F.col("source_arxiv_id").alias("source"))
    return single.unionByName(double).withColumn("order_key", qa.seeded_order(F.col("sample")))


@query
def qa_type_counts(spark, d):
    kind = F.coalesce(F.lower(T.strip(F.col("type"))), F.lit("unknown"))
    return _qa(spark, d, "type").groupBy(kind.alias("type")).agg(F.count("*").alias("n"))


@query
def chat_messages(spark, d):
    made = qa.chat_messages(_qa(spark, d, "qa_id", "instruction", "input", "output"))
    flat = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return made.select("qa_id", F.size("messages").alias("n_messages"), F.md5(flat).alias("digest"))


@query
def token_length_stats(spark, d):
    n = T.word_count(F.concat_ws(" ", "instruction", "input", "output"))
    return evaluate.length_stats(_qa(spark, d, "instruction", "input", "output"), n, 200)


@query
def train_eval_split(spark, d):
    return qa.train_eval_split(read_table(spark, d, "qa_dataset"), "qa_id")


@query
def retrieval_metrics(spark, d):
    return evaluate.retrieval_metrics(evaluate.list_scores(read_table(spark, d, "eval_details")))


@query
def retrieval_metrics_vectors(spark, d):
    """Vectors of one label are relevant to each other; the probe itself isn't a result."""
    vectors = read_table(spark, d, "embeddings")
    probes = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("own"))
    found = vector.top_k(probes.select("query_id", "embedding"), vectors, 6).where("vec_id <> query_id")
    joined = found.join(F.broadcast(probes.select("query_id", "own")), "query_id").join(vectors.select("vec_id", "label"), "vec_id")
    return evaluate.retrieval_metrics(evaluate.retrieval_scores(joined, F.col("own") == F.col("label")))


@query
def answer_details(spark, d):
    items = read_table(spark, d, "eval_details").withColumn("keywords", F.array_distinct(T.lexical_tokens(F.col("question"))))
    made = evaluate.answer_details(items)
    return made.withColumn("coverage", F.round("coverage", 6))


@query
def answer_metrics(spark, d):
    return evaluate.answer_summary(
        read_table(spark, d, "eval_details"), "keyword_coverage", "source_hit", "is_substantive", "answer_word_count", "latency_seconds"
    )


@query
def eval_report_details(spark, d):
    own = evaluate.list_scores(read_table(spark, d, "eval_details"))
    return own.select("item_id", "hit", F.round("rr", 6).alias("rr"), F.round("precision", 6).alias("precision"))


@query
def embed_batches(spark, d):
    """Rows only: the vectors are a stand-in's."""
    made = models.embed(_chunks(spark, d, "chunk_id", "text").where("text is not null"), "chunk_id", "text", models.HashEmbedder(), 32)
    return made.select("chunk_id", F.size("embedding").alias("size"), "status")


@query
def generate_answers(spark, d):
    """Rows only: the answers are a stand-in's."""
    asked = rag.prompts(_search(spark, d), _corpus(spark, d), _questions(spark, d))
    made = models.generate(asked, "query_id", "prompt", models.EchoGenerator(), rag.INSTRUCTION)
    return made.select("query_id", T.strip_thinking(F.col("raw")).alias("answer"))


@query
def eval_report(spark, d):
    """The stored report, flat; label and time are given, the details are those of the table."""
    made = evaluate.report(read_table(spark, d, "eval_details"), "baseline", "now", 5)
    return made.select(
        "label", "config.top_k", "config.dataset_size", "retrieval.hit_rate", "retrieval.mrr", "retrieval.avg_precision", "answer.summary.avg_keyword_coverage",
        "answer.summary.source_hit_rate", "answer.summary.substantive_rate", "answer.summary.total_time", F.size("answer.details").alias("n_details"),
        T.percent(F.col("retrieval.hit_rate")).alias("hit_rate_text"), T.percent(F.col("answer.summary.avg_keyword_coverage")).alias("coverage_text"),
    )


@query
def run_progress(spark, d):
    """Rate a minute and minutes left after each item, as if items were answered one after another."""
    items = read_table(spark, d, "eval_details").select("item_id", F.coalesce("latency_seconds", F.lit(0.0)).alias("s"))
    so_far = Window.orderBy("item_id").rowsBetween(Window.unboundedPreceding, 0)  # a bounded set of items
    placed = items.select("item_id", F.sum("s").over(so_far).alias("seconds"), F.row_number().over(Window.orderBy("item_id")).alias("done"))
    rate, left = evaluate.progress(F.col("done"), items.agg(F.count("*")).scalar(), F.col("seconds"))
    return placed.select("item_id", F.round(rate, 6).alias("per_minute"), F.round(left, 6).alias("minutes_left"))
