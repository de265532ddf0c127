"""Sampling of chunks and rendering of question and answer samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import models
from ..config import SETTINGS, Settings
from ..functions.text import json_between_braces, topic_of
from ..runtime import Scratch
from .ingest import row_numbers


def seeded_order(key: Column, seed: int = 42) -> Column:
    """A shuffle that any engine can repeat: the hash of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def allocate(chunks: DataFrame, scratch: Scratch, settings: Settings = SETTINGS) -> DataFrame:
    """(chunk_id, arxiv_id, place, kind, pool_place, n_synthesis) of eligible chunks in shuffled order.

    Of min(n, cap) samples the grounded share comes first, then refusals (the remainder), then
    all other chunks are left for pairs. Places are numbered over ranges of the hash, so no task
    sees all rows, and texts stay where they are: samples fetch theirs by chunk_id.
    """
    eligible = chunks.where(F.col("word_count") >= settings.qa_min_words).select("chunk_id", "arxiv_id", seeded_order(F.col("chunk_id"), settings.seed).alias("_o"))
    placed = row_numbers(eligible, ["_o", "chunk_id"], scratch, "place")
    n = placed.agg(F.count("*")).scalar()
    total = F.least(n, F.lit(settings.qa_cap))
    grounded = F.floor(total * settings.qa_grounded)
    synthesis = F.floor(total * settings.qa_synthesis)
    refusal = total - grounded - synthesis
    sized = placed.select("*", grounded.alias("_g"), refusal.alias("_r"), synthesis.alias("n_synthesis"))
    kind = F.when(F.col("place") < F.col("_g"), "grounded").when(F.col("place") < F.col("_g") + F.col("_r"), "refusal").otherwise("synthesis")
    return sized.withColumn("kind", kind).withColumn("pool_place", F.when(kind == "synthesis", F.col("place") - F.col("_g") - F.col("_r"))).drop("_o", "_g", "_r")


def pairs(allocated: DataFrame) -> DataFrame:
    """(pair_no, first, second): neighbours in the pool of different papers, each chunk used once.

    Pairs of one paper are dropped without replacement, and at most n_synthesis are kept.
    """
    pool = allocated.where(F.col("kind") == "synthesis").where(F.col("pool_place") < F.col("n_synthesis") * 2)
    two = pool.groupBy(F.floor(F.col("pool_place") / 2).alias("pair_no")).agg(
        F.min_by(F.struct("chunk_id", "arxiv_id"), "pool_place").alias("a"),
        F.max_by(F.struct("chunk_id", "arxiv_id"), "pool_place").alias("b"),
        F.count("*").alias("n"),
    )
    kept = two.where((F.col("n") == 2) & (F.col("a.arxiv_id") != F.col("b.arxiv_id")))
    return kept.select("pair_no", F.col("a.chunk_id").alias("first"), F.col("b.chunk_id").alias("second"))


def passage(title: Column, section: Column, text: Column, chars: int) -> Column:
    """What a sample shows of a chunk; the form of the first line is a fixed value, as stored samples have it."""
    return F.concat(
        F.lit("Context from '"), F.coalesce(title, F.lit("")), F.lit("' ("), F.coalesce(section, F.lit("")), F.lit("):\n"), F.substring(text, 1, chars)
    )


def grounded_inputs(placed: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(chunk_id, kind, topic, title, excerpt, context, source_arxiv_id) of grounded and refusal samples.

    ``placed`` comes from :func:`allocate`; of the chunks only those of samples are fetched, of
    which there are at most ``settings.qa_cap``.
    """
    chosen = placed.where("kind <> 'synthesis'").select("chunk_id", "kind")
    own = chunks.select("chunk_id", "arxiv_id", "title", "section", "text").join(_few(chosen, settings), "chunk_id")
    return own.select(
        "chunk_id", "kind", topic_of(F.coalesce("title", F.lit(""))).alias("topic"), F.coalesce("title", F.lit("")).alias("title"),
        F.substring("text", 1, settings.qa_context_chars).alias("excerpt"),
        passage(F.col("title"), F.col("section"), F.col("text"), settings.qa_context_chars).alias("context"), F.col("arxiv_id").alias("source_arxiv_id"),
    )


def synthesis_inputs(paired: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(pair_no, titles, excerpts, context, source_arxiv_id) of paired chunks, both in their order."""
    ends = paired.select("pair_no", F.explode(F.array(F.struct(F.lit(1).alias("at"), F.col("first").alias("chunk_id")), F.struct(F.lit(2).alias("at"), F.col("second").alias("chunk_id")))).alias("e"))
    ends = ends.select("pair_no", "e.at", "e.chunk_id")
    own = chunks.select("chunk_id", "arxiv_id", "title", "section", "text").join(_few(ends, settings), "chunk_id")
    shown = passage(F.col("title"), F.col("section"), F.col("text"), settings.qa_pair_chars).alias("context")
    row = F.struct("at", F.coalesce("title", F.lit("")).alias("title"), F.substring("text", 1, settings.qa_pair_chars).alias("excerpt"), shown, "arxiv_id")
    two = own.groupBy("pair_no").agg(F.array_sort(F.collect_list(row)).alias("x"))  # two rows a pair
    return two.select(
        "pair_no", F.col("x.title").alias("titles"), F.col("x.excerpt").alias("excerpts"),
        F.array_join("x.context", "\n\n").alias("context"), F.array_join("x.arxiv_id", ",").alias("source_arxiv_id"),
    )


def _few(keys: DataFrame, settings: Settings) -> DataFrame:
    """Keys of samples, of which there are at most twice the cap, for a join with the chunks."""
    return F.broadcast(keys) if settings.qa_cap <= 100_000 else keys


#: Our wording of the three requests to a generator; slots and their order are what is fixed.
RULES = "Stay with what the excerpt says, name the paper, write plain sentences, and reply with one JSON object that has the keys question and answer only."
REQUESTS = {
    "grounded": ("Write a question about one claim, method or result of this excerpt, and its answer in two to four sentences.\n", RULES, "\n\nPaper: ", "\nExcerpt:\n"),
    "synthesis": ("Write a question that compares these two papers, and an answer in three to five sentences that uses both.\n", RULES, "\n\nPaper ", ": ", "\nExcerpt:\n"),
    "refusal": (
        "Write a question on the topic of this paper that the excerpt does not answer, and an answer that says what the excerpt covers and what it lacks.\n",
        RULES, "\n\nPaper: ", "\nTopic: ", "\nExcerpt:\n",
    ),
}


def requests(placed: DataFrame, chunks: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(sample, type, prompt, context, source_arxiv_id): what a generator is asked for each sample."""
    single = grounded_inputs(placed, chunks, settings)
    g, r, s = (REQUESTS[k] for k in ("grounded", "refusal", "synthesis"))
    own = F.when(F.col("kind") == "grounded", F.concat(F.lit(g[0] + g[1] + g[2]), "title", F.lit(g[3]), "excerpt")).otherwise(
        F.concat(F.lit(r[0] + r[1] + r[2]), "title", F.lit(r[3]), "topic", F.lit(r[4]), "excerpt")
    )
    double = synthesis_inputs(pairs(placed), chunks, settings)
    part = lambda i: F.concat(F.lit(f"{s[2]}{i + 1}{s[3]}"), F.col("titles")[i], F.lit(s[4]), F.col("excerpts")[i])
    both = F.concat(F.lit(s[0] + s[1]), part(0), part(1))
    columns = lambda sample, kind, prompt: (sample.alias("sample"), kind.alias("type"), prompt.alias("prompt"), "context", "source_arxiv_id")
    return single.select(*columns(F.col("chunk_id"), F.col("kind"), own)).unionByName(
        double.select(*columns(F.concat(F.lit("pair-"), "pair_no"), F.lit("synthesis"), both))
    )


def samples(asked: DataFrame, generator: models.Generator, instruction: str, settings: Settings = SETTINGS, retries: int = 1, wait: float = 2.0) -> DataFrame:
    """(sample, type, instruction, input, output, source_arxiv_id, order_key) of the requests a generator met.

    The generator is asked for JSON, again after an error up to ``retries`` times; a request
    without a valid object (see :func:`parse_generated`) gives no sample. ``order_key`` is a
    seeded shuffle of all kinds.
    """
    raw = models.generate(asked, "sample", "prompt", generator, temperature=0.7, retries=retries, wait=wait, keep=["type", "context", "source_arxiv_id"], json=True)
    made = parse_generated(raw, "raw").where("question is not null")
    return made.select(
        "sample", "type", F.lit(instruction).alias("instruction"), F.concat("context", F.lit("\n\nQuestion: "), "question").alias("input"),
        F.col("answer").alias("output"), "source_arxiv_id", seeded_order(F.col("sample"), settings.seed).alias("order_key"),
    )


def sample_stats(made: DataFrame) -> DataFrame:
    """One row: total and the number of samples of each type."""
    of = lambda kind: F.count_if(F.col("type") == kind)
    return made.agg(F.count("*").alias("total"), of("grounded").alias("type1_grounded"), of("synthesis").alias("type2_synthesis"), of("refusal").alias("type3_refusal"))


def parse_generated(df: DataFrame, raw: str) -> DataFrame:
    """Adds question and answer of a generated JSON, both null where it isn't valid.

    Valid: an object between the first and last brace with a question of more than 10 and an
    answer of more than 20 characters.
    """
    parsed = F.from_json(json_between_braces(F.col(raw)), "question string, answer string")
    good = (F.length(parsed["question"]) > 10) & (F.length(parsed["answer"]) > 20)
    return df.withColumn("question", F.when(good, parsed["question"])).withColumn("answer", F.when(good, parsed["answer"]))


def chat_messages(samples: DataFrame) -> DataFrame:
    """(qa_id, messages): system, user and assistant turns; samples without an input or output fall out."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    kept = samples.where(F.col("input").isNotNull() & F.col("output").isNotNull())
    messages = F.filter(F.array(turn("system", "instruction"), turn("user", "input"), turn("assistant", "output")), lambda m: m["content"].isNotNull())
    return kept.select("qa_id", messages.alias("messages"))


def train_eval_split(samples: DataFrame, key: str, share: float = 0.05, seed: int = 42) -> DataFrame:
    """(key, split): ceil(share * n) rows with the least hashes are eval, the others train.

    The cut is found from hash buckets of a fixed number: only the bucket it falls in is ordered.
    """
    h = seeded_order(F.col(key), seed)
    rows = samples.select(key).distinct().withColumn("_h", h).withColumn("_b", F.substring("_h", 1, 3))
    sizes = sorted((r["_b"], r["n"]) for r in rows.groupBy("_b").agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)
    wanted = -(-round(total * share * 1_000_000) // 1_000_000)
    run, edge, inside = 0, "", 0
    for b, n in sizes:
        if run + n >= wanted:
            edge, inside = b, wanted - run
            break
        run += n
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h"))
    at_edge = rows.where(F.col("_b") == edge).withColumn("_n", place).select(key, F.when(F.col("_n") <= inside, "eval").otherwise("train").alias("split"))
    others = rows.where(F.col("_b") != edge).select(key, F.when(F.col("_b") < edge, "eval").otherwise("train").alias("split"))
    return at_edge.unionByName(others)


def group_by_paper(chunks: DataFrame, scratch: Scratch) -> DataFrame:
    """(arxiv_id, title, n_chunks, pos, chunk_id): each paper's first title and its chunks in corpus order.

    The group is a run of rows in order of paper and ``pos``, not a list in one cell, so a paper
    with a third of all chunks is spread over tasks like any other: rows are numbered over range
    partitions, and the count, first title and first number of each paper are added up before
    they are shuffled.
    """
    placed = row_numbers(chunks.select("arxiv_id", "chunk_id", "chunk_ord", "title"), ["arxiv_id", "chunk_ord", "chunk_id"], scratch, "_n")
    per = placed.groupBy(F.col("arxiv_id").alias("_paper")).agg(F.min(F.struct("_n", "title")).alias("_first"), F.count("*").alias("n_chunks"))
    joined = placed.join(per, F.col("arxiv_id").eqNullSafe(F.col("_paper")))
    return joined.select("arxiv_id", F.col("_first.title").alias("title"), "n_chunks", (F.col("_n") - F.col("_first._n")).alias("pos"), "chunk_id")
