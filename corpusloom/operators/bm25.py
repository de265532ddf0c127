"""BM25 as stored tables: postings and term statistics that are built once, opened and searched in batches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexical_tokens
from ..runtime import spread

#: Folders the postings are stored in, by term; a search opens those of its terms only.
BUCKETS = 64
#: Query terms that are broadcast and whose folders are picked; more are joined by shuffle.
SENT_TERMS = 100_000
#: Query terms whose names are pushed into the scan.
PUSHED_TERMS = 1000


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # term, doc, tf, dl, head, bucket; a document's head row is its first, or one without a term
    terms: DataFrame  # term, df, idf
    n_docs: int
    avgdl: float


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def build_index(corpus: DataFrame, key: str, text: str, path: str, epsilon: float = 0.25) -> Index:
    """Stores the index of all rows with a text at ``path`` and opens it. ``key`` must be unique.

    A term's idf is ln(N - df + 0.5) - ln(df + 0.5); negative ones are replaced by ``epsilon``
    times the mean over the vocabulary. Texts are read once. A document's terms are counted inside
    its row, as runs of its sorted tokens, so the only shuffle of postings is the one that stores
    them by term, which adaptive execution splits where a term is in most documents.
    """
    spark = corpus.sparkSession
    texts = spread(corpus.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("_t")))
    sorted_ = texts.select("doc", F.array_sort(lexical_tokens(F.col("_t"))).alias("s")).select("doc", "s", F.size("s").alias("dl"))
    other = lambda i: (i == 0) | (F.get("s", i) != F.get("s", i - 1))
    starts = F.when(F.col("dl") > 0, F.filter(F.sequence(F.lit(0), F.col("dl") - 1), other)).otherwise(F.array(F.lit(0)))
    runs = sorted_.select("doc", "s", "dl", starts.alias("at"))
    run = lambda a, j: F.struct(F.get("s", a).alias("term"), (F.coalesce(F.get("at", j + 1), F.col("dl")) - a).alias("tf"), (j == 0).alias("head"))
    rows = runs.select("doc", "dl", F.size("at").alias("_n"), F.explode_outer(F.transform("at", run)).alias("x"))
    rows = rows.select("x.term", "doc", "x.tf", "dl", "x.head").withColumn("bucket", F.coalesce(_bucket(F.col("term")), F.lit(0)))
    # A rebalance by bucket, not a repartition: common terms are spread over several files.
    rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    kind = corpus.schema[key].dataType.simpleString()
    postings = _postings(spark, path, kind)
    sizes = postings.where("head").agg(F.count("*").alias("n"), F.sum("dl").alias("dl")).first()
    n = sizes["n"]
    raw = postings.where("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    raw = raw.withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    raw.sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/raw")
    facts = [(n, (sizes["dl"] or 0) / n if n else 0.0, spark.read.schema("term string, df bigint, raw double").parquet(f"{path}/raw").agg(F.avg("raw")).first()[0], float(epsilon), kind)]
    spark.createDataFrame(facts, _FACTS).coalesce(1).write.mode("overwrite").parquet(f"{path}/facts")
    return open_index(spark, path)


_FACTS = "n_docs bigint, avgdl double, mean double, epsilon double, doc_type string"


def _postings(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(f"term string, doc {kind}, tf int, dl int, head boolean, bucket int").parquet(f"{path}/postings")


def open_index(spark: SparkSession, path: str) -> Index:
    """An index stored by :func:`build_index`; only its one row of facts is read here."""
    facts = spark.read.schema(_FACTS).parquet(f"{path}/facts").first()
    raw = spark.read.schema("term string, df bigint, raw double").parquet(f"{path}/raw")
    floor = F.lit((facts["mean"] or 0.0) * facts["epsilon"])
    terms = raw.select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))
    return Index(_postings(spark, path, facts["doc_type"]), terms, facts["n_docs"], facts["avgdl"])


def search(index: Index, queries: DataFrame, k: int, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query_id, doc, score, rank): the best ``k`` documents of each query with a positive score.

    ``queries`` has query_id and question. A term counts as often as the question has it. Ties
    go to the lesser document; scores are compared after rounding to nine places. Up to
    SENT_TERMS query terms are read once and broadcast, and only their folders of the postings
    are opened; more are joined by shuffle.
    """
    asked = queries.select("query_id", F.explode(lexical_tokens(F.col("question"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    postings, terms = index.postings.where("term is not null").drop("head"), index.terms
    first = asked.limit(SENT_TERMS + 1).collect()
    if len(first) <= SENT_TERMS:
        asked = F.broadcast(queries.sparkSession.createDataFrame(first, asked.schema))
        names = sorted({r["term"] for r in first})
        used = asked.select(_bucket(F.col("term"))).distinct().collect()  # at most BUCKETS rows
        postings = postings.where(F.col("bucket").isin([r[0] for r in used]))
        if len(names) <= PUSHED_TERMS:
            postings, terms = postings.where(F.col("term").isin(names)), terms.where(F.col("term").isin(names))
        hits = postings.join(asked, "term").join(F.broadcast(terms.join(asked.select("term").distinct(), "term", "left_semi")), "term")
    else:
        hits = postings.join(asked, "term").join(terms, "term")
    part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl or 1.0)))
    scores = hits.groupBy("query_id", "doc").agg(F.round(F.sum(part), 9).alias("score")).where("score > 0")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
