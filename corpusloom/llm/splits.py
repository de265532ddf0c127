"""Train, validation and test splits that never part samples sharing an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from ..operators.ingest import SENT_KEYS
from ..runtime import Scratch

#: Fixed value: how a paper is named inside an identifier of any spelling.
PAPER = r"(?<![0-9])([0-9]{4}\.[0-9]{5})(?![0-9])"
PROPORTIONS = (("train", 0.8), ("validation", 0.1), ("test", 0.1))
#: Groups of more than this share of all samples are placed first; there are at most 1 / LARGE.
LARGE = 0.0005
#: Hash buckets whose sizes give the running total; the number is fixed, whatever the input.
BUCKETS = 4096


def paper_groups(df: DataFrame, scratch: Scratch, key: str = "qa_id", source: str = "source_arxiv_id") -> DataFrame:
    """(key, group_id): for each sample that names a paper, the least paper of its group.

    Papers are the ``YYMM.NNNNN`` in ``source``, whatever stands around them (versions, prefixes,
    addresses, blanks). Samples that name one paper are in one group, directly or through others.
    Samples with a null, empty or blank source, or one without a paper, aren't listed, nor are
    null keys. A key in several rows counts once and names the papers of all its rows. Other
    columns are not read. An empty table gives no rows.

    Only samples that name several papers make edges, one to each from their least paper; the
    papers' graph is searched by :func:`connected_components`.
    """
    found = df.where(F.col(key).isNotNull()).select(
        F.col(key).alias("key"), F.explode(F.expr(f"regexp_extract_all(`{source}`, r'{PAPER}', 1)")).alias("paper")
    )
    named = scratch.table(found.distinct())
    # One row a sample, however often its key or a paper is repeated.
    samples = scratch.table(named.groupBy("key").agg(F.min("paper").alias("least"), F.count("*").alias("n")))
    several = samples.where("n > 1").select("key", "least")
    edges = named.join(several, "key").where("paper <> least").select(F.col("least").alias("a"), F.col("paper").alias("b")).distinct()
    roots = connected_components(edges, scratch)
    least = roots.groupBy("root").agg(F.min("node").alias("group_id"))
    of, n = scratch.counted(roots.join(least, "root").select(F.col("node").alias("paper"), "group_id"))
    if n <= SENT_KEYS:  # else the samples of a paper named very often are split by adaptive execution
        of = F.broadcast(of)
    return (
        samples.select(F.col("key").alias(key), F.col("least").alias("paper"))
        .join(of, "paper", "left")
        .select(key, F.coalesce("group_id", "paper").alias("group_id"))
    )


def split_groups(
    samples: DataFrame, scratch: Scratch, key: str = "qa_id", group: str = "group_id", proportions=PROPORTIONS, seed: int = 42
) -> DataFrame:
    """(key, group, split): whole groups in each split, sizes as near the proportions as they allow.

    A null group stands alone, as its key. The few large groups go first, each to the split that
    lacks most samples; the others follow in the order of their hashes and fill what is left, cut
    where the running total passes a split's size. The same input gives the same splits. An empty
    table gives no rows; a proportion of 0 leaves a split empty. ``key`` must be unique.
    """
    spark = samples.sparkSession
    own = samples.select(F.col(key), F.col(group)).withColumn(
        "_g", F.coalesce(F.col(group).cast("string"), F.concat(F.lit("\u0000"), F.col(key).cast("string")))
    )
    sizes = scratch.table(
        own.groupBy("_g").agg(F.count("*").alias("n")).withColumn("h", F.xxhash64(F.lit(seed), "_g"))
    )
    total = sizes.agg(F.sum("n")).first()[0] or 0
    names = [name for name, _ in proportions]
    whole = sum(p for _, p in proportions)
    lack = {name: total * p / whole for name, p in proportions}
    placed = []
    large = F.col("n") > max(1.0, LARGE * total)
    for r in sorted(sizes.where(large).collect(), key=lambda r: (-r["n"], r["h"], r["_g"])):
        name = max(names, key=lambda x: lack[x])
        lack[name] -= r["n"]
        placed.append((r["_g"], name))
    first = spark.createDataFrame(placed, "_g string, split string")

    rest = sizes.where(~large).withColumn("bucket", F.shiftrightunsigned("h", 52).cast("int"))
    sums = {r["bucket"]: r["n"] for r in rest.groupBy("bucket").agg(F.sum("n").alias("n")).collect()}
    before, running = [], 0
    for b in sorted(sums):
        before.append((b, running))
        running += sums[b]
    room = {name: max(0.0, lack[name]) for name in names}
    scale = running / (sum(room.values()) or 1.0)
    offsets = spark.createDataFrame(before, "bucket int, before bigint")
    order = Window.partitionBy("bucket").orderBy("h", "_g").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("before") + F.sum("n").over(order) - F.col("n") / 2
    choice, edge = F.lit(names[-1]), running
    for name in reversed(names[1:]):
        edge -= room[name] * scale
        previous = names[names.index(name) - 1]
        choice = F.when(F.col("middle") < F.lit(float(edge)), F.lit(previous)).otherwise(choice)
    others = rest.join(F.broadcast(offsets), "bucket").withColumn("middle", middle).select("_g", choice.alias("split"))
    # The large groups are few and sent to the samples, so no key of the join that is left is hot.
    placed = own.join(F.broadcast(first.withColumnRenamed("split", "_large")), "_g", "left")
    rest = placed.where("_large is null").drop("_large").join(others, "_g").select(key, group, "split")
    return placed.where("_large is not null").select(key, group, F.col("_large").alias("split")).unionByName(rest)
