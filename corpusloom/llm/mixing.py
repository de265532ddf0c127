"""Mixing sources to target shares of tokens by pivotal dependent rounding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

#: The plan of the mix is made on the driver from one row per target; more rows than this are refused.
MOST_TARGETS = 10_000
#: Residual documents of this many tasks meet in one task of the next level of the reduction.
FAN_IN = 16


def plan_amounts(sizes: dict[str, int], targets: dict[str, tuple[float, int]], total: float | None = None) -> dict[str, float]:
    """Tokens each source is to give.

    ``sizes`` are the tokens a source has, ``targets`` its (share, max_repeats). Shares are taken
    relative to the sources that have tokens. Without ``total`` the mix is the largest in which
    every such source reaches its share. With a larger ``total`` the sources too small for it
    give all they may (size times max_repeats) and the rest divide what remains by their shares,
    so the shares reached then differ from the targets.
    """
    live = {s: (share, sizes[s] * times) for s, (share, times) in targets.items() if share > 0 and times > 0 and sizes.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(share for share, _ in live.values())
    if total is None:
        total = min(cap * whole / share for share, cap in live.values())
    out: dict[str, float] = {}
    left = min(total, sum(cap for _, cap in live.values()))
    while live:
        whole = sum(share for share, _ in live.values())
        # A cap reached exactly counts as full only beyond rounding errors.
        full = {s: cap for s, (share, cap) in live.items() if left * share / whole > cap * (1 + 1e-12)}
        if not full:
            out |= {s: min(cap, left * share / whole) for s, (share, cap) in live.items()}
            break
        out |= full
        left -= sum(full.values())
        live = {s: v for s, v in live.items() if s not in full}
    return out


def _uniform(seed: int, *parts) -> float:
    return xxhash.xxh64_intdigest("\x1f".join(map(str, parts)).encode(), seed=seed) / 2.0**64


def _pivot(seed: int, level: int):
    """Rounds fractional documents pairwise; each source leaves at most one of them in a task.

    Two documents of one source move tokens between each other, either way with the odds that
    keep each one's expectation, until one is wholly in or out; their tokens together never
    change. The other stays fractional and meets the next document.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: dict[str, list] = {}
        for f in frames:
            done = []
            for key, source, n, whole, p in zip(f["doc_id"], f["source"], f["n_tokens"], f["whole"], f["part"]):
                if p <= 1e-9 or p >= 1 - 1e-9:
                    done.append((key, source, n, whole + round(p), 0.0, True))
                    continue
                held = open_.get(source)
                if held is None:
                    open_[source] = [key, n, whole, p]
                    continue
                k, m, w, q = held
                up = min((1 - q) * m, p * n)  # tokens to the held document
                down = min(q * m, (1 - p) * n)
                if _uniform(seed, level, k, key) * (up + down) < down:
                    q, p = q + up / m, p - up / n
                else:
                    q, p = q - down / m, p + down / n
                out = []
                for a, an, aw, ap in ((k, m, w, q), (key, n, whole, p)):
                    if ap <= 1e-9 or ap >= 1 - 1e-9:
                        done.append((a, source, an, aw + round(ap), 0.0, True))
                    else:
                        out.append([a, an, aw, ap])
                if out:
                    open_[source] = out[0]
                else:
                    del open_[source]
            yield pd.DataFrame(done, columns=["doc_id", "source", "n_tokens", "whole", "part", "settled"])
        yield pd.DataFrame(
            [(k, s, n, w, p, False) for s, (k, n, w, p) in open_.items()],
            columns=["doc_id", "source", "n_tokens", "whole", "part", "settled"],
        )

    return run


def mix_sources(
    documents: DataFrame, targets: DataFrame, scratch: Scratch, total_tokens: float | None = None, seed: int = 42
) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document is used.

    ``documents`` has doc_id (unique), source and n_tokens, ``targets`` source, target_share and
    max_repeats; other columns are left out. A document's expected copies are its source's amount
    (see :func:`plan_amounts`) by the source's tokens; the fraction is rounded by dependent
    rounding, which keeps each source's tokens to within one document. Documents without a target
    source or without tokens have 0 copies or are left out (no target). Targets with a null
    source, a share or max_repeats that is null or not above 0 count as none; of repeated targets
    of a source the shares add up and the least max_repeats holds. Empty tables give no rows.

    Rounding runs in one pass over the documents, then on a tree of ever fewer tasks over the
    one open document per source that each task leaves.
    """
    wanted = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy("source")
        .agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("times"))
    )
    rows = wanted.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} target sources")
    goal = {r["source"]: (r["share"], r["times"]) for r in rows}
    named = documents.where(F.col("source").isin(list(goal))) if goal else documents.limit(0)
    tokens = scratch.table(named.select("doc_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens")))
    sizes = {r["source"]: r["n"] for r in tokens.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    amounts = plan_amounts(sizes, goal, total_tokens)
    each = {s: amounts[s] / sizes[s] for s in amounts}
    spark = documents.sparkSession
    plan = spark.createDataFrame(
        [(s, int(math.floor(c + 1e-9)), max(0.0, c - math.floor(c + 1e-9))) for s, c in each.items()],
        "source string, whole bigint, part double",
    )
    live = tokens.where("n_tokens > 0").join(F.broadcast(plan), "source").select("doc_id", "source", "n_tokens", "whole", "part")
    schema = "doc_id {}, source string, n_tokens bigint, whole bigint, part double, settled boolean".format(
        tokens.schema["doc_id"].dataType.simpleString()
    )
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    settled, level = [], 0
    current = live
    while True:
        # Sorted within a fixed number of hash partitions, a lost task is done again alike.
        rounded = scratch.table(
            current.repartition(n, "doc_id").sortWithinPartitions("doc_id").mapInPandas(_pivot(seed, level), schema)
        )
        settled.append(rounded.where("settled"))
        current = rounded.where("not settled").drop("settled")
        level += 1
        if n == 1:
            break
        n = math.ceil(n / FAN_IN)
    last = current.withColumn("u", F.xxhash64(F.lit(seed), "doc_id").cast("double") / F.lit(2.0**64) + 0.5).withColumn(
        "whole", F.col("whole") + (F.col("u") < F.col("part")).cast("bigint")
    )
    out = last.drop("u", "part")
    for s in settled:
        out = out.unionByName(s.drop("part", "settled"))
    idle = tokens.where("n_tokens <= 0").select("doc_id", "source", "n_tokens", F.lit(0).cast("bigint").alias("whole"))
    return out.unionByName(idle).select("doc_id", "source", "n_tokens", F.col("whole").alias("copies"))


def share_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per source of ``targets``: what it has, what it gives, and its shares.

    Columns: source, target_share, max_repeats, documents, tokens, most_copies, mix_tokens,
    mix_share (null for an empty mix). A source without documents reports zeros.
    """
    goal = (
        targets.where("source is not null")
        .groupBy("source")
        .agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    )
    used = mix.groupBy("source").agg(
        F.count("*").alias("documents"),
        F.sum("n_tokens").alias("tokens"),
        F.max("copies").alias("most_copies"),
        F.sum(F.col("n_tokens") * F.col("copies")).alias("mix_tokens"),
    )
    filled = goal.join(used, "source", "left").na.fill(0, ["documents", "tokens", "most_copies", "mix_tokens"])
    whole = F.sum("mix_tokens").over(Window.partitionBy(F.lit(1)))  # over the targets only
    return filled.withColumn("whole", whole).select(
        "source",
        "target_share",
        "max_repeats",
        "documents",
        "tokens",
        "most_copies",
        "mix_tokens",
        F.expr("try_divide(cast(mix_tokens as double), cast(whole as double))").alias("mix_share"),
    )
