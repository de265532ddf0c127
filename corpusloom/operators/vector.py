"""Exact cosine search of a set of query vectors against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from ..runtime import spread

#: Query vectors that one pass over the corpus compares.
QUERY_BLOCK = 4096
#: Corpus vectors multiplied at once in a worker.
ROW_BLOCK = 4096


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two arrays, null if a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x.cast("array<double>"), y.cast("array<double>"), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, key, distance, rank): the ``k`` nearest rows of each query by cosine distance.

    ``queries`` has query_id and the vector column; they are broadcast to the workers in blocks of
    QUERY_BLOCK, one pass over the corpus each. A task carries its best ``k`` of each query from
    batch to batch and gives them once, so at most tasks x queries x k rows are shuffled, however
    long the corpus is. Distances are rounded to six places and ties go to the lesser key. Null
    and zero vectors, and those of another length than the first query's, match nothing.
    """
    id_type, key_type = queries.schema["query_id"].dataType, corpus.schema[key].dataType.simpleString()
    wanted = queries.where(F.col(vector).isNotNull()).select("query_id", vector)
    n = wanted.count()
    blocks = max(1, -(-n // QUERY_BLOCK))
    out = None
    for i in range(blocks):
        own = wanted if blocks == 1 else wanted.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        rows = sorted((r["query_id"], list(r[vector])) for r in own.collect())  # a block
        found = _block(rows, corpus.select(key, vector), k, key, id_type, key_type)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy("distance", key)
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of this width, the vectors), out of the Arrow buffers."""
    lengths = np.diff(column.offsets.to_numpy())
    ok = lengths == width
    if column.null_count:
        ok &= column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(ok)
    begin = column.offsets.to_numpy()[:-1][at]
    return at, values[begin[:, None] + np.arange(width)]


def _least(distance: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least of each column, ties to the upper rows; rows are in order of keys."""
    if len(distance) <= k:
        return np.argsort(distance, axis=0, kind="stable")
    edge = np.partition(distance, k - 1, axis=0)[k - 1]
    out = np.empty((k, distance.shape[1]), np.int64)
    for j in range(distance.shape[1]):
        near = np.flatnonzero(distance[:, j] <= edge[j])
        out[:, j] = near[np.argsort(distance[near, j], kind="stable")[:k]]
    return out


def _block(rows: list, corpus: DataFrame, k: int, key: str, id_type: DataType, key_type: str) -> DataFrame:
    own = to_arrow_type(id_type)
    width = len(rows[0][1]) if rows else 0
    rows = [(i, v) for i, v in rows if len(v) == width]
    matrix = np.array([v for _, v in rows], np.float64).reshape(len(rows), width)
    norms = np.linalg.norm(matrix, axis=1)
    live = np.isfinite(norms) & (norms > 0)
    ids = [i for (i, _), ok in zip(rows, live) if ok]
    sent = corpus.sparkSession.sparkContext.broadcast((ids, matrix[live] / norms[live, None]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = sent.value
        if not ids:
            return
        keys: np.ndarray | None = None  # the best so far: (k, queries)
        best: np.ndarray | None = None
        kind = None
        for b in batches:
            kind = b.schema.field(0).type
            for begin in range(0, b.num_rows, ROW_BLOCK):
                part = b.slice(begin, ROW_BLOCK)
                at, x = _matrix(part.column(1), width)
                at_valid = part.column(0).is_valid().to_numpy(zero_copy_only=False)[at]
                at, x = at[at_valid], x[at_valid]
                size = np.linalg.norm(x, axis=1)
                ok = np.isfinite(size) & (size > 0)
                at, x, size = at[ok], x[ok], size[ok]
                if not len(at):
                    continue
                named = np.array(part.column(0).take(pa.array(at)).to_pylist())
                order = np.argsort(named, kind="stable")
                named, distance = named[order], (np.round(1 - (x @ matrix.T) / size[:, None], 6) + 0.0)[order]  # no minus zero
                near = _least(distance, k)
                d, n = np.take_along_axis(distance, near, 0), named[near]
                if best is not None:
                    d, n = np.concatenate([best, d]), np.concatenate([keys, n])
                    first = np.lexsort((n, d), axis=0)[:k]
                    d, n = np.take_along_axis(d, first, 0), np.take_along_axis(n, first, 0)
                best, keys = d, n
        if best is not None:
            q = np.repeat(np.arange(len(ids))[None, :], len(best), axis=0).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[j] for j in q], own), pa.array(keys.ravel().tolist(), kind), pa.array(best.ravel())], names=["query_id", key, "distance"]
            )

    return spread(corpus).mapInArrow(run, f"query_id {id_type.simpleString()}, `{key}` {key_type}, distance double")
