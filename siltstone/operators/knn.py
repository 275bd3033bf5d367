"""Exact nearest neighbours of a stated set of questions among all rows of a store.

A task keeps the best of what it has read, for every question, so that little
is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from siltstone.session import ship

METRICS = ("l2", "cosine")


def _matrix(vectors: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are usable, and their values: ``dim`` finite values, not all zero."""
    import pyarrow.compute as pc

    good = np.flatnonzero(pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False) == dim)
    values = vectors.take(pa.array(good)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    fine = np.isfinite(values).all(1) & (values != 0).any(1)
    return good[fine], values[fine]


def _scores(questions: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Less is nearer: squared distance, or 1 - cosine; rounded so that equal rows tie."""
    if metric == "cosine":
        q = questions / np.linalg.norm(questions, axis=1, keepdims=True)
        r = rows / np.linalg.norm(rows, axis=1, keepdims=True)
        return np.round(1 - q @ r.T, 9)
    return np.round((questions**2).sum(1)[:, None] + (rows**2).sum(1)[None, :] - 2 * (questions @ rows.T), 9)


class Best:
    """The ``k`` best of what was read, for every question of a block: by distance, ties to the lower id."""

    def __init__(self, ids: np.ndarray, asked: np.ndarray, k: int, metric: str, without_self: bool):
        self.ids, self.asked, self.k, self.metric, self.without_self = ids, asked, k, metric, without_self
        self.question = np.zeros(0, np.int64)
        self.distance = np.zeros(0)
        self.found = np.zeros(0, ids.dtype)

    def read(self, names: np.ndarray, values: np.ndarray) -> None:
        scores = _scores(self.asked, values, self.metric)
        if self.without_self:
            scores[self.ids[:, None] == names[None, :]] = np.inf
        limit = np.full(len(self.ids), np.inf)
        full = np.bincount(self.question, minlength=len(self.ids)) >= self.k
        np.maximum.at(worst := np.full(len(self.ids), -np.inf), self.question, self.distance)
        limit[full] = worst[full]
        if scores.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(scores, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero((scores <= limit[:, None]) & np.isfinite(scores))
        question, distance = np.append(self.question, q), np.append(self.distance, scores[q, r])
        found = np.append(self.found.astype(object), names[r].astype(object)) if names.dtype == object else np.append(self.found.astype(names.dtype), names[r])
        order = np.lexsort((np.unique(found, return_inverse=True)[1], distance, question))
        question = question[order]
        order = order[np.arange(len(order)) - np.searchsorted(question, question) < self.k]
        self.question, self.distance, self.found = np.append(self.question, q)[order], distance[order], found[order]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.ids[self.question], self.found, self.distance


def _names(ids: pa.Array) -> np.ndarray:
    return ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) else np.array(ids.to_pylist(), object)


def nearest(
    questions: DataFrame, store: DataFrame, *, question_id: str, question_vector: str, id: str, vector: str, k: int, dim: int, metric: str = "l2", without_self: bool = False,
    block: int = 4096, cell_rows: int = 65_536,
) -> DataFrame:
    """(question_id, rank, id, distance): the ``k`` nearest rows for every question, nearest first, ties to the lower id.

    Vectors that aren't ``dim`` finite values, or are all zero, neither ask nor
    answer.  ``without_self`` leaves out the row with the question's own id.

    Up to ``block`` questions are sent to the tasks that read the store.  More
    are cut into blocks of about that size and the store into cells of about
    ``cell_rows``, and every pair of these is a group of one join; the plan is
    the same for any number of questions, and none goes to the driver.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    ship(store.sparkSession)
    q_kind, kind = questions.schema[question_id].dataType.simpleString(), store.schema[id].dataType.simpleString()
    out = f"question {q_kind}, id {kind}, distance double"
    shape = to_arrow_schema(StructType.fromDDL(out))
    rows = store.select(F.col(id).alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    asked = questions.select(F.col(question_id).alias("id"), F.col(question_vector).alias("v")).where("id is not null and v is not null")

    def read(best: Best, b: pa.RecordBatch | pa.Table, step: int = 8192) -> None:
        for at in range(0, b.num_rows, step):
            part = b.slice(at, step)
            ids, vectors = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (part.column("id"), part.column("v")))
            good, values = _matrix(vectors, dim)
            if len(good):
                best.read(_names(ids.take(pa.array(good))), values)

    def result(best: Best) -> dict[str, list]:
        question, found, distance = best.rows()
        return {"question": question.tolist(), "id": found.tolist(), "distance": distance.tolist()}

    head = asked.limit(block + 1).collect()
    if len(head) <= block:
        vectors = [r["v"] for r in head]
        good, values = _matrix(pa.array(vectors, pa.list_(pa.float64())), dim)
        ids = _names(pa.array([r["id"] for r in head]).take(pa.array(good))) if len(good) else np.zeros(0, np.int64)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(ids, values, k, metric, without_self)
            for b in batches:
                if len(ids):
                    read(best, b)
            yield pa.RecordBatch.from_pydict(result(best), schema=shape)

        found = rows.mapInArrow(scan, out)
    else:
        blocks, cells = -(-asked.count() // block), max(1, -(-rows.count() // cell_rows))

        def spread(df: DataFrame, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
            every = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
            return df.select(F.pmod(F.xxhash64("id"), F.lit(n_own)).cast("int").alias(own), "id", "v", every)

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            good, values = _matrix(left.column("v").combine_chunks(), dim) if left.num_rows else (np.zeros(0, int), None)
            if not len(good) or not right.num_rows:
                return shape.empty_table()
            best = Best(_names(left.column("id").combine_chunks().take(pa.array(good))), values, k, metric, without_self)
            read(best, right)
            return pa.Table.from_pydict(result(best), schema=shape)

        left, right = spread(asked, "block", blocks, "cell", cells), spread(rows, "cell", cells, "block", blocks)
        found = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(compare, out)
    rank = F.row_number().over(Window.partitionBy("question").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("question").alias(question_id), "rank", F.col("id").alias(id), "distance")
