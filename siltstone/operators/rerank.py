"""Rescoring of a question's few candidates by a pair model."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.plugins import OverlapReranker, Reranker
from siltstone.schemas import TOP_RERANK
from siltstone.session import ship


def rerank(
    candidates: DataFrame, *, question_id: str, question: str, document: str, in_pos: str, keep: int = TOP_RERANK, model: Reranker | None = None
) -> DataFrame:
    """``candidates`` with ``score`` and ``rank``: the best ``keep`` of every question; ties keep the order of ``in_pos``.

    An empty or null document is scored as a blank.
    """
    ship(candidates.sparkSession)
    scorer = model or OverlapReranker()
    schema = StructType([*candidates.schema.fields, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, d = (b.column(b.schema.get_field_index(c)).to_pylist() for c in (question, document))
            scores = scorer.score([(x or "", y or " ") for x, y in zip(q, d)])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([round(float(s), 9) for s in scores], pa.float64())], [*b.schema.names, "score"])

    rank = F.row_number().over(Window.partitionBy(question_id).orderBy(F.desc("score"), in_pos))
    return candidates.mapInArrow(run, schema).withColumn("rank", rank).where(F.col("rank") <= keep)
