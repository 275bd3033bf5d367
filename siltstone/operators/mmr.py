"""Maximal marginal relevance: near to the question, far from what is chosen already."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.schemas import MMR_WEIGHT, TOP_MMR
from siltstone.session import ship


def select(question: np.ndarray, candidates: np.ndarray, k: int, weight: float) -> list[int]:
    """Positions of the chosen candidates, in the order of choice; ties go to the earlier candidate.

    The largest similarity to the chosen ones is kept up to date, so each step
    costs one product for each candidate left.
    """
    if not len(candidates):
        return []
    unit = candidates / np.maximum(np.linalg.norm(candidates, axis=1, keepdims=True), 1e-300)
    to_question = unit @ (question / max(float(np.linalg.norm(question)), 1e-300))
    to_chosen = np.full(len(unit), -np.inf)
    open_ = np.ones(len(unit), bool)
    chosen: list[int] = []
    while len(chosen) < k and open_.any():
        score = to_question if not chosen else weight * to_question - (1 - weight) * to_chosen
        best = int(np.argmax(np.where(open_, np.round(score, 12), -np.inf)))
        chosen.append(best)
        open_[best] = False
        to_chosen = np.maximum(to_chosen, unit @ unit[best])
    return chosen


def diversify(
    candidates: DataFrame, *, question_id: str, question_vector: str, id: str, vector: str, rank: str = "rank", k: int = TOP_MMR, weight: float = MMR_WEIGHT
) -> DataFrame:
    """(question_id, mmr_rank, id) of the ``k`` chosen among each question's few candidates, which stand in the order of ``rank``."""
    ship(candidates.sparkSession)
    q_kind, kind = candidates.schema[question_id].dataType.simpleString(), candidates.schema[id].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        v = np.array(t.column("v").to_pylist(), np.float64)
        chosen = select(np.array(t.column("q")[0].as_py(), np.float64), v, k, weight)
        at = pa.array(chosen, pa.int64())
        return pa.table({question_id: t.column("question").take(at), "mmr_rank": pa.array(range(1, len(chosen) + 1), pa.int32()), id: t.column("id").take(at)})

    flat = candidates.select(
        F.col(question_id).alias("question"), F.col(rank).alias("rank"), F.col(id).alias("id"), F.col(vector).alias("v"), F.col(question_vector).alias("q")
    )
    return flat.groupBy("question").applyInArrow(run, f"{question_id} {q_kind}, mmr_rank int, {id} {kind}")
