"""Ordered bag unions of result lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fuse(*lists: tuple[str, DataFrame], question_id: str, rank: str = "rank", dedup_on: str | None = None) -> DataFrame:
    """The lists one after the other, with ``src`` (the list's name) and ``in_pos`` (from 1, by question).

    Nothing is merged: a row that two lists hold stays twice, unless ``dedup_on``
    names the id whose first occurrence is kept.
    """
    parts = [df.withColumns({"src": F.lit(name), "_list": F.lit(i)}) for i, (name, df) in enumerate(lists)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    if dedup_on:
        seen = F.row_number().over(Window.partitionBy(question_id, dedup_on).orderBy("_list", rank))
        every = every.withColumn("_seen", seen).where("_seen = 1").drop("_seen")
    place = F.row_number().over(Window.partitionBy(question_id).orderBy("_list", rank))
    return every.withColumn("in_pos", place).drop("_list")
