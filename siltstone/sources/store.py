"""The two collections of a store: text and images, as Parquet under one folder.

Collections are written aside and moved into place, and a marker comes last, so
that a store is either whole or absent.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.schemas import STORED
from siltstone.session import materialize

MARKER = "_READY"
ARRIVALS = "arrivals"


def numbered(df: DataFrame, order: list[str], prefix: str, start: int = 0) -> DataFrame:
    """``df`` with ``id``: the prefix and the row's place in the given order, without gaps and without one big partition.

    The rows are range-sorted and written; only each partition's count goes to the driver.
    """
    placed = materialize(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftrightunsigned(F.col("_m"), 33).cast("long"), F.col("_m").bitwiseAND((1 << 33) - 1)
    counts = sorted((r[0], r[1]) for r in placed.groupBy(part.alias("p")).count().toLocalIterator())
    offsets, at = [], start
    for p, n in counts:
        offsets.append((p, at))
        at += n
    if not offsets:
        return placed.drop("_m").withColumn("id", F.lit(None).cast("string"))
    table = df.sparkSession.createDataFrame(offsets, "_p long, _at long")
    joined = placed.withColumn("_p", part).join(F.broadcast(table), "_p")  # a row for each partition
    return joined.withColumn("id", F.concat(F.lit(prefix), (F.col("_at") + within).cast("string"))).drop("_m", "_p", "_at")


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _exists(self, path: str) -> bool:
        fs, p = self._fs(path)
        return fs.exists(p)

    def exists(self) -> bool:
        return self._exists(self.root)

    def ready(self) -> bool:
        return self._exists(f"{self.root}/{MARKER}")

    def has(self, name: str) -> bool:
        return self.ready() and self._exists(f"{self.root}/{name}")

    def arrived(self) -> bool:
        """Whether files have been stored since, as they arrived."""
        return self._exists(f"{self.root}/{ARRIVALS}")

    def _made(self, name: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.root}/{name}") if self.has(name) else None

    def collection(self, name: str) -> DataFrame | None:
        """The rows of a collection, with the texts that arrived since; None where it is absent."""
        rows = self._made(name)
        if name != "text" or not self.arrived():
            return rows
        later = self.spark.read.schema(STORED).parquet(f"{self.root}/{ARRIVALS}")
        later = later.select(*STORED.fieldNames())
        return later if rows is None else rows.select(*STORED.fieldNames()).unionByName(later)

    def count(self, name: str) -> int:
        rows = self.collection(name)
        return 0 if rows is None else rows.count()

    def empty(self, name: str) -> bool:
        rows = self.collection(name)
        return rows is None or rows.isEmpty()

    def create(self, text: DataFrame, images: DataFrame | None) -> bool:
        """Write both collections; False, and nothing done, if there are text vectors already."""
        made = self._made("text")
        if made is not None and not made.isEmpty():
            return False
        aside = f"{self.root}/.writing-{uuid.uuid4().hex}"
        for name, rows in (("text", text), ("images", images)):
            if rows is None:
                continue
            rows.write.parquet(f"{aside}/{name}")
            fs, target = self._fs(f"{self.root}/{name}")
            if fs.exists(target):
                fs.delete(target, True)
            fs.rename(self._fs(f"{aside}/{name}")[1], target)
        fs, p = self._fs(aside)
        fs.delete(p, True)
        self._fs(f"{self.root}/{MARKER}")[0].create(self._fs(f"{self.root}/{MARKER}")[1]).close()
        return True


def latest(df: DataFrame, key: str, at: str) -> DataFrame:
    """One row for each key, the one delivered last; keys hold few rows each, and null keys are dropped."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(at)))
    return df.where(F.col(key).isNotNull()).withColumn("_n", rank).where("_n = 1").drop("_n")
