"""Helpers shared by the training-text operators."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import ship

#: Blanks as the data description defines them.
BLANKS = " \t\r\n"


def unflagged(*, images: bool) -> Column:
    """True where none of the three table flags is set; without ``images``, also no image path."""
    plain = ~(
        F.coalesce(F.col("table_md"), F.lit(False))
        | F.coalesce(F.col("table_json"), F.lit(False))
        | F.coalesce(F.col("table_row"), F.lit(False))
    )
    return plain if images else plain & F.col("image_path").isNull()


def map_rows(df: DataFrame, schema: str, fn: Callable[[list, list], Iterator[tuple]], key: str, text: str) -> DataFrame:
    """Run ``fn(keys, texts)`` over Arrow batches of two columns; it yields row tuples of ``schema``."""
    ship(df.sparkSession)
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(fn(b.column(0).to_pylist(), b.column(1).to_pylist()))
            cols = list(zip(*rows)) if rows else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

    return df.select(F.col(key), F.col(text)).mapInArrow(run, schema)


class RepeatedIds:
    """A bit table of fixed size: tells for certain of most ids that they don't repeat."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def slots(hashes: np.ndarray, n_bits: int) -> np.ndarray:
        """Two places in the table for each hash."""
        h = hashes.view(np.uint64)
        return np.stack([h % np.uint64(n_bits), (h >> np.uint64(32)) % np.uint64(n_bits)]).astype(np.int64)

    def possible(self, hashes: np.ndarray) -> np.ndarray:
        return self.bits[self.slots(hashes, len(self.bits))].all(0) if len(hashes) else np.zeros(0, bool)

    @classmethod
    def of(cls, repeated: DataFrame, n_bits: int) -> RepeatedIds:
        """The table of the hashes ``h``; tasks make parts of it, which are put together before they go to the driver."""
        chunk = min(n_bits, 1 << 16)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            bits = np.zeros(n_bits, bool)
            for b in batches:
                bits[cls.slots(b.column(0).to_numpy(), n_bits).ravel()] = True
            for part, x in enumerate(bits.reshape(-1, chunk)):
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1)], pa.binary())], ["part", "bits"])

        def unite(t: pa.Table) -> pa.Table:
            every = np.stack([np.frombuffer(zlib.decompress(x), np.uint8) for x in t.column("bits").to_pylist()])
            return pa.table({"part": t.column("part").slice(0, 1), "bits": pa.array([np.bitwise_or.reduce(every, 0).tobytes()], pa.binary())})

        bits = np.zeros(n_bits, bool)
        parts = repeated.select("h").mapInArrow(mark, "part int, bits binary").groupBy("part").applyInArrow(unite, "part int, bits binary")
        for part, x in parts.toLocalIterator():
            bits[part * chunk : (part + 1) * chunk] = np.unpackbits(np.frombuffer(x, np.uint8))
        return cls(bits)


def rows_and_copies(df: DataFrame, key: str, text: str, table_bits: int) -> tuple[DataFrame, RepeatedIds, DataFrame]:
    """(rows, repeated, copies) of (k, t, h): key, text and the key's hash, neither null.

    Of ``rows``, those that ``repeated`` finds impossible to repeat stand alone.
    ``copies`` has the others in key order, so that rows of one key follow each
    other.  Only ids are shuffled to find out, and the rows of ``copies``.
    """
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t"), F.xxhash64(F.col(key)).alias("h")).where("k is not null and t is not null")
    repeated = RepeatedIds.of(rows.groupBy("h").count().where("count > 1"), 1 << table_bits)

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What may repeat; an id that does so within a batch is sent once, so that a hot one fills no partition."""
        for b in batches:
            b = b.filter(pa.array(repeated.possible(b.column(2).to_numpy())))
            first = dict(zip(reversed(b.column(0).to_pylist()), range(b.num_rows - 1, -1, -1)))
            yield b.take(pa.array(sorted(first.values()), pa.int64()))

    ship(df.sparkSession)
    return rows, repeated, rows.mapInArrow(thin, rows.schema).repartition("k").sortWithinPartitions("k")
