"""Embedding of texts of any length: windows over the tokens, one call for many, mean of the windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from siltstone.plugins import Embedder, ImageEmbedder, Tokenizer, WhitespaceTokenizer
from siltstone.schemas import EMBED_BATCH, INGEST_WINDOW, QUERY_WINDOW, WINDOW_OVERLAP
from siltstone.session import ship


def split_windows(items: list, size: int, overlap: int) -> list[list]:
    """All items if they fit (or there are none), else a window at every step."""
    if len(items) <= size:
        return [items]
    return [items[at : at + size] for at in range(0, len(items), size - overlap)]


def pooled(texts: list[str], embedder: Embedder, tokenizer: Tokenizer, *, size: int, overlap: int, batch: int, keep_short: bool) -> np.ndarray:
    """One float32 vector for each text: the mean of its windows' vectors, not normalised again.

    ``keep_short`` embeds a text of one window as it is, else its decoded tokens.
    """
    parts: list[str] = []
    counts: list[int] = []
    for t in texts:
        windows = split_windows(tokenizer.encode(t), size, overlap)
        counts.append(len(windows))
        parts += [t] if keep_short and len(windows) == 1 else [tokenizer.decode(w) for w in windows]
    if not texts:
        return np.zeros((0, embedder.dim), np.float32)
    vectors = np.concatenate([np.asarray(embedder.embed(parts[i : i + batch]), np.float32) for i in range(0, len(parts), batch)])
    starts = np.cumsum([0, *counts[:-1]])
    return (np.add.reduceat(vectors.astype(np.float64), starts) / np.array(counts)[:, None]).astype(np.float32)


def embed_column(
    df: DataFrame, text: str, embedder: Embedder, *, to: str = "embedding", tokenizer: Tokenizer | None = None, as_query: bool = False, batch: int = EMBED_BATCH,
) -> DataFrame:
    """``df`` with a vector for each text; a null text counts as ''.

    ``as_query``: the longer window of questions, and short texts as they are.
    """
    ship(df.sparkSession)
    size = QUERY_WINDOW if as_query else INGEST_WINDOW
    words = tokenizer or WhitespaceTokenizer()
    schema = StructType([*(f for f in df.schema.fields if f.name != to), StructField(to, ArrayType(FloatType()))])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            v = pooled(texts, embedder, words, size=size, overlap=WINDOW_OVERLAP, batch=batch, keep_short=as_query)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in names), pa.array(list(v), pa.list_(pa.float32()))], [*names, to])

    return df.mapInArrow(run, schema)


def embed_images(df: DataFrame, content: str, embedder: ImageEmbedder, *, to: str = "embedding", batch: int = 32) -> DataFrame:
    """``df`` without its ``content``, with a vector for each image; null where the model can't read it."""
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in (content, to)]
    schema = StructType([*kept, StructField(to, ArrayType(FloatType()))])

    def vectors(contents: list[bytes]) -> list[np.ndarray | None]:
        try:
            return list(np.asarray(embedder.embed_images(contents), np.float32))
        except Exception:  # noqa: BLE001 - whatever a model raises: the one image that it is about, alone
            return [None] if len(contents) == 1 else [v for c in contents for v in vectors([c])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = vectors([c or b"" for c in part.column(part.schema.get_field_index(content)).to_pylist()])
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(v, pa.list_(pa.float32()))], [*(f.name for f in kept), to])

    return df.mapInArrow(run, schema)


def mean_vector(vector: Column | str) -> Column:
    """Aggregate: element-wise mean in double precision.  Groups are the windows of one text; for large groups see :func:`mean_by_key`."""
    summed = F.aggregate(
        F.collect_list(vector), F.array().cast("array<double>"), lambda s, v: F.when(F.size(s) == 0, v.cast("array<double>")).otherwise(F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    )
    return F.transform(summed, lambda x: x / F.count(vector))


def mean_by_key(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, pos, mean): element-wise means of groups of any size, added up before the shuffle."""
    flat = df.select(key, F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
