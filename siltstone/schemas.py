"""Row shapes of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

# Keys that a document's metadata may carry; an absent key is null, and null and false read alike.
METADATA = T.StructType(
    [
        T.StructField("source", T.StringType()),
        T.StructField("image_path", T.StringType()),
        T.StructField("page", T.IntegerType()),
        *(T.StructField(flag, T.BooleanType()) for flag in ("table_md", "table_json", "table_row", "caption", "chartqa", "ocr")),
    ]
)

#: A document with its place: the file's path, and its number within the file.
DOCUMENT = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("doc_seq", T.IntegerType()),
        T.StructField("content", T.StringType()),
        T.StructField("metadata", METADATA),
    ]
)

#: A row of a collection.
STORED = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("document", T.StringType()),
        T.StructField("metadata", METADATA),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

# Flags that a source label shows, in their order.
LABEL_FLAGS = ("table_md", "table_json", "table_row", "chartqa", "ocr")

# Sizes that decide what a question retrieves.
INGEST_WINDOW = 480
QUERY_WINDOW = 512
WINDOW_OVERLAP = 32
CHUNK_CHARS = 800
CHUNK_OVERLAP = 80
ANN_CANDIDATES = 60
TOP_MMR = 40
MMR_WEIGHT = 0.6
TOP_BM25 = 10
TOP_RERANK = 10
TOP_IMAGE = 2
SNIPPET_CHARS = 200
EMBED_BATCH = 96
