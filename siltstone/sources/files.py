"""Folders of files as documents: text and Markdown, PDF with its tables, images with what is read from them.

A file that can't be read never fails the job: PDF and images give empty text,
undecodable text gives a row with its error and no content.  Names that start
with a dot or an underscore are skipped, as Spark's file sources do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions.formatting import file_kind
from siltstone.operators import tables
from siltstone.plugins import ImageReader, NoImages, NoPdf, PdfReader
from siltstone.schemas import METADATA
from siltstone.session import materialize, ship


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content, kind) of the files below ``folder`` that are of a known kind."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.withColumn("kind", file_kind(F.col("path"))).where(F.col("kind").isNotNull())


def metadata(**values: Column) -> Column:
    """The metadata struct with the given keys, the others null."""
    return F.struct(*(values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA.fields))


def texts(files: DataFrame) -> DataFrame:
    """One document for each text file, read whole as UTF-8."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, error = [], []
            for x in b.column(1).to_pylist():
                try:
                    content.append((x or b"").decode("utf-8"))
                    error.append(None)
                except UnicodeDecodeError as e:
                    content.append(None)
                    error.append(str(e))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.string()), pa.array(error, pa.string())], ["path", "content", "error"])

    read = files.where("kind = 'text'").select("path", "content").mapInArrow(decode, "path string, content string, error string")
    return read.select("path", F.lit(0).alias("doc_seq"), "content", metadata(source=F.col("path")).alias("metadata"), "error")


def pdfs(files: DataFrame, reader: PdfReader) -> DataFrame:
    """Of each PDF its text, then of each page's tables: Markdown, JSON, and a sentence for each row.

    A table without rows ends its page.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content, found, error = [], [], []
            for x in b.column(1).to_pylist():
                text, rows, failed = "", [], None
                try:
                    text = reader.text(x)
                except Exception as e:  # noqa: BLE001 - whatever a parser raises
                    failed = str(e)
                try:
                    for page, its in reader.tables(x):
                        for n, t in enumerate(its):
                            if not t:
                                break
                            rows.append({"page": page, "table_ix": n, "cells": [[None if c is None else str(c) for c in r] for r in t]})
                except Exception as e:  # noqa: BLE001
                    failed = failed or str(e)
                content.append(text)
                found.append(rows)
                error.append(failed)
            kind = pa.list_(pa.struct([("page", pa.int32()), ("table_ix", pa.int32()), ("cells", pa.list_(pa.list_(pa.string())))]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, pa.string()), pa.array(found, kind), pa.array(error, pa.string())], ["path", "content", "tables", "error"])

    schema = "path string, content string, tables array<struct<page: int, table_ix: int, cells: array<array<string>>>>, error string"
    parsed = materialize(files.where("kind = 'pdf'").select("path", "content").mapInArrow(parse, schema), "pdf")
    source = F.col("path")
    text = parsed.select("path", F.lit(0).alias("doc_seq"), "content", metadata(source=source).alias("metadata"), "error")
    flat = parsed.select("path", F.posexplode("tables").alias("n", "t")).select("path", "n", "t.page", "t.cells")
    flat = flat.withColumns({"head": tables.header(F.col("cells")), "rows": tables.body(F.col("cells"))})
    page = F.col("page")
    as_md = flat.select("path", "n", F.lit(0).alias("part"), tables.markdown(F.col("head"), F.col("rows")).alias("content"), metadata(source=source, page=page, table_md=F.lit(True)).alias("metadata"))
    as_json = flat.select("path", "n", F.lit(1).alias("part"), tables.json(F.col("head"), F.col("rows")).alias("content"), metadata(source=source, page=page, table_json=F.lit(True)).alias("metadata"))
    rows = tables.row_sentences(flat, "head", "rows", keep=("path", "n", "page"))
    as_rows = rows.select("path", "n", (F.col("row_ix") + 2).alias("part"), F.col("sentence").alias("content"), metadata(source=source, page=page, table_row=F.lit(True)).alias("metadata"))
    # a file's tables come after its text, one after the other, whatever their length
    every = as_md.unionByName(as_json).unionByName(as_rows)
    number = F.row_number().over(Window.partitionBy("path").orderBy("n", "part")).alias("doc_seq")
    every = every.select("path", number, "content", "metadata", F.lit(None).cast("string").alias("error"))
    return text.unionByName(every)


def fused(caption: Column, chart: Column, ocr: Column) -> Column:
    """What was read from an image, joined where it isn't empty."""
    return F.concat_ws(" • ", *(F.nullif(F.coalesce(c, F.lit("")), F.lit("")) for c in (caption, chart, ocr)))


def images(files: DataFrame, reader: ImageReader) -> tuple[DataFrame, DataFrame]:
    """The text documents of the images, and the images themselves (empty content)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells: tuple = ([], [], [], [])
            for x in b.column(1).to_pylist():
                try:
                    values = (*reader.read(x), None)
                except Exception as e:  # noqa: BLE001
                    values = ("", "", "", str(e))
                for c, v in zip(cells, values):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.string()) for c in cells)], ["path", "caption", "chart", "ocr", "error"])

    seen = files.where("kind = 'image'")
    texts_ = seen.select("path", "content").mapInArrow(read, "path string, caption string, chart string, ocr string, error string")
    flags = metadata(image_path=F.col("path"), caption=F.lit(True), chartqa=F.col("chart") != "", ocr=F.col("ocr") != "")
    documents = texts_.select("path", F.lit(0).alias("doc_seq"), fused(F.col("caption"), F.col("chart"), F.col("ocr")).alias("content"), flags.alias("metadata"), "error")
    pictures = seen.select("path", F.lit("").alias("document"), metadata(image_path=F.col("path")).alias("metadata"), "content")
    return documents, pictures


def load_folder(spark: SparkSession, folder: str, *, image_reader: ImageReader | None = None, pdf_reader: PdfReader | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, images) of a folder; see the parts above."""
    ship(spark)
    files = scan(spark, folder)
    read, pictures = images(files, image_reader or NoImages())
    return texts(files).unionByName(pdfs(files, pdf_reader or NoPdf())).unionByName(read), pictures
