"""The engine's queries over the test tables.

Searches ask with every row whose id is divisible by 20, against all rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.functions import formatting
from siltstone.functions.vectors import usable
from siltstone.operators import bm25, chunking, embedding, fusion, knn, mmr, rerank, tables
from siltstone.plans.retrieval import Corpus, context, retrieve
from siltstone.plugins import HashEmbedder
from siltstone.session import materialize, table
from siltstone.sources.files import fused

EVERY = 20
DIM = 64
FLAGS = ("table_md", "table_json", "table_row", "caption", "chartqa", "ocr")


def stored(spark: SparkSession, d: str, name: str) -> DataFrame:
    """The usable rows of a collection, each id once (rows that repeat hold the same)."""
    return table(spark, d, name).dropDuplicates(["vec_id"]).where(usable("embedding", DIM))


def asking(df: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    return df.where(F.col(id) % EVERY == 0).select(F.col(id).alias("query_id"), F.col(vector).alias("qvec"))


def _knn(rows: DataFrame, k: int, metric: str, without_self: bool = False) -> DataFrame:
    return knn.nearest(
        asking(rows), rows, question_id="query_id", question_vector="qvec", id="vec_id", vector="embedding", k=k, dim=DIM, metric=metric, without_self=without_self
    )


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def knn_l2_top60(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_knn(table(spark, d, "embeddings"), 60, "l2"), "distance")


def knn_cosine_top60(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_knn(table(spark, d, "embeddings"), 60, "cosine"), "distance")


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_knn(stored(spark, d, "text_store"), 5, "cosine", without_self=True), "distance")


def image_knn_top2(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_knn(stored(spark, d, "image_store"), 2, "l2"), "distance")


def mmr_top40(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings")
    near = materialize(_knn(rows, 60, "l2"), "near")
    joined = near.join(asking(rows), "query_id").join(rows.select("vec_id", "embedding"), "vec_id")
    return mmr.diversify(joined, question_id="query_id", question_vector="qvec", id="vec_id", vector="embedding", k=40, weight=0.6)


def mean_pool_by_label(spark: SparkSession, d: str) -> DataFrame:
    return rounded(embedding.mean_by_key(table(spark, d, "embeddings"), "label", "embedding"), "mean")


def embed_documents(spark: SparkSession, d: str) -> DataFrame:
    rows = embedding.embed_column(table(spark, d, "documents").select("doc_id", "text"), "text", HashEmbedder(DIM))
    flat = rows.select("doc_id", F.posexplode("embedding").alias("pos", "x"))
    return flat.select("doc_id", "pos", F.round(F.col("x").cast("double"), 6).alias("value"))


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", chunking.tokens(F.col("text")).alias("tokens"))
    cut = chunking.token_windows(words, "tokens")
    return cut.select("doc_id", "window_ix", F.size("window").alias("n_tokens"), F.md5(F.array_join("window", " ")).alias("digest"))


def window_counts(spark: SparkSession, d: str) -> DataFrame:
    n = F.size(chunking.tokens(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.size(chunking.window_starts(n, 480, 32)).alias("windows"))


def md_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "doc_records").dropDuplicates(["rec_id"]).select("rec_id", F.col("page_content").alias("content"))
    return chunking.chunk_documents(rows)


def bm25_term_stats(spark: SparkSession, d: str) -> DataFrame:
    return rounded(bm25.build(table(spark, d, "documents"), "doc_id", "text").terms.select("term", "df", "idf"), "idf")


def bm25_doc_len(spark: SparkSession, d: str) -> DataFrame:
    return bm25.analysed(table(spark, d, "documents"), "doc_id", "text").select(F.col("doc").alias("doc_id"), "dl")


def _bm25(spark: SparkSession, d: str, k: int) -> DataFrame:
    index = bm25.build(table(spark, d, "documents"), "doc_id", "text")
    items = table(spark, d, "benchmark").select("item_id", "text")
    return bm25.search(index, items, question_id="item_id", question="text", id="doc_id", k=k)


def bm25_batch(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_bm25(spark, d, 10), "score")


def rerank_top10(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("question"))
    documents = table(spark, d, "documents").select("doc_id", F.col("text").alias("document"))
    candidates = materialize(_bm25(spark, d, 40), "bm25").withColumnRenamed("rank", "in_pos").drop("score")
    joined = candidates.join(items, "item_id").join(documents, "doc_id")
    best = rerank.rerank(joined, question_id="item_id", question="question", document="document", in_pos="in_pos")
    return rounded(best.select("item_id", "rank", "doc_id", "score"), "score")


def hybrid_fuse(spark: SparkSession, d: str) -> DataFrame:
    rows = stored(spark, d, "text_store")
    near = _knn(rows, 10, "cosine").select("query_id", "rank", "vec_id")
    asked = rows.where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "document")
    words = bm25.search(bm25.build(rows, "vec_id", "document"), asked, question_id="query_id", question="document", id="vec_id", k=10)
    return fusion.fuse(("vectors", near), ("words", words.select("query_id", "rank", "vec_id")), question_id="query_id").select("query_id", "in_pos", "src", "vec_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    fields = ("source", "image_path", "page", *FLAGS)
    return table(spark, d, "doc_records").dropDuplicates(["rec_id"]).withColumn("metadata", F.struct(*fields))


def source_labels(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("rec_id", formatting.source_label(F.col("metadata"), F.col("rec_id")).alias("label"))


def snippets(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).select("rec_id", formatting.snippet(F.coalesce("page_content", F.lit(""))).alias("snippet"))


def _top_context(spark: SparkSession, d: str) -> DataFrame:
    """Five lexical hits in the text collection for every held-out item."""
    rows = materialize(table(spark, d, "text_store").dropDuplicates(["vec_id"]).select("vec_id", "document", "metadata"), "text")
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    hits = bm25.search(bm25.build(rows, "vec_id", "document"), items, question_id="query_id", question="question", id="vec_id", k=5)
    return hits.withColumnRenamed("rank", "number").join(items, "query_id").join(rows, "vec_id")


def context_listing(spark: SparkSession, d: str) -> DataFrame:
    return context(_top_context(spark, d)).select("query_id", "listing")


def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    return context(_top_context(spark, d)).select("query_id", "prompt")


def ask_batch(spark: SparkSession, d: str) -> DataFrame:
    def rows(name: str, meta: F.Column) -> DataFrame:
        return materialize(stored(spark, d, name).select(F.col("vec_id").alias("doc_ix"), "document", meta.alias("metadata"), "embedding"), name)

    picture = F.struct(
        F.lit(None).cast("string").alias("source"), "image_path", F.lit(None).cast("int").alias("page"), *(F.lit(None).cast("boolean").alias(f) for f in FLAGS)
    )
    corpus = Corpus.of(rows("text_store", F.col("metadata")), rows("image_store", picture), DIM)
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    return context(retrieve(items, corpus)).select("query_id", "listing", "prompt")


def collection_counts(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name in ("text_store", "image_store"):
        rows = table(spark, d, name)
        good = F.when(usable("embedding", DIM), F.col("vec_id"))
        parts.append(rows.agg(F.lit(name).alias("collection"), F.count("*").alias("n_rows"), F.count_distinct("vec_id").alias("n_ids"), F.count_distinct(good).alias("n_usable")))
    return parts[0].unionByName(parts[1])


def file_type_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_files").select("file_id", formatting.file_kind(F.col("path")).alias("kind"))


def image_text_fusion(spark: SparkSession, d: str) -> DataFrame:
    name, mime = formatting.basename(F.col("path")), F.coalesce("mime", F.lit(""))
    chart, ocr = F.when(F.col("file_id") % 3 == 0, "").otherwise(mime), F.when(F.col("file_id") % 2 == 0, F.col("path")).otherwise("")
    return table(spark, d, "source_files").select("file_id", fused(name, chart, ocr).alias("content"), (chart != "").alias("chartqa"), (ocr != "").alias("ocr"))


def _region_tables(spark: SparkSession, d: str) -> DataFrame:
    """The nations of each region as a table of strings; every third name is missing."""
    name = F.when(F.col("n_nationkey") % 3 == 0, F.lit(None)).otherwise(F.col("n_name"))
    row = F.struct("n_nationkey", F.array(F.col("n_nationkey").cast("string"), name).alias("cells"))
    grouped = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(row)).alias("r"))
    return grouped.select("n_regionkey", F.array(F.lit("key"), F.lit("name")).alias("head"), F.transform("r", lambda x: x["cells"]).alias("rows"))


def table_markdown(spark: SparkSession, d: str) -> DataFrame:
    return _region_tables(spark, d).select("n_regionkey", tables.markdown(F.col("head"), F.col("rows")).alias("content"))


def table_json(spark: SparkSession, d: str) -> DataFrame:
    return _region_tables(spark, d).select("n_regionkey", tables.json(F.col("head"), F.col("rows")).alias("content"))


def table_row_sentences(spark: SparkSession, d: str) -> DataFrame:
    return tables.row_sentences(_region_tables(spark, d), "head", "rows", keep=("n_regionkey",))


def chat_turns(spark: SparkSession, d: str) -> DataFrame:
    """The messages of each conversation in order, repeated deliveries once, blank ones left out."""
    said = table(spark, d, "conversations").dropDuplicates(["conv_id", "turn"]).where(F.trim(F.coalesce("text", F.lit(""))) != "")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return said.select("conv_id", place.alias("place"), "role", F.trim("text").alias("content"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        knn_l2_top60, knn_cosine_top60, batch_knn, image_knn_top2, mmr_top40, mean_pool_by_label, embed_documents, token_windows, window_counts, md_chunks,
        bm25_term_stats, bm25_doc_len, bm25_batch, rerank_top10, hybrid_fuse, source_labels, snippets, context_listing, prompt_build, ask_batch,
        collection_counts, file_type_dispatch, image_text_fusion, table_markdown, table_json, table_row_sentences, chat_turns,
    )
}
