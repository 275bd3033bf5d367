"""The path of a question: candidates, diversity, lexical hits, rescoring, images, context and prompt.

It runs for a table of questions at once; every step keeps ``query_id``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions import formatting
from siltstone.operators import bm25, embedding, fusion, knn, mmr, rerank
from siltstone.plugins import Embedder, HashEmbedder, OverlapReranker, Reranker, Tokenizer
from siltstone.session import materialize


@dataclass
class Corpus:
    """The collections with their lexical index.

    ``text``: (doc_ix, document, metadata, embedding); ``images``: the same, or None.
    """

    text: DataFrame
    images: DataFrame | None
    index: bm25.Index
    dim: int

    @classmethod
    def of(cls, text: DataFrame, images: DataFrame | None, dim: int) -> Corpus:
        return cls(text, images, bm25.build(text, "doc_ix", "document"), dim)


def answerable(questions: DataFrame, question: str = "question") -> DataFrame:
    """Questions stripped, blank ones left out."""
    return questions.withColumn(question, F.trim(F.coalesce(F.col(question), F.lit("")))).where(F.col(question) != "")


def retrieve(
    questions: DataFrame,
    corpus: Corpus,
    *,
    embedder: Embedder | None = None,
    image_embedder: Embedder | None = None,
    tokenizer: Tokenizer | None = None,
    reranker: Reranker | None = None,
    candidates: int = schemas.ANN_CANDIDATES,
    k_mmr: int = schemas.TOP_MMR,
    weight: float = schemas.MMR_WEIGHT,
    k_bm25: int = schemas.TOP_BM25,
    keep: int = schemas.TOP_RERANK,
    k_images: int = schemas.TOP_IMAGE,
) -> DataFrame:
    """(query_id, question, number, src, document, metadata) of the context of every question (query_id, question).

    A document that both the vectors and the words find is rescored twice and
    may take two places.  Images come last and are not rescored.
    """
    model = embedder or HashEmbedder(corpus.dim)
    asked = materialize(embedding.embed_column(answerable(questions).select("query_id", "question"), "question", model, to="qvec", tokenizer=tokenizer, as_query=True), "questions")
    near = knn.nearest(asked, corpus.text, question_id="query_id", question_vector="qvec", id="doc_ix", vector="embedding", k=candidates, dim=corpus.dim)
    near = materialize(near, "near")
    with_vectors = near.join(asked, "query_id").join(corpus.text.select("doc_ix", "embedding"), "doc_ix")
    chosen = mmr.diversify(with_vectors, question_id="query_id", question_vector="qvec", id="doc_ix", vector="embedding", k=k_mmr, weight=weight)
    words = bm25.search(corpus.index, asked, question_id="query_id", question="question", id="doc_ix", k=k_bm25)
    both = fusion.fuse(
        ("mmr", chosen.select("query_id", F.col("mmr_rank").alias("rank"), "doc_ix")), ("bm25", words.select("query_id", "rank", "doc_ix")), question_id="query_id"
    )
    both = materialize(both, "hits")  # of known, small size: the collection's rows are picked by it and not moved
    gathered = both.drop("rank").join(asked.select("query_id", "question"), "query_id").join(corpus.text.select("doc_ix", "document", "metadata"), "doc_ix")
    best = rerank.rerank(gathered, question_id="query_id", question="question", document="document", in_pos="in_pos", keep=keep, model=reranker or OverlapReranker())
    found = best.select("query_id", "question", "rank", "src", "document", "metadata")
    if corpus.images is None or k_images == 0 or corpus.images.isEmpty():
        return found.withColumnRenamed("rank", "number")
    in_images = asked if image_embedder is None else embedding.embed_column(asked.drop("qvec"), "question", image_embedder, to="qvec", tokenizer=tokenizer, as_query=True)
    in_images_dim = corpus.dim if image_embedder is None else image_embedder.dim
    pictures = knn.nearest(in_images, corpus.images, question_id="query_id", question_vector="qvec", id="doc_ix", vector="embedding", k=k_images, dim=in_images_dim)
    shown = pictures.join(asked.select("query_id", "question"), "query_id").join(corpus.images.select("doc_ix", "document", "metadata"), "doc_ix")
    every = fusion.fuse(("text", found), ("image", shown.select("query_id", "question", "rank", "document", "metadata")), question_id="query_id")
    return every.select("query_id", "question", F.col("in_pos").alias("number"), "src", "document", "metadata")


def context(found: DataFrame) -> DataFrame:
    """(query_id, question, listing, prompt) from the rows of :func:`retrieve`."""
    document, metadata, number = F.col("document"), F.col("metadata"), F.col("number")
    lines = found.select(
        "query_id", "question", "number", formatting.listing_line(document, metadata, number).alias("line"), formatting.prompt_block(document, metadata, number).alias("block")
    )
    grouped = lines.groupBy("query_id", "question").agg(
        formatting.in_order(F.col("number"), F.col("line"), "\n").alias("lines"), formatting.in_order(F.col("number"), F.col("block"), "\n\n").alias("blocks")
    )
    return grouped.select(
        "query_id", "question", F.concat(F.lit("\n🔎 Retrieved context:\n"), "lines").alias("listing"), formatting.prompt(F.col("question"), F.col("blocks")).alias("prompt")
    )

