"""Lexical retrieval: Okapi BM25 with a floor under negative idf.

The index is two written tables and the totals: segments of documents, each
with its postings by term in one row, so that no posting is ever shuffled; and
terms with their document frequency and idf.  A task scores its segments for
many questions at once and keeps the best.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import StructType

from siltstone.schemas import TOP_BM25
from siltstone.session import materialize, ship

K1, B, FLOOR = 1.5, 0.75, 0.25


@dataclass
class Index:
    """``segments``: (segment, docs, dl, terms, bounds, at, tf); ``terms``: (term, df, raw_idf, idf); totals."""

    segments: DataFrame
    terms: DataFrame
    n: int
    mean_length: float

    def save(self, path: str) -> None:
        """Write the index to a folder, its totals last."""
        self.segments.write.mode("overwrite").parquet(f"{path}/segments")
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        spark = self.terms.sparkSession
        spark.createDataFrame([(self.n, self.mean_length)], "n long, mean_length double").coalesce(1).write.mode("overwrite").parquet(f"{path}/totals")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Index:
        n, mean = spark.read.parquet(f"{path}/totals").first()
        return cls(spark.read.parquet(f"{path}/segments"), spark.read.parquet(f"{path}/terms"), n, mean)


def analysed(df: DataFrame, id: str, text: str) -> DataFrame:
    """(doc, dl, terms, tfs): lower-cased runs of non-blank characters with their counts; null is an empty text."""
    ship(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = [Counter((t or "").lower().split()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([sum(c.values()) for c in counts], pa.int32()), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32()))],
                ["doc", "dl", "terms", "tfs"],
            )

    return df.select(F.col(id).alias("doc"), F.col(text)).where("doc is not null").mapInArrow(run, f"doc {kind}, dl int, terms array<string>, tfs array<int>")


def segmented(df: DataFrame, id: str, text: str, segment_docs: int) -> DataFrame:
    """Segments of at most ``segment_docs`` documents: of each its documents with their lengths, and its postings by term.

    ``bounds`` has where each term's postings end, ``at`` their documents' places
    in the segment, ``tf`` their counts; all are 32-bit integers.
    """
    ship(df.sparkSession)
    kind = df.schema[id].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first in range(0, b.num_rows, segment_docs):
                part = b.slice(first, segment_docs)
                words = [(t or "").lower().split() for t in part.column(1).to_pylist()]
                number: dict[str, int] = {}
                flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int64, sum(map(len, words)))
                dl = [len(w) for w in words]
                keys, tf = np.unique(flat * len(words) + np.repeat(np.arange(len(words)), dl), return_counts=True)
                term, at = np.divmod(keys, max(1, len(words)))
                bounds = np.searchsorted(term, np.arange(len(number)), side="right")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([part.column(0).to_pylist()], pa.list_(arrow)), pa.array([dl], pa.list_(pa.int32())), pa.array([list(number)], pa.list_(pa.string())),
                        *(pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (bounds, at, tf)),
                    ],
                    ["docs", "dl", "terms", "bounds", "at", "tf"],
                )

    rows = df.select(F.col(id).alias("doc"), F.col(text)).where("doc is not null")
    cut = rows.mapInArrow(run, f"docs array<{kind.simpleString()}>, dl array<int>, terms array<string>, bounds binary, at binary, tf binary")
    return cut.withColumn("segment", F.monotonically_increasing_id())


def document_counts(segments: DataFrame) -> DataFrame:
    """(term, df) from the segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for terms, bounds in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ends = np.frombuffer(bounds, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(np.diff(ends, prepend=0).astype(np.int64))], ["term", "df"])

    return segments.select("terms", "bounds").mapInArrow(run, "term string, df long").groupBy("term").agg(F.sum("df").alias("df"))


def build(df: DataFrame, id: str, text: str, segment_docs: int = 4096) -> Index:
    """The index of all rows with an id."""
    segments = materialize(segmented(df, id, text, segment_docs), "bm25-segments")
    lengths = segments.select(F.size("docs").alias("n"), F.aggregate("dl", F.lit(0).cast("long"), lambda s, x: s + x).alias("words"))
    n, total = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    counts = document_counts(segments)
    raw = materialize(counts.withColumn("raw_idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "bm25-terms")
    mean = raw.agg(F.avg("raw_idf")).first()[0] or 0.0
    terms = raw.withColumn("idf", F.when(F.col("raw_idf") < 0, F.lit(FLOOR * mean)).otherwise(F.col("raw_idf")))
    return Index(segments, terms, n, total / n if n else 0.0)


class Asked:
    """A block of questions, by term, and the ``k`` best documents of each so far: by score, ties to the higher id."""

    def __init__(self, questions: list[tuple], k: int, mean_length: float):
        self.k, self.mean_length = k, mean_length
        self.ids = [q for q, _, _ in questions]
        self.by_term: dict[str, list[tuple[int, float]]] = {}
        for j, (_, terms, weights) in enumerate(questions):
            for t, w in zip(terms, weights):
                self.by_term.setdefault(t, []).append((j, w))
        self.best: list[list[tuple[float, object]]] = [[] for _ in questions]

    def read(self, docs: list, dl: list[int], terms: list[str], bounds: bytes, at: bytes, tf: bytes) -> None:
        ends, at_, tf_ = (np.frombuffer(x, np.int32) for x in (bounds, at, tf))
        length = K1 * (1 - B + B * np.array(dl, float) / (self.mean_length or 1.0))
        scores = np.zeros((len(self.ids), len(docs)))
        for i, t in enumerate(terms):
            asking = self.by_term.get(t)
            if asking:
                of = slice(ends[i - 1] if i else 0, ends[i])
                d, f = at_[of], tf_[of].astype(float)
                part = f * (K1 + 1) / (f + length[d])
                for j, w in asking:
                    scores[j, d] += w * part
        scores = np.round(scores, 9)
        kth = np.partition(scores, len(docs) - self.k, axis=1)[:, len(docs) - self.k] if len(docs) > self.k else np.full(len(self.ids), -np.inf)
        for j, row in enumerate(scores):
            limit = max(kth[j], self.best[j][-1][0] if len(self.best[j]) == self.k else -np.inf)
            near = np.flatnonzero(row >= limit)
            if len(near):
                self.best[j] = heapq.nlargest(self.k, chain(self.best[j], ((float(row[i]), docs[i]) for i in near)))

    def rows(self) -> dict[str, list]:
        found = [(q, d, s) for q, best in zip(self.ids, self.best) for s, d in best]
        return {name: [r[i] for r in found] for i, name in enumerate(("question", "id", "score"))}


def search(index: Index, questions: DataFrame, *, question_id: str, question: str, id: str, k: int = TOP_BM25, block: int = 1024) -> DataFrame:
    """(question_id, rank, id, score): the ``k`` best documents for every question, zero scores included; ties to the higher id.

    A term asked twice counts twice.  Scores are rounded to 9 decimals.

    Up to ``block`` questions are sent to the tasks that read the segments.  More
    are cut into blocks of about that size, and every pair of a block and a
    segment is a group of one join; the plan is the same for any number of
    questions, and none goes to the driver.
    """
    spark = index.terms.sparkSession
    q_kind, kind = questions.schema[question_id].dataType.simpleString(), index.segments.schema["docs"].dataType.elementType.simpleString()
    out = f"question {q_kind}, id {kind}, score double"
    shape = to_arrow_schema(StructType.fromDDL(out))
    mean_length = index.mean_length
    words = F.filter(F.split(F.lower(F.coalesce(F.col(question), F.lit(""))), r"\s+"), lambda t: t != "")
    asked = questions.where(F.col(question_id).isNotNull()).select(F.col(question_id).alias("q"), words.alias("words"))
    counted = asked.select("q", F.explode("words").alias("term")).groupBy("q", "term").agg(F.count("*").alias("times"))
    weighed = counted.join(index.terms.select("term", "idf"), "term").groupBy("q").agg(F.collect_list(F.struct("term", (F.col("times") * F.col("idf")).alias("weight"))).alias("x"))
    # questions without a known term have zero scores only
    every = materialize(asked.select("q").join(weighed, "q", "left").select("q", F.coalesce("x.term", F.array()).alias("terms"), F.coalesce("x.weight", F.array()).alias("weights")), "asked")
    columns = ["docs", "dl", "terms", "bounds", "at", "tf"]

    head = every.limit(block + 1).collect()
    if len(head) <= block:
        sent = spark.sparkContext.broadcast([(r["q"], r["terms"], r["weights"]) for r in head])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            mine = Asked(sent.value, k, mean_length)
            for b in batches:
                for cells in zip(*(b.column(i).to_pylist() for i in range(len(columns)))):
                    mine.read(*cells)
            yield pa.RecordBatch.from_pydict(mine.rows(), schema=shape)

        found = index.segments.select(*columns).mapInArrow(scan, out)
    else:
        blocks, cells = -(-every.count() // block), max(1, index.segments.count())

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            mine = Asked(list(zip(*(left.column(c).to_pylist() for c in ("q", "terms", "weights")))), k, mean_length)
            for cells_ in zip(*(right.column(c).to_pylist() for c in columns)):
                mine.read(*cells_)
            return pa.Table.from_pydict(mine.rows(), schema=shape)

        left = every.withColumns({"block": F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"), "cell": F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))})
        right = index.segments.withColumns({"cell": F.pmod(F.xxhash64("segment"), F.lit(cells)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        found = left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(compare, out)
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), F.desc("id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("question").alias(question_id), "rank", F.col("id").alias(id), "score")
