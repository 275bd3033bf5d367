import textwrap

import pytest
from pyspark.sql import functions as F

from siltstone.functions import formatting
from siltstone.functions.vectors import cosine, squared_l2, usable
from siltstone.operators import embedding
from siltstone.plans.retrieval import context
from siltstone.plugins import HashEmbedder, OverlapReranker
from siltstone.schemas import METADATA

LONG = "one two-three four " * 30


@pytest.mark.parametrize("text", ["", "a  b\n c", LONG, "x" * 300, "word " * 39 + "tail", "well-known " * 40, "ab " * 64 + "high-pressure" * 9, "é à " * 80, "a-b " * 70])
def test_snippets_are_those_of_textwrap(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(formatting.snippet(F.col("t"))).first()[0]
    assert got == textwrap.shorten(" ".join(text.split()), width=200)


def labels(spark, *metas):
    rows = [(i + 1, tuple(m.get(f) for f in METADATA.names)) for i, m in enumerate(metas)]
    df = spark.createDataFrame(rows, f"n int, metadata {METADATA.simpleString()}")
    return [r[0] for r in df.select(formatting.source_label(F.col("metadata"), F.col("n"))).collect()]


def test_labels(spark):
    assert labels(
        spark,
        {"image_path": "a/x.png", "caption": True, "ocr": True},
        {"source": "b/y.pdf", "table_md": True, "page": 2},
        {},
        {"image_path": "a/x.png"},
        {"source": "b/z.pdf", "table_row": True, "chartqa": True, "ocr": False},
    ) == ["Source 1: x.png (image) (ocr)", "Source 2: y.pdf (table_md)", "Source 3: unknown", "Source 4: x.png", "Source 5: z.pdf (table_row/chartqa)"]


def test_prompt_hides_what_was_read_from_images(spark):
    meta = {f: None for f in METADATA.names}
    rows = [
        (1, "why?", 2, "secret", tuple((meta | {"image_path": "i/p.png", "caption": True}).values())),
        (1, "why?", 1, "because", tuple((meta | {"source": "d/t.md"}).values())),
    ]
    df = spark.createDataFrame(rows, f"query_id int, question string, number int, document string, metadata {METADATA.simpleString()}")
    row = context(df).first()
    assert row["prompt"] == (
        "You are a helpful assistant. Use ONLY the sources below.\n\nUser question: why?\n\nSource 1: t.md\nbecause\n\n"
        "Source 2: p.png (image)\n<image at i/p.png>\n\nCite facts like (Source 2)."
    )
    assert row["listing"] == "\n🔎 Retrieved context:\n  1. Source 1: t.md — because\n  2. Source 2: p.png (image) — <image>"


def test_file_kinds(spark):
    paths = ["a.PDF", "b.txt", "c.Md", "d.png", "e.docx", "f.html", "sub/g.md", "noext", "x.pdf/y"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(formatting.file_kind(F.col("p"))).collect()] == ["pdf", "text", "text", "image", None, None, "text", None, None]


def test_vector_expressions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<float>")
    got = df.select(cosine("a", "b"), squared_l2("a", "b")).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == 2.0 and got[1][0] is None
    bad = [[1.0, 2.0], None, [1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0]]
    df = spark.createDataFrame([(v,) for v in bad], "v array<float>")
    assert [r[0] for r in df.select(usable("v", 2)).collect()] == [True] + [False] * 6


def test_pooling(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [2.0, 2.0])], "k int, v array<float>")
    assert {r["k"]: r["m"] for r in df.groupBy("k").agg(embedding.mean_vector("v").alias("m")).collect()} == {1: [0.5, 0.5], 2: [2.0, 2.0]}
    assert sorted(tuple(r) for r in embedding.mean_by_key(df, "k", "v").collect()) == [(1, 0, 0.5), (1, 1, 0.5), (2, 0, 2.0), (2, 1, 2.0)]


class Counting:
    """Remembers what it was asked to embed."""

    name, dim = "counting", 2

    def __init__(self):
        self.calls = []

    def embed(self, texts):
        self.calls.append(list(texts))
        return [[len(t.split()), 1.0] for t in texts]


def test_windows_are_decoded_at_ingest_and_kept_in_questions():
    from siltstone.plugins import WhitespaceTokenizer

    model = Counting()
    kept = dict(size=4, overlap=1, batch=2)
    v = embedding.pooled(["a  b", "1 2 3 4 5 6 7"], model, WhitespaceTokenizer(), keep_short=False, **kept)
    assert model.calls == [["a b", "1 2 3 4"], ["4 5 6 7", "7"]]
    assert v.tolist() == [[2.0, 1.0], [3.0, 1.0]]
    embedding.pooled(["a  b"], model, WhitespaceTokenizer(), keep_short=True, **kept)
    assert model.calls[-1] == ["a  b"]
    assert embedding.pooled([], model, WhitespaceTokenizer(), keep_short=True, **kept).shape == (0, 2)


def test_stand_ins():
    a, b = HashEmbedder(16).embed(["Some words here", "some WORDS here"])
    assert (a == b).all() and abs((a * a).sum() - 1) < 1e-12
    assert HashEmbedder(16).embed([""]).sum() == 0
    assert OverlapReranker().score([("a b", "b c"), ("", "x"), ("a", " ")]) == [0.5, 0.0, 0.0]
