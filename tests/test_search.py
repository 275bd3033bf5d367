import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import bm25, fusion, knn, mmr, rerank


def test_mmr_prefers_near_then_different():
    q, same, other = np.array([1.0, 0.0]), [1.0, 0.0], [0.6, 0.8]
    c = np.array([same, same, other])
    assert mmr.select(q, c, 2, 0.6) == [0, 1]
    assert mmr.select(q, c, 2, 0.3) == [0, 2]
    assert mmr.select(q, c, 9, 0.3) == [0, 2, 1]
    assert mmr.select(q, np.zeros((0, 2)), 3, 0.6) == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.floats(-1, 1), min_size=3, max_size=3).filter(lambda v: sum(x * x for x in v) > 0.01), min_size=1, max_size=12))
def test_mmr_with_weight_one_is_cosine_order(vectors):
    v, q = np.array(vectors), np.array([0.3, -0.2, 0.9])
    cosine = np.round((v @ q) / np.linalg.norm(v, axis=1) / np.linalg.norm(q), 12)
    assert mmr.select(q, v, len(v), 1.0) == sorted(range(len(v)), key=lambda i: (-cosine[i], i))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, v array<float>, rank string")


@pytest.mark.parametrize("block", [4, 100])
@pytest.mark.parametrize("metric", knn.METRICS)
def test_nearest_agrees_with_brute_force(spark, metric, block):
    rng = np.random.default_rng(3)
    data = rng.standard_normal((300, 8)).astype(np.float32)
    data[10] = data[11] = data[12]  # ties go to the lower id
    rows = vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(data)]).repartition(5)
    asked = rows.where("id < 15")
    got = knn.nearest(asked.withColumnRenamed("id", "q"), rows, question_id="q", question_vector="v", id="id", vector="v", k=7, dim=8, metric=metric, block=block, cell_rows=80)
    d = data.astype(float)
    for q in range(15):
        dist = 1 - d @ d[q] / np.linalg.norm(d, axis=1) / np.linalg.norm(d[q]) if metric == "cosine" else ((d - d[q]) ** 2).sum(1)
        want = sorted(range(300), key=lambda i: (round(dist[i], 9), i))[:7]
        assert [r["id"] for r in got.where(f"q = {q}").orderBy("rank").collect()] == want


def test_the_plan_is_the_same_for_any_number_of_questions(spark):
    rng = np.random.default_rng(4)
    rows = vectors(spark, [(i, v.tolist(), "x") for i, v in enumerate(rng.standard_normal((120, 4)))])
    ask = dict(question_id="q", question_vector="v", id="id", vector="v", k=3, dim=4, cell_rows=50)
    plans = []
    for block in (50, 10):  # 3 blocks and 12
        got = knn.nearest(rows.withColumnRenamed("id", "q"), rows, block=block, **ask)
        assert got.count() == 360
        plans.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert plans[0].count("LogicalRDD") == plans[1].count("LogicalRDD") and plans[0].count("\n") == plans[1].count("\n") and "Union" not in plans[1]


def test_string_ids_and_self(spark):
    df = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0]), ("d", [1.0, 0.1])], "id string, v array<double>")
    ask = dict(question_id="q", question_vector="v", id="id", vector="v", k=2, dim=2, without_self=True)
    for block in (2, 10):
        got = knn.nearest(df.withColumnRenamed("id", "q"), df, block=block, **ask)
        assert [r["id"] for r in got.where("q = 'a'").orderBy("rank").collect()] == ["b", "d"]
        assert [r["id"] for r in got.where("q = 'd'").orderBy("rank").collect()] == ["a", "b"]


def test_unusable_vectors_neither_ask_nor_answer(spark):
    rows = vectors(spark, [(1, [1.0, 0.0], "a"), (2, None, "b"), (3, [1.0], "c"), (4, [0.0, 0.0], "d"), (5, [float("nan"), 1.0], "e"), (None, [1.0, 1.0], "f"), (6, [0.0, 2.0], "g")])
    got = knn.nearest(rows.withColumnRenamed("id", "q"), rows, question_id="q", question_vector="v", id="id", vector="v", k=3, dim=2, without_self=True)
    assert sorted((r["q"], r["id"]) for r in got.collect()) == [(1, 6), (6, 1)]


def test_no_rows_and_no_questions(spark):
    none = vectors(spark, [])
    ask = dict(question_id="q", question_vector="v", id="id", vector="v", k=3, dim=2)
    assert knn.nearest(none.withColumnRenamed("id", "q"), none, **ask).count() == 0


def okapi(docs: list[str], q: str) -> list[float]:
    words = [d.lower().split() for d in docs]
    n, mean = len(docs), sum(map(len, words)) / len(docs)
    df = {t: sum(t in w for w in words) for w0 in words for t in w0}
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = 0.25 * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    return [round(sum(idf.get(t, 0) * w.count(t) * 2.5 / (w.count(t) + 1.5 * (0.25 + 0.75 * len(w) / mean)) for t in q.lower().split()), 9) for w in words]


@pytest.mark.parametrize("block", [1, 2, 10])
def test_bm25_agrees_with_the_formula_and_pads_with_zeros(spark, tmp_path, block):
    docs = ["The cat sat", "the dog", "the the bird sang", "fish", "a cat and the dog", "the end", "", "the cat sat"]
    df = spark.createDataFrame(list(enumerate(docs)), "id long, text string").repartition(3)
    asked = spark.createDataFrame([(0, "the the cat"), (1, "zebra"), (2, None)], "q int, text string")
    index = bm25.build(df, "id", "text", segment_docs=2)
    index.save(str(tmp_path / "index"))
    loaded = bm25.Index.load(spark, str(tmp_path / "index"))
    ask = dict(question_id="q", question="text", id="id", k=8)
    got = bm25.search(index, asked, block=block, **ask)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, bm25.search(loaded, asked, **ask).collect()))
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    for q, text in ((0, "the the cat"), (1, "zebra"), (2, "")):
        score = okapi(docs, text)
        want = sorted(range(8), key=lambda i: (score[i], i), reverse=True)
        rows = got.where(f"q = {q}").orderBy("rank").collect()
        assert [r["id"] for r in rows] == want
        assert [r["score"] for r in rows] == pytest.approx([score[i] for i in want], abs=1e-8)


def test_bm25_of_nothing(spark):
    none = spark.createDataFrame([], "id long, text string")
    asked = spark.createDataFrame([(1, "x")], "q int, text string")
    index = bm25.build(none, "id", "text")
    assert bm25.search(index, asked, question_id="q", question="text", id="id").count() == 0


def test_rerank_keeps_order_of_ties_and_ten(spark):
    rows = [(1, "a b", "a b" if i == 7 else ("" if i == 3 else "a x"), i) for i in range(12)]
    df = spark.createDataFrame(rows, "q int, question string, document string, in_pos int")
    got = rerank.rerank(df, question_id="q", question="question", document="document", in_pos="in_pos").orderBy("rank").collect()
    assert [r["in_pos"] for r in got] == [7, 0, 1, 2, 4, 5, 6, 8, 9, 10]


def test_fusion_keeps_what_both_lists_hold(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "q int, rank int, id int")
    got = fusion.fuse(("a", a), ("b", b), question_id="q").orderBy("in_pos").collect()
    assert [(r["src"], r["id"]) for r in got] == [("a", 10), ("a", 11), ("b", 11), ("b", 12)]
    once = fusion.fuse(("a", a), ("b", b), question_id="q", dedup_on="id").orderBy("in_pos").collect()
    assert [r["id"] for r in once] == [10, 11, 12]
