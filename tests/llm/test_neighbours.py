from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest

from siltstone.llm import neighbours

DATA = Path("/root/testdata")

SCHEMA = "vec_id long, embedding array<float>, rank string, id long, cosine double"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 0, 0.0) for i, v in rows], SCHEMA).repartition(3)


def brute(ids, data, k):
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    out = {}
    for i, name in enumerate(ids):
        c = np.round(unit @ unit[i], 6)
        order = [j for j in np.lexsort((ids, -c)) if j != i][:k]
        out[name] = [(int(ids[j]), float(c[j])) for j in order]
    return out


def got(df):
    out = {}
    for r in df.orderBy("vec_id", "rank").collect():
        out.setdefault(r["vec_id"], []).append((r["neighbour_id"], r["cosine"]))
    return out


def test_all_lists_probed_is_exact_with_ties_and_copies(spark):
    rng = np.random.default_rng(5)
    data = rng.standard_normal((220, 16)).astype(np.float32)
    data[20:32] = data[3]  # a class larger than k + 1
    data[40] = 2 * data[41]  # equal but for the length
    ids = np.arange(220) * 3
    df = table(spark, [(int(i), v.tolist()) for i, v in zip(ids, data)])
    found = neighbours.nearest_vectors(df, k=5, dim=16, lists=6, probes=6, miss=0, cell_data=37, cell_queries=50)
    assert got(found) == brute(ids, data, 5)


def test_a_vector_held_by_a_third_of_the_rows(spark):
    rng = np.random.default_rng(6)
    data = rng.standard_normal((300, 8)).astype(np.float32)
    data[::3] = data[0]
    ids = np.arange(300)
    found = got(neighbours.nearest_vectors(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, data)]), k=4, dim=8, lists=4, probes=4, miss=0))
    assert found == brute(ids, data, 4)


def test_recall_with_few_probes(spark):
    rng = np.random.default_rng(7)
    centers = rng.standard_normal((40, 32))
    data = (centers[rng.integers(0, 40, 2000)] + 0.4 * rng.standard_normal((2000, 32))).astype(np.float32)
    ids = np.arange(2000)
    found = got(neighbours.nearest_vectors(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, data)]), k=5, dim=32, probes=8))
    want = brute(ids, data, 5)
    hits = sum(len({a for a, _ in found[i]} & {a for a, _ in want[i]}) for i in want)
    assert hits / (5 * len(want)) >= 0.95


def stored(sf):
    path = DATA / sf / "text_store.parquet"
    if not path.exists():
        pytest.skip("no test data")
    rows = pq.read_table(path, columns=["vec_id", "embedding"]).to_pylist()
    by_id = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] is not None and len(r["embedding"]) == 64}
    by_id = {i: v for i, v in by_id.items() if np.isfinite(np.array(v, float)).all() and np.any(v)}
    return np.array(sorted(by_id)), np.array([by_id[i] for i in sorted(by_id)], np.float32)


def test_the_test_abandons_most_candidates_of_the_text_store():
    ids, data = stored("sf0.1")
    vectors = np.unique(data, axis=0).astype(np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    n = len(vectors)
    space = neighbours.Space.fit(vectors, round(n**0.5 / 3), 5, 16, 0.0003)
    turned = vectors.astype(np.float32) @ space.turn
    near = np.argsort(-(turned @ space.centroids.T), axis=1)[:, :8]
    best, tally = np.full((n, 5), 4.0, np.float32), np.zeros(5, np.int64)
    for place in range(8):  # of every vector its nearest list, then the next
        for x in range(len(space.centroids)):
            asking, held = np.flatnonzero(near[:, place] == x), np.flatnonzero(near[:, 0] == x)
            mine = best[asking]
            neighbours.adaptive_scan(turned[asking], turned[held], asking, held, mine, space, tally=tally)
            best[asking] = mine
    alive = tally[1:] / tally[0]
    assert alive[1] < 0.2 and (np.diff(alive) < 0).all(), alive


def test_recall_on_the_text_store_with_default_parameters(spark):
    ids, data = stored("sf0.1")
    found = got(neighbours.nearest_vectors(table(spark, [(int(i), v.tolist()) for i, v in zip(ids, data)])))
    asked = ids[:: max(1, len(ids) // 1500)]
    unit = data.astype(float) / np.linalg.norm(data.astype(float), axis=1, keepdims=True)
    hits = total = 0
    for i in asked:
        j = int(np.searchsorted(ids, i))
        c = np.round(unit @ unit[j], 6)
        want = [int(ids[x]) for x in np.lexsort((ids, -c)) if x != j][:5]
        hits += len(set(want) & {a for a, _ in found[int(i)]})
        total += 5
    assert hits / total >= 0.98, hits / total


def test_scan_keeps_the_nearest_and_what_it_knows_up_to_date():
    rng = np.random.default_rng(8)
    data = rng.standard_normal((500, 64)).astype(np.float32)
    data /= np.linalg.norm(data, axis=1, keepdims=True)
    space = neighbours.Space.fit(data.astype(np.float64), 1, 5, 16, 0.0003)
    turned = data @ space.turn
    ids, best = np.arange(500), np.full((50, 5), 4.0, np.float32)
    qi, di = neighbours.adaptive_scan(turned[:50], turned, ids[:50], ids, best, space)
    kept = set(zip(qi.tolist(), di.tolist()))
    order = np.argsort(-(data[:50] @ data.T), axis=1)[:, 1:6]
    missed = sum((q, int(d)) not in kept for q in range(50) for d in order[q])
    assert missed <= 3 and len(kept) < 0.3 * 50 * 500 and all(q != d for q, d in kept)
    exact = neighbours.Space(space.turn, space.centroids, np.ones(4, np.float32), 16)
    best = np.full((50, 5), 4.0, np.float32)
    neighbours.adaptive_scan(turned[:50], turned, ids[:50], ids, best, exact)
    want = np.sort(2 - 2 * (data[:50] @ data.T), axis=1)[:, 1:6]
    assert np.abs(best - want).max() < 1e-4


def test_pairs(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])]
    found = neighbours.nearest_vectors(table(spark, rows), k=3, dim=2)
    assert len(got(found)[1]) == 3
    assert [tuple(r) for r in neighbours.similar_pairs(found, 0.9).collect()] == [(1, 2)]


def test_unusable_rows_repeated_rows_and_none(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [1.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [0.0, 0.0]), (None, [1.0, 1.0]), (9, [None, 1.0])]
    found = neighbours.nearest_vectors(table(spark, rows), k=5, dim=2)
    assert {k: [a for a, _ in v] for k, v in got(found).items()} == {1: [2], 2: [1]}
    assert neighbours.nearest_vectors(table(spark, rows[3:]), k=5, dim=2).count() == 0
    assert neighbours.nearest_vectors(table(spark, []), k=5, dim=2).count() == 0
