import random
import re

import numpy as np
import pytest

from siltstone.llm import neardup

SCHEMA = "rec_id long, page_content string, rep long, id string, text int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 0, "x", 1) for i, t in rows], SCHEMA).repartition(3)


def brute(rows, width, threshold, least):
    sets = {}
    for i, t in rows:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if i is not None and t is not None and len(w) >= max(least, width):
            sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def edited(rng, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        k = rng.randrange(len(out))
        out[k : k + 1] = rng.choice([[], [f"new{rng.randrange(10**6)}"], [out[k], f"more{rng.randrange(10**6)}"]])
    if rng.random() < 0.5:
        k = rng.randrange(len(out))
        out = out[k:] + out[:k]
    return out


def corpus(seed, families, copies):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    common = "who would have thought that a thing can be as it was said to be in the end".split()
    rows, n = [], 0
    for _ in range(families):
        words = []
        for _ in range(rng.randint(6, 40)):
            words += rng.choices(vocabulary, k=rng.randint(4, 9)) + common[: rng.randint(0, 17)]
        for c in range(rng.choice(copies)):
            rows.append((n, " ".join(words if c == 0 else edited(rng, words, rng.choice([0, 0.01, 0.03, 0.06, 0.1])))))
            n += 1
    return rows


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.6), (5, 0.8)])
def test_links_agree_with_brute_force(spark, width, threshold):
    rows = corpus(1, 120, [1, 1, 2, 4])
    found = neardup.near_duplicates(table(spark, rows), width=width, threshold=threshold, least_words=40)
    got = {tuple(r) for r in found.pairs().collect()}
    want = brute(rows, width, threshold, 40)
    assert got <= want
    assert len(got & want) >= 0.99 * len(want) and len(want) > 50


def test_copies_form_one_class_and_pairs_stay_linear_beyond_the_bound(spark):
    words = [f"a{i}" for i in range(60)]
    rows = [(i, " ".join(words).upper() if i % 2 else " ".join(words) + "!") for i in range(30)] + [(100, " ".join([*words, "z"])), (101, "other " * 50)]
    found = neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6)
    assert {r["rep"] for r in found.members.where("id < 30").collect()} == {0}
    assert {tuple(r) for r in found.pairs().collect()} == brute(rows, 3, 0.6, 0)
    few = {tuple(r) for r in found.pairs(whole_class=10).collect()}
    # two texts in the class: each tied by its lowest id, these two paired with each other and with the similar text
    assert few == {(i % 2, i) for i in range(2, 30)} | {(0, 1), (0, 100), (1, 100)}
    groups = {r["id"]: (r["class_id"], r["group_id"]) for r in found.groups().collect()}
    assert groups[7] == (0, 0) and groups[100] == (100, 0) and groups[101] == (101, 101)


def test_chained_signatures_give_the_same_pairs(spark):
    rows = corpus(2, 15, [6, 8])
    small = {tuple(r) for r in neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6, hot=3, hot_low=2).pairs().collect()}
    assert small == {tuple(r) for r in neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6).pairs().collect()}


def test_run_pairs():
    sig, rep, n = np.array([1, 1, 1, 2, 3, 3]), np.array([5, 4, 9, 7, 1, 2]), np.array([10, 10, 30, 10, 10, 11])
    a, b = neardup.run_pairs(sig, rep, n, np.zeros((6, 2), np.int64), 0.6)
    assert list(zip(a.tolist(), b.tolist())) == [(1, 2), (4, 5)]
    run = np.zeros(5, np.int64), np.arange(5), np.full(5, 10), np.zeros((5, 2), np.int64)
    assert len(neardup.run_pairs(*run, 0.6)[0]) == 10
    assert list(zip(*(x.tolist() for x in neardup.run_pairs(*run, 0.6, reach=1)))) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_sketches_of_similar_sets_agree():
    rng = np.random.default_rng(4)
    least, lost, passed = neardup.least_agreeing(0.6), 0, 0
    for _ in range(300):
        x = rng.integers(0, 1 << 62, 100, dtype=np.uint64)
        y, z = np.append(x[25:], rng.integers(0, 1 << 62, 25, dtype=np.uint64)), np.append(x[90:], rng.integers(0, 1 << 62, 90, dtype=np.uint64))
        of_x, of_y, of_z = neardup.bit_sketches([x, y, z])
        agree = lambda a, b: 128 - int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
        lost += agree(of_x, of_y) < least
        passed += agree(of_x, of_z) >= least
    assert lost == 0 and passed < 20


def test_two_sets_that_differ_little_share_a_subset_of_partitions():
    """With all groups signing, no pair is lost whose sets differ in fewer than twice as many features as there are groups."""
    rng = np.random.default_rng(3)
    for size in (30, 60, 150):
        scheme = neardup.Scheme(0.6, 20, 10**6)
        n_groups = min(scheme.domain(int(b)) for b in scheme.band(np.array([size])) + np.arange(2))
        for _ in range(40):
            x = rng.integers(0, 1 << 62, size, dtype=np.uint64)
            differ = min(2 * n_groups - 1, size // 2)
            y = np.append(x[differ // 2 :], rng.integers(0, 1 << 62, differ // 2, dtype=np.uint64))
            # no signature has little information here
            doc, sig, top = neardup.signatures([np.unique(x), np.unique(y)], neardup.Scheme(0.6, 20, n_groups), np.full(1 << 12, 255, np.uint8), 1.0)
            assert (top == -1).all() and set(sig[doc == 0]) & set(sig[doc == 1])


def family_table(share, n=5000):
    rng = random.Random(round(share * 100))
    base = [f"h{i}" for i in range(78)]
    rows = []
    for i in range(round(share * n)):
        words = list(base)
        for k in rng.sample(range(3, 75), rng.choice((2, 2, 3))):
            words[k] = f"e{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    return rows + [(100_000 + i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(78))) for i in range(n - len(rows))]


@pytest.mark.parametrize("share", [0.05, 0.1, 0.5, 1.0])
def test_a_large_family_is_one_group(spark, share):
    rows = family_table(share)
    found = neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6, least_words=40)
    links, members = found.links.count(), round(share * 5000)
    groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
    sizes: dict[int, int] = {}
    for i in range(members):
        sizes[groups[i]] = sizes.get(groups[i], 0) + 1
    assert sum(n * (n - 1) for n in sizes.values()) >= 0.99 * members * (members - 1)
    assert all(groups[i] == i for i in groups if i >= 100_000)
    assert links <= 250 * members  # some for each signature, however large the family


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(20), 100 + rng.randrange(20)) for _ in range(15)] + [(300, 200)]
    roots: dict[int, int] = {}

    def root(x):
        while roots.setdefault(x, x) != x:
            x = roots[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        roots[b] = a
    df = spark.createDataFrame(edges, "a long, b long")
    linked = {x for e in edges if e[0] != e[1] for x in e}
    for bound in (0, 10**6):  # by rounds, and in one task
        rows = neardup.components(df, task_edges=bound).collect()
        assert {r["node"]: r["root"] for r in rows} == {x: root(x) for x in linked} and len(rows) == len(linked)
        assert neardup.components(df.where("a < 0"), task_edges=bound).count() == 0


def test_nulls_blanks_short_and_none(spark):
    words = " ".join(f"b{i}" for i in range(50))
    rows = [(1, None), (2, ""), (3, "a b"), (None, words), (4, words), (4, words), (5, words + " c"), (6, "Ä ö ü " * 50)]
    found = neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6, least_words=40)
    assert [tuple(r) for r in found.pairs().collect()] == [(4, 5)]
    assert sorted(r["id"] for r in found.members.collect()) == [4, 5]
    for some in ([], rows[:3]):
        none = neardup.near_duplicates(table(spark, some), width=3, threshold=0.6)
        assert none.pairs().count() == 0 and none.groups().count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(5)
    words = [f"c{rng.randrange(5000)}" for _ in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(edited(rng, words, 0.02))), (3, " ".join(words[:100]))]
    assert [tuple(r) for r in neardup.near_duplicates(table(spark, rows), width=5, threshold=0.8).pairs().collect()] == [(1, 2)]


def hot_family(seed, family, others):
    """A third of all rows are different edited copies of one text; as many texts stand around one boilerplate."""
    rng = random.Random(seed)
    base, notice = [f"h{i}" for i in range(120)], [f"n{i}" for i in range(90)]
    rows = [(i, " ".join(edited(rng, base, rng.choice([0.04, 0.05, 0.06])))) for i in range(family)]
    rows += [(1000 + i, " ".join(notice + [f"o{i}x{k}" for k in range(rng.randint(4, 60))])) for i in range(family)]
    return rows + [(5000 + i, " ".join(f"u{rng.randrange(10**6)}" for _ in range(100))) for i in range(others)]


def test_hot_families_are_linked_whole(spark):
    rows = hot_family(6, 350, 350)
    want = brute(rows, 3, 0.6, 40)
    assert len({p for p in want if p[1] < 1000}) > 5000 and len({p for p in want if p[0] >= 1000}) > 5000
    for some in ({}, {"block_sets": 150}):
        got = [tuple(r) for r in neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6, least_words=40, **some).pairs().collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_block_pairs():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, rng.integers(20, 60)).astype(np.uint64)) for _ in range(60)]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
    whole = neardup.Block(np.arange(60), sets, step=7)
    halves = neardup.Block(np.arange(25), sets[:25], step=7), neardup.Block(np.arange(25, 60), sets[25:], step=7)
    for pairs in ([(whole, whole)], [(halves[0], halves[0]), (halves[0], halves[1]), (halves[1], halves[1])]):
        got = [(int(a), int(b)) for x, y in pairs for p in neardup.block_pairs(x, y, 0.6, columns=13) for a, b in zip(p[0], p[1])]
        assert len(got) == len(set(got)) and set(got) == want


def partners_in_boilerplate(n=300):
    """Every two texts share a notice, and are not similar for that; each has one partner, with which it shares a little more."""
    notice = [f"n{i}" for i in range(100)]
    rows = []
    for i in range(n):
        for side in "xy":
            rows.append((len(rows), " ".join([*notice, *(f"s{i}z{k}" for k in range(12)), *(f"o{i}{side}{k}" for k in range(26))])))
    return rows


def test_partners_among_many_that_share_as_much_are_found(spark):
    rows = partners_in_boilerplate()
    want = {(2 * i, 2 * i + 1) for i in range(300)}
    assert brute(rows[:40], 3, 0.6, 40) == {p for p in want if p[1] < 40}
    for some in ({}, {"hot": 1}):
        found = neardup.near_duplicates(table(spark, rows), width=3, threshold=0.6, least_words=40, **some)
        assert {tuple(r) for r in found.pairs().collect()} == want
        assert {r["id"]: r["group_id"] for r in found.groups().collect()} == {i: i - i % 2 for i in range(600)}


def test_no_pair_and_no_group_is_lost_to_chance(spark):
    rows = corpus(7, 150, [1, 2, 3, 6])
    for width, threshold in ((3, 0.6), (2, 0.45)):
        want = brute(rows, width, threshold, 40)
        low: dict[int, int] = {}
        for a, b in sorted(want, key=lambda p: (p[1], p[0])):
            low.setdefault(b, low.get(a, a))
        for some in ({}, {"hot": 2, "hot_low": 2, "groups": 1, "reach": 1}):
            found = neardup.near_duplicates(table(spark, rows), width=width, threshold=threshold, least_words=40, **some)
            got = [tuple(r) for r in found.pairs().collect()]
            assert len(got) == len(set(got)) and set(got) == want
            groups = {r["id"]: r["group_id"] for r in found.groups().collect()}
            assert all(groups[a] == groups[b] for a, b in want) and {i for i, g in groups.items() if g != i} == set(low)


def test_long_runs_join_only_sets_that_may_be_similar(spark):
    """(key, rep, size, place): sizes that the places leave too little to share are not joined, nor are those apart in size."""
    rows = [(1, i, 100, 30) for i in range(20)] + [(2, 100 + i, 100, 10) for i in range(20)] + [(2, 200 + i, 400, 10) for i in range(20)]
    begun = spark.createDataFrame(rows, "key long, rep long, n int, at int")
    long, short = ([tuple(r) for r in neardup.sharing_pairs(begun, 0.6, hot).collect()] for hot in (5, 100))
    assert all(n is None and 0 < a // 100 == b // 100 for a, b, n in long) and {x for a, b, _ in long for x in (a, b)} == {*range(100, 120), *range(200, 220)}
    want = {(k + i, k + j, n) for k, n in ((100, 200), (200, 800)) for i in range(20) for j in range(i + 1, 20)}
    assert len(long) == 38 and len(short) == len(want) and set(short) == want
