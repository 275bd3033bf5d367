"""Problem 1: for every vector, the most similar vectors of the collection.

Method: adaptive dimension scan over probed lists.  Vectors are normalised,
rotated so that the first columns hold the most variance, and filed under the
nearest centroid.  Every vector is then a query against its nearest lists: first
its own, then the others, taking along the k-th distance known so far, which
falls with every few rows read.  Within a list, squared distances grow one
column block at a time; after each block a hypothesis test on the partial
distance drops the candidates that can't be among the best.  What is left is
compared in double precision.

Equal vectors form a class that is searched for once, so that a vector held by
a third of all rows costs no more than any other; lists and their queries are
cut into cells of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize, ship


def usable_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(id, vec, class_key) of the usable rows: ``dim`` values, all finite, not all zero."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lists = b.column(0), b.column(1)
            good = np.flatnonzero(np.asarray((pc.list_value_length(lists).fill_null(-1)).to_numpy(zero_copy_only=False) == dim))
            part = lists.take(pa.array(good))
            values = part.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            fine = np.isfinite(values).all(1) & (values != 0).any(1)
            values = values[fine] + np.float32(0)  # -0.0 and 0.0 are equal
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(good[fine])), pa.array([v.tobytes() for v in values], pa.binary())], ["id", "vec"])

    chosen = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where("id is not null and v is not null")
    return chosen.mapInArrow(keep, "id long, vec binary").withColumn("class_key", F.md5("vec"))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means on a bounded sample."""
    rng = np.random.default_rng(7)
    centroids = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        nearest = np.concatenate([np.argmax(part @ centroids.T, 1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        order = np.argsort(nearest, kind="stable")
        bounds = np.searchsorted(nearest[order], np.arange(len(centroids)))
        filled = np.unique(nearest)
        sums = np.add.reduceat(sample[order], bounds[filled])
        centroids[filled] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def unit_rows(cells: list[bytes], dim: int) -> np.ndarray:
    v = np.frombuffer(b"".join(cells), np.float32).reshape(-1, dim).astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Space:
    """What is fitted on a bounded sample: the rotation, the centroids, and the limits of the test after each block.

    The test's hypothesis after d columns is that a candidate is nearer than the
    k-th known.  Under it, at most the share ``limits`` of that distance lies in
    the first d columns, but for a fraction ``miss`` of the pairs: the limits are
    quantiles over the sample's own nearest pairs.
    """

    turn: np.ndarray
    centroids: np.ndarray
    limits: np.ndarray
    block: int

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, k: int, block: int, miss: float, asked: int = 2000) -> Space:
        dim = sample.shape[1]
        if not len(sample):
            return cls(np.eye(dim, dtype=np.float32), np.zeros((1, dim), np.float32), np.ones(-(-dim // block), np.float32), block)
        _, axes = np.linalg.eigh(sample.T @ sample)
        turn = axes[:, ::-1].astype(np.float32)
        turned = sample.astype(np.float32) @ turn
        centroids = fit_centroids(turned, min(lists, len(turned)))
        ends = [*range(block, dim, block), dim]
        limits = np.ones(len(ends), np.float32)  # 1 drops nothing that is nearer
        if miss > 0 and len(turned) > k + 1:
            shares = []
            for part in np.array_split(turned[:asked], -(-min(asked, len(turned)) // 256)):
                near = np.argpartition(-(part @ turned.T), k, axis=1)[:, : k + 1]
                gap = np.cumsum((part[:, None] - turned[near]) ** 2, axis=2)
                apart = gap[:, :, -1] > 1e-6
                shares.append(gap[apart][:, np.array(ends) - 1] / gap[apart][:, -1:])
            every = np.concatenate(shares)
            if len(every):
                limits[:-1] = np.quantile(every, 1 - miss, axis=0)[:-1]
        return cls(turn, centroids, limits, block)


def adaptive_scan(
    queries: np.ndarray, data: np.ndarray, query_ids: np.ndarray, data_ids: np.ndarray, best: np.ndarray, space: Space, step: int = 128, tally: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(query, data) index pairs that survive: those that may be among the nearest of a query.

    Both sides are rotated unit vectors; pairs of equal ids are left out.
    ``best`` holds, in ascending order, the squared distances of the nearest rows
    that a query knows of; it is brought up to date after every ``step`` rows.
    ``tally`` counts the pairs begun, and those alive after each block.
    """
    dim, k = data.shape[1], best.shape[1]
    found_q, found_d = [], []
    for first in range(0, len(data), step):
        part = data[first : first + step]
        known = best[:, -1]
        partial = np.zeros((len(queries), len(part)), np.float32)
        alive = query_ids[:, None] != data_ids[None, first : first + step]
        qi = di = left = None
        if tally is not None:
            tally[0] += alive.sum()
        for n, at in enumerate(range(0, dim, space.block)):
            q, d = queries[:, at : at + space.block], part[:, at : at + space.block]
            bound = known * space.limits[n] + 1e-5
            if qi is None:
                partial += (q * q).sum(1)[:, None] + (d * d).sum(1)[None, :] - 2 * (q @ d.T)
                alive &= partial <= bound[:, None]
                if at + space.block >= dim or np.count_nonzero(alive) < 0.1 * alive.size:
                    qi, di = np.nonzero(alive)
                    left = partial[qi, di]
            else:
                left = left + ((q[qi] - d[di]) ** 2).sum(1)
                stay = left <= bound[qi]
                qi, di, left = qi[stay], di[stay], left[stay]
            if tally is not None:
                tally[n + 1] += np.count_nonzero(alive) if qi is None else len(qi)
        found_q.append(qi)
        found_d.append(di + first)
        # the k nearest of these, put among those known
        order = np.lexsort((left, qi))
        qi, left = qi[order], left[order]
        place = np.arange(len(qi)) - np.searchsorted(qi, qi)
        few = place < k
        rows, number = np.unique(qi[few], return_inverse=True)
        new = np.full((len(rows), k), np.inf, np.float32)
        new[number, place[few]] = left[few]
        best[rows] = np.sort(np.concatenate([best[rows], new], 1), 1)[:, :k]
    return np.concatenate(found_q), np.concatenate(found_d)


def best_of(qi: np.ndarray, di: np.ndarray, cosine: np.ndarray, rep: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best pairs of every query: by cosine, ties to the lower id."""
    order = np.lexsort((rep[di], -cosine, qi))
    qi, di, cosine = qi[order], di[order], cosine[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[best], di[best], cosine[best]


def grouped_lists(
    centroids: np.ndarray, held: dict[int, int], asked: dict[int, int], cell_data: int, cell_queries: int, together: int = 8
) -> tuple[dict[int, int], dict[int, tuple[int, int]]]:
    """(group of each list, cuts of each group along data and queries).

    Neighbouring lists share a group, so that a query that asks several of them
    is sent once.  A list beyond the size of a cell is a group of its own and is
    cut; other groups are filled up to that size.
    """
    nearest = np.argmax(centroids @ fit_centroids(centroids, max(1, len(centroids) // together)).T, 1)
    group_of: dict[int, int] = {}
    cuts: dict[int, tuple[int, int]] = {}
    load = (0, 0)
    before = None
    for x in sorted(held, key=lambda x: (nearest[x], x)):
        mine = (held[x], asked.get(x, 0))
        hot = mine[0] > cell_data or mine[1] > cell_queries
        full = load[0] + mine[0] > 2 * cell_data or load[1] + mine[1] > 2 * cell_queries
        if hot or before is None or nearest[x] != before or full:
            cuts[len(cuts)] = (-(-mine[0] // cell_data), max(1, -(-mine[1] // cell_queries))) if hot else (1, 1)
            load = (0, 0)
        group_of[x] = len(cuts) - 1
        load = (load[0] + mine[0], load[1] + mine[1])
        before = None if hot else nearest[x]
    return group_of, cuts


def scattered(ids: np.ndarray, salt: int) -> np.ndarray:
    """A hash of the ids: ids with a common factor go to different cells too."""
    h = (ids.astype(np.uint64) + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return (h >> np.uint64(33)).astype(np.int64)


def exact_cosines(exact: np.ndarray, qi: np.ndarray, di: np.ndarray) -> np.ndarray:
    return np.round(np.einsum("ij,ij->i", exact[qi], exact[di]), 6)


def class_neighbours(
    classes: DataFrame, n: int, k: int, dim: int, lists: int | None, probes: int | None, sample_rows: int, block: int, miss: float, cell_data: int, cell_queries: int
) -> DataFrame:
    """(q, d, cosine): for every class its ``k`` best other classes, cosines rounded to 6 decimals, ties to the lower id."""
    lists = lists or max(1, round(min(n**0.5 / 3, n / 128)))
    sample_rows = min(sample_rows, max(20_000, 20 * lists))
    # a little more than the sample by hash, then exactly its bound: no task sends the driver a sample of its own
    share = min(1.0, 1.2 * sample_rows / max(1, n))
    likely = classes.where(F.pmod(F.xxhash64("rep"), F.lit(1_000_000)) < F.lit(math.ceil(share * 1_000_000)))
    drawn = [r[0] for r in likely.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("vec").toLocalIterator()]
    sample = unit_rows([bytes(v) for v in drawn], dim) if drawn else np.zeros((0, dim))
    space = Space.fit(sample, lists, k, block, miss)
    centroids, turn = space.centroids, space.turn
    probes = min(probes or max(8, round(0.85 * len(centroids) ** 0.5)), len(centroids))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = (unit_rows(b.column(1).to_pylist(), dim).astype(np.float32) @ turn) @ centroids.T if b.num_rows else np.zeros((0, len(centroids)))
            near = np.argpartition(-v, probes - 1, axis=1)[:, :probes] if probes < v.shape[1] else np.argsort(-v, axis=1)
            own = np.argmax(v, 1) if len(v) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.int32()), pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))], ["rep", "vec", "own", "near"])

    placed = materialize(classes.select("rep", "vec").mapInArrow(place, "rep long, vec binary, own int, near array<int>"), "placed")
    # of each list: how many vectors it holds, how many queries it gets (at most as many rows as lists)
    held = {r[0]: r[1] for r in placed.groupBy("own").count().toLocalIterator()}
    asked = {r[0]: r[1] for r in placed.select(F.explode("near").alias("l")).groupBy("l").count().toLocalIterator()}
    group_of, cuts = grouped_lists(centroids, held, asked, cell_data, cell_queries)

    # first every vector's own list (where that is cut, its cell of it): the distances found there bound all that follows
    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(2).to_numpy()
            parts = np.array([cuts[group_of[x]][0] for x in own.tolist()], np.int64)
            cell = (own.astype(np.int64) << 32) + scattered(b.column(0).to_numpy(), 1) % np.maximum(parts, 1)
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], ["cell", *b.schema.names])

    def scan_home(t: pa.Table) -> pa.Table:
        rep, exact = t.column("rep").to_numpy(), unit_rows(t.column("vec").to_pylist(), dim)
        turned = exact.astype(np.float32) @ turn
        best = np.full((len(rep), k), 4.0, np.float32)
        ids, cosines = np.full((len(rep), k), -1, np.int64), np.full((len(rep), k), -2.0)
        for part in np.array_split(np.arange(len(rep)), -(-len(rep) // 2048)):
            mine = best[part]
            qi, di = adaptive_scan(turned[part], turned, rep[part], rep, mine, space)
            qi, di, cosine = best_of(qi, di, exact_cosines(exact, part[qi], di), rep, k)
            at = np.arange(len(qi)) - np.searchsorted(qi, qi)
            ids[part[qi], at], cosines[part[qi], at] = rep[di], cosine
        lists_ = [pa.array(list(x), pa.list_(kind)) for x, kind in ((ids, pa.int64()), (cosines, pa.float64()))]
        return pa.table({"rep": t.column("rep"), "vec": t.column("vec"), "own": t.column("own"), "near": t.column("near"), "ids": lists_[0], "cosines": lists_[1]})

    homed = placed.mapInArrow(home, "cell long, rep long, vec binary, own int, near array<int>")
    kinds = "rep long, vec binary, own int, near array<int>, ids array<long>, cosines array<double>"
    first = materialize(homed.groupBy("cell").applyInArrow(scan_home, kinds), "first")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, cell, query, wanted = [], [], [], []
            reps = b.column(0).to_numpy()
            by_data, by_query = scattered(reps, 1).tolist(), scattered(reps, 2).tolist()
            for i, (own, near) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist())):
                mine = group_of[own]
                ds, qs = cuts[mine]
                for q in range(qs):
                    rows.append(i)
                    cell.append((mine << 32) + ((by_data[i] % ds) << 16) + q)
                    query.append(False)
                    wanted.append([own])
                by_group: dict[int, list[int]] = {}
                for x in near:
                    if x in group_of and (x != own or ds > 1):
                        by_group.setdefault(group_of[x], []).append(x)
                for g, lists_ in by_group.items():
                    ds, qs = cuts[g]
                    for d in range(ds):
                        if g == mine and ds > 1 and d == by_data[i] % ds:
                            continue  # scanned at home
                        rows.append(i)
                        cell.append((g << 32) + (d << 16) + by_query[i] % qs)
                        query.append(True)
                        wanted.append(lists_)
            at = pa.array(rows, pa.int64())
            mask = pa.array([not q for q in query], pa.bool_())
            known = pc.if_else(mask, pa.nulls(len(rows), b.column(5).type), b.column(5).take(at))  # data need none
            columns = [pa.array(cell, pa.int64()), pa.array(query, pa.bool_()), b.column(0).take(at), b.column(1).take(at), pa.array(wanted, pa.list_(pa.int32())), known]
            yield pa.RecordBatch.from_arrays(columns, ["cell", "is_query", "rep", "vec", "lists", "known"])

    def scan(t: pa.Table) -> pa.Table:
        query, rep = t.column("is_query").to_numpy(), t.column("rep").to_numpy()
        exact = unit_rows(t.column("vec").to_pylist(), dim)
        turned = exact.astype(np.float32) @ turn
        wanted = t.column("lists").combine_chunks()
        list_of = wanted.flatten().to_numpy()
        row_of = np.repeat(np.arange(len(query)), wanted.value_lengths().to_numpy())
        best = np.zeros((len(query), k), np.float32)
        asking = np.flatnonzero(query)
        if len(asking):
            cosines = t.column("known").combine_chunks().take(pa.array(asking)).flatten().to_numpy().reshape(-1, k)
            best[asking] = np.where(cosines > -2, 2 - 2 * cosines, 4.0)  # in ascending order, as the cosines fall
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for x in np.unique(list_of[~query[row_of]]):
            of_list = row_of[list_of == x]
            d_at, q_at = of_list[~query[of_list]], of_list[query[of_list]]
            for part in np.array_split(q_at, max(1, -(-len(q_at) // 4096))):
                if len(part) and len(d_at):
                    mine = best[part]
                    qi, di = adaptive_scan(turned[part], turned[d_at], rep[part], rep[d_at], mine, space)
                    best[part] = mine
                    qi, di = part[qi], d_at[di]
                    rows.append(best_of(qi, di, exact_cosines(exact, qi, di), rep, k))
        qi, di, cosine = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        qi, di, cosine = best_of(qi, di, cosine, rep, k)
        return pa.table({"q": pa.array(rep[qi], pa.int64()), "d": pa.array(rep[di], pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    cells = first.mapInArrow(spread, "cell long, is_query boolean, rep long, vec binary, lists array<int>, known array<double>")
    found = cells.groupBy("cell").applyInArrow(scan, "q long, d long, cosine double")
    at_home = first.select(F.col("rep").alias("q"), F.explode(F.arrays_zip("ids", "cosines")).alias("x")).select("q", F.col("x.ids").alias("d"), F.col("x.cosines").alias("cosine")).where("d <> -1 or cosine > -2")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "d"))
    return found.unionByName(at_home).withColumn("r", rank).where(F.col("r") <= k).drop("r")


def nearest_vectors(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    *,
    k: int = 5,
    dim: int = 64,
    lists: int | None = None,
    probes: int | None = None,
    sample_rows: int = 200_000,
    block: int = 16,
    miss: float = 0.0003,
    cell_data: int = 4096,
    cell_queries: int = 16_384,
) -> DataFrame:
    """(vec_id, rank, neighbour_id, cosine): the ``k`` most similar other vectors of every usable vector.

    Cosines are computed in double precision and rounded to 6 decimals; ties go
    to the lower id.  A vector is usable if it has exactly ``dim`` values, all
    finite and not all zero; others, null ids among them, are neither queries nor
    neighbours.  Rows with the same id count once, other columns are ignored,
    empty tables give no rows.

    Rotation, centroids and limits are fitted on at most ``sample_rows`` vectors
    (20 for each list, 20,000 at least); every vector is filed and searched.
    ``lists`` defaults to a third of the square root of the number of classes, of
    128 classes each at least; ``probes``, the number of lists scanned for each
    query, to 0.85 times the square root of that (8 at least).  ``miss`` is how
    often a test may drop a neighbour that is just as far as the k-th known; with
    0 none is dropped.
    """
    usable = usable_vectors(df, key, vector, dim)
    ship(df.sparkSession)
    # read twice, as that costs less than a written copy of the vectors; an id stays in one class whatever its rows hold
    named = materialize(usable.groupBy("id").agg(F.min("class_key").alias("class_key")), "members")
    classes = materialize(usable.groupBy("class_key").agg(F.min("id").alias("rep"), F.first("vec").alias("vec")), "classes")
    n = classes.count()
    near = class_neighbours(classes, n, k, dim, lists, probes, sample_rows, block, miss, cell_data, cell_queries)

    # of every class the k + 1 lowest ids: more of it can't be among anyone's k best
    members = named.join(classes.select("class_key", "rep"), "class_key").select("rep", "id")
    head = F.row_number().over(Window.partitionBy("rep").orderBy("id"))
    heads = members.withColumn("r", head).where(F.col("r") <= k + 1).select(F.col("rep").alias("d"), F.col("id").alias("other"))
    several = members.groupBy("rep").count().where("count > 1").select(F.col("rep").alias("q"), F.col("rep").alias("d"), F.lit(1.0).alias("cosine"))
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("cosine"), "other"))
    by_class = near.unionByName(several).join(heads, "d").withColumn("r", best).where(F.col("r") <= k + 1).select("q", "other", "cosine")
    mine = members.withColumnRenamed("rep", "q").join(by_class, "q").where(F.col("id") != F.col("other"))
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "other"))
    ranked = mine.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select(F.col("id").alias("vec_id"), "rank", F.col("other").alias("neighbour_id"), "cosine")


def similar_pairs(neighbours: DataFrame, least_cosine: float) -> DataFrame:
    """(vec_a, vec_b), vec_a < vec_b, of neighbours with at least that cosine."""
    return (
        neighbours.where(F.col("cosine") >= least_cosine)
        .select(F.least("vec_id", "neighbour_id").alias("vec_a"), F.greatest("vec_id", "neighbour_id").alias("vec_b"))
        .distinct()
    )
