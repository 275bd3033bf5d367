"""Problem 2: records that share most of their content.

Method: prefix filtering, which is exact, and PartEnum signatures, which spare
work where very many sets are alike.  Texts are sets of word shingles.

All sets' features have one order, the rarest first (by a sketch of the features'
frequencies over all records; any order would give the same pairs).  Two similar
sets share a feature within the beginnings of both, which are as long as the
features that a similar set may lack.  The sets of a feature are paired; a pair is
dropped where its sizes, the feature's places in the two sets, or the number of
bits in which two short tables of the sets differ rule out that it is similar.
What is left is compared exactly.

Sets of a feature that very many of them begin with, as the edited copies in a
large family do, are not paired but form a family, and all pairs of a family are
sought block by block where they are asked for.  Groups don't need them all.
There the sets of a family are first linked by PartEnum signatures: sets of
similar size share a size band; for a band the feature domain is cut into groups,
and each group into three partitions, and the signatures of a set are all subsets
of two of the three, for a number of groups.  The sets of a signature that very
many share are linked in a chain, in an order of its own, at a cost that grows
with the family.  Only sets that the chains leave apart are compared block by
block with the others of their family, so that the groups are exact as well.

Texts of equal shingle sets form a class that is compared once.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.session import materialize

WORD = re.compile("[a-z0-9]+")
MASK = (1 << 64) - 1
#: Odd multipliers of the hash functions.
M1, M2, M3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93


class WordHash(dict):
    """64-bit hashes of words, kept for the life of a task up to a bound."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = xxhash.xxh64_intdigest(word)
        if len(self) < 500_000:
            self[word] = h
        return h


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = (x ^ np.uint64((salt * M3) & MASK)) * np.uint64(M1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(M2)
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[str], width: int, least_words: int, hashes: WordHash) -> list[np.ndarray | None]:
    """The distinct shingle hashes of each text, sorted; None where it has too few words."""
    powers = [np.uint64(pow(M2, i, 1 << 64)) for i in range(width)]
    words = [WORD.findall(t.lower()) for t in texts]
    sizes = [len(w) for w in words]
    h = np.fromiter(map(hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))
    n = max(0, len(h) - width + 1)
    s = h[:n] * powers[0]
    for i in range(1, width):
        s = mixed(s, i) + h[i : i + n] * powers[i]
    out: list[np.ndarray | None] = []
    at = 0
    for size in sizes:
        out.append(np.unique(s[at : at + size - width + 1]) if size >= max(least_words, width) else None)
        at += size
    return out


#: Bits of the table by which pairs are ruled out.
TABLE = 1024


def parity_bits(s: np.ndarray) -> bytes:
    """A bit for each cell of the features' hashes, of whether it holds an odd number: two tables differ in at most as many bits as the sets in features."""
    return np.packbits(np.bincount((mixed(s, 5) % np.uint64(TABLE)).astype(np.int64), minlength=TABLE) % 2 == 1).tobytes()


def classes_of(df: DataFrame, key: str, text: str, width: int, least_words: int, bits: int, chunk: int = 1 << 16) -> DataFrame:
    """(id, rep, body, text, bits, part, counts): every record with its class, named by the lowest id; one row of a class holds a text and its bit table.

    ``body`` is a hash of the text itself: texts of a class may differ in case,
    punctuation and the like.

    Equal shingle sets are one class.  Within a batch a class sends its text
    once, so that copies, however many, cost a few bytes each.

    Rows with a ``part`` belong to no record: they are each task's counts of the
    features, by hash in 2**``bits`` cells, whatever the size of the data.  A
    class counts once in a batch there.
    """
    chunk = min(chunk, 1 << bits)
    names = ["id", "f1", "f2", "body", "text", "bits", "part", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary()]

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes = WordHash()
        cells = np.zeros(1 << bits, np.int32)
        for b in batches:
            rows: list[tuple] = []
            fresh: list[np.ndarray] = []
            sent: set = set()
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, t, s in zip(ids, texts, shingle_sets(texts, width, least_words, hashes)):
                if s is None:
                    continue
                f = (int(mixed(s, 1).sum() >> np.uint64(1)), int(mixed(s, 2).sum() >> np.uint64(1)))
                new = f not in sent
                rows.append((i, *f, xxhash.xxh64_intdigest(t) - (1 << 63), *((t, parity_bits(s)) if new else (None, None)), None, None))
                if new:
                    fresh.append(s)
                    sent.add(f)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                cells += np.bincount((mixed(np.concatenate(fresh)) & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.int32)
        for k, part in enumerate(cells.reshape(-1, chunk)):
            if part.any():
                row = (None, k, 0, None, None, None, k, zlib.compress(part.tobytes(), 1))
                yield pa.RecordBatch.from_arrays([pa.array([x], k_) for x, k_ in zip(row, kinds)], names)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rep, told, last = None, None, False, None
        for b in batches:
            rows: list[tuple] = []
            for i, f1, f2, body, t, bits, part, counts in zip(*(c.to_pylist() for c in b.columns)):
                if part is not None:
                    rows.append((None, None, None, None, None, part, counts))
                    continue
                if (f1, f2) != current:
                    current, rep, told, last = (f1, f2), i, False, None
                if i == last and (told or t is None):
                    continue  # delivered again
                last = i
                rows.append((i, rep, body, *((None, None) if told else (t, bits)), None, None))
                told = told or t is not None
            if rows:
                out = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), out)], ["id", "rep", "body", "text", "bits", "part", "counts"])

    chosen = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where("id is not null and text is not null")
    printed = chosen.mapInArrow(fingerprints, "id long, f1 long, f2 long, body long, text string, bits binary, part int, counts binary")
    ordered = printed.repartition("f1", "f2").sortWithinPartitions("f1", "f2", "id")
    return ordered.mapInArrow(name, "id long, rep long, body long, text string, bits binary, part int, counts binary")


def feature_sketch(parts: DataFrame, bits: int, chunk: int = 1 << 16) -> np.ndarray:
    """The tasks' counts added up."""
    chunk = min(chunk, 1 << bits)

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(chunk, np.int64)
        for c in t.column("counts").to_pylist():
            total += np.frombuffer(zlib.decompress(c), np.int32)
        return pa.table({"part": t.column("part").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    sums = parts.select("part", "counts").groupBy("part").applyInArrow(add, "part int, counts binary")
    cells = np.zeros(1 << bits, np.int64)
    for part, counts in sums.toLocalIterator():
        cells[part * chunk : (part + 1) * chunk] = np.frombuffer(zlib.decompress(counts), np.int64)
    return cells


@dataclass(frozen=True)
class Scheme:
    """The size bands and, of each band, its groups of three partitions."""

    threshold: float
    base: int
    groups: int  # that make signatures, of each band
    elements: float = 2.0  # features of a set that a signature holds, on the average
    scarce: int = 12  # informative signatures, below which a set uses others too

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.maximum(0, np.floor(np.log(np.maximum(n, 1) / self.base) / -math.log(self.threshold))).astype(np.int64)

    def domain(self, band: int) -> int:
        """Number of groups, for sets of the band's middle size.

        Of a set of n features a group holds 3 at two features for a signature.
        Two such sets of similarity 0.6 differ in n / 2 features, less than twice
        the number of groups, so that some group has at most one of them.
        """
        middle = self.base * self.threshold ** -(band + 0.5)
        return max(4, round(middle / (1.5 * self.elements)))

    def rounds(self, band: int) -> int:
        """Small sets have few groups: their domain is cut several times, by other hashes."""
        return -(-self.groups // self.domain(band))


def least_shared_bits(doc: np.ndarray, bits: np.ndarray, sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Of each set, the mean bits of the features that it shares with a similar set, if these are its most common ones."""
    total = np.append(0, np.cumsum(bits[np.lexsort((bits, doc))].astype(np.int64)))
    starts, n = np.cumsum(sizes) - sizes, np.ceil(threshold * sizes).astype(np.int64)
    return (total[starts + n] - total[starts]) / (8 * np.maximum(n, 1))


def signatures(sets: list[np.ndarray], scheme: Scheme, bits_of: np.ndarray, least_bits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``bits_of``: information by feature hash, in eighths of a bit.

    Returns (index of the set, signature, bits of its rarest feature or -1 where
    the signature is informative), for the set's own band and the next one: a
    larger partner lies in one of the two.
    """
    sizes = np.array([len(s) for s in sets])
    own = scheme.band(sizes)
    flat = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets)), sizes)
    bits = bits_of[(mixed(flat) & np.uint64(len(bits_of) - 1)).astype(np.int64)]
    # too common for a signature of half as many features again as usual to be informative
    common = 1.5 * scheme.elements * least_shared_bits(doc, bits, sizes, scheme.threshold) < least_bits
    out_doc, out_sig, out_top = [], [], []
    for band in range(int(own.min()), int(own.max()) + 2):
        mine = (own == band) | (own == band - 1)
        at = np.flatnonzero(mine[doc])
        if not len(at):
            continue
        width = min(scheme.domain(band), scheme.groups)
        for r in range(scheme.rounds(band)):
            h = mixed(flat[at], 100 + 16 * band + r)
            group = ((h >> np.uint64(20)) % np.uint64(scheme.domain(band))).astype(np.int64)
            kept = group < width
            slot = (doc[at][kept] * width + group[kept]) * 3 + (h[kept] % np.uint64(3)).astype(np.int64)
            cells = len(sets) * width * 3
            sums, top = np.zeros(cells, np.uint64), np.full(cells, -1, np.int16)
            np.add.at(sums, slot, mixed(h[kept], 3))
            np.maximum.at(top, slot, bits[at][kept])
            info = np.bincount(slot, weights=bits[at][kept], minlength=cells) / 8
            sums, top, info = (x.reshape(len(sets), width, 3) for x in (sums, top, info))
            # each subset of two partitions, by the one left out
            of_two = sums.sum(2, dtype=np.uint64, keepdims=True) - sums
            info = info.sum(2, keepdims=True) - info
            top = np.maximum(np.roll(top, -1, axis=2), np.roll(top, -2, axis=2))
            held, good = top >= 0, info >= least_bits
            needs = (good.sum((1, 2)) < scheme.scarce) | common
            row, g, left_out = np.nonzero(good | (held & needs[:, None, None]))
            out_doc.append(row)
            out_sig.append(mixed(of_two[row, g, left_out] + (g * 3 + left_out).astype(np.uint64), 1000 + 16 * band + r))
            out_top.append(np.where(good[row, g, left_out], -1, top[row, g, left_out] // 8))
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_sig).view(np.int64), np.concatenate(out_top)


#: Bits of the sketch that sets of signatures of little information carry.
SKETCH = 128


def bit_sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Of each set, one bit of the least value of each of 128 hash functions: two sets agree in one half of the bits and half their similarity more."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    bits = np.empty((len(sets), SKETCH), bool)
    for k in range(SKETCH):
        least = np.minimum.reduceat((flat ^ np.uint64((k * M3 + M2) & MASK)) * np.uint64(M1 + 2 * k), starts)
        bits[:, k] = (least * np.uint64(M3)) >> np.uint64(63)
    return np.packbits(bits, axis=1).view(np.int64)


def least_agreeing(threshold: float, deviations: float = 4.5) -> int:
    """Bits in which two similar sets agree but for one in 300,000 pairs."""
    mean = (1 + threshold) / 2
    return math.floor(SKETCH * mean - deviations * math.sqrt(SKETCH * mean * (1 - mean)))


def run_pairs(
    sig: np.ndarray, rep: np.ndarray, n: np.ndarray, sketches: np.ndarray, threshold: float, reach: int | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) of the pairs of compatible sizes with equal signatures, which stand together: all, or of at most ``reach`` places apart.

    Pairs whose sketches agree too little are left out; signatures that say much
    come with sketches of zeros.
    """
    agreeing = least_agreeing(threshold)
    ends = np.flatnonzero(np.append(sig[1:] != sig[:-1], True)) if len(sig) else np.zeros(0, int)
    after = ends[np.searchsorted(ends, np.arange(len(sig)))] - np.arange(len(sig))  # rows of the run that follow
    found_a, found_b = [], []
    at, step = np.arange(len(sig)), 1
    while len(at := at[after[at] >= step]) and (reach is None or step <= reach):
        x, y = at, at + step
        x, y = (z[(np.minimum(n[x], n[y]) >= threshold * np.maximum(n[x], n[y])) & (rep[x] != rep[y])] for z in (x, y))
        fit = SKETCH - np.bitwise_count((sketches[x] ^ sketches[y]).view(np.uint64)).sum(1, dtype=np.int64) >= agreeing
        found_a.append(np.minimum(rep[x], rep[y])[fit])
        found_b.append(np.maximum(rep[x], rep[y])[fit])
        step += 1
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)], 1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def beginnings(sets: list[np.ndarray], bits_of: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the set, key of the feature, its place in the set's order) of the rarest features of each set.

    The order is that of the keys: the information by feature hash (``bits_of``),
    then the hash.  A similar set lacks fewer of a set's features than its
    beginning has, and so does the set of the other's: the least feature that
    they share lies in both beginnings.
    """
    sizes = np.array([len(s) for s in sets])
    h = mixed(np.concatenate(sets))
    rank = np.uint64(255) - bits_of[(h & np.uint64(len(bits_of) - 1)).astype(np.int64)].astype(np.uint64)
    keys = (rank << np.uint64(56)) | (h >> np.uint64(8))
    lengths = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
    ends = np.cumsum(sizes)
    chosen = np.concatenate([np.sort(keys[end - size : end])[:k] for end, size, k in zip(ends, sizes, np.minimum(lengths, sizes))])
    lengths = np.minimum(lengths, sizes)
    return np.repeat(np.arange(len(sets)), lengths), chosen.view(np.int64), np.arange(len(chosen)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def largest_partner(n: np.ndarray, at: np.ndarray, threshold: float) -> np.ndarray:
    """The size up to which a set can be similar to one of n features, if the first one that they share has that place in the latter."""
    return (1 + threshold) / threshold * (n - at) - n + 1e-6


def key_pairs(key: np.ndarray, rep: np.ndarray, n: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, features of both) of all pairs of an equal key that stand together, in order of size, unless one is larger than a partner of the other may be."""
    ends = np.flatnonzero(np.append(key[1:] != key[:-1], True)) if len(key) else np.zeros(0, int)
    after = ends[np.searchsorted(ends, np.arange(len(key)))] - np.arange(len(key))  # rows of the run that follow
    found = []
    at, step = np.arange(len(key)), 1
    while len(at := at[after[at] >= step]):
        at = at[n[at + step] <= most[at]]  # those that follow are as large or larger
        x, y = at, at + step
        x, y = (z[(n[x] <= most[y]) & (rep[x] != rep[y])] for z in (x, y))
        found.append(np.stack([np.minimum(rep[x], rep[y]), np.maximum(rep[x], rep[y]), n[x] + n[y]], 1))
        step += 1
    pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    return pairs[:, 0], pairs[:, 1], pairs[:, 2]


def sharing_pairs(begun: DataFrame, threshold: float, hot: int) -> DataFrame:
    """(a, b, n), a < b, of sets that share a key and may be similar, n being the features of both; of a key of more than ``hot`` sets (a, b, null), which join all that may be.

    Rows come sorted by key and size, so a task holds one run of ``hot`` rows at
    most.  In a longer run a set that no smaller one reaches by its largest
    possible partner begins a new stretch, as neither it nor a later one has a
    partner before; each other set is joined to the first one of its stretch.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray, n: np.ndarray | None) -> pa.RecordBatch:
            both = pa.nulls(len(a), pa.int64()) if n is None else pa.array(n, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), both], ["a", "b", "n"])

        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        burning, reached, first = None, -1.0, 0  # the key of the long run that goes on, the size that it reaches, the first set of its stretch
        for b in _with_end(batches):
            if b is not None:
                held = tuple(np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for h, c in zip(held, b.columns))
            key, rep, n, at = held
            if not len(key):
                continue
            most = largest_partner(n, at, threshold)
            ends = np.flatnonzero(np.append(key[1:] != key[:-1], True))
            starts = np.append(0, ends[:-1] + 1)
            size = ends - starts + 1
            long = size > hot
            if burning is not None and key[0] == burning:
                long[0] = True
            else:
                burning = None
            last = len(size) - 1 if b is not None else len(size)  # the last run may go on
            run = np.repeat(np.arange(len(size)), size)
            plain = ~long[run] & (run < last)
            x, y, both = key_pairs(key[plain], rep[plain], n[plain], most[plain])
            if len(x):
                yield rows(x, y, both)
            for k in np.flatnonzero(long):
                part = slice(starts[k], ends[k] + 1)
                if burning is None or key[starts[k]] != burning:
                    burning, reached, first = key[starts[k]], -1.0, rep[starts[k]]
                before = np.maximum.accumulate(np.append(reached, most[part]))
                joined = before[:-1] >= n[part]
                begins = np.maximum.accumulate(np.where(joined, -1, np.arange(len(joined))))
                heads = np.where(begins < 0, first, rep[part][np.maximum(begins, 0)])
                reached, first = before[-1], heads[-1]
                joined &= heads != rep[part]
                if joined.any():
                    yield rows(np.minimum(heads, rep[part])[joined], np.maximum(heads, rep[part])[joined], None)
            keep = slice(len(key), None) if long[-1] else slice(starts[-1], None)
            held = tuple(h[keep] for h in held)

    ordered = begun.repartition("key").sortWithinPartitions("key", "n").select("key", "rep", "n", "at")
    return materialize(ordered.mapInArrow(pairs, "a long, b long, n long"), "pairs")


def not_ruled_out(pairs: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of the pairs (a, b, n) whose bit tables differ no more than similar sets do."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint64).reshape(-1, TABLE // 64) for k in (3, 4))
            differ = np.bitwise_count(x ^ y).sum(1, dtype=np.int64)
            at = pa.array(np.flatnonzero(differ <= (1 - threshold) / (1 + threshold) * b.column(2).to_numpy() + 1e-6))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at)], ["a", "b"])

    bits = reps.select("rep", "bits")
    joined = pairs.join(bits.withColumnsRenamed({"rep": "a", "bits": "bits_a"}), "a").join(bits.withColumnsRenamed({"rep": "b", "bits": "bits_b"}), "b")
    return joined.select("a", "b", "n", "bits_a", "bits_b").mapInArrow(check, "a long, b long")


def candidate_pairs(signed: DataFrame, threshold: float, hot: int, hot_low: int, reach: int) -> DataFrame:
    """(a, b), a < b, of sets that share a signature and agree in size: not all of them, but enough to link most of a family.

    Rows come sorted by signature, so a task holds one run at a time.  Of runs of
    more than ``hot`` rows (``hot_low``, if the signature says little) every row
    is paired with the ``reach`` rows after it only.
    """

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        kinds = (np.int64, np.int64, np.int32, bool, np.int64, np.int64)
        held = tuple(np.zeros(0, k) for k in kinds)
        burning = None  # the signature of the chain that the rows held back belong to
        for b in _with_end(batches):
            if b is not None:
                held = tuple(np.concatenate([h, c.to_numpy(zero_copy_only=False).astype(h.dtype)]) for h, c in zip(held, b.columns))
            sig, rep, n, low, *halves = held
            sketches = np.stack(halves, 1)
            if not len(sig):
                continue
            ends = np.flatnonzero(np.append(sig[1:] != sig[:-1], True))
            starts = np.append(0, ends[:-1] + 1)
            size = ends - starts + 1
            big = size > np.where(low[starts], hot_low, hot)
            if burning is not None and sig[0] == burning:
                big[0] = True
            last = len(size) - 1 if b is not None else len(size)  # the last run may go on
            run = np.repeat(np.arange(len(size)), size)
            plain, chain = ~big[run] & (run < last), big[run]
            x, y = run_pairs(sig[plain], rep[plain], n[plain], sketches[plain], threshold)
            if len(x):
                yield rows(x, y)
            if chain.any():
                x, y = run_pairs(sig[chain], rep[chain], n[chain], sketches[chain], threshold, reach)
                if len(x):
                    yield rows(x, y)
            burning = sig[-1] if big[-1] else None
            # of a chain its last rows, of a run its beginning
            keep = slice(max(starts[-1], len(sig) - reach), None) if big[-1] else slice(starts[-1], None)
            held = tuple(h[keep] for h in held)

    ordered = signed.repartition("sig", "salt").sortWithinPartitions("sig", "place").select("sig", "rep", "n", "low", "sketch_a", "sketch_b")
    return materialize(ordered.mapInArrow(pairs, "a long, b long"), "chains")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def verified(pairs: DataFrame, reps: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs whose shingle sets have at least that Jaccard similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            left = shingle_sets(b.column(2).to_pylist(), width, 0, hashes)
            right = shingle_sets(b.column(3).to_pylist(), width, 0, hashes)
            both = np.array([len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)], np.int64)
            either = np.array([len(x) + len(y) for x, y in zip(left, right)], np.int64) - both
            good = np.flatnonzero(both >= threshold * either - 1e-9)
            at = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(both[good] / either[good], pa.float64())], ["a", "b", "similarity"])

    text = reps.select("rep", "text")
    joined = pairs.join(text.withColumnsRenamed({"rep": "a", "text": "ta"}), "a").join(text.withColumnsRenamed({"rep": "b", "text": "tb"}), "b")
    return joined.select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long, similarity double")


class Block:
    """Sets in groups of at most ``step``, with the features of each group."""

    def __init__(self, reps: np.ndarray, sets: list[np.ndarray], step: int = 512):
        order = np.argsort([int(mixed(s, 7).min()) for s in sets], kind="stable")  # similar sets stand together
        self.groups = []
        for at in range(0, len(order), step):
            chosen = order[at : at + step]
            sizes = np.array([len(sets[i]) for i in chosen])
            flat = np.concatenate([sets[i] for i in chosen])
            self.groups.append((reps[chosen], sizes, flat, np.repeat(np.arange(len(chosen)), sizes), np.unique(flat)))


def block_pairs(left: Block, right: Block, threshold: float, columns: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, similarity) of all similar pairs between two blocks, or within one if both are the same object."""
    for i, (reps_x, n_x, *x, all_x) in enumerate(left.groups):
        for reps_y, n_y, *y, all_y in right.groups[i if left is right else 0 :]:
            shared = np.intersect1d(all_x, all_y, assume_unique=True)
            if not len(shared):
                continue
            sides = []
            for (flat, row), n in ((x, n_x), (y, n_y)):
                column = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
                held = shared[column] == flat
                row, column = row[held], column[held]
                # a set with too few features on the other side has no partner there
                live = np.bincount(row, minlength=len(n)) >= threshold * n - 1e-9
                number = np.cumsum(live) - 1
                sides.append((np.flatnonzero(live), number[row[live[row]]], column[live[row]]))
            (rows_x, row_x, column_x), (rows_y, row_y, column_y) = sides
            if not len(rows_x) or not len(rows_y):
                continue
            both = np.zeros((len(rows_x), len(rows_y)), np.float64)
            for at in range(0, len(shared), columns):
                parts = []
                for rows, row, column in sides:
                    some = (column >= at) & (column < at + columns)
                    m = np.zeros((len(rows), min(columns, len(shared) - at)), np.float32)
                    m[row[some], column[some] - at] = 1
                    parts.append(m)
                both += parts[0] @ parts[1].T
            either = n_x[rows_x][:, None] + n_y[rows_y][None, :] - both
            a, b = np.nonzero(both >= threshold * either - 1e-9)
            rx, ry, similarity = reps_x[rows_x[a]], reps_y[rows_y[b]], both[a, b] / either[a, b]
            keep = rx < ry if reps_x is reps_y else rx != ry
            yield np.minimum(rx, ry)[keep], np.maximum(rx, ry)[keep], similarity[keep]


def family_links(families: DataFrame, threshold: float, block_sets: int, block_features: int = 1 << 21) -> DataFrame:
    """(a, b, similarity) of all similar pairs within each family, but for those of two joined sets: (family, rep, joined, features).

    A family is cut into blocks of about ``block_sets`` sets and ``block_features``
    features at most, and every pair of its blocks is a task's group, so that no
    group grows with the family.  Joined sets are in blocks of their own, of
    which no two are paired.
    """

    def blocks(of: Column) -> Column:
        return F.ceil(F.greatest(F.count_if(of) / block_sets, F.coalesce(F.sum(F.when(of, F.octet_length("features"))), F.lit(0)) / (8 * block_features)))

    cut = families.groupBy("family").agg(blocks(F.col("joined")).alias("closed"), blocks(~F.col("joined")).alias("open")).where("open > 0")
    number = F.xxhash64("rep")
    own = F.when(F.col("joined"), F.pmod(number, F.greatest("closed", F.lit(1)))).otherwise(F.col("closed") + F.pmod(number, F.col("open")))
    placed = families.join(cut, "family").withColumn("own", own)
    least = F.when(F.col("joined"), F.col("closed")).otherwise(F.lit(0).cast("long"))
    placed = placed.withColumn("other", F.explode(F.sequence(least, F.col("closed") + F.col("open") - 1)))
    cells = placed.select("family", F.least("own", "other").alias("u"), F.greatest("own", "other").alias("v"), "own", "rep", "features")

    def compare(t: pa.Table) -> pa.Table:
        own, reps = t.column("own").to_numpy(), t.column("rep").to_numpy()
        sets = [np.frombuffer(f, np.uint64) for f in t.column("features").to_pylist()]
        parts = [Block(reps[at], [sets[i] for i in at]) for k in np.unique(own) for at in [np.flatnonzero(own == k)]]
        same = t.column("u")[0].as_py() == t.column("v")[0].as_py()
        found = list(block_pairs(parts[0], parts[-1], threshold)) if same or len(parts) == 2 else []
        a, b, s = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"a": a, "b": b, "similarity": s})

    return cells.groupBy("family", "u", "v").applyInArrow(compare, "a long, b long, similarity double")


@dataclass
class NearDuplicates:
    """``members``: (id, rep, body), every record with its class and its text's hash; ``links``: (a, b, similarity) between classes, a < b.

    Of a large family the links are only those that signatures give; all of
    them are in :meth:`all_links`.  ``families``: (rep, family) of the classes
    that links may be missing between; None if there are none.
    """

    members: DataFrame
    links: DataFrame
    families: DataFrame | None
    features: Callable[[DataFrame], DataFrame]  # (rep, ...) -> (rep, ..., features)
    threshold: float
    block_sets: int

    def all_links(self) -> DataFrame:
        """(a, b, similarity) of every two similar classes."""
        if self.families is None:
            return self.links
        every = self.features(self.families.withColumn("joined", F.lit(False)))
        within = family_links(materialize(every, "features"), self.threshold, self.block_sets)
        return self.links.unionByName(within).dropDuplicates(["a", "b"])

    def joining_links(self) -> DataFrame:
        """(a, b) of links that have the components of all of them.

        Of each family the classes of its most frequent component are joined as
        it is; the others are compared with these and with each other.
        """
        if self.families is None:
            return self.links.select("a", "b")
        roots = components(self.links.select("a", "b")).withColumnsRenamed({"node": "rep"})
        placed = materialize(self.families.join(roots, "rep", "left").withColumn("root", F.coalesce("root", "rep")), "families")
        counted = placed.groupBy("family", "root").count()
        main = counted.groupBy("family").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
        apart = self.features(placed.join(main, "family").select("rep", "family", (F.col("root") == F.col("main")).alias("joined")))
        rest = family_links(materialize(apart, "features"), self.threshold, self.block_sets)
        return self.links.select("a", "b").unionByName(rest.select("a", "b"))

    def pairs(self, whole_class: int = 1000) -> DataFrame:
        """(a, b), a < b, of all similar records.

        Copies in classes of at most ``whole_class`` records are paired in full.
        In a larger class the records of equal texts are tied together by their
        lowest id, which stands for them in all pairs with other texts, so that
        no output is quadratic in a group of exact copies.
        """
        sizes = self.members.groupBy("rep").count()
        sized = self.members.join(sizes, "rep")
        # of each text of a large class the lowest id
        large = sized.where(F.col("count") > whole_class)
        large = materialize(large.join(large.groupBy("rep", "body").agg(F.min("id").alias("lead")), ["rep", "body"]), "large")
        wide = sized.where(F.col("count") <= whole_class).select("id", "rep", "count").unionByName(large.where("id = lead").select("id", "rep", "count"))
        left, right = wide.select(F.col("id").alias("x"), F.col("rep").alias("a")), wide.select(F.col("id").alias("y"), F.col("rep").alias("b"))
        across = self.all_links().select("a", "b").join(left, "a").join(right, "b").select("x", "y")
        several = wide.where("count > 1")
        within = several.select(F.col("id").alias("x"), "rep").join(several.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y")
        star = large.where("id <> lead").select(F.col("lead").alias("x"), F.col("id").alias("y"))
        every = across.unionByName(within).unionByName(star)
        return every.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def groups(self) -> DataFrame:
        """(id, class_id, group_id): every record with its class and its group.

        A group is a connected component of the links, named by its lowest id.
        """
        roots = components(self.joining_links())
        named = self.members.join(roots.withColumnsRenamed({"node": "rep"}), "rep", "left")
        return named.select("id", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("group_id"))


def united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a task, the root being the lowest node."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (y := above.setdefault(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            above[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60, task_edges: int = 200_000) -> DataFrame:
    """(node, root): every node with the lowest one of its component.

    Up to ``task_edges`` edges are united in one task; more by alternating
    large-star and small-star rounds, of which the tables are written out.
    """
    now = materialize(edges.where("a <> b").distinct(), "edges")
    if now.count() <= task_edges:
        return now.repartition(1).mapInArrow(united, "node long, root long")
    for _ in range(most_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = down.join(least, "u")
        small = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        following = materialize(small.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        if following.exceptAll(now).isEmpty() and now.exceptAll(following).isEmpty():
            break
        now = following
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_duplicates(
    df: DataFrame,
    key: str = "rec_id",
    text: str = "page_content",
    *,
    width: int = 5,
    threshold: float = 0.8,
    least_words: int = 0,
    base: int = 20,
    groups: int = 16,
    sketch_bits: int = 20,
    spare_bits: float = 4.0,
    feature_bits: float = 9.5,
    least_classes: int = 4096,
    hot: int = 512,
    hot_low: int = 16,
    reach: int = 2,
    block_sets: int = 1024,
    salt_rows: int = 1_000_000,
) -> NearDuplicates:
    """Classes of equal and links between similar records; see :class:`NearDuplicates`.

    Words are maximal runs of a-z and 0-9 after lower-casing; a text is the set
    of its ``width`` words in a row, and two texts are similar if their Jaccard
    similarity is at least ``threshold``.  Texts with fewer than ``least_words``
    (or ``width``) words, null texts and null ids are left out; rows with the
    same id count once; other columns are ignored; an empty table gives no rows.

    The sets of a feature that more than ``hot`` of them begin with form a family.
    All its links are sought within it, in blocks of ``block_sets``; what follows
    decides only how many are known without that.

    ``groups`` groups of partitions make three signatures each (in each band),
    more where a signature must hold more than two features of ``feature_bits``
    each.  A signature is informative if it carries log2(number of classes) +
    ``spare_bits`` bits by a sketch of 2**``sketch_bits`` counts; a collection of
    fewer than ``least_classes`` is weighed as one of that size.  Sets with few
    of these, or so many common features that what they share with a similar set
    may make none, use the others too.  A signature of more than ``hot`` sets
    (``hot_low``, if it isn't informative) makes a chain, in which a set is
    compared with the next ``reach``; chains of about ``salt_rows`` sets are cut.
    """
    named = materialize(classes_of(df, key, text, width, least_words, sketch_bits), "classes")
    members, reps = named.where("id is not null").select("id", "rep", "body").dropDuplicates(["id", "rep"]), named.where("text is not null").select("rep", "text", "bits")
    count = reps.count()
    sketch = feature_sketch(named.where("part is not null"), sketch_bits)
    size = max(count, least_classes)
    bits_of = np.clip(-8 * np.log2(np.maximum(sketch, 1) / size), 0, 255).astype(np.uint8)  # in eighths
    sent = df.sparkSession.sparkContext.broadcast(bits_of)  # 2**sketch_bits bytes, whatever the data
    least_bits = math.log2(size) + spare_bits
    # a larger collection needs signatures of more features, and more of them, as fewer are shared whole
    elements = max(2.0, least_bits / feature_bits)
    scheme = Scheme(threshold, base, round(groups * (elements / 2) ** 2), elements)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                sets = shingle_sets(part.column(1).to_pylist(), width, least_words, hashes)
                doc, key, place = beginnings(sets, sent.value, threshold)
                n = np.array([len(s) for s in sets], np.int32)[doc]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (key, part.column(0).to_numpy()[doc], n, place.astype(np.int32))], ["key", "rep", "n", "at"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                ids = part.column(0).to_numpy()
                sets = shingle_sets(part.column(1).to_pylist(), width, least_words, hashes)
                doc, sig, top = signatures(sets, scheme, sent.value, least_bits)
                n = np.array([len(s) for s in sets], np.int32)[doc]
                rep, low = ids[doc], top >= 0
                place = mixed(rep.view(np.uint64) ^ sig.view(np.uint64), 9)  # an order of its own for each signature
                # at most as many sets share it as have its rarest feature
                chains = np.where(low, np.maximum(1, size * 2.0 ** -np.maximum(top, 0) // salt_rows), 1).astype(np.uint64)
                sketches = np.zeros((len(sets), 2), np.int64)
                if low.any():
                    some = np.unique(doc[low])
                    sketches[some] = bit_sketches([sets[i] for i in some])
                halves = np.where(low[:, None], sketches[doc], 0)
                cells = [sig, rep, n, low, halves[:, 0], halves[:, 1], (place % chains).astype(np.int32), (place >> np.uint64(33)).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], ["sig", "rep", "n", "low", "sketch_a", "sketch_b", "salt", "place"])

    def features(chosen: DataFrame) -> DataFrame:
        def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHash()
            for b in batches:
                sets = shingle_sets(b.column(b.num_columns - 1).to_pylist(), width, least_words, hashes)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x.tobytes() for x in sets], pa.binary())], [*b.schema.names[:-1], "features"])

        joined = chosen.join(reps, "rep").select(*chosen.columns, "text")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in joined.schema.fields[:-1])
        return joined.mapInArrow(shingled, f"{kinds}, features binary")

    text = reps.select("rep", "text")
    found = sharing_pairs(text.mapInArrow(begin, "key long, rep long, n int, at int"), threshold, hot)
    candidates = not_ruled_out(found.where("n is not null").distinct(), reps, threshold)
    links = materialize(verified(candidates, reps, width, threshold), "links")
    joined = found.where("n is null").select("a", "b")
    if joined.isEmpty():
        return NearDuplicates(members, links, None, features, threshold, block_sets)
    families = materialize(components(joined).select(F.col("node").alias("rep"), F.col("root").alias("family")), "families")
    signed = text.join(families, "rep", "leftsemi").mapInArrow(sign, "sig long, rep long, n int, low boolean, sketch_a long, sketch_b long, salt int, place int")
    chained = candidate_pairs(signed, threshold, hot, hot_low, reach).distinct().join(links, ["a", "b"], "leftanti")
    links = materialize(links.unionByName(verified(chained, reps, width, threshold)), "links")
    return NearDuplicates(members, links, families, features, threshold, block_sets)
