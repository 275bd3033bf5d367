"""Problem 8: documents that repeat passages of held-out items.

Method: a positional inverted index, partitioned by document and stored.  A
segment of it holds, for every term of some documents, the sorted positions of
its occurrences; the items' terms are looked up there.  A run of ``min_words`` words always covers a
whole aligned block of ``min_words // 2`` words of the item, so each block is a
phrase query: its terms' position lists, shifted by their offsets, are
intersected from the rarest term on.  Matches are then extended to both sides.
A run that is broken at places holds no such block for certain, so for these
every two terms that may follow each other in an item are looked up among the
terms that do so in the documents; the steps found are chained.
The documents are read once, however many items are asked, and later items find
the index as it is.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from siltstone.session import materialize, ship

WORD = re.compile("[a-z0-9]+")
NOWHERE = np.zeros(0, np.int64)


class Items:
    """Held-out items as term numbers, with the aligned blocks that have to be looked up."""

    def __init__(self, rows: list[tuple[int, str]], min_words: int):
        self.terms: dict[str, int] = {}
        self.width = max(1, min_words // 2)
        self.ids: list = []
        self.words: list[np.ndarray] = []
        where: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in rows:
            words = WORD.findall(text.lower())
            if len(words) < min_words:
                continue
            numbers = np.array([self.terms.setdefault(w, len(self.terms)) for w in words], np.int32)
            for at in range(0, len(numbers) - self.width + 1, self.width):
                where[tuple(numbers[at : at + self.width].tolist())].append((len(self.ids), at))
            self.ids.append(item_id)
            self.words.append(numbers)
        self.blocks = list(where.items())  # equal blocks of several items are looked up once
        self.item_of = np.repeat(np.arange(len(self.ids)), [len(w) for w in self.words])
        self.starts = np.cumsum([0, *(len(w) for w in self.words)])

    def steps(self, gap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair of terms, position in all items, step), by pair: terms with at most ``gap`` others between them."""
        flat = np.concatenate([*self.words, np.zeros(0, np.int32)]).astype(np.int64)
        pair, at, step = [], [], []
        for d in range(1, gap + 2):
            first = np.flatnonzero(self.item_of[:-d] == self.item_of[d:])
            pair.append(flat[first] * len(self.terms) + flat[first + d])
            at.append(first)
            step.append(np.full(len(first), d))
        pair, at, step = np.concatenate(pair), np.concatenate(at), np.concatenate(step)
        order = np.argsort(pair, kind="stable")
        return pair[order], at[order], step[order]


def segment_row(keys: list, words: list[list[str]]) -> tuple:
    """(keys, starts, length, terms, bounds, positions) of some documents: where each begins, and of each term its sorted positions.

    Documents are one place apart, so that phrases don't reach from one into the
    next.  All numbers are 32-bit integers.
    """
    number: dict[str, int] = {}
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    flat = np.fromiter((number.setdefault(w, len(number)) for w in chain.from_iterable(words)), np.int32, int(sizes.sum()))
    at = (np.arange(len(flat)) + np.repeat(np.arange(1, len(words) + 1), sizes)).astype(np.int32)
    order = np.argsort(flat, kind="stable")
    bounds = np.searchsorted(flat[order], np.arange(len(number)), side="right")
    return keys, starts.astype(np.int32).tobytes(), int(sizes.sum()) + len(words) + 1, list(number), bounds.astype(np.int32).tobytes(), at[order].tobytes()


class Segment:
    """What a stored segment says of the items' terms."""

    def __init__(self, starts: bytes, length: int, terms: list[str], bounds: bytes, positions: bytes, items: Items):
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        self.words = np.full(length, -1, np.int32)  # -1: no term of the items
        ends, flat = np.frombuffer(bounds, np.int32), np.frombuffer(positions, np.int32)
        self.found: dict[int, np.ndarray] = {}
        number = items.terms.get
        for i, t in enumerate(terms):
            if (k := number(t)) is not None:
                at = flat[ends[i - 1] if i else 0 : ends[i]].astype(np.int64)
                self.found[k] = at
                self.words[at] = k

    def postings(self, term: int) -> np.ndarray:
        return self.found.get(term, NOWHERE)

    def phrase(self, terms: tuple[int, ...]) -> np.ndarray:
        """Positions at which the terms stand in a row."""
        order = sorted(range(len(terms)), key=lambda k: len(self.postings(terms[k])))
        found = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other = self.postings(terms[k])
            i = np.searchsorted(other, found + k)
            found = found[(i < len(other)) & (other[np.minimum(i, len(other) - 1)] == found + k)]
        return found

    def extended(self, found: np.ndarray, width: int, words: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
        """How many further words agree to the left and to the right of each match."""
        sides = []
        for step, first, room in ((-1, at - 1, at), (1, at + width, len(words) - at - width)):
            more = np.zeros(len(found), np.int64)
            live = np.arange(len(found))
            edge = found - 1 if step < 0 else found + width
            for n in range(room):
                live = live[self.words[edge[live] + step * n] == words[first + step * n]]
                if not len(live):
                    break
                more[live] = n + 1
            sides.append(more)
        return sides[0], sides[1]


def broken_runs(segment: Segment, items: Items, min_words: int, gap: int, most_steps: int = 1 << 21) -> Iterator[tuple[np.ndarray, ...]]:
    """(document number, item number, words, position in the document, position in the item) of the longest chains.

    A chain's equal words follow each other with at most ``gap`` others between
    them, in text and item alike; of chains that begin at one word the longest
    counts.  Unbroken ones are left out.  About ``most_steps`` steps are held.
    """
    pairs, item_at, item_step = items.steps(gap)
    if not len(pairs):
        return
    known, first, count = np.unique(pairs, return_index=True, return_counts=True)
    words = segment.words.astype(np.int64)
    doc = np.searchsorted(segment.starts, np.arange(len(words)), side="right")
    columns = []
    for d in range(1, gap + 2):
        at = np.flatnonzero((words[:-d] >= 0) & (words[d:] >= 0) & (doc[:-d] == doc[d:]))
        pair = words[at] * len(items.terms) + words[at + d]
        k = np.minimum(np.searchsorted(known, pair), len(known) - 1)
        hit = known[k] == pair
        columns.append(np.stack([at[hit], np.full(hit.sum(), d), k[hit]]))
    at, step, k = np.concatenate(columns, 1)
    order = np.argsort(at, kind="stable")
    at, step, k = at[order], step[order], k[order]
    total = np.cumsum(count[k])
    ends = np.flatnonzero(np.append(doc[at[1:]] != doc[at[:-1]], True)) + 1 if len(at) else np.zeros(0, int)
    begin = 0
    while begin < len(at):  # whole documents
        held = total[begin - 1] if begin else 0
        fit = ends[: np.searchsorted(total[ends - 1], held + most_steps, side="right")]
        end = fit[-1] if len(fit) and fit[-1] > begin else ends[np.searchsorted(ends, begin, side="right")]
        n = count[k[begin:end]]
        entry = np.repeat(first[k[begin:end]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield from chains(segment, items, np.repeat(at[begin:end], n), np.repeat(step[begin:end], n), item_at[entry], item_step[entry], min_words, gap)
        begin = end


def chains(
    segment: Segment, items: Items, at: np.ndarray, step: np.ndarray, item_at: np.ndarray, item_step: np.ndarray, min_words: int, gap: int
) -> Iterator[tuple[np.ndarray, ...]]:
    """The longest chains of steps from (at, item_at) to (at + step, item_at + item_step)."""
    span = min_words + (min_words - 1) * gap  # min_words of a chain lie in one of two overlapping windows
    live = np.zeros(len(at), bool)
    for shift in (0, span):
        _, window, size = np.unique((at + shift) // (2 * span) * len(items.ids) + items.item_of[item_at], return_inverse=True, return_counts=True)
        live |= (size >= min_words - 1)[window]
    at, step, item_at, item_step = at[live], step[live], item_at[live], item_step[live]
    width = len(items.item_of)
    nodes, ends = np.unique(np.concatenate([at * width + item_at, (at + step) * width + item_at + item_step]), return_inverse=True)
    if not len(nodes):
        return
    source, target = ends[: len(at)], ends[len(at) :]
    order = np.lexsort((step + item_step, source))  # of equally long chains the one with the smaller break
    source, target, wide = source[order], target[order], (step + item_step)[order]
    bounds = np.searchsorted(source, np.arange(len(nodes) + 1))
    open_steps = np.bincount(target, minlength=len(nodes))
    head, length = np.arange(len(nodes)), np.ones(len(nodes), np.int64)
    front, n = np.flatnonzero(open_steps == 0), 1
    while len(front):  # layer n: words at which the longest chain has n words
        m = bounds[front + 1] - bounds[front]
        edge = np.repeat(bounds[front] - (np.cumsum(m) - m), m) + np.arange(m.sum())
        np.subtract.at(open_steps, target[edge], 1)
        edge = edge[open_steps[target[edge]] == 0]
        edge = edge[np.lexsort((wide[edge], target[edge]))]
        edge = edge[np.append(True, target[edge][1:] != target[edge][:-1])] if len(edge) else edge
        front, n = target[edge], n + 1
        head[front], length[front] = head[source[edge]], n
    order = np.lexsort((-length, head))
    best = order[np.append(True, head[order][1:] != head[order][:-1])]
    start, of_item = np.divmod(nodes[head[best]], width)
    last, last_item = np.divmod(nodes[best], width)
    n = length[best]
    good = (n >= min_words) & ((last - start >= n) | (last_item - of_item >= n))
    start, of_item, n = start[good], of_item[good], n[good]
    doc, item = np.searchsorted(segment.starts, start, side="right") - 1, items.item_of[of_item]
    yield doc, item, n, start - segment.starts[doc], of_item - items.starts[item]


def runs(segment: Segment, items: Items, min_words: int, near_gap: int) -> Iterator[tuple[np.ndarray, int, str, np.ndarray, np.ndarray, np.ndarray]]:
    """(document numbers, item number, kind, words, position in the document, position in the item)."""
    by_item: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = defaultdict(list)
    for terms, places in items.blocks:
        found = segment.phrase(terms)
        if not len(found):
            continue
        for item, at in places:
            left, right = segment.extended(found, items.width, items.words[item], at)
            length = items.width + left + right
            keep = length >= min_words
            if keep.any():
                by_item[item].append((found[keep] - left[keep], at - left[keep], length[keep]))
    for item, parts in by_item.items():
        start, of_item, length = (np.concatenate(x) for x in zip(*parts))
        table = np.unique(np.stack([start, of_item, length], 1), axis=0)
        start, of_item, length = table.T
        doc = np.searchsorted(segment.starts, start, side="right") - 1
        yield doc, item, "phrase", length, start - segment.starts[doc], of_item
    if near_gap:
        for doc, item, length, start, of_item in broken_runs(segment, items, min_words, near_gap):
            for i in np.unique(item):
                of = item == i
                yield doc[of], i, "near", length[of], start[of], of_item[of]


@dataclass
class PassageIndex:
    """Stored segments of documents: (keys, starts, length, terms, bounds, positions)."""

    segments: DataFrame
    key: str

    def find(
        self, benchmark: DataFrame, *, item_key: str = "item_id", item_text: str = "text", min_words: int = 12, near_gap: int = 2, block_items: int = 5_000
    ) -> DataFrame:
        """Passages of the items; see :func:`leaked_passages`.

        Up to ``block_items`` items are sent to the tasks that read the segments.
        More are cut into blocks of about that size, and every pair of a block
        and a segment is a group of one join.
        """
        kind, item_kind = self.segments.schema["keys"].dataType.elementType, benchmark.schema[item_key].dataType
        schema = f"{self.key} {kind.simpleString()}, {item_key} {item_kind.simpleString()}, kind string, words int, doc_word int, item_word int"
        types = [to_arrow_type(kind), to_arrow_type(item_kind), pa.string(), pa.int32(), pa.int32(), pa.int32()]
        names = [self.key, item_key, "kind", "words", "doc_word", "item_word"]
        columns = ["keys", "starts", "length", "terms", "bounds", "positions"]

        def match(rows: pa.RecordBatch | pa.Table, items: Items) -> Iterator[pa.RecordBatch]:
            for at in range(rows.num_rows):
                keys, *stored = (rows.column(c)[at].as_py() for c in columns)
                for doc, item, what, n, at_word, of_item in runs(Segment(*stored, items), items, min_words, near_gap):
                    cells = [[keys[d] for d in doc], [items.ids[item]] * len(doc), [what] * len(doc), n, at_word, of_item]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, types)], names)

        asked = benchmark.select(F.col(item_key).alias("item"), F.col(item_text).alias("t")).where("item is not null and t is not null").distinct()
        head = asked.limit(block_items + 1).collect()
        if len(head) <= block_items:
            rows = [(r["item"], r["t"]) for r in head]

            def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                items = Items(rows, min_words)
                for b in batches:
                    yield from match(b, items)

            return self.segments.select(*columns).mapInArrow(scan, schema).distinct()

        asked = materialize(asked, "items")
        blocks, cells = -(-asked.count() // block_items), max(1, self.segments.count())

        def compare(left: pa.Table, right: pa.Table) -> pa.Table:
            items = Items(list(zip(left.column("item").to_pylist(), left.column("t").to_pylist())), min_words)
            return pa.Table.from_batches(match(right, items), pa.schema(list(zip(names, types))))

        left = asked.withColumns({"block": F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"), "cell": F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))})
        right = self.segments.withColumns({"cell": F.pmod(F.xxhash64("starts", F.col("keys")[0]), F.lit(cells)).cast("int"), "block": F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))})
        return left.groupBy("block", "cell").cogroup(right.groupBy("block", "cell")).applyInArrow(compare, schema).distinct()


def index_passages(docs: DataFrame, *, key: str = "doc_id", text: str = "text", segment_words: int = 500_000) -> PassageIndex:
    """The stored index of all documents with key and text; ``segment_words`` bounds a segment, but for its last document."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType
    types = [pa.list_(to_arrow_type(kind)), pa.binary(), pa.int32(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list = []
        words: list[list[str]] = []
        size = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(segment_row(keys, words), types)], ["keys", "starts", "length", "terms", "bounds", "positions"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys.append(k)
                words.append(WORD.findall(t.lower()))
                size += len(words[-1])
                if size >= segment_words:
                    yield row()
                    keys, words, size = [], [], 0
        if keys:
            yield row()

    chosen = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    schema = f"keys array<{kind.simpleString()}>, starts binary, length int, terms array<string>, bounds binary, positions binary"
    return PassageIndex(materialize(chosen.mapInArrow(cut, schema), "passages"), key)


def leaked_passages(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    min_words: int = 12,
    near_gap: int = 2,
    segment_words: int = 500_000,
    block_items: int = 5_000,
) -> DataFrame:
    """(key, item_key, kind, words, doc_word, item_word): passages of the items found in the documents.

    Words are maximal runs of a-z and 0-9 after lower-casing.  ``phrase``: at
    least ``min_words`` words in a row are equal.  ``near``: such a row is
    broken by at most ``near_gap`` words at a place, on either side (0: not
    sought), at any number of places.  Positions count words from 0.  Items with fewer words match
    nothing.  Rows with null key or null text are skipped, rows that repeat
    give one match, other columns are ignored, empty tables give no rows.

    The documents' index is written first, see :func:`index_passages`; to ask
    several times, keep it and use :meth:`PassageIndex.find`.
    """
    index = index_passages(docs, key=key, text=text, segment_words=segment_words)
    return index.find(benchmark, item_key=item_key, item_text=item_text, min_words=min_words, near_gap=near_gap, block_items=block_items)
