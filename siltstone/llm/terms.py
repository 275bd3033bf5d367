"""Problem 5: occurrences and record counts of every term, with a mark on the rare and the common.

Method: last-seen counters.  Tokens are read in runs, record by record, and every
term keeps just three numbers - occurrences, records, and the last record it
was seen in - and no set of records.  A term counts a record where that is not
the one it was last seen in.  The counters of a task are then hash-partitioned
by term and added up.

A record may be delivered several times, and then counts once.  Only ids are
shuffled to find those that repeat; a bit table of them, of fixed size, tells a
task which of its records can't be among them.  Those are counted where they are
read.  The others, few of them by the collision of their bits, are
hash-partitioned and ordered by record, so that copies stand next to each other.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import RepeatedIds, rows_and_copies
from siltstone.session import materialize

#: The term under which a task reports the number of records that it read.
TOTAL = ""


class LastSeen:
    """Counters of terms: occurrences, records, and the number of the record last seen."""

    def __init__(self) -> None:
        self.terms: dict[str, int] = {}
        self.occurrences = np.zeros(1024, np.int64)
        self.records = np.zeros(1024, np.int64)
        self.last = np.full(1024, -1, np.int64)
        self.total = 0

    def read(self, runs: list[list[str]], first: int) -> None:
        """Count the tokens of some records, numbered from ``first`` on; the first may go on where the last call ended."""
        known = self.terms
        number = np.fromiter((known.setdefault(t, len(known)) for t in chain.from_iterable(runs)), np.int64, sum(map(len, runs)))
        if len(known) > len(self.last):
            more = max(len(known), 2 * len(self.last)) - len(self.last)
            self.occurrences = np.append(self.occurrences, np.zeros(more, np.int64))
            self.records = np.append(self.records, np.zeros(more, np.int64))
            self.last = np.append(self.last, np.full(more, -1, np.int64))
        if not len(number):
            return
        self.occurrences[: len(known)] += np.bincount(number, minlength=len(known))
        record = np.repeat(np.arange(first, first + len(runs)), [len(r) for r in runs])
        order = np.argsort(number, kind="stable")  # tokens of a term, in the order of the records
        number, record = number[order], record[order]
        opens = np.append(True, number[1:] != number[:-1])
        before = np.append(-1, record[:-1])
        before[opens] = self.last[number[opens]]
        self.records[: len(known)] += np.bincount(number[before != record], minlength=len(known))
        self.last[number] = record  # the last one written is the last one seen

    def dump(self) -> pa.RecordBatch:
        n = len(self.terms)
        cells = (
            pa.array([*self.terms, TOTAL], pa.string()),
            pa.array(np.append(self.occurrences[:n], 0)),
            pa.array(np.append(self.records[:n], self.total)),
        )
        self.__init__()
        return pa.RecordBatch.from_arrays(list(cells), ["term", "occurrences", "records"])


def counters(pattern: re.Pattern, flush_terms: int, skip: RepeatedIds | None, chunk: int = 1024):
    """The counting of one task; with ``skip``, of the records that can't be among the repeated, else of records in key order."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = LastSeen()
        number, last = -1, None
        for b in batches:
            keep = b if skip is None else b.filter(pa.array(~skip.possible(b.column(2).to_numpy())))
            for at in range(0, keep.num_rows, chunk):
                part = keep.slice(at, chunk)
                runs, first = [], number + 1
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if skip is None and k == last:
                        continue  # a copy of the record before
                    last = k
                    number += 1
                    runs.append(pattern.findall(t.lower()))
                seen.total += len(runs)
                seen.read(runs, first)
                if len(seen.terms) > flush_terms:  # between two records, so no last-seen mark is cut
                    yield seen.dump()
        yield seen.dump()

    return count


def partial_counters(df: DataFrame, key: str, text: str, min_letters: int, flush_terms: int, table_bits: int) -> DataFrame:
    """Partial (term, occurrences, records) rows of every task."""
    pattern = re.compile("[a-z]{%d,}" % min_letters)
    schema = "term string, occurrences long, records long"
    rows, repeated, copies = rows_and_copies(df, key, text, table_bits)
    single = rows.mapInArrow(counters(pattern, flush_terms, repeated), schema)
    return single.unionByName(copies.mapInArrow(counters(pattern, flush_terms, None), schema))


def term_frequencies(
    df: DataFrame,
    key: str = "rec_id",
    text: str = "page_content",
    *,
    min_letters: int = 3,
    rare_records: int = 2,
    common_share: float = 0.2,
    flush_terms: int = 200_000,
    table_bits: int = 22,
) -> DataFrame:
    """(term, occurrences, records, mark) for every term of the collection.

    Terms are maximal runs of a-z of at least ``min_letters`` letters after
    lower-casing.  ``mark`` is ``rare`` (at most ``rare_records`` records),
    ``common`` (more than ``common_share`` of all records with text and not
    rare) or null.  Rows with a null key or null text don't count; blank text
    counts as a record without terms; rows with the same key count once; an
    empty table gives no rows.  Other columns are ignored, whatever their names.
    ``flush_terms`` bounds a task's dictionary, and 2**``table_bits`` is the size
    of the table of repeated ids; neither changes the result.
    """
    parts = partial_counters(df, key, text, min_letters, flush_terms, table_bits)
    sums = materialize(parts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")), "terms")
    total = sums.where(F.col("term") == TOTAL).agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    mark = F.when(F.col("records") <= rare_records, "rare").when(F.col("records") > F.lit(total) * F.lit(common_share), "common")
    return sums.where(F.col("term") != TOTAL).withColumn("mark", mark)
