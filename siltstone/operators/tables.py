"""Tables as text: Markdown, JSON and one sentence for each row."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")


def _cell(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def header(table: Column) -> Column:
    """The first row, null cells as ''."""
    return F.transform(table[0], _cell)


def body(table: Column) -> Column:
    return F.slice(table, 2, F.greatest(F.size(table) - 1, F.lit(0)))


def markdown(head: Column, rows: Column) -> Column:
    def line(cells: Column) -> Column:
        return F.concat(F.lit("| "), F.array_join(F.transform(cells, _cell), " | "), F.lit(" |\n"))

    rule = F.concat(F.repeat(F.lit("|---"), F.size(head)), F.lit("|\n"))
    return F.concat(line(head), rule, F.array_join(F.transform(rows, line), ""))


def json(head: Column, rows: Column) -> Column:
    """Compact JSON; null cells of the rows stay null, non-ASCII characters stay as they are."""
    return F.to_json(F.struct(head.alias("headers"), rows.alias("rows")), {"ignoreNullFields": "false"})


def row_sentences(df: DataFrame, head: str, rows: str, *, strict_csv: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., row_ix, sentence): 'Row -> h1: v1, h2: v2' for each row.

    ``strict_csv`` takes the cells through unquoted CSV, as tables have always
    been stored: a comma in a cell moves the cells after it, a line break starts
    a row, quotes are CSV quotes, and a row equal to the header is left out.
    Without it, cells are taken as they are (rows equal to the header are left
    out too).  The longer of header and row is cut.
    """
    if not strict_csv:
        pairs = F.transform(
            F.slice(F.arrays_zip(F.col("_h"), F.col("_r")), 1, F.least(F.size("_h"), F.size("_r"))),
            lambda p: F.concat(F.trim(p["_h"]), F.lit(": "), F.trim(p["_r"])),
        )
        flat = df.select(*keep, F.col(head).alias("_h"), F.posexplode(rows).alias("row_ix", "_raw")).withColumn("_r", F.transform("_raw", _cell))
        return flat.where(F.col("_r") != F.col("_h")).select(*keep, "row_ix", F.concat(F.lit("Row -> "), F.array_join(pairs, ", ")).alias("sentence"))

    rendered = df.select(*keep, F.col(head).alias("_h"), F.col(rows).alias("_r"))
    fields = [*rendered.schema.fields[: len(keep)], T.StructField("row_ix", T.IntegerType()), T.StructField("sentence", T.StringType())]

    def reread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            owner, number, said = [], [], []
            for at, (titles, body_) in enumerate(zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist())):
                for n, s in enumerate(sentences_of(titles, body_ or ()) if titles is not None else ()):
                    owner.append(at)
                    number.append(n)
                    said.append(s)
            kept = [c.take(pa.array(owner, pa.int64())) for c in b.columns[: len(keep)]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(number, pa.int32()), pa.array(said, pa.string())], [f.name for f in fields])

    return rendered.mapInArrow(reread, T.StructType(fields))


def sentences_of(titles: Sequence[str | None], records: Iterable[Sequence[str | None]]) -> list[str]:
    """A table's sentences, its cells read back from the lines of an unquoted CSV file."""
    titles = [t or "" for t in titles]
    file = "\n".join(",".join(c or "" for c in cells) for cells in chain([titles], records))
    lines = LINE.findall(file)  # any of the usual line ends; the one of the file's last line may be missing
    read = [cells for cells in csv.reader(lines) if cells != titles]
    labels = [f"{t.strip()}: " for t in titles]
    # The wording of a row's sentence.
    return ["Row -> " + ", ".join(map(add, labels, (c.strip() for c in cells))) for cells in read]
