"""Sections by header, pieces by size, and windows over tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siltstone.schemas import CHUNK_CHARS, CHUNK_OVERLAP, INGEST_WINDOW, WINDOW_OVERLAP
from siltstone.session import ship

SEPARATORS = ("\n\n", "\n", " ", "")


def header_sections(text: str, levels: int = 3) -> list[str]:
    """Contents between the headers of the first ``levels`` levels, without the header lines.

    Lines are stripped of blanks and of characters that don't print.  Blank
    lines end a paragraph; paragraphs under the same path of headers, with no
    other between them, are joined by two blanks and a line feed.  Inside a
    fence nothing is a header and blank lines stay.
    """
    out: list[tuple[tuple, str]] = []
    path: list[tuple[int, str]] = []
    lines: list[str] = []
    fence = ""

    def close() -> None:
        if lines:
            key, content = tuple(path), "\n".join(lines)
            if out and out[-1][0] == key:
                out[-1] = (key, out[-1][1] + "  \n" + content)
            else:
                out.append((key, content))
            lines.clear()

    for raw in text.split("\n"):
        line = "".join(filter(str.isprintable, raw.strip()))
        if fence:
            closing = line.startswith(fence)
            fence = "" if closing else fence
            if not closing:
                lines.append(line)
                continue
        elif (line.startswith("```") and line.count("```") == 1) or line.startswith("~~~"):
            fence = line[:3]
            lines.append(line)
            continue
        depth = len(line) - len(line.lstrip("#"))
        if 1 <= depth <= levels and (len(line) == depth or line[depth] == " "):
            close()
            while path and path[-1][0] >= depth:
                path.pop()
            path.append((depth, line[depth:].strip()))
        elif line:
            lines.append(line)
        else:
            close()
    close()
    return [content for _, content in out]


def sized_pieces(text: str, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Greedy pieces of at most ``size`` characters that repeat at most ``overlap``.

    The text is cut at the first of the ``separators`` that it holds, which stay
    at the head of the part that follows; parts are gathered while they fit, and
    parts that are too long alone are cut at the separators further down.
    """
    level = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, finer = separators[level], separators[level + 1 :]
    if mark:
        head, *rest = text.split(mark)
        parts = [p for p in (head, *(mark + r for r in rest)) if p]
    else:
        parts = list(text)
    out: list[str] = []
    fitting: list[str] = []
    for p in parts:
        if len(p) < size:
            fitting.append(p)
            continue
        out += _gathered(fitting, size, overlap)
        fitting = []
        out += sized_pieces(p, size, overlap, finer) if finer else [p]
    return out + _gathered(fitting, size, overlap)


def _gathered(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    first, total = 0, 0
    for i, p in enumerate(parts):
        if total + len(p) > size and i > first:
            out.append("".join(parts[first:i]).strip())
            while first < i and (total > overlap or (total + len(p) > size and total > 0)):
                total -= len(parts[first])
                first += 1
        total += len(p)
    if first < len(parts):
        out.append("".join(parts[first:]).strip())
    return [x for x in out if x]


def chunk_documents(df: DataFrame, text: str = "content", *, size: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Every column of ``df`` but ``text``, with ``section_ix``, ``piece_ix`` and ``chunk`` for each piece.

    Null and blank texts give no piece.
    """
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name != text]
    schema = StructType([*kept, StructField("section_ix", IntegerType()), StructField("piece_ix", IntegerType()), StructField("chunk", StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, section, piece, chunk = [], [], [], []
            for i, t in enumerate(b.column(b.schema.get_field_index(text)).to_pylist()):
                for s, content in enumerate(header_sections(t or "")):
                    for k, c in enumerate(sized_pieces(content, size, overlap)):
                        row.append(i)
                        section.append(s)
                        piece.append(k)
                        chunk.append(c)
            at = pa.array(row, pa.int64())
            columns = [b.column(b.schema.get_field_index(f.name)).take(at) for f in kept]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(section, pa.int32()), pa.array(piece, pa.int32()), pa.array(chunk, pa.string())],
                [*(f.name for f in kept), "section_ix", "piece_ix", "chunk"],
            )

    return df.mapInArrow(cut, schema)


def tokens(text: Column) -> Column:
    """Runs of non-blank characters; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: t != "")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Numbers of the windows over ``n`` tokens: one if they fit (or there are none), else a window at every step."""
    step = size - overlap
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.ceil(n / F.lit(step)).cast("int") - 1))


def token_windows(df: DataFrame, token_array: str, *, size: int = INGEST_WINDOW, overlap: int = WINDOW_OVERLAP) -> DataFrame:
    """Every other column, with ``window_ix`` and ``window`` (the tokens) for each window."""
    kept = [c for c in df.columns if c != token_array]
    spread = df.select(*kept, F.col(token_array), F.explode(window_starts(F.size(token_array), size, overlap)).alias("window_ix"))
    return spread.select(*kept, "window_ix", F.slice(F.col(token_array), F.col("window_ix") * (size - overlap) + 1, F.lit(size)).alias("window"))
