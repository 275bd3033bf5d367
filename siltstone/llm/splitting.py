"""Problem 4: cutting oversized sections at natural boundaries, with overlap.

Method: pointer doubling.  Every place where a piece may begin is joined to the
place where the next piece must begin (farthest legal cut, less the overlap).
Squaring that successor table yields the places reached in 1, 2, 4, ... steps;
what is reached from the start of a section are its cuts, found for all
sections of a table at once in logarithmically many rounds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from siltstone.llm.common import BLANKS, map_rows

HEADER = re.compile(r"#{1,3}(?: |$)")
FENCES = ("```", "~~~")
WORD = re.compile(r"[^ \t\r\n]+")
SENTENCE_END = re.compile(r"[.!?…](?=[ \t\r\n])")
LINE_END = re.compile(r"(?=\n)")


def sections(text: str) -> Iterator[tuple[int, int, int]]:
    """(section_no, start, end) of every section, trimmed of blanks at both ends.

    Section 0 precedes the first header line; section n follows the n-th.
    """
    number, start, at, fence = 0, 0, 0, None
    for line in text.split("\n"):
        bare = line.strip(BLANKS)
        if fence is None:
            if bare.startswith(FENCES):
                fence = bare[:3]
            elif HEADER.match(bare):
                yield number, *trimmed(text, start, at)
                number, start = number + 1, min(at + len(line) + 1, len(text))
        elif bare.startswith(fence):
            fence = None
        at += len(line) + 1
    yield number, *trimmed(text, start, len(text))


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    part = text[start:end]
    start += len(part) - len(part.lstrip(BLANKS))
    return start, max(start, start + len(part.strip(BLANKS)))


def successors(starts: np.ndarray, last: np.ndarray, begins: np.ndarray, stops: list[np.ndarray], size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """For every start: where its piece ends, and the index of the next start (its own where the section ends).

    ``last``: end of the start's section; ``begins``: starts of words; ``stops``:
    cuts by falling preference, the last one being the ends of words.  A better
    kind of cut is taken if it leaves the piece at least half full.
    """
    limit = np.minimum(starts + size, last)
    cut = limit.copy()
    open_ = limit < last
    undecided = open_.copy()
    for level, s in enumerate(stops):
        least = starts + (overlap if level == len(stops) - 1 else size // 2)
        i = np.searchsorted(s, limit, side="right") - 1
        at = np.where(i >= 0, s[np.maximum(i, 0)], -1) if len(s) else np.full(len(starts), -1)
        hit = undecided & (at > least)
        cut[hit] = at[hit]
        undecided &= ~hit
    # the first word that begins within the overlap, else the first one after the cut
    i = np.searchsorted(begins, cut - overlap, side="left")
    follow = begins[np.minimum(i, len(begins) - 1)]
    follow = np.where(undecided, cut - overlap, follow)  # no natural boundary: cut inside a word
    nxt = np.searchsorted(starts, follow, side="left")
    return cut, np.where(open_, nxt, np.arange(len(starts)))


def reached(nxt: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """Indices reachable from ``roots`` along ``nxt``, by squaring the successor table."""
    seen = np.zeros(len(nxt), bool)
    seen[roots] = True
    jump = nxt
    while True:
        more = jump[np.flatnonzero(seen)]
        before = int(seen.sum())
        seen[more] = True
        squared = jump[jump]
        if int(seen.sum()) == before and np.array_equal(squared, jump):
            return np.flatnonzero(seen)
        jump = squared


def cuts(texts: list[str], size: int, overlap: int) -> Iterator[list[tuple[int, int]]]:
    """For each text longer than ``size``: (start, end) of its pieces, in order."""
    gap, base = size + 1, 0
    starts, words_at, ends_at, lines, sentences, bases, lasts = [], [], [], [], [], [], []
    for t in texts:
        begins, stops = [], []
        own: list[int] = []
        for m in WORD.finditer(t):
            b, e = m.span()
            begins.append(b)
            stops.append(e)
            own.append(b)
            if e - b > size - overlap:  # a word so long that it may be cut anywhere
                own.extend(range(b + 1, e))
        starts.append(np.asarray(own) + base)
        words_at.append(np.asarray(begins) + base)
        ends_at.append(np.asarray(stops) + base)
        lines.append(np.asarray([m.start() for m in LINE_END.finditer(t)], np.int64) + base)
        sentences.append(np.asarray([m.end() for m in SENTENCE_END.finditer(t)], np.int64) + base)
        lasts.append(np.full(len(own), base + len(t)))
        bases.append(base)
        base += len(t) + gap
    if not texts:
        return
    flat = np.concatenate(starts)
    cut, nxt = successors(flat, np.concatenate(lasts), np.concatenate(words_at), [np.concatenate(lines), np.concatenate(sentences), np.concatenate(ends_at)], size, overlap)
    first = np.searchsorted(flat, np.asarray(bases))
    on_path = reached(nxt, first)
    owner = np.searchsorted(np.asarray(bases), flat[on_path], side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    for k, b in enumerate(bases):
        own = on_path[bounds[k] : bounds[k + 1]]
        yield list(zip((flat[own] - b).tolist(), (cut[own] - b).tolist()))


def split_oversized(df: DataFrame, key: str = "rec_id", text: str = "page_content", *, size: int = 800, overlap: int = 80, table_chars: int = 4_000_000) -> DataFrame:
    """(key, section_no, piece_no, piece_start, piece_end, piece) of every section above ``size`` characters.

    Positions are code points within the record's text; a piece has at most
    ``size`` characters, starts and ends at non-blank characters, and shares at
    most ``overlap`` characters with the one before.  Cuts prefer line ends,
    then sentence ends (where the piece stays at least half full), then ends of
    words; only a word that leaves no such place is cut inside, with the full
    overlap.  Null and blank texts, and null keys, give no rows; rows that
    repeat whole count once; other columns are ignored.  ``table_chars`` bounds
    the text whose successors stand in one table, but for its last section.
    """

    def pieces(keys: list, texts: list) -> Iterator[tuple]:
        where, parts, seen, held = [], [], set(), 0

        def cut() -> Iterator[tuple]:
            for (k, number, a), part, found in zip(where, parts, cuts(parts, size, overlap)):
                for i, (b, e) in enumerate(found):
                    e = b + len(part[b:e].rstrip(BLANKS))
                    yield k, number, i, a + b, a + e, part[b:e]

        for k, t in zip(keys, texts):
            if k is None or t is None or len(t) <= size or (k, t) in seen:
                continue
            seen.add((k, t))
            for number, a, b in sections(t):
                if b - a > size:
                    where.append((k, number, a))
                    parts.append(t[a:b])
                    held += b - a
                    if held >= table_chars:
                        yield from cut()
                        where, parts, held = [], [], 0
        yield from cut()

    kind = df.schema[key].dataType.simpleString()
    rows = map_rows(df, f"{key} {kind}, section_no int, piece_no int, piece_start int, piece_end int, piece string", pieces, key, text)
    return rows.dropDuplicates([key, "section_no", "piece_no"])


def oversized_sections(df: DataFrame, key: str = "rec_id", text: str = "page_content", *, size: int = 800, overlap: int = 80) -> DataFrame:
    """(key, section_no) of the sections that had to be cut."""
    return split_oversized(df, key, text, size=size, overlap=overlap).where("piece_no = 0").select(key, "section_no")
