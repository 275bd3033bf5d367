"""Problem 6: text of scanned pages made into continuous paragraphs.

Method: noisy channel.  Running headers and page numbers are taken out, words
broken over lines are joined, and each line is decoded by Viterbi: a word is
itself or any known word that a scanner may have misread for it, weighed by the
probabilities of the confusions and of the words and word pairs of the corpus.

The corpus is all records, each counted once; how likely each confusion is comes
from its rare words that are explained by frequent ones.  Only words (pairs)
above a share of all words (pairs) are sent to the tasks: there can be no more
than one over that share of them, however large the corpus.  The rarer words are
joined to the records whose unknown words may be misreadings of them.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import RepeatedIds, map_rows, rows_and_copies
from siltstone.llm.neardup import MASK, WordHash
from siltstone.llm.quality import COMMON_WORDS
from siltstone.session import materialize

# What is read, and what may have been printed.
CONFUSIONS = (
    ("c", "e"), ("@", "a"), ("0", "o"), ("†", "t"), ("|", "i"), ("|", "l"), ("1", "l"), ("1", "i"), ("ii", "u"), ("cl", "d"), ("5", "s"), ("li", "h"), ("rn", "m"),
    ("9", "g"), ("m", "in"), ("6", "b"), ("vv", "w"), ("f", "e"), ("d", "cl"), ("8", "b"), ("3", "e"), ("$", "s"), ("¢", "c"), ("€", "e"), ("l", "i"), ("m", "rn"), ("w", "vv"),
)

WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
CORE = re.compile(r"[\w@†|$¢€](?:[\w@†|$¢€'-]*[\w@†|$¢€])?")
BREAK = re.compile("\r\n|[\r\n\f\v ]")
ENDED = re.compile(r"[.?!:;,\"”»)\]]$")
SENTENCE_ENDED = re.compile(r"[.?!:][\"”»)\]]*$")
PAGE_NUMBER = re.compile(
    r"^[\[(~\-–—|*. ]*(?:(?:p[a@][g9][ec]|pp?\.?|p[g9]\.?|seite|s\.|p[aá@][g9]ina|pág\.?|folio)[ .:]*)?"
    r"(?:\d{1,4}|[ivxl]{1,6})\s*(?:(?:/|of|von|de|sur|-)\s*\d{1,4})?[\])~\-–—|* ]*$",
    re.IGNORECASE,
)
NUMBERED = re.compile(r"^\d{1,4}(?: {2,}| ?[|–—-] )\S|\S(?: {2,}| ?[|–—-] )\d{1,4}$")
#: Stands where a line ended, after lines were put together.
JOINT = "\x00"
BREAKS = re.compile("[-‐\u00ad¬](?:[ \\t]*\x00[ \\t]*|[ \\t]+)|\u00ad")
BEFORE = re.compile(r"[^\W\d_][\w@†|]*$")
AFTER = re.compile(r"[^\W\d_][\w@†|]*")
#: A word broken at the end of a line.
BROKEN = re.compile("([^\\W\\d_][\\w@†|]*)[-‐\u00ad¬][ \\t]*[\\r\\n\\f\\v ]+[ \\t]*([^\\W\\d_][\\w@†|]*)")
#: A sign or digit between letters.
INNER = re.compile(r"[^\W\d_][@†|¢€$\d]+[^\W\d_]")
CODE = re.compile(r"^[A-Z]{2,}-\d+$|^\d[\d.,]*$")


#: Odd multipliers of the hash of two words.
PAIR = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Makes a word and all its misreadings equal (and some other words too).
FOLD = str.maketrans(
    {**dict.fromkeys("cf3¢€", "e"), **dict.fromkeys("lr1|", "i"), **dict.fromkeys("uh", "ii"), **dict.fromkeys("68", "b"), "@": "a", "0": "o", "†": "t", "5": "s", "$": "s", "9": "g", "m": "in", "w": "vv", "d": "ei"}
)


def aligned(read: str, printed: str, log_of: dict[tuple[str, str], float]) -> tuple[float, tuple[tuple[str, str], ...]] | None:
    """(log probability, confusions) of the likeliest way to read the one for the other; None if the confusions can't explain it."""
    if read == printed:
        return 0.0, ()
    n = 0
    while n < min(len(read), len(printed)) and read[n] == printed[n]:
        n += 1
    # the equal start may have to be shorter: a sequence that was misread began in it
    best = None
    for k in range(n, max(-1, n - 3), -1):
        for pair in CONFUSIONS:
            seen, meant = pair
            if read.startswith(seen, k) and printed.startswith(meant, k) and (k == n or len(seen) + k > n or len(meant) + k > n):
                rest = aligned(read[k + len(seen) :], printed[k + len(meant) :], log_of)
                if rest is not None and (best is None or rest[0] + log_of[pair] > best[0]):
                    best = rest[0] + log_of[pair], (pair, *rest[1])
    return best


def confusion_hits(language: Language, rare: Iterable[tuple[str, int]], certain: int = 20) -> Counter:
    """How often each confusion explains a rare word by one at least ``certain`` times as frequent."""
    even = dict.fromkeys(CONFUSIONS, -2.0)
    hits: Counter = Counter()
    for word, n in rare:
        found = [(x[0] + math.log(language.words[c]), x[1]) for c in language.mates(word) if language.words[c] >= certain * n and (x := aligned(word, c, even))]
        if found:
            for pair in max(found)[1]:
                hits[pair] += n
    return hits


def confusion_logs(hits: dict[tuple[str, str], int], noise: float) -> dict[tuple[str, str], float]:
    """Log probability of each confusion where its printed side stands on a noisy page.

    Of all misreadings of a printed sequence, each has its share of the counts
    (and one count beforehand); together they are the share ``noise``.
    """
    every: Counter = Counter()
    for pair in CONFUSIONS:
        every[pair[1]] += hits.get(pair, 0) + 1
    return {pair: math.log(noise * (hits.get(pair, 0) + 1) / every[pair[1]]) for pair in CONFUSIONS}


class Parts(dict):
    """The matches of a pattern within a run of non-blank characters, kept for the life of a task up to a bound."""

    def __init__(self, pattern: re.Pattern):
        super().__init__()
        self.pattern = pattern

    def __missing__(self, token: str) -> list[str]:
        found = self.pattern.findall(token)
        if len(self) < 300_000:
            self[token] = found
        return found

    def of(self, text: str) -> list[str]:
        """All matches in a text; the pattern must match no blanks."""
        return list(chain.from_iterable(map(self.__getitem__, text.split())))


@dataclass
class Language:
    """Frequent words and word pairs (by hash) of the corpus with their counts, and the confusions' log probabilities."""

    words: dict[str, int]
    pairs: dict[int, int]
    total: int
    logs: dict[tuple[str, str], float] = field(default_factory=dict)
    plain_share: float = 2e-4
    cache: dict[str, list[tuple[str, float]]] = field(default_factory=dict)
    folds: dict[str, list[str]] = field(default_factory=dict)
    plain: set[str] = field(default_factory=set)
    hashes: WordHash = field(default_factory=WordHash)
    letters: Counter | None = None
    extra: dict[str, int] = field(default_factory=dict)  # rarer words, known for the record at hand
    extra_folds: dict[str, list[str]] = field(default_factory=dict)
    fold_of: dict[str, str] = field(default_factory=dict)
    cores: Parts = field(default_factory=lambda: Parts(CORE))

    def fold(self, word: str) -> str:
        found = self.fold_of.get(word)
        if found is None:
            found = word.translate(FOLD)
            if len(self.fold_of) < 300_000:
                self.fold_of[word] = found
        return found

    def with_words(self, extra: dict[str, int]) -> Language:
        """The language, with these rarer words until others are given."""
        if extra or self.extra:
            self.extra, self.extra_folds = extra, {}
            for w in extra:
                self.extra_folds.setdefault(self.fold(w), []).append(w)
        return self

    def __post_init__(self) -> None:
        for w in self.words:
            self.folds.setdefault(w.translate(FOLD), []).append(w)

    def count(self, word: str) -> int:
        return self.words.get(word) or self.extra.get(word, 0)

    def mates(self, word: str) -> list[str]:
        """The known words that fold to the same string as this one."""
        fold = self.fold(word)
        return [c for c in (*self.folds.get(fold, ()), *self.extra_folds.get(fold, ())) if c != word]

    def log_likelihood(self, before: str, word: str) -> float:
        alone = max(self.count(word), 0.5) / max(1, self.total)
        n = self.words.get(before, 0)
        together = self.pairs.get(pair_key(self.hashes[before], self.hashes[word]), 0) / n if n else 0.0
        return math.log(0.5 * alone + 0.5 * together)

    def candidates(self, word: str) -> list[tuple[str, float]]:
        """(what may have been printed, log of the channel's probability), the word itself first.

        A word and its misreadings fold to one string, under which the known
        words are filed, so any number of misread characters costs one look-up.
        Words above ``plain_share`` of all are never taken for misread.
        """
        here = bool(self.extra_folds) and self.fold(word) in self.extra_folds
        found = None if here else self.cache.get(word)
        if found is None:
            found = [(word, 0.0)]
            if (len(word) > 2 or not word.isalpha()) and self.words.get(word, 0) < self.plain_share * self.total + 10:
                found += [(c, x[0]) for c in self.mates(word) if (x := aligned(word, c, self.logs))]
                if not self.count(word) and INNER.search(word):
                    found += [(c, p) for c, p in self.respelled(word) if c not in dict(found)]
            if not here and len(self.cache) < 300_000:
                self.cache[word] = found
                if len(found) == 1:
                    self.plain.add(word)
        return found

    def respelled(self, word: str) -> list[tuple[str, float]]:
        """For an unknown word, such as a name: readings of the signs between its letters.

        What tells them apart from the word is how its letters follow each other
        in known words.
        """
        readings = [("", 0.0)]
        for k, c in enumerate(word):
            inner = not c.isalpha() and 0 < k < len(word) - 1
            ways = [(c, 0.0)] + [(meant, self.logs[c, meant]) for seen, meant in CONFUSIONS if inner and seen == c]
            readings = [(r + w, p + q) for r, p in readings for w, q in ways][:64]
        own = self.spelling(word)
        return [(r, p + self.spelling(r) - own) for r, p in readings if r != word]

    def spelling(self, word: str) -> float:
        """Log likelihood of the row of characters, counted over the known words."""
        if self.letters is None:
            self.letters = Counter(x for w in self.words for x in zip(f" {w}", f"{w} "))
            self.letters.update(Counter(x for w in self.words for x in f" {w}"))
        return sum(math.log((self.letters[x] + 0.1) / (self.letters[x[0]] + 10)) for x in zip(f" {word}", f"{word} "))

    def clear(self, text: str) -> bool:
        """True if every word of the text can only be itself."""
        words = self.cores.of(text.lower())
        if self.extra_folds:
            plain, extra, fold = self.plain, self.extra_folds, self.fold
            return all((w in plain and fold(w) not in extra) or len(self.candidates(w)) == 1 for w in words)
        return all(w in self.plain or len(self.candidates(w)) == 1 for w in words)

    def decoded(self, words: list[str]) -> list[str]:
        """The most likely printed words of a line (Viterbi)."""
        options = [self.candidates(w) for w in words]
        if all(len(o) == 1 for o in options):
            return words
        scores, back, before = [0.0], [], [("", 0.0)]
        for o in options:
            if len(o) == len(before) == 1:  # nothing to decide here
                before = o
                back.append([0])
                continue
            ranked = [max((s + self.log_likelihood(b, c) + misread, k) for k, ((b, _), s) in enumerate(zip(before, scores))) for c, misread in o]
            scores, before = [r[0] for r in ranked], o
            back.append([r[1] for r in ranked])
        k = max(range(len(scores)), key=scores.__getitem__)
        out = []
        for o, pointers in zip(reversed(options), reversed(back)):
            out.append(o[k][0])
            k = pointers[k]
        return out[::-1]


def folded(line: str) -> str:
    """The line without numbers, and with look-alike characters made equal."""
    words = [w for w in re.findall(r"[\w@†|$]+", line.lower()) if not re.fullmatch(r"\d+|[ivxl]+|\|", w)]
    s = " ".join(words).translate(str.maketrans("@0†|1596c3$", "aotilsgbees"))
    for seen, same in (("el", "d"), ("ii", "u"), ("li", "h"), ("rn", "m"), ("in", "m"), ("vv", "w"), ("f", "e"), ("l", "i")):
        s = s.replace(seen, same)
    return s


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """Indices of the running headers or footers, and of the lines that hold only a page number."""
    texts = [(i, x) for i, x in enumerate(lines) if x]
    numbers = {i for i, x in texts if PAGE_NUMBER.match(x)}
    if len(numbers) == 1 and re.fullmatch(r"(?:19|20)\d\d", lines[min(numbers)]):
        numbers = set()  # a year that stands alone after wrapping
    body = [(i, x) for i, x in texts if i not in numbers]
    if len(body) < 2:
        return set(), numbers if len(texts) > 1 else set()
    width = median(len(x) for _, x in body)
    shape: dict[str, list[int]] = {}
    for i, x in body:
        words = x.split()
        low = WORD.findall(x.lower())
        if len(words) <= 12 and len(x) <= 90 and low and not re.match(r"[^\W\d_A-Z]*[a-z]", x) and not re.search("[-.?!;,\u00ad]$", x):
            if sum(w in COMMON_WORDS for w in low) <= 0.34 * len(low) and not re.search(r"[.?!;] [A-Z]", x):
                shape.setdefault(folded(x), []).append(i)
    headers = {i for key, at in shape.items() if len(at) > 1 and len(key) > 3 for i in at}
    once = {at[0] for at in shape.values() if len(at) == 1}
    order = [i for i, _ in body]
    place = {i: k for k, i in enumerate(order)}
    for i in once:
        k, x = place[i], lines[i]
        before = lines[order[k - 1]] if k else ""
        after = lines[order[k + 1]] if k + 1 < len(order) else ""
        numbered = bool(NUMBERED.search(x)) and len(x.split()) >= 3 and len(x) < 0.75 * width
        cuts_in = before and not ENDED.search(before) and after[:1].islower() and len(x) < 0.75 * width
        if numbered or cuts_in:
            headers.add(i)
    return headers, numbers


def repaired(text: str, language: Language, least_misread: int) -> tuple[str, list[str]]:
    """The text as continuous paragraphs, and the kinds of noise that it had."""
    lines = [x.strip() for x in BREAK.split(text)]
    words = WORD.findall(text.lower())
    ruled = sum(x.startswith("|") for x in lines) > 0.5 * sum(map(bool, lines)) or text.lstrip().startswith('{"')
    if not words or ruled or sum(w in COMMON_WORDS for w in words) < 0.18 * len(words):
        return text, []  # not running text: nothing to put together
    headers, numbers = furniture(lines)
    noise = []
    # paragraphs, with a joint where a line ended
    paragraphs: list[list[str]] = [[]]
    for i, x in enumerate(lines):
        if i in headers or i in numbers:
            continue
        if x:
            paragraphs[-1].append(x)
        elif paragraphs[-1]:
            paragraphs.append([])
    joined: list[str] = []
    for p in filter(None, paragraphs):
        whole = f" {JOINT} ".join(p)
        if joined and not SENTENCE_ENDED.search(joined[-1]) and (whole[:1].islower() or joined[-1].endswith(("-", "\u00ad"))) and (headers or numbers or len(joined[-1]) > 60):
            joined[-1] += f" {JOINT} {whole}"  # a page ended inside the paragraph
        else:
            joined.append(whole)
    hyphens = 0

    def rejoined(p: str) -> str:
        """The paragraph with its broken words in one."""
        nonlocal hyphens
        out, at = "", 0
        for m in BREAKS.finditer(p):
            out += p[at : m.start()]
            at = m.start()
            left, right = BEFORE.search(out[-60:]), AFTER.match(p, m.end())
            if not left or not right:
                continue
            a, b = left.group(), right.group()
            whole, compound = (a + b).lower(), f"{a}-{b}".lower()
            known = max((language.count(c) for c, _ in language.candidates(whole)), default=0)
            own = language.count(compound)
            if not known and not own:
                # neither form is frequent: two words of their own make a compound, else it is one word
                known = not (language.count(a.lower()) and language.count(b.lower()))
            at = m.end()
            if b[:1].islower() and known > own:
                hyphens += 1
            else:
                out += "-"
        return out + p[at:]

    misread = 0
    out = []
    for p in joined:
        p = rejoined(p).replace(JOINT, " ").replace("\u00ad", "")
        if language.clear(p):
            out.append(re.sub(r"[ \t]+", " ", p).strip())
            continue
        spans = [m for m in CORE.finditer(p) if not CODE.match(m.group())]
        low = [m.group().lower() for m in spans]
        parts, at = [], 0
        for m, read, printed in zip(spans, low, language.decoded(low)):
            if read != printed:
                misread += 1
                was = m.group()
                new = printed.upper() if len(was) > 1 and was.isupper() else printed.capitalize() if was[:1].isupper() else printed
                parts += [p[at : m.start()], new]
                at = m.end()
        parts.append(p[at:])
        out.append(re.sub(r"[ \t]+", " ", "".join(parts)).strip())
    if hyphens:
        noise.append("hyphen")
    if misread >= least_misread:
        noise.append("chars")
    if headers:
        noise.append("header")
    if numbers:
        noise.append("pageno")
    return "\n\n".join(out), noise


def pair_key(a: int, b: int) -> int:
    """A signed 64-bit key of two words' hashes."""
    k = (a * PAIR[0] + (b ^ (b >> 29)) * PAIR[1]) & MASK
    return k - (1 << 64) if k >> 63 else k


def pair_keys(h: np.ndarray) -> np.ndarray:
    """The keys of all neighbours in a row of word hashes."""
    a, b = h[:-1], h[1:]
    return (a * np.uint64(PAIR[0]) + (b ^ (b >> np.uint64(29))) * np.uint64(PAIR[1])).view(np.int64)


def corpus_counts(df: DataFrame, key: str, text: str, table_bits: int, flush: int = 1_000_000) -> DataFrame:
    """(term, pair, n): counts of words and of hashed word pairs over all texts, a key once; the totals stand under '' and ' '."""

    def counter(skip: RepeatedIds | None):
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, words, parts = WordHash(), Counter(), Parts(WORD)
            held: list[np.ndarray] = []
            waiting: list[list[str]] = []  # texts whose pairs have not been made yet
            size = n_words = n_pairs = 0
            last = None

            def make() -> None:
                nonlocal waiting
                sizes = np.fromiter(map(len, waiting), np.int64, len(waiting))
                keys = pair_keys(np.fromiter(map(hashes.__getitem__, chain.from_iterable(waiting)), np.uint64, int(sizes.sum())))
                within = np.ones(len(keys), bool)
                within[np.cumsum(sizes)[:-1] - 1] = False  # not from one text into the next
                held.append(keys[within])
                waiting = []

            def pairs() -> pa.RecordBatch:
                if waiting:
                    make()
                keys, n = np.unique(np.concatenate([*held, np.zeros(0, np.int64)]), return_counts=True)
                held.clear()
                return pa.RecordBatch.from_arrays([pa.nulls(len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["term", "pair", "n"])

            def dump() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.nulls(len(words), pa.int64()), pa.array(list(words.values()), pa.int64())], ["term", "pair", "n"])

            for b in batches:
                if skip is not None:
                    b = b.filter(pa.array(~skip.possible(b.column(2).to_numpy())))
                for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    if skip is None and k == last:
                        continue  # a copy of the record before
                    last = k
                    found = parts.of(t.lower())
                    n_words += len(found)
                    words.update(found)
                    if "-" in t:
                        words.update(x for w in found if "-" in w for x in w.split("-"))
                    if len(found) > 1:
                        waiting.append(found)
                        n_pairs += len(found) - 1
                        size += len(found) - 1
                        if len(waiting) == 256:
                            make()
                    if size > flush:
                        yield pairs()
                        size = 0
                    if len(words) > 200_000:
                        yield dump()
                        words.clear()
            yield pairs()
            words.update({"": n_words, " ": n_pairs})
            yield dump()

        return count

    rows, repeated, copies = rows_and_copies(df, key, text, table_bits)
    schema = "term string, pair long, n long"
    return rows.mapInArrow(counter(repeated), schema).unionByName(copies.mapInArrow(counter(None), schema))


def corpus_language(
    df: DataFrame, key: str, text: str, word_share: float, pair_share: float, least: int, noise: float, table_bits: int
) -> tuple[Language, DataFrame]:
    """The language of all texts, and (term, n) of the words that are too rare to be sent with it.

    What is sent to the driver is bounded by one over the shares, and by the
    number of confusions.
    """
    sums = materialize(corpus_counts(df, key, text, table_bits).groupBy("term", "pair").agg(F.sum("n").alias("n")).where(F.col("n") >= F.when(F.col("pair").isNull(), 1).otherwise(least)), "ngrams")
    totals = dict(sums.where("term in ('', ' ')").select("term", "n").toLocalIterator())
    words, pairs = totals.get("", 0), totals.get(" ", 0)
    single = sums.where("pair is null and trim(term) <> ''")
    frequent = F.col("n") >= F.greatest(F.lit(word_share * words), F.lit(least))
    known = dict(single.where(frequent).select("term", "n").toLocalIterator())
    together = dict(sums.where(F.col("pair").isNotNull() & (F.col("n") >= F.lit(pair_share * pairs))).select("pair", "n").toLocalIterator())
    language = Language(known, together, words)
    sent = df.sparkSession.sparkContext.broadcast((known, words))

    def explained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rare words, the parts that the confusions have in explaining them."""
        local = Language(sent.value[0], {}, sent.value[1])
        hits: Counter = Counter()
        for b in batches:
            hits.update(confusion_hits(local, zip(b.column(0).to_pylist(), b.column(1).to_pylist())))
        cells = [CONFUSIONS.index(p) for p in hits], list(hits.values())
        yield pa.RecordBatch.from_arrays([pa.array(cells[0], pa.int32()), pa.array(cells[1], pa.int64())], ["pair", "n"])

    rare = single.where(~frequent).select("term", "n")
    hits = rare.mapInArrow(explained, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toLocalIterator()
    language.logs = confusion_logs({CONFUSIONS[k]: n for k, n in hits}, noise)
    return language, rare.where(F.col("n") >= least)


def unknown_words(text: str, language: Language) -> set[str]:
    """The words of a text that the language doesn't know, those broken in two put together."""
    low = text.lower()
    found = {w for w in {*language.cores.of(low)} if w not in language.words and not CODE.match(w)}
    found.update(w for a, b in BROKEN.findall(low) if (w := a + b) not in language.words)
    return {w for w in found if len(w) > 2 or not w.isalpha()}


def with_rare_words(df: DataFrame, key: str, text: str, rare: DataFrame, known: Callable[[], Language]) -> DataFrame:
    """(key, x): the text with the rarer words (term, n) that its unknown words may be, or may be misread for."""

    def folded_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([t.translate(FOLD) for t in b.column(0).to_pylist()], pa.string()), *b.columns], ["fold", "term", "n"])

    def folds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [{known().fold(w) for w in unknown_words(t, known())} for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(list(chain.from_iterable(found)), pa.string())], ["k", "fold"])

    chosen = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null")
    kind = df.schema[key].dataType.simpleString()
    asked = chosen.mapInArrow(folds, f"k {kind}, fold string").distinct()
    words = asked.join(rare.mapInArrow(folded_terms, "fold string, term string, n long"), "fold").groupBy("k").agg(F.collect_list(F.struct("term", "n")).alias("lexicon"))
    return chosen.join(words, "k", "left").select(F.col("k").alias(key), F.struct("t", "lexicon").alias("x"))


def repair_scans(
    df: DataFrame,
    key: str = "rec_id",
    text: str = "page_content",
    *,
    corpus: DataFrame | None = None,
    least_misread: int = 3,
    word_share: float = 2e-6,
    pair_share: float = 1e-5,
    least_count: int = 3,
    noise: float = 0.1,
    table_bits: int = 22,
) -> DataFrame:
    """(key, text, noise): every text repaired, with the kinds of noise found in it.

    ``hyphen``: a word was broken over lines; ``chars``: at least
    ``least_misread`` words outside running headers were misread; ``header``:
    running headers or footers; ``pageno``: lines with only a page number.
    Texts that are not running text (tables, codes, blank) come out as they are.
    Null texts give no rows, nor do null keys; rows with the same key count
    once; other columns are ignored; an empty table gives no rows.

    ``corpus`` has the records that the language is counted on, with the same
    columns (default: the records themselves).  Words of at least ``word_share`` of
    all are sent to the tasks, rarer ones reach the records that they matter to by
    a join; words seen fewer than ``least_count`` times are unknown, and pairs
    below ``pair_share`` of all count as their words alone.  ``noise`` is the share of a character's
    occurrences that are misread on a noisy page.
    """
    language, rare = corpus_language(df if corpus is None else corpus, key, text, word_share, pair_share, least_count, noise, table_bits)
    sent = df.sparkSession.sparkContext.broadcast((language.words, language.pairs, language.total, language.logs))
    name = uuid.uuid4().hex

    def known() -> Language:
        global _language
        if _language is None or _language[0] != name:
            _language = (name, Language(*sent.value))
        return _language[1]

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        seen: set = set()
        for k, x in zip(keys, texts):
            if k not in seen:
                seen.add(k)
                extra = {w["term"]: w["n"] for w in x["lexicon"] or ()}
                yield k, *repaired(x["t"], known().with_words(extra), least_misread)

    kind = df.schema[key].dataType.simpleString()
    whole = with_rare_words(df, key, text, rare, known)
    return map_rows(whole, f"{key} {kind}, {text} string, noise array<string>", rows, key, "x").dropDuplicates([key])


#: The task's language model, kept for all batches of a worker process.
_language: tuple | None = None


def noise_kinds(fixed: DataFrame, key: str = "rec_id") -> DataFrame:
    """(key, noise) with a row for every kind."""
    return fixed.select(key, F.explode("noise").alias("noise"))
