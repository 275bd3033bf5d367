"""Problem 3: statistics of a text that set natural prose apart from lists, tables and junk.

Method: every line has statistics (shares of function words, digits and signs,
counts of words and separators, its length, how it opens and closes), and a
hidden Markov model with the states prose, list, table and junk labels the lines
by them; the shares of the labels, by characters, are the document's statistics.
The model is estimated here, by counting over labelled texts that are made by
rule; no statistic names a label by itself.
"""

from __future__ import annotations

import json
import math
import random
import re
import textwrap
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, map_rows

STATES = ("prose", "list", "table", "junk")

# Frequent function words of the four languages.
COMMON_WORDS = frozenset(
    """
    the a an and or of to in is are was were be been for with that this these by on at as it its not had has have
    which than then so if but from will can must would all both more no without only there when what who how
    into over near under after before between each every most some any other they we you he she i up out
    le la les l de des du d un une et en est par pour sur ne pas plus que qui au aux se s a été cette ce dans ni
    avec sans même être doit peut avant puis où il elle on nous vous son sa ses sont était c n qu
    der die das und ist wird nicht mit von zu den dem des ein eine einer auf im am nach es sich dass ohne kann
    für wurde war bleibt noch weder wenn dann auch als weil mehr zum zur bei aus sind hat werden
    el los las del una y es por para con no lo al su en más como ha fue sin puede ser sigue queda ni esta este
    después cuando hasta porque ya era debe luego
    """.split()
)

WORD = re.compile(r"[^\W\d_]+")
HEADING = re.compile(r"#{1,6}(?: |$)")
ENDS = re.compile(r"[.!?…:;][\"'»”)]*$")
MARKER = re.compile(r"(?:[-*+•–—‣▪·]|\(?\w{1,3}[.)]|\d{1,3} -)[ \t]+\S")
SEPARATORS = re.compile(r"\t| {2,}(?=\S)|\||[»·›•]|\w / \w")
RUN = re.compile(r"[.…_]{4,}|(?:\. ){4,}")


def line_statistics(line: str, words: list[str], common: int) -> tuple[int, ...]:
    """The statistics of a line, each as the number of the bin's edges below it; they say nothing about what the line is."""
    tokens = line.split() or [line]
    separators = len(SEPARATORS.findall(line)) if any(x in line for x in ("  ", "|", "\t", "»", "·", "›", "•", " / ")) else 0
    run = any(x in line for x in ("..", ". . ", "__", "…")) and bool(RUN.search(line))
    solid, letters, digits = sum(map(len, tokens)), sum(map(len, words)), sum(map(line.count, "0123456789"))
    first, last = line[0], line[-1]
    opening = 0 if first.islower() else 1 if first.isalpha() else 2 if first.isdigit() else 3 if first in "|{[" else 4
    closing = 0 if last in ".!?…" else 1 if last in ":;," else 2 if last.isdigit() else 3 if last.isalpha() else 4
    n, colons = max(1, len(words)), line.count(":") + line.count("=")
    return (
        bisect_left((0, 0.1, 0.18, 0.25, 0.35), common / n),
        bisect_left((0, 1, 2, 3, 5, 8, 12), len(words)),
        bisect_left((0, 0.1, 0.3, 0.6), digits / solid),
        bisect_left((0, 0.03, 0.06, 0.12, 0.25, 0.5), 1 - (letters + digits) / solid),
        bisect_left((2.5, 4, 5.5, 7, 9), letters / n),
        bisect_left((12, 17, 27), max(map(len, tokens))),
        bisect_left((0, 0.15, 0.35), (line.count(",") + line.count(";")) / n),
        bisect_left((0, 1, 2), colons),
        bisect_left((0, 0.12, 0.25), colons / n),
        bisect_left((0, 1, 3), separators),
        bisect_left((0, 2), line.count('"') + line.count("{") + line.count("[")),
        run + 2 * bool(MARKER.match(line)),
        bisect_left((18, 40, 70), len(line)),
        bisect_left((0.3, 0.6, 0.9), len(set(words)) / n),
        opening,
        closing,
    )


class Samples:
    """Labelled texts as lines of (state, line), made by rule: what the model learns from.

    ``p`` prose, ``l`` list, ``t`` table, ``j`` junk.
    """

    # The words that the labelled texts are made of.
    NAMES = """pump valve hammer ladder press motor tank bolt wire kettle garden harbour engine mirror letter window bridge market
        river teacher copper silver village doctor paper winter summer station orchard candle Pumpe Ventil Kammer Leitung Schrank
        Fenster Garten Brücke Lehrer Winter pompe vanne câble lumière jardin fenêtre marché école rivière voiture bomba válvula
        ventana jardín puente mercado escuela invierno camino cámara""".split()
    KINDS = "small long cold grey spare heavy narrow open broad quick grau kalt lang alt petit froid gris neuf frío largo viejo nuevo".split()
    DONE = "tested opened moved cleaned stored checked removed painted geprüft gebaut versetzt vérifié ouvert rangé revisado abierto pintado".split()

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.common = sorted(COMMON_WORDS)

    def name(self) -> str:
        r = self.r
        if r.random() < 0.3:  # an invented word
            return "".join(r.choice("b br d f g gr k l m n p pl r s st t tr v w z".split()) + r.choice("a e i o u ea ou ie".split()) for _ in range(r.randint(1, 3))) + r.choice("lnmrskxt")
        return r.choice(self.NAMES)

    def item(self) -> str:
        said = " ".join([self.r.choice(self.KINDS)] * (self.r.random() < 0.5) + [self.name() for _ in range(self.r.randint(1, 2))])
        return said.title() if self.r.random() < 0.2 else said

    def sentence(self) -> str:
        r, out = self.r, []
        for _ in range(r.choice((2, 3, 3, 4, 5, 6))):
            out += [r.choice(self.common) for _ in range(r.choice((1, 1, 2, 2, 3)))]
            out.append(r.choice((self.name, self.name, lambda: r.choice(self.DONE), lambda: r.choice(self.KINDS), lambda: str(r.randint(1, 2100))))())
            if r.random() < 0.15:
                out[-1] += ","
        text = " ".join(out)
        return text[0].upper() + text[1:] + r.choice("......!?:")

    def paragraph(self) -> list[str]:
        r = self.r
        text = " ".join(self.sentence() for _ in range(r.randint(1, 6)))
        width = r.choice((30, 45, 60, 75, 90, 10_000, 10_000))
        return textwrap.wrap(text, width)

    def cell(self) -> str:
        r = self.r
        return r.choice((self.item, self.item, lambda: str(r.randint(0, 99_999)), lambda: f"{r.uniform(0, 9000):.2f}", lambda: f"{r.choice('ABKMQ')}{r.choice('AEX')}Z-{r.randint(100, 9999)}", lambda: r.choice(("", "-", "n/a", "0"))))()

    def listed(self) -> list[str]:
        r, n = self.r, self.r.randint(4, 14)
        kind = r.randrange(7)
        if kind == 0:
            return [f"{i}.{r.randint(1, 9)} {self.item().title()} {r.choice(('.', '. ')) * r.randint(5, 40)} {i * 3}" for i in range(1, n)]
        if kind == 1:
            mark = r.choice((" » ", " | ", " · ", " › ", " / ", " > "))
            return [mark.join(self.item().title() for _ in range(r.randint(4, 14))) for _ in range(r.choice((1, 1, 3)))]
        if kind == 2:
            return [self.item() + ", " * (r.random() < 0.1) + self.name() * (r.random() < 0.1) for _ in range(n)]
        mark = r.choice(("-", "*", "+", "•", "–", "#)", "#.", "(#)", "#.", "#)"))
        return [f"{mark.replace('#', str(i))} {self.item()}" + (f", {r.choice(self.KINDS)}" if r.random() < 0.3 else "") for i in range(1, n)]

    def table(self) -> list[str]:
        r, width = self.r, self.r.randint(2, 6)
        rows = [[self.cell() for _ in range(width)] for _ in range(r.randint(3, 12))]
        head = [self.item() for _ in range(width)]
        kind = r.randrange(10)
        if kind < 2:
            return [f"| {' | '.join(c)} |" for c in [head]] + ["|---" * width + "|"] + [f"| {' | '.join(c)} |" for c in rows]
        if kind == 2:
            return ["\t".join(c) for c in rows]
        if kind == 3:
            return ["".join(f"{x:<{r.choice((18, 22))}}" for x in c) for c in rows]
        if kind == 4:
            mark = r.choice((",", ";", ", "))
            return [mark.join(c) for c in rows]
        if kind in (5, 8, 9):
            return [r.choice(("Row -> ", "")) + ", ".join(f"{h}: {x}" for h, x in zip(head, c)) for c in rows[: r.choice((1, 1, 4))]]
        if kind == 6:
            return [json.dumps({"headers": head, "rows": rows})]
        mark = r.choice((": ", ":", " = ", "="))
        return [f"{self.item()}{mark}{self.cell()}" for _ in range(3 * len(rows))]

    def junk(self) -> list[str]:
        r, n = self.r, self.r.randint(3, 10)
        letters = "abcdefghijklmnopqrstuvwxyz"
        kind = r.randrange(8)
        if kind == 7:
            return [" ".join([self.name()] * r.randint(5, 60))]
        if kind == 0:
            return [f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)} {r.randint(10, 23)}:{r.randint(10, 59)} [{r.choice(('INFO', 'WARN', 'ERROR', 'DEBUG'))}] {self.name()}.{self.name()}#{r.randint(1, 999)} rc={r.randint(0, 9)}" for _ in range(n)]
        if kind == 1:
            return [" ".join(f"{r.uniform(0, 999):.{r.choice((0, 1, 3))}f}" for _ in range(r.randint(3, 9))) for _ in range(n)]
        if kind == 2:
            return ["".join(r.choice("%&$@#=/:~<_-+^|*.> \\") for _ in range(r.randint(15, 70))).strip() or "##" for _ in range(n)]
        if kind == 3:
            return [" ".join(f"{r.randrange(256):02x}" for _ in range(16)) for _ in range(n)]
        if kind == 4:
            return ["".join(r.choice(letters + letters.upper() + "0123456789+/") for _ in range(r.choice((24, 40, 60, 76)))) for _ in range(n)]
        if kind == 5:
            return textwrap.wrap(" ".join("".join(r.choice(letters) for _ in range(r.randint(2, 14))) for _ in range(60)), r.choice((60, 80, 10_000)))
        return textwrap.wrap(" ".join(self.item() for _ in range(40)), r.choice((60, 80, 10_000)))  # words without sentences

    def text(self) -> list[tuple[str, str]]:
        """Mostly one kind, with others among it."""
        r = self.r
        make = {"p": self.paragraph, "l": self.listed, "t": self.table, "j": self.junk}
        main = r.choice("ppplltj")
        order = [main] * r.randint(1, 3)
        if r.random() < 0.5:
            order.insert(r.randrange(len(order) + 1), r.choice("pplt"))
        return [(s, line.strip(BLANKS)) for s in order for line in make[s]() if line.strip(BLANKS)]


@dataclass
class LineModel:
    """Log probabilities of the hidden Markov model: of the first state, of the next one, and of every statistic's bin in each state.

    The statistics of a line aren't independent of each other, so each counts
    for the part ``trust`` only.
    """

    start: list[float]
    follow: list[list[float]]
    emit: list[list[list[float]]]
    trust: float = 0.6
    known: dict[tuple[int, ...], list[float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, texts: int = 3000, seed: int = 1) -> LineModel:
        """Counted over labelled texts."""
        samples = Samples(seed)
        start, follow = dict.fromkeys("pltj", 1.0), {a: dict.fromkeys("pltj", 1.0) for a in "pltj"}
        emit: list[dict[str, list[float]]] = []
        for _ in range(texts):
            before = None
            for state, line in samples.text():
                words = WORD.findall(line)
                statistics = line_statistics(line, words, sum(w.lower() in COMMON_WORDS for w in words))
                emit = emit or [{a: [1.0] * 9 for a in "pltj"} for _ in statistics]
                for counts, x in zip(emit, statistics):
                    counts[state][x] += 1
                if before is None:
                    start[state] += 1
                else:
                    follow[before][state] += 1
                before = state

        def logs(counts: Iterable[float]) -> list[float]:
            counts = list(counts)
            return [math.log(v / sum(counts)) for v in counts]

        by_state = [[logs(f[a]) for a in "pltj"] for f in emit]
        return cls(logs(start.values()), [logs(follow[a].values()) for a in "pltj"], [[list(x) for x in zip(*f)] for f in by_state])

    def evidence(self, statistics: tuple[int, ...]) -> list[float]:
        """Log likelihood of a line in each state."""
        found = self.known.get(statistics)
        if found is None:
            found = [self.trust * sum(f[x][s] for f, x in zip(self.emit, statistics)) for s in range(4)]
            if len(self.known) < 200_000:
                self.known[statistics] = found
        return found

    def labels(self, statistics: list[tuple[int, ...]], lengths: list[int], unit: int = 80) -> list[int]:
        """The most likely states (Viterbi), as indices into ``STATES``.

        A line that was never wrapped holds the evidence of several: its statistics
        count once for every ``unit`` characters begun.
        """
        if not statistics:
            return []
        said = [self.evidence(x) if n <= unit else [e * -(-n // unit) for e in self.evidence(x)] for x, n in zip(statistics, lengths)]
        best = [s + e for s, e in zip(self.start, said[0])]
        back = []
        for e in said[1:]:
            pointers, new = [], []
            for k in range(4):
                scores = [best[j] + self.follow[j][k] for j in range(4)]
                j = max(range(4), key=scores.__getitem__)
                pointers.append(j)
                new.append(scores[j] + e[k])
            back.append(pointers)
            best = new
        state = max(range(4), key=best.__getitem__)
        path = [state]
        for pointers in reversed(back):
            state = pointers[state]
            path.append(state)
        return path[::-1]


line_model = lru_cache(maxsize=1)(LineModel.fit)


def measured(text: str, model: LineModel) -> tuple:
    """Statistics of one text; see :func:`text_statistics`."""
    lines, statistics, fence = [], [], None
    n_lines = n_words = ended = letters = common = 0
    for raw in text.split("\n"):
        line = raw.strip(BLANKS)
        if not line:
            continue
        words = WORD.findall(line)
        known = sum(map(COMMON_WORDS.__contains__, map(str.lower, words)))
        n_lines += 1
        n_words += len(words)
        letters += sum(map(len, words))
        common += known
        ended += bool(ENDS.search(line, max(0, len(line) - 8)))
        if fence:
            fence = None if line.startswith(fence) else fence
        elif line.startswith(("```", "~~~")):
            fence = line[:3]
        elif not HEADING.match(line):
            lines.append(len(line))
            statistics.append(line_statistics(line, words, known))
    solid = len(text) - sum(map(text.count, BLANKS))
    digits = sum(map(text.count, "0123456789"))
    mass = [0, 0, 0, 0]
    for n, s in zip(lines, model.labels(statistics, lines)):
        mass[s] += n
    total = sum(mass)
    shares = [m / total for m in mass] if total else [1.0 if n_lines else 0.0, 0.0, 0.0, 0.0]
    return (
        n_words,
        letters / n_words if n_words else 0.0,
        (solid - letters - digits) / solid if solid else 0.0,
        ended / n_lines if n_lines else 0.0,
        common / n_words if n_words else 0.0,
        *shares,
    )


def text_statistics(df: DataFrame, key: str = "rec_id", text: str = "page_content") -> DataFrame:
    """One row for each key: the statistics of its text and the shares of the line labels.

    ``n_words`` (runs of letters), ``mean_word_length``, ``symbol_ratio`` (share
    of the non-blank characters that are neither letters nor digits),
    ``ended_lines`` (share of the non-blank lines that end in punctuation),
    ``common_words`` (share of the words that are function words of one of four
    languages) and ``prose``, ``list``, ``table``, ``junk``: shares of the
    characters on lines with that label.  Headings and fenced code are left out
    of the shares; a text of nothing else counts as prose.  Null and blank texts
    have zeros throughout and ``blank`` true.  Null keys are dropped, rows with
    the same key count once, other columns are ignored, an empty table gives no
    rows.
    """

    model = line_model()  # fitted once, on the driver

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        seen: set = set()
        for k, t in zip(keys, texts):
            if k is not None and k not in seen:
                seen.add(k)
                yield k, not (t or "").strip(BLANKS), *measured(t or "", model)

    kind = df.schema[key].dataType.simpleString()
    names = ("mean_word_length", "symbol_ratio", "ended_lines", "common_words", *STATES)
    schema = f"{key} {kind}, blank boolean, n_words int, " + ", ".join(f"{n} double" for n in names)
    return map_rows(df, schema, rows, key, text).dropDuplicates([key])


def not_prose(stats: DataFrame, key: str = "rec_id", *, least_prose: float = 0.5) -> DataFrame:
    """Keys of the texts that are not blank and mostly not prose."""
    return stats.where(~F.col("blank") & (F.col("prose") < least_prose)).select(key)
