"""Problem 9: template residue, filler, error messages and script notices instead of content.

Method: labelled exemplars of residue, whole sentences, stand in an inverted
index from term to exemplar.  A passage window retrieves the exemplars that share
terms with it; its containment is the share of its TF-IDF mass that the best
exemplar covers.  Messages and filler are scored sentence by sentence, and a line
(for filler, a paragraph) by the sum over its sentences.  Filler made to look
like Latin is compared by the beginnings of its words.  The window of a
placeholder is what stands in its marks: the term of its shape and, where the
marks also have other uses, a term for each word between them.  Document
frequencies come from all documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import BLANKS, map_rows

# Labelled exemplars of residue, a passage in each line.
EXEMPLARS = {
    "error": """
        Error 404
        HTTP status: 500
        Error code 0x80070005
        We are sorry, something went wrong.
        Oops! An unexpected error has occurred.
        404 - Page not found
        We looked everywhere for the page you asked for, but it is missing.
        The page you requested does not exist.
        The file you requested was removed.
        The folder you requested is not available.
        The record you requested cannot be shown.
        The resource you are looking for could not be found on this server.
        The item you requested has moved or no longer exists.
        The document has moved here or no longer exists.
        You do not have permission to view this page.
        You do not have the rights to view this folder.
        You do not have clearance to view this item.
        You do not have access to open this file.
        Access denied. You lack permission to open this file.
        403 Forbidden: you are not authorized to access this resource.
        You must log in to view this page.
        The request failed. The server could not complete your request.
        Request failed
        Try again in a few minutes.
        Please try again later.
        Check the address and retry.
        Please contact the administrator if this keeps happening.
        Contact support and give them the incident number.
        Go back to the start page.
        Our servers are overloaded at the moment.
        This host is down for maintenance at the moment.
        The archive is not responding at the moment.
        This site is currently offline for maintenance.
        The service is temporarily unavailable due to maintenance.
        Thank you for your patience.
        500 Internal server error
        502 Bad gateway
        Gateway timeout: the upstream service gave no answer within 30 s.
        The server took too long to respond and the request timed out.
        The connection to the host was refused after 30 s.
        The connection to the host was closed after 30 s.
        The connection was reset by the server.
        Too many requests
        Slow down and retry after 30 seconds.
        Your session has expired. Sign in again to continue.
        Please log in again.
        Could not extract text from this page: the document is password protected.
        Could not extract text from this attachment: the file is encrypted or damaged.
        Could not extract text from this file.
        Request id: 5d1f
        Incident number 5d1f
        Code 17
        Unhandled exception in thread main
        Unhandled failure in module.function
        Traceback (most recent call last):
        File "main.py", at line 17
        ValueError: empty value
        KeyError: name
        TypeError: object is not callable
        Fehler 404: Diese Seite gibt es nicht (mehr).
        Die angeforderte Seite wurde nicht gefunden.
        Zugriff verweigert. Bitte melden Sie sich erneut an.
        Der Dienst ist zurzeit nicht erreichbar.
        Bitte versuchen Sie es später erneut.
        Interner Serverfehler
        Ihre Sitzung ist abgelaufen.
        Vorgang 5d1f
        Erreur 404 : la page demandée est introuvable.
        Cette page n'existe pas.
        Accès refusé. Vous n'avez pas les droits.
        Votre session a expiré, veuillez vous reconnecter.
        Service indisponible pour le moment (incident 5d1f)
        Veuillez réessayer plus tard.
        Erreur interne du serveur
        Error 404: no encontramos la página solicitada.
        Esta página no existe.
        Acceso denegado. Inicie sesión otra vez.
        Su sesión ha caducado.
        El servicio no está disponible ahora mismo (referencia 5d1f)
        Inténtelo de nuevo más tarde.
        Error interno del servidor
    """,
    "script": """
        You need to enable JavaScript to run this app.
        You need to enable scripting to run this app.
        Please turn on JavaScript in your browser and reload the page.
        Please turn on scripting in your browser and reload the page.
        Please enable JS and disable any ad blocker.
        JavaScript is disabled.
        JS is disabled.
        Scripting is disabled.
        Some parts of this page will not work until you activate it.
        Your browser does not support scripts, so the document cannot be displayed.
        This site requires JavaScript.
        This viewer requires JS.
        This viewer requires scripting.
        It appears to be switched off.
        Loading document viewer ...
        If nothing happens, allow scripts and cookies for this page.
        Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.
        Bitte aktivieren Sie JS, um diese Seite anzuzeigen.
        Ohne JavaScript kann dieses Dokument nicht geladen werden.
        Ohne JS kann dieses Dokument nicht geladen werden.
        Veuillez activer JavaScript pour afficher ce document.
        Veuillez activer JS pour afficher ce document.
        Votre navigateur bloque les scripts ; la page ne peut pas s'afficher.
        Active JavaScript para ver esta página.
        Active JS para ver esta página.
        Su navegador no permite scripts y el documento no se puede mostrar.
    """,
    "filler": """
        Lorem ipsum dolor sit amet, consectetur adipiscing elit.
        foo bar baz qux foo bar baz
        asdf asdf qwert qwerty
        abc abc test test testing
        foo bar baz test test abc asdf qwert
        test test text text blah blah bla bla etc etc xxx xxx
        Text goes here.
        Your text here.
        Your content will appear in this place.
        This is sample text.
        This is an example paragraph.
        Add more text to fill this block.
        Replace this paragraph with your own words.
        Write a short description here.
        Dummy paragraph to show the layout.
        Dummy text
        Hier steht ein Beispieltext.
        Platzhaltertext
        Dies ist ein Blindtext.
        Texte provisoire à remplacer.
        Votre texte ici.
        Aquí va el texto de ejemplo.
        Texto de relleno
        Heading one
        Heading two
        Subheading
        Section title
        Body text
        Caption text
        Bullet point
        List item
        Under construction.
        Coming soon.
        Content pending.
        To be completed.
        TBD
        TODO
        Placeholder only.
        The author has not supplied any text yet.
        Please check back later.
        This section will be written at a later date.
    """,
}
# The passages that typesetters and generators of filler have always used.  What is made to look like them
# shares the beginnings of their words, so they are compared by these.
PSEUDO_LATIN = """
    Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. Ut enim ad minim
    veniam, quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat. Duis aute irure dolor in reprehenderit in voluptate
    velit esse cillum dolore eu fugiat nulla pariatur. Excepteur sint occaecat cupidatat non proident, sunt in culpa qui officia deserunt mollit
    anim id est laborum. Sed ut perspiciatis unde omnis iste natus error sit voluptatem accusantium doloremque laudantium, totam rem aperiam, eaque
    ipsa quae ab illo inventore veritatis et quasi architecto beatae vitae dicta sunt explicabo. Nemo enim ipsam voluptatem quia voluptas sit
    aspernatur aut odit aut fugit. Pellentesque habitant morbi tristique senectus et netus et malesuada fames ac turpis egestas. Vestibulum tortor
    quam, feugiat vitae, ultricies eget, tempor sit amet, ante. Donec eu libero sit amet quam egestas semper. Aenean ultricies mi vitae est. Mauris
    placerat eleifend leo. Quisque sit amet est et sapien ullamcorper pharetra. Vestibulum erat wisi, condimentum sed, commodo vitae, ornare sit
    amet, wisi. Aenean fermentum, elit eget tincidunt condimentum, eros ipsum rutrum orci, sagittis tempus lacus enim ac dui. Donec non enim in
    turpis pulvinar facilisis. Ut felis. Praesent dapibus, neque id cursus faucibus, tortor neque egestas augue, eu vulputate magna eros eu erat.
    Aliquam erat volutpat. Nam dui mi, tincidunt quis, accumsan porttitor, facilisis luctus, metus. Class aptent taciti sociosqu ad litora torquent
    per conubia nostra, per inceptos himenaeos. Nunc porta risus a urna, massa lacinia ligula.
"""

# Shapes of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"""
    \{\{\s*[A-Za-z][\w.-]*\s*\}\} | \$\{\s*[A-Za-z][\w.-]*\s*\} | \#\{\s*[A-Za-z][\w.-]*\s*\}
  | <%=?\s*[A-Za-z][\w.-]*\s*%> | \{%\s*[A-Za-z][\w. -]*%\}
  | \[\[[A-Za-z][\w .-]*\]\] | <<[A-Za-z][\w .-]*>> | &lt;[A-Za-z]\w*[ _-][\w ._-]*&gt;
  | \[(?:insert|your|enter|add|todo|tbd|name\ of)\b[^\]\n]{0,80}\] | <[A-Za-z][\w ]*\ (?:goes\ here|here)>
  | \{[A-Za-z]+[._-][A-Za-z]+\} | (?<![\w%])%[A-Za-z]+_[A-Za-z_]+%(?!\w) | @@[A-Za-z]\w*@@
  | (?<![A-Za-z0-9_/+])(?:__[A-Za-z]+_[A-Za-z_]+?__|XX_[A-Za-z_]+?_XX)(?![A-Za-z0-9_/+])
    """,
    re.VERBOSE | re.IGNORECASE,
)
# Marks that hold a placeholder only if the words between them name what is to be filled in.
MARKS = {
    "{}": re.compile(r"(?<![{$#%\w])\{ ?([A-Za-z][\w -]{0,60})\}(?!\})"),
    "[]": re.compile(r"(?<![\[\w!])\[ ?([A-Za-z][\w -]{0,60})\](?![\](\[:])"),
    "<>": re.compile(r"(?<![<\w])<(?!(?:title|address|time|data)>)([A-Za-z][\w -]{0,60})>(?!>)", re.IGNORECASE),
}
BLANK = re.compile(r"\w:[ \t]*(?:_{3,}|\.{5,})")
FIELDS = (
    "name first last full middle sur user customer client company employer organisation organization recipient sender author contact person date day month year time"
    " address street city town country state zip postcode phone telephone mobile number email mail fax title position department amount price total signature subject"
    " your insert enter here vorname nachname datum firma anschrift ort nom prénom entreprise adresse ville nombre apellido fecha empresa dirección ciudad"
).split()
OPENERS = ("{", "[", "<", "%", "@@", "__", "XX_", "&lt;", ".....")
FENCED = re.compile(r"^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*|\Z)", re.DOTALL | re.MULTILINE)
QUOTED = re.compile(r"``[^\n]*?``|`[^`\n]*`")
WORD = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?;:]+(?:\s+|$)")
PARAGRAPH = re.compile(r"\n[ \t\r]*\n")
MENU = re.compile(r" [|»·›/•>] ")


def placeholder_windows(text: str) -> Iterator[list[str]]:
    """The terms of every passage that may be a placeholder; they are no words, so they don't mix with those."""
    if not any(o in text for o in OPENERS):
        return
    if PLACEHOLDER.search(text):
        yield ["shape:marked"]
    if BLANK.search(text):
        yield ["shape:blank"]
    for mark, pattern in MARKS.items():
        if mark[0] in text:
            for m in pattern.finditer(text):
                yield [f"shape:{mark}", *(f"field:{w}" for w in WORD.findall(m[1].lower().replace("_", " ")))]


#: Labelled exemplars of placeholders, as terms.
PLACEHOLDERS = [["shape:marked"], ["shape:blank"], *([f"shape:{m}", *(f"field:{w}" for w in FIELDS)] for m in MARKS)]


def terms(text: str) -> list[str]:
    return WORD.findall(text.lower())


def beginnings(words: Iterable[str]) -> list[str]:
    """The words' first three letters, as terms that don't mix with words."""
    return [f"begin:{w[:3]}" for w in words]


#: (label, terms) of every exemplar.
LABELLED = [
    *((label, terms(line)) for label, lines in EXEMPLARS.items() for line in lines.strip().split("\n")),
    ("latin", beginnings(terms(PSEUDO_LATIN))),
    *(("placeholder", w) for w in PLACEHOLDERS),
]
VOCABULARY = frozenset(t for _, x in LABELLED for t in x)
WORDS = frozenset(t for t in VOCABULARY if ":" not in t)
BEGINNINGS = frozenset(t for t in VOCABULARY if t.startswith("begin:"))


@dataclass
class Index:
    """Inverted index of the exemplars, with the weights of their terms."""

    postings: dict[str, list[int]]
    labels: list[str]
    weight: dict[str, float]
    outside: float

    @classmethod
    def build(cls, frequencies: dict[str, int], documents: int, cap: float) -> Index:
        postings: dict[str, list[int]] = {}
        for e, (_, window) in enumerate(LABELLED):
            for term in set(window):
                postings.setdefault(term, []).append(e)
        weight = {t: min(cap, 0.1 + math.log((documents + 1) / (frequencies.get(t, 0) + 1))) for t in postings}
        return cls(postings, [label for label, _ in LABELLED], weight, cap)

    def covered(self, window: list[str], wanted: tuple[str, ...]) -> tuple[float, float, str]:
        """Of the window's mass what the best exemplar of the wanted labels covers, the whole mass, and that exemplar's label."""
        total = 0.0
        mass: dict[int, float] = {}
        for term in window:
            hit = self.postings.get(term)
            if hit is None:
                total += self.outside
                continue
            w = self.weight[term]
            total += w
            for e in hit:
                if self.labels[e] in wanted:
                    mass[e] = mass.get(e, 0.0) + w
        if not mass:
            return 0.0, total, ""
        best = max(mass, key=mass.__getitem__)
        return mass[best], total, self.labels[best]

    def containment(self, window: list[str], wanted: tuple[str, ...]) -> float:
        found, total, _ = self.covered(window, wanted)
        return found / total if total else 0.0

    def coverage(self, windows: list[list[str]], wanted: tuple[str, ...]) -> tuple[float, str]:
        """Share of the windows' mass that is covered, each by its own best exemplar, and the label that covers most."""
        whole, by_label = 0.0, Counter()
        for w in windows:
            found, total, label = self.covered(w, wanted)
            whole += total
            by_label[label] += found
        return (sum(by_label.values()) / whole, by_label.most_common(1)[0][0]) if whole else (0.0, "")


def is_menu(line: str) -> bool:
    """Navigation rather than a sentence: separators, or a few words without an end mark."""
    return bool(MENU.search(line)) or (line[-1] not in ".!?;:" and len(line.split()) <= 8)


def sentences(line: str) -> list[list[str]]:
    """The terms of a line's sentences."""
    return [w for x in SENTENCE.split(line) if (w := terms(x))]


def message_kind(text: str, index: Index, threshold: float) -> str | None:
    """``error`` or ``script`` if, apart from menu lines, the whole text is such a message."""
    found: Counter = Counter()
    told = 0
    for raw in text.split("\n"):
        line = raw.strip(BLANKS)
        if not line:
            continue
        if line.startswith("|"):
            return None
        windows = [[t for t in w if len(t) > 1] for w in sentences(line)]
        score, label = index.coverage(windows, ("error", "script"))
        if score >= threshold:
            n = sum(map(len, windows))
            told += n
            found[label] += n
        elif any(windows) and not is_menu(line):
            return None
    return found.most_common(1)[0][0] if told >= 3 else None


def is_filler(paragraph: str, index: Index, threshold: float, least_latin: float) -> bool:
    if paragraph.lstrip(BLANKS).startswith("#"):
        return False
    window = terms(paragraph)
    latin = beginnings(window)
    if len(latin) >= 8 and sum(t in BEGINNINGS for t in latin) >= 0.5 * len(latin) and index.containment(latin, ("latin",)) >= least_latin:
        return True
    return sum(t in WORDS for t in window) >= 0.6 * len(window) and index.coverage(sentences(paragraph.replace("\n", ".\n")), ("filler",))[0] >= threshold


def residue_kinds(text: str, index: Index, message: float, filler: float, placeholder: float = 0.75, latin: float = 0.6) -> list[str]:
    """Labels of the residue in one text."""
    kinds = []
    plain = QUOTED.sub(" ", FENCED.sub("\n\n", text)) if "`" in text or "~~~" in text else text
    if any(index.containment(w, ("placeholder",)) >= placeholder for w in placeholder_windows(plain)):
        kinds.append("placeholder")
    if any(is_filler(p, index, filler, latin) for p in PARAGRAPH.split(plain)):
        kinds.append("filler")
    if (kind := message_kind(plain, index, message)) is not None:
        kinds.append(kind)
    return kinds


def exemplar_frequencies(df: DataFrame, key: str, text: str) -> tuple[dict[str, int], int]:
    """Document frequencies of the exemplars' terms, over all documents, and the number of documents.

    The result is bounded by the exemplars' vocabulary.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        n = 0
        for b in batches:
            for t in b.column(0).to_pylist():
                n += 1
                words = set(terms(t))
                seen.update(WORDS & words)
                seen.update(BEGINNINGS.intersection(beginnings(words)))
                seen.update(VOCABULARY.intersection(x for w in placeholder_windows(t) for x in w))
        cells = [*seen.items(), ("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in cells], pa.string()), pa.array([c[1] for c in cells], pa.int64())], ["term", "n"])

    parts = df.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "term string, n long")
    sums = dict(parts.groupBy("term").agg(F.sum("n")).toLocalIterator())
    return sums, sums.pop("", 0)


def template_residue(
    df: DataFrame, key: str = "doc_id", text: str = "text", *, message: float = 0.6, filler: float = 0.75, placeholder: float = 0.75, latin: float = 0.6, weight_cap: float = 6.0
) -> DataFrame:
    """(key, kind) for every document with residue; ``kind``: placeholder, filler, error, script.

    ``message``, ``filler``, ``latin`` and ``placeholder`` are the least
    containments of a message line, a filler paragraph, one that is made to look
    like Latin, and a placeholder; ``weight_cap`` bounds the weight of a term, and is
    the weight of terms that no exemplar has.  Code in fences or backticks is
    ignored.  Null and blank texts and null keys give no rows; rows that repeat
    whole count once; other columns are ignored; an empty table gives no rows.
    """
    frequencies, documents = exemplar_frequencies(df, key, text)
    index = Index.build(frequencies, documents, weight_cap)

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            if k is not None and t:
                for kind in residue_kinds(t, index, message, filler, placeholder, latin):
                    yield k, kind

    kind = df.schema[key].dataType.simpleString()
    return map_rows(df, f"{key} {kind}, kind string", rows, key, text).distinct()
