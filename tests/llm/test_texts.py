"""Splitting, statistics, terms, packing."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing, quality, splitting, terms
from siltstone.llm.common import BLANKS

RECORDS = "rec_id long, page_content string, term string, piece string, section_no string, prose string, n int, k int, t int"


def records(spark, rows):
    return spark.createDataFrame([(i, t, "c", "l", "a", "s", 1, 2, 3) for i, t in rows], RECORDS).repartition(3)


# --- splitting


def test_sections():
    text = "intro\n# A\n\n body \n##\nx\n####no\n```\n# not\n```\n### C\r\nlast\n"
    got = [(n, text[a:b]) for n, a, b in splitting.sections(text)]
    assert got == [(0, "intro"), (1, "body"), (2, "x\n####no\n```\n# not\n```"), (3, "last")]
    assert list(splitting.sections("")) == [(0, 0, 0)]
    assert [n for n, *_ in splitting.sections("# A")] == [0, 1]
    assert [n for n, *_ in splitting.sections("~~~\n# A\n```\n# B\n~~~\n# C")] == [0, 1]


def pieces_of(text, size, overlap):
    text = text.strip(BLANKS)
    return text, next(splitting.cuts([text], size, overlap))


def greedy(text, size, overlap):
    """The same cuts one after the other."""
    words = [m.span() for m in re.finditer(r"[^ \t\r\n]+", text)]
    lines = [m.start() for m in re.finditer("\n", text)]
    ends = [m.end() for m in splitting.SENTENCE_END.finditer(text)]
    out, at = [], 0
    while True:
        limit = at + size
        if limit >= len(text):
            return [*out, (at, len(text))]
        for stops, least in ((lines, size // 2), (ends, size // 2), ([e for _, e in words], overlap)):
            fit = [s for s in stops if at + least < s <= limit]
            if fit:
                cut = fit[-1]
                break
        else:
            cut = None
        out.append((at, cut or limit))
        at = limit - overlap if cut is None else next(b for b, _ in words if b >= cut - overlap)


TEXT = st.lists(st.sampled_from(["a", "bcd", "efghij.", "k" * 30, "l" * 120, "mnopq"]), min_size=30, max_size=120)


@settings(max_examples=150, deadline=None)
@given(TEXT, st.lists(st.sampled_from([" ", "  ", "\n", "\n\n"]), min_size=120, max_size=120))
def test_pointer_doubling_gives_the_greedy_cuts(words, gaps):
    text = "".join(w + g for w, g in zip(words, gaps)).strip()
    if len(text) <= 60:
        return
    _, got = pieces_of(text, 60, 12)
    assert all(e - b <= 60 for b, e in got)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (_, e), (b, _) in zip(got, got[1:]):
        assert e - b <= 12 and not text[e:b].strip()
    if not any(len(w) > 48 for w in words):
        assert got == greedy(text, 60, 12)


def test_many_texts_at_once_equal_one_at_a_time():
    rng = random.Random(1)
    texts = [" ".join("x" * rng.randint(1, 12) for _ in range(rng.randint(20, 300))) for _ in range(40)]
    texts = [t for t in texts if len(t) > 60]
    assert list(splitting.cuts(texts, 60, 10)) == [next(splitting.cuts([t], 60, 10)) for t in texts]
    assert list(splitting.cuts([], 60, 10)) == []


def test_split_oversized_table(spark):
    long = "word and more. " * 100
    rows = [(1, None), (2, ""), (3, "short"), (4, "# h\n" + long), (4, "# h\n" + long), (None, long), (5, "x" * 2001), (6, long[:400] + "\n# A\n" + long[:500])]
    df = records(spark, rows)
    got = splitting.split_oversized(df).orderBy("rec_id", "piece_no").collect()
    assert {(r["rec_id"], r["section_no"]) for r in got} == {(4, 1), (5, 0)}
    text = dict(rows[4:])
    for r in got:
        source = ("x" * 2001) if r["rec_id"] == 5 else rows[3][1]
        assert source[r["piece_start"] : r["piece_end"]] == r["piece"] and len(r["piece"]) <= 800
    assert [(r["piece_start"], r["piece_end"]) for r in got if r["rec_id"] == 5] == [(0, 800), (720, 1520), (1440, 2001)]
    assert text is not None
    assert sorted(map(tuple, splitting.oversized_sections(df).collect())) == [(4, 1), (5, 0)]
    assert splitting.split_oversized(records(spark, [])).count() == 0


def test_cuts_of_the_tables_are_the_greedy_ones(spark, tiny):
    df = spark.read.parquet(f"{tiny}/doc_records.parquet")
    got: dict = {}
    for r in splitting.split_oversized(df).collect():
        got.setdefault((r["rec_id"], r["section_no"]), []).append((r["piece_no"], r["piece_start"], r["piece_end"]))
    want = {}
    for r in df.select("rec_id", "page_content").where("page_content is not null").collect():
        for number, a, b in splitting.sections(r["page_content"]):
            part = r["page_content"][a:b]
            if b - a > 800 and all(len(w) <= 720 for w in part.split()):
                want[r["rec_id"], number] = [(i, a + x, a + x + len(part[x:y].rstrip(BLANKS))) for i, (x, y) in enumerate(greedy(part, 800, 80))]
    assert len(want) > 20
    assert {k: sorted(got[k]) for k in want} == want


def test_small_tables_of_successors_give_the_same_cuts(spark):
    rows = [(i, "word and more. " * (60 + i)) for i in range(40)]
    whole, cut = (splitting.split_oversized(records(spark, rows), table_chars=n) for n in (4_000_000, 3000))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, cut.collect()))


# --- statistics

MODEL = quality.line_model()
PROSE = {
    "en": "The pump was tested in the spring, and it was found that the valve did not close. When the work was done, all of the parts were put back.",
    "de": "Die Pumpe wurde im Frühjahr geprüft, weil das Ventil nicht mehr dicht war. Nach der Arbeit ist die Anlage wieder in Betrieb.",
    "fr": "La pompe a été vérifiée au printemps parce que la vanne n'était plus étanche. Après le travail, le tableau est à sa place.",
    "es": "La bomba fue revisada en primavera porque la válvula ya no era segura. Después de la prueba, el cable queda en su sitio.",
}
JUNK = [
    "- pump\n- valve\n- grey motor\n- ladder", "1) pump\n2) valve, grey\n3) motor", "Home | About us | Contact | Imprint", "a;12;b\nc;13;d\ne;14;f",
    "pump: 12\nvalve: grey\nmotor: n/a", "2024-01-01 10:00 [INFO] pump.start#12 rc=0\n2024-01-01 10:01 [WARN] x.y#1 rc=1", "12.4 55 1.9 33\n8 7 6 5\n3.3 1.2",
    "%&$@#=/:~<_-+^:#_=|=*^\n+=-/*%$ #@!~ ^^^&&*", "Row -> pump: 12, valve: n/a, motor: grey", '{"headers": ["a", "b"], "rows": [["1", null]]}', "pump\tvalve\tmotor\n12\t\t4",
    "1.2 Pumps ........ 4\n1.3 Valves ............ 9", "4f 6a 00 1b 22 9c de ad be ef\n00 11 22 33 44 55 66 77 88 99", "zkulccn bgmtm hctihj qzstlv iyjsm fbtbrz lebeqp txetem hsdjsb",
    "SGVsbG8gd29ybGQgdGhpcyBpcyBiYXNlNjQgdGV4dA0KU2Vjb25k\nMTIzNDU2Nzg5MDEyMzQ1Njc4OTAxMjM0NTY3ODkwMTIzNDU2Nzg5",
]


@pytest.mark.parametrize("language", sorted(PROSE))
def test_prose_stays_prose(language):
    text = PROSE[language]
    wrapped = re.sub(r"(.{1,40}) ", r"\1\n", text)
    listed = "# Parts\n\n- pump\n- valve\n\n" + text + "\n\n```\nx = 1\ny = 2\n```\n"
    for t in (text, wrapped, listed, text.split(". ")[0] + "."):
        assert quality.measured(t, MODEL)[5] >= 0.5, t


@pytest.mark.parametrize("text", JUNK)
def test_junk_is_not_prose(text):
    assert quality.measured(text, MODEL)[5] < 0.5


def test_mostly_is_by_characters():
    assert quality.measured(PROSE["en"] + "\n" + "- pump and valve\n" * 2, MODEL)[5] > 0.5
    assert quality.measured("This is the list of the parts:\n" + "- spare pump\n" * 20, MODEL)[5] < 0.5


def test_statistics_of_nothing_and_of_headings():
    assert quality.measured("", MODEL) == (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert quality.measured("# Only a heading", MODEL)[5:] == (1.0, 0.0, 0.0, 0.0)
    for odd in ("\u00a0", "\u2028\u2028\n\u00a0", "\x0b", "\ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16")):
        assert sum(quality.measured(odd, MODEL)[5:]) == pytest.approx(1.0)


def test_text_statistics_table(spark):
    rows = [(1, PROSE["en"]), (1, PROSE["en"]), (2, None), (3, " \r\n"), (4, JUNK[0]), (None, "x"), (5, "Two words.")]
    stats = quality.text_statistics(records(spark, rows))
    got = {r["rec_id"]: r for r in stats.collect()}
    assert set(got) == {1, 2, 3, 4, 5}
    assert got[2]["blank"] and got[3]["blank"] and not got[5]["blank"]
    assert (got[5]["n_words"], got[5]["mean_word_length"], got[5]["ended_lines"]) == (2, 4.0 - 0.0, 1.0) or got[5]["mean_word_length"] == 4.0
    assert got[5]["symbol_ratio"] == pytest.approx(1 / 9)
    assert [r[0] for r in quality.not_prose(stats).collect()] == [4]
    assert quality.text_statistics(records(spark, [])).count() == 0


def labelled(text, alone=False):
    """The states of the lines: by the model, or each line's most likely one ``alone``."""
    lines = text.split("\n")
    stats = []
    for x in lines:
        words = quality.WORD.findall(x)
        stats.append(quality.line_statistics(x, words, sum(w.lower() in quality.COMMON_WORDS for w in words)))
    if alone:
        return [quality.STATES[max(range(4), key=MODEL.evidence(x).__getitem__)] for x in stats]
    return [quality.STATES[s] for s in MODEL.labels(stats, [len(x) for x in lines])]


def test_the_model_is_right_where_lines_alone_are_not():
    wrapped = "The old pump was moved to the\nsouthern storage hall\nbecause it had not been in use for\na year, and the new one\nstands next to the long\nwall."
    assert labelled(wrapped) == ["prose"] * 6 and "list" in labelled(wrapped, alone=True)
    items = "- hammer\n- copper wire\n- cold press\n- what is left.\n- ladder\n- spare bolt"
    assert labelled(items) == ["list"] * 6
    text = quality.measured(wrapped, MODEL)
    assert text[5] == 1.0


def test_the_model_changes_the_shares_of_the_tables(tiny):
    import pyarrow.parquet as pq

    texts = [t for t in pq.read_table(f"{tiny}/doc_records.parquet", columns=["page_content"])["page_content"].to_pylist() if t and "\n" in t]
    assert sum(labelled("\n".join(x for x in t.split("\n") if x.strip())) != labelled("\n".join(x for x in t.split("\n") if x.strip()), alone=True) for t in texts) > 0.1 * len(texts)


def test_held_out_labelled_lines():
    samples = quality.Samples(99)
    right = total = 0
    for _ in range(200):
        text = samples.text()
        got = labelled("\n".join(line for _, line in text))
        right += sum(g[0] == s for g, (s, _) in zip(got, text))
        total += len(text)
    assert right / total > 0.95


# --- terms


def test_term_frequencies_agree_with_sets(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["Pump", "valve", "it", "the", f"only{i % 40}x", "Äpfel", "a1bcd"], k=rng.randint(0, 12)))) for i in range(60)]
    rows += rows[:9] + [(100, None), (101, ""), (None, "pump pump")]
    records_, total = {}, Counter()
    for k, t in dict(r for r in rows if r[0] is not None).items():
        if t is not None:
            found = re.findall("[a-z]{3,}", t.lower())
            total.update(found)
            records_[k] = set(found)
    df_ = Counter(w for s in records_.values() for w in s)
    want = {w: (total[w], df_[w], "rare" if df_[w] <= 2 else "common" if df_[w] > 0.2 * len(records_) else None) for w in total}
    for flush in (200_000, 1):
        got = {r["term"]: (r["occurrences"], r["records"], r["mark"]) for r in terms.term_frequencies(records(spark, rows), flush_terms=flush).collect()}
        assert got == want


def test_terms_of_nothing(spark):
    assert terms.term_frequencies(records(spark, [])).count() == 0
    assert terms.term_frequencies(records(spark, [(1, None), (2, "1 2"), (None, "abc")])).count() == 0


def test_a_term_counts_a_record_unless_it_was_last_seen_there():
    seen = terms.LastSeen()
    seen.read([["a", "b", "a"], ["a"]], 0)
    seen.read([["a", "c", "b"], ["b", "c"]], 1)  # record 1 goes on
    got = {t: (int(seen.occurrences[k]), int(seen.records[k]), int(seen.last[k])) for t, k in seen.terms.items()}
    assert got == {"a": (4, 2, 1), "b": (3, 3, 2), "c": (2, 2, 2)}
    assert seen.dump().num_rows == 4 and not seen.terms


def test_a_third_of_all_rows_are_copies_in_many_parts(spark):
    rows = [(7, "hot hot thing")] * 300 + [(i, f"word{chr(97 + i % 26)} every") for i in range(100, 700)] + [(i, f"word{chr(97 + i % 26)} every") for i in range(100, 120)]
    df = records(spark, rows).repartition(7)
    for bits in (4, 22):  # however full the table of repeated ids
        got = {r["term"]: (r["occurrences"], r["records"]) for r in terms.term_frequencies(df, table_bits=bits).collect()}
        assert got["hot"] == (2, 1) and got["thing"] == (1, 1) and got["every"] == (600, 600)
        assert sum(n for t, (n, _) in got.items() if t.startswith("word")) == 600


# --- packing


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40))
def test_packing_holds_everything_and_is_no_worse_than_best_fit(sizes):
    bins = packing.complete_bins(sizes, 30)
    assert sorted(s for b in bins for s in b) == sorted(sizes)
    assert all(sum(b) <= 30 for b in bins)
    bound = packing.lower_bound(np.bincount(sizes, minlength=31), 30) if sizes else 0
    assert bound <= len(bins) <= len(packing.best_fit_decreasing(sizes, 30))


def least_bins(sizes, capacity):
    """The least number of containers, by trying everything."""
    best = len(sizes)

    def place(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        for i in range(len(rooms)):
            if rooms[i] >= rest[0] and rooms[i] not in rooms[:i]:
                place(rest[1:], rooms[:i] + [rooms[i] - rest[0]] + rooms[i + 1 :])
        place(rest[1:], rooms + [capacity - rest[0]])

    place(sorted(sizes, reverse=True), [])
    return best


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(3, 20), min_size=1, max_size=9))
def test_small_packings_are_optimal(sizes):
    assert len(packing.complete_bins(sizes, 20, nodes=None)) == least_bins(sizes, 20)


def test_bin_completion_beats_best_fit():
    rng = random.Random(3)
    better = 0
    for _ in range(300):
        sizes = [rng.randint(10, 60) for _ in range(30)]
        a, b = len(packing.best_fit_decreasing(sizes, 100)), len(packing.complete_bins(sizes, 100))
        assert b <= a
        better += b < a
    assert better > 0


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 1, "s", 2, 3) for i, t in rows], "doc_id long, text string, size int, shard string, piece_no int, container_id int").repartition(3)


def test_pack_table(spark):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 30)) for i in range(200)] + [(500, "w x " * 45), (501, None), (502, " \n"), (7, "again"), (None, "lost")]
    rows.append((503, "w " * 20))
    packed = packing.pack(documents(spark, rows), capacity=20, shard_items=64).collect()
    by_bin = Counter()
    by_doc = Counter()
    for r in packed:
        by_doc[r["doc_id"]] += r["piece_tokens"]
        if r["container_id"] is not None:
            by_bin[r["container_id"]] += r["piece_tokens"]
    want = {}
    for i, t in rows:
        if i is not None:
            want[i] = max(want.get(i, 0), len(re.findall(r"[^ \t\r\n]+", t or "")))
    assert by_doc == Counter(want) and max(by_bin.values()) <= 20
    assert len(by_bin) <= sum(want.values()) / 20 * 1.1 + 8
    pieces = sorted((r["piece_no"], r["piece_tokens"]) for r in packed if r["doc_id"] == 500)
    assert pieces == [(0, 20), (1, 20), (2, 5)]
    assert {r["container_id"] for r in packed if r["doc_id"] in (501, 502)} == {None}
    whole = [r["doc_id"] for r in packed if want[r["doc_id"]] <= 20]
    assert len(whole) == len(set(whole))
    over = {r[0] for r in packing.oversized(packing.pack(documents(spark, rows), capacity=20), capacity=20).collect()}
    assert over == {i for i, n in want.items() if n > 20}


def test_pack_nothing(spark):
    assert packing.pack(documents(spark, [])).count() == 0


def test_pack_by_a_public_tokenizer(spark):
    public = pytest.importorskip("public_tokenizers")
    packed = packing.pack(documents(spark, [(1, "Hello world, this is text."), (2, "<|endoftext|>")]), capacity=480, tokenizer_file=public.path("byte_bpe_50k.json"))
    assert {r["doc_id"]: r["doc_tokens"] for r in packed.collect()} == {1: 7, 2: 7}


def test_gap_to_the_bound_with_the_production_parameters():
    for seed in (1, 6, 10):
        rng = random.Random(seed)
        sizes = [min(480, max(1, int(rng.lognormvariate(4.9, 0.7)))) for _ in range(4000)]
        bound = packing.lower_bound(np.bincount(sizes, minlength=481), 480)
        found = len(packing.complete_bins(sizes, 480))
        assert bound <= found <= bound + 1 and found <= len(packing.best_fit_decreasing(sizes, 480))


def triplets(n, capacity, rng):
    """Items that fill n containers exactly, three in each."""
    out = []
    while len(out) < 3 * n:
        a = rng.randint(int(0.38 * capacity), int(0.49 * capacity))
        b = rng.randint((capacity - a) // 4 + 1, (capacity - a) // 2)
        if b >= capacity // 4 and capacity - a - b >= capacity // 4:
            out += [a, b, capacity - a - b]
    return out


def test_the_exact_search_packs_triplets():
    rng = random.Random(3)
    for _ in range(8):
        sizes = triplets(20, 1000, rng)
        assert len(packing.best_fit_decreasing(sizes, 1000)) > 20
        bins = packing.complete_bins(sizes, 1000, nodes=None)
        assert len(bins) == 20 and sorted(s for b in bins for s in b) == sorted(sizes)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=9), st.integers(1, 20))
def test_fillings_leave_out_only_dominated_ones(sizes, room):
    have = np.bincount(sizes, minlength=21).tolist()
    kept = list(packing.fillings(have, room, room))
    for mask in range(1 << len(sizes)):
        f = tuple(s for i, s in enumerate(sorted(sizes, reverse=True)) if mask >> i & 1)
        if sum(f) <= room:
            assert any(packing.dominated(g, f) for g in kept)


def test_every_shard_is_a_task(spark):
    packed = packing.pack(documents(spark, [(i, "w " * (i % 19 + 1)) for i in range(300)]), capacity=20, shard_items=32, nodes=None)
    assert packed.rdd.getNumPartitions() == 10
    assert {r["container_id"] >> 32 for r in packed.collect()} == set(range(10))
