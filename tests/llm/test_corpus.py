"""Leaked passages, template residue, scanned text."""

import math
import random
import re
import shutil
from collections import Counter

import numpy as np
import pytest

from siltstone.llm import leakage, residue, scans

DOCS = "doc_id long, text string, item_id long, kind string, k int, t int"
RECORDS = "rec_id long, page_content string, text string, noise string, term string"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, 5, "x", 1, 2) for i, t in rows], DOCS).repartition(3)


def items(spark, rows):
    return spark.createDataFrame([(i, t, "test") for i, t in rows], "item_id long, text string, split string")


# --- leaked passages


def brute(docs, tests, n):
    def grams(t):
        w = re.findall("[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    held = {i: grams(t) for i, t in tests}
    return {(d, i) for d, t in docs for i, g in held.items() if grams(t) & g}


def test_phrases_agree_with_brute_force(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    tests = [(i, " ".join(rng.choices(words, k=rng.randint(5, 60)))) for i in range(30)]
    docs = []
    for d in range(150):
        body = rng.choices(words, k=rng.randint(0, 80))
        if d % 2:
            own = tests[rng.randrange(30)][1].split()
            a = rng.randrange(len(own))
            k = rng.randrange(len(body) + 1)
            body[k:k] = own[a : a + rng.randint(6, 20)]
        docs.append((d, rng.choice([" ", ", ", "\n"]).join(body).upper() if d % 3 else " ".join(body)))
    want = brute(docs, tests, 8)
    for segment in (2_000_000, 100):
        found = leakage.leaked_passages(documents(spark, docs), items(spark, tests), min_words=8, near_gap=0, segment_words=segment, block_items=7)
        rows = found.collect()
        assert {(r["doc_id"], r["item_id"]) for r in rows} == want and len(want) > 20
        held = {d: re.findall("[a-z0-9]+", t.lower()) for d, t in docs}
        asked = {i: t.split() for i, t in tests}
        for r in rows:
            assert held[r["doc_id"]][r["doc_word"] : r["doc_word"] + r["words"]] == asked[r["item_id"]][r["item_word"] : r["item_word"] + r["words"]]


def test_near_matches(spark):
    tests = [(1, " ".join(f"a{i}" for i in range(20)))]
    broken = " ".join(f"a{i}" if i != 10 else "zz" for i in range(20))
    apart = " ".join(f"a{i}" if i != 10 else "zz yy xx vv" for i in range(20))
    found = leakage.leaked_passages(documents(spark, [(1, broken), (2, apart), (3, tests[0][1])]), items(spark, tests), min_words=12, near_gap=2).collect()
    assert {(r["doc_id"], r["kind"], r["words"]) for r in found} == {(1, "near", 19), (3, "phrase", 20)}


def longest_chain(doc, item, gap):
    best = {}
    for p, w in enumerate(doc):
        for q, x in enumerate(item):
            if w == x:
                best[p, q] = 1 + max((best.get((p - i, q - j), 0) for i in range(1, gap + 2) for j in range(1, gap + 2)), default=0)
    return max(best.values(), default=0)


def test_near_matches_agree_with_brute_force_however_often_they_are_broken(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)] + ["the", "of"] * 30
    tests = [(i, " ".join(rng.choices(words, k=rng.randint(12, 60)))) for i in range(20)]
    docs = [(0, " ".join([*tests[0][1].split()[2:8], "zz", *tests[0][1].split()[9:15]]))]
    for d in range(1, 161):
        own = tests[d % 20][1].split()
        every, out = 3 + d % 8, []
        for k, w in enumerate(own[: rng.randint(10, 60)]):
            out += [w] if k % every != every - 1 else rng.choice([[], ["zz"], [w, "zz"], ["zz", "yy"], ["zz", "yy", "xx"]])
        docs.append((d, " ".join(rng.choices(words, k=rng.randint(0, 40)) + out + rng.choices(words, k=rng.randint(0, 40)))))
    want = {(d, i): n for d, t in docs for i, x in tests if (n := longest_chain(t.split(), x.split(), 2)) >= 12}
    for segment in (2_000_000, 100):
        got = {}
        for r in leakage.leaked_passages(documents(spark, docs), items(spark, tests), segment_words=segment, block_items=7).collect():
            got[r["doc_id"], r["item_id"]] = max(got.get((r["doc_id"], r["item_id"]), 0), r["words"])
            assert docs[r["doc_id"]][1].split()[r["doc_word"]] == tests[r["item_id"]][1].split()[r["item_word"]]
        assert got == want and len(want) > 80 and want[0, 0] == 12


def test_the_index_is_asked_again_without_the_documents(spark, tmp_path):
    phrase = " ".join(f"c{i}" for i in range(30))
    documents(spark, [(i, f"x {phrase} y") for i in range(20)]).write.parquet(str(tmp_path / "docs"))
    index = leakage.index_passages(spark.read.parquet(str(tmp_path / "docs")), segment_words=100)
    shutil.rmtree(tmp_path / "docs")
    for block in (1, 5_000):  # cut into blocks, and not
        found = index.find(items(spark, [(1, phrase), (2, phrase[8:]), (3, "other " * 20)]), near_gap=0, block_items=block)
        assert found.count() == 40 and "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_no_match_reaches_over_documents_nulls_and_none(spark):
    phrase = " ".join(f"b{i}" for i in range(12))
    half = phrase.split()
    docs = [(1, " ".join(half[:6])), (2, " ".join(half[6:])), (3, None), (None, phrase), (4, ""), (5, phrase), (5, phrase), (6, phrase.replace(" ", " ... "))]
    tests = [(9, phrase), (8, None), (None, phrase), (7, "too short")]
    found = leakage.leaked_passages(documents(spark, docs), items(spark, tests)).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in found) == [(5, 9), (6, 9)]
    assert leakage.leaked_passages(documents(spark, docs), items(spark, [])).count() == 0
    assert leakage.leaked_passages(documents(spark, []), items(spark, tests)).count() == 0


# --- template residue

PROSE = "The pump was tested in the spring, and it was found that the valve did not close. When the work was done, all of the parts were put back."
RESIDUE = {
    "placeholder": [
        f"{PROSE} The {{{{pump_name}}}} was moved.", "Dear [Insert name here], the pump is ready.", "Name: <first name goes here>\nCity: [your city]", "Total ${order.total} due.",
        "See [[part list]] and <%= user.name %> for more.", "Ring @@phone_number@@ or %office_phone%.", "Code: __part_code__ and XX_part_code_XX",
    ],
    "filler": [f"{PROSE}\n\nLorem ipsum dolor sit amet consectetur adipiscing elit.\n\n{PROSE}", "asdf foo bar baz foo asdf", "Coming soon. Please check back later.", "Body text 1\nHeading one 2\nBullet point 4"],
    "error": ["Error 404\nThe page you requested does not exist.\n\nHome | Search | Help", "Zugriff verweigert. Bitte melden Sie sich erneut an.", "Access denied. You lack permission to open this file.", "La page demandée est introuvable."],
    "script": ["Please enable JavaScript in your browser and reload the page.", "Bitte aktivieren Sie JavaScript, um diese Seite anzuzeigen.\n\nStart | Suche"],
}
CLEAN = [
    PROSE, f"{PROSE}\n\nThe mark `{{{{name}}}}` stands for the name of the part.", f"{PROSE}\n\n```\n<h1>[Insert title here]</h1>\n```\n",
    "Half of the visitors who met error 404 on the page came back later, and the team has since changed the notice.", f"The viewer no longer requires JavaScript. {PROSE}",
    "# Pump and valve\n\n#page #caption", "| page | text |\n|---|---|\n| error | 404 |", "The lorem blocks of the old layout were taken out, and the text was written by hand.",
]


def test_residue_kinds(spark):
    rows, want, n = [], {}, 0
    for kind, texts in RESIDUE.items():
        for t in texts:
            rows.append((n, t))
            want[n] = {kind}
            n += 1
    rows += [(1000 + i, t) for i, t in enumerate(CLEAN)] + [(2000 + i, f"{PROSE} Part {i} is kept near the door of the hall.") for i in range(300)]
    rows += [(3000, None), (3001, ""), (3002, " \n "), (None, RESIDUE["error"][0]), rows[0]]
    got: dict = {}
    for r in residue.template_residue(documents(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add(r["kind"])
    assert got == want


def test_placeholders_are_scored_by_shape_and_words():
    index = residue.Index.build({"shape:[]": 9, "shape:<>": 9}, 100, 6.0)
    for t in ("Dear {name}, it is ready.", "The [Company Name] pump.", "On [DATE] it closed.", "Ask <name> first.", "Name: ______", "City: ........", "Write to {first_name} soon.", "An [COMPANY_NAME] pump."):
        assert residue.residue_kinds(t, index, 0.6, 0.75) == ["placeholder"], t
    for t in ("A set {a} of parts.", "He [sic] left.", "<p>The pump</p>", "<title>The pump</title>", "See [Name](http://a.b).", "- [x] done", "[table 3] shows", "Wait: ...", "The `{name}` mark.", "[pump tower] is"):
        assert "placeholder" not in residue.residue_kinds(t, index, 0.6, 0.75), t


def test_sentences_are_scored_each_by_its_own_exemplar():
    index = residue.Index.build({"page": 50, "the": 90, "you": 60, "be": 80, "could": 40}, 100, 6.0)
    kinds = lambda t: residue.residue_kinds(t, index, 0.6, 0.75)
    assert kinds("Something went wrong. Please try again later.\n\nHome | Back") == ["error"]
    assert kinds("Die angeforderte Seite wurde nicht gefunden.") == ["error"]
    assert kinds("You need to enable JavaScript to run this shop.") == ["script"]
    assert kinds("The page about bridges could be found by you in the harbour museum.") == []
    assert kinds("Section title 3\nBody text 1\nBullet point 9") == ["filler"]
    assert kinds("Loren ipsur dolom sitam consecut adipis elitus sedum tempora laboro magnar.") == ["filler"]  # made to look like it
    assert kinds("The commodity market of the province had a temporary surplus of magnets and commas.") == []


def test_residue_of_nothing(spark):
    assert residue.template_residue(documents(spark, [])).count() == 0


def test_a_very_long_text():
    index = residue.Index.build({}, 10, 6.0)
    assert residue.residue_kinds(f"{PROSE}\n" * 20_000, index, 0.6, 0.75) == []
    assert residue.residue_kinds("[" * 50_000 + "{" * 50_000, index, 0.6, 0.75) == []


# --- scanned text

WORDS = "the pump was tested in spring and it found that valve did not close when work done all of parts were put back under bridge near summer because metal column".split()
WORDS += "large small ladder window station summer printed handle copper silent engine market garden letter people modern simple double marble".split()


def page(rng, sentences):
    out = []
    for _ in range(sentences):
        s = ["the"] + [rng.choice(WORDS) for _ in range(rng.randint(6, 12))]
        out.append(" ".join(s).capitalize() + ".")
    return " ".join(out)


def wrapped(text, width):
    lines, line = [], ""
    for w in text.split():
        if len(line) + len(w) > width:
            lines.append(line)
            line = ""
        line = f"{line} {w}".strip()
    return [*lines, line]


def misread(rng, text, n):
    """The text with n words misread, by the confusions that scanners make."""
    words = text.split()
    spots = [i for i, w in enumerate(words) if len(w) >= 4 and re.fullmatch("[a-z]+", w)]
    done = 0
    for i in rng.sample(spots, len(spots)):
        options = [(p, r) for r, p in (("c", "e"), ("1", "l"), ("0", "o"), ("rn", "m"), ("†", "t"), ("ii", "u")) if p in words[i]]
        if options and done < n:
            printed, read = rng.choice(options)
            words[i] = words[i].replace(printed, read, 1)
            done += 1
    assert done == n
    return " ".join(words)


def noisy(rng, text, kinds):
    if "chars" in kinds:
        text = misread(rng, text, 5)
    lines = wrapped(text, 60)
    if "hyphen" in kinds:
        for i in range(0, len(lines) - 1, 3):
            head, _, tail = lines[i + 1].partition(" ")
            if len(head) >= 5 and head.isalpha():
                lines[i], lines[i + 1] = f"{lines[i]} {head[:3]}-", f"{head[3:]} {tail}".strip()
    out = []
    for i, x in enumerate(lines):
        if i and i % 4 == 0:
            if "header" in kinds:
                out.append("Volume 7, Bridge Report")
            if "pageno" in kinds:
                out.append(f"- {i} -")
        out.append(x)
    return "\n".join(out)


def test_repair_restores_the_text(spark):
    rng = random.Random(6)
    kinds = ["hyphen", "chars", "header", "pageno"]
    clean, rows, want = {}, [], {}
    for i in range(160):
        clean[i] = page(rng, 9)
        mine = [k for k in kinds if rng.random() < 0.4] if i % 2 else []
        rows.append((i, noisy(rng, clean[i], mine)))
        want[i] = mine
    extra = [(500, None), (501, ""), (502, "| a | b |\n|---|---|\n| 1 | 2 |"), (None, "x"), rows[1]]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows + extra], RECORDS).repartition(3)
    got = {r["rec_id"]: r for r in scans.repair_scans(df).collect()}
    assert set(got) == {*want, 501, 502}
    assert got[502]["page_content"] == extra[2][1] and got[501]["noise"] == []
    right = Counter()
    for i, kinds_ in want.items():
        right["noise"] += got[i]["noise"] == kinds_
        right["text"] += got[i]["page_content"] == clean[i]
    assert right["noise"] >= 0.97 * len(want) and right["text"] >= 0.95 * len(want), right
    assert {(r["rec_id"], r["noise"]) for r in scans.noise_kinds(scans.repair_scans(df)).collect()} == {(i, k) for i in got for k in got[i]["noise"]}


def test_own_hyphens_are_no_breaks():
    language = scans.Language({"high-pressure": 50, "pressure": 60, "high": 90, "the": 900, "is": 300, "pump": 80, "of": 200, "windows": 40}, {}, 10_000)
    text, noise = scans.repaired("The pump is of the high-\npressure kind, and the win-\ndows of the pump", language, 3)
    assert (text, noise) == ("The pump is of the high-pressure kind, and the windows of the pump", ["hyphen"])
    text, noise = scans.repaired("The pump is of the high-\npressure kind of the pump", language, 3)
    assert noise == []
    text, noise = scans.repaired("The pump is of the high- pres-\nsure kind of the pump", language, 3)
    assert noise == ["hyphen"]


def test_channel():
    even = dict.fromkeys(scans.CONFUSIONS, -2.0)
    assert scans.aligned("rnodern", "modern", even) == (-2.0, (("rn", "m"),))
    assert scans.aligned("mcdcrn", "modern", even) is None
    assert scans.aligned("", "", even) == (0.0, ())
    assert scans.aligned("woiild", "would", even) == scans.aligned("siip", "sup", even)
    assert scans.aligned("pagc5", "pages", even)[1] == (("c", "e"), ("5", "s"))


def test_confusions_are_counted_on_rare_words():
    language = scans.Language({"modern": 900, "engine": 800, "sheet": 700, "pages": 600}, {}, 100_000)
    hits = scans.confusion_hits(language, [("rnodern", 3), ("cnginc", 2), ("shcct", 1), ("pagcs", 40), ("unheard", 9)])
    assert hits == {("rn", "m"): 3, ("c", "e"): 6}  # "pagcs" is too frequent to be explained for certain
    logs = scans.confusion_logs(hits, 0.1)
    of_e = {pair: math.exp(x) for pair, x in logs.items() if pair[1] == "e"}
    assert sum(of_e.values()) == pytest.approx(0.1) and max(of_e, key=of_e.get) == ("c", "e")


def small_language(**more):
    words = {"they": 100, "eat": 50, "cat": 8, "bread": 100, "the": 400, "is": 90, "of": 200, "in": 90, "sleeps": 20}
    h = scans.WordHash()
    pairs = {scans.pair_key(h[a], h[b]): n for a, b, n in (("they", "eat", 45), ("eat", "bread", 30), ("the", "cat", 8), ("cat", "sleeps", 6))}
    return scans.Language(words, pairs, 2000, scans.confusion_logs({("c", "e"): 5}, 0.1), plain_share=0.002)


def test_viterbi_is_right_where_the_best_single_words_are_not():
    language = small_language()
    assert [c for c, _ in language.candidates("cat")] == ["cat", "eat"]
    greedy = lambda words: [max(language.candidates(w), key=lambda x: x[1])[0] for w in words]
    likeliest = lambda words: [max(language.candidates(w), key=lambda x: language.count(x[0]) * math.exp(x[1]))[0] for w in words]
    for read, printed in (("they cat bread", "they eat bread"), ("the cat sleeps", "the cat sleeps")):
        assert language.decoded(read.split()) == printed.split()
    assert greedy("they cat bread".split()) != "they eat bread".split()  # by the channel alone
    assert likeliest("they cat bread".split()) != "they eat bread".split()  # by words without their neighbours
    without = small_language()
    without.pairs = {}
    assert without.decoded("they cat bread".split()) != "they eat bread".split()


def test_rare_words_reach_the_records_that_need_them(spark):
    rng = random.Random(5)
    common = "the pump was in the hall and the valve was open when the work was done by the team".split()
    rows = [(i, " ".join(rng.choices(common, k=40))) for i in range(300)]
    rows += [(1000 + i, "the gasket and the manometer of the pump") for i in range(60)] + [(2000, "the gaskct was in the hall. The rnanometer was open and the ga5ket and the gas-\nkct was done")]
    df = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], RECORDS).repartition(3)
    got = {}
    for share in (1e-5, 0.01):  # all words with the language; and rare ones by the join
        fixed = {r["rec_id"]: r for r in scans.repair_scans(df, word_share=share).collect()}
        got[share] = fixed[2000]["page_content"], sorted(fixed[2000]["noise"])
        assert len(fixed) == len(rows)
    assert got[0.01] == got[1e-5] == ("the gasket was in the hall. The manometer was open and the gasket and the gasket was done", ["chars", "hyphen"])


def test_signs_in_an_unknown_word():
    known = {w: 5 for w in "garden pustrel marlow pustule foxtail roxane boxes pastor lustre".split()}
    language = scans.Language(known, {}, 10_000, scans.confusion_logs({}, 0.1))
    assert language.decoded(["pustr0x"]) == ["pustrox"] and language.decoded(["b2b"]) == ["b2b"]
    assert language.decoded(["mp3"]) == ["mp3"]


def test_pair_keys():
    h = scans.WordHash()
    words = ["a", "b", "c", "a", "b"]
    keys = scans.pair_keys(np.array([h[w] for w in words], np.uint64)).tolist()
    assert keys == [scans.pair_key(h[a], h[b]) for a, b in zip(words, words[1:])] and keys[0] == keys[3] != keys[1]


def test_the_language_counts_all_records_once(spark):
    rows = [(i, f"The word{'s' * (i % 3)} of the page.") for i in range(60)]
    df = spark.createDataFrame([*rows, *rows[:20], (None, "lost lost"), (90, None)], "k long, t string").repartition(5)
    language, rare = scans.corpus_language(df, "k", "t", 0, 0, 1, 0.1, 12)
    assert rare.count() == 0
    assert language.total == 300 and language.words["the"] == 120 and language.words["word"] == 20 and "lost" not in language.words
    h = language.hashes
    assert language.pairs[scans.pair_key(h["the"], h["page"])] == 60


def test_scans_of_nothing(spark):
    df = spark.createDataFrame([], RECORDS)
    assert scans.repair_scans(df).count() == 0
