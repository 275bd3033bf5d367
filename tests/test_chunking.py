from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.operators import chunking
from siltstone.operators.embedding import split_windows

TEXTS = st.text(alphabet=st.sampled_from(list("ab# \n`~.")), max_size=400)


def test_headers_cut_and_are_left_out():
    text = "intro\n# A\none\ntwo\n\nthree\n## B\nfour\n# C\n"
    assert chunking.header_sections(text) == ["intro", "one\ntwo  \nthree", "four"]


def test_equal_paths_join():
    assert chunking.header_sections("# A\none\n# A\ntwo") == ["one  \ntwo"]
    assert chunking.header_sections("# A\n## B\none\n# A\n## B\ntwo\n# X\n## B\nthree") == ["one  \ntwo", "three"]


def test_nothing_is_a_header_in_a_fence():
    assert chunking.header_sections("```\n# no\n\nx\n```\n# yes\ny") == ["```\n# no\n\nx\n```", "y"]
    assert chunking.header_sections("#no\n#### no") == ["#no\n#### no"]


def test_only_blank():
    assert chunking.header_sections(" \n\n") == []
    assert chunking.sized_pieces("") == []


def test_sizes_and_overlap():
    text = " ".join(f"word{i}" for i in range(400))
    pieces = chunking.sized_pieces(text, 100, 20)
    assert all(len(p) <= 100 for p in pieces)
    for a, b in zip(pieces, pieces[1:]):
        shared = max(n for n in range(0, 21) if a.endswith(b[:n]))
        assert shared >= 6


def test_long_words_are_cut():
    assert all(len(p) <= 50 for p in chunking.sized_pieces("x" * 333, 50, 10))


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_pieces_fit_and_keep_all_words(text):
    pieces = chunking.sized_pieces(text, 40, 8)
    assert all(0 < len(p) <= 40 for p in pieces)
    held = "".join(pieces)
    for c in "ab#.":
        assert held.count(c) >= text.count(c)


def test_chunk_documents_keeps_columns_that_clash(spark):
    rows = [(1, "# h\none", "x"), (2, None, None), (3, "  ", "y")]
    df = spark.createDataFrame(rows, "chunk_id int, content string, section string")
    got = chunking.chunk_documents(df).collect()
    assert [(r["chunk_id"], r["section"], r["section_ix"], r["piece_ix"], r["chunk"]) for r in got] == [(1, "x", 0, 0, "one")]


def test_window_counts(spark):
    sizes = [0, 1, 480, 481, 896, 906]
    df = spark.createDataFrame([(n,) for n in sizes], "n int")
    got = [r[0] for r in df.select(F.size(chunking.window_starts(F.col("n"), 480, 32))).collect()]
    assert got == [1, 1, 1, 2, 2, 3]
    assert [len(split_windows(list(range(n)), 480, 32)) for n in sizes] == got
    df = spark.createDataFrame([(n,) for n in (512, 513, 960, 961)], "n int")
    assert [r[0] for r in df.select(F.size(chunking.window_starts(F.col("n"), 512, 32))).collect()] == [1, 2, 2, 3]


def test_windows_overlap(spark):
    df = spark.createDataFrame([(1, [str(i) for i in range(10)]), (2, [])], "k int, t array<string>")
    got = {(r["k"], r["window_ix"]): r["window"] for r in chunking.token_windows(df, "t", size=6, overlap=2).collect()}
    assert got == {(1, 0): list("012345"), (1, 1): list("456789"), (1, 2): ["8", "9"], (2, 0): []}


def test_tokens(spark):
    df = spark.createDataFrame([(" a\tb\n",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(chunking.tokens(F.col("t"))).collect()] == [["a", "b"], [], []]
