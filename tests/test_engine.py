import contextlib
import http.server
import json
import sys
import threading
import types

import pytest
from pyspark import cloudpickle

from siltstone.engine import ANSWER, NOT_READY, Engine
from siltstone.operators.embedding import embed_images
from siltstone.plugins import HttpGenerator, PypdfReader
from siltstone.sources.files import load_folder
from siltstone.sources.store import Store, latest, numbered
from siltstone.streaming.ingest import stream_texts

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import the tests


class Images:
    def read(self, content):
        if content == b"bad":
            raise ValueError("no image")
        return "a pump", "", "PUMP 7"


class Pdf:
    def text(self, content):
        if content == b"broken":
            raise ValueError("no pdf")
        return "page one\npage two"

    def tables(self, content):
        if content == b"broken":
            raise ValueError("no pdf")
        return [(1, [[["k", None], ["1", "x"]], [], [["lost"], ["1"]]]), (2, [[["a"], ["b"]]])]


@pytest.fixture
def folder(tmp_path):
    d = tmp_path / "docs"
    (d / "sub").mkdir(parents=True)
    (d / "a.md").write_text("# Pumps\nThe red pump moves water.\n# Fans\nThe fan moves air.")
    (d / "sub/b.TXT").write_text("Valves close pipes.")
    (d / "c.html").write_text("<p>ignored</p>")
    (d / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (d / "p.pdf").write_bytes(b"ok")
    (d / "q.PDF").write_bytes(b"broken")
    (d / "i.png").write_bytes(b"img")
    (d / "j.jpg").write_bytes(b"bad")
    return d


def test_load_folder(spark, folder):
    documents, images = load_folder(spark, str(folder), image_reader=Images(), pdf_reader=Pdf())
    rows = documents.collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["doc_seq"])):
        by.setdefault(r["path"].rsplit("/", 1)[1], []).append(r)
    assert set(by) == {"a.md", "b.TXT", "bad.txt", "p.pdf", "q.PDF", "i.png", "j.jpg"}
    assert by["bad.txt"][0]["content"] is None and by["bad.txt"][0]["error"]
    assert [r["content"] for r in by["p.pdf"]] == [
        "page one\npage two", "| k |  |\n|---|---|\n| 1 | x |\n", '{"headers":["k",""],"rows":[["1","x"]]}', "Row -> k: 1, : x",
        "| a |\n|---|\n| b |\n", '{"headers":["a"],"rows":[["b"]]}', "Row -> a: b",
    ]
    assert [r["metadata"]["page"] for r in by["p.pdf"]] == [None, 1, 1, 1, 2, 2, 2]
    assert by["q.PDF"][0]["content"] == "" and by["q.PDF"][0]["error"]
    assert by["i.png"][0]["content"] == "a pump • PUMP 7"
    assert (by["i.png"][0]["metadata"]["chartqa"], by["i.png"][0]["metadata"]["ocr"]) == (False, True)
    assert by["j.jpg"][0]["content"] == ""
    assert images.count() == 2


def test_numbers_have_no_gaps(spark):
    df = spark.range(0, 50, 1, 7).selectExpr("49 - id as k", "id as v")
    got = numbered(df, ["k"], "t", 5).orderBy("k").collect()
    assert [r["id"] for r in got] == [f"t{i}" for i in range(5, 55)]
    assert numbered(df.where("k < 0"), ["k"], "t").count() == 0


def test_latest(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c"), (None, 1, "d")], "k int, at int, v string")
    assert sorted((r["k"], r["v"]) for r in latest(df, "k", "at").collect()) == [(1, "b"), (2, "c")]


def test_ingest_connect_ask_chat(spark, folder, tmp_path):
    store = str(tmp_path / "store")
    engine = Engine(spark, image_reader=Images(), pdf_reader=Pdf())
    assert engine.chat("hi", [])[-1]["content"] == NOT_READY
    assert engine.connect("")[1] is False
    assert engine.connect(store) == (f"Nothing is stored at {store}.", False)
    assert engine.ingest(str(folder), store) is True
    assert engine.ingest(str(folder), store) is False  # vectors are there already
    message, connected = engine.connect(store)
    assert connected and "2 images" in message
    assert engine.connect(str(tmp_path / "none"))[1] is False and engine.ready  # the former connection stays
    history = []
    assert engine.chat("  ", history) is history and history == []
    engine.show_context = True
    turns = engine.chat("red pump water", history)
    assert [t["role"] for t in turns] == ["user", "assistant", "assistant"]
    assert "a.md" in turns[1]["content"] and turns[2]["content"].startswith(ANSWER)
    asked = spark.createDataFrame([(1, "valves"), (2, " "), (3, "fan air")], "query_id long, question string")
    answers = {r["query_id"]: r["prompt"] for r in engine.ask(asked).collect()}
    assert set(answers) == {1, 3}
    assert "Source 1: b.TXT\nValves close pipes." in answers[1]
    assert answers[1].index("<image at") > answers[1].index("Valves close")
    with_answers = {r["query_id"]: r["answer"] for r in engine.answer(asked).collect()}
    assert set(with_answers) == {1, 3} and with_answers[1].startswith("Source 1: b.TXT")
    assert engine.progress["text"]["rows"] == Store(spark, store).count("text") and engine.progress["images"] == {"rows": 2, "embedded": 2}
    assert Store(spark, store).has("lexical")  # written at ingest, read by connect
    vectors = [r["embedding"] for r in Store(spark, store).collection("images").collect()]
    assert len(vectors[0]) == 64 and vectors[0] != vectors[1]
    text = Store(spark, store).collection("text")
    assert sorted(r["id"] for r in text.select("id").collect()) == sorted(f"t{i}" for i in range(text.count()))
    engine.reset()
    assert not engine.ready


def test_a_store_without_marker_is_absent(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "s/text"))
    assert Store(spark, str(tmp_path / "s")).collection("text") is None


def test_streamed_files_are_stored_once(spark, tmp_path):
    docs, store = tmp_path / "in", str(tmp_path / "out")
    docs.mkdir()
    (docs / "a.txt").write_text("first words")
    engine = Engine(spark)
    run = lambda: stream_texts(engine, str(docs), store, str(tmp_path / "cp")).awaitTermination()
    run()
    (docs / "b.txt").write_text("second words")
    (docs / "c.bin").write_bytes(b"x")
    run()
    run()
    rows = Store(spark, store).collection("text").collect()
    assert sorted(r["document"] for r in rows) == ["first words", "second words"]
    assert len({r["id"] for r in rows}) == 2
    assert engine.connect(store)[1]  # a store of arrivals only
    asked = spark.createDataFrame([(1, "second words")], "query_id long, question string")
    assert "Source 1: b.txt\nsecond words" in engine.ask(asked).first()["prompt"]


def test_arrivals_join_what_was_ingested(spark, tmp_path):
    docs, later, store = tmp_path / "docs", tmp_path / "later", str(tmp_path / "out")
    docs.mkdir()
    later.mkdir()
    (docs / "a.txt").write_text("first words")
    (later / "b.txt").write_text("late words")
    engine = Engine(spark)
    assert engine.ingest(str(docs), store)
    stream_texts(engine, str(later), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r["document"] for r in Store(spark, store).collection("text").collect()) == ["first words", "late words"]
    assert engine.connect(store) == (f"{store} is open: 2 text rows, 0 images.", True)


class Rgb:
    """Fails for a whole call if one image can't be read."""

    name, dim = "rgb", 2

    def embed_images(self, contents):
        if b"bad" in contents:
            raise ValueError("no image")
        return [[len(c), 1.0] for c in contents]


def test_one_unreadable_image_costs_only_itself(spark):
    df = spark.createDataFrame([(1, bytearray(b"abc")), (2, bytearray(b"bad")), (3, bytearray(b"x")), (4, None)], "k int, content binary").coalesce(1)
    got = {r["k"]: r["embedding"] for r in embed_images(df, "content", Rgb()).collect()}
    assert got == {1: [3.0, 1.0], 2: None, 3: [1.0, 1.0], 4: [0.0, 1.0]}


def test_files_without_a_reader_say_so(spark, folder):
    documents, _ = load_folder(spark, str(folder))
    by = {r["path"].rsplit("/", 1)[1]: r for r in documents.collect()}
    assert by["p.pdf"]["content"] == "" and "no reader" in by["p.pdf"]["error"]
    assert by["i.png"]["content"] == "" and "no reader" in by["i.png"]["error"]


def test_pdf_adapter(monkeypatch):
    page = types.SimpleNamespace(extract_text=lambda: "text", extract_tables=lambda: [[["a"], ["1"]]])
    empty = types.SimpleNamespace(extract_text=lambda: None, extract_tables=list)
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda f: types.SimpleNamespace(pages=[page, empty])))
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=lambda f: contextlib.nullcontext(types.SimpleNamespace(pages=[page, empty]))))
    assert PypdfReader().text(b"x") == "text\n"
    assert list(PypdfReader().tables(b"x")) == [(1, [[["a"], ["1"]]]), (2, [])]


def test_http_generator():
    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "said"}}]}).encode())

        def log_message(self, *args):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.handle_request, daemon=True).start()
    assert HttpGenerator(f"http://127.0.0.1:{server.server_port}/v1/", "m").answer("why?") == "said"
    assert asked == [("/v1/chat/completions", {"model": "m", "temperature": 0.2, "messages": [{"role": "user", "content": "why?"}]})]
    server.server_close()
