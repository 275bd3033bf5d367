from pyspark.sql import functions as F

from siltstone.operators import tables

SCHEMA = "head array<string>, rows array<array<string>>"


def test_markdown_and_json(spark):
    df = spark.createDataFrame([(["a", None], [["1", "2"], [None, "3"]])], SCHEMA)
    head = F.transform("head", lambda c: F.coalesce(c, F.lit("")))
    row = df.select(tables.markdown(head, F.col("rows")).alias("m"), tables.json(head, F.col("rows")).alias("j")).first()
    assert row["m"] == "| a |  |\n|---|---|\n| 1 | 2 |\n|  | 3 |\n"
    assert row["j"] == '{"headers":["a",""],"rows":[["1","2"],[null,"3"]]}'


def test_header_and_body(spark):
    df = spark.createDataFrame([([["h", None], ["1", "2"]],), ([["h"]],)], "t array<array<string>>")
    got = df.select(tables.header(F.col("t")), tables.body(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(["h", ""], [["1", "2"]]), (["h"], [])]


def sentences(spark, head, rows, **options):
    df = spark.createDataFrame([(7, head, rows)], "k int, " + SCHEMA)
    return [r["sentence"] for r in tables.row_sentences(df, "head", "rows", keep=("k",), **options).orderBy("row_ix").collect()]


def test_sentences_take_cells_through_csv(spark):
    assert sentences(spark, ["h1", "h2"], [["1", "2"], ["x,y", "z"], ["h1", "h2"]]) == ["Row -> h1: 1, h2: 2", "Row -> h1: x, h2: y"]
    assert sentences(spark, ["h"], [["a\nb"], [None], ["c"]]) == ["Row -> h: a", "Row -> h: b", "Row -> ", "Row -> h: c"]
    assert sentences(spark, ["a,b"], [["1"]]) == ["Row -> a,b: a", "Row -> a,b: 1"]


def test_sentences_with_plain_cells(spark):
    assert sentences(spark, ["h1", "h2"], [["x,y", " z "], ["h1", "h2"], [None, "1", "9"]], strict_csv=False) == ["Row -> h1: x,y, h2: z", "Row -> h1: , h2: 1"]


def test_no_rows(spark):
    assert sentences(spark, ["h"], []) == []
    assert sentences(spark, ["h"], None) == []
