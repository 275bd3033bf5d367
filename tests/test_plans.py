"""Scans read the columns that a query needs, and nothing is joined without keys."""

import pytest

from siltstone.plans import queries
from siltstone.session import materialize, shared_dir, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("window_counts", "doc_id:bigint,text:string"),
        ("bm25_doc_len", "doc_id:bigint,text:string"),
        ("md_chunks", "rec_id:bigint,page_content:string"),
        ("file_type_dispatch", "file_id:bigint,path:string"),
        ("batch_knn", "vec_id:bigint,embedding:array<float>"),
    ],
)
def test_scans_are_pruned(spark, tiny, name, columns):
    assert f"ReadSchema: struct<{columns}>" in plan(queries.QUERIES[name](spark, tiny))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"ask_batch"}))
def test_no_cross_join_and_no_row_wise_python(spark, tiny, name):
    text = plan(queries.QUERIES[name](spark, tiny))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in text


def test_materialized_tables_lie_in_the_shared_folder(spark):
    df = materialize(spark.range(5).selectExpr("id", "array(id) as a"), "t")
    assert df.count() == 5 and df.schema["a"].dataType.simpleString() == "array<bigint>"
    assert {f.split("/siltstone/")[0].split(":")[-1].lstrip("/") for f in df.inputFiles()} == {shared_dir(spark).split(":")[-1].lstrip("/")}


def test_small_inputs_are_spread(spark, tmp_path):
    spark.range(300_000).selectExpr("id", "uuid() as t").coalesce(1).write.parquet(str(tmp_path / "x.parquet"))
    assert table(spark, str(tmp_path), "x").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
