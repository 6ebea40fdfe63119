"""Training rows hold every text that has a class."""

from terroir.queries.relational import training_rows


def test_all_rows_with_a_class(spark, tmp_path):
    rows = [(1, "short", "review"), (2, "long " * 100, " review "), (3, "x", ""), (4, "y", None), (5, None, "offer"), (6, "z", "  ")]
    spark.createDataFrame(rows, "doc_id bigint, text string, doc_type string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in training_rows(spark, str(tmp_path)).collect()), key=str)
    assert got == [(1, "review", "short"), (2, "review", ("long " * 100).strip()), (5, "offer", None)]
