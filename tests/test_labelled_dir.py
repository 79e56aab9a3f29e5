"""Labelled text files: one for each document, no folder for each."""

from pathlib import Path

from chatterlens.sources import readers as R


def test_a_file_for_each_document_and_few_folders(spark, tmp_path):
    rows = [(i, i % 2, f"é text {i}\nline\n") for i in range(300)] + [(7, 1, "again"), (8, 1, "other label"), (900, None, None)]
    path = str(tmp_path / "labelled")
    R.write_labelled_dir(spark.createDataFrame([(5000, 1, "old")], "doc_id long, label int, text string"), path)
    R.write_labelled_dir(spark.createDataFrame(rows, "doc_id long, label int, text string"), f"file://{path}")
    want = {(i, i % 2): f"é text {i}\nline\n\n" for i in range(300)} | {(8, 1): "other label\n", (900, 0): "\n"}
    got = {(r.doc_id, r.label): r.text for r in R.read_labelled_dir(spark, path).collect()}
    assert sorted(got.pop((7, 1)).split("\n")) == sorted((want.pop((7, 1)) + "again\n").split("\n"))
    assert got == want
    assert len([x for x in Path(path).rglob("*") if x.is_dir()]) <= 2 + 2 * R.FOLDERS


def test_no_document(spark, tmp_path):
    path = str(tmp_path / "labelled")
    R.write_labelled_dir(spark.createDataFrame([], "doc_id long, label int, text string"), path)
    assert R.read_labelled_dir(spark, path).collect() == []
