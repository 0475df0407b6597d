"""Columns with clashing names and broken pictures."""

from veilframe.llm import images, mixing


def test_a_picture_without_a_head():
    assert images.decode(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\0IDAT\0\0\0\0") is None and images.decode(b"P5") is None


def test_mixing_keeps_columns_with_its_own_names(spark):
    rows = [(i, f"text {i} " * (i + 1), "s", i, 7, 8) for i in range(6)]
    out = mixing.emit(spark.createDataFrame(rows, "doc_id long, text string, source string, cell_no int, cell_no_r int, rows_before int"))
    assert out.columns == ["doc_id", "text", "source", "cell_no", "cell_no_r", "rows_before"] and {(r.cell_no, r.cell_no_r, r.rows_before) for r in out.collect()} <= {(i, 7, 8) for i in range(6)}
