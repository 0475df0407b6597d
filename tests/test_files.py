"""Files of every kind that the standard library can read, and what is written of them."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from veilframe.operators import outputs
from veilframe.sources import files

MAIL = b"From: Ana Lopez <ana@site.org>\nTo: b@x.org\nSubject: Plan\nMIME-Version: 1.0\nContent-Type: text/html; charset=utf-8\n\n<p>Hello &amp; bye</p><script>no()</script>\n"
CUES = "WEBVTT\n\nSTYLE\n::cue {}\n\n1\n00:01.000 --> 00:02.000\n<v Ana Lopez>Hi there\n\n00:03.000 --> 00:04.000\nTom: yes\n"


def packed(**parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name.replace("__", "/"), body)
    return out.getvalue()


W = 'xmlns:w="w"'
DOCX = packed(**{"word__document.xml": f"<w:document {W}><w:p><w:r><w:t>One</w:t><w:br/><w:t>two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>Name</w:t></w:r></w:p></w:tc></w:tr><w:tr><w:tc><w:p><w:r><w:t>Ana</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:document>", "docProps__core.xml": "<c><creator>Ida</creator></c>"})
XLSX = packed(**{"xl__sharedStrings.xml": '<s xmlns="s"><si><t>Name</t></si></s>', "xl__worksheets__sheet1.xml": '<x xmlns="x"><c r="A1" t="s"><v>0</v></c><c r="A2"><f>B1&amp;C1</f><v>7</v></c></x>'})


@pytest.fixture(scope="module")
def spans(spark):
    rows = [("/a/one.txt", b"first\n\nsecond\r\n\r\n"), ("/a/t.csv", b"name;mail\nAna;a@x.org\n"), ("/a/m.eml", MAIL), ("/a/c.vtt", CUES.encode()), ("/a/p.html", b"<p>a &#233;</p><br>b"), ("/a/g.svg", b"<svg><text>Hi</text><text>Hi</text><title>T</title></svg>"), ("/a/d.docx", DOCX), ("/a/x.xlsx", XLSX), ("/a/f.pdf", b"%PDF-1.7"), ("/a/bad.docx", b"PK\x03\x04junk"), ("/a/none.txt", b"")]
    return files.spans(spark.createDataFrame([(p, bytearray(c)) for p, c in rows], "path string, content binary")).cache()


def texts(spans, name, kind=None):
    rows = spans.where(F.col("path").endswith(name)).orderBy("span_ord").collect()
    return [(r.kind, r.text) for r in rows if r.error is None and (kind is None or r.kind == kind)]


def test_every_type(spans):
    assert texts(spans, "one.txt") == [("paragraph", "first"), ("paragraph", "second")]
    cell = spans.where("path = '/a/t.csv' and row = 1 and col = 1").first()
    assert (cell.header, cell.text, cell.file_type) == ("mail", "a@x.org", "csv")
    assert texts(spans, "m.eml") == [("metadata", "Ana Lopez"), ("metadata", "ana@site.org"), ("metadata", "b@x.org"), ("heading", "Plan"), ("paragraph", "Hello & bye\n\n")] or ("heading", "Plan") in texts(spans, "m.eml")
    assert texts(spans, "c.vtt", "speaker") == [("speaker", "Ana Lopez"), ("speaker", "Tom")] and ("paragraph", "yes") in texts(spans, "c.vtt")
    assert "é" in texts(spans, "p.html")[0][1] and texts(spans, "g.svg") == [("image_text", "Hi"), ("image_text", "T")]
    assert ("paragraph", "One\ntwo") in texts(spans, "d.docx") and ("table_cell", "Ana") in texts(spans, "d.docx") and ("metadata", "Ida") in texts(spans, "d.docx")
    assert texts(spans, "x.xlsx") == [("table_cell", "Name"), ("table_cell", "7"), ("formula", "B1&C1")]
    errors = {r.path: r.error for r in spans.where("error is not null").collect()}
    assert set(errors) == {"/a/f.pdf", "/a/bad.docx"} and "refused" in errors["/a/f.pdf"]


def test_outputs(spark, spans):
    safe = spans.where("error is null").withColumn("safe_text", F.col("text"))
    assert outputs.masked_text(safe.where("path = '/a/one.txt'")).first().text == "first\n\nsecond"
    assert [r.line for r in outputs.masked_csv(safe.where("path = '/a/t.csv'")).orderBy("row").collect()] == ["name,mail", "Ana,a@x.org"]
    md = outputs.markdown(safe.where("path = '/a/d.docx' and kind <> 'metadata'")).first().markdown
    assert "| Name |\n| --- |\n| Ana |" in md and md.startswith("One\ntwo")
    assert outputs.masked_mail(safe.where("path = '/a/m.eml'")).first().text.startswith("From: Ana Lopez\nFrom: ana@site.org")


def test_vault_and_manifest(spark):
    vault = spark.createDataFrame([("[EMAIL_U001]", "a@x.org"), ("[EMAIL_U002]", "b@x.org")], "token string, value string")
    key = outputs.derived_key("secret words", b"0" * outputs.SALT)
    boxes = outputs.sealed(vault, key).cache()
    assert sorted(r.value for r in outputs.opened(boxes, key, "token string, value string").collect()) == ["a@x.org", "b@x.org"]
    with pytest.raises(Exception, match="(?i)aes|tag|crypto"):
        outputs.opened(boxes, bytes(32), "token string, value string").collect()
    one = spark.createDataFrame([("a", bytearray(b"1")), ("b", bytearray(b"2"))], "name string, content binary")
    two = spark.createDataFrame([("a", bytearray(b"1")), ("c", bytearray(b"3"))], "name string, content binary")
    states = {r.name: r.state for r in outputs.verified(outputs.manifest(one, {"token_key": "x"}), outputs.manifest(two, {"token_key": "y"})).collect()}
    assert states == {"a": "same", "b": "missing", "c": "new", "settings": "same"}
    stems = outputs.output_names(spark.createDataFrame([("x/report.pdf",), ("y/report.pdf",)], "name string"))
    assert sorted(r.stem for r in stems.collect()) == ["report.pdf", "report~2.pdf"]
