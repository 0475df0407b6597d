"""Files as spans: what type a file is, and its text with the place each piece came from.

Files are read by Spark (binaryFile: path, content), so any store that Spark reads will do; parsing runs in Arrow batches
on the executors, with the standard library alone. A file that cannot be read gives no spans and one row with its error.
"""

from __future__ import annotations

import csv
import email
import email.policy
import email.utils
import html
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Limits of a package, so that a small file cannot unpack to a huge one.
PACKAGE_BYTES, PACKAGE_PARTS = 2 << 30, 20_000
TEXT_TYPES = {"txt": "text", "md": "text", "log": "text", "csv": "csv", "tsv": "csv", "eml": "email", "vtt": "transcript", "srt": "transcript", "html": "html", "htm": "html", "svg": "svg"}
SPAN = pa.schema([("span_ord", pa.int32()), ("kind", pa.string()), ("source", pa.string()), ("anchor", pa.string()), ("header", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("error", pa.string())])
SPAN_DDL = "path string, span_ord int, kind string, source string, anchor string, header string, row int, col int, text string, error string"


def load(spark: SparkSession, path: str) -> DataFrame:
    """path, content of every file under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def sniffed(content: Column, path: Column) -> Column:
    """pdf, png, jpeg, gif, tiff, bmp, legacy (old office files), zip (a package, told apart when opened), or by the name's
    ending what kind of text; unknown otherwise."""
    head = F.hex(F.substr(content, F.lit(1), F.lit(8)))
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    by_name = F.when(F.lit(False), "")
    for e, kind in TEXT_TYPES.items():
        by_name = by_name.when(ending == e, kind)
    magic = [("25504446", "pdf"), ("89504E47", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"), ("D0CF11E0", "legacy"), ("504B0304", "zip")]
    out = F.when(F.lit(False), "")
    for sign, kind in magic:
        out = out.when(head.startswith(sign), kind)
    return out.otherwise(F.coalesce(by_name, F.lit("unknown")))


class _Text(HTMLParser):
    """Text of a page: scripts and styles left out, a line end after blocks."""

    ENDS = {"br", "p", "div", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6", "table", "ul", "ol", "section", "article"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.deaf = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.deaf += tag in ("script", "style")
        if tag == "br":
            self.out.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.deaf = max(0, self.deaf - 1)
        elif tag in self.ENDS:
            self.out.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.deaf:
            self.out.append(data)


def page_text(source: str) -> str:
    p = _Text()
    p.feed(source)
    p.close()
    return "".join(p.out)


def decoded(data: bytes) -> str:
    for kind in ("utf-8-sig", "utf-16") if data[:2] in (b"\xff\xfe", b"\xfe\xff") else ("utf-8-sig",):
        try:
            return data.decode(kind)
        except UnicodeDecodeError:
            pass
    return data.decode("cp1252", "replace")


Row = tuple[str, str, str, str | None, int | None, int | None, str]  # kind, source, anchor, header, row, col, text


def text_rows(data: bytes) -> Iterator[Row]:
    for i, part in enumerate(re.split(r"\r?\n[ \t]*\r?\n", decoded(data))):
        if part.strip():
            yield "paragraph", "native", f"p[{i}]", None, None, None, part


def csv_rows(data: bytes) -> Iterator[Row]:
    """Cells that are not blank, with the header above them; the delimiter is told from the file."""
    text = decoded(data)
    try:
        dialect = csv.Sniffer().sniff(text[:65536], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    head: list[str] = []
    for r, cells in enumerate(csv.reader(io.StringIO(text, newline=""), dialect)):
        if r == 0:
            head = cells
        for c, value in enumerate(cells):
            if value.strip():
                yield "table_cell", "native", f"r{r}c{c}", head[c] if r and c < len(head) else None, r, c, value


def mail_rows(data: bytes) -> Iterator[Row]:
    """Names and addresses of the headers, the subject, the body (plain text rather than HTML). Attachments are counted."""
    m = email.message_from_bytes(data, policy=email.policy.default)
    for field in ("from", "to", "cc", "bcc", "reply-to"):
        for i, (name, address) in enumerate(email.utils.getaddresses([str(x) for x in m.get_all(field, [])])):
            if name:
                yield "metadata", "native", f"{field}[{i}].name", f"{field} name", None, None, name
            if address:
                yield "metadata", "native", f"{field}[{i}].address", f"{field} e-mail", None, None, address
    if m["subject"]:
        yield "heading", "native", "subject", None, None, None, str(m["subject"])
    body = m.get_body(preferencelist=("plain", "html"))
    if body is not None:
        text = body.get_content()
        text = page_text(text) if body.get_content_type() == "text/html" else text
        for kind, source, anchor, *rest in text_rows(text.encode()):
            yield kind, source, f"body.{anchor}", *rest
    n = sum(1 for _ in m.iter_attachments())
    if n:
        yield "note", "native", "attachments", None, None, None, f"{n} attachments left out"


CUE = re.compile(r"(?m)^(?P<from>\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})[ \t]+-->[ \t]+(?P<to>\d{1,2}:\d{2}(?::\d{2})?[.,]\d{3})[^\n]*\n")
VOICE = re.compile(r"<v(?:\.[^ >]*)?\s+([^>]+)>")
NAMED = re.compile(r"^([^\W\d_][\w.'’-]*(?: [\w.'’-]+){0,4}):\s")


def transcript_rows(data: bytes) -> Iterator[Row]:
    """The speaker and the speech of every cue, and notes; styles and regions are left out."""
    text = decoded(data).replace("\r\n", "\n")
    for i, block in enumerate(re.split(r"\n[ \t]*\n", text)):
        m = CUE.search(block + "\n")
        if not m:
            if re.match(r"(?:STYLE|REGION)\b", block) or block.strip() in ("", "WEBVTT"):
                continue
            yield "note", "native", f"b[{i}]", None, None, None, block
            continue
        if block[: m.start()].strip() and not block[: m.start()].strip().isdigit():
            yield "note", "native", f"b[{i}].name", None, None, None, block[: m.start()].strip()
        speech = (block + "\n")[m.end() :].rstrip("\n")
        voice, named = VOICE.search(speech), NAMED.match(speech)
        if voice or named:
            yield "speaker", "native", f"b[{i}].speaker", None, None, None, (voice or named)[1]
        spoken = re.sub(r"</?[vcbiu](?:\.[^ >]*)?(?:\s[^>]*)?>", "", speech if voice or not named else speech[named.end() :])
        if spoken.strip():
            yield "paragraph", "native", f"b[{i}].speech", None, None, None, spoken


def page_rows(data: bytes) -> Iterator[Row]:
    for kind, source, anchor, *rest in text_rows(page_text(decoded(data)).encode()):
        yield kind, source, anchor, *rest


def svg_rows(data: bytes) -> Iterator[Row]:
    seen = set()
    for i, e in enumerate(ElementTree.fromstring(data).iter()):
        if e.tag.rsplit("}", 1)[-1] in ("text", "title", "desc"):
            text = " ".join("".join(e.itertext()).split())
            if text and text not in seen:
                seen.add(text)
                yield "image_text", "native", f"e[{i}]", None, None, None, text


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def package(data: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(data))
    infos = z.infolist()
    if len(infos) > PACKAGE_PARTS or sum(i.file_size for i in infos) > PACKAGE_BYTES:
        raise ValueError("a package of too many parts, or too large once unpacked")
    return z


def paragraph_text(p: ElementTree.Element) -> str:
    return "".join("\n" if local(e.tag) in ("br", "cr") else "\t" if local(e.tag) == "tab" else (e.text or "") for e in p.iter() if local(e.tag) in ("t", "br", "cr", "tab", "instrText", "delText"))


def word_rows(z: zipfile.ZipFile) -> Iterator[Row]:
    """Paragraphs and table cells of the body, headers, footers, notes and comments."""
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"word/(?:document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", n)):
        root = ElementTree.fromstring(z.read(part))
        in_table = {id(p) for t in root.iter() if local(t.tag) == "tbl" for p in t.iter() if local(p.tag) == "p"}
        for i, p in enumerate(e for e in root.iter() if local(e.tag) == "p" and id(e) not in in_table):
            if (text := paragraph_text(p)).strip():
                yield "paragraph", "native", f"{part}#p[{i}]", None, None, None, text
        for t, table in enumerate(e for e in root.iter() if local(e.tag) == "tbl"):
            head: list[str] = []
            for r, row in enumerate(e for e in table if local(e.tag) == "tr"):
                cells = ["\n".join(paragraph_text(p) for p in c.iter() if local(p.tag) == "p") for c in row if local(c.tag) == "tc"]
                head = cells if r == 0 else head
                for c, text in enumerate(cells):
                    if text.strip():
                        yield "table_cell", "native", f"{part}#t[{t}]r{r}c{c}", head[c] if r and c < len(head) else None, r, c, text


def slide_rows(z: zipfile.ZipFile) -> Iterator[Row]:
    """Paragraphs of slides and notes, in the order of their numbers."""
    number = lambda n: int(re.search(r"(\d+)\.xml$", n)[1])
    for kind in ("slides/slide", "notesSlides/notesSlide"):
        for part in sorted((n for n in z.namelist() if re.fullmatch(rf"ppt/{kind}\d+\.xml", n)), key=number):
            for i, p in enumerate(e for e in ElementTree.fromstring(z.read(part)).iter() if local(e.tag) == "p"):
                if (text := paragraph_text(p)).strip():
                    yield "paragraph", "native", f"{part}#p[{i}]", None, None, None, text


def sheet_rows(z: zipfile.ZipFile) -> Iterator[Row]:
    """Cells of all sheets, hidden ones too, with the first cell of their column as header; formulas and comments."""
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in si.iter() if local(t.tag) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if local(si.tag) == "si"]
    for part in sorted(n for n in z.namelist() if re.fullmatch(r"xl/(?:worksheets/sheet|comments)\d*\.xml", n)):
        head: dict[str, str] = {}
        for e in ElementTree.fromstring(z.read(part)).iter():
            if local(e.tag) == "comment":
                if text := "".join(t.text or "" for t in e.iter() if local(t.tag) == "t").strip():
                    yield "comment", "native", f"{part}#{e.get('ref')}", None, None, None, text
            if local(e.tag) != "c":
                continue
            column, row = re.match(r"([A-Z]+)(\d+)", e.get("r", "A1")).groups()
            value = next((x.text or "" for x in e if local(x.tag) == "v"), "")
            text = shared[int(value)] if e.get("t") == "s" and value else "".join(t.text or "" for t in e.iter() if local(t.tag) == "t") or value
            formula = next((x.text or "" for x in e if local(x.tag) == "f"), "")
            above = head.get(column)
            head.setdefault(column, text)
            c = 0
            for letter in column:
                c = c * 26 + ord(letter) - 64
            for kind, value_ in (("table_cell", text), ("formula", formula)):
                if value_.strip():
                    yield kind, "native", f"{part}#{column}{row}", above, int(row), c - 1, value_


def package_rows(data: bytes) -> Iterator[Row]:
    """A word, slide or sheet file: its text, then properties, authors, alternative texts and link targets of all parts."""
    z = package(data)
    names = z.namelist()
    kinds: dict[str, Callable] = {"word/": word_rows, "ppt/": slide_rows, "xl/": sheet_rows}
    told = next((f for start, f in kinds.items() if any(n.startswith(start) for n in names)), None)
    if told is None:
        raise ValueError("a package of another kind")
    yield from told(z)
    for part in names:
        if part.startswith("docProps/") and part.endswith(".xml") or part.startswith("customXml/item") and part.endswith(".xml"):
            for e in ElementTree.fromstring(z.read(part)).iter():
                if e.text and e.text.strip() and not len(e):
                    yield "metadata", "native", f"{part}#{local(e.tag)}", local(e.tag), None, None, e.text.strip()
        elif part.endswith(".rels"):
            for e in ElementTree.fromstring(z.read(part)):
                if e.get("TargetMode") == "External":
                    yield "metadata", "native", f"{part}#{e.get('Id')}", "link", None, None, e.get("Target", "")
        elif part.endswith(".xml") and part.startswith(("word/", "ppt/", "xl/")):
            for i, e in enumerate(ElementTree.fromstring(z.read(part)).iter()):
                for a, v in e.attrib.items():
                    if local(a) in ("author", "lastModifiedBy", "descr", "title", "initials") and v.strip():
                        yield "metadata", "native", f"{part}#e[{i}].{local(a)}", local(a), None, None, v


READERS: dict[str, Callable[[bytes], Iterator[Row]]] = {"text": text_rows, "csv": csv_rows, "email": mail_rows, "transcript": transcript_rows, "html": page_rows, "svg": svg_rows, "zip": package_rows}


def spans(files: DataFrame, readers: dict[str, Callable[[bytes], Iterator[Row]]] | None = None) -> DataFrame:
    """path, file_type, sha256, span_ord, kind, source, anchor, header, row, col, text, error of files (path, content).

    readers maps a type to a function of the content; a caller with libraries for pdf or pictures adds its own there (rows
    of source image_ocr are then judged by the rules for such text). Types without a reader are refused: one row with the
    error. A file that its reader cannot read gives the spans up to there and the error.
    """
    known = READERS | (readers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, kind, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                rows, error = [], None
                try:
                    if kind not in known:
                        raise ValueError(f"files of type {kind} are refused")
                    for n, r in enumerate(known[kind](content.as_py() or b"")):
                        rows.append((n, *r, None))
                except Exception as e:  # noqa: BLE001 - whatever a reader raises is told, and the other files go on
                    error = f"{type(e).__name__}: {e}"
                if error:
                    rows.append((len(rows), None, None, None, None, None, None, None, error))
                for low in range(0, len(rows), 4096):
                    cols = zip(*rows[low : low + 4096], strict=True)
                    part = [pa.array(list(c), f.type) for c, f in zip(cols, SPAN, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part[0]), pa.string()), *part], ["path", *SPAN.names])

    typed = files.select("path", sniffed(F.col("content"), F.col("path")).alias("file_type"), "content")
    told = typed.select("path", "file_type", F.sha2("content", 256).alias("sha256"))
    return typed.mapInArrow(run, SPAN_DDL).join(told, "path").select("path", "file_type", "sha256", *SPAN.names)


def numeric_entities(text: Column) -> Column:
    """HTML entities read, all of them, by Arrow batches."""
    from pyspark.sql.functions import pandas_udf

    return pandas_udf(lambda s: s.map(html.unescape, na_action="ignore"), "string")(text)
