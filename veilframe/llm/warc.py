"""WARC archives, Zstandard-compressed record by record with a dictionary of their own.

A file starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record is one frame, followed
by an empty skippable frame. Each writing task trains the dictionary on its own records: up to SAMPLE_BYTES of them,
spread evenly over the file. That bound sets how well records compress and nothing else.

Records with equal payloads of at least `least_bytes` bytes are stored once: the one with the smallest id is the response, the
others are revisits that carry headers only. Matching runs over ids and digests, not over payloads.

Cases: null payload is empty; a null url has no WARC-Target-URI; control characters in a url are percent-encoded; rows
with a null id are responses unless an equal payload has an id; rows that repeat the response's id are responses too;
an empty table gives no files and no rows; other columns are not read.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, save
from veilframe.llm.files import read_whole, write_sections

DICTIONARY_FRAME = 0x184D2A5D
#: The empty skippable frame 0x184D2A50 as text.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
SUFFIX = ".warc.zst"
DICTIONARY_BYTES = 1 << 15
SAMPLE_BYTES = 1 << 21
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPACE = uuid.UUID("5b0f6a54-6a0c-4d4e-9d0b-6a2b4f0a7c11")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit of page refers_to."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]) -> bytes:
    """Trained where there is enough to train on, else raw content: the first record."""
    step = max(1, sum(map(len, records)) // SAMPLE_BYTES)
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records[::step], k=256, d=8, f=20, accel=4, steps=1, split_point=1.0).as_bytes()
    except zstandard.ZstdError:
        return records[0][:DICTIONARY_BYTES]


def frames(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    own = dictionary(records)
    yield struct.pack("<II", DICTIONARY_FRAME, len(own)) + own
    squeeze = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True)
    for r in records:
        yield squeeze.compress(r)


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a file."""
    magic, n = struct.unpack_from("<II", content)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame in front")
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + n]))
    stream = io.BufferedReader(plain.stream_reader(content[8 + n :], read_across_frames=True), 1 << 20)
    while first := stream.readline():
        if first.strip() != b"WARC/1.1":
            raise ValueError(f"not a record: {first[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record of another length than it says")
        yield head, block


def write(pages: DataFrame, path: str, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100, file_bytes: int = 32 << 20, date: str = "2000-01-01T00:00:00Z") -> None:
    """Archive pages under path."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = save(picked.select("page_id", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").alias("bytes")), "digests")
    firsts = digests.where(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # a plain key, so that the payloads stay where the writing tasks need them
    key = F.coalesce("page_id", F.lit(-(1 << 63))).alias("key")
    revisits = digests.join(firsts, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(key, "digest", "refers_to").distinct()
    files = max(1, -(-(digests.agg(F.sum("bytes")).first()[0] or 0) // file_bytes))
    dealt = picked.select("*", F.sha2("payload", 256).alias("digest"), key).repartition(files, "key", "digest")
    planned = dealt.join(revisits, ["key", "digest"], "left").select("page_id", "url", "payload", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = [record(*row, date) for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if records:
            for f in frames(records):
                yield pa.RecordBatch.from_arrays([pa.array([f], pa.binary())], ["section"])

    write_sections(arrow_map(planned, run, "section binary"), "section", path, SEPARATOR, SUFFIX)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: page_id, url, record_type, payload_bytes, payload_digest, refers_to, payload (null in revisits)."""
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]

    def rows(content: bytes) -> Iterator[tuple]:
        whole = lambda x: None if x is None else int(x)
        for head, block in parse(content):
            http, _, body = block.partition(b"\r\n\r\n")
            size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
            kept = head["warc-type"] == "response"
            yield whole(head.get("warc-page-id")), head.get("warc-target-uri"), head["warc-type"], size, head["warc-payload-digest"].removeprefix("sha256:"), whole(head.get("warc-refers-to-page-id")), body if kept else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                part: list[tuple] = []
                for r in rows(content.as_py()):
                    part.append(r)
                    if len(part) == 256:
                        yield batch(part)
                        part = []
                if part:
                    yield batch(part)

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part, strict=True), kinds, strict=True)], names)

    return arrow_map(read_whole(spark, path, SUFFIX).select("content"), run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")
