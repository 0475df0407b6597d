"""What leaves the engine: masked files, Markdown, reports, the encrypted vault, the manifest of a run."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import mask
from veilframe.operators.redact import live

#: Names of outputs that hold no values and may be passed on.
SHAREABLE = ("llm.md", "summary.json", "audit.jsonl", "manifest.json", "register_masked")
#: Cost, block size and parallelism of the key derivation; length of salt and nonce.
SCRYPT, SALT, NONCE = {"n": 1 << 15, "r": 8, "p": 1, "maxmem": 64 << 20, "dklen": 32}, 16, 12
AAD = b"veilframe-vault-1"


def masked_text(spans: DataFrame, key: str = "path") -> DataFrame:
    """A row a text file: its paragraphs (safe_text, in the order of span_ord) with a blank line between. Texts are put
    together per file, so one file's text is held at a time."""
    return spans.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_ord", "safe_text"))), lambda s: s["safe_text"]), "\n\n").alias("text"))


def masked_csv(cells: DataFrame, key: str = "path") -> DataFrame:
    """A row a line of a delimited file, rebuilt from its cells (row, col, safe_text); fields are quoted where they must be."""
    width = cells.groupBy(key).agg((F.max("col") + 1).alias("width"))
    quoted = F.when(F.col("safe_text").rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col("safe_text"), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col("safe_text"))
    rows = cells.groupBy(key, "row").agg(F.map_from_entries(F.collect_list(F.struct(F.col("col"), quoted))).alias("m")).join(width, key)
    line = F.array_join(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(""))), ",")
    return rows.select(key, "row", line.alias("line"))


def masked_transcript(spans: DataFrame, blocks: DataFrame, key: str = "path") -> DataFrame:
    """Transcripts rebuilt: blocks (key, block, times) with the masked speaker and speech of their spans (anchor b[n].part)."""
    part = spans.select(key, F.regexp_extract("anchor", r"^b\[(\d+)\]", 1).cast("int").alias("block"), F.regexp_extract("anchor", r"\.(\w+)$", 1).alias("part"), "safe_text")
    said = part.groupBy(key, "block").agg(F.max(F.when(F.col("part") == "speaker", F.col("safe_text"))).alias("speaker"), F.max(F.when(F.col("part") == "speech", F.col("safe_text"))).alias("speech"), F.max(F.when(F.col("part") == "", F.col("safe_text"))).alias("note"))
    both = blocks.join(said, [key, "block"], "left")
    text = F.when(F.col("times").isNull(), F.col("note")).otherwise(F.concat_ws("\n", "times", F.concat(F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), F.coalesce("speech", F.lit("")))))
    return both.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", text.alias("t")))), lambda b: b["t"]), "\n\n").alias("text"))


def masked_mail(spans: DataFrame, key: str = "path") -> DataFrame:
    """A mail as text: masked headers, subject and body; attachments are not kept."""
    field = F.regexp_extract("anchor", r"^([\w-]+)", 1)
    head = F.when(F.col("kind").isin("metadata", "heading"), F.concat(F.initcap(field), F.lit(": "), F.col("safe_text")))
    rows = spans.select(key, "span_ord", head.alias("head"), F.when(F.col("anchor").startswith("body"), F.col("safe_text")).alias("body"))
    ordered = lambda c: F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("span_ord", F.col(c).alias("t")))))
    listed = lambda c, sep: F.array_join(F.transform(ordered(c), lambda s: s["t"]), sep)
    return rows.groupBy(key).agg(F.concat(listed("head", "\n"), F.lit("\n\n"), listed("body", "\n\n")).alias("text"))


def md_table(rows: Column) -> Column:
    """array<array<string>>, the first the header, as a Markdown table; every row as wide as the header."""
    width = F.size(F.get(rows, F.lit(0)))
    cell = lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(F.sequence(F.lit(0), width - 1), lambda i: cell(F.get(r, i))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def markdown(spans: DataFrame, key: str = "path") -> DataFrame:
    """A row a file: headings, paragraphs and tables (cells of one table, told by the anchor before r..c..) in their order."""
    table = F.when(F.col("kind") == "table_cell", F.regexp_extract("anchor", r"^(.*?)r\d+c\d+$", 1))
    cells = spans.where(F.col("kind") == "table_cell").withColumn("t", table)
    lines = cells.groupBy(key, "t", "row").agg(F.min("span_ord").alias("at"), F.map_from_entries(F.collect_list(F.struct("col", "safe_text"))).alias("m"), F.max("col").alias("last"))
    width = Window.partitionBy(key, "t")
    lines = lines.withColumn("width", F.max("last").over(width) + 1).withColumn("cells", F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda c: F.try_element_at("m", c)))
    tables = lines.groupBy(key, "t").agg(F.min("at").alias("at"), F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("rows")).select(key, "at", md_table(F.col("rows")).alias("block"))
    safe = F.replace(F.col("safe_text"), F.lit("|"), F.lit("\\|"))
    others = spans.where(F.col("kind") != "table_cell").select(key, F.col("span_ord").alias("at"), F.when(F.col("kind") == "heading", F.concat(F.lit("## "), safe)).otherwise(safe).alias("block"))
    return tables.unionByName(others).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "block"))), lambda b: b["block"]), "\n\n").alias("markdown"))


def register(findings: DataFrame, masked: bool = True) -> DataFrame:
    """The list of findings; values masked, unless the list stays where the values may be seen."""
    value = mask(F.col("value")) if masked else F.col("value")
    return findings.withColumn("value", value)


def audit_records(findings: DataFrame, keys: list[str], operator: str) -> DataFrame:
    """One record a finding, as canonical JSON: place, category, decision, score, masked value, who ran it."""
    fields = [*keys, "start", "end", "entity_type", "decision", "score"]
    record = F.to_json(F.struct(*[F.col(c) for c in sorted(fields)], F.lit(operator).alias("operator"), mask(F.col("value")).alias("value")))
    return findings.select(*keys, record.alias("record"))


def write_reports(findings: DataFrame, summary: DataFrame, path: str) -> None:
    """register_masked and register_SENSITIVE as CSV, the summary as JSON, under path, by Spark's writers."""
    flat = [c for c, t in findings.dtypes if not t.startswith(("array", "map", "struct"))]
    register(findings.select(*flat)).write.mode("overwrite").option("header", True).csv(f"{path}/register_masked")
    findings.select(*flat).write.mode("overwrite").option("header", True).csv(f"{path}/register_SENSITIVE")
    summary.write.mode("overwrite").json(f"{path}/summary.json")


def shareable(names: DataFrame, name: str = "name") -> DataFrame:
    return names.where(F.col(name).isin(*SHAREABLE))


def derived_key(passphrase: str, salt: bytes) -> bytes:
    return hashlib.scrypt(passphrase.encode(), salt=salt, **SCRYPT)


def sealed(vault: DataFrame, key: bytes) -> DataFrame:
    """The vault's rows, each encrypted with AES-256-GCM under a nonce of its own (token, box)."""
    row = F.to_json(F.struct(*sorted(vault.columns)))
    box = F.aes_encrypt(F.encode(row, "UTF-8"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.left(F.sha2(F.concat(F.lit(key.hex()), F.uuid()), 256), F.lit(2 * NONCE))), F.lit(AAD))
    return vault.select("token", F.base64(box).alias("box"))


def opened(boxes: DataFrame, key: bytes, schema: str) -> DataFrame:
    """Rows of a sealed vault; a wrong key or a changed box raises."""
    row = F.decode(F.aes_decrypt(F.unbase64("box"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(AAD)), "UTF-8")
    return boxes.select(F.from_json(row, schema).alias("r")).select("r.*")


def manifest(files: DataFrame, settings: dict, secret: tuple[str, ...] = ("token_key", "passphrase")) -> DataFrame:
    """Digests of files (name, content) and the settings, secrets only as set or not: name, sha256, bytes."""
    told = {k: ("set" if v else "not set") if k in secret else v for k, v in settings.items()}
    text = json.dumps(told, sort_keys=True, separators=(",", ":"), default=str)
    own = files.select("name", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes"))
    line = files.sparkSession.range(1).select(F.lit("settings").alias("name"), F.lit(hashlib.sha256(text.encode()).hexdigest()).alias("sha256"), F.lit(len(text.encode())).cast("long").alias("bytes"))
    return own.unionByName(line)


def verified(before: DataFrame, after: DataFrame) -> DataFrame:
    """name, state (same, changed, missing, new) of a manifest against another."""
    both = before.select("name", F.col("sha256").alias("was")).join(after.select("name", F.col("sha256").alias("now")), "name", "full")
    return both.select("name", F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "new").when(F.col("was") == F.col("now"), "same").otherwise("changed").alias("state"))


def output_names(files: DataFrame, name: str = "name") -> DataFrame:
    """Adds stem: a name for each output, without its folder; equal ones are told apart by ~2, ~3."""
    base = F.regexp_replace(F.regexp_extract(name, r"([^/\\]+)$", 1), r"[^\w.()+ -]", "_")
    n = F.row_number().over(Window.partitionBy(F.lower(base)).orderBy(name))
    return files.withColumn("stem", F.when(n == 1, base).otherwise(F.concat(F.regexp_replace(base, r"(\.[^.]*)$", ""), F.lit("~"), n.cast("string"), F.regexp_extract(base, r"(\.[^.]*)$", 1))))


def live_masked(findings: DataFrame) -> DataFrame:
    return register(live(findings))
