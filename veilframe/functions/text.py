"""Text functions as Column expressions: canonical keys, masks, keyed tokens, matches with offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.functions.checks import digits


def normalise(entity: Column, value: Column) -> Column:
    """The key under which equal values of a category meet."""
    v = F.trim(value)
    numeric = entity.isin("PHONE_NUMBER", "CREDIT_CARD", "US_SSN", "IN_AADHAAR") | (entity.isin("TAX_ID", "BANK_ACCOUNT") & ~v.rlike("[A-Za-z]"))
    return (
        F.when(entity.isin("EMAIL_ADDRESS", "UPI_ID"), F.regexp_replace(F.lower(v), r"\s", ""))
        .when(numeric, digits(v))
        .when(entity == "PERSON", F.lower(F.regexp_replace(v, r"\s+", " ")))
        .otherwise(F.regexp_replace(F.upper(v), r"\s+", " "))
    )


def mask(value: Column) -> Column:
    """First and last character stay; four or fewer become stars."""
    n = F.char_length(value)
    return F.when(n <= 4, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(value, F.lit(1)), F.repeat(F.lit("*"), n - 2), F.right(value, F.lit(1))))


def clean(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"[\s ]+", " "))


def token_case(word: Column) -> Column:
    """initial, title, upper, lower or null, by Unicode case."""
    return (
        F.when(word.rlike(r"(?U)^\p{Lu}\.?$"), "initial")
        .when(word.rlike(r"(?U)^\p{Lu}[\p{Lu}'’-]+$"), "upper")
        .when(word.rlike(r"(?U)^\p{Lu}[\p{L}'’-]*$"), "title")
        .when(word.rlike(r"(?U)^\p{Ll}[\p{Ll}'’-]*$"), "lower")
    )


def ocr_denoise(word: Column) -> Column:
    """Digits that character recognition takes for letters, in words with at most two digits and three letters or more."""
    few = F.char_length(digits(word)).between(1, 2) & (F.char_length(F.regexp_replace(word, r"[^A-Za-z]", "")) >= 3)
    return F.when(few, F.translate(word, "015864", "olsbba")).otherwise(word)


def markdown_cell(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))


def written_forms(value: Column) -> Column:
    """The value as it is, as HTML has it, and as an address has it."""
    html = value
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        html = F.replace(html, F.lit(plain), F.lit(escaped))
    return F.array_distinct(F.array(value, html, F.replace(F.url_encode(value), F.lit("+"), F.lit("%20"))))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 in hex, from nested digests."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(b ^ 0x36 for b in block)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(b ^ 0x5C for b in block)), F.unhex(inner)), 256)


def matches(text: Column, pattern: str, group: int = 0, lead: int = 0) -> Column:
    """array<struct<start, end, text>> of all matches, in code points, without leaving the JVM.

    With a group, the stretch of that group: it starts where group `lead`, all of the match before it, ends. Without a
    lead, the match must start with the group.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    ahead = F.regexp_extract_all(text, F.lit(pattern), F.lit(lead)) if lead else F.transform(found, lambda m: F.lit(""))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    rows = F.arrays_zip(found.alias("m"), part.alias("g"), ahead.alias("l"), F.slice(between, F.lit(1), F.size(found)).alias("b"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        begin = a["at"] + r["b"]
        own = begin + F.char_length(r["l"])
        one = F.struct(own.cast("int").alias("start"), (own + F.char_length(r["g"])).cast("int").alias("end"), r["g"].alias("text"))
        return F.struct((begin + F.char_length(r["m"])).cast("int").alias("at"), F.concat(a["out"], F.array(one)).alias("out"))

    return F.aggregate(rows, start, step)["out"]
