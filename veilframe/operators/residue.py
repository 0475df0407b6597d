"""Known values that can still be read: what to look for, where it stands, and texts without it.

A value is looked for in every form it may be written in. Blanks of any kind and number count as one, case counts only for
single-word names, a long number counts by its digits however they are grouped, and a text is also read as it would be seen:
without tags, unescaped, decoded. A batch of texts is read once, by one automaton over all forms, if these are few enough to
be sent to every task (their size is measured first). Of more, each form is known by its longest word: a Bloom filter over
these lets only such words of a text leave the scan, with the letters around them, to be compared where the form is. Either
way the places are the leftmost and longest ones.
"""

from __future__ import annotations

import html
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import unquote_to_bytes

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.checks import digits
from veilframe.functions.text import mask
from veilframe.operators.redact import live, splice
from veilframe.sources.kept import kept

#: Shorter values, or numbers, are no needles; from here on a number is looked for by its digits alone, if they are
#: so large a share of it; what may stand between two of its digits.
LEAST_CHARS, LEAST_DIGITS, DIGITS_FORM, DIGITS_SHARE = 4, 6, 9, 0.6
BETWEEN_DIGITS = r"[\s().+-]{0,2}"
#: Characters of all forms that are sent to every task; of more, the forms are joined to.
HELD = 16_000_000
#: Bits of the filter for each of its entries; six hashes let one foreign word in a hundred through.
FILTER_BITS, FILTER_HASHES = 10, 6
#: A filter of more bits is not sent around: all words leave the scan then.
FILTER_MOST = 1 << 30
WORD = re.compile(r"[^\W_]+")
NUMBERS = re.compile(rf"\d+(?:{BETWEEN_DIGITS}\d+)*")
NEEDLE = "form string, token string, cased array<string>, number boolean"


def html_forms(value: Column) -> list[Column]:
    """A value as HTML has it, with both ways to write an apostrophe."""
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return [F.replace(value, F.lit("'"), F.lit(x)) for x in ("&#x27;", "&apos;")]


def address_forms(value: Column) -> list[Column]:
    """A value as an address has it: all encoded, or but for blanks and at signs."""
    full = F.url_encode(value)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        full = F.replace(full, F.lit(a), F.lit(b))
    return [full, F.replace(F.replace(full, F.lit("%40"), F.lit("@")), F.lit("%20"), F.lit(" "))]


def spaced(value: Column) -> Column:
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def needles(findings: DataFrame) -> DataFrame:
    """What to look for, from findings (entity_type, value, token, decision): form, token, cased, number.

    A form is in lower case with single blanks; of a number (`number`), its digits alone. `cased` has the spellings that count,
    or null if all do. A form without a letter or digit is none. A person's single word counts as written or in capitals only, and not at all while it awaits review; what
    was hidden only because a stamp runs across it is no needle. Short values and short numbers are none. A form that several
    values have belongs to the smallest token.
    """
    v = spaced(F.col("value"))
    rows = live(findings)
    if "recognizer" in findings.columns:
        rows = rows.where(F.coalesce(F.col("recognizer") != "failclosed:overprint", F.lit(True)))
    rows = rows.select("entity_type", "token", "decision", v.alias("v")).withColumn("d", digits(F.col("v")))
    bare = F.regexp_replace("v", r"[\s().+-]", "")
    word = (F.col("entity_type") == "PERSON") & ~F.contains(F.col("v"), F.lit(" "))
    rows = rows.where((F.char_length("v") >= LEAST_CHARS) & ~((F.col("d") == bare) & (F.length("d") < LEAST_DIGITS)) & ~(word & (F.col("decision") == "review")))
    every = F.array_distinct(F.transform(F.array("v", *html_forms(F.col("v")), *address_forms(F.col("v"))), F.lower))
    forms = rows.select(F.explode(F.when(word, F.array(F.lower("v"))).otherwise(every)).alias("form"), "token", F.when(word, F.array_distinct(F.array("v", F.upper("v")))).alias("cased"), F.lit(False).alias("number"))
    long = (F.length("d") >= DIGITS_FORM) & (F.length("d") >= DIGITS_SHARE * F.char_length(F.regexp_replace("v", " ", "")))
    numbers = rows.where(long & ~word).select(F.col("d").alias("form"), "token", F.lit(None).cast("array<string>").alias("cased"), F.lit(True).alias("number"))
    # of one form, a value of any case says more than one that is tied to some spellings
    first = F.min(F.struct(F.col("cased").isNotNull(), F.col("token"), F.col("cased")))
    return forms.unionByName(numbers).where(F.col("form").rlike(r"[\p{L}\p{N}]")).groupBy("form", "number").agg(first.alias("t")).select("form", "t.token", "t.cased", "number")


# texts as they are read


def lowered(text: str) -> str:
    """In lower case, letter for letter."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class View:
    """A text as it reads, and where each of its characters comes from: from `begins` to `ends` of the text as it is."""

    def __init__(self, text: str, begins: list[int] | range, ends: list[int] | range):
        self.text, self.begins, self.ends = text, begins, ends

    @classmethod
    def whole(cls, text: str) -> View:
        return cls(text, range(len(text)), range(1, len(text) + 1))

    def replaced(self, pattern: re.Pattern, by) -> View:
        """by(match): the pieces of what stands in its place, as (text, from, to) within the match."""
        out, begins, ends, at = [], [], [], 0
        for m in pattern.finditer(self.text):
            out.append(self.text[at : m.start()])
            begins += self.begins[at : m.start()]
            ends += self.ends[at : m.start()]
            for piece, a, b in by(m):
                out.append(piece)
                begins += [self.begins[m.start() + a]] * len(piece)
                ends += [self.ends[m.start() + b - 1]] * len(piece)
            at = m.end()
        if not at:
            return self
        return View("".join([*out, self.text[at:]]), begins + [*self.begins[at:]], ends + [*self.ends[at:]])


BLANKS, TAG, ENTITY, ENCODED = re.compile(r"\s{2,}|[^\S ]"), re.compile(r"<[^>]+>"), re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|\w+);?"), re.compile(r"(?:%[0-9A-Fa-f]{2})+")


def _decoded(m: re.Match) -> Iterator[tuple[str, int, int]]:
    """Characters of a run of encoded bytes, each with the bytes it takes."""
    raw, i = unquote_to_bytes(m[0]), 0
    while i < len(raw):
        n = 1 if raw[i] < 0xC0 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
        yield raw[i : i + n].decode("utf-8", "replace"), 3 * i, min(3 * (i + n), len(m[0]))
        i += n


def views(text: str) -> list[View]:
    """The text, and as it reads without tags (closed up, or with a blank for each), unescaped, and decoded."""
    out = [View.whole(text)]
    if "<" in text:
        out += [out[0].replaced(TAG, lambda m: []), out[0].replaced(TAG, lambda m: [(" ", 0, len(m[0]))])]
    for v in out.copy():
        u = v.replaced(ENTITY, lambda m: [(html.unescape(m[0]), 0, len(m[0]))]) if "&" in v.text else v
        w = u.replaced(ENCODED, _decoded) if "%" in u.text else u
        out += [x for x in dict.fromkeys((u, w)) if x is not v]
    return out


def read(text: str, through: bool) -> Iterator[tuple[View, str]]:
    """The views of a text with blanks drawn together, and the same in lower case."""
    seen = set()
    for v in views(text) if through else [View.whole(text)]:
        v = v.replaced(BLANKS, lambda m: [(" ", 0, len(m[0]))])
        if v.text not in seen or v.begins != range(len(text)):
            seen.add(v.text)
            yield v, lowered(v.text)


def edges(text: str, a: int, b: int, glued: bool = False) -> bool:
    """Neither side of the place continues a word; glued: where a small letter meets a capital, a word may end."""

    def ends(at: int) -> bool:
        inside = 0 < at < len(text) and WORD.match(text, at - 1, at) and WORD.match(text, at, at + 1)
        return not inside or (glued and "a" <= text[at - 1] <= "z" and "A" <= text[at] <= "Z")

    return ends(a) and ends(b)


def words_in(text: str, glued: bool) -> Iterator[tuple[int, int]]:
    """Where words stand; glued: also the parts of those in which small letters meet capitals, and neighbouring parts together."""
    for m in WORD.finditer(text):
        cuts = [m.start(), *(k for k in range(m.start() + 1, m.end()) if glued and "a" <= text[k - 1] <= "z" and "A" <= text[k] <= "Z"), m.end()]
        yield from ((a, b) for i, a in enumerate(cuts) for b in cuts[i + 1 :])


def number_places(text: str) -> Iterator[tuple[int, int, str]]:
    """Every stretch of whole groups of digits of one run, with its digits, of DIGITS_FORM to MOST_DIGITS."""
    for m in NUMBERS.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start(), g[0]) for g in re.finditer(r"\d+", m[0])]
        for i, (a, _, _) in enumerate(groups):
            have = ""
            for _, b, g in groups[i:]:
                have += g
                if len(have) > MOST_DIGITS:
                    break
                if len(have) >= DIGITS_FORM:
                    yield a, b, have


#: Digits that a number looked for by its digits may have.
MOST_DIGITS = 64


def chosen(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Leftmost ones, of those the longest, of those the one with the smallest token; none overlaps one taken before."""
    out, at = [], 0
    for a, b, token in sorted(found, key=lambda p: (p[0], -p[1], p[2])):
        if a >= at:
            out.append((a, b, token))
            at = b
    return out


class Automaton:
    """All forms at once."""

    def __init__(self, rows: tuple):
        import ahocorasick

        self.words, self.numbers = ahocorasick.Automaton(), {}
        for form, token, cased, number in rows:
            if number:
                self.numbers[form] = token
            else:
                self.words.add_word(form, (len(form), token, frozenset(cased) if cased else None))
        self.any = len(self.words) > 0
        self.words.make_automaton() if self.any else None

    def places(self, text: str, through: bool, glued: bool = False) -> list[tuple[int, int, str]]:
        found = set()
        for v, low in read(text, through):
            if self.any:
                for end, (n, token, cased) in self.words.iter(low):
                    a, b = end - n + 1, end + 1
                    if edges(v.text, a, b, glued) and (cased is None or v.text[a:b] in cased):
                        found.add((v.begins[a], v.ends[b - 1], token))
            if self.numbers:
                found |= {(v.begins[a], v.ends[b - 1], self.numbers[d]) for a, b, d in number_places(v.text) if d in self.numbers}
        return chosen(list(found))


AUTOMATA: dict[str, Automaton] = {}


def automaton(name: str, rows) -> Automaton:
    """One a worker process and table of forms; the last two are held."""
    if name not in AUTOMATA:
        while len(AUTOMATA) > 1:
            AUTOMATA.pop(next(iter(AUTOMATA)))
        AUTOMATA[name] = Automaton(rows.value)
    return AUTOMATA[name]


def rows_of(batch: pa.RecordBatch, n_keys: int, fields: list[str], found: list[tuple]) -> pa.RecordBatch:
    """found: (row, ...) for the keys of that row and further columns."""
    columns = list(zip(*found, strict=True)) if found else [()] * (len(fields) - n_keys + 1)
    taken = pa.array(columns[0], pa.int64())
    return pa.RecordBatch.from_arrays([*(batch.column(k).take(taken) for k in range(n_keys)), *(pa.array(c, t) for c, t in zip(columns[1:], PLACE_TYPES[len(columns) - 1], strict=True))], fields)


PLACE_TYPES = {3: (pa.int32(), pa.int32(), pa.string()), 6: (pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))}


def scanned(df: DataFrame, keys: list[str], fn, more: str) -> DataFrame:
    """A row for each tuple that fn(text) yields, by batches of 256 texts."""
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    fields = [*keys, *(x.split()[0] for x in more.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                found = [(i, *place) for i, t in enumerate(part.column(len(keys)).to_pylist()) if t for place in fn(t)]
                yield rows_of(part, len(keys), fields, found)

    return df.select(*keys, "text").mapInArrow(run, f"{kinds}, {more}")


def anchor(form: str) -> tuple[str, int]:
    """The longest word of a form, the first of these, and where it stands; a form without words stands for itself."""
    m = max(WORD.finditer(form), key=lambda m: (len(m[0]), -m.start()), default=None)
    return (m[0], m.start()) if m else (form, 0)


def _hashes(word: str) -> Iterator[int]:
    a, b = struct.unpack("<QQ", xxhash.xxh3_128_digest(word))
    return ((a + k * b) & 0xFFFFFFFFFFFFFFFF for k in range(FILTER_HASHES))


def joined(spans: DataFrame, table: DataFrame, keys: list[str], through: bool, glued: bool = False) -> DataFrame:
    """Places of forms that are too many to send around; all of them, overlapping ones as well."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            form, number = b.column(0).to_pylist(), b.column(3).to_pylist()
            at = [(f, 0) if n else anchor(f) for f, n in zip(form, number, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([a for a, _ in at]), pa.array([k for _, k in at], pa.int32())], [*b.schema.names, "anchor", "lead"])

    known = kept(table.select("form", "token", "cased", "number").mapInArrow(anchored, f"{NEEDLE}, anchor string, lead int"), "anchors")
    sizes = known.agg(F.count("*"), F.coalesce(F.max("lead"), F.lit(0)), F.coalesce(F.max(F.char_length("form") - F.col("lead")), F.lit(0))).first()
    bits, ahead, behind = max(1 << 16, FILTER_BITS * sizes[0]), sizes[1], sizes[2]

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = sorted({h % bits for w in b.column(0).to_pylist() for h in _hashes(w)})
            yield pa.RecordBatch.from_arrays([pa.array([x >> 19 for x in at], pa.int64()), pa.array([x & 0x7FFFF for x in at], pa.int32())], ["block", "bit"])

    # the filter is put together by blocks of bits in many tasks; ten bits a form, so a hundredth of what the forms take
    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytearray] = {}
        for b in batches:
            for no, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(no, bytearray(1 << 16))[x >> 3] |= 1 << (x & 7)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([bytes(x) for x in held.values()], pa.binary())], ["block", "bits"])

    blocks = known.select("anchor").distinct().mapInArrow(marked, "block long, bit int").repartition("block").mapInArrow(block, "block long, bits binary")
    filled = spans.sparkSession.sparkContext.broadcast({r.block: bytes(r.bits) for r in blocks.collect()}) if bits <= FILTER_MOST else None

    def passes(word: str) -> bool:
        if filled is None:
            return True
        held = filled.value
        for h in _hashes(word):
            x = h % bits
            row = held.get(x >> 19)
            if row is None or not row[(x & 0x7FFFF) >> 3] >> (x & 7) & 1:
                return False
        return True

    def candidates(text: str) -> Iterator[tuple]:
        """(anchor, number, place of the anchor in the piece, the piece's length, the piece, where its characters begin, and end)."""
        for v, low in read(text, through):
            for a, b, d in number_places(v.text):
                if passes(d):
                    yield d, True, 0, 0, "", [v.begins[a], v.ends[b - 1]]
            for a, b in words_in(v.text, glued):
                w = low[a:b]
                if passes(w):
                    low_end, high = max(0, a - ahead - 1), min(len(low), a + behind + 1)
                    ends = [*v.begins[low_end:high], *v.ends[low_end:high]]
                    yield w, False, a - low_end, high - low_end, v.text[low_end:high], ends

    near = scanned(spans, keys, candidates, "anchor string, number boolean, at int, n int, piece string, ends array<int>")
    own = known.withColumnsRenamed({"anchor": "of_anchor", "number": "of_number"})
    both = near.join(own, (F.col("anchor") == F.col("of_anchor")) & (F.col("number") == F.col("of_number")))
    kinds = ", ".join(f"`{k}` {spans.schema[k].dataType.simpleString()}" for k in keys)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*keys, "start", "end", "token"]
        for b in batches:
            found = []
            columns = [b.column(len(keys) + k).to_pylist() for k in range(8)]
            for i, (number, at, n, piece, ends, form, token, rest) in enumerate(zip(*columns, strict=True)):
                if number:
                    found.append((i, ends[0], ends[1], token))
                    continue
                cased, lead = rest["cased"], rest["lead"]
                a, e = at - lead, at - lead + len(form)
                low = lowered(piece)
                if a >= 0 and low[a:e] == form and edges(piece, a, e, glued) and (cased is None or piece[a:e] in cased):
                    found.append((i, ends[a], ends[n + e - 1], token))
            yield rows_of(b, len(keys), names, found)

    rows = both.select(*keys, "number", "at", "n", "piece", "ends", "form", "token", F.struct("cased", "lead").alias("rest"))
    return rows.mapInArrow(compared, f"{kinds}, start int, end int, token string").distinct()


def leftmost(places: DataFrame, keys: list[str]) -> DataFrame:
    """Of all places of a text those that `chosen` would take."""
    listed = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "token"))).alias("p"))
    kind = "array<struct<start:int,back:int,token:string>>"
    take = lambda a, x: F.when(x["start"] >= a["at"], F.struct((-x["back"]).alias("at"), F.concat(a["out"], F.array(x)).alias("out"))).otherwise(a)
    kept_ones = F.aggregate("p", F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out")), take)["out"]
    return listed.select(*keys, F.explode(kept_ones).alias("x")).select(*keys, "x.start", (-F.col("x.back")).alias("end"), "x.token")


def locate(spans: DataFrame, needles: DataFrame, keys: list[str], through: bool = True, held: int = HELD, glued: bool = False) -> DataFrame:
    """keys, start, end, token of every place of a text at which a needle can be read: the leftmost, of those the longest, none
    overlapping another. through: also without tags, unescaped and decoded, where the place is all that stands for it. glued: a place
    may also begin or end within a word, where a small letter meets a capital.

    Cases: null and empty texts have no places; no needles, no places; repeated rows repeat their places where the automaton is
    used, and share them where needles are joined (give spans keys that are unique).
    """
    table = kept(needles.select("form", "token", "cased", "number"), "needles")
    size = table.agg(F.count("*"), F.coalesce(F.sum(F.char_length("form")), F.lit(0))).first()
    if size[1] > held:
        return leftmost(joined(spans, table, keys, through, glued), keys)
    rows = spans.sparkSession.sparkContext.broadcast(tuple((r.form, r.token, tuple(r.cased) if r.cased else None, r.number) for r in table.collect()))
    name = uuid.uuid4().hex
    return scanned(spans, keys, lambda t: automaton(name, rows).places(t, through, glued), "start int, end int, token string")


def uncovered(places: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """Places that no live finding of their span overlaps."""
    own = live(findings).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("start").alias("of_start"), F.col("end").alias("of_end"))
    on = (F.col("start") < F.col("of_end")) & (F.col("end") > F.col("of_start"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"of_{k}"))
    return places.join(own, on, "left_anti")


def scrub(spans: DataFrame, needles: DataFrame, keys: list[str]) -> DataFrame:
    """spans with safe_text: every needle replaced by its token."""
    found = locate(spans, needles, keys).select(*keys, "start", "end", F.col("token").alias("replacement"), F.lit("redact").alias("decision"))
    return splice(spans, found, keys)


def gate(safe: DataFrame, findings: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start, end, token of values that can still be read in safe_text, in whatever span; empty when nothing leaks.
    findings have entity_type, value, token, decision."""
    return locate(safe.select(*keys, F.col("safe_text").alias("text")), needles(findings), keys)


def mask_reasons(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """rows (keys, text) with safe_text, where every value that was looked at (column `value`), and every word of one, from three
    letters on, shows its first and last letter only; labels and other words stay."""
    v = spaced(F.col("value"))
    words = F.array_union(F.array(v), F.split(v, r"[\s,;()]+"))
    forms = values.select(F.explode(words).alias("form")).where((F.char_length("form") >= 3) & F.col("form").rlike(r"[\p{L}\p{N}]")).select(F.lower("form").alias("form")).distinct()
    table = forms.select("form", F.lit("").alias("token"), F.lit(None).cast("array<string>").alias("cased"), F.lit(False).alias("number"))
    found = locate(rows, table, keys, through=False).join(rows.select(*keys, "text"), keys)
    piece = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return splice(rows, found.select(*keys, "start", "end", mask(piece).alias("replacement"), F.lit("redact").alias("decision")), keys)
