"""Names put right, completed by the words beside them, and looked for again until no person is new."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.text import token_case
from veilframe.operators import residue, resolve
from veilframe.operators.names import NO_LISTS, POSSESSIVE, Lists, denoised, is_given, let, mentioned, name_tokens, people, propagate, surname, trimmed, unit
from veilframe.sources.kept import kept

#: What a lone word may score at most; rules that go by the place of a name, by a listed given name, by a title; how often
#: names are looked for again at most.
LONE, BY_PLACE, BY_GIVEN, BY_TITLE, ROUNDS = 0.5, "initials_surname", "given_name", "honorific_name", 3
#: The word behind and before a name; a given name with one or two initials, and initials, in front of it.
BEHIND, BEFORE = "^[  ]([^\\s,;:()\\[\\]\"]+)", "([^\\s,;:()\\[\\]\"]+)[  ]$"
GIVEN_INITIALS, INITIALS_BEFORE = "(?U)([A-Z][^\\W\\d_]{2,})[  ](?:[A-Z0-9]\\.[  ]?){1,2}$", "(?U)(?<![^\\W_])(?:[A-Z]\\.[  ]?){1,3}$"
#: So many letters before a name are looked at; a word that is longer is none of a name.
REACH = 120


def with_text(findings: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    layer = [] if "layer" in findings.columns else [F.lit("L1").alias("layer")]
    kind = F.col("kind") if "kind" in spans.columns else F.lit("")
    return findings.select("*", *layer).join(spans.select(*keys, F.col("text").alias("of_span"), kind.alias("of_kind")), keys)


def read_again(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value", F.substr(F.col("of_span"), F.col("start") + 1, F.col("end") - F.col("start")))


def cleaned(findings: DataFrame, spans: DataFrame, keys: list[str], lists: Lists = NO_LISTS) -> DataFrame:
    """findings, those of people cut to the name in their first line; those without a name go.

    A lone word scores LONE at most, unless a title led to it, and is none in a heading or in metadata. Names by their place need
    a last word that can be a surname. What comes from structure (layer L3) or is a confirmed person (L4) stays as it is, like all
    other categories. Findings whose span is not there go; null kinds are none.
    """
    rows = with_text(findings, spans, keys)
    judged = (F.col("entity_type") == "PERSON") & ~F.col("layer").isin("L3", "L4")
    placed = judged & (F.col("recognizer") == BY_PLACE)
    free = judged & (F.col("recognizer") != BY_PLACE)
    blank = F.char_length("value") - F.char_length(F.regexp_replace("value", r"^\s+", ""))
    line = F.regexp_extract(F.regexp_replace("value", r"^\s+", ""), r"^[^\n]*", 0)
    cut = F.when(F.col("recognizer") == BY_GIVEN, trimmed(line, lists, ("title", "upper", "lower"))).otherwise(trimmed(line, lists))
    rows = rows.withColumn("lead", blank).withColumn("cut", F.when(free, cut))
    rows = rows.where(~free | F.col("cut").isNotNull()).where(~placed | surname(F.element_at(F.split("value", r"[.\s ]+"), -1), "title", lists))
    begin = F.col("start") + F.col("lead")
    rows = rows.withColumns({"start": F.when(free, begin + F.col("cut.start")).otherwise(F.col("start")).cast("int"), "end": F.when(free, begin + F.col("cut.end")).otherwise(F.col("end")).cast("int")})
    rows = read_again(rows)
    lone = free & (F.size(F.split(F.trim("value"), r"\s+")) == 1)
    rows = rows.where(~(lone & F.coalesce(F.col("of_kind"), F.lit("")).isin("heading", "metadata")))
    capped = F.when(lone & (F.col("recognizer") != BY_TITLE), F.least("score", F.lit(LONE))).otherwise(F.col("score"))
    return rows.withColumn("score", capped).drop("lead", "cut", "of_span", "of_kind")


def extended(findings: DataFrame, spans: DataFrame, keys: list[str], lists: Lists = NO_LISTS) -> DataFrame:
    """findings, those of people completed: a name of one or two words of one letter case goes on over one word behind it that can be its
    surname, and over a listed given name before it; then over initials before it and the given name in front of these, which may be
    run together with the word before. Findings whose span is not there go.
    """
    rows = with_text(findings, spans, keys)
    person = F.col("entity_type") == "PERSON"
    cases = let(name_tokens(F.col("value")), lambda t: F.when(F.size(t).between(1, 2), F.array_distinct(F.filter(F.transform(t, token_case), lambda c: c.isNotNull() & (c != "initial")))))
    case = let(cases, lambda c: F.when((F.size(c) == 1) & F.get(c, F.lit(0)).isin("title", "upper"), F.get(c, F.lit(0))))

    def fits(word: Column) -> Column:
        own = F.when(F.col("case") == "title", surname(word, "title", lists)).when(F.col("case") == "upper", surname(word, "upper", lists))
        return F.coalesce((word != "") & own, F.lit(False))

    def lead(start: Column) -> Column:
        return F.substr(F.col("of_span"), F.greatest(start - REACH + 1, F.lit(1)), F.least(start, F.lit(REACH)))

    shown = lambda word: F.regexp_replace(F.regexp_replace(word, "[.,;:!?]+$", ""), POSSESSIVE, "")
    rows = rows.withColumn("case", F.when(person, case))
    rows = rows.withColumn("behind", F.regexp_extract(F.substr(F.col("of_span"), F.col("end") + 1, F.lit(REACH)), BEHIND, 1)).withColumn("before", F.regexp_extract(lead(F.col("start")), BEFORE, 1))
    rows = rows.withColumn("end", F.when(fits(F.col("behind")), F.col("end") + 1 + F.char_length(shown(F.col("behind")))).otherwise(F.col("end")).cast("int"))
    rows = rows.withColumn("start", F.when(fits(F.col("before")) & is_given(denoised(F.col("before")), lists), F.col("start") - 1 - F.char_length("before")).otherwise(F.col("start")).cast("int"))
    rows = read_again(rows)
    # initials, and a given name before them
    whole = F.regexp_extract(lead(F.col("start")), GIVEN_INITIALS, 0)
    glued = F.regexp_extract("whole", "^[A-Za-z]*[a-z](?=[A-Z][^\\W\\d_]{2,}[  ])", 0)
    open_ = person & F.coalesce(token_case(F.get(F.split("value", r"\s+"), F.lit(0))) != "initial", F.lit(True))
    rows = rows.withColumns({"whole": whole, "initials": F.regexp_extract(lead(F.col("start")), INITIALS_BEFORE, 0), "open": open_})
    rows = rows.withColumn("whole", F.substr(F.col("whole"), F.char_length(glued) + 1))
    given = F.regexp_extract("whole", "^[^  ]+", 0)
    named = (F.col("whole") != "") & ~unit(given, lists).rlike("[aonhk]$")
    back = F.when(~F.col("open"), 0).when(named, F.char_length("whole")).otherwise(F.char_length("initials"))
    rows = read_again(rows.withColumn("start", (F.col("start") - back).cast("int")))
    return rows.drop("case", "behind", "before", "whole", "initials", "open", "of_span", "of_kind")


def everywhere(spans: DataFrame, keys: list[str], findings: DataFrame, lists: Lists = NO_LISTS, rounds: int = ROUNDS, held: int = residue.HELD, delta: bool = True) -> tuple[DataFrame, DataFrame]:
    """(what stands of findings and of confirmed people named again, the index of people).

    A name that is completed where it is found again is a new person to look for, so the search is repeated until the index stays as it
    is, `rounds` times at most. From the second time on, only spans that name a person who is new, has changed or has gone are
    searched and resolved again (by the whole index, so that the longest name wins there as well); all others are taken over. With
    delta False every span is done each time, which gives the same rows. Tables between rounds are written to the shared folder.

    keys tell spans apart. Cases: null texts name nobody; no people, no further findings; people who share a single name keep it
    as ambiguous.
    """
    raw = kept(extended(cleaned(findings, spans, keys, lists), spans, keys, lists).withColumn("canonical", F.lit(None).cast("string")), "raw")
    standing = kept(resolve.rewritten(resolve.resolve(raw, keys), spans, keys), "standing")
    index = None
    for _ in range(rounds):
        fresh = kept(people(standing, lists), "index")
        changed = fresh if index is None else fresh.exceptAll(index).unionByName(index.exceptAll(fresh))
        if changed.isEmpty():
            break
        first, index = index is None, fresh
        if first or not delta:
            part, own, rest = spans, raw, None
        else:
            forms = changed.dropDuplicates(["variant", "written"])
            touched = kept(mentioned(spans, keys, forms, held).select(*keys).distinct(), "touched")
            part, own, rest = spans.join(touched, keys, "left_semi"), raw.join(touched, keys, "left_semi"), standing.join(touched, keys, "left_anti")
        again = propagate(part, keys, index, lists, held).withColumn("layer", F.lit("L4"))
        both = own.unionByName(extended(again, part, keys, lists), allowMissingColumns=True)
        done = resolve.rewritten(resolve.resolve(both, keys), part, keys)
        standing = kept(reduce(DataFrame.unionByName, [x for x in (rest, done) if x is not None]), "standing")
    return standing, fresh if index is None else index
