"""Rules: a pattern, a score, a check of the value, words that must or may stand near. Rules are data. All of them scan a
text in one pass: a projection collects the matches of every rule whose cheap test the text passes, exploded once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import checks, secrets
from veilframe.operators import catalogue
from veilframe.operators.vocab import AFTER, BEFORE, CONTEXT_BOOST, CONTEXT_WORDS, NO_CONTEXT_CAP, REDACT, REVIEW

#: The year that ages are counted from; a parameter of the scan.
YEAR = 2026
CHECKS: dict[str, Callable[[Column], Column]] = {
    "mailbox": checks.mailbox_delta, "phone": checks.phone_delta, "ssn": checks.ssn_delta, "pan": checks.pan_delta, "pesel": checks.pesel_delta, "card": checks.card_delta,
    "aadhaar": checks.aadhaar_delta, "gstin": checks.gstin_delta, "ip": checks.ip_delta, "iban": checks.iban_delta, "secret": secrets.secret_delta, "entropy": secrets.entropy_delta,
    "date": lambda x: checks.date_delta(x, YEAR),
}
ACCEPTS: dict[str, Callable[[Column, Column], Column]] = {"named": lambda key, value: secrets.named_secret(key), "mixed": lambda key, value: secrets.mixed(value)}


@dataclass(frozen=True)
class Rule:
    """check and accept are Column functions, of the value and of (key, value); any caller may bring its own."""

    name: str
    entity: str
    pattern: str
    score: float
    check: Callable[[Column], Column] | None = None
    group: int = 0
    needs_context: bool = False
    least_digits: int = 0
    lead: int = 0
    key: int = 0
    accept: Callable[[Column, Column], Column] | None = None
    unless: str | None = None
    context: tuple[str, ...] = ()


def from_catalogue(rows: list[tuple]) -> list[Rule]:
    out = []
    for name, entity, score, pattern, more in rows:
        words = () if more.get("plain") or name in WITHOUT_CONTEXT else tuple(CONTEXT_WORDS.get(entity, ()))
        own = {k: v for k, v in more.items() if k in ("group", "lead", "key", "unless", "needs_context", "least_digits")}
        out.append(Rule(name, entity, pattern, score, check=CHECKS.get(more.get("check")), accept=ACCEPTS.get(more.get("accept")), context=words, **own))
    return out


#: Rules that take no notice of words nearby, though their category has some.
WITHOUT_CONTEXT = {"email", "email_ocr_damaged", "card_last4", "ssn_last4", "secret_url_password", "secret_known", "secret_assigned", "secret_known_more", "secret_in_code", "secret_env", "secret_auth_header", "secret_bearer", "org_person_id_ocr"}
RULES = from_catalogue(catalogue.BODY)
IMAGE_RULES = from_catalogue(catalogue.IMAGE)


def near(text: Column, start: Column, end: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Does one of words stand shortly before or after?"""
    if not words:
        return F.lit(False)
    forms = [*words, *(w.replace(" ", "") for w in words if " " in w)]
    # JVM and SQL positions count from 1
    lead = F.least(F.lit(BEFORE), start)
    around = F.lower(F.concat_ws(" ", F.substr(text, start - lead + 1, lead), F.substr(text, end + 1, F.lit(AFTER))))
    return around.rlike("(?<![a-z])(?:" + "|".join(re.escape(w) for w in forms) + ")(?![a-z])")


#: Columns beside the text that the tests below share, so that each is worked out once.
LOW, DIGITS = "_text_low", "_text_digits"
HIT = "array<struct<rule:int,start:int,end:int,text:string,key:string>>"
#: What a text must hold for a rule to match at all; tested before the pattern is. Rules not named have no such test.
#: Any one of these, as it is written.
NEEDS = {
    "email": ["@"], "email_ocr_damaged": ["@"], "in_upi": ["@"], "secret_url_password": ["://"], "ipv6": [":"], "ipv4": ["."], "secret_in_code": ["=", ":"], "secret_env": ["="],
    "org_person_id": ["EMP-", "DIR-", "STF-", "CON-", "USR-"], "org_vendor_id": ["MER-", "VEN-", "SUP-"], "us_ein": ["-"], "pl_nip": ["-"], "in_gstin": ["Z"], "dob_iso": ["-"],
    "honorific_name": ["Mr", "Ms", "Miss", "Mx", "Dr", "Prof", "Shri", "Smt"], "dob_text": ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"],
    "secret_known": ["AKIA", "ASIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "xox", "sk-", "sk_", "rk-", "rk_", "AIza", "eyJ", "PRIVATE KEY-----"],
    "secret_known_more": ["glpat-", "npm_", "pypi-", "SG.", "hf_", "shp", "dop_v1_", "ya29.", "hooks.slack.com", ":AA", "AccountKey=", "PRIVATE KEY"],
    "secret_bearer": ["earer"], "secret_high_entropy": ['"', "'", "`"], "pem_body": ["\n"], "blood_group": ["+", "-", "positive", "negative"],
}
#: Any one of these, in lower case, for patterns that take no notice of case.
NEEDS_LOW = {
    "card_last4": ["ending", "ends", "last", "xxxx", "****", "••••"], "ssn_last4": ["last"], "driving_licence_labelled": ["driving licen", "driver", "dl"],
    "secret_assigned": ["key", "secret", "token", "bearer", "passw", "pwd"], "secret_auth_header": ["authorization", "x-auth-token", "api-key"],
    "health_statement": ["diagnosed with", "suffers from", "undergoing treatment for", "medical condition"], "in_address": ["flat", "plot", "house", "no", "block", "sector", "shop"],
}
#: How many digits at least.
DIGIT_RULES = {
    "phone": 7, "org_person_id": 1, "org_vendor_id": 1, "us_ssn": 9, "passport": 6, "in_pan": 4, "pl_pesel": 6, "us_ein": 9, "pl_nip": 10, "credit_card": 13, "card_last4": 4, "ssn_last4": 4,
    "in_aadhaar": 12, "in_gstin": 6, "in_ifsc": 1, "bank_account": 9, "uk_nino": 6, "in_voter_id": 7, "in_driving_licence": 13, "driving_licence_labelled": 4, "in_address": 6, "iban": 2,
    "dob_numeric": 4, "dob_iso": 8, "dob_text": 5, "street_address": 1, "ipv4": 4, "phone_ocr_confusable": 1, "phone_ocr_glued": 1,
}


def gate(text: Column, rule: Rule, low: Column | None = None, digits: Column | None = None) -> Column:
    """Whether a rule may match: what is cheap to test first. low, digits: the text in lower case, and how many digits it has."""
    tests = []
    if rule.name in DIGIT_RULES:
        tests.append((F.regexp_count(text, F.lit("[0-9]")) if digits is None else digits) >= DIGIT_RULES[rule.name])
    for of, needs in ((text, NEEDS), (F.lower(text) if low is None else low, NEEDS_LOW)):
        if rule.name in needs:
            tests.append(reduce(Column.__or__, (F.contains(of, F.lit(x)) for x in needs[rule.name])))
    out = text.rlike(rule.pattern)
    for t in reversed(tests):
        out = t & out
    return out


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def hits_sql(number: int, rule: Rule) -> str:
    """functions.text.matches of the column text, with the rule's number and key, as SQL: dozens of rules are parsed faster
    than their expressions are put together call by call."""
    p = literal(rule.pattern)
    every = f"regexp_extract_all(text, {p}, 0)"
    of = lambda group, none: f"regexp_extract_all(text, {p}, {group})" if group else none
    blank = f"transform({every}, x -> '')"
    between = f"transform(split(text, {p}, -1), x -> char_length(x))"
    begin = "a.at + r.`3` + char_length(r.`2`)"
    one = f"named_struct('rule', {number}, 'start', cast({begin} as int), 'end', cast({begin} + char_length(r.`1`) as int), 'text', r.`1`, 'key', r.`4`)"
    zipped = f"arrays_zip({every}, {of(rule.group, every)}, {of(rule.lead, blank)}, slice({between}, 1, size({every})), {of(rule.key, blank)})"
    start = f"named_struct('at', 0, 'out', cast(array() as {HIT}))"
    return f"aggregate({zipped}, {start}, (a, r) -> named_struct('at', cast(a.at + r.`3` + char_length(r.`0`) as int), 'out', concat(a.out, array({one}))), a -> a.out)"


def rule_hits(number: int, rule: Rule, blocker: tuple[int, Rule] | None = None) -> Column:
    """The matches of one rule in the column text (beside LOW and DIGITS) as array<struct<rule, start, end, text, key>>; without those that a match
    of the blocker overlaps."""
    rows = F.expr(hits_sql(number, rule))
    if rule.accept:
        rows = F.filter(rows, lambda h: rule.accept(h["key"], h["text"]))
    if blocker:
        others = rule_hits(*blocker)
        rows = F.filter(rows, lambda h: ~F.exists(others, lambda b: (b["start"] < h["end"]) & (b["end"] > h["start"])))
    return F.when(gate(F.col("text"), rule, F.col(LOW), F.col(DIGITS)), rows).otherwise(F.expr(f"cast(array() as {HIT})"))


def scan(spans: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Findings of all rules over spans (text and any keys): spans' columns (without text), start, end, value, entity_type,
    recognizer, score.

    Cases: null texts have no findings; a value of blanks alone is none; repeated spans repeat their findings.
    """
    rules = RULES if rules is None else rules
    keep = [c for c in spans.columns if c != "text"]
    text = F.col("text")
    number = {r.name: i for i, r in enumerate(rules)}
    blockers = {i: (number[r.unless], rules[number[r.unless]]) for i, r in enumerate(rules) if r.unless in number}
    # an outer explode: of a plain one the optimizer would infer a filter, and run every pattern twice
    told = spans.where(text.isNotNull()).select(*keep, "text", F.lower(text).alias(LOW), F.regexp_count(text, F.lit("[0-9]")).alias(DIGITS))
    hit = told.select(*keep, "text", F.explode_outer(F.concat(*[rule_hits(i, r, blockers.get(i)) for i, r in enumerate(rules)])).alias("h")).where("h is not null")
    hit = hit.select(*keep, "text", F.col("h.rule").alias("rule"), F.col("h.start").alias("start"), F.col("h.end").alias("end"), F.col("h.text").alias("value")).where(F.trim("value") != "")

    def by_rule(of: Callable[[Rule], Column | None], default) -> Column:
        """of(rule) by the rule's number; rules with the same function share a branch."""
        out = F.when(F.lit(False), default)
        branches: dict[object, tuple[list[int], Column]] = {}
        for i, r in enumerate(rules):
            key, value = of(r)
            if value is not None:
                branches.setdefault(key, ([], value))[0].append(i)
        for numbers, value in branches.values():
            out = out.when(F.col("rule").isin(numbers), value)
        return out.otherwise(default)

    digits = F.length(checks.digits(F.col("value")))
    hit = hit.where(digits >= by_rule(lambda r: (r.least_digits, F.lit(r.least_digits) if r.least_digits else None), F.lit(0)))
    score = by_rule(lambda r: (r.score, F.lit(float(r.score))), F.lit(0.0)) + by_rule(lambda r: (r.check, r.check(F.col("value")).cast("double") if r.check else None), F.lit(0.0))
    known = by_rule(lambda r: (r.context, near(F.col("text"), F.col("start"), F.col("end"), r.context) if r.context else None), F.lit(False))
    lone = F.when(F.col("rule").isin([i for i, r in enumerate(rules) if r.needs_context]), F.least(F.col("score"), F.lit(NO_CONTEXT_CAP))).otherwise(F.col("score"))
    hit = hit.withColumns({"score": score, "known": known}).withColumn("score", F.when(F.col("known"), F.col("score") + CONTEXT_BOOST).otherwise(lone))
    of_rule = lambda f: F.get(F.array(*[F.lit(f(r)) for r in rules]), F.col("rule"))
    return hit.select(*keep, "start", "end", "value", of_rule(lambda r: r.entity).alias("entity_type"), of_rule(lambda r: r.name).alias("recognizer"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "score")), 3).alias("score"))


def route(score: Column) -> Column:
    return F.when(score >= REDACT, "redact").when(score >= REVIEW, "review").otherwise("drop")
