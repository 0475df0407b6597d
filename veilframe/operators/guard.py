"""The prompt guard: code, classification markings, registered text and values in prompts; what is blocked, warned of,
replaced or let through."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import normalise
from veilframe.operators import protected, redact, resolve, rules

#: Points and patterns of a line of code (without blanks around it); patterns of languages.
CODE_SIGNS = [
    (2, r"^(?:async\s+)?def\s+\w+\s*\(|^class\s+\w+.*:\s*$"),
    (2, r"^(?:from\s+[\w.]+\s+)?import\s+[\w.*{]"),
    (2, r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\b|^(?:export\s+)?(?:const|let|var)\s+[\w${\[]"),
    (2, r"^(?:public|private|protected|static|final|abstract|override|virtual)\s+[\w<>\[\], ]+[({;=]"),
    (2, r"^#\s*(?:include|define|ifdef|ifndef|endif|pragma)\b|^#!"),
    (2, r"^(?:package|namespace|using)\s+[\w.]+\s*[;{]?$|^func\s+[\w(]"),
    (2, r"^(?:if|for|while|switch|catch|foreach|else\s+if)\s*\(.*\)\s*\{?$|^\}?\s*else\s*\{$|^try\s*\{$"),
    (2, r"^(?:if|elif|for|while|with|except)\b.+:\s*(?:#.*)?$|^(?:else|try|finally)\s*:\s*$"),
    (2, r"(?i)^(?:select\b.+\bfrom\b|insert\s+into\b|update\s+\w+\s+set\b|delete\s+from\b|create\s+(?:table|index|view)\b|alter\s+table\b)"),
    (2, r"^SELECT\b|^select\s+(?:\*|distinct\b|[\w.]+\s*,)"),
    (1, r"(?i)^(?:from|where|(?:inner|left|right|outer|cross)\s+join|join|group\s+by|order\s+by|having|values|limit)\b"),
    (2, r"^(?:export\s+)?[A-Z][A-Z0-9_]{2,}=\S*$|^\$\s+[a-z][\w.-]*(?:\s|$)"),
    (2, r"[;{]\s*(?://.*)?$|^[}\])]+[;,)]*\s*$"),
    (2, r"\b[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)+\([^)]*\)?|=>\s*[{(\w]|->\s*\w+\s*[:{]|::\w+\("),
    (2, r"^@\w[\w.]*(?:\(.*\))?$|^</?[a-zA-Z][\w-]*(?:\s[^>]*)?/?>"),
    (2, r"^\"[\w$.-]+\"\s*:\s*(?:[\"\[{\d-]|true|false|null)"),
    (1, r"^(?:return|raise|throw|yield|await|break|continue|pass|print|echo|export|sudo|pip|npm|git|docker|kubectl|curl|cd)\b"),
    (1, r"^[A-Za-z_][\w.\[\]\"']*\s*(?:[+\-*/|&]?=|:=)\s*\S"),
    (1, r"^(?://|/\*|\*/|\*\s|#\s|--\s|<!--)"),
    (1, r"\b\w+\([^)]*\)"),
    (1, r"^[\w-]+:\s*(?:\S.*)?$|^-\s+[\w-]+:\s"),
    (1, r"^\$\s+\w+"),
]
LANGUAGES = {
    "Python": r"^\s*(?:def |class \w+.*:|from [\w.]+ import |import \w+$|elif |except\b|print\(|for \w+ in .+:$|(?:if|while) .+:$)|\bself\.|\bNone\b|__\w+__|\.append\(",
    "JavaScript / TypeScript": r"\b(?:const|let|var)\s+\w+\s*=|=>|\bfunction\b|console\.log|\brequire\(|\bexport\s+(?:default|const)|: (?:string|number|boolean)\b",
    "Java / C#": r"\b(?:public|private|protected)\s+(?:static\s+)?[\w<>\[\]]+\s+\w+\s*\(|System\.out|Console\.Write|\bnew\s+\w+\(|^\s*using\s+System",
    "C / C++": r"^\s*#\s*include|\bint\s+main\s*\(|std::|\bprintf\(|\w+\s*->\s*\w+",
    "SQL": r"(?i)^\s*(?:select|from|where|insert\s+into|update\s+\w+\s+set|create\s+table|(?:inner|left|right)\s+join|order\s+by|group\s+by)\b",
    "Shell": r"^#!.*sh\b|^\s*(?:\$\s+)?(?:sudo|export|echo|curl|chmod|grep|cd|pip|npm|git|docker|kubectl)\s",
    "Go": r"^\s*func\s+[\w(]|^\s*package\s+\w+$|:=|\bfmt\.\w+\(",
    "Configuration": r"^\s*\"[\w$.-]+\"\s*:|^\s*[\w-]+:\s|^\s*[A-Z][A-Z0-9_]+=",
}
FENCE = r"^\s*(?:```|~~~)"
#: Points that make a line code, lines that make a block, share of lines that make few code lines count.
CODE_POINTS, CODE_LINES, FEW_LINES, CODE_SHARE = 2, 3, 2, 0.6
MARKINGS = ["strictly confidential", "highly confidential", "company confidential", "privileged and confidential", "confidential", "internal use only", "for internal use", "internal only", "do not distribute", "not for distribution", "do not share", "trade secret", "top secret", "proprietary", "restricted"]
LABEL_BEFORE = r"(?i)\b(?:classification|marking|sensitivity|security\s+level|data\s+class(?:ification)?|handling)\s*[:=-]\s*$"
SHORT_LINE = 8


def line_points(line: Column) -> Column:
    total = F.lit(0)
    for points, pattern in CODE_SIGNS:
        total = total + F.when(F.trim(line).rlike(pattern), points).otherwise(0)
    return F.when(F.trim(line) == "", 0).otherwise(total)


def as_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line (from 1), text: all lines, blank ones too."""
    return texts.select(*keys, F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def code_lines(texts: DataFrame, keys: list[str]) -> DataFrame:
    """Every line with code (0/1), blank, fence: lines with points enough, lines between fences, and weak or indented ones
    in an unbroken run with such a line."""
    strip = F.regexp_replace("text", r"^\s+|\s+$", "")
    lines = as_lines(texts, keys).withColumns({"points": line_points(strip), "blank": strip == "", "fence": F.col("text").rlike(FENCE)})
    order = Window.partitionBy(*keys).orderBy("line")
    fences = F.sum(F.col("fence").cast("int")).over(order)
    strong = (F.col("points") >= CODE_POINTS) | (~F.col("fence") & ~F.col("blank") & (fences % 2 == 1))
    lines = lines.withColumn("strong", strong)
    weak = ~F.col("blank") & ((F.col("points") >= 1) | F.col("text").rlike(r"^[ \t]"))
    lines = lines.withColumn("part", F.col("strong") | weak)
    run = F.col("line") - F.sum(F.col("part").cast("int")).over(order)
    lines = lines.withColumn("run", run)
    held = F.max(F.col("strong").cast("int")).over(Window.partitionBy(*keys, "run", "part"))
    return lines.withColumn("code", (F.col("part") & (held == 1)).cast("int")).select(*keys, "line", "text", "code", "blank", "fence")


def code(texts: DataFrame, keys: list[str]) -> DataFrame:
    """A row a text (keys, text): detected, lines (not blank), code_lines, share, blocks (array of first and last line),
    languages (two at most, those with half the votes of the first).

    Cases: texts without code have zero, no blocks and no languages; null texts are left out; a text is one window, its
    lines are never gathered with those of another.
    """
    lines = code_lines(texts.where("text is not null"), keys)
    order = Window.partitionBy(*keys).orderBy("line")
    marked = lines.withColumn("blank_before", F.lag("blank").over(order))
    only = marked.where("code = 1").withColumn("gap", F.col("line") - F.lag("line").over(order))
    opened = F.col("gap").isNull() | (F.col("gap") > 2) | ((F.col("gap") == 2) & ~F.col("blank_before"))
    only = only.withColumn("block", F.sum(opened.cast("int")).over(order))
    votes = {f"v{i}": F.sum(F.col("text").rlike(rx).cast("int")) for i, rx in enumerate(LANGUAGES.values())}
    blocks = only.groupBy(*keys, "block").agg(F.min("line").alias("first"), F.max("line").alias("last"), F.count("*").alias("n"), *[c.alias(k) for k, c in votes.items()])
    per = blocks.groupBy(*keys).agg(F.array_sort(F.collect_list(F.array("first", "last"))).alias("blocks"), F.max("n").alias("longest"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in votes])
    sizes = lines.groupBy(*keys).agg(F.sum((~F.col("blank")).cast("long")).alias("lines"), F.max(F.col("fence").cast("int")).alias("fenced"))
    both = sizes.join(per, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    ranked = F.array_sort(F.filter(F.array(*[F.struct(F.negative(k).alias("votes"), F.lit(name).alias("name")) for k, name in zip(votes, LANGUAGES, strict=True)]), lambda x: x["votes"] < 0))
    top = F.get(ranked, F.lit(0))["votes"]
    chosen = F.slice(F.transform(F.filter(ranked, lambda x: x["votes"] <= F.least(F.lit(-2.0), top * 0.5)), lambda x: x["name"]), 1, 2)
    languages = F.when(F.size(ranked) == 0, F.array().cast("array<string>")).when(F.size(chosen) > 0, chosen).otherwise(F.array(F.get(ranked, F.lit(0))["name"]))
    found = ((F.col("fenced") == 1) & (F.col("n") > 0)) | (F.coalesce("longest", F.lit(0)) >= CODE_LINES) | ((F.col("n") >= FEW_LINES) & (F.col("n") >= CODE_SHARE * F.col("lines")))
    none = lambda c, kind: F.when(F.col("detected"), c).otherwise(F.array().cast(kind))
    return both.withColumn("detected", found).select(
        *keys, "detected", "lines", F.when(F.col("detected"), F.col("n")).otherwise(0).alias("code_lines"), F.when(F.col("detected"), F.round(F.col("n") / F.col("lines"), 3)).otherwise(0.0).alias("share"),
        none(F.col("blocks"), "array<array<int>>").alias("blocks"), none(languages, "array<string>").alias("languages"),
    )


def markings(lines: DataFrame, phrases: list[str] | None = None) -> DataFrame:
    """Lines (column text) with a classification marking: marking (as written) and why. The first that counts in a line.

    Several words count anywhere; a single word only behind a label, in brackets, or on a short line of its own.
    """
    phrases = MARKINGS if phrases is None else phrases
    if not phrases:
        return lines.withColumns({"marking": F.lit(""), "why": F.lit("")}).limit(0)
    forms = [r"[\s_-]+".join(re.escape(w) for w in re.split(r"[\s_-]+", p.strip())) for p in sorted(phrases, key=len, reverse=True)]
    pattern = rf"(?i)(?<!\w)(?:{'|'.join(forms)})(?!\w)"
    from veilframe.functions.text import matches

    found = F.when(F.col("text").rlike(pattern), matches(F.col("text"), pattern))
    text, words = F.col("text"), F.size(F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != ""))

    def why(m: Column) -> Column:
        before, after = F.substr(text, F.lit(1), m["start"]), F.substr(text, m["end"] + 1, F.char_length(text))
        alone = (words <= SHORT_LINE) & ((m["text"] == F.upper(m["text"])) | (words <= 3))
        return (
            F.when(m["text"].rlike(r"[\s_-]"), "a classification phrase")
            .when(before.rlike(LABEL_BEFORE), "follows a classification label")
            .when(before.rlike(r"[\[(*<|]\s*$") & after.rlike(r"^\s*[\])*>|]"), "set apart in brackets")
            .when(alone, "a marking on a line of its own")
        )

    told = F.filter(F.transform(found, lambda m: F.struct(m["text"].alias("text"), why(m).alias("why"))), lambda m: m["why"].isNotNull())
    out = lines.withColumn("told", told).where(F.size("told") > 0)
    return out.withColumns({"marking": F.col("told")[0]["text"], "why": F.col("told")[0]["why"]}).drop("told")


@dataclass(frozen=True)
class Policy:
    """block, warn or allow; max_bytes 0 is no limit."""

    source_code: str = "block"
    markings: str = "block"
    protected: str = "block"
    block_categories: tuple[str, ...] = ()
    max_bytes: int = 0
    phrases: tuple[str, ...] = field(default_factory=lambda: tuple(MARKINGS))


def verdict(blocked: Column, changed: Column) -> Column:
    return F.when(blocked, "blocked").when(changed, "redacted").otherwise("clean")


def check(prompts: DataFrame, keys: list[str], policy: Policy | None = None, *, prints: DataFrame | None = None, item_id: str = "item_id", extra: DataFrame | None = None) -> DataFrame:
    """A row a prompt (keys, text): bytes, verdict, blocked_by, warned, code_lines, languages, marks, protected_words,
    n_values, findings, safe_text (empty if blocked).

    Every prompt is judged on all rules; prompts over policy.max_bytes are refused unread. prints are registered passages,
    extra further findings (terms, known people) with the columns of a scan.

    Cases: null texts are empty and clean; equal keys are one prompt's lines and should be unique.
    """
    policy = policy or Policy()
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    turns = prompts.select(*keys, text.alias("text")).withColumn("bytes", F.octet_length("text"))
    large = (F.col("bytes") > policy.max_bytes) if policy.max_bytes else F.lit(False)
    turns = turns.withColumn("too_large", large)
    read = turns.where(~F.col("too_large")).select(*keys, "text")
    coded = code(read, keys).select(*keys, "detected", "code_lines", "languages")
    marks = markings(as_lines(read, keys), list(policy.phrases)).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "marking", "why"))).alias("marks"))
    found = rules.scan(read)
    if extra is not None:
        found = found.unionByName(extra)
    won = resolve.rewritten(resolve.resolve(found, keys), read, keys)
    values = redact.live(won).withColumn("norm_value", normalise(F.col("entity_type"), F.col("value")))
    # numbered within the prompt by first appearance, in windows, so that the scan is not run again for a join
    values = values.withColumn("first_at", F.min("start").over(Window.partitionBy(*keys, "entity_type", "norm_value")))
    number = F.dense_rank().over(Window.partitionBy(*keys, "entity_type").orderBy("first_at", "norm_value")).cast("string")
    token = F.concat(F.lit("["), resolve.lookup(redact.SHORT_NAMES, F.col("entity_type"), "VALUE"), F.lit("_U"), F.when(F.char_length(number) < 3, F.lpad(number, 3, "0")).otherwise(number), F.lit("]"))
    own = values.withColumn("replacement", token).persist(StorageLevel.DISK_ONLY)
    safe = redact.splice(read, own, keys).select(*keys, "safe_text")
    counts = own.groupBy(*keys).agg(F.countDistinct("entity_type", "norm_value").alias("n_values"), F.count("*").alias("findings"), F.collect_set("entity_type").alias("categories"))
    out = turns.join(coded, keys, "left").join(marks, keys, "left").join(counts, keys, "left").join(safe, keys, "left")
    if prints is not None and policy.protected != "allow":
        if len(keys) > 1:
            one = F.to_json(F.struct(*keys))
            hits = protected.match(read.select(one.alias("prompt_key"), "text"), "prompt_key", prints, item_id).groupBy("prompt_key").agg(F.max("words_covered").alias("protected_words"))
            out = out.withColumn("prompt_key", one).join(hits, "prompt_key", "left").drop("prompt_key")
        else:
            out = out.join(protected.match(read, keys[0], prints, item_id).groupBy(keys[0]).agg(F.max("words_covered").alias("protected_words")), keys, "left")
    else:
        out = out.withColumn("protected_words", F.lit(0).cast("long"))
    told = {"source_code": (policy.source_code, F.coalesce("detected", F.lit(False))), "marking": (policy.markings, F.size(F.coalesce("marks", F.array())) > 0), "protected": (policy.protected, F.coalesce("protected_words", F.lit(0)) > 0)}
    banned = [c for c in policy.block_categories]
    blocks = [F.when(F.col("too_large"), "size"), *[F.when(hit, name) for name, (action, hit) in told.items() if action == "block"], *[F.when(F.array_contains(F.coalesce("categories", F.array().cast("array<string>")), c), f"category {c}") for c in banned]]
    warns = [F.when(hit & ~F.col("too_large"), name) for name, (action, hit) in told.items() if action == "warn"]
    kept = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    out = out.withColumns({"blocked_by": kept(blocks), "warned": kept(warns)})
    blocked = F.size("blocked_by") > 0
    zero = lambda c: F.coalesce(c, F.lit(0))
    return out.select(*keys, "bytes", verdict(blocked, zero("findings") > 0).alias("verdict"), "blocked_by", "warned", zero("code_lines").alias("code_lines"), "languages", "marks", zero("protected_words").alias("protected_words"), zero("n_values").alias("n_values"), zero("findings").alias("findings"), F.when(blocked, "").otherwise(F.col("safe_text")).alias("safe_text"))


def conversation_tokens(findings: DataFrame, conv: str, turn: str) -> DataFrame:
    """Numbers for values that hold through a conversation: by first appearance, per category."""
    values = findings.withColumn("norm", normalise(F.col("entity_type"), F.col("value")))
    first = values.groupBy(conv, "entity_type", "norm").agg(F.min(F.struct(turn, "start")).alias("first"), F.count("*").alias("uses"))
    return first.withColumn("number", F.row_number().over(Window.partitionBy(conv, "entity_type").orderBy("first", "norm"))).drop("first")


def inspect_answer(answers: DataFrame, keys: list[str], known: DataFrame) -> DataFrame:
    """Values in answers: keys, entity_type, value, kind (echoed: the prompt's own value; produced: found for the first
    time). known has keys, entity_type and norm_value of the values of the conversation."""
    won = redact.live(resolve.resolve(rules.scan(answers.select(*keys, "text")), keys))
    own = won.withColumn("norm_value", normalise(F.col("entity_type"), F.col("value")))
    seen = known.select(*keys, "entity_type", "norm_value").distinct().withColumn("seen", F.lit(True))
    out = own.join(seen, [*keys, "entity_type", "norm_value"], "left")
    return out.select(*keys, "start", "end", "entity_type", "value", F.when(F.col("seen"), "echoed").otherwise("produced").alias("kind"))


def replayed(scenarios: DataFrame, keys: list[str], cap: int = 1024, policy: Policy | None = None, **options) -> DataFrame:
    """Each scenario (keys, text, sensitive) under a size cap and under the guard: which of the two is right."""
    judged = check(scenarios, keys, policy, **options)
    both = scenarios.select(*keys, "sensitive").join(judged, keys)
    capped = F.col("bytes") > cap
    right = F.when(F.col("sensitive"), F.col("verdict").isin("blocked", "redacted")).otherwise(F.col("verdict") == "clean")
    return both.select(*keys, "sensitive", "bytes", F.when(capped, "blocked").otherwise("allowed").alias("cap_verdict"), (capped == F.col("sensitive")).alias("cap_right"), "verdict", right.alias("guard_right"))


def replay_summary(rows: DataFrame) -> DataFrame:
    """One row: how often each was right, what each let through, what harmless prompts each refused."""
    n = lambda c: F.sum(c.cast("long"))
    s = F.col("sensitive")
    return rows.agg(F.count("*").alias("scenarios"), n(F.col("cap_right")).alias("cap_right"), n(F.col("guard_right")).alias("guard_right"), n(s & (F.col("cap_verdict") == "allowed")).alias("cap_leaks"), n(s & (F.col("verdict") == "clean")).alias("guard_leaks"), n(~s & (F.col("cap_verdict") == "blocked")).alias("cap_refused_harmless"), n(~s & (F.col("verdict") != "clean")).alias("guard_refused_harmless"))
