"""Categories from structure: the header of a column, the label of a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of headers and labels in the order in which they are tried; what makes a header one of things and not of
#: people; the longest header.
HEADERS = [
    ("EMAIL_ADDRESS", r"e-?mail|email address|mail id"),
    ("PHONE_NUMBER", r"phone|mobile|tel\b|telephone|cell|contact no|contact number|ext\.?\b"),
    ("DATE_OF_BIRTH", r"date of birth|\bdob\b|birth ?date|born"),
    ("US_SSN", r"\bssn\b|social security"),
    ("PASSPORT", r"passport"),
    ("IN_PAN", r"\bpan\b(?! ?card)|permanent account"),
    ("PL_PESEL", r"pesel"),
    ("IN_AADHAAR", r"aadhaa?r|\buid\b"),
    ("IP_ADDRESS", r"\bip\b|ip address"),
    ("CREDENTIAL", r"api ?key|secret|password|passwd|\btoken\b|credential"),
    ("TAX_ID", r"\btin\b|tax ?id|taxpayer|\bnip\b|\bein\b|gstin|\bgst\b|\bvat\b"),
    ("BANK_ACCOUNT", r"bank account|account (?:no|number|#)|a/c ?(?:no|number)?\b|\bifsc\b|sort code|routing"),
    ("UPI_ID", r"\bupi\b|\bvpa\b"),
    ("DRIVING_LICENCE", r"driving licen[cs]e|driver'?s? licen[cs]e|\bdl (?:no|number)"),
    ("IN_VOTER_ID", r"voter|\bepic\b|election card"),
    ("UK_NINO", r"national insurance|\bnino\b|\bni (?:no|number)"),
    ("HEALTH_DATA", r"blood (?:group|type)|diagnosis|medical condition|disabilit|allerg"),
    ("NATIONAL_ID", r"national id|nat\.? id|national identifier|id number|identity (?:no|number)"),
    ("EMPLOYEE_ID", r"employee id|emp(?:loyee)? ?(?:no|#|number)|staff id|badge"),
    ("ADDRESS", r"(?:home |postal |residential |mailing )?address"),
    ("PERSON", r"\bname\b|full name|employee\b|owner|approver|approved by|prepared by|reviewed by|author|signed by|signatory|contact person|\bcontact\b|assignee|assigned to|requester|requestor|reviewer|attendee|member|manager name|person|staff|user ?name|display name|last.?modified.?by|lastmodifiedby|creator|^manager$|\blead\b|champion|delegate|escalat"),
]
NOT_PERSON = "vendor|supplier|compan|organi[sz]ation|engagement|product|system|application|project|file|document|template|field|control name|risk name|process name|group|department|team|business unit|site|entity|task|trigger|rule|stage|workflow|role|attribute|question|report|form\\b|queue|object|step|status"
LONGEST_HEADER = 60
LABEL = r"^\s*([A-Za-z][A-Za-z .-]{1,30}):\s+(\S.*)$"
LABEL_SCORE = 0.72


def header_category(header: Column) -> Column:
    """The first category whose pattern the header holds; null for none, for names of things and for headers that are too long."""
    label = F.lower(F.trim(header))
    told = reduce(lambda c, h: c.when(label.rlike(h[1]), h[0]), HEADERS, F.when(F.lit(False), ""))
    return F.when((F.char_length(label) <= LONGEST_HEADER) & ~((told == "PERSON") & label.rlike(NOT_PERSON)), told)


def labelled(spans: DataFrame) -> DataFrame:
    """Findings of `Label: value` lines: spans' columns (without text), start, end, value, entity_type, recognizer, score.

    A person's value ends at a comma, bracket or dash; other values at the end of the line, without blanks.
    """
    keep = [c for c in spans.columns if c != "text"]
    category = header_category(F.regexp_extract("text", LABEL, 1))
    whole = F.rtrim(F.regexp_extract("text", LABEL, 2))
    value = F.when(category == "PERSON", F.rtrim(F.regexp_extract(whole, r"^([^,(–—]*)", 1))).otherwise(whole)
    start = F.char_length(F.regexp_extract("text", r"^(\s*[A-Za-z][A-Za-z .-]{1,30}:\s+)\S", 1))
    hit = spans.where(F.col("text").rlike(LABEL)).select(*keep, start.alias("start"), (start + F.char_length(value)).alias("end"), value.alias("value"), category.alias("entity_type"))
    return hit.where("entity_type is not null and value <> ''").withColumn("recognizer", F.lit("label")).withColumn("score", F.lit(LABEL_SCORE))


#: Labels that are no speakers; given names that are words as well; scores of what structure says.
NOT_A_SPEAKER = {"speaker", "interviewer", "interviewee", "moderator", "host", "operator", "narrator", "unknown", "agent", "customer", "caller", "participant", "audience", "presenter", "chair", "all", "everyone", "q", "a", "question", "answer", "response", "reply", "comment", "comments", "note", "result", "summary", "action", "attribute", "section", "condition", "example", "step", "status", "subject", "topic"}
WORD_LIKE_GIVEN = {"mark", "will", "bill", "grace", "hope", "rose", "joy", "dawn", "faith", "jack", "frank", "grant", "rob", "bob", "pat", "sue", "ray", "dan", "don", "nick", "josh", "rod", "sandy", "sally", "amber", "art", "carol", "dean", "earl", "holly", "ivy", "lance", "miles", "pearl", "penny", "ruby", "victor"}
HEADER_SCORE, SPEAKER_CUE, SPEAKER_LINE, NAME_LIST, NAME_LINE, BROKEN_ID, UNREADABLE = 0.75, 0.8, 0.7, 0.65, 0.5, 0.88, 0.5
EMPTY_VALUES = ["", "-", "–", "—", "n/a", "na", "none", "tbd", "tbc", "nil", "null", "yes", "no", "x", "?", "various", "all"]
#: How far the rest of a broken id may be, in spans; how much of the span before is read with the next;
#: the least confidence of a read word; share of a box that a stamp must cover; words and share of an unreadable picture.
ID_REACH, PREFIX_CHARS, OCR_FLOOR, STAMP_SHARE, UNREADABLE_WORDS, UNREADABLE_SHARE = 6, 60, 0.6, 0.3, 5, 0.5
FINDING = ["start", "end", "value", "entity_type", "recognizer", "score"]


def plausible(value: Column, category: Column) -> Column:
    """Can the value be what its header says? Names are judged by letters alone here, their shape elsewhere."""
    v = F.trim(value)
    n = F.char_length(F.regexp_replace(v, "[^0-9]", ""))
    return ~F.lower(v).isin(EMPTY_VALUES) & (F.char_length(v) >= 2) & (
        F.when(category == "PERSON", v.rlike(r"(?U)^[\p{L}][\p{L} .,'’-]{0,59}$"))
        .when(category == "EMAIL_ADDRESS", F.contains(v, F.lit("@")) | v.rlike(r"\w[.\s]\w+\s?(?:com|org|net|example)\b"))
        .when(category == "PHONE_NUMBER", n >= 7)
        .when(category == "DATE_OF_BIRTH", (n >= 2) & v.rlike(r"(?:19|20)?\d{2}"))
        .when(category == "ADDRESS", (F.char_length(v) >= 8) & ((n > 0) | F.contains(v, F.lit(","))))
        .otherwise((n >= 3) | F.replace(v, F.lit(" "), F.lit("")).rlike("^[A-Z0-9-]{6,}$"))
    )


def headed(cells: DataFrame) -> DataFrame:
    """Findings of cells by the header of their column, a line of the cell each: cells have header and text."""
    from veilframe.functions.text import matches

    keep = [c for c in cells.columns if c not in ("text", "header")]
    told = cells.withColumn("category", header_category(F.col("header"))).where("category is not null")
    lines = told.select(*keep, "category", F.explode(matches(F.col("text"), r"[^\n]*\S")).alias("m"))
    lead = F.char_length(F.regexp_extract("m.text", r"^(\s*)", 1))
    own = lines.select(*keep, "category", (F.col("m.start") + lead).alias("start"), F.col("m.end").alias("end"), F.trim("m.text").alias("value"))
    return own.where(plausible(F.col("value"), F.col("category"))).select(*keep, "start", "end", "value", F.col("category").alias("entity_type"), F.lit("header").alias("recognizer"), F.lit(HEADER_SCORE).alias("score"))


def speakers(spans: DataFrame, keys: list[str], given: list[str] | None = None) -> DataFrame:
    """Speakers: of a cue (kind speaker), and labels at line starts that are a given name or come twice in a span."""
    from pyspark.sql import Window

    from veilframe.functions.text import matches

    kind = F.col("kind") if "kind" in spans.columns else F.lit("")
    rows = spans.withColumn("of_kind", kind)
    value = F.trim("text")
    cue = rows.where((F.col("of_kind") == "speaker") & ~F.lower(F.regexp_replace(value, r"[\d\s#]+$", "")).isin(*NOT_A_SPEAKER) & plausible(value, F.lit("PERSON")))
    lead = F.char_length(F.regexp_extract("text", r"^(\s*)", 1))
    cues = cue.select(*keys, lead.alias("start"), (lead + F.char_length(value)).alias("end"), value.alias("value"), F.lit("PERSON").alias("entity_type"), F.lit("speaker").alias("recognizer"), F.lit(SPEAKER_CUE).alias("score"))
    pattern = r"(?m)(^[ \t]*(?:\[?\d{1,2}:\d{2}(?::\d{2})?\]?[ \t]+)?)([A-Z][\w'.-]*(?:[ \t]+[A-Z][\w'.-]*){0,3})[ \t]*(?:\(\d{1,2}:\d{2}(?::\d{2})?\))?:[ \t]+\S"
    lines = rows.where((F.col("of_kind") != "speaker") & F.col("text").rlike(pattern)).select(*keys, "of_kind", F.explode(matches(F.col("text"), pattern, 2, 1)).alias("m"))
    lines = lines.withColumn("times", F.count("*").over(Window.partitionBy(*keys, "m.text")))
    name = F.lower("m.text")
    repeated = (F.col("times") >= 2) & (F.col("of_kind") != "table_cell") & ~name.rlike(NOT_PERSON)
    listed = F.lower(F.regexp_extract("m.text", r"^(\S+)", 1)).isin([g.lower() for g in given]) if given else F.lit(False)
    said = lines.where((repeated | listed) & ~name.isin(*NOT_A_SPEAKER) & header_category(F.col("m.text")).isNull())
    return cues.unionByName(said.select(*keys, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("value"), F.lit("PERSON").alias("entity_type"), F.lit("speaker").alias("recognizer"), F.lit(SPEAKER_LINE).alias("score")))


def name_lists(cells: DataFrame, keys: list[str], people: DataFrame) -> DataFrame:
    """The other lines of a cell of three lines or more in which at least two, and half, are people already found. people
    are findings (keys, start, end) of persons that are to be redacted."""
    from veilframe.functions.text import matches

    lines = cells.select(*keys, F.explode(matches(F.col("text"), r"[^\n]*\S[^\n]*")).alias("m")).select(*keys, F.col("m.start").alias("a"), F.col("m.end").alias("b"), F.col("m.text").alias("line"))
    p = people.select(*[F.col(k).alias(f"p_{k}") for k in keys], F.col("start").alias("p_start"), F.col("end").alias("p_end"))
    on = (F.col("p_start") < F.col("b")) & (F.col("p_end") > F.col("a"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"p_{k}"))
    held = F.coalesce(F.sum(F.when(F.col("p_start").isNotNull(), F.least("p_end", "b") - F.greatest("p_start", "a"))), F.lit(0))
    got = lines.join(p, on, "left").groupBy(*keys, "a", "b", "line").agg(held.alias("held"))
    got = got.withColumn("named", F.col("held") >= 0.8 * F.char_length(F.trim("line")))
    per = got.groupBy(*keys).agg(F.count("*").alias("lines"), F.sum(F.col("named").cast("int")).alias("people"))
    lists = per.where((F.col("lines") >= 3) & (F.col("people") >= F.greatest(F.lit(2), F.col("lines") / 2)))
    value = F.trim("line")
    shaped = value.rlike(r"(?U)^\p{Lu}[\p{L}.'’-]*(?: [\p{L}.'’-]+){1,4}$")
    rest = got.where(~F.col("named") & shaped).join(lists.select(*keys), keys, "left_semi")
    start = (F.col("a") + F.char_length(F.regexp_extract("line", r"^(\s*)", 1))).alias("start")
    return rest.select(*keys, start, (F.col("a") + F.char_length(F.regexp_extract("line", r"^(\s*)", 1)) + F.char_length(value)).alias("end"), value.alias("value"), F.lit("PERSON").alias("entity_type"), F.lit("name_list").alias("recognizer"), F.lit(NAME_LIST).alias("score"))


def name_lines(spans: DataFrame, keys: list[str], ordinary: list[str] | None = None) -> DataFrame:
    """A given name that is a word as well, with one more capitalised word and nothing else on its line. For cells and for
    text read from pictures."""
    from veilframe.functions.text import matches

    pattern = r"(?m)(^[ \t]*)([A-Z][a-z]+[ \t][A-Z][a-z]+(?:[-'’][A-Z][a-z]+)?)[ \t]*$"
    hit = spans.where(F.col("text").rlike(pattern)).select(*keys, F.explode(matches(F.col("text"), pattern, 2, 1)).alias("m"))
    words = F.split(F.lower("m.text"), r"[ \t]")
    hit = hit.where(words[0].isin(*WORD_LIKE_GIVEN) & (~words[1].isin(ordinary) if ordinary else F.lit(True)))
    return hit.select(*keys, F.col("m.start").alias("start"), F.col("m.end").alias("end"), F.col("m.text").alias("value"), F.lit("PERSON").alias("entity_type"), F.lit("name_line").alias("recognizer"), F.lit(NAME_LINE).alias("score"))


def with_prefix(spans: DataFrame, file: str, page: str | None = None, order: str = "span_ord") -> DataFrame:
    """spans with prefix: their header, or the end of the span before on the same page. A scan of prefix and text finds what
    was broken between two spans; lead tells where the text begins."""
    from pyspark.sql import Window

    of = Window.partitionBy(file, *([page] if page else [])).orderBy(order)
    header = F.nullif(F.col("header"), F.lit("")) if "header" in spans.columns else F.lit(None).cast("string")
    prefix = F.coalesce(F.concat(header, F.lit(" ")), F.concat(F.right(F.lag("text").over(of), F.lit(PREFIX_CHARS)), F.lit("\n")), F.lit(""))
    return spans.withColumn("prefix", prefix).withColumn("lead", F.char_length("prefix"))


def after_prefix(findings: DataFrame) -> DataFrame:
    """Findings of a scan of prefix and text, in places of the text; those that begin in the prefix go, unless the prefix
    ends in a hyphen within them."""
    crosses = F.col("prefix").rlike(r"-\s*$") & (F.col("end") > F.col("lead"))
    moved = findings.where((F.col("start") >= F.col("lead")) | crosses)
    return moved.withColumn("start", F.greatest(F.col("start") - F.col("lead"), F.lit(0))).withColumn("end", F.col("end") - F.col("lead")).where(F.col("end") > F.col("start"))


def broken_ids(spans: DataFrame, file: str, prefixes: tuple[str, ...] = ("EMP", "DIR", "STF", "CON", "USR"), order: str = "span_ord") -> DataFrame:
    """Ids whose prefix ends a span and whose number begins one of the next six: file, prefix_ord, span_ord, start, end,
    value. The nearest number is taken, and each once."""
    from pyspark.sql import Window

    heads = spans.withColumn("head", F.regexp_extract("text", rf"(?:^|[^A-Za-z0-9])((?:{'|'.join(prefixes)})-)\s*$", 1)).where("head <> ''").select(F.col(file).alias("h_file"), F.col(order).alias("prefix_ord"), "head")
    tails = spans.withColumn("tail", F.regexp_extract("text", r"^\s*([0-9]{3,7})(?![0-9A-Za-z])", 1)).where("tail <> ''").select(file, order, "tail", F.char_length(F.regexp_extract("text", r"^(\s*)", 1)).alias("start"))
    near = heads.join(tails, (F.col("h_file") == F.col(file)) & (F.col(order) > F.col("prefix_ord")) & (F.col(order) <= F.col("prefix_ord") + ID_REACH))
    first = F.row_number().over(Window.partitionBy(file, "prefix_ord").orderBy(order))
    once = F.row_number().over(Window.partitionBy(file, order).orderBy(F.desc("prefix_ord")))
    best = near.withColumn("n", first).where("n = 1").withColumn("n", once).where("n = 1")
    return best.select(file, "prefix_ord", order, "start", (F.col("start") + F.char_length("tail")).alias("end"), F.concat("head", "tail").alias("value"))


def read_lines(words: DataFrame, keys: list[str]) -> DataFrame:
    """Lines of read words (keys, line, pos, word, conf) as spans with the place of each word: text, conf (mean), words."""
    per = words.groupBy(*keys, "line").agg(F.array_sort(F.collect_list(F.struct("pos", "word", "conf"))).alias("w"))
    text = F.array_join(F.transform("w", lambda x: x["word"]), " ")
    places = F.aggregate("w", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out")), lambda a, x: F.struct((a["at"] + F.char_length(x["word"]) + 1).cast("int").alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].cast("int").alias("start"), (a["at"] + F.char_length(x["word"])).cast("int").alias("end")))).alias("out")))["out"]
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x["conf"]) / F.size("w")
    return per.select(*keys, "line", text.alias("text"), F.round(mean, 4).alias("conf"), places.alias("words"))


def unreadable(words: DataFrame, keys: list[str], floor: float = OCR_FLOOR) -> DataFrame:
    """Pictures of five words or more of which at least half were read below floor."""
    per = words.groupBy(*keys).agg(F.count("*").alias("words"), F.sum((F.col("conf") < floor).cast("int")).alias("low"))
    return per.where((F.col("words") >= UNREADABLE_WORDS) & (F.col("low") >= UNREADABLE_SHARE * F.col("words"))).select(*keys, "words", "low")


def fail_closed(words: DataFrame, keys: list[str], findings: DataFrame, floor: float = OCR_FLOOR) -> DataFrame:
    """Read words (keys, start, end, word, conf) that look like an identifier, were read below floor and are not found yet:
    they await review."""
    from veilframe.operators.redact import uncovered

    like = F.col("word").rlike("[0-9]") & (F.char_length("word") >= 4)
    low = words.where((F.col("conf") < floor) & like).select(*keys, "start", "end", F.col("word").alias("value"))
    return uncovered(low, findings, keys).select(*keys, "start", "end", "value", F.lit("LOW_CONFIDENCE_OCR").alias("entity_type"), F.lit("low_confidence").alias("recognizer"), F.lit(UNREADABLE).alias("score"))


def overlap_share(a: str, b: str) -> Column:
    """The share of box a (columns a_x0, a_y0, a_x1, a_y1) that box b covers."""
    side = lambda k: F.greatest(F.least(F.col(f"{a}_{k}1"), F.col(f"{b}_{k}1")) - F.greatest(F.col(f"{a}_{k}0"), F.col(f"{b}_{k}0")), F.lit(0))
    area = (F.col(f"{a}_x1") - F.col(f"{a}_x0")) * (F.col(f"{a}_y1") - F.col(f"{a}_y0"))
    return F.when(area > 0, side("x") * side("y") / area).otherwise(0.0)


def boxed(words: DataFrame, boxes: DataFrame, page: list[str], share: float = STAMP_SHARE) -> DataFrame:
    """Words (page, w_x0..) and the boxes of their page (b_x0..) that cover at least share of them: words in cells, words
    under stamps. An equi-join by page, then the boxes are compared."""
    return words.join(boxes, page).where(overlap_share("w", "b") >= share)


def finding_boxes(findings: DataFrame, words: DataFrame, keys: list[str], pad: float = 1.0) -> DataFrame:
    """One box a line for every finding: keys, start, end, line, x0, y0, x1, y1. words have keys, line, start, end, w_x0.."""
    w = words.select(*[F.col(k).alias(f"w_{k}") for k in keys], "line", F.col("start").alias("w_start"), F.col("end").alias("w_end"), "w_x0", "w_y0", "w_x1", "w_y1")
    on = (F.col("w_start") < F.col("end")) & (F.col("w_end") > F.col("start"))
    for k in keys:
        on = on & (F.col(k) == F.col(f"w_{k}"))
    return findings.join(w, on).groupBy(*keys, "start", "end", "line").agg((F.min("w_x0") - pad).alias("x0"), (F.min("w_y0") - pad).alias("y0"), (F.max("w_x1") + pad).alias("x1"), (F.max("w_y1") + pad).alias("y1"))
