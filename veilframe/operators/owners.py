"""Tokens of people, and of the values that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import normalise
from veilframe.operators.names import name_tokens
from veilframe.operators.redact import live, numbered_vault
from veilframe.operators.resolve import lookup
from veilframe.operators.vocab import SHORT_NAMES

#: Categories whose values may carry a person's number.
LINKABLE = ["EMAIL_ADDRESS", "PHONE_NUMBER", "EMPLOYEE_ID", "US_SSN", "PASSPORT", "IN_PAN", "PL_PESEL", "TAX_ID", "DATE_OF_BIRTH", "ADDRESS", "NATIONAL_ID", "IN_AADHAAR", "BANK_ACCOUNT", "UPI_ID", "DRIVING_LICENCE", "IN_VOTER_ID", "UK_NINO", "HEALTH_DATA"]


def padded(number: Column) -> Column:
    s = number.cast("string")
    return F.when(F.char_length(s) < 3, F.lpad(s, 3, "0")).otherwise(s)


def person_tokens(findings: DataFrame, order: list[str]) -> DataFrame:
    """person (canonical, lower case), number, token of everyone found, numbered by first appearance. A column canonical of
    findings, where there is one, says who a mention is."""
    who = F.coalesce(F.col("canonical"), F.col("value")) if "canonical" in findings.columns else F.col("value")
    people = findings.where("entity_type = 'PERSON'").withColumn("value", F.array_join(name_tokens(who), " "))
    vault = numbered_vault(people, order)
    number = F.regexp_extract("token", r"_U(\d+)\]", 1)
    return vault.select(F.col("norm_value").alias("person"), number.alias("number"), F.concat(F.lit("[PERSON_"), number, F.lit("]")).alias("token"))


def mail_owners(addresses: DataFrame, people: DataFrame) -> DataFrame:
    """norm_value of addresses and the person whose name their first part spells: first and last name in either order, or
    an initial and the last name. An equi-join on the letters; of several people the first by number."""
    words = F.split("person", " ")
    letters = lambda c: F.regexp_replace(c, "[^a-z]", "")
    named = people.where(F.size(words) >= 2).select("person", "number", letters(words[0]).alias("f"), letters(F.element_at(words, -1)).alias("l")).where("f <> '' and l <> ''")
    forms = F.array_distinct(F.array(F.concat("f", "l"), F.concat(F.left("f", F.lit(1)), F.col("l")), F.concat(F.col("l"), F.left("f", F.lit(1))), F.concat("l", "f")))
    spelled = named.select("person", "number", F.explode(forms).alias("letters"))
    local = addresses.select("norm_value", letters(F.substring_index("norm_value", "@", 1)).alias("letters")).where("letters <> ''")
    best = F.row_number().over(Window.partitionBy("norm_value").orderBy("number", "person"))
    return local.join(spelled, "letters").withColumn("n", best).where("n = 1").select("norm_value", "person")


def row_owners(findings: DataFrame, row: list[str], order: list[str]) -> DataFrame:
    """The first person of every row of a table (columns row): row, person."""
    who = F.coalesce(F.col("canonical"), F.col("value")) if "canonical" in findings.columns else F.col("value")
    people = live(findings).where("entity_type = 'PERSON'").where(F.col(row[-1]).isNotNull())
    return people.groupBy(*row).agg(F.min_by(F.lower(F.array_join(name_tokens(who), " ")), F.struct(*order)).alias("person"))


def owned_vault(findings: DataFrame, order: list[str], row: list[str] | None = None) -> DataFrame:
    """entity_type, norm_value, token, owner of every value: [EMAIL_007] is an address of the seventh person, [EMAIL_007_2]
    a second one; a value without an owner is numbered by itself.

    The owner is the first person of the value's table row, or the one whose name an address spells.
    """
    people = person_tokens(findings, order)
    values = live(findings).where("entity_type <> 'PERSON'").withColumn("norm_value", normalise(F.col("entity_type"), F.col("value")))
    addresses = values.where("entity_type = 'EMAIL_ADDRESS'").select("norm_value").distinct()
    spelled = mail_owners(addresses, people).withColumnRenamed("person", "spelled")
    if row:
        values = values.join(row_owners(findings, row, order).withColumnRenamed("person", "beside"), row, "left")
    else:
        values = values.withColumn("beside", F.lit(None).cast("string"))
    first = values.groupBy("entity_type", "norm_value").agg(F.min(F.struct(*order)).alias("first"), F.min_by("beside", F.struct(*order)).alias("beside"))
    first = first.join(spelled, "norm_value", "left")
    owner = F.when(F.col("entity_type").isin(LINKABLE), F.coalesce("beside", F.when(F.col("entity_type") == "EMAIL_ADDRESS", F.col("spelled"))))
    first = first.withColumn("owner", owner).join(people.select(F.col("person").alias("owner"), "number"), "owner", "left")
    own = first.where("number is not null")
    nth = F.row_number().over(Window.partitionBy("entity_type", "owner").orderBy("first", "norm_value"))
    short = lookup(SHORT_NAMES, F.col("entity_type"), "VALUE")
    linked = own.withColumn("nth", nth).select("entity_type", "norm_value", F.concat(F.lit("["), short, F.lit("_"), "number", F.when(F.col("nth") > 1, F.concat(F.lit("_"), F.col("nth").cast("string"))).otherwise(""), F.lit("]")).alias("token"), "owner")
    alone = numbered_vault(values.join(own.select("entity_type", "norm_value"), ["entity_type", "norm_value"], "left_anti"), order).select("entity_type", "norm_value", "token", F.lit(None).cast("string").alias("owner"))
    persons = people.select(F.lit("PERSON").alias("entity_type"), F.col("person").alias("norm_value"), "token", F.col("person").alias("owner"))
    return persons.unionByName(linked).unionByName(alone)


def withheld(images: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Text of pictures that could not be read well enough is withheld as a whole. images: keys, status."""
    return texts.join(images.select(*keys, "status"), keys, "left").withColumn("safe_text", F.when(F.col("status") == "unreadable", "[IMAGE_TEXT_WITHHELD]").otherwise(F.col("safe_text"))).drop("status")
