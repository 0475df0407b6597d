"""Text copied from registered passages, by five-word shingles. The registry holds keyed digests and no text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words a shingle, shortest run, fewest covered words, shortest passage that can be registered.
SHINGLE, RUN, COVERED, REGISTER = 5, 10, 30, 10
#: As many prints are held in every task, to drop shingles that match none before they are rows; more are joined.
HELD = 20_000
WORD = r"[\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def keyed(salt: str, text: Column) -> Column:
    """64 bits of a keyed digest, in hex."""
    return F.left(F.sha2(F.concat(F.lit(f"{salt}|"), text), 256), F.lit(16))


def shingles(ws: Column, salt: str = "") -> Column:
    """array<struct<pos, fp>>; the fingerprint is a keyed digest, so a registry holds no text.

    Shifted copies of the words are zipped: a slice inside a lambda would read the words anew for every place.
    """
    n = F.size(ws) - SHINGLE + 1
    shifted = [F.slice(ws, i, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(1, SHINGLE + 1)]
    print_ = lambda r: keyed(salt, F.concat_ws(" ", *[r[f"w{i}"] for i in range(1, SHINGLE + 1)]))
    return F.transform(F.arrays_zip(*shifted), lambda r, i: F.struct(i.alias("pos"), print_(r).alias("fp")))


def register(items: DataFrame, id_col: str, salt: str = "") -> DataFrame:
    """Distinct fingerprints of each registered passage: id_col, fp. Passages of the same words are one: the last id of
    them stands for all. Shorter ones than REGISTER words are refused."""
    ws = items.select(id_col, words(F.col("text")).alias("ws")).where(F.size("ws") >= REGISTER).withColumn("digest", F.sha2(F.concat_ws(" ", "ws"), 256))
    ws = ws.groupBy("digest").agg(F.max(id_col).alias(id_col), F.first("ws").alias("ws"))
    return ws.select(id_col, F.explode(shingles(F.col("ws"), salt)).alias("s")).select(id_col, F.col("s.fp").alias("fp")).distinct()


def added(registry: DataFrame, items: DataFrame, id_col: str, salt: str = "") -> DataFrame:
    """The registry with further passages; prints of ids that come again are replaced."""
    new = register(items, id_col, salt)
    return registry.join(new.select(id_col).distinct(), id_col, "left_anti").unionByName(new)


def removed(registry: DataFrame, id_col: str, ids: list) -> DataFrame:
    return registry.where(~F.col(id_col).isin(ids))


def listed(registry: DataFrame, id_col: str) -> DataFrame:
    return registry.groupBy(id_col).agg(F.count("*").alias("fingerprints"))


def covered(docs: DataFrame, doc_id: str, prints: DataFrame, item_id: str, salt: str) -> DataFrame:
    """doc_id, item_id, pos of every word of a document that a passage has in the same five words."""
    own = docs.select(doc_id, shingles(words(F.col("text")), salt).alias("all"))
    few = [r.fp for r in prints.select("fp").distinct().limit(HELD + 1).collect()]
    if len(few) <= HELD:
        own = own.withColumn("all", F.filter("all", lambda s: s["fp"].isin(few)))
    own = own.select(doc_id, F.explode("all").alias("s")).select(doc_id, "s.pos", "s.fp")
    return own.join(prints, "fp").select(doc_id, item_id, F.explode(F.sequence("pos", F.col("pos") + SHINGLE - 1)).alias("pos")).distinct()


def match(docs: DataFrame, doc_id: str, prints: DataFrame, item_id: str, salt: str = "") -> DataFrame:
    """doc_id, item_id, words_covered, longest_run of pairs with a run of 10 words, or 30 words in all."""
    places = covered(docs, doc_id, prints, item_id, salt)
    island = F.col("pos") - F.row_number().over(Window.partitionBy(doc_id, item_id).orderBy("pos"))
    runs = places.withColumn("g", island).groupBy(doc_id, item_id, "g").agg(F.count("*").alias("n"))
    return runs.groupBy(doc_id, item_id).agg(F.sum("n").alias("words_covered"), F.max("n").alias("longest_run")).where((F.col("longest_run") >= RUN) | (F.col("words_covered") >= COVERED))


def overlaps(docs: DataFrame, doc_id: str, prints: DataFrame, item_id: str, salt: str = "") -> DataFrame:
    """match, with share (of the document's words) and lines (array of first and last line, from 1), most words first."""
    hits = match(docs, doc_id, prints, item_id, salt)
    places = covered(docs, doc_id, prints, item_id, salt).join(hits.select(doc_id, item_id), [doc_id, item_id], "left_semi")
    # lines are told from the number of words in each line, so that no word needs a place of its own
    per_line = docs.select(doc_id, F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).select(doc_id, (F.col("line") + 1).alias("line"), F.size(words(F.col("text"))).cast("long").alias("n"))
    order = Window.partitionBy(doc_id).orderBy("line")
    per_line = per_line.withColumn("upto", F.sum("n").over(order)).withColumn("total", F.sum("n").over(Window.partitionBy(doc_id)))
    lines = per_line.where("n > 0").withColumn("from_word", F.col("upto") - F.col("n"))
    on = (places[doc_id] == lines[doc_id]) & (F.col("pos") >= F.col("from_word")) & (F.col("pos") < F.col("upto"))
    at = places.join(lines, on).select(places[doc_id], item_id, "line", "total").distinct()
    pair = Window.partitionBy(doc_id, item_id).orderBy("line")
    # a line whose words are not covered ends a range; so does a blank one
    ranges = at.withColumn("g", F.col("line") - F.row_number().over(pair)).groupBy(doc_id, item_id, "g", "total").agg(F.min("line").alias("a"), F.max("line").alias("b"))
    told = ranges.groupBy(doc_id, item_id, "total").agg(F.array_sort(F.collect_list(F.array("a", "b"))).alias("lines"))
    out = hits.join(told, [doc_id, item_id]).withColumn("share", F.round(F.col("words_covered") / F.col("total"), 3)).drop("total")
    return out.orderBy(doc_id, F.desc("words_covered"), item_id)
