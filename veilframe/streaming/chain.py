"""A record that only grows, as a stream's sink: entries chained in segments, segments folded to a batch, batches chained.

An entry's hash covers the one before in its segment of at most 256 entries, so segments are hashed side by side. Their last hashes
are folded, 256 at a time, to one digest of the batch; a batch's head covers that digest and the head before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilframe.operators.audit import START
from veilframe.sources.kept import kept

ENTRIES = "run_id string, segment long, seq int, body string, prev string, hash string"
HEADS = "run_id string, n long, digest string, prev string, head string"
#: So many bits of a row's number count within a segment, and so many segments are folded to one digest at a time.
BITS, LEVELS = 8, 7


def told(*parts: Column | str) -> Column:
    return F.sha2(F.concat_ws("|", *[p if isinstance(p, Column) else F.col(p) for p in parts]), 256)


def entries(numbered: DataFrame, run_id: str, batch: int) -> DataFrame:
    """Entries of (row, body), chained within each segment in the order of row."""
    once = lambda prev, seq, body, segment: F.sha2(F.concat_ws("|", prev, F.lit(run_id), F.lit(str(batch)), segment.cast("string"), seq.cast("string"), body), 256)
    segments = numbered.groupBy(F.shiftright("row", BITS).alias("segment")).agg(F.array_sort(F.collect_list(F.struct("row", "body"))).alias("rows"))
    none = F.expr("cast(array() as array<struct<seq:int,body:string,prev:string,hash:string>>)")

    def step(out: Column, r: Column) -> Column:
        prev, seq = F.coalesce(F.try_element_at(out, F.lit(-1))["hash"], F.lit(START)), (F.size(out) + 1).cast("int")
        return F.concat(out, F.array(F.struct(seq.alias("seq"), r["body"].alias("body"), prev.alias("prev"), once(prev, seq, r["body"], F.col("segment")).alias("hash"))))

    rows = segments.select("segment", F.explode(F.aggregate("rows", none, step)).alias("e"))
    return rows.select(F.lit(run_id).alias("run_id"), "segment", "e.seq", "e.body", "e.prev", "e.hash")


def folded(written: DataFrame, by: list[str]) -> DataFrame:
    """by, n, digest: the last hashes of all segments, folded in their order by groups of at most 256."""
    level = written.groupBy(*by, "segment").agg(F.count("*").alias("n"), F.max_by("hash", "seq").alias("digest"))
    fold = [F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "digest"))), lambda s: F.concat_ws(":", s["segment"].cast("string"), s["digest"])), ","), 256).alias("digest")]
    for _ in range(LEVELS):
        level = level.withColumn("above", F.shiftright("segment", BITS)).groupBy(*by, "above").agg(*fold).withColumnRenamed("above", "segment")
    return level.select(*by, "n", "digest")


def read(spark: SparkSession, folder: str, what: str, schema: str) -> DataFrame:
    """A table of the record with the number of its batch; empty where nothing has been written yet."""
    full = f"{schema}, batch long"
    try:
        return spark.read.schema(full).option("basePath", f"{folder}/{what}").parquet(f"{folder}/{what}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], full)


def sink(folder: str, run_id: str) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch, over rows with a column body; each chain has its own folder, shared by driver and executors.

    A batch is done when its head is there, which is written last: a replayed batch adds nothing, and what an attempt
    that failed left is written over. Rows are first written with their numbers, so a task that runs again finds the same ones.
    Cases: null bodies are empty ones; repeated rows are entries each; an empty batch leaves nothing; other columns are left out.
    """
    folder = folder.rstrip("/")

    def append(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        heads = read(spark, folder, "heads", HEADS)
        if not heads.where(F.col("batch") == batch).isEmpty():
            return
        numbered = kept(rows.select(F.coalesce("body", F.lit("")).alias("body")).withColumn("row", F.monotonically_increasing_id()), "numbered")
        if numbered.isEmpty():
            return
        place = f"{folder}/entries/batch={batch}"
        entries(numbered, run_id, batch).write.mode("overwrite").parquet(place)
        before = heads.where(F.col("batch") < batch).agg(F.max_by("head", "batch")).first()[0] or START
        whole = folded(spark.read.schema(ENTRIES).parquet(place), ["run_id"]).withColumn("prev", F.lit(before))
        head = told("prev", "run_id", F.lit(str(batch)), F.col("n").cast("string"), "digest")
        whole.select("run_id", "n", "digest", "prev", head.alias("head")).write.mode("overwrite").parquet(f"{folder}/heads/batch={batch}")

    return append


def verify(spark: SparkSession, folder: str, last: str | None = None) -> DataFrame:
    """What does not fit: batch, segment, seq, problem (changed, broken link, missing entry, other entries, changed head, missing batch).

    Entries that are gone from the end of a segment, or whole segments, show as `other entries` of their batch. The last batches
    can only be missed by who kept the last head elsewhere and gives it here.
    """
    folder = folder.rstrip("/")
    # entries of a batch without a head are of an attempt that failed: no part of the record
    heads, every = read(spark, folder, "heads", HEADS), read(spark, folder, "entries", ENTRIES)
    every = every.join(heads.select("batch"), "batch", "left_semi")
    order = Window.partitionBy("batch", "segment").orderBy("seq")
    digest = told("prev", "run_id", F.col("batch").cast("string"), F.col("segment").cast("string"), F.col("seq").cast("string"), "body")
    due = F.coalesce(F.lag("hash").over(order), F.lit(START))
    problem = F.when(F.col("hash") != digest, "changed").when(F.col("seq") != F.row_number().over(order), "missing entry").when(F.col("prev") != due, "broken link")
    own = every.withColumn("problem", problem).where("problem is not null").select("batch", "segment", "seq", "problem")
    now = folded(every, ["batch"]).select("batch", F.col("n").alias("n_now"), F.col("digest").alias("digest_now"))
    # one row a batch: their chain is one window
    chain = Window.partitionBy("run_id").orderBy("batch")
    head = told("prev", "run_id", F.col("batch").cast("string"), F.col("n").cast("string"), "digest")
    checked = heads.withColumn("due", F.coalesce(F.lag("head").over(chain), F.lit(START))).join(now, "batch", "left")
    wrong = F.array_compact(F.array(F.when(F.col("head") != head, "changed head"), F.when(F.col("prev") != F.col("due"), "missing batch"), F.when(~(F.col("n").eqNullSafe(F.col("n_now")) & F.col("digest").eqNullSafe(F.col("digest_now"))), "other entries")))
    null = lambda t: F.lit(None).cast(t)
    out = own.unionByName(checked.select("batch", null("long").alias("segment"), null("int").alias("seq"), F.explode(wrong).alias("problem")))
    if last is not None:
        end = heads.agg(F.max("batch").alias("batch"), F.max_by("head", "batch").alias("head")).where(~F.col("head").eqNullSafe(F.lit(last)))
        out = out.unionByName(end.select("batch", null("long").alias("segment"), null("int").alias("seq"), F.lit("missing batch").alias("problem")))
    return out
