"""What the operators of this subpackage share: the shared folder, Arrow mapping, group-wise ranks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are the runs between these six ASCII characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder will do for
    a session of one process alone; on a cluster it is an error, as no executor would see another's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="veilframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written within are of no more use afterwards: they go at the end of the write, not whenever
    the driver's garbage goes."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def save(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it back: a cut in the lineage that outlives any executor."""
    path = new_path(df.sparkSession, name)
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    # what else the write has left, Spark drops when the driver's garbage goes
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete what save wrote, once nothing reads it any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(taken: Iterable[str], name: str) -> str:
    """name, with as many underscores in front as it takes to differ from every name in taken (case is ignored)."""
    lowered = {x.lower() for x in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def trim() -> None:
    """Hand freed memory back to the system: worker processes outlive their tasks, and the next stage needs the room."""
    gc.collect()
    released()


def released() -> None:
    """As trim, without looking for garbage in cycles."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, by batches of at most a thousand rows where the session has no setting of its own."""
    conf = df.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from fn(batches)
        trim()

    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that what a task derives from a batch stays small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes; null counts as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.large_binary())
    elif pa.types.is_string(column.type):
        column = column.cast(pa.binary())
    return [x or b"" for x in column.to_pylist()]


def hash31(*columns) -> F.Column:
    """A long in [0, 2^32) that SQL engines with md5 can compute as well; nulls count as empty text."""
    text = F.concat_ws(":", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def group_rank(df: DataFrame, groups: DataFrame, keys: list[str], order: list, spread, cells: str, rank: str) -> DataFrame:
    """Add rank: the place, from 1, of each row in its group, without ever sorting a whole group in one task.

    groups has one row a group: the keys, the number of cells it is cut into (column `cells`) and what else is to be
    added to its rows. Rows go to cell pmod(spread, cells); the rank follows (cell, *order). Null keys form a group.
    """
    taken = [*df.columns, *groups.columns]
    cell, at = fresh(taken, "cell_no"), fresh(taken, "rows_before")
    twin = fresh([*taken, cell], f"{cell}_r")
    here = {k: fresh([*taken, cell, twin, at], f"key_{k}") for k in keys}

    def joined(left: DataFrame, right: DataFrame, also: dict[str, str]) -> DataFrame:
        right = right.withColumnsRenamed(here)
        same = [left[k].eqNullSafe(right[here[k]]) for k in keys] + [left[x] == right[y] for x, y in also.items()]
        on = same[0]
        for x in same[1:]:
            on = on & x
        return left.join(right, on).drop(*here.values(), *also.values())

    dealt = joined(df, groups, {}).withColumn(cell, F.pmod(spread, F.col(cells)).cast("int"))
    counts = dealt.groupBy(*keys, cell).agg(F.count("*").alias(at))
    before = Window.partitionBy(*keys).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn(at, F.coalesce(F.sum(at).over(before), F.lit(0))).withColumnRenamed(cell, twin)
    ranked = dealt.withColumn(rank, F.row_number().over(Window.partitionBy(*keys, cell).orderBy(*order)))
    return joined(ranked, counts, {cell: twin}).withColumn(rank, F.col(rank).cast("long") + F.col(at)).drop(cell, at)
