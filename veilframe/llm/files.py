"""Binary files on any file system that Spark writes to, and whole files read back.

Spark's text writer puts out the bytes of a string column as they are, each row followed by a separator of our choice;
a format that names the separator as part of itself can so be written by ordinary tasks, with Spark's commit protocol:
a lost executor costs a rerun of its tasks and never half a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sections(sections: DataFrame, column: str, path: str, separator: str, suffix: str) -> None:
    """A file for each partition: the bytes of `column`, row after row, each followed by separator."""
    sections.select(F.col(column).cast("string").alias("value")).write.option("lineSep", separator).text(path)
    spark = sections.sparkSession
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for found in fs.listStatus(folder):
        name = found.getPath().getName()
        if name.startswith("part-"):
            fs.rename(found.getPath(), jvm.org.apache.hadoop.fs.Path(folder, name.rsplit(".", 1)[0] + suffix))


def read_whole(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """One row a file: path, content."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path).where("length > 0").select("path", "content")
