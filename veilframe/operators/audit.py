"""A hash-chained record: each entry's hash covers the one before."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

START = "0" * 64


def append(records: Iterable[dict], run_id: str, prev: str = START, seq: int = 0) -> list[dict]:
    """Entries that continue a chain. Appending is sequential by nature and is done where the log is written."""
    out = []
    for r in records:
        seq += 1
        body = json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        digest = hashlib.sha256(f"{prev}|{run_id}|{seq}|{body}".encode()).hexdigest()
        out.append({"run_id": run_id, "seq": seq, "body": body, "prev": prev, "hash": digest})
        prev = digest
    return out


def verify(log: DataFrame) -> DataFrame:
    """Entries that don't fit: run_id, seq, problem. Checking is a lag and a digest, so it runs in parallel by run."""
    order = Window.partitionBy("run_id").orderBy("seq")
    due = F.coalesce(F.lag("hash").over(order), F.lit(START))
    digest = F.sha2(F.concat_ws("|", "prev", "run_id", F.col("seq").cast("string"), "body"), 256)
    problem = F.when(F.col("hash") != digest, "changed").when(F.col("prev") != due, "broken link").when(F.col("seq") != F.row_number().over(order), "missing entry")
    return log.withColumn("problem", problem).where("problem is not null").select("run_id", "seq", "problem")
