"""Streams: daily activity with late events, and conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def daily(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events and value by day and type; works on a stream (with a watermark) and on a table alike."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks need the type with a time zone
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", "total")


def conversation_numbers(found: DataFrame) -> DataFrame:
    """A stream of (conv_id, entity_type, norm) -> (conv_id, entity_type, norm, number): numbers of values hold from
    prompt to prompt, kept as state per conversation."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for pdf in batches:
            for entity, norm in zip(pdf["entity_type"], pdf["norm"], strict=True):
                name = f"{entity}\x1f{norm}"
                if name not in known:
                    known[name] = 1 + sum(x.startswith(f"{entity}\x1f") for x in known)
                out.append((key[0], entity, norm, known[name]))
        state.update((list(known), list(known.values())))
        yield pd.DataFrame(out, columns=["conv_id", "entity_type", "norm", "number"])

    return found.groupBy("conv_id").applyInPandasWithState(step, "conv_id long, entity_type string, norm string, number long", "names array<string>, numbers array<long>", "append", GroupStateTimeout.NoTimeout)
