"""Places and running sums inside groups, in order, without ever holding a group in one task.

Rows are dealt to tasks by ranges of (group, order), so a group of any size is cut into as many ranges as it needs. A
task counts from where its range begins; only the group that a range begins with may have started in an earlier one, so
one number a task, and not one a group, is added afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, fresh, save

#: Running sums are taken modulo 2^62, so that two of them add up within a long.
MASK = (1 << 62) - 1


def starts_of(column: pa.Array, before: pa.Array | None) -> np.ndarray:
    """Which rows begin a group; before: the last row of the previous batch. Nulls are one group."""
    whole = pa.concat_arrays([before, column]) if before is not None else pa.concat_arrays([column[:1], column])
    a, b = whole[1:], whole[:-1]
    other = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
    out = other.to_numpy(zero_copy_only=False)
    if before is None:
        out = out.copy()
        out[0] = True
    return out


def summed(x: np.ndarray, begins: np.ndarray, carry: np.uint64) -> np.ndarray:
    """Sums of x from the begin of each group on, modulo 2^64; carry: what the group at hand had before this batch."""
    total = np.cumsum(x, dtype=np.uint64)
    at = np.flatnonzero(begins)
    bases = np.concatenate([[np.uint64(0) - carry], total[at] - x[at]]).astype(np.uint64)
    return total - bases[np.cumsum(begins)]


def running(df: DataFrame, group: str, order: Sequence[str], place: str = "place", sums: Sequence[str] = (), name: str = "ranked") -> DataFrame:
    """df, saved, with `place`: from 1, the place of a row in its group by `order` (nulls first); and with each column of `sums`
    (longs from 0 to MASK) replaced by its sum over the group up to this row, modulo 2^62.

    Rows that tie in `order` get places in any order, but keep them. Null groups are one group. No rows: no rows.
    """
    part, opened, last = (fresh(df.columns, x) for x in ("part_no", "opened", "is_last"))
    kind = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in df.columns), f"`{place}` long, `{part}` long, `{opened}` boolean, `{last}` boolean"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no, before, first, held = TaskContext.get().partitionId(), None, True, None
        carry = dict.fromkeys([place, *sums], np.uint64(0))
        for b in batches:
            if not b.num_rows:
                continue
            column = b.column(group)
            begins = starts_of(column, before)
            groups = np.cumsum(begins)
            here = groups <= 1 if before is None else (groups == 0) & first
            first, before = bool(here[-1]), column[-1:]
            columns = {c: b.column(c) for c in b.schema.names}
            for c in (place, *sums):
                x = np.ones(b.num_rows, np.uint64) if c == place else columns[c].to_numpy(zero_copy_only=False).astype(np.uint64)
                out = summed(x, begins, carry[c]) & np.uint64(MASK)
                carry[c], columns[c] = out[-1], pa.array(out.astype(np.int64))
            n = b.num_rows
            columns |= {part: pa.array(np.full(n, no, np.int64)), opened: pa.array(here), last: pa.array(np.zeros(n, bool))}
            if held is not None:
                yield pa.RecordBatch.from_pydict(held)
            held = columns
        if held is not None:
            end = np.zeros(len(held[part]), bool)
            end[-1] = True
            yield pa.RecordBatch.from_pydict(held | {last: pa.array(end)})

    keys = [group, *order]
    walked = save(arrow_map(df.repartitionByRange(*keys).sortWithinPartitions(*keys), walk, schema), name)
    # the group that a task begins with has, in each earlier task that ends with it, as much as that one's last row says
    counted = [place, *sums]
    ends = walked.where(F.col(last)).select(part, group, *counted)
    begun = walked.where(F.col(opened)).groupBy(part, group).agg(*[F.lit(0).cast("long").alias(c) for c in counted])
    both = ends.unionByName(begun).groupBy(part, group).agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in counted])
    earlier = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    more = {c: fresh([*walked.columns, *counted], f"more_{c}") for c in counted}
    offsets = both.select(F.col(part).alias("at_part"), F.col(group).alias("at_group"), *[(F.coalesce(F.sum(c).over(earlier), F.lit(0)).cast("decimal(38,0)") % F.lit(MASK + 1)).cast("long").alias(more[c]) for c in counted])
    # one row a task, so the side that is sent to all tasks is as small as the list of tasks
    offsets = offsets.join(begun.select(F.col(part).alias("of_part"), F.col(group).alias("of_group")), F.expr("at_part = of_part AND at_group <=> of_group")).select("at_part", *more.values())
    out = walked.join(F.broadcast(offsets), (F.col(part) == F.col("at_part")) & F.col(opened), "left")
    moved = {c: (F.col(c) + F.coalesce(F.col(more[c]), F.lit(0))).bitwiseAND(F.lit(MASK)).alias(c) for c in counted}
    return out.select(*[moved.get(c, F.col(c)) for c in df.columns], moved[place])
