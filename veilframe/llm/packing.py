"""Best-fit packing by exact-complement hashing.

Every document becomes token ids plus an end id; only documents longer than a sequence are cut, into full pieces with
the shorter one first. Packing then needs only how many pieces there are of each length, a table of at most `capacity`
rows whatever the corpus. From long to short, a length's gap is looked up among the sums of one, two and three lengths
that are still to be had; a combination that fills the gap exactly is taken as often as its counts allow. A gap that no
combination fills takes the longest length that fits (best fit) and is looked up again. The result is a list of patterns
with multiplicities; pieces are dealt to the slots of the patterns by their rank within their length.

Cases: null text is empty (the end id alone); rows that repeat are packed as rows of their own; an empty table gives
no pieces; ids may be null and are only carried along.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, fresh, group_rank, hash31, slices
from veilframe.llm.tokens import encoder

CELL_ROWS = 4096


class Lengths:
    """Counts of pieces by length, with sums of one to three of them looked up in bit sets."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.cap = capacity
        self.count = [0] * (capacity + 1)
        self.have = self.mirror = 0  # bit x, and bit cap - x, for each length x that is left
        for x, n in counts.items():
            self.count[x] = n
            if n:
                self.have |= 1 << x
                self.mirror |= 1 << (capacity - x)

    def take(self, x: int, n: int) -> None:
        self.count[x] -= n
        if not self.count[x]:
            self.have &= ~(1 << x)
            self.mirror &= ~(1 << (self.cap - x))

    def longest(self, most: int) -> int:
        return (self.have & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else -1

    def pair(self, total: int) -> tuple[int, int] | None:
        """Two lengths of the given sum, the longest such first."""
        both = self.have & (self.mirror >> (self.cap - total)) & ((1 << total) - 1) & ~1
        while both:
            x = both.bit_length() - 1
            if 2 * x != total or self.count[x] > 1:
                return x, total - x
            both &= ~(1 << x)
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        """One, two or three lengths that are to be had and sum to gap."""
        if self.count[gap]:
            return (gap,)
        if two := self.pair(gap):
            return two
        left = self.have & ((1 << gap) - 1)
        while left:
            x = left.bit_length() - 1
            left &= ~(1 << x)
            if 3 * x < gap:
                return None  # the longest of three is at least a third
            self.count[x] -= 1
            gone = not self.count[x]
            if gone:
                self.count[x] += 1
                self.take(x, 1)
            two = self.pair(gap - x)
            self.count[x] += 1
            if gone:
                self.have |= 1 << x
                self.mirror |= 1 << (self.cap - x)
            if two:
                return x, *two
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths of one sequence) with the number of sequences of each."""
    left, out = Lengths(counts, capacity), []
    while (x := left.longest(capacity)) > 0:
        pattern, gap = [x], capacity - x
        rest = Lengths({}, capacity)
        rest.count, rest.have, rest.mirror = left.count, left.have, left.mirror
        taken = [x]
        rest.take(x, 1)
        while gap > 0:
            if (found := rest.fill(gap)) is None:
                longest = rest.longest(gap)
                found = (longest,) if longest > 0 else ()
            if not found:
                break
            for y in found:
                rest.take(y, 1)
                pattern.append(y)
                taken.append(y)
                gap -= y
        # the same pattern again, as often as the counts allow
        uses = Counter(pattern)
        more = min(rest.count[y] // n for y, n in uses.items())
        for y, n in uses.items():
            if more:
                rest.take(y, n * more)
        left = rest
        out.append((tuple(pattern), 1 + more))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted arrays: (length << 44) + first rank of a run of slots, first sequence, offset. A run has one slot in each
    of the pattern's sequences; ranks count from 0 within a length."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for pattern, times in patterns:
        offset = 0
        for x in pattern:
            rows.append(((x << 44) + used[x], sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3


def pieces(docs: DataFrame, path: str, *, kind: str = "bytes", end_id: int = 0, capacity: int = 2048, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row a piece: the columns keep, piece (from 0), start, length, ids (little-endian unsigned 32-bit)."""
    names = [fresh(keep, x) for x in ("piece", "start", "length", "ids")]
    text = fresh([*keep, *names], "tokenized_text")
    picked = docs.select(*keep, F.col(text_col).alias(text))
    end = end_id.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        own, row, number, start, length, ids, held = encoder(path, kind), [], [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            head = [c.take(pa.array(row, pa.int32())) for c in batch.columns[:-1]]
            return pa.RecordBatch.from_arrays([*head, pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], [*batch.schema.names[:-1], *names])

        for i, t in enumerate(batch.column(batch.num_columns - 1)):
            packed = own.encode(t.as_py() or "") + end
            n = len(packed) // 4
            cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                row.append(i)
                number.append(k)
                start.append(a)
                length.append(b - a)
                ids.append(packed[4 * a : 4 * b])
                held += b - a
            if held >= 1 << 21:
                yield flush()
                row, number, start, length, ids, held = [], [], [], [], [], 0
        if row:
            yield flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield from cut(b)

    kinds = ["int", "long", "long", "binary"]
    return arrow_map(picked, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), *(f"`{n}` {k}" for n, k in zip(names, kinds, strict=True))]))


def pack(parts: DataFrame, *, capacity: int = 2048, length_col: str = "length", spread: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """parts with sequence_id and offset. parts should be a saved table: it is read twice. Lengths are 1 to capacity."""
    counts = {r[0]: r[1] for r in parts.groupBy(length_col).count().collect()}  # at most capacity rows
    if bad := [x for x in counts if x is None or not 0 < x <= capacity]:
        raise ValueError(f"lengths outside 1 to {capacity}: {bad[:5]}")
    first, sequence, offset = slots(plan(counts, capacity))
    spark = parts.sparkSession
    length, cells, rank = (fresh(parts.columns, x) for x in ("group_length", "group_cells", "rank_in_length"))
    groups = spark.createDataFrame([(x, -(-n // CELL_ROWS)) for x, n in counts.items()] or [(1, 1)], f"{length} long, {cells} long")
    grouped = parts.withColumn(length, F.col(length_col).cast("long"))
    ranked = group_rank(grouped, F.broadcast(groups), [length], [F.col(c).asc_nulls_first() for c in spread], hash31(*[F.col(c) for c in spread]), cells, rank)
    ranked = ranked.select(*parts.columns, length, rank)
    shared = spark.sparkContext.broadcast((first, sequence, offset))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = shared.value
        for b in batches:
            n = b.num_columns
            key = (b.column(n - 2).to_numpy(zero_copy_only=False) << 44) + b.column(n - 1).to_numpy(zero_copy_only=False) - 1
            at = np.searchsorted(first, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[: n - 2], pa.array(sequence[at] + key - first[at]), pa.array(offset[at])], [*b.schema.names[: n - 2], "sequence_id", "offset"])

    return arrow_map(ranked, deal, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields), "sequence_id long", "offset long"]))
