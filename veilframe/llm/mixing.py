"""Mixing sources to target weights by systematic sampling (DataFrame operations only).

Every document of a source is expected target / source_size times. The expected copies are prefix-summed over the
source's documents, one offset is added to the sums, and a document is emitted once for each integer its stretch
crosses. Sums are whole numbers of 2^-24, so copies never differ by rounding and reruns agree.

Within a source, documents follow one another by size inside cells of a few thousand (see group_rank); so long and
short documents get their share and the words taken stay near the target, while no task sorts a whole source.

Cases: null text or source_col is size 0 / a source of its own, last in order; a source without words has target 0
and emits nothing; rows that repeat are documents in their own right; an empty table gives an empty one; other
columns are carried along and never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import WORD_PATTERN, fresh, group_rank, hash31

UNIT = 1 << 24
CELL_ROWS = 4096
MOST_CELLS = 65536


def source_targets(sized: DataFrame, source_col: str, size: str, weights: tuple[int, ...], cap: int, seed: str) -> DataFrame:
    """One row a source: source_size, target (weighted share of all words, held at cap times the source's words, the
    excess reshared by weight), step (expected copies, in 2^-24), offset (in 2^-24), cells."""
    wide = "decimal(38,0)"
    sources = sized.groupBy(source_col).agg(F.sum(size).alias("source_size"), F.count("*").alias("rows"))
    place = Window.orderBy(F.col(source_col).asc_nulls_last())
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(place) - 1) % len(weights) + 1).cast("int")).cast("long"))
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = Window.partitionBy(F.lit(0)).orderBy(F.col("source_size") * cap / F.col("weight"), F.col(source_col).asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumns({"words": F.sum("source_size").over(every), "weights": F.sum("weight").over(every)})
    sources = sources.withColumns({"held_before": F.coalesce(F.sum(F.col("source_size") * cap).over(earlier), F.lit(0)), "weight_before": F.coalesce(F.sum("weight").over(earlier), F.lit(0))})
    held = F.col("source_size").cast(wide) * cap * (F.col("weights") - F.col("weight_before")) <= F.col("weight").cast(wide) * (F.col("words") - F.col("held_before"))
    sources = sources.withColumn("held", held)
    sources = sources.withColumns({"held_words": F.sum(F.when(F.col("held"), F.col("source_size") * cap).otherwise(0)).over(every), "held_weight": F.sum(F.when(F.col("held"), F.col("weight")).otherwise(0)).over(every)})
    level = (F.col("weight") * (F.col("words") - F.col("held_words"))).cast("double") / (F.col("weights") - F.col("held_weight")).cast("double")
    sources = sources.withColumn("target", F.when(F.col("held"), (F.col("source_size") * cap).cast("double")).otherwise(level))
    step = F.when(F.col("held"), F.lit(cap * UNIT).cast("long")).otherwise(F.least(F.floor(F.col("target") / F.col("source_size") * UNIT), F.lit(cap * UNIT).cast("long")))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("null")))), 1, 6), 16, 10).cast("long")
    cells = F.least(F.lit(MOST_CELLS), F.ceil(F.col("rows") / CELL_ROWS))
    return sources.select(source_col, "source_size", "target", F.when(F.col("source_size") > 0, step).otherwise(0).cast("long").alias("step"), offset.alias("offset"), cells.cast("long").alias("cells"))


def mix(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix-1", names: dict[str, str] | None = None) -> DataFrame:
    """docs with five more columns: size (words), source_size, target, copies, taken (copies * size).

    names renames the added columns where docs has columns of these names already.
    """
    added = {x: x for x in ("size", "source_size", "target", "copies", "taken")} | (names or {})
    own = {x: fresh([*docs.columns, *added.values()], f"mix_{x}") for x in ("size", "source_size", "target", "step", "offset", "cells", "rank")}
    sized = docs.withColumn(own["size"], F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_PATTERN)).cast("long"))
    narrow = sized.select(F.col(source_col).alias("source"), F.col(own["size"]).alias("size"))
    targets = source_targets(narrow, "source", "size", weights, cap, seed).withColumnsRenamed({x: own[x] for x in ("source_size", "target", "step", "offset", "cells")} | {"source": source_col})
    ranked = group_rank(sized, targets, [source_col], [own["size"], F.col(id_col).asc_nulls_first()], hash31(F.col(id_col)), own["cells"], own["rank"])
    crossed = lambda k: F.shiftright(k * F.col(own["step"]) + F.col(own["offset"]), 24)
    copies = crossed(F.col(own["rank"])) - crossed(F.col(own["rank"]) - 1)
    out = ranked.withColumns({added["size"]: F.col(own["size"]), added["source_size"]: F.col(own["source_size"]), added["target"]: F.col(own["target"]), added["copies"]: copies, added["taken"]: copies * F.col(own["size"])})
    return out.select(*docs.columns, *added.values())


def emit(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken."""
    names = {x: fresh(docs.columns, f"mixed_{x}") for x in ("size", "source_size", "target", "copies", "taken")}
    times = F.explode(F.sequence(F.lit(1), F.col(names["copies"]).cast("int"))).alias(fresh(docs.columns, "copy_no"))
    return mix(docs, names=names, **options).where(F.col(names["copies"]) > 0).select(*docs.columns, times).select(*docs.columns)
