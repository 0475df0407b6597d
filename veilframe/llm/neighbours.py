"""Nearest neighbours by inner product over shifted space-filling curves.

Vectors are lifted so that the largest inner product is the smallest distance (one more component makes all norms equal),
projected to `dims` directions by a seeded rotation of each ordering, shifted by a seeded offset and put in the order of
their Hilbert index. Each ordering is cut into ranges of the curve; a query meets the `reach` rows on either side of its
own place, also where they lie in a neighbouring range. What the windows of all orderings find is merged and reranked
with double-precision inner products of the original vectors.

How wide a window must be depends on the vectors: a few rows where they lie in clusters, a share of the table where they
fill all dimensions evenly. It is measured, not assumed: in a sample of at most `sample` vectors, the true neighbours of
`probes` of them are found by brute force, and reach is the distance on the curves within which `recall` of these lie in
at least one ordering, carried over to the whole table. The sample (bounded, in the driver) also gives the cuts of the
ranges; every vector is indexed, and none is dropped. Measured recall and work are stated in the README.

Equal vectors are one entry of the index, with the smallest `k + 1` of their ids: a query can need no more of them, so
a vector that a third of all rows share costs one row after partial aggregation. Windows compare half-precision copies;
whatever could be among the k best within their error goes on to the rerank.

Cases: null and zero vectors, and those with a null or non-finite component, take no part, as queries or otherwise; so
do rows with a null id and rows whose length is not that of most; rows that repeat an id with the same vector are one,
with another vector they are candidates of their own; ties go to the smaller id; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, save, slices

BITS = 6


def hilbert(x: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with integer coordinates of `bits` bits (Skilling's transform), as one unsigned integer."""
    x = x.astype(np.uint64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(n):
            up = (x[i] & np.uint64(q)) != 0
            t = np.where(up, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] ^= np.where(up, p, t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & np.uint64(q)) != 0, t ^ np.uint64(q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return out


def curve(vectors: np.ndarray, radius: float, ordering: int, dims: int, seed: int) -> np.ndarray:
    """The place of each vector on one curve, as a signed 64-bit integer."""
    rng = np.random.default_rng([seed, ordering])
    lifted = np.hstack([vectors, np.sqrt(np.maximum(radius**2 - (vectors**2).sum(1), 0))[:, None]]) / (radius or 1)
    directions, _ = np.linalg.qr(rng.standard_normal((lifted.shape[1], min(dims, lifted.shape[1]))))
    # coordinates of unit vectors, in standard deviations, shifted
    at = lifted @ directions * np.sqrt(lifted.shape[1]) / 3 + rng.uniform(-0.25, 0.25, directions.shape[1])
    cells = np.clip(((at + 1.25) / 2.5 * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
    return hilbert(cells, BITS).astype(np.int64)


def as_matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def calibrated(x: np.ndarray, keys: list[np.ndarray], near: int, probes: int, recall: float) -> float:
    """The share of the table on either side of a query that holds `recall` of its `near` best in at least one ordering."""
    n = len(x)
    asked = np.arange(0, n, max(1, n // probes))[:probes]
    scores = x[asked] @ x.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = min(near, n - 1)
    best = np.argpartition(-scores, near - 1, axis=1)[:, :near]
    apart = np.full(best.shape, n)
    for key in keys:
        place = np.empty(n, np.int64)
        place[np.argsort(key, kind="stable")] = np.arange(n)
        apart = np.minimum(apart, np.abs(place[best] - place[asked][:, None]))
    return (float(np.quantile(apart, recall)) + 1) / n


def met(rows: np.ndarray, entries: np.ndarray, norms: np.ndarray, asked: np.ndarray, names: np.ndarray, at: np.ndarray, reach: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(queries, entries): what could be among the k best of each query's window, queries in order of their place."""
    wide = rows.astype(np.float32)
    # few enough queries at a time for their places to be near one another
    size = int(np.clip(reach.max() * len(asked) // (4 * len(rows)), 1, 32))
    for i in range(0, len(asked), size):
        q, p, r = asked[i : i + size], at[i : i + size], reach[i : i + size]
        low, high = max(0, int((p - r).min())), min(len(rows), int((p + r).max()))
        if high <= low:
            continue
        scores = q @ wide[low:high].T
        # half-precision components are within 2^-11 of their size, or 2^-25 where they are tiny
        doubt = np.linalg.norm(q, axis=1)[:, None] * (norms[low:high] * 2.0**-10 + 2.0**-22)
        keep = min(k, high - low)
        edge = np.partition(scores - doubt, high - low - keep, axis=1)[:, high - low - keep]
        which, row = np.nonzero(scores + doubt >= edge[:, None])
        yield names[i : i + size][which], entries[low:high][row]


def search(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = 20, orderings: int = 24, dims: int = 8, recall: float = 0.92, sample: int = 16384, probes: int = 256, range_rows: int = 4096, seed: int = 7) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found to each vector whose id is divisible by `every`."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == size["n"]).distinct()
    # equal vectors: the smallest k + 1 ids, cut down before they are shuffled
    first = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= k + 1)
    index = save(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.min("id").alias("entry")), "ann-index")
    asked = save(rows.where(F.col("id") % every == 0).join(index.select("v", "entry"), "v").select("id", "entry"), "ann-queries")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, radius, largest = index.agg(F.count("*"), F.max(norm), F.max(F.array_max(F.transform("v", F.abs)))).first()
    radius = radius if np.isfinite(radius) else largest * size["n"] ** 0.5
    drawn = index.orderBy(F.xxhash64("entry"), "entry").limit(sample).select("v").toArrow()
    x = as_matrix(drawn.column("v").combine_chunks()) / radius
    keys = [curve(x, 1.0, o, dims, seed) for o in range(orderings)]
    share = calibrated(x, keys, max(1, round(k * len(x) / n)), probes, recall) if len(x) > 1 else 1.0
    reach = min(n, int(share * n) + 1)
    ranges = int(max(1, min(n // max(range_rows, 2 * reach), len(x) // 8)))
    ordered = [np.sort(key) for key in keys]
    cuts = [np.unique(key[[len(key) * i // ranges for i in range(1, ranges)]]) for key in ordered]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(o: int, zone, at, entry, span, data) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(o * ranges + zone, pa.int32()), pa.array(at), pa.array(entry), pa.array(span, pa.int64()), pa.array(data, pa.binary())], ["zone", "at", "entry", "reach", "data"])

        for b in slices(batches, 2048):
            y, entry, asks = as_matrix(b.column(0)) / radius, b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False)
            half, full = [r.tobytes() for r in y.astype(np.float16)], [r.tobytes() for r in y.astype(np.float32)]
            who = np.flatnonzero(asks)
            for o in range(orderings):
                at = curve(y, 1.0, o, dims, seed)
                zone = np.searchsorted(cuts[o], at, "right")
                yield out(o, zone, at, entry, np.full(len(at), -1), half)
                # a query also goes to the ranges before and after, as far as its window is likely to go into them
                near = np.searchsorted(ordered[o], at[who], "right") / len(ordered[o]) * n
                edges = np.concatenate([[0], np.searchsorted(ordered[o], cuts[o], "left") / len(ordered[o]) * n, [n]])
                for step in (-1, 0, 1):
                    to = zone[who] + step
                    ok = (to >= 0) & (to <= len(cuts[o]))
                    border = edges[np.clip(to + (step < 0), 0, len(edges) - 1)]
                    left = np.ceil(reach - (np.abs(near - border) if step else 0)).astype(np.int64) if step else np.full(len(who), reach)
                    ok &= left > 0
                    if ok.any():
                        yield out(o, to[ok], at[who][ok], entry[who][ok], left[ok], [full[i] for i in who[ok]])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
            at, entry, span = (np.concatenate([p[i] for p in parts]) for i in range(3))
            data = [d for p in parts for d in p[3]]
            stored, asking = np.flatnonzero(span < 0), np.flatnonzero(span >= 0)
            if not len(stored) or not len(asking):
                return
            held = np.frombuffer(b"".join(data[i] for i in stored), np.float16).reshape(len(stored), -1)
            qs = np.frombuffer(b"".join(data[i] for i in asking), np.float32).reshape(len(asking), -1)
            norms = np.linalg.norm(held.astype(np.float32), axis=1)
            for q, e in met(held, entry[stored], norms, qs, entry[asking], np.searchsorted(at[stored], at[asking]), span[asking], k + 1):
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(e)], ["q", "entry"])

        parts, zone = [], None
        for b in batches:  # sorted by zone and place; a zone is a range of one curve
            zones = b.column(0).to_numpy()
            bounds = np.flatnonzero(np.diff(zones)) + 1
            for low, high in zip([0, *bounds], [*bounds, len(zones)], strict=True):
                if low == high:
                    continue
                if zone is not None and zones[low] != zone:
                    yield from done(parts)
                    parts = []
                zone, cut = zones[low], b.slice(low, high - low)
                parts.append((*(cut.column(i).to_numpy() for i in (1, 2, 3)), cut.column(4).to_pylist()))
        if parts:
            yield from done(parts)

    flagged = index.join(asked.select(F.col("entry").alias("of")).distinct(), F.col("entry") == F.col("of"), "left").select("v", "entry", F.col("of").isNotNull().alias("asks"))
    zoned = arrow_map(flagged, place, "zone int, at long, entry long, reach long, data binary")
    total = orderings * ranges
    zoned = zoned.repartition(int(min(total, 20_000)), "zone").sortWithinPartitions("zone", "at", "reach")
    pairs = save(arrow_map(zoned, windows, "q long, entry long").distinct(), "ann-pairs")
    mine = index.select(F.col("entry").alias("q"), F.col("v").alias("qv"))
    product = F.aggregate(F.zip_with("v", "qv", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = pairs.join(index, "entry").join(mine, "q").select("q", F.explode("ids").alias("id"), product.alias("score"))
    best = scored.withColumn("nth", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).where(F.col("nth") <= k + 1)
    listed = best.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("nth", F.col("id").alias("vec_id"), "score"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("id")), 1, k)
    answers = asked.join(listed, F.col("entry") == F.col("q")).select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "f"))
    return answers.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), "f.vec_id", "f.score")
