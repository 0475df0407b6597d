"""SimHash near-duplicates: fingerprints of word shingles, linked when they differ in few bits, or when the sets of
shingles behind them are similar.

near_duplicates links 64-bit fingerprints at `distance` bits or less. Pigeonhole: 64 bits are cut into `distance + 2`
blocks; two fingerprints within `distance` agree on at least two whole blocks, so all such pairs meet on some pair of
blocks (a key of about 32 bits), where Hamming distance is verified. Only distinct fingerprints take part, so exact
copies cost one row. A key that more than PAIRS fingerprints share is not paired off: its members are instead joined on
the points at distance one or less (in the bits that the key leaves open). Two of them share such a point exactly when
they are within two bits, so this loses no link, and it takes rows in proportion to the members.

near_copies links sets of shingles with a Jaccard similarity of at least `similarity`. At 0.8 some ten of 64 bits differ,
which no few blocks of 64 bits survive, so the fingerprint is made longer and cut into as many blocks as it takes for a
pair at exactly `similarity` to agree on a whole one with a chance of `recall` (closer pairs do so practically always).
A block is as long as the number of rows asks for, so pairs that meet by chance stay in proportion to the rows. Pairs
on a block are verified by Hamming distance (64 further bits, 4 standard deviations wide), then on the sets themselves.
A member whose set is too large or too small for every other of its block can be similar to none and is left out there.
First each member of a block meets the first and the one before it alone; the sets of its best partner decide, and form
components. Then, in blocks that hold several components, all members of different ones meet: in slices of SLICE rows,
each slice with each, so that no task holds more than two slices; first by size and 64 bits, as narrow lists, and those who
have someone plausible beside them by their whole fingerprints. At
first only the nearest of another component is verified for each member, and components grow; once that joins nothing (or
after ROUNDS), all that are left and about as near as wanted are verified. As components only grow, a member of a block
that has no one of another component about as near as wanted will have none later: it goes on in that block no more, so
whole fingerprints of chance meetings are moved once.

Cases: null text is empty text; texts without words have fingerprint zero and the empty set, and link like any other;
rows with a null id take part and never name a component (a component of nothing else has null); repeated rows link to
each other; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, drop_saved, fresh, save, slices, utf8
from veilframe.llm.components import components

SEED = 42
PAIRS = 64
#: Members of a block that are compared in one piece.
SLICE = 256
ROUNDS = 3
#: Pairs that are compared at a time.
FACING = 1 << 14
#: Shingles hashed at a time, so that very long texts take bounded memory.
CHUNK = 1 << 18


def shingle_hashes(words: list[bytes], size: int) -> Iterator[np.ndarray]:
    """XXH64 of every run of `size` words (fewer words: of the whole sequence), in order, by chunks."""
    if not words:
        return
    n = max(1, len(words) - size + 1)
    for low in range(0, n, CHUNK):
        part = words[low : low + CHUNK + size - 1]
        ends = list(accumulate(map(len, part), lambda at, k: at + k + 1))
        text, span = b" ".join(part), min(size, len(part))
        starts = [0, *(e + 1 for e in ends)]
        yield np.fromiter((xxhash.xxh64_intdigest(text[a:b], SEED) for a, b in zip(starts, ends[span - 1 :], strict=False)), np.uint64)


def fingerprint(text: bytes, size: int = 3) -> int:
    """The SimHash of one text, as an unsigned 64-bit integer."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text.lower().split(), size):
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(ones * 2 > n).view(">u8")[0]) if n else 0


def fingerprints(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), size: int = 3, name: str = "fp") -> DataFrame:
    """The columns keep of docs, and the fingerprint as a (signed) long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            values = np.array([fingerprint(t, size) for t in utf8(b.column(b.num_columns - 1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(values)], [*b.schema.names[:-1], name])

    text = fresh(keep, "shingled_text")
    picked = docs.select(*keep, F.col(text_col).alias(text))
    return arrow_map(picked, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), f"`{name}` long"]))


def blocks(bits: int, n: int) -> list[int]:
    """n masks that cut `bits` bits into runs as even as can be."""
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, distance: int = 2) -> DataFrame:
    """prints (fp), distinct -> edges (a, b) whose components are those of all pairs within `distance` bits."""
    if distance > 2:
        raise ValueError("crowded keys are exact for a distance of at most 2")
    masks = [a | b for a, b in combinations(blocks(64, distance + 2), 2)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)]))
    keyed = save(prints.select("fp", keys.alias("k")).select("fp", "k.t", "k.key"), "blocks")
    sizes = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    few, many = sizes.where(F.col("n") <= PAIRS).drop("n"), sizes.where(F.col("n") > PAIRS).drop("n")
    paired = keyed.join(few, ["t", "key"], "left_semi")
    left, right = paired.select("t", "key", F.col("fp").alias("a")), paired.select("t", "key", F.col("fp").alias("b"))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)).select("a", "b")
    crowded = keyed.join(many, ["t", "key"], "left_semi")
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(64) if not m >> i & 1]) for m in masks]), F.col("t") + 1)
    points = crowded.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("point")).distinct()
    centres = points.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(centres, "point").select(F.col("fp").alias("a"), "b").where("a <> b")
    return pairs.unionAll(stars)


def near_duplicates(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 3, distance: int = 2) -> DataFrame:
    """One row a row of docs: id_col, fp (long), root (the component's name, a fingerprint), component_id (its smallest id)."""
    rows = save(fingerprints(docs, text_col, (id_col,), size), "fingerprints")
    prints = save(rows.groupBy("fp").agg(F.min(id_col).alias("least")), "prints")
    named = prints.join(components(links(prints.select("fp"), distance)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = save(named, "named")
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.drop("least").join(smallest, "root"), "fp").select(id_col, "fp", "root", "component_id")


def layout(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a block, and how many blocks it takes for n rows."""
    bits = max(12, math.ceil(math.log2(max(2, n))) + 2)
    # equally large sets at this similarity have this cosine; a bit differs with the angle's share of a half turn
    same = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles of a text, sorted, as 32 bits of their hashes."""
    parts = [h.astype(np.uint32) for h in shingle_hashes(text.lower().split(), size)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint32)


def wide_bits(shingles: np.ndarray, words: int) -> np.ndarray:
    """64 * words fingerprint bits of a set: 1 where more than half of the shingles' hashes have it."""
    ones, rng = np.zeros(words * 64, np.int64), np.random.default_rng(29)
    flips, factors = rng.integers(0, 1 << 64, words, np.uint64), rng.integers(0, 1 << 64, words, np.uint64) | np.uint64(1)
    lanes = np.uint64(0x0101010101010101)
    for low in range(0, len(shingles), 255 * 8):
        x = (shingles[low : low + 255 * 8].astype(np.uint64)[:, None] ^ flips) * factors
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        # each bit of a byte is counted in a byte of its own, over 255 rows at most
        parts = [np.add.reduceat((x >> np.uint64(k)) & lanes, np.arange(0, len(x), 255), axis=0) for k in range(8)]
        counts = np.stack([p.view(np.uint8).reshape(len(p), words, 8) for p in parts], axis=3)
        ones += counts.sum(axis=0, dtype=np.int64).reshape(-1)
    return ones * 2 > len(shingles)


def sketches(docs: DataFrame, text_col: str, keep: tuple[str, ...], size: int, bits: int, blocks_: int, name: str, full: bool = True) -> DataFrame:
    """The columns keep of docs, a long that stands for the shingle set, and (if full) its members, their number, 64 bits
    to choose by, the whole fingerprint and the keys of all blocks."""
    words = 1 + -(-bits * blocks_ // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.uint64(1) << np.arange(bits, dtype=np.uint64)
        tags = np.arange(blocks_, dtype=np.uint64) << np.uint64(bits)
        for b in slices(batches, 128):
            own = [shingle_set(t, size) for t in utf8(b.column(b.num_columns - 1))]
            cols, names = [pa.array([xxhash.xxh64_intdigest(s.tobytes()) for s in own], pa.uint64()).view(pa.int64())], [name]
            if full:
                all_bits = [wide_bits(s, words) for s in own]
                check = np.array([np.packbits(x[:64]).view(np.uint64)[0] for x in all_bits], np.uint64).view(np.int64)
                keys = [((x[64 : 64 + bits * blocks_].reshape(blocks_, bits) @ powers) | tags).view(np.int64) for x in all_bits]
                wide = [np.packbits(x).tobytes() for x in all_bits]
                cols += [pa.array([s.tobytes() for s in own], pa.binary()), pa.array(map(len, own), pa.int32()), pa.array(check), pa.array(wide, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                names += ["members", "n", "bits", "wide", "keys"]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], [*b.schema.names[:-1], *names])

    text = fresh(keep, "shingled_text")
    picked = docs.select(*keep, F.col(text_col).alias(text))
    more = ["members binary", "n int", "bits long", "wide binary", "keys array<long>"] if full else []
    return arrow_map(picked, run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), f"`{name}` long", *more]))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, members) are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            good = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left, right = (sets.select(F.col("node").alias(s), F.col("members").alias(f"members_{s}")) for s in ("a", "b"))
    return arrow_map(pairs.join(left, "a").join(right, "b").select("a", "b", "members_a", "members_b"), run, "a long, b long")


def most_apart(bits: int, similarity: float, deviations: float) -> int:
    """So many of `bits` bits may differ: those expected at this similarity, and some standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * share + deviations * math.sqrt(bits * share * (1 - share)))


def facing(met: DataFrame, similarity: float, bits: int, blocks_: int, nearest: bool) -> DataFrame:
    """Pairs (key, a, b, d) across two slices of a block (key, left, right: node, n, root, wide; without right, within one)
    that lie in different components and whose whole fingerprints differ in few enough bits (d), as 99 of 100 pairs at this
    similarity; with nearest, of each member only the nearest. A pair that shares several blocks is told in the first."""
    single = "right" not in met.columns

    def first(who: np.ndarray, apart: np.ndarray) -> np.ndarray:
        """Where each of who comes first by apart."""
        order = np.lexsort((apart, who))
        return order[np.concatenate([[True], who[order][1:] != who[order][:-1]])] if len(order) else order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            key = b.column(0).to_numpy()
            both = [b.column(1), b.column(1 if single else 2)]
            sides, sizes = [x.flatten() for x in both], [pc.list_value_length(x).to_numpy().astype(np.int64) for x in both]
            (p, pn, pr), (q, qn, qr) = [[side.field(k).to_numpy() for k in ("node", "n", "root")] for side in sides]
            pw, qw = [np.frombuffer(b"".join(side.field("wide").to_pylist()), np.uint64).reshape(len(side), -1) for side in sides]
            most = most_apart(pw.shape[1] * 64, similarity, 2.33)
            at = [np.cumsum(x) - x for x in sizes]
            pairs = sizes[0] * sizes[1]
            # as many rows at a time as have some ten thousand pairs
            cuts = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + FACING, FACING), "left")
            cuts = np.unique(np.concatenate([[0], cuts, [len(pairs)]]))
            for low, high in zip(cuts, cuts[1:], strict=False):
                of = np.repeat(np.arange(low, high), pairs[low:high])
                inner = np.arange(len(of)) - np.repeat(np.cumsum(pairs[low:high]) - pairs[low:high], pairs[low:high])
                i, j = at[0][of] + inner // sizes[1][of], at[1][of] + inner % sizes[1][of]
                ok = (pr[i] != qr[j]) & (np.minimum(pn[i], qn[j]) >= similarity * np.maximum(pn[i], qn[j]))
                if single:
                    ok &= i < j
                i, j, of = i[ok], j[ok], of[ok]
                differ = pw[i] ^ qw[j]
                apart = np.bitwise_count(differ).sum(axis=1)
                near = np.flatnonzero(apart <= most)
                each = np.unpackbits(differ[near].view(np.uint8).reshape(len(near), pw.shape[1] * 8), axis=1)[:, 64 : 64 + bits * blocks_]
                near = near[each.reshape(len(near), blocks_, bits).any(axis=2).argmin(axis=1) == key[of[near]] >> bits]
                i, j, of, apart = i[near], j[near], of[near], apart[near]
                if nearest:
                    own = np.unique(np.concatenate([first(i, apart), first(j, apart)]))
                    i, j, of, apart = i[own], j[own], of[own], apart[own]
                if len(i):
                    yield pa.RecordBatch.from_arrays([pa.array(key[of]), pa.array(np.minimum(p[i], q[j])), pa.array(np.maximum(p[i], q[j])), pa.array(apart.astype(np.int32))], ["key", "a", "b", "d"])

    return arrow_map(met.select("key", "left", *([] if single else ["right"])), run, "key long, a long, b long, d int")


def plausible(met: DataFrame, similarity: float) -> DataFrame:
    """key, left, right (as meeting has them: lists of node, n, root, bits; without right, within one) -> key, node, n, root of those
    that have a member of another component beside them, of about their size and near enough in 64 bits."""
    single, most = "right" not in met.columns, most_apart(64, similarity, 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 512):
            key = b.column(0).to_numpy()
            sides = [b.column(k).flatten() for k in ((1, 1) if single else (1, 2))]
            sizes = [pc.list_value_length(b.column(k)).to_numpy().astype(np.int64) for k in ((1, 1) if single else (1, 2))]
            (p, pn, pr, pb), (q, qn, qr, qb) = [[side.field(k).to_numpy() for k in ("node", "n", "root", "bits")] for side in sides]
            at = [np.cumsum(x) - x for x in sizes]
            pairs = sizes[0] * sizes[1]
            cuts = np.searchsorted(np.cumsum(pairs), np.arange(0, pairs.sum() + FACING, FACING), "left")
            cuts = np.unique(np.concatenate([[0], cuts, [len(pairs)]]))
            keep = [np.zeros(len(p), bool), np.zeros(len(q), bool)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                of = np.repeat(np.arange(low, high), pairs[low:high])
                inner = np.arange(len(of)) - np.repeat(np.cumsum(pairs[low:high]) - pairs[low:high], pairs[low:high])
                i, j = at[0][of] + inner // sizes[1][of], at[1][of] + inner % sizes[1][of]
                ok = np.flatnonzero(pr[i] != qr[j])
                i, j = i[ok], j[ok]
                near = (np.bitwise_count((pb[i] ^ qb[j]).view(np.uint64)) <= most) & (np.minimum(pn[i], qn[j]) >= similarity * np.maximum(pn[i], qn[j]))
                keep[0][i[near]] = keep[1][j[near]] = True
            # within one list, both sides are the same members
            for side, size, good in [(sides[0], sizes[0], keep[0] | keep[1])] if single else zip(sides, sizes, keep, strict=True):
                if good.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(key, size)[good]), *(side.field(k).filter(pa.array(good)) for k in ("node", "n", "root"))], ["key", "node", "n", "root"])

    return arrow_map(met.select("key", "left", *([] if single else ["right"])), run, "key long, node long, n int, root long")


def facing_blocks(placed: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """key, node, n, root of the members of blocks (placed: these, many and bits) that have someone plausible of another component
    beside them. Blocks, and slices of large ones, are put together once, as lists of narrow rows; those of one component
    alone are left out as lists, and only members that come through are rows again. With them, the saved slices, to be dropped."""
    cut = F.pmod(F.xxhash64("node"), F.col("of")).cast("int")
    own = F.collect_list(F.struct("node", "n", "root", "bits"))
    sliced = placed.withColumn("of", F.ceil(F.col("many") / SLICE)).groupBy("key", "of", cut.alias("slice")).agg(own.alias("left"), F.min("root").alias("low"), F.max("root").alias("high"))
    parts = save(sliced.where("of > 1 OR low <> high"), "narrow-slices")
    large = parts.where("of > 1")
    right = large.select("key", F.col("slice").alias("r"), F.col("left").alias("right"), F.col("low").alias("r_low"), F.col("high").alias("r_high"))
    crossed = large.join(right, "key").where((F.col("slice") <= F.col("r")) & (F.least("low", "r_low") != F.greatest("high", "r_high")))
    # a member of a large block comes through once a slice at most
    return plausible(parts.where("of = 1"), similarity).unionAll(plausible(crossed, similarity).distinct()), parts


def meeting(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What meets in blocks (rows: key, many, node, n, root, wide), as facing takes it: blocks of up to SLICE members, each
    within itself; of larger ones, slices each with each; and the saved slices, to be dropped. What is of one component alone
    is left out as lists."""
    own, ends = F.collect_list(F.struct("node", "n", "root", "wide")), [F.min("root").alias("low"), F.max("root").alias("high")]
    alone = rows.where(F.col("many") <= SLICE).groupBy("key").agg(own.alias("left"), *ends).where("low <> high").select("key", "left")
    cut = F.pmod(F.xxhash64("node"), F.ceil(F.col("many") / SLICE)).cast("int")
    parts = save(rows.where(F.col("many") > SLICE).groupBy("key", cut.alias("slice")).agg(own.alias("rows"), *ends), "block-slices")
    left, right = (parts.select("key", *(F.col(c).alias(f"{side}_{c}") for c in ("slice", "low", "high")), F.col("rows").alias(side)) for side in ("left", "right"))
    crossed = left.join(right, "key").where((F.col("left_slice") <= F.col("right_slice")) & (F.least("left_low", "right_low") != F.greatest("left_high", "right_high")))
    return alone, crossed.select("key", "left", "right"), parts


def best_of(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, d) the nearest of each member: a, b, distinct."""
    either = pairs.select("a", "d", F.col("b").alias("to")).unionAll(pairs.select("b", "d", "a"))
    best = either.groupBy("a").agg(F.min(F.struct("d", "to")).alias("m"))
    return best.select(F.least("a", "m.to").alias("a"), F.greatest("a", "m.to").alias("b")).distinct()


def similar(sets: DataFrame, similarity: float, bits: int, blocks_: int) -> DataFrame:
    """sets (node, members, n, bits, wide, keys), distinct nodes -> (node, root): the components of all similar pairs that
    share a block. Nodes without links don't appear."""
    block = Window.partitionBy("key")
    by_size = block.orderBy("n")
    keyed = sets.select("node", "n", "bits", F.explode("keys").alias("key"))
    keyed = keyed.withColumns({"less": F.lag("n").over(by_size), "more": F.lead("n").over(by_size)})
    # the next smaller and the next larger set are the likeliest to be about as large
    keyed = keyed.where((F.col("less") >= similarity * F.col("n")) | (F.col("n") >= similarity * F.col("more")))
    keyed = save(keyed.select("key", "node", "n", "bits", F.count("*").over(block).alias("many")), "block-keys")
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", "key"), "node")
    own = F.struct("node", "n", "bits")
    beside = keyed.withColumns({"head": F.first(own).over(order), "before": F.lag(own).over(order)})
    beside = beside.select("node", "n", "bits", F.explode(F.array("head", "before")).alias("o")).where("o is not null and node <> o.node")
    apart = F.bit_count(F.col("bits").bitwiseXOR(F.col("o.bits")))
    # sets of very different sizes cannot be similar
    alike = (F.least("n", "o.n") >= similarity * F.greatest("n", "o.n")) & (apart <= most_apart(64, similarity, 4))
    pairs = beside.where(alike).select(F.least("node", "o.node").alias("a"), F.greatest("node", "o.node").alias("b"), apart.alias("d")).distinct()
    best = save(best_of(pairs), "best-pairs")
    edges = save(verified(best, sets, similarity), "near-links")
    drop_saved(best)
    roots, last, placed = save(components(edges), "near-roots"), False, None
    for turn in range(ROUNDS + 1):
        last = last or turn == ROUNDS
        by = roots.withColumnRenamed("node", "of")
        if placed is None:
            rooted = keyed.join(by, F.col("node") == F.col("of"), "left").select("key", "node", "n", "many", "bits", F.coalesce("root", "node").alias("root"))
            through, narrow = facing_blocks(rooted, similarity)
            found = save(through, "plausible")
            crowd = found.groupBy("key").agg(F.count("*").alias("many"))
            # the only place where whole fingerprints come to rows of blocks; later turns take them along
            placed = save(found.join(crowd, "key").join(sets.select("node", "wide"), "node"), "placed")
            for done in (narrow, found, keyed):
                drop_saved(done)
            rooted = placed
        else:
            rooted = placed.drop("root").join(by, F.col("node") == F.col("of"), "left").select("key", "node", "n", "many", "wide", F.coalesce("root", "node").alias("root"))
        alone, crossed, parts = meeting(rooted)
        faced = facing(alone, similarity, bits, blocks_, not last).unionAll(facing(crossed, similarity, bits, blocks_, not last))
        if last:
            found = save(faced.select("a", "b").distinct(), "other-pairs")
        else:
            near = save(faced, "nearest")
            found = save(best_of(near), "other-pairs")
        more = save(verified(found, sets, similarity), "near-links")
        for done in (parts, found):
            drop_saved(done)
        linked = not more.isEmpty()
        if linked:
            edges = edges.unionAll(more)
            before, roots = roots, save(components(edges), "near-roots")
            drop_saved(before)
        if last:
            break
        # who has no one near now will have none later
        alive = near.select("key", F.col("a").alias("node")).unionAll(near.select("key", "b")).distinct()
        still = placed.join(alive, ["key", "node"], "left_semi")
        before, placed = placed, save(still.drop("many").join(alive.groupBy("key").agg(F.count("*").alias("many")), "key"), "placed")
        for done in (before, near):
            drop_saved(done)
        if placed.isEmpty():
            break
        # when nothing nearest is near enough, what else is left is looked at once
        last = not linked
    drop_saved(placed)
    return roots


def near_copies(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """One row a row of docs: id_col, fp (long, the shingle set), root (the component's name), component_id (its smallest id)."""
    bits, blocks_ = layout(docs.count(), similarity, recall)
    sketched = save(sketches(docs, text_col, (id_col,), size, bits, blocks_, "fp"), "sketches")
    rows = save(sketched.select(id_col, "fp"), "row-prints")
    prints = save(rows.groupBy("fp").agg(F.min(id_col).alias("least"), F.count("*").alias("copies")), "prints")
    # of the rows with one set, the first by id has it (by chance where ids are null or repeated)
    chosen = sketched.join(prints.withColumnRenamed("fp", "of"), (F.col("fp") == F.col("of")) & F.col(id_col).eqNullSafe(F.col("least")))
    once = chosen.where("copies = 1").unionByName(chosen.where("copies > 1").dropDuplicates(["fp"]))
    sets = save(once.select(F.col("fp").alias("node"), "members", "n", "bits", "wide", "keys"), "sets")
    drop_saved(sketched)
    named = prints.join(similar(sets, similarity, bits, blocks_), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = save(named, "named")
    drop_saved(sets)
    smallest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select(id_col, "fp").join(named.drop("least").join(smallest, "root"), "fp").select(id_col, "fp", "root", "component_id")


def keep_one(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", size: int = 5, similarity: float = 0.8, recall: float = 0.95) -> DataFrame:
    """docs with one row of each component of near copies: a row with its smallest id (of a component without ids, any row).

    Only narrow rows are linked; the texts are shuffled once, by id.
    """
    groups = save(near_copies(docs, text_col=text_col, id_col=id_col, size=size, similarity=similarity, recall=recall), "groups")
    key, fp, root = (fresh(docs.columns, x) for x in ("kept_id", "fp", "root"))
    named = groups.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias(key)).agg(F.count("*").alias("rows_of_id"))
    once, again = named.where("rows_of_id = 1").select(key), named.where("rows_of_id > 1").select(key)
    kept = docs.join(once, docs[id_col] == once[key], "left_semi")
    repeated = docs.join(again, docs[id_col] == again[key], "left_semi").dropDuplicates([id_col])
    nameless = groups.where(F.col("component_id").isNull()).select(F.col("fp").alias(fp), F.col("root").alias(root)).distinct()
    if nameless.isEmpty():
        return kept.unionByName(repeated)
    bare = sketches(docs.where(F.col(id_col).isNull()), text_col, tuple(docs.columns), size, 1, 1, fp, full=False)
    bare = bare.join(nameless, fp).dropDuplicates([root]).select(*docs.columns)
    return kept.unionByName(repeated).unionByName(bare)
