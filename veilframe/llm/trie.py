"""The prefix trie of conversations: which beginnings they share, with counts rolled up from below.

A turn's label is a digest of role and text; a prefix is known by a running sum of labels mixed with their places, which
tasks can take over ranges of a conversation. So one grouping of all rows by prefix gives the nodes. A node under which
more rows lie than a shard may hold is heavy; the subtrees below heavy nodes are the shards. Whole shards are read by
numpy as a forest in level order: a LOUDS bit vector (for each node in order, as many ones as it has children, then a
zero) and an array of labels. Parents are read off the bits, and values are added up from the deepest level to the first.
What a shard's roots sum up to is added per parent before it moves, and the heavy nodes, with these sums, are the trie of
the next round. Each round's trie is smaller by the shards taken off, until one shard is the whole of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import WORD_PATTERN, arrow_map, save
from veilframe.llm.ranks import MASK, running

#: Rows below a node that a shard may hold; a task's forest holds less than two of them.
SHARD = 1 << 17
#: Most turns that a conversation takes over from the first of its twenty.
HEADS = 3
CHUNK = 1 << 14


@dataclass
class Louds:
    """A forest in level order. bits: for each node, a one a child, then a zero; roots: how many there are. labels: a row a node."""

    bits: np.ndarray
    roots: int
    labels: np.ndarray

    def parents(self) -> np.ndarray:
        """Each node's parent by its place in level order, -1 for roots: the i-th one of the bits stands for the i-th node that
        is no root, and as many zeros stand before it as nodes before its parent."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([np.full(self.roots, -1, np.int64), ones - np.arange(len(ones))])

    def degrees(self) -> np.ndarray:
        """Children of each node: ones between its zero and the one before."""
        return np.diff(np.flatnonzero(self.bits == 0), prepend=-1) - 1

    def children(self, node: int) -> range:
        """Places of a node's children; by select on the zeros."""
        zeros = np.flatnonzero(self.bits == 0)
        begin, end = (int(zeros[node - 1]) + 1 if node else 0), int(zeros[node])
        return range(self.roots + begin - node, self.roots + end - node)


def level_order(depth: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes in level order, the children of one node together and in the order of their parents; and where each level begins.
    parent: by row, -1 for roots. Roots may stand at any depth: levels count from the root."""
    n = len(parent)
    place = np.full(n, -1, np.int64)
    by_depth = np.argsort(depth, kind="stable")
    cuts = np.flatnonzero(np.diff(depth[by_depth], prepend=-2))
    level = np.zeros(n, np.int64)
    for rows in np.split(by_depth, cuts[1:]):  # parents come first
        inner = rows[parent[rows] >= 0]
        level[inner] = level[parent[inner]] + 1
    order = np.argsort(level, kind="stable")
    begins = np.flatnonzero(np.diff(level[order], prepend=-1))
    for begin, rows in zip(begins, np.split(order, begins[1:]), strict=True):
        if begin:
            rows = rows[np.argsort(place[parent[rows]], kind="stable")]
        place[rows] = begin + np.arange(len(rows))
    return np.argsort(place), begins


def louds(order: np.ndarray, parent: np.ndarray, labels: np.ndarray) -> Louds:
    """The forest whose rows stand in this level order."""
    n = len(order)
    degrees = np.bincount(parent[parent >= 0], minlength=n)[order]
    bits = np.ones(int(degrees.sum()) + n, np.uint8)
    bits[np.cumsum(degrees + 1) - 1] = 0
    return Louds(bits, int((parent < 0).sum()), labels[order])


def rollups(trie: Louds, begins: np.ndarray, kids: np.ndarray, leaves: np.ndarray, saved: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each node in level order: parent, children, childless nodes below (or itself), saved below and here. kids, leaves and
    saved are what nodes bring along: children and their sums in shards taken off before, and their own saving."""
    parents = trie.parents()
    kids = kids + trie.degrees()
    leaves = np.where(kids == 0, 1, leaves)
    saved = saved.copy()
    ends = np.append(begins[1:], len(parents))
    for begin, end in zip(begins[:0:-1], ends[:0:-1], strict=True):
        up = parents[begin:end]
        np.add.at(leaves, up, leaves[begin:end])
        np.add.at(saved, up, saved[begin:end])
    return parents, kids, leaves, saved


def parent_rows(keys: np.ndarray, above: np.ndarray) -> np.ndarray:
    """For each row, the row whose key is its parent's key, or -1. keys and above: two columns of a structured array."""
    order = np.argsort(keys)
    at = np.searchsorted(keys[order], above)
    found = order[np.minimum(at, len(keys) - 1)]
    return np.where(keys[found] == above, found, -1)


def rebuilt(conversations: DataFrame, heads_of=None, taken=None) -> tuple[DataFrame, DataFrame]:
    """(rows, convs). rows: conv_id, place, label_a, label_b, words, a row a turn of every rebuilt conversation; convs: conv_id and
    how many turns it has, turnless ones as well.

    A conversation c takes the first h turns of conversation heads_of(c), then its own after its first h: by default c - c % 20
    and CRC-32(c) % 4, at most HEADS. Turns stand by turn (null first), then by role and a digest of the text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    lane = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    words = F.size(F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))).cast("long")
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), lane(1).alias("label_a"), lane(16).alias("label_b"), words.alias("words"))
    placed = running(save(turns, "turns"), "conv_id", ["turn", "role", "label_a", "label_b"], "at", name="turns-placed").drop("turn", "role")
    heads_of = heads_of or (lambda c: c - c % 20)
    taken = taken or (lambda c: (F.crc32(c.cast("string")) % 4).cast("int"))
    c = F.col("conv_id")
    convs = placed.groupBy("conv_id").agg(F.count("*").alias("own")).select("conv_id", "own", heads_of(c).alias("head_id"), taken(c).alias("h"))
    heads = placed.where(F.col("at") <= HEADS).groupBy(c.alias("head_id")).agg(F.array_sort(F.collect_list(F.struct("at", "label_a", "label_b", "words"))).alias("heads"))
    convs = convs.join(heads, "head_id", "left").select("conv_id", "own", "h", F.coalesce(F.slice("heads", F.lit(1), F.col("h")), F.expr("CAST(array() AS array<struct<at:bigint,label_a:bigint,label_b:bigint,words:bigint>>)")).alias("heads"))
    convs = save(convs.withColumn("n", F.size("heads") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "convs")
    first = convs.select("conv_id", F.explode("heads").alias("x")).select("conv_id", F.col("x.at").alias("place"), "x.label_a", "x.label_b", "x.words")
    rest = placed.join(convs.select("conv_id", "h", F.size("heads").alias("kept")), "conv_id").where("at > h")
    rest = rest.select("conv_id", (F.col("at") - F.col("h") + F.col("kept")).alias("place"), "label_a", "label_b", "words")
    return first.unionByName(rest), convs.select("conv_id", "n")


def mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels mixed with their places, so that a sum of them tells the order as well."""

    def stirred(x: np.ndarray) -> np.ndarray:
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    for b in batches:
        at = stirred(b.column("place").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        columns = {c: b.column(c) for c in b.schema.names}
        for c in ("label_a", "label_b"):
            columns[c] = pa.array((stirred(columns[c].to_numpy().astype(np.uint64) ^ at) & np.uint64(MASK)).astype(np.int64))
        yield pa.RecordBatch.from_pydict(columns)


def paths(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Saved: for each conversation and depth, 0 included, the prefix (a, b), the prefix before it (up_a, up_b), the words of its last
    turn, and the conversation's length n."""
    labelled = arrow_map(rows, mixed, "conv_id long, place long, label_a long, label_b long, words long").withColumns({"a": F.col("label_a"), "b": F.col("label_b")})
    summed = running(save(labelled, "labelled"), "conv_id", ["place"], "again", sums=["a", "b"], name="prefixes").drop("again")
    before = lambda x: (F.col(x) - F.col(f"label_{x}") + F.lit(MASK + 1)).bitwiseAND(F.lit(MASK))
    down = summed.join(convs, "conv_id").select("conv_id", F.col("place").alias("depth"), "a", "b", before("a").alias("up_a"), before("b").alias("up_b"), "words", "n")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"), "n")
    return save(top.unionByName(down), "paths")


NODE = "a long, b long, up_a long, up_b long, depth long, conv_id long, n_convs long, kids long, leaves long, saved long"
SHARDED = f"{NODE}, parent_conv_id long, is_top boolean, shard_a long, shard_b long"


def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of NODE with their shard, shards one after another: the same with sums rolled up. Whole shards are read together, as
    one forest, until SHARD rows are there."""
    wait: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        wait.append(b)
        if sum(x.num_rows for x in wait) < SHARD:
            continue
        whole = pa.Table.from_batches(wait).combine_chunks()
        a, b2 = (whole.column(c).to_numpy() for c in ("shard_a", "shard_b"))
        cut = np.flatnonzero((a != a[-1]) | (b2 != b2[-1]))
        if len(cut):
            done = int(cut[-1]) + 1
            yield from forest(whole.slice(0, done))
            wait = whole.slice(done).to_batches()
    if wait:
        yield from forest(pa.Table.from_batches(wait))


def forest(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    got = {c: rows.column(c).to_numpy() for c in ("a", "b", "depth", "conv_id", "kids", "leaves", "saved")}
    pair = np.dtype([("a", np.int64), ("b", np.int64)])
    keys, above = np.empty(rows.num_rows, pair), np.empty(rows.num_rows, pair)
    keys["a"], keys["b"] = got["a"], got["b"]
    above["a"], above["b"] = (rows.column(c).fill_null(-1).to_numpy() for c in ("up_a", "up_b"))
    parent = parent_rows(keys, above)
    order, begins = level_order(got["depth"], parent)
    trie = louds(order, parent, keys)
    parents, kids, leaves, saved = rollups(trie, begins, *(got[c][order] for c in ("kids", "leaves", "saved")))
    conv = got["conv_id"][order]
    top = parents < 0
    columns = {c: rows.column(c).take(pa.array(order)) for c in rows.column_names} | {
        "kids": pa.array(kids), "leaves": pa.array(leaves), "saved": pa.array(saved),
        "parent_conv_id": pa.array(np.where(top, 0, conv[parents]), mask=top), "is_top": pa.array(top),
    }
    yield from pa.table(columns).select([x.split()[0] for x in SHARDED.split(", ")]).to_batches(max_chunksize=10_000)


def rolled(path: DataFrame, limit: int = SHARD) -> DataFrame:
    """All nodes with their sums: NODE, where kids, leaves and saved cover the whole subtree, and parent_conv_id."""
    nodes = path.groupBy("a", "b").agg(F.min(F.struct("depth", "up_a", "up_b", "words")).alias("x"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("n") - F.col("depth") + 1).alias("below"))
    zero = F.lit(0).cast("long")
    nodes = nodes.select("a", "b", "x.up_a", "x.up_b", "x.depth", "conv_id", "n_convs", zero.alias("kids"), zero.alias("leaves"), ((F.col("n_convs") - 1) * F.col("x.words")).alias("saved"), "below")
    done: list[DataFrame] = []
    while True:
        nodes = save(nodes, "nodes")
        heavy = nodes.where(F.col("below") > limit)
        light = nodes.where(F.col("below") <= limit).drop("below")
        names = heavy.select("a", "b")
        # below a heavy node, a conversation is in the shard of its first light node
        shard = path.join(names, ["a", "b"], "left_anti").groupBy("conv_id").agg(F.min(F.struct("depth", "a", "b")).alias("s"))
        dealt = light.join(shard.select("conv_id", F.col("s.a").alias("shard_a"), F.col("s.b").alias("shard_b")), "conv_id")
        dealt = dealt.withColumns({"parent_conv_id": F.lit(None).cast("long"), "is_top": F.lit(False)}).select([x.split()[0] for x in SHARDED.split(", ")])
        climbed = save(arrow_map(dealt.repartition("shard_a", "shard_b").sortWithinPartitions("shard_a", "shard_b"), climb, SHARDED), "climbed")
        done.append(climbed)
        if heavy.isEmpty():
            break
        # the tops' sums, added up per heavy parent
        tops = climbed.where("is_top").groupBy(F.col("up_a").alias("a"), F.col("up_b").alias("b")).agg(F.count("*").alias("more_kids"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        more = lambda c: (F.col(c) + F.coalesce(F.col(f"more_{c}"), zero)).alias(c)
        kept = heavy.drop("below").join(tops, ["a", "b"], "left").select("a", "b", "up_a", "up_b", "depth", "conv_id", "n_convs", more("kids"), more("leaves"), more("saved"))
        # the next round's trie: paths of the conversations that name heavy nodes, as far as they are heavy
        path = save(path.join(names, ["a", "b"], "left_semi").join(heavy.select("conv_id").distinct(), "conv_id", "left_semi"), "heavy-paths")
        lengths = path.groupBy("conv_id").agg(F.max("depth").alias("n"))
        below = path.drop("n").join(lengths, "conv_id").groupBy("a", "b").agg(F.sum(F.col("n") - F.col("depth") + 1).alias("below"))
        nodes = kept.join(below, ["a", "b"])
    out = done[-1].drop("is_top", "shard_a", "shard_b")
    for i, part in enumerate(done[:-1]):
        inner = part.where("NOT is_top").drop("is_top", "shard_a", "shard_b")
        names = done[i + 1].select("a", "b", "conv_id")
        for later in done[i + 2 :]:
            names = names.unionByName(later.select("a", "b", "conv_id"))
        names = names.select(F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("top_conv"))
        outer = part.where("is_top").join(names, ["up_a", "up_b"]).withColumn("parent_conv_id", F.col("top_conv"))
        out = out.unionByName(inner).unionByName(outer.select(out.columns))
    return out


def joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, conv_id): for each (a, b) met, its ids as text, CHUNK of them a row."""
    have: list[str] = []
    at = first = None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"a": pa.array([at[0]], pa.int64()), "b": pa.array([at[1]], pa.int64()), "first": pa.array([first], pa.int64()), "ids": [",".join(have)]})

    for batch in batches:
        for a, b, c in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "conv_id")), strict=True):
            if (a, b) != at or len(have) >= CHUNK:
                if have:
                    yield flush()
                at, first, have = (a, b), c, []
            have.append(str(c))
    if have:
        yield flush()


def hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (a, b, first, ids): one digest for each (a, b), fed chunk by chunk."""
    at, digest, out = None, None, []
    for batch in batches:
        for a, b, ids in zip(*(batch.column(x).to_pylist() for x in ("a", "b", "ids")), strict=True):
            if (a, b) == at:
                digest.update(f",{ids}".encode())
                continue
            if at:
                out.append((*at, digest.hexdigest()))
            at, digest = (a, b), hashlib.sha256(ids.encode())
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))
                out = []
    if at:
        out.append((*at, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(("a", "b", "ends_sha256"), map(list, zip(*out, strict=True)), strict=True)))


def ends(path: DataFrame) -> DataFrame:
    """For each prefix at which conversations end, the SHA-256 of their ids in order, joined by commas. Ranges of ids become text in
    many tasks; what one task does for a prefix is to feed these texts to the digest, one after another."""
    last = save(path.where("depth = n").select("a", "b", "conv_id"), "ends")
    keys = ["a", "b", "conv_id"]
    texts = arrow_map(last.repartitionByRange(*keys).sortWithinPartitions(*keys), joined_ids, "a long, b long, first long, ids string")
    return arrow_map(texts.repartition("a", "b").sortWithinPartitions("a", "b", "first"), hashed_ids, "a long, b long, ends_sha256 string")


def nodes(conversations: DataFrame, limit: int = SHARD) -> DataFrame:
    """The trie of all rebuilt conversations, a row a node: conv_id (the smallest member), depth, parent_conv_id (null for the root),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's name (a, b).

    Cases: null roles and texts are empty; rows without a conv_id belong to no conversation; turns that tie stand by role and
    digest of the text, equal ones are turns of their own; a conversation left without turns is a member of the root alone;
    no rows: no nodes. Texts of any length are hashed whole and never move. Columns with other names take no part.
    """
    rows, convs = rebuilt(conversations)
    path = paths(rows, convs)
    empty = hashlib.sha256(b"").hexdigest()
    out = rolled(path, limit).join(ends(path), ["a", "b"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"), "a", "b")
