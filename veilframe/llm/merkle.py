"""A Merkle manifest of a table: who holds the root can check any one row.

Every row is a leaf, the hash of its columns. Per tree (a source) leaves stand in order; runs of `fan` nodes become one,
whose preimage, the hashes of its children one after another, is stored; the trees' roots are the leaves of a tree of their
own. A leaf is proved by joining the preimages of its ancestors: its own slot of 64 characters taken out leaves the
siblings, another hash put into the slot and hashed upwards gives the root that this hash would lead to. Paths are handed
down from the root level by level, so leaves themselves meet the table of their parents only, in one join of even groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import drop_saved, save
from veilframe.llm.ranks import running

FAN = 16
HEX = 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<preimage:string,slot:int>>"


def framed(column: Column) -> Column:
    """A value with its length in front, so that no two rows give the same bytes: `-` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(framed, columns)), 256)


def levels(nodes: DataFrame, fan: int) -> list[DataFrame]:
    """nodes: tree, idx (from 0, without gaps), hash. The levels above them, saved: tree, idx, preimage, lone. A row is lone if
    its tree had one node left below, which is that tree's root; every tree ends in one lone row."""
    out = []
    while True:
        above = nodes.groupBy("tree", F.expr(f"idx div {fan}").alias("idx")).agg(F.array_sort(F.collect_list(F.struct((F.col("idx") % fan).cast("int").alias("slot"), "hash"))).alias("run"))
        above = above.select("tree", "idx", F.array_join(F.col("run.hash"), "").alias("preimage"), ((F.col("idx") == 0) & (F.size("run") == 1)).alias("lone"))
        out.append(save(above, f"level-{len(out) + 1}"))
        going = out[-1].where("NOT lone")
        if going.isEmpty():
            return out
        nodes = going.select("tree", "idx", F.sha2("preimage", 256).alias("hash"))


def stepped(nodes: DataFrame, above: DataFrame, fan: int) -> DataFrame:
    """nodes with the columns of their parents in `above` (tree, idx, preimage, lone, path, subroot); their path is their
    parent's with one step in front, except under a lone row, where nothing was hashed."""
    parents = above.withColumnsRenamed({"tree": "p_tree", "idx": "p_idx", "preimage": "p_preimage", "lone": "p_lone"})
    own = F.array(F.struct(F.col("p_preimage").alias("preimage"), (F.col("idx") % fan).cast("int").alias("slot"))).cast(STEPS)
    path = F.when(F.col("p_lone"), F.col("path")).otherwise(F.concat(own, F.col("path")))
    return nodes.join(parents, F.expr(f"tree <=> p_tree AND idx div {fan} = p_idx")).withColumn("path", path).drop("p_tree", "p_idx", "p_preimage", "p_lone")


def handed_down(ups: list[DataFrame], upper: DataFrame, fan: int) -> DataFrame:
    """The lowest of `ups` with the path from each of its rows to the root. upper: tree, path, subroot, from each tree's root on."""
    upper = upper.withColumnRenamed("tree", "u_tree")
    down = None
    for level in reversed(ups):
        ends = level.where("lone").join(upper, F.expr("tree <=> u_tree")).drop("u_tree")
        down = ends if down is None else ends.unionByName(stepped(level.where("NOT lone"), down, fan))
        # a plan of few joins each, which the driver can hold whatever the number of levels
        down = save(down, "paths") if level is not ups[0] else down
    return down


class Manifest:
    """leaves: the rows' kept columns with tree, idx, hash; ups: the levels over them; tops: the trees' roots as leaves (tree,
    idx, hash, of_tree); top_ups: the levels over these. All of it is saved; drop() deletes it."""

    def __init__(self, leaves: DataFrame, fan: int = FAN):
        self.leaves, self.fan = leaves, fan
        self.ups = levels(leaves.select("tree", "idx", "hash"), fan)
        roots = self.ups[0].where("lone")
        for level in self.ups[1:]:
            roots = roots.unionByName(level.where("lone"))
        # the trees' roots are few beside the leaves, but as many as there are trees: ranked like leaves
        roots = roots.select(F.lit(None).cast("string").alias("tree"), F.col("tree").alias("of_tree"), F.col("preimage").alias("hash"))
        self.tops = running(roots, "tree", ["of_tree"], "idx", name="tops").withColumn("idx", F.col("idx") - 1)
        self.top_ups = levels(self.tops.select("tree", "idx", "hash"), fan)

    def root(self) -> DataFrame:
        """One row: root; no rows for a table without rows."""
        return self.top_ups[-1].where("lone").select(F.col("preimage").alias("root"))

    def proofs(self) -> DataFrame:
        """leaves with subroot, root and path: an array of (preimage, slot) from the leaf's parent up to the root."""
        top = self.top_ups[-1].where("lone").select("tree", F.array().cast(STEPS).alias("path"), F.col("preimage").alias("root"))
        above = handed_down(self.top_ups, top, self.fan)
        subroots = stepped(self.tops, above, self.fan).select(F.col("of_tree").alias("tree"), "path", F.col("hash").alias("subroot"), "root")
        return stepped(self.leaves, handed_down(self.ups, save(subroots, "subroots"), self.fan), self.fan)

    def drop(self) -> None:
        for level in [*self.ups, *self.top_ups]:
            drop_saved(level)


def siblings(path: str = "path") -> Column:
    """All siblings on a path, level by level and left to right: preimages without the own slots."""
    return F.expr(f"array_join(transform({path}, x -> concat(substring(x.preimage, 1, {HEX} * x.slot), substring(x.preimage, {HEX} * x.slot + {HEX + 1}))), '')")


def folded(leaf: Column, path: str = "path") -> Column:
    """The root that this leaf's hash leads to: put into its slot, hashed, and so on upwards."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.overlay(x["preimage"], h, x["slot"] * HEX + 1, F.lit(HEX)), 256))


def manifest(docs: DataFrame, tree: str = "source", order: str = "doc_id", columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), tampered: dict[str, Column] | None = None, fan: int = FAN) -> Manifest:
    """A manifest of docs: one leaf a row, a tree for each value of `tree`, ordered by `order`.

    tampered: other values of some columns, as if a row had been changed after its leaf was stored; `now` is then the hash of
    the row as it is (null where it is as before). Leaves keep `order`, `tree` and these hashes, no texts.

    Cases: a null value is hashed as `-`, so it differs from an empty text; null trees are a tree, the first one; null
    places stand first; rows that tie stand in the order of their hashes; repeated rows are leaves of their own (equal
    leaves, at neighbouring places); a table without rows has no root. Texts of any length are hashed whole. Columns that are
    not named take no part, whatever their names.
    """
    hashed = leaf_hash([F.col(f"`{c}`") for c in columns])
    now = F.lit(None).cast("string")
    if tampered:
        other = leaf_hash([tampered.get(c, F.col(f"`{c}`")) for c in columns])
        changed = F.lit(False)
        for c, value in tampered.items():
            changed = changed | ~value.eqNullSafe(F.col(f"`{c}`"))
        now = F.when(changed, other)
    # saved, as the ranges of the next step are drawn from it: else every text would be hashed once more
    leaves = save(docs.select(F.col(f"`{order}`").alias("item"), F.col(f"`{tree}`").cast("string").alias("tree"), hashed.alias("hash"), now.alias("now"), F.monotonically_increasing_id().alias("tie")), "leaves")
    placed = running(leaves, "tree", ["item", "hash", "tie"], "idx", name="placed").withColumn("idx", F.col("idx") - 1).drop("tie")
    return Manifest(placed, fan)


def lowered_fifth(item: str, text: str) -> Column:
    """A change to detect: A-Z in lower case where the item's CRC-32 is divisible by 5."""
    return F.when(F.crc32(F.col(item).cast("string")) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(F.col(text))


def verified(docs: DataFrame) -> DataFrame:
    """Each row of documents with its leaf, its tree's and the whole root, the hash of its siblings, the root that its text leads
    to after the change of lowered_fifth, and whether that is the root: doc_id, leaf, subroot, root, proof_sha256, folded_root,
    verified, depth (levels on the path)."""
    proofs = manifest(docs, tampered={"text": lowered_fifth("doc_id", "text")}).proofs()
    out = proofs.select(F.col("item").alias("doc_id"), F.col("hash").alias("leaf"), "subroot", "root", F.sha2(siblings(), 256).alias("proof_sha256"), folded(F.coalesce("now", "hash")).alias("folded_root"), F.size("path").alias("depth"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
