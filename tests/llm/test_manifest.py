"""The Merkle manifest and running places against plain loops."""

import hashlib
import zlib

import numpy as np
from pyspark.sql import functions as F

from veilframe.llm import merkle
from veilframe.llm.ranks import MASK, running

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, idx int, hash string, path string"


def h(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


def leaf(r, text=None):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[1], r[2], r[3], r[4] if text is None else text)))


def grown(hashes, fan):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
    return out


def steps(levels, i, fan):
    out = []
    for level in levels[:-1]:
        a = i // fan * fan
        out.append((level[a:i], level[i + 1 : a + fan]))
        i //= fan
    return out


def plain(rows, fan=16):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    held = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for s in sources}
    trees = {s: grown([leaf(r) for r in held[s]], fan) for s in sources}
    top = grown([trees[s][-1][0] for s in sources], fan)
    out = []
    for k, s in enumerate(sources):
        for i, r in enumerate(held[s]):
            path = steps(trees[s], i, fan) + steps(top, k, fan)
            text, folded = r[4], None
            if r[0] is not None and text is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = leaf(r, text)
            for a, b in path:
                folded = h(*a, folded, *b)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], h(*(x for a, b in path for x in a + b)), folded, folded == top[-1][0], len(path)))
    return out


def made():
    rng = np.random.default_rng(2)
    sources = ["a", "B", "ä", "z" * 40, None, "", *(f"s{i}" for i in range(20))]
    rows = [(int(i), sources[0] if i % 3 == 0 else sources[int(rng.integers(len(sources)))], "en", 5, f"Text Ä {i} " * int(rng.integers(1, 20)), "t", 1, "h", "p") for i in rng.permutation(700) - 20]
    rows += [(None, "a", None, None, None, None, None, None, None)] * 3 + [rows[0], (701, "a", "en", 1, "", "t", 1, "h", "p"), (702, "lone", "en", 1, "Long Text " * 100_000, "t", 1, "h", "p")]
    return rows


def test_proofs_equal_a_plain_tree(spark):
    got = merkle.verified(spark.createDataFrame(made(), SCHEMA).repartition(5)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "depth").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(made())))
    assert any(not r.verified for r in got) and any(r.verified for r in got)


def test_other_fans_and_any_changed_column(spark):
    rows = made()[:90]
    kept = merkle.manifest(spark.createDataFrame(rows, SCHEMA), fan=3, tampered={"lang": F.when(F.col("doc_id") % 7 == 0, "xx").otherwise(F.col("lang"))})
    root = plain(rows, 3)[0][3]
    assert [r.root for r in kept.root().collect()] == [root]
    got = kept.proofs().select("item", "root", (merkle.folded(F.coalesce("now", "hash")) == F.col("root")).alias("holds")).collect()
    assert len(got) == 90 and all(r.root == root and r.holds == (r.item % 7 != 0) for r in got)
    kept.drop()


def test_one_row_and_none(spark):
    row = made()[0]
    (got,) = merkle.verified(spark.createDataFrame([row], SCHEMA)).collect()
    assert got.leaf == got.subroot == got.root == leaf(row) and got.proof_sha256 == h() and got.depth == 0
    assert merkle.verified(spark.createDataFrame([], SCHEMA)).collect() == []


def test_running_places_and_sums(spark):
    rng = np.random.default_rng(4)
    rows = [(None if g == 0 else f"g{g}", int(x), int(v)) for g, x, v in zip(rng.choice(4, 3000, p=[0.1, 0.6, 0.2, 0.1]), rng.permutation(3000), rng.integers(0, MASK, 3000), strict=True)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {r.x: (r.place, r.v) for r in running(spark.createDataFrame(rows, "g string, x long, v long"), "g", ["x"], sums=["v"]).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    seen, total = {}, {}
    for g, x, v in sorted(rows, key=lambda r: r[1]):
        seen[g], total[g] = seen.get(g, 0) + 1, (total.get(g, 0) + v) & MASK
        assert got[x] == (seen[g], total[g])
