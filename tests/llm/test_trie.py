"""The prefix trie of conversations against dictionaries of tuples."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from veilframe.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string, a long, depth string, place int"


def plain(rows):
    held = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            held.setdefault(c, []).append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    held = {c: [(x[2], x[4]) for x in sorted(xs)] for c, xs in held.items()}
    built = {}
    for c in held:
        n = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(held.get(c - c % 20, [])[:n] + held[c][n:])
    members, kids, sums, out = {}, {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[x] for x in kids.get(p, [])]
        sums[p] = (sum(x[0] for x in below) or 1, (len(members[p]) - 1) * words + sum(x[1] for x in below))
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(p))
        out[min(m), len(p)] = (min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def made(n=150):
    rng = np.random.default_rng(8)
    openings = [f"hello there {k}" for k in range(3)]
    rows = []
    for c in rng.choice(1000, n, replace=False):
        for t in range(int(rng.integers(1, 7))):
            text = str(rng.choice(openings)) if t < 3 else f"words {int(rng.integers(4))} go on"
            rows.append((int(c), t, "user" if t % 2 == 0 else "assistant", text, 1, "x", 2))
    rows += [(2000 + k, t, "user", f"copy {t}", 1, "x", 2) for k in range(40) for t in range(5)]
    rows += [(3000, t, "user", f"long {t} " * 3, 1, "x", 2) for t in range(400)] + [(3001, t, "user", f"long {t} " * 3, 1, "x", 2) for t in range(390)]
    rows += [(3040, None, None, None, 1, "x", 2), (3040, None, "user", "later " * 50_000, 1, "x", 2), (3040, 1, "user", None, 1, "x", 2), (3040, 1, "user", None, 1, "x", 2), (3041, 0, "", "", 1, "x", 2), (None, 0, "user", "of none", 1, "x", 2), (-7, 0, "user", "hi", 1, "x", 2)]
    return rows


@pytest.mark.parametrize("limit", [trie.SHARD, 50, 5])
def test_nodes_equal_plain_prefixes(spark, limit):
    rows = made() if limit > 5 else made(30)[:120]
    got = trie.nodes(spark.createDataFrame(rows, SCHEMA).repartition(4), limit).collect()
    out = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in got}
    assert len(got) == len(out) and out == plain(rows)


def test_no_conversations(spark):
    assert trie.nodes(spark.createDataFrame([], SCHEMA)).collect() == []


def test_bits_tell_parents_and_children():
    rng = np.random.default_rng(1)
    n = 500
    parent = np.array([-1, -1, -1, *(int(rng.integers(-1, i)) if i % 50 == 0 else int(rng.integers(i)) for i in range(3, n))])
    depth = np.zeros(n, np.int64)
    for i in range(n):
        depth[i] = depth[parent[i]] + 1 if parent[i] >= 0 else 2
    order, begins = trie.level_order(depth, parent)
    bits = trie.louds(order, parent, np.arange(n))
    place = np.argsort(order)
    want = np.where(parent[order] >= 0, place[parent[order]], -1)
    assert bits.parents().tolist() == want.tolist() and bits.labels.tolist() == order.tolist()
    assert bits.degrees().tolist() == [int((want == i).sum()) for i in range(n)] and len(bits.bits) == 2 * n - bits.roots
    assert all([*bits.children(i)] == np.flatnonzero(want == i).tolist() for i in range(n))
    _, kids, leaves, saved = trie.rollups(bits, begins, np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, np.int64))
    for i in range(n):
        below, todo = [], [i]
        while todo:
            below.append(todo.pop())
            todo += bits.children(below[-1])
        assert saved[i] == len(below) and leaves[i] == sum(kids[x] == 0 for x in below)
