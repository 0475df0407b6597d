"""Substring dedup with compact windows.

The tokens are the hashes of every five words. For each of `hashes` hash functions, a node of the Cartesian tree over a
text's hash values stands for all stretches that share its minimum: the compact window (l, c, r) holds those that start
in l..c and end in c..r. Only nodes at least as wide as the shortest passage matter, about 2 in `least` of all. Windows
with the same function and minimum are joined, their intervals are laid over one another at c, and stretches that at
least `agree` functions support become candidates. Candidates are verified on the token hashes themselves: within a
candidate, maximal stretches of which enough tokens recur in the other text, with a Jaccard similarity of at least
`similarity`, are reported.

Who meets whom. The windows of a minimum are sorted by their surroundings (a digest of the `least` tokens around c),
then by document. Each is linked to the first with the same surroundings, with which it shares a whole passage. The first
ones of the surroundings are linked to each other; where a minimum has more than CROWD surroundings, they are compared on
the tokens themselves: first with the earliest that has some stretch alike; then, for each stretch of `least` tokens round
the minimum that none of these has, with all that share one of its rarest tokens (a prefix filter, which loses none). So
every stretch that recurs is told with an earlier document, not with each of them, and rows grow with the windows. Windows of one batch with the same surroundings have a whole passage in common;
there, only the first goes on and the others are linked to it on the spot, so a passage that a third of all documents hold
does not fill one task. Equal texts are one minimum of their own (the digest of the text) and are not compared any further.

Cases: null and short texts have no passages; rows with a null id don't take part and are never changed; rows of one id
are not compared with each other, and a stretch that is cut from one is cut from the others as far as they reach; ties of
the hash go to the left; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, drop_saved, fresh, save, slices, utf8
from veilframe.llm.words import scramble, word_hashes

SHINGLE = 5
PLACE = 24
#: Arms of a window are told in 16 bits; where they are longer, the windows further down the tree cover the rest.
ARM, ARMS = 16, (1 << 16) - 1
#: The mark of a text's own digest, in the place of a hash function's number.
WHOLE = 15
#: So many surroundings of a minimum are linked each with each; those of more are compared by their tokens.
CROWD = 8
#: Pairs of windows that are compared at a time, and windows at least.
FACING, TOGETHER = 1 << 14, 1 << 12
#: Tokens of several texts that are looked at side by side.
ASIDE = 1 << 15
#: Random numbers that stand for tokens of 16 bits in sums.
MARKS = np.random.default_rng(31).integers(0, 1 << 64, 1 << 16, np.uint64)
WORD = re.compile(r"[^ \t-\r]+")
#: Odd multipliers of the words of a run.
RUN = np.random.default_rng(32).integers(0, 1 << 64, SHINGLE, np.uint64) | np.uint64(1)
#: Odd multipliers of the hash functions, from the fractional part of the golden ratio.
GOLDEN = 0x9E3779B97F4A7C15


def tokens(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Hashes of the five-word runs of each text, in order (fewer words: one hash, as for the whole)."""
    for words in word_hashes(texts):
        n = max(1, len(words) - SHINGLE + 1) if len(words) else 0
        total = np.zeros(n, np.uint64)
        for k, by in enumerate(RUN[: len(words)]):
            total += words[k : k + n] * by
        yield scramble(total)


def mixed(h: np.ndarray, function: int) -> np.ndarray:
    """The values of one hash function."""
    x = h * np.uint64((GOLDEN * (2 * function + 1)) & (1 << 64) - 1 | 1)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def compact_windows(h: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(l, c, r) of the nodes of the Cartesian tree over h (the leftmost of equal values on top) at least `least` wide."""
    n = len(h)
    if n < least:
        return
    low = np.uint64((1 << PLACE) - 1)
    for base in range(0, n, (1 << PLACE) - 1 - least):  # longer texts in stretches that overlap by a passage
        part = h[base : base + (1 << PLACE) - 1]
        if len(part) < least:
            break
        keys = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        # minima of all stretches of `least` tokens; what is none of these heads a smaller subtree
        width, m = 1, keys
        while 2 * width <= least:
            m = np.minimum(m[:-width], m[width:])
            width *= 2
        if width < least:
            m = np.minimum(m[: len(m) - (least - width)], m[least - width :])
        tops = np.unique(m & low).astype(np.int64)
        values = keys[tops].tolist()
        places = tops.tolist()
        left, right, stack = [0] * len(places), [len(part) - 1] * len(places), []
        for i, v in enumerate(values):
            while stack and values[stack[-1]] > v:
                right[stack.pop()] = places[i] - 1
            left[i] = places[stack[-1]] + 1 if stack else 0
            stack.append(i)
        for a, c, b in zip(left, places, right, strict=True):
            yield base + a, base + c, base + b


def side_by_side(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of several texts in one array, with a place in front of each text and one at the end; and these places."""
    marks = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])])
    flat = np.zeros(marks[-1] + 1, np.uint64)
    for at, x in zip(marks.tolist(), own, strict=False):
        flat[at + 1 : at + 1 + len(x)] = x
    return flat, marks


def windows_of_all(h: np.ndarray, marks: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As compact_windows, for all texts of side_by_side at once (fewer than 1 << PLACE places): arrays l, c, r of places in h."""
    low = np.uint64((1 << PLACE) - 1)
    keys = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    # less than every token's key: no stretch with a mark in it has a minimum of its own, no node reaches across one
    keys[marks] = 0
    width, m = 1, keys
    while 2 * width <= least:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    if width < least:
        m = np.minimum(m[: len(m) - (least - width)], m[least - width :])
    top = np.zeros(len(h), bool)
    top[(m & low).astype(np.int64)] = True
    top[marks] = True
    places = np.flatnonzero(top)
    values = keys[places]
    inner = np.flatnonzero(values)

    def smaller(step: int) -> np.ndarray:
        """The nearest place with a smaller key on one side: what lies between a place and the one it is told by is larger."""
        to, left = np.arange(len(places)) + step, inner
        while len(left):
            left = left[values[to[left]] > values[left]]
            to[left] = to[to[left]]
        return places[to[inner]]

    return smaller(-1) + 1, places[inner], smaller(1) - 1


def joined(value: np.ndarray, near: np.ndarray, ids: np.ndarray, heads: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, partner) of rows sorted by value, surroundings and id: with the first of the same surroundings; for
    that one, a head, with all heads of the value before it, if its rank among them is below CROWD."""
    row, first = np.arange(len(value)), np.zeros(len(value), np.int64)
    first[heads] = heads
    first = np.maximum.accumulate(first)
    left, right = [row], [first]
    for d in range(1, CROWD):
        near_by = (value[heads[d:]] == value[heads[:-d]]) & (rank[d:] < CROWD)
        left.append(heads[d:][near_by])
        right.append(heads[:-d][near_by])
    left, right = np.concatenate(left), np.concatenate(right)
    # a text as a whole is like those with the same digest and surroundings only
    apart = (ids[left] != ids[right]) & ((value[left] & 15 != WHOLE) | (near[left] == near[right]))
    return left[apart], right[apart]


LINK = ["id", "start", "rep", "rep_start", "length", "f"]
#: In the place of words: the link is of windows that share a whole passage; the row is a window of a crowd (id, place, value).
SURE, CROWDED = -1, -2


def laid(value: np.ndarray, ids: np.ndarray, place: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The links (columns LINK) of pairs of windows, from the later document (larger id) to the earlier."""
    left, right = np.where(ids[left] > ids[right], left, right), np.where(ids[left] > ids[right], right, left)
    c, before, after = place >> 2 * ARM, place >> ARM & ARMS, place & ARMS
    arm, leg = np.minimum(before[left], before[right]), np.minimum(after[left], after[right])
    return [ids[left], c[left] - arm, ids[right], c[right] - arm, arm + leg + 1, value[left] & 15]


def windows(docs: DataFrame, text_col: str, id_col: str, hashes: int, least: int) -> DataFrame:
    """value, near, id, place of compact windows, place packing c, c - l and r - c in 31, 16 and 16 bits; and rows that are
    the link of a window which goes no further, being alike one of its batch: id and, as bytes, the other columns of LINK."""
    names = ["value", "near", "id", "place", "link"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            out: list[list] = [[] for _ in range(4)]

            def add(value: np.ndarray, near: np.ndarray, i: np.ndarray, place: np.ndarray) -> None:
                for x, y in zip(out, (value.view(np.int64), near, i, place), strict=True):  # noqa: B023
                    x.append(y)

            def grow(batch: list[tuple[int, np.ndarray]]) -> None:
                flat, marks = side_by_side([own for _, own in batch])
                begin, end = np.append(marks[:-1], 0) + 1, np.append(marks[1:], 0)
                numbers = np.array([i for i, _ in batch], np.int64)
                around = mixed(flat, 7)
                around[marks] = 0
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(around, dtype=np.uint64)])
                for f in range(hashes):
                    h = mixed(flat, f)
                    if len(flat) < 1 << PLACE:
                        l, c, r = windows_of_all(h, marks, least)  # noqa: E741
                    else:  # one very long text
                        l, c, r = (1 + np.array(x, np.int64) for x in zip(*compact_windows(h[1:-1], least), strict=True))  # noqa: E741
                    text = np.searchsorted(marks, c) - 1
                    first, last = begin[text], end[text]
                    low = np.maximum(c - least // 2, first)
                    near = (sums[np.minimum(low + least, last)] - sums[low] + (c - low).astype(np.uint64)).astype(np.uint32).view(np.int32)
                    # the function is part of the value: its low bits
                    value = h[c] >> np.uint64(4) << np.uint64(4) | np.uint64(f)
                    add(value, near, numbers[text], c - first << ARM * 2 | np.minimum(c - l, ARMS) << ARM | np.minimum(r - c, ARMS))

            texts, batch = utf8(b.column(1)), []
            for i, t, own in zip(b.column(0).to_pylist(), texts, tokens(texts), strict=True):
                if len(own) < least:
                    continue
                # the text as a whole is a window of all its tokens; its length in words is told by the place
                digest = np.array([xxhash.xxh64_intdigest(t, 5) >> 4 << 4 | WHOLE], np.uint64)
                add(digest, np.array([xxhash.xxh32_intdigest(t, 6)], np.uint32).view(np.int32), np.array([i], np.int64), np.array([(len(own) + SHINGLE - 1) << 2 * ARM], np.int64))
                if batch and sum(len(x) for _, x in batch) + len(own) > ASIDE:
                    grow(batch)
                    batch = []
                batch.append((i, own))
            if batch:
                grow(batch)
            if not out[0]:
                continue
            value, near, ids, place = (np.concatenate(x) for x in out)
            order = np.lexsort((place, ids, near, value))
            value, near, ids, place = value[order], near[order], ids[order], place[order]
            again = np.zeros(len(value), bool)
            again[1:] = (value[1:] == value[:-1]) & (near[1:] == near[:-1])
            head = np.maximum.accumulate(np.where(again, 0, np.arange(len(value))))
            own_link = np.flatnonzero(again & (ids != ids[head]))
            go = ~again
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([value[go], near[go], ids[go], place[go], [None] * int(go.sum())], kinds, strict=True)], names)
            if len(own_link):
                link = laid(value, ids, place, own_link, head[own_link])
                rest = np.ascontiguousarray(np.stack([*link[1:], np.where(value[own_link] & 15 == WHOLE, place[own_link] >> 2 * ARM, SURE)], axis=1))
                # such rows need no company: they are spread by what they are
                spread = mixed(link[0].view(np.uint64) ^ value[own_link].view(np.uint64), 3).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip([spread, near[own_link], link[0], place[own_link], [r.tobytes() for r in rest]], kinds, strict=True)], names)

    picked = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(text_col))
    return arrow_map(picked, run, "value long, near int, id long, place long, link binary")


def links(found: DataFrame, parts: int, least: int) -> DataFrame:
    """Links (columns LINK, and words: the length of a text that is equal as a whole, or SURE): those made within batches,
    and those of windows that share a value, in a single pass over sorted windows; and the CROWDED windows."""
    names = [*LINK, "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the value at hand: its heads (of a crowd: the last), and how many it has
        kept: list[np.ndarray] | None = None
        seen = 0
        for b in batches:
            if not b.num_rows:
                continue
            told = b.column(4).is_valid()
            done = b.filter(told)
            if done.num_rows:
                rest = np.frombuffer(b"".join(done.column(4).to_pylist()), np.int64).reshape(-1, len(LINK))
                yield pa.RecordBatch.from_arrays([done.column(2), *(pa.array(np.ascontiguousarray(x)) for x in rest.T)], names)
                b = b.filter(pc.invert(told))
                if not b.num_rows:
                    continue
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns[:4]]
            if kept is not None and kept[0][0] == cols[0][0]:
                cols = [np.concatenate([k, c]) for k, c in zip(kept, cols, strict=True)]
                old = len(kept[0])
            else:
                old = seen = 0
            value, near, ids, place = cols
            new, fresh_near = np.ones(len(value), bool), np.ones(len(value), bool)
            new[1:] = value[1:] != value[:-1]
            fresh_near[1:] = new[1:] | (near[1:] != near[:-1])
            start = np.maximum.accumulate(np.where(new, np.arange(len(value)), 0))
            heads, count = np.flatnonzero(fresh_near), np.cumsum(fresh_near)
            rank = (count - count[start])[heads]
            # heads that are no longer kept count as well
            rank[value[heads] == value[0]] += max(0, seen - int(fresh_near[:old].sum()))
            left, right = joined(value, near, ids, heads, rank)
            fresh_ = left >= old
            left, right = left[fresh_], right[fresh_]
            if len(left):
                link, whole = laid(value, ids, place, left, right), value[left] & 15 == WHOLE
                words = np.where(whole, place[left] >> 2 * ARM, np.where(near[left] == near[right], SURE, 0))
                long = whole | (link[4] >= least)
                yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (*link, words)], names)
            full = np.flatnonzero((rank == CROWD) & (heads >= old))
            many = np.unique(np.concatenate([heads[(rank >= CROWD) & (heads >= old)], heads[(full[:, None] - np.arange(1, CROWD + 1)).ravel()]]))
            many = many[value[many] & 15 != WHOLE]
            if len(many):
                none = np.zeros(len(many), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[many], place[many], value[many], none, none, value[many] & 15, none + CROWDED)], names)
            own = heads[value[heads] == value[-1]]
            seen = int(rank[-1]) + 1
            kept = [c[own if seen <= CROWD else own[-1:]].copy() for c in cols]

    sorted_ = found.repartition(parts, "value").sortWithinPartitions("value", "near", "id", "place")
    return arrow_map(sorted_, run, ", ".join(f"{c} long" for c in names))


def partners(value: np.ndarray, ids: np.ndarray, around: np.ndarray, least: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, partner) of windows sorted by value and id, with the 2 * least - 1 tokens around the minimum (0: none): for
    each stretch of `least` tokens that holds the minimum and of which a window of the same value and a smaller id has at
    least `enough` tokens, one such window. One word changed, put in or left out is what `least` tokens at a similarity of
    0.8 bear, so tokens are looked for at most one place off."""
    n, middle = len(value), least - 1
    group = np.cumsum(np.concatenate([[0], value[1:] != value[:-1]])).astype(np.uint64)
    # by row and stretch (told by the tokens it has before the minimum), the first partner found; n: none
    best = np.full((n, least), n, np.int64)

    def counted(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), 2 * least), np.uint8)
        np.cumsum(x, axis=1, out=total[:, 1:])
        return (total[:, least:] - total[:, :least])[:, ::-1]

    def compare(pairs: np.ndarray) -> None:
        for k in range(0, len(pairs), FACING):
            i, j = pairs[k : k + FACING] // n, pairs[k : k + FACING] % n
            a, b = around[i], around[j]
            hit = a == b
            hit[:, 1:] |= a[:, 1:] == b[:, :-1]
            hit[:, :-1] |= a[:, :-1] == b[:, 1:]
            hit &= a > 0
            some = np.flatnonzero((hit.sum(axis=1) >= enough) & (ids[i] != ids[j]))
            if len(some):
                i, j = i[some], j[some]
                told = np.where(counted(hit[some]) >= enough, j[:, None], n)
                starts = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                best[i[starts]] = np.minimum(best[i[starts]], np.minimum.reduceat(told, starts, axis=0))

    # with the first that has one of some stretches, or a side, as it is
    sums = np.zeros((n, 2 * least), np.uint64)
    np.cumsum(MARKS[around], axis=1, out=sums[:, 1:])
    pairs = []
    for a, b in [*((middle - o, middle - o + least) for o in range(0, least, 9)), (middle - least // 2, middle), (least, least + least // 2)]:
        key = (sums[:, b] - sums[:, a]) ^ group * np.uint64(GOLDEN)
        order = np.argsort(key, kind="stable")
        again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
        first = order[np.maximum.accumulate(np.where(again, 0, np.arange(n)))]
        pairs.append((order * n + first)[again])
    compare(np.unique(np.concatenate(pairs)))
    # stretches without a partner, a few neighbours at a time: of any misses + 1 tokens that they have in common, a partner
    # has one; the rarest will do. Where many windows have that one, a few of them are tried first, all of them at last
    token = around.astype(np.uint64) | group[:, None] << np.uint64(16)
    place = (token * np.uint64(GOLDEN) >> np.uint64(44)).astype(np.int32)
    often = np.bincount(place.ravel(), minlength=1 << 20)
    # how often a token is there, and its place; narrow, as this is sorted for each stretch
    at, step, times = np.arange(2 * least - 1), -(-least // 4), often[place]
    # a token that no other window has is missing from all
    active = counted((around > 0) & (times > 1)) >= enough
    narrow = np.int32 if times.max() < 1 << 22 else np.int64
    none = np.iinfo(narrow).max
    rarity = np.where(around > 0, times.astype(narrow) << narrow(8) | at.astype(narrow), narrow(none))
    for most in (8, 128, n):
        left = active & (best == n)
        spread = []
        for k in range(0, least, step):
            part = left[:, k : k + step]
            take = np.flatnonzero(part.any(axis=1))
            spread.append([take, k + part[take].argmax(axis=1), k + part.shape[1] - 1 - part[take, ::-1].argmax(axis=1)])
        row, low, high = (np.concatenate(x) for x in zip(*spread, strict=True))
        inside = (at >= middle - low[:, None]) & (at <= 2 * middle - high[:, None])
        order = np.where(inside, rarity[row], narrow(none))
        order = np.partition(order, least - enough, axis=1)[:, : least - enough + 1]
        of, rank = np.nonzero(order < none)
        probe_row, probe_at = row[of], order[of, rank] & 255
        wanted = np.zeros(1 << 20, bool)
        wanted[place[probe_row, probe_at]] = True
        there, there_at = np.nonzero(wanted[place] & (around > 0))
        keys, number = np.unique(token[probe_row, probe_at], return_inverse=True)
        if not len(keys):
            break
        known = token[there, there_at]
        which = np.minimum(np.searchsorted(keys, known), len(keys) - 1)
        found = np.unique((which << 32 | there)[keys[which] == known])
        begin, end = np.searchsorted(found, number << 32), np.searchsorted(found, number << 32 | probe_row)
        every = end - begin
        met = np.minimum(every, most)
        before = np.concatenate([[0], np.cumsum(met)])
        cuts = np.unique(np.concatenate([[0], np.searchsorted(before[1:], np.arange(16 * FACING, before[-1] + 1, 16 * FACING)), [len(met)]]))
        for a, b in zip(cuts, cuts[1:], strict=False):
            x = np.repeat(np.arange(a, b), met[a:b])
            y = begin[x] + (np.arange(before[a], before[b]) - before[x]) * every[x] // met[x]
            compare(np.unique(probe_row[x] * n + (found[y] & (1 << 32) - 1)))
        more = np.zeros(n, bool)
        more[probe_row[every > met]] = True
        active &= more[:, None]
        if not more.any():
            break
    who, _ = np.nonzero(best < n)
    pairs = np.unique(who * n + best[best < n])
    return pairs // n, pairs % n


def crowds(docs: DataFrame, crowded: DataFrame, text_col: str, id_col: str, parts: int, least: int, enough: int) -> DataFrame:
    """Links (LINK, words) of the windows of crowds (id, place, value), which share a whole passage."""
    per_doc = crowded.groupBy("id").agg(F.collect_list(F.struct("value", "place")).alias("spots"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(per_doc.hint("merge"), "id").select("id", "text", "spots")

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            for i, own, spots in zip(b.column(0).to_pylist(), tokens(utf8(b.column(1))), b.column(2), strict=True):
                spots = spots.values
                value, place = spots.field("value").to_numpy(), spots.field("place").to_numpy()
                c = place >> 2 * ARM
                # of several rows with one id, the one that has the window
                here = c < len(own)
                for f in np.unique(value & 15):
                    mine = np.flatnonzero(here & (value & 15 == f))
                    here[mine] = mixed(own[c[mine]], int(f)) >> np.uint64(4) == value[mine].view(np.uint64) >> np.uint64(4)
                value, place, c = value[here], place[here], c[here]
                if not len(c):
                    continue
                padded = np.zeros(len(own) + 2 * (least - 1), np.uint16)
                padded[least - 1 : least - 1 + len(own)] = np.maximum(own.astype(np.uint16), 1)
                around = padded[c[:, None] + np.arange(2 * least - 1)]
                yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.full(len(c), i, np.int64)), pa.array(place), pa.array([x.tobytes() for x in around], pa.binary())], ["value", "id", "place", "around"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def faced(table: pa.Table) -> pa.RecordBatch:
            value, ids, place = (table.column(k).to_numpy() for k in range(3))
            around = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint16).reshape(len(value), -1)
            left, right = partners(value, ids, around, least, enough)
            link = laid(value, ids, place, left, right)
            long = link[4] >= least
            return pa.RecordBatch.from_arrays([*(pa.array(x[long]) for x in link), pa.array(np.full(int(long.sum()), SURE, np.int64))], [*LINK, "words"])

        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) >= TOGETHER:
                table = pa.Table.from_batches(held)
                value = table.column(0).to_numpy()
                # the last value may go on in the next batch
                done = int(np.searchsorted(value, value[-1]))
                if done:
                    yield faced(table.slice(0, done))
                    held = table.slice(done).to_batches()
        if held:
            yield faced(pa.Table.from_batches(held))

    around = arrow_map(picked, surroundings, "value long, id long, place long, around binary")
    sorted_ = around.repartition(parts, "value").sortWithinPartitions("value", "id", "place")
    return arrow_map(sorted_, run, ", ".join(f"{c} long" for c in [*LINK, "words"]))


def candidates(linked: DataFrame, least: int, agree: int, drift: int = 16) -> DataFrame:
    """Stretches of a document laid over stretches of another that enough functions agree on, or a link that is sure by
    itself: islands of overlapping links on nearby diagonals."""
    spans = linked.where(F.col("length") >= least).withColumns({"end": F.col("start") + F.col("length"), "diagonal": F.floor((F.col("start") - F.col("rep_start")) / drift)})
    pair = Window.partitionBy("id", "rep", "diagonal").orderBy("start", "end")
    reach = F.max("end").over(pair.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", (reach.isNull() | (F.col("start") >= reach)).cast("int"))
    spans = spans.withColumn("island", F.sum("new").over(pair.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("id", "rep", "diagonal", "island").agg(F.min("start").alias("s"), F.max("end").alias("e"), F.min("rep_start").alias("rs"), F.max(F.col("rep_start") + F.col("length")).alias("re"), F.countDistinct("f").alias("n"), F.min("words").alias("sure"))
    # a margin, as a function may have found the edge of a passage in another text; multiples of 32 make stretches alike
    down, up = lambda x: F.greatest(F.floor((F.col(x) - 64) / 32) * 32, F.lit(0)), lambda x: F.ceil((F.col(x) + 64) / 32) * 32
    return islands.where((F.col("n") >= agree) | (F.col("sure") == SURE)).select("id", down("s").alias("s"), up("e").alias("e"), "rep", down("rs").alias("rs"), up("re").alias("re")).distinct()


def recurring(a: np.ndarray, b: np.ndarray, least: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Stretches [s, e) of a, at least `least` long, that recur in b as [rs, re): with their Jaccard similarity."""
    order = np.argsort(b, kind="stable")
    at = np.searchsorted(b[order], a)
    at[at == len(b)] = 0
    hit = b[order][at] == a if len(b) else np.zeros(len(a), bool)
    # enough of a stretch recurs: of equally long sets, similarity s means a share of 2s/(1+s)
    share = 2 * similarity / (1 + similarity)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))

    def compared(s: int, e: int) -> tuple[int, int, int, int, float] | None:
        where = order[at[s:e][hit[s:e]]]
        mid = int(np.median(where - np.flatnonzero(hit[s:e])))
        rs, re_ = max(0, mid), min(len(b), mid + e - s)
        x, y = np.unique(a[s:e]), np.unique(b[rs:re_])
        both = len(np.intersect1d(x, y, assume_unique=True))
        score = both / (len(x) + len(y) - both)
        return (s, e, rs, re_, score) if score >= similarity else None

    out, runs = [], list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
    i = 0
    while i < len(runs):
        s, e = runs[i]
        hits = e - s
        j = i + 1
        while j < len(runs) and (hits + runs[j][1] - runs[j][0]) >= share * (runs[j][1] - s):
            hits += runs[j][1] - runs[j][0]
            e = runs[j][1]
            j += 1
        # the whole stretch, or else those of its unbroken runs that are long enough by themselves
        for pieces in ([(s, e)], [r for r in runs[i:j] if j - i > 1]):
            good = [p for x, y in pieces if y - x >= least and (p := compared(x, y))]
            out += good
            if good:
                break
        i = j
    return out


def token_slices(docs: DataFrame, wanted: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, s, e and the token hashes s..e (32 bits of each) of the document, for each row of wanted."""
    per_doc = wanted.distinct().groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(per_doc.hint("merge"), "id").select("id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 64):
            rows = []
            for i, own, spans in zip(b.column(0).to_pylist(), tokens(utf8(b.column(1))), b.column(2).to_pylist(), strict=True):
                rows += [(i, x["s"], x["e"], own[x["s"] : x["e"]].astype(np.uint32).tobytes()) for x in spans]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["id", "s", "e", "hashes"])

    return arrow_map(picked, run, "id long, s long, e long, hashes binary")


def repeated_passages(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least_words: int = 50, similarity: float = 0.8, hashes: int = 6, agree: int = 2) -> DataFrame:
    """Passages of at least least_words words that an earlier document (a smaller id) has as well: id, start_word,
    end_word (exclusive), of_id, of_start, of_end, similarity."""
    least = least_words - SHINGLE + 1
    spark = docs.sparkSession
    found = windows(docs, text_col, id_col, hashes, least)
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (64 << 20)))
    linked = save(links(found, parts, least), "links")
    crowded = linked.where(F.col("words") == CROWDED).select("id", F.col("start").alias("place"), F.col("rep").alias("value"))
    enough = math.ceil(least * 2 * similarity / (1 + similarity))
    more = save(crowds(docs, crowded, text_col, id_col, parts, least, enough), "crowd-links")
    # a text that is equal to an earlier one as a whole needs no comparison with others
    zero, words = F.lit(0).cast("long"), F.col("words")
    equal = linked.where(F.col("f") == WHOLE).groupBy("id").agg(F.min("rep").alias("of_id"), F.max("words").alias("words"))
    equal = save(equal.select("id", zero.alias("start_word"), words.alias("end_word"), "of_id", zero.alias("of_start"), words.alias("of_end"), F.lit(1.0).alias("similarity")), "equal")
    others = linked.where((F.col("f") != WHOLE) & (F.col("words") != CROWDED)).unionByName(more).join(equal.select("id"), "id", "left_anti")
    pairs = save(candidates(others, least, agree), "passage_pairs")
    for done in (linked, more):
        drop_saved(done)
    cut = save(token_slices(docs, pairs.select("id", "s", "e").unionAll(pairs.select(F.col("rep"), F.col("rs"), F.col("re"))), text_col, id_col), "slices")
    theirs = cut.select(F.col("id").alias("rep"), F.col("s").alias("rs"), F.col("e").alias("re"), F.col("hashes").alias("rep_hashes"))
    laid = pairs.join(cut.hint("merge"), ["id", "s", "e"]).join(theirs.hint("merge"), ["rep", "rs", "re"]).select("id", "s", "rep", "rs", "hashes", "rep_hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            rows = []
            for i, s, rep, rs, x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for a, e, ra, re_, score in recurring(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least, similarity):
                    rows.append((i, s + a, s + e + SHINGLE - 1, rep, rs + ra, rs + re_ + SHINGLE - 1, score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["id", "start_word", "end_word", "of_id", "of_start", "of_end", "similarity"])

    return arrow_map(laid, run, "id long, start_word long, end_word long, of_id long, of_start long, of_end long, similarity double").unionByName(equal).distinct()


def drop_repeated(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", n_chars_col: str = "n_chars", **options) -> DataFrame:
    """docs without the passages that an earlier document has; n_chars_col, where there is one, is counted anew.
    Documents that are left without a word go."""
    found = save(repeated_passages(docs, text_col=text_col, id_col=id_col, **options), "repeated")
    spans, key = fresh(docs.columns, "repeated_spans"), fresh(docs.columns, "repeated_id")
    cuts = found.groupBy(F.col("id").alias(key)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(spans))
    changed = docs.join(cuts, F.col(id_col).cast("long") == F.col(key)).drop(key)
    untouched = docs.join(cuts.select(key), F.col(id_col).cast("long") == F.col(key), "left_anti")
    at, last = docs.columns.index(text_col), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 128):
            texts, kept = [], []
            for row, (t, drop) in enumerate(zip(b.column(at).to_pylist(), b.column(last).to_pylist(), strict=True)):
                places = [m.start() for m in WORD.finditer(t or "")] + [len(t or "")]
                last_word = len(places) - 1
                out, end = [], 0
                for s, e in sorted((min(x["start_word"], last_word), min(x["end_word"], last_word)) for x in drop):
                    if places[s] > end:
                        out.append(t[end : places[s]])
                    end = max(end, places[e])
                left = "".join([*out, (t or "")[end:]])
                if WORD.search(left):
                    texts.append(left)
                    kept.append(row)
            cols = [c.take(pa.array(kept, pa.int32())) for c in b.columns[:last]]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:last])

    edited = arrow_map(changed, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields))
    if n_chars_col in docs.columns:
        edited = edited.withColumn(n_chars_col, F.char_length(text_col).cast(docs.schema[n_chars_col].dataType))
    return untouched.unionByName(edited)
