"""Hierarchical Pitman-Yor language model over words.

Each word that stands before others is a restaurant whose customers are the tokens that follow it; its tables are
customers of one shared parent, the restaurant of single words, whose own tables go back to a uniform base over the
words of the training half and one more for all unknown ones. Seatings are sampled by blocked Gibbs sweeps: in every
restaurant, all customers of a dish leave and are seated again one by one, given the tables of everyone else as the
last sweep left them. After a burn-in, predictive probabilities of the sweeps are averaged, and a text's score is the
sum of their logarithms.

How it runs. Texts are kept as blocks of some million tokens: the distinct words of a block, its distinct bigrams as
pairs of places among these, and the bigram of each token. All that blocks must know of one another goes through one
primitive, totals by key: each block sends its partial counts of its distinct keys, spread by hash over buckets; a bucket
adds them up and answers each block in its own order. Counts of words and bigrams are asked for once and kept beside
the blocks, which stay where they are; a sweep asks for totals of words only. A bigram is seated in the one block that owns
it; where the last pass needs its tables elsewhere, they are drawn again from the same hashes of bigram and sweep. A
frequent word or bigram is one entry a block, so no bucket is hot, and all tables grow with the corpus.

Approximations, stated: restaurants are resampled in parallel; a blocked seating is taken without a Metropolis
correction; customers sit down n / 64 at a time (one by one at first), n being those of the dish that already sit, each
such group with the chance of a new table that its first member has. Word and bigram hashes are 64 bits; a collision
would mix two counts.

Cases: null text is empty (its end is still scored); rows with a null id are training text; repeated rows count each;
without training text all words are unknown; other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, drop_saved, released, save, shuffles_dropped, slices, utf8
from veilframe.llm.words import scramble, word_hashes

BLOCK_TOKENS = 1_000_000
BUCKET_KEYS = 1_000_000
GROUPS = 64
#: Dishes that are seated at a time.
DISHES = 1 << 14
END, START = np.uint64(1), np.uint64(2)
#: Bigrams of a block whose chances are worked out at a time.
TOGETHER = 1 << 16
BLOCK_SCHEMA = "block long, ids array<long>, train binary, lens binary, words binary, word_counts binary, pairs binary, pair_counts binary, bigrams binary"
#: What the counts of all blocks add to a block: of its words; of its bigrams, and which it owns.
KNOWN = ["words", "word_totals", "pairs", "pair_totals", "own"]
UP_SCHEMA = "bucket int, block long, keys binary, a binary, b binary"
DOWN_SCHEMA = "block long, step int, bucket int, data binary, stats array<double>"


@lru_cache(maxsize=1)
def zstd() -> tuple[zstandard.ZstdCompressor, zstandard.ZstdDecompressor]:
    """One of each a process: a new one costs more than the small arrays that it is used for."""
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def squeeze(x: np.ndarray) -> bytes:
    return zstd()[0].compress(x.tobytes())


def spread(data: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstd()[1].decompress(data), kind)


def salt_of(s: int) -> np.uint64:
    return np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)


def unit(keys: np.ndarray) -> np.ndarray:
    """Scrambled keys as numbers in (0, 1)."""
    u = (keys >> np.uint64(11)).astype(np.float64)
    u += 0.5
    u *= 1 / (1 << 53)
    return u


def binomial(n: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """The binomial draw at the quantile u: by its distribution where few are expected, by the normal limit elsewhere."""
    mean = n * p
    many = np.flatnonzero(mean >= 16)
    if not len(many):
        return np.minimum(few_expected(n, p, u), n).astype(np.int64)
    out, x, share = np.empty(len(mean)), mean[many], p[many]
    z = np.sqrt(2) * erf_inverse(2 * u[many] - 1)
    out[many] = np.clip(np.rint(x + z * np.sqrt(x * (1 - share))), 0, n[many])
    few = np.flatnonzero(mean < 16)
    out[few] = np.minimum(few_expected(n[few], p[few], u[few]), n[few])
    return out.astype(np.int64)


def few_expected(n: np.ndarray, q: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The draws as far as 64, by the distribution."""
    m = n.astype(np.float64)
    term, k, at = np.exp(m * np.log1p(-q)), np.zeros(len(m)), np.arange(len(m))
    for i in range(64):
        # only those that go on are looked at again
        over = np.flatnonzero(left > term)
        if not len(over):
            break
        at, m, q, left, term = at[over], m[over], q[over], left[over] - term[over], term[over]
        k[at] += 1
        term = term * np.maximum(m - i, 0) / (i + 1) * q / (1 - q)
    return k


def erf_inverse(x: np.ndarray) -> np.ndarray:
    """Winitzki's closed form; errors under 0.002."""
    a, log = 0.147, np.log1p(-np.clip(x, -1 + 1e-15, 1 - 1e-15) ** 2)
    b = 2 / (np.pi * a) + log / 2
    return np.sign(x) * np.sqrt(np.sqrt(b * b - log / a) - b)


def seat(counts: np.ndarray, fresh: np.ndarray, discount: float, keys: np.ndarray, *salts: int) -> np.ndarray:
    """Tables of each dish after its `counts` customers sat down: a new table with weight fresh, one of the dish's own
    with its customers less the discounts. With several salts: one seating after the other, fresh being theirs in turn."""
    if len(salts) > 1:
        counts = np.tile(counts, len(salts))
    order = np.argsort(-counts.astype(np.int64), kind="stable")
    c, weight, salted = counts[order].astype(np.int64), fresh[order], scramble(np.concatenate([keys + salt_of(s) for s in salts])[order])
    out = np.empty_like(c)
    # some dishes at a time, as these stay in the processor's memory over all steps
    for k in range(0, len(c), DISHES):
        part = slice(k, k + DISHES)
        out[order[part]] = seated_by_size(c[part], weight[part], discount, salted[part])
    return out


def seated_by_size(c: np.ndarray, weight: np.ndarray, discount: float, salted: np.ndarray) -> np.ndarray:
    """seat, for dishes with the most customers first."""
    # as many sit at every dish that is not done yet; with the largest first, those are in front
    tables, less = np.minimum(c, 1), -c
    active, sit, step = int(np.searchsorted(less, -1)), 1, 0
    while active:
        own, come = slice(0, active), max(1, sit // GROUPS)
        p = weight[own] / (weight[own] + sit - discount * tables[own])
        u = unit(scramble(salted[own] + salt_of(step)))
        if come == 1:
            tables[own] += u < p
        else:
            more = np.minimum(c[own] - sit, come)
            tables[own] += (u < p) if more[0] == 1 else np.where(more == 1, u < p, binomial(more, np.minimum(p, 1 - 1e-12), u))
        sit += come
        active = int(np.searchsorted(less[own], -sit))
        step += 1
    return tables


@dataclass(frozen=True)
class Params:
    """d, theta of the contexts; d1, theta1 of the parent; its customers and tables; tokens and distinct words trained on."""

    d: float = 0.5
    theta: float = 1.0
    d1: float = 0.5
    theta1: float = 1.0
    customers: float = 0.0
    tables: float = 0.0
    n: int = 0
    v: int = 0

    def parent(self, c1: np.ndarray, t1: np.ndarray) -> np.ndarray:
        return (c1 - self.d1 * t1 + (self.theta1 + self.d1 * self.tables) / (self.v + 1)) / (self.theta1 + self.customers)


class Block:
    """A block's words and bigrams, and what the other blocks say of them, as far as the row holds it."""

    def __init__(self, row: dict):
        self.number = row["block"]
        self.hashes = np.frombuffer(row["words"], np.uint64)
        pairs = spread(row["pairs"], np.uint32).astype(np.int64).reshape(2, -1)
        self.u, self.v = pairs
        self.first, self.second = self.hashes * np.uint64(0x9E3779B97F4A7C15), scramble(self.hashes)
        if row.get("own") is not None:
            self.totals, self.own = spread(row["pair_totals"], np.uint32).astype(np.int64), np.unpackbits(spread(row["own"], np.uint8), count=len(self.u))
            self.word_totals = spread(row["word_totals"], np.uint32)

    def keys(self, some: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of bigrams."""
        return scramble(self.first[self.u[some]] + self.second[self.v[some]])


def described(ids: list, train: list, lens: list, hashed: list[np.ndarray], number: int) -> dict:
    """A block row: END is the last but one of its words, START the last."""
    words, codes = np.unique(np.concatenate(hashed) if hashed else np.zeros(0, np.uint64), return_inverse=True)
    lens_, train_ = np.array(lens, np.int64), np.array(train, bool)
    k = len(words) + 2
    ends = np.cumsum(lens_ + 1) - 1
    w = np.empty(len(codes) + len(lens_), np.int64)
    inside = np.ones(len(w), bool)
    inside[ends] = False
    w[inside], w[ends] = codes, k - 2
    u = np.empty_like(w)
    u[1:] = w[:-1]
    u[np.concatenate([[0], ends[:-1] + 1])] = k - 1
    pairs, bigram = np.unique(u * k + w, return_inverse=True)
    learnt = np.repeat(train_, lens_ + 1)
    word_counts = np.bincount(w[learnt], minlength=k)
    word_counts[-1] = train_.sum()
    small = lambda x: squeeze(x.astype(np.uint32))
    return {
        "block": number, "ids": ids, "train": train_.astype(np.uint8).tobytes(), "lens": small(lens_), "words": np.concatenate([words, [END, START]]).astype(np.uint64).tobytes(), "word_counts": small(word_counts),
        "pairs": small(np.concatenate([pairs // k, pairs % k])), "pair_counts": small(np.bincount(bigram[learnt], minlength=len(pairs))), "bigrams": small(bigram),
    }


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket, and where each bucket starts."""
    if buckets == 1:
        return np.arange(len(keys)), np.array([0, len(keys)])
    bucket = (keys % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def sent(block: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray | None, buckets: int) -> pa.Table:
    order, at = dealt(keys, buckets)
    rows = [(i, block, keys[o].tobytes(), squeeze(a[o].astype(np.uint32)), squeeze(b[o].astype(np.uint32)) if b is not None else None) for i in range(buckets) if len(o := order[at[i] : at[i + 1]])]
    cols = zip(*rows, strict=True) if rows else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "keys", "a", "b"])


def answered(rows: list[dict], keys: np.ndarray, buckets: int, kind: np.dtype) -> np.ndarray:
    """A block's answers from all buckets, in the order of its keys."""
    order, at = dealt(keys, buckets)
    out = np.zeros(len(keys), kind)
    for r in rows:
        out[order[at[r["bucket"]] : at[r["bucket"] + 1]]] = spread(r["data"], kind)
    return out


def totals(up: DataFrame, buckets: int, step: int, finish) -> DataFrame:
    """Adds up by key; finish(keys, a, b, first) -> (record array of answers by key, stats, or None for first-come marks)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for b in batches:  # a partition is one bucket: BUCKET_KEYS keys, about
            for r in b.to_pylist():
                parts.setdefault(r["bucket"], []).append((r["block"], np.frombuffer(r["keys"], np.uint64), spread(r["a"], np.uint32), spread(r["b"], np.uint32) if r["b"] is not None else None))
        for bucket, rows in parts.items():
            rows.sort(key=lambda r: r[0])
            asked = np.concatenate([r[1] for r in rows])
            order = np.argsort(asked)
            keys = asked[order]
            new = np.ones(len(keys), bool)
            new[1:] = keys[1:] != keys[:-1]
            keys, inverse = keys[new], np.empty(len(keys), np.int64)
            inverse[order] = np.cumsum(new) - 1
            add = lambda i: np.bincount(inverse, np.concatenate([r[i] for r in rows]), len(keys)).astype(np.int64) if rows[0][i] is not None else None  # noqa: B023, E731
            answers, stats = finish(keys, add(2), add(3))
            each = answers[inverse]
            if "own" in each.dtype.names:
                each["own"][order[new]] = 1
            at, data = 0, []
            for _, own, _, _ in rows:
                data.append(squeeze(each[at : at + len(own)]))
                at += len(own)
            del asked, order, inverse, each
            # the answers of some blocks at a time, not a batch for each
            for k in range(0, len(rows), 64):
                n = len(data[k : k + 64])
                cols = [[r[0] for r in rows[k : k + n]], [step] * n, [bucket] * n, data[k : k + n], [stats if k + i == 0 else None for i in range(n)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.float64())), strict=True)], ["block", "step", "bucket", "data", "stats"])

    return arrow_map(up.repartitionById(buckets, F.col("bucket")), run, DOWN_SCHEMA)


def summed(down: DataFrame) -> list[float]:
    """Statistics of all buckets, added up: a handful of numbers."""
    n = down.where("stats is not null").select(F.size("stats").alias("n")).limit(1).collect()
    if not n:
        return [0.0] * 8
    return list(down.where("stats is not null").agg(*[F.sum(F.col("stats")[i]) for i in range(n[0]["n"])]).first())


COUNT = np.dtype([("c", "<u4")])
PAIR = np.dtype([("c", "<u4"), ("own", "u1")])
WORD = np.dtype([("t", "<u4"), ("c1", "<u4"), ("t1", "<u4")])


def tokenised(docs: DataFrame, text_col: str, id_col: str, folds: int) -> DataFrame:
    id_ = F.col(id_col).cast("long")
    picked = docs.select(id_.alias("id"), F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds != 0, F.lit(True)).alias("train"), F.col(text_col).alias("text"), F.spark_partition_id().alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, train, lens, hashed, held, made = [], [], [], [], 0, 0

        def flush(p: int) -> pa.RecordBatch:
            row = described(ids, train, lens, hashed, (p << 32) + made)
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 7]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row.values(), kinds, strict=True)], list(row))

        p = 0
        for b in slices(batches):
            p = b.column(3)[0].as_py()
            for i, t, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), word_hashes(utf8(b.column(2))), strict=True):
                ids.append(i)
                train.append(t)
                lens.append(len(words))
                hashed.append(np.maximum(words, np.uint64(3)))
                held += len(words) + 1
                if held >= BLOCK_TOKENS:
                    yield flush(p)
                    ids, train, lens, hashed, held, made = [], [], [], [], 0, made + 1
        if ids:
            yield flush(p)

    return arrow_map(picked, run, BLOCK_SCHEMA)


def score(docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", folds: int = 10, burn_in: int = 1, samples: int = 2) -> DataFrame:
    """id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity of every document."""
    spark = docs.sparkSession
    out_schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    told = lambda df: df.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text_col)), F.lit(0)) + F.count("*")).first()[0]
    # blocks are looked at again and again: bucketed by number, they stay where they are and only answers move. With fewer
    # buckets than shuffle partitions Spark would rather deal the blocks anew
    parts = int(max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(size // (5 * BLOCK_TOKENS), 4096)))
    names = [f"hpylm_{k}_{uuid.uuid4().hex}" for k in ("read", "known")]
    tokenised(docs, text_col, id_col, folds).write.bucketBy(parts, "block").saveAsTable(names[0])
    read = spark.table(names[0])
    made = read.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("words") / 8), F.lit(0)), F.coalesce(F.sum(F.octet_length("bigrams")), F.lit(0))).first()
    if made[0] == 0:
        spark.sql(f"DROP TABLE {names[0]}")
        return told(spark.createDataFrame([], out_schema))
    w_buckets = int(max(1, -(-made[1] // BUCKET_KEYS)))
    # of a block of this size, the numbers of bigrams take about 2.4 bytes a token, and 0.7 of the tokens are distinct ones
    b_buckets = int(max(1, -(-made[2] // (3 * BUCKET_KEYS))))

    def from_blocks(blocks: DataFrame, columns: list[str], fn, schema: str, *known: DataFrame) -> DataFrame:
        """fn(block row, answers by step) -> table, for every block."""
        blocks = blocks.select("block", *columns)
        if not known:
            return arrow_map(blocks, lambda batches: (x for b in batches for i in range(b.num_rows) for x in fn(b.slice(i, 1).to_pylist()[0], {}).to_batches()), schema)

        several = len(known) > 1

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            steps: dict[int, list[dict]] = {}
            for r in right.to_pylist():
                steps.setdefault(r["step"], []).append(r)
            row = left.to_pylist()[0]
            del left, right
            out = fn(row, steps)
            row.clear()
            steps.clear()
            # unlike in arrow_map, no task's end follows at which the room would be given back; it is much where several
            # answers come together
            if several:
                released()
            return out

        answers = known[0].select("block", "step", "bucket", "data")
        for k in known[1:]:
            answers = answers.unionByName(k.select("block", "step", "bucket", "data"))
        return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(both, schema)

    # counts of words, and of bigrams
    def words_up(row: dict, _: dict) -> pa.Table:
        return sent(row["block"], np.frombuffer(row["words"], np.uint64), spread(row["word_counts"], np.uint32), None, w_buckets)

    def words_done(keys, a, _):
        out = np.zeros(len(keys), COUNT)
        out["c"] = a
        real = keys != START
        return out, [float(a[real].sum()), float((a[real] > 0).sum())]

    def pairs_up(row: dict, _: dict) -> pa.Table:
        x = Block(row)
        return sent(x.number, x.keys(), spread(row["pair_counts"], np.uint32), None, b_buckets)

    def pairs_done(keys, a, _):
        out = np.zeros(len(keys), PAIR)
        out["c"] = a
        return out, [float((a == 1).sum()), float((a == 2).sum())]

    def known_of(row: dict, steps: dict) -> pa.Table:
        x = Block(row)
        words, pair = answered(steps.get(0, []), x.hashes, w_buckets, COUNT), answered(steps.get(1, []), x.keys(), b_buckets, PAIR)
        new = {"block": x.number, "word_totals": squeeze(words["c"]), "pair_totals": squeeze(pair["c"]), "own": squeeze(np.packbits(pair["own"]))}
        kinds = [pa.int64(), *[pa.binary()] * 3]
        return pa.table([pa.array([v], k) for v, k in zip(new.values(), kinds, strict=True)], list(new))

    word_counts = save(totals(from_blocks(read, ["words", "word_counts"], words_up, UP_SCHEMA), w_buckets, 0, words_done), "hpylm-words")
    n, v = summed(word_counts)[:2]
    pair_counts = save(totals(from_blocks(read, ["words", "pairs", "pair_counts"], pairs_up, UP_SCHEMA), b_buckets, 1, pairs_done), "hpylm-pairs")
    once, twice = summed(pair_counts)[:2]
    known_schema = "block long, word_totals binary, pair_totals binary, own binary"
    with shuffles_dropped(spark):
        from_blocks(read, ["words", "pairs"], known_of, known_schema, word_counts, pair_counts).write.bucketBy(parts, "block").saveAsTable(names[1])
    for done in (word_counts, pair_counts):
        drop_saved(done)
    # both tables lie in the same buckets, so the blocks are not dealt anew
    blocks = read.join(spark.table(names[1]).hint("merge"), "block")
    p = Params(d=min(0.95, max(0.05, once / max(1, once + 2 * twice))), n=int(n), v=int(v), tables=float(v), customers=float(v))

    def tables_of(x: Block, chosen: np.ndarray | None, *given: tuple[np.ndarray | None, Params, int]) -> list[np.ndarray]:
        """Tables of the chosen bigrams of a block (none of the others; without chosen, of all) in sweeps that are given by
        the words' state before, the parameters and the number; these sweeps are seated at once."""
        plain = np.minimum(x.totals, 1) if chosen is None else np.minimum(x.totals, 1) * chosen
        if given[0][0] is None:
            return [plain]
        many = np.flatnonzero(x.totals > 1 if chosen is None else (x.totals > 1) & chosen)
        u, v, n = x.u[many], x.v[many], len(many)
        weights = [(q.theta + q.d * words["t"][u]) * q.parent(words["c1"].astype(np.float64), words["t1"].astype(np.float64))[v] for words, q, _ in given]
        seated = seat(x.totals[many], np.concatenate(weights), given[0][1].d, x.keys(many), *(s for _, _, s in given))
        out = [plain, *(plain.copy() for _ in given[1:])]
        for i, t in enumerate(out):
            t[many] = seated[i * n : (i + 1) * n]
        return out

    def sweep(step: int, before: DataFrame | None, q: Params) -> DataFrame:
        later = before is not None

        def up(row: dict, steps: dict) -> pa.Table:
            x = Block(row)
            words = answered(steps.get(step - 1, []), x.hashes, w_buckets, WORD) if later else None
            t = tables_of(x, x.own.astype(bool), (words, q, step))[0]
            size = len(x.hashes)
            return sent(x.number, x.hashes, np.bincount(x.u, t, size).astype(np.int64), np.bincount(x.v, t, size).astype(np.int64), w_buckets)

        def done(keys, t, c1):
            out = np.zeros(len(keys), WORD)
            out["t"], out["c1"] = t, c1
            t1 = seat(c1, np.full(len(keys), (q.theta1 + q.d1 * q.tables) / (q.v + 1)), q.d1, keys, -step - 1)
            out["t1"] = t1
            # what the concentration of the contexts is drawn from (auxiliary variables, by their means)
            some = t[t > 0].astype(np.float64)
            x = q.theta / q.d
            opened = x * (np.log(x + some) - np.log(x + 1)) + 1
            return out, [float(c1.sum()), float(t1.sum()), float((c1 == 1).sum()), float((c1 == 2).sum()), float(opened.sum()), float(len(some))]

        return save(totals(from_blocks(blocks, KNOWN, up, UP_SCHEMA, *([before] if later else [])), w_buckets, step, done), "hpylm-sweep")

    states, params, before = [], [], None
    for s in range(burn_in + samples + 1):
        state = sweep(2 + s, before, p)
        c, t, ones, twos, opened, contexts = summed(state)[:6]
        p_next = replace(p, customers=c, tables=t, d1=min(0.95, max(0.05, ones / max(1, ones + 2 * twos))))
        if p.n and contexts:
            # -E log x of Beta(theta + 1, c - 1), at the mean size of a context
            mean = max(1.5, p.n / contexts)
            p_next = replace(p_next, theta=float(np.clip((1 + opened) / (1 + contexts * (np.log(mean + p.theta) - np.log(p.theta + 0.5))), 0.05, 5000)))
        states.append(state)
        params.append((p, p_next))
        before, p = state, p_next
    used = list(range(burn_in + 1, burn_in + samples + 1))

    def final(row: dict, steps: dict) -> pa.Table:
        x = Block(row)
        bigrams, lens, train = spread(row["bigrams"], np.uint32), spread(row["lens"], np.uint32).astype(np.int64), np.frombuffer(row["train"], np.uint8).astype(bool)
        starts = np.concatenate([[0], np.cumsum(lens + 1)[:-1]]).astype(np.int64)
        c = x.word_totals.astype(np.float64)
        states = {s: answered(steps.get(2 + s, []), x.hashes, w_buckets, WORD) for s in sorted({s - d for s in used for d in (0, 1)})}
        steps.clear()
        seated = tables_of(x, None, *((states[s - 1], params[s][0], 2 + s) for s in used))
        after = params[used[-1]][1]
        average = np.zeros(len(x.totals))
        # some bigrams at a time, so that what is worked out on the way stays small
        words = {s: (params[s][1].parent(states[s]["c1"].astype(np.float64), states[s]["t1"].astype(np.float64)), states[s]["t"].astype(np.float64)) for s in used}
        for k in range(0, len(average), TOGETHER):
            part = slice(k, k + TOGETHER)
            u, v, total = x.u[part], x.v[part], x.totals[part]
            size = c[u]
            for s, t in zip(used, seated, strict=True):
                given, after = params[s]
                parent, tables = words[s][0][v], words[s][1][u]
                own = (np.maximum(total - given.d * t[part], 0) + (after.theta + given.d * tables) * parent) / (after.theta + size)
                average[part] += np.where(size > 0, own, parent) / len(used)
        base = np.log10((c + 0.1) / (after.n + 0.1 * (after.v + 1)))
        heard, v = (c > 0).astype(np.int64), x.v.astype(np.uint32)
        del states, seated, words, x
        score = np.add.reduceat(np.log10(average)[bigrams], starts)
        del average
        v = v[bigrams]
        known, base_score = (np.add.reduceat(by_word[v], starts) for by_word in (heard, base))
        cols = [row["ids"], ~train, lens + 1, known, np.full(len(lens), after.n, np.int64), base_score, score]
        kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        return pa.table([pa.array(a, k) for a, k in zip(cols, kinds, strict=True)], [id_col, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    needed = sorted({i for s in used for i in (s - 1, s)})
    out = save(from_blocks(blocks, [*KNOWN, "ids", "train", "lens", "bigrams"], final, out_schema, *[states[i] for i in needed]), "hpylm-scores")
    for done in states:
        drop_saved(done)
    for name in names:
        spark.sql(f"DROP TABLE {name}")
    return told(out)
