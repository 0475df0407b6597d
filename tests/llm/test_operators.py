"""The operators against brute force on small tables with nulls, blanks, repeats, clashing columns and no rows."""

import collections
import gc
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from veilframe.llm import components, hpylm, mixing, neighbours, packing, passages, simhash, sstable, toxicity, warc
from veilframe.llm.common import new_path, save

WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, cell_no int"


def made(seed=1, n=60):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        text = " ".join(rng.choice(WORDS, int(rng.integers(1, 200)))) + ".\nEnd  of it"
        out.append((i, text, "en", f"s{i % 3}", len(text), 1, 2, 3))
    out[5] = (5, out[4][1], *out[5][2:])
    out[6] = (6, out[4][1].replace("w1", "w1x", 1), *out[6][2:])
    shared = " ".join(rng.choice(WORDS, 70))
    for i in (10, 20, 30):
        out[i] = (i, out[i][1] + " " + shared + f" tail{i}", *out[i][2:])
    return [*out, (60, None, None, None, None, None, None, None), (61, "", None, "s1", 0, 0, 0, 0), (None, "lost words here", "en", "s0", 5, 0, 0, 0), (62, " \t\n ", "en", None, 4, 0, 0, 0), (63, "long " * 30000, "en", "s2", 150000, 0, 0, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return save(spark.createDataFrame(made(), SCHEMA), "test-docs")


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(docs, none):
    names = {"size": "words"}
    got = mixing.mix(docs, names=names).collect()
    assert len(got) == len(made())
    total = sum(len(words(r[1])) for r in made())
    assert math.isclose(sum({(r.source): r.target for r in got}.values()), total)
    for r in got:
        assert r.words == len(words(r.text)) and r.taken == r.copies * r.words and 0 <= r.copies <= 3
        assert r.copies in (math.floor(r.target / max(1, r.source_size)), math.ceil(r.target / max(1, r.source_size)))
    assert mixing.emit(docs).count() == sum(r.copies for r in got)
    assert mixing.emit(docs).columns == docs.columns
    assert mixing.mix(none, names=names).collect() == []


def brute_fingerprint(t, size):
    w = (t or "").encode().lower().split()
    s = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(docs, none):
    for r in simhash.fingerprints(docs, keep=("doc_id", "text")).collect():
        assert r.fp % (1 << 64) == brute_fingerprint(r.text, 3)
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    assert got[5].component_id == 4 and got[60].component_id == got[61].component_id == got[62].component_id == 60
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({(r.root) for r in simhash.near_duplicates(docs).collect()})
    assert simhash.near_duplicates(none).collect() == []


def test_crowded_keys_lose_no_link(spark):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 62))
    prints = {centre ^ sum(1 << int(b) for b in rng.choice(20, k, replace=False)) for k in (1, 2, 3, 4) for _ in range(60)}
    prints |= {int(x) for x in rng.integers(0, 1 << 62, 50)}
    edges = simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    got = {r.node: r.root for r in components.components(edges).collect()}
    names = {p: p for p in prints}
    todo = True
    while todo:
        todo = False
        for a in prints:
            for b in prints:
                if (a ^ b).bit_count() <= 2 and names[a] > names[b]:
                    names[a], todo = names[b], True
    assert {p: got.get(p, p) for p in prints} == names


def test_passages(docs, none):
    found = passages.repeated_passages(docs).collect()
    spans = collections.defaultdict(set)
    for r in found:
        spans[r.id] |= set(range(r.start_word, r.end_word))
    texts = {r[0]: words(r[1]) for r in made()}
    for i in (20, 30):
        at = len(texts[i]) - 71
        assert set(range(at, at + 70)) <= spans[i]
    assert set(range(len(texts[5]))) <= spans[5] and not {10, 40, 50, 63} & set(spans)
    left = {r.doc_id: r for r in passages.drop_repeated(docs).collect()}
    assert 5 not in left and left[30].text.endswith("tail30") and left[30].n_chars == len(left[30].text) and left[10].text == made()[10][1]
    assert passages.repeated_passages(none).collect() == []


def test_compact_windows_by_brute_force():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 1 << 63, 300).astype(np.uint64)
    low = np.uint64((1 << 24) - 1)
    keys = (h & ~low) | np.arange(300, dtype=np.uint64)
    for least in (5, 20, 46):
        windows = list(passages.compact_windows(h, least))
        covered = {(i, j): c for a, c, b in windows for i in range(a, c + 1) for j in range(c, b + 1) if j - i + 1 >= least}
        assert covered == {(i, j): i + int(np.argmin(keys[i : j + 1])) for i in range(300) for j in range(i + least - 1, 300)}


def test_packing(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    got = packing.pack(save(packing.pieces(docs, path), "test-pieces")).collect()
    plain = Tokenizer.from_file(path)
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t, *_ in made():
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        assert b"".join(r.ids for r in sorted(by[i], key=lambda r: r.piece)) == ids
    places = collections.defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        assert [o for o, _ in sorted(p)] == [sum(n for _, n in sorted(p)[:k]) for k in range(len(p))] and sum(n for _, n in p) <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert packing.pack(packing.pieces(none, path)).collect() == []


def test_texts_with_added_tokens_and_odd_letters():
    """Ids are the library's own for any text, end marks spelled out included."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from veilframe.llm.tokens import Encoder

    rng = np.random.default_rng(6)
    letters = list("ab éÜ ,.!?-'0129\n\t  xyzñß—…“”$%/()<>_|日本")
    texts = ["".join(rng.choice(letters, int(rng.integers(0, 60)))) for _ in range(3000)] + ["a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y"]
    for kind, name in (("words", "word_bpe_49k.json"), ("bytes", "byte_bpe_50k.json")):
        path = public_tokenizers.path(name)
        own, plain = Encoder(path, kind), Tokenizer.from_file(path)
        assert all(own.encode(t) == np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts)


def test_shards(spark, docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path, where = public_tokenizers.path("word_bpe_49k.json"), new_path(spark, "test-shards")
    sstable.write(docs, where, tokenizer=path, kind="words", end_id=1, shard_bytes=20_000)
    got = sorted(sstable.positions(spark, where).collect(), key=lambda r: r.start)
    plain, at = Tokenizer.from_file(path), 0
    for r, (i, t, *_) in zip(got, sorted(made(), key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        ids = np.array(plain.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (r.key, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert {r.key for r in sstable.lookup(spark, where, [3, 63, 9999]).collect()} == {3, 63}
    assert sstable.find(spark, where, 3) == [r.ids for r in sstable.lookup(spark, where, [3]).collect()] and sstable.find(spark, where, 9999) == []
    sstable.write(none, where + "-none", tokenizer=path, kind="words", end_id=1)
    assert sstable.positions(spark, where + "-none").collect() == []


def test_warc(spark):
    rows = [(3, "http://a/\n", "x" * 500), (1, None, "x" * 500), (2, "u", None), (4, "u", "é" * 60), (5, "u", "é" * 60), (6, "u", "short"), (7, "u", "short"), (None, "u", "x" * 500)]
    where = new_path(spark, "test-warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), where)
    got = {r.page_id: r for r in warc.read(spark, where).collect()}
    assert {i: r.refers_to for i, r in got.items()} == {1: None, 2: None, 3: 1, 4: None, 5: 4, 6: None, 7: None, None: 1}
    assert got[1].payload == b"x" * 500 and got[3].payload is None and got[3].payload_bytes == 500 and got[4].payload.decode() == "é" * 60
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), where + "-none")
    assert warc.read(spark, where + "-none").collect() == []


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16))
    rows = [(i, x[i].tolist()) for i in range(400)] + [(400 + i, x[0].tolist()) for i in range(60)] + [(900, None), (920, [0.0] * 16), (940, [float("nan")] * 16), (None, x[1].tolist()), (960, [1.0])]
    got = collections.defaultdict(list)
    for r in sorted(neighbours.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), key=lambda r: (r.query_id, r.rank)):
        got[r.query_id].append(r.vec_id)
    real = {i: np.array(v) for i, v in rows if i is not None and i < 900}
    assert set(got) == {i for i in real if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        best = sorted((i for i in real if i != q), key=lambda i: (-round(float(real[q] @ real[i]), 9), i))[:20]
        hit += len(set(best) & set(found))
    assert hit >= 0.9 * 20 * len(got)
    assert got[0][:3] == [400, 401, 402]
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_language_model(docs, none):
    got = hpylm.score(docs).collect()
    assert len(got) == len(made())
    counts = collections.Counter()
    for i, t, *_ in made():
        if i is None or zlib.crc32(str(i).encode()) % 10:
            counts.update((t or "").lower().split())
            counts[None] += 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        text = next(t for i, t, *_ in made() if i == r.doc_id)
        tokens = [*(text or "").lower().split(), None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens), sum(counts[t] > 0 for t in tokens), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in tokens))
        assert r.score < 0
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) - 50
    assert hpylm.score(none).collect() == []


def test_language_model_against_a_plain_sampler(spark):
    """Held-out perplexity is near that of customers who leave and sit down again one by one."""
    rng = np.random.default_rng(21)
    after = {w: rng.choice(WORDS[:40], 4) for w in WORDS[:40]}
    rows = []
    for i in range(300):
        w, text = str(rng.choice(WORDS[:40])), []
        for _ in range(30):
            text.append(w)
            w = str(rng.choice(after[w]))
        rows.append((i, " ".join(text)))
    got = hpylm.score(spark.createDataFrame(rows, "doc_id long, text string"), burn_in=2, samples=3).collect()
    held = [r for r in got if r.held_out]
    mine = 10 ** (-sum(r.score for r in held) / sum(r.n_tokens for r in held))
    counts, single = collections.Counter(), collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 10:
            ws = ["<s>", *t.split(), "</s>"]
            counts.update(zip(ws, ws[1:], strict=False))
            single.update(ws[1:])
    v, d, theta = len(single), 0.5, 1.0
    seats = {k: [1] * c for k, c in counts.items()}
    tables, customers = collections.Counter(), collections.Counter()
    for (u, w), t in seats.items():
        tables[u] += len(t)
        customers[w] += len(t)
    total = collections.Counter()
    for (u, _), c in counts.items():
        total[u] += c
    parent = lambda w: (customers[w] + 1 / (v + 1)) / (sum_customers[0] + 1)
    sum_customers = [sum(customers.values())]
    for _ in range(3):
        for (u, w), t in seats.items():
            for _ in range(counts[u, w]):
                k = int(rng.choice(len(t), p=np.array(t) / sum(t)))
                t[k] -= 1
                if not t[k]:
                    t.pop(k)
                    tables[u] -= 1
                    customers[w] -= 1
                    sum_customers[0] -= 1
                weights = np.array([*(n - d for n in t), (theta + d * tables[u]) * parent(w)])
                k = int(rng.choice(len(weights), p=weights / weights.sum()))
                if k == len(t):
                    t.append(1)
                    tables[u] += 1
                    customers[w] += 1
                    sum_customers[0] += 1
                else:
                    t[k] += 1
    logs, n = 0.0, 0
    for i, t in rows:
        if not zlib.crc32(str(i).encode()) % 10:
            ws = ["<s>", *t.split(), "</s>"]
            for u, w in zip(ws, ws[1:], strict=False):
                own = max(counts[u, w] - d * len(seats.get((u, w), ())), 0)
                logs += math.log10((own + (theta + d * tables[u]) * parent(w)) / (theta + total[u]))
                n += 1
    # the other sampler keeps its parameters fixed, so it may be a little worse
    assert -0.25 < math.log(mine / 10 ** (-logs / n)) < 0.1
    assert all(math.isclose(r.perplexity, 10 ** (-r.score / r.n_tokens)) for r in got)


def test_seats_are_between_one_and_all():
    c = np.array([0, 1, 2, 50, 5000])
    t = hpylm.seat(c, np.full(5, 0.5), 0.5, np.arange(5, dtype=np.uint64), 1)
    assert (t >= np.minimum(c, 1)).all() and (t <= c).all()


def test_toxicity(spark):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        sentences = [" ".join(rng.choice(WORDS, 8)) + "." for _ in range(int(rng.integers(1, 12)))]
        if bad := i % 5 == 0:
            sentences[int(rng.integers(0, len(sentences)))] = f"you {rng.choice(['grubble', 'snarkle'])} {rng.choice(WORDS)}."
        rows.append((i, " ".join(sentences), 0.0))
        labels.append((i, int(bad)))
    rows += [(1000, None, 0.0), (1001, "", 0.0), (None, "you grubble", 0.0)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score double"), spark.createDataFrame([*labels, (1, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(docs, toxicity.train(docs, marks)).collect()}
    held = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i].score >= 0.5) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    for i in held:
        for s in got[i].offending:
            assert re.search("grubble|snarkle", rows[i][1][s.start : s.end])
    assert 0 <= got[1000].score == got[1001].score < 0.5 <= got[None].score
    assert toxicity.drop_toxic(docs, marks).count() == sum(r.score < 0.5 for r in got.values())
    assert toxicity.score(docs.limit(0), toxicity.train(docs.limit(0), marks.limit(0))).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(made(), SCHEMA).drop("size", "fp", "cell_no").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(50)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {r.doc_id for r in got} <= {r[0] for r in made()} and 5 not in {r.doc_id for r in got}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    tracker = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    gc.collect()
    before = tracker()
    kept = [save(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "test-shuffle") for _ in range(3)]
    assert tracker() <= before and sum(r["count"] for k in kept for r in k.collect()) == 3000


def test_language_model_writes_its_blocks_once(docs, monkeypatch):
    written, real = [], DataFrameWriter.saveAsTable

    def told(self, name, *rest, **more):
        real(self, name, *rest, **more)
        written.append(set(self._df.columns))

    monkeypatch.setattr(DataFrameWriter, "saveAsTable", told)
    assert hpylm.score(docs).count() == len(made())
    assert [c & {"ids", "words", "pairs", "bigrams"} for c in written] == [{"ids", "words", "pairs", "bigrams"}, set()]


def test_tables_are_those_of_customers_seated_one_by_one():
    rng = np.random.default_rng(3)
    counts, fresh, keys = rng.integers(0, 60, 300), rng.uniform(0.1, 9, 300), rng.integers(0, 1 << 62, 300).astype(np.uint64)
    plain = []
    for c, f, k in zip(counts, fresh, keys, strict=True):
        tables = min(c, 1)
        for sit in range(1, c):
            u = hpylm.unit(hpylm.scramble(hpylm.scramble(np.array([k]) + hpylm.salt_of(5)) + hpylm.salt_of(sit - 1)))[0]
            tables += u < f / (f + sit - 0.4 * tables)
        plain.append(tables)
    assert hpylm.seat(counts, fresh, 0.4, keys, 5).tolist() == plain


def test_seatings_made_at_once_are_those_made_one_by_one():
    rng = np.random.default_rng(33)
    counts, keys = rng.zipf(1.4, 3000).clip(2, 20000), rng.integers(0, 1 << 64, 3000, np.uint64)
    first, second = rng.exponential(2.0, (2, 3000))
    both = hpylm.seat(counts, np.concatenate([first, second]), 0.6, keys, 4, 5).tolist()
    assert both == [*hpylm.seat(counts, first, 0.6, keys, 4).tolist(), *hpylm.seat(counts, second, 0.6, keys, 5).tolist()]
