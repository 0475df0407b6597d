"""Toxicity by multiple-instance learning: a document is toxic when at least one of its sentences is.

A sentence scores sigmoid(bias + sum of the weights of its distinct words); sentences, and one leak that stands for
labels which no sentence explains, are combined by noisy-or. Only document labels are needed: the noisy-or passes the
blame to the sentences, which afterwards show where the offence is.

A word has features of its own and of its beginnings and ends (4 to 6 letters), so unseen forms of a known stem count.
Training takes at most `most_rows` labels (picked by a hash of the id) and their whole texts to one task, a bound that
does not grow with the corpus. Scoring covers every whole text.

Cases: null text is empty; a text without words has no sentence and scores the leak alone; rows with a null or unknown
label, or a null id, teach nothing; several labels of one id teach once each; repeated rows score alike; if nothing can
be learnt (no labels, or one class only) every text scores the share of label 1, or 0 without labels.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import arrow_map, fresh, slices

SENTENCE = re.compile(r"[^.!?\n]+(?:[.!?]+(?=\s|$)|[.!?]+|\n|$)?")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
#: Words remembered by a scoring task.
MEMO = 150_000
#: Places for features while training; two features of one place share a weight.
SLOTS = 1 << 21


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}+" for k in (4, 5, 6) if len(word) > k), *(f"+{word[-k:]}" for k in (5, 6) if len(word) > k)]


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """Stretches (start, end) that end at a sentence mark or a line end and hold something besides blanks."""
    for m in SENTENCE.finditer(text):
        if not m[0].isspace():
            yield m.start(), m.end()


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Model:
    bias: float = 0.0
    leak: float = 0.0
    weights: dict[str, float] = field(default_factory=dict)
    memo: dict[str, float] = field(default_factory=dict, repr=False)

    def word(self, w: str) -> float:
        got = self.memo.get(w)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[w] = sum(self.weights.get(f, 0.0) for f in word_features(w))
        return got

    def sentence_scores(self, text: str) -> list[tuple[int, int, float]]:
        out, word = [], self.word
        for a, b in sentences(text):
            found = set(WORD.findall(text[a:b].lower()))
            if found:
                out.append((a, b, sum(map(word, found))))
        return out

    def score(self, parts: list[tuple[int, int, float]]) -> tuple[float, list[float]]:
        """The document's score and its sentences' own."""
        if not self.weights or not parts:
            return self.leak, [0.0] * len(parts)
        p = sigmoid(self.bias + np.array([x for _, _, x in parts]))
        return float(1 - (1 - self.leak) * np.prod(1 - p)), p.tolist()


def fit(texts: Iterable[str], labels: list[int], *, rounds: int = 300, rate: float = 0.3, l2: float = 2e-5, least_docs: int = 4, least_z: float = 3.0) -> Model:
    """Noisy-or multiple-instance logistic model, by Adam over all sentences at once. Texts are read once, one by one;
    labels may grow with them."""
    # words as numbers, their features as slots of a table: texts are held once and no feature is held as a string
    numbers: dict[str, int] = {}
    bags: list[list[np.ndarray]] = []
    for text in texts:
        found = ({*WORD.findall(text[a:e].lower())} for a, e in sentences(text))
        bags.append([np.array([numbers.setdefault(w, len(numbers)) for w in sorted(f)], np.int32) for f in found if f])
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(leak=float(y.mean()) if len(y) else 0.0)
    per_word = [[xxhash.xxh32_intdigest(f) % SLOTS for f in word_features(w)] for w in numbers]
    sizes = np.array([len(s) for s in per_word], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    flat = np.fromiter((s for own in per_word for s in own), np.int32, int(begin[-1]))
    del per_word

    def slots(words: np.ndarray) -> np.ndarray:
        n = sizes[words]
        return flat[np.repeat(begin[words] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]

    seen = np.zeros((2, SLOTS), np.int32)
    for bag, label in zip(bags, labels, strict=True):
        if bag:
            seen[label, np.unique(slots(np.unique(np.concatenate(bag))))] += 1
    # features that go with a label more often than chance would have it
    share, n = y.mean(), seen.sum(axis=0)
    chosen = (n >= least_docs) & (np.abs(seen[1] - n * share) > least_z * np.sqrt(n * share * (1 - share)))
    index = np.where(chosen, np.cumsum(chosen) - 1, -1).astype(np.int32)
    size = int(chosen.sum())
    if not size:
        return Model(leak=float(share))
    cols, sent, doc, k = [], [], [], 0
    for d, bag in enumerate(bags):
        for words in bag:
            own = index[slots(words)]
            own = own[own >= 0]
            cols.append(own)
            sent.append(np.full(len(own), k, np.int32))
            k += 1
        doc += [d] * len(bag)
    cols_, sent_, doc_ = np.concatenate(cols), np.concatenate(sent), np.array(doc, np.int32)
    w, bias, leak = np.zeros(size), -6.0, np.log(0.02)
    m, v, n = np.zeros(size + 2), np.zeros(size + 2), len(y)
    for step in range(1, rounds + 1):
        z = bias + np.bincount(sent_, w[cols_], minlength=k)
        p = sigmoid(z)
        log_clean = -np.bincount(doc_, np.logaddexp(0, z), minlength=n) + np.log1p(-sigmoid(np.array([leak]))[0])
        p_doc = np.clip(-np.expm1(log_clean), 1e-9, 1 - 1e-9)
        # of the log likelihood by z: y (1 - P) / P p - (1 - y) p
        pull = np.where(y == 1, (1 - p_doc) / p_doc, -1.0)
        by_z = pull[doc_] * p
        grad = np.concatenate([np.bincount(cols_, by_z[sent_], minlength=size) - l2 * n * w, [by_z.sum(), (pull * sigmoid(np.array([leak]))[0]).sum()]]) / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w += move[:-2]
        bias, leak = min(bias + move[-2], -2.0), leak + move[-1]
    kept = {}
    for word in numbers:
        for f in word_features(word):
            if (i := index[xxhash.xxh32_intdigest(f) % SLOTS]) >= 0 and abs(w[i]) > 1e-3:
                kept[f] = float(w[i])
    return Model(float(bias), float(sigmoid(np.array([leak]))[0]), kept)



def train(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", folds: int = 5, most_rows: int = 6000) -> Model:
    """Fit on labelled rows outside the held-out fold (crc32 of the id as text, mod folds, is 0), in one task of a worker:
    the driver gets the weights alone."""
    taught = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % folds != 0)).select(F.col(id_col).alias("taught_id"), F.col(label_col).cast("int").alias("taught_label"))
    taught = taught.distinct().orderBy(F.xxhash64("taught_id"), "taught_id", "taught_label").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("text_id"), F.col(text_col).alias("taught_text"))
    rows = texts.join(F.broadcast(taught), F.col("text_id") == F.col("taught_id"))
    rows = rows.orderBy(F.xxhash64("text_id"), "text_id", "taught_label", "taught_text").limit(2 * most_rows).select("taught_text", "taught_label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: list[int] = []

        def texts_() -> Iterator[str]:
            for b in batches:
                for t, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    given.append(label)
                    yield t or ""

        m = fit(texts_(), given)
        names = ["", " ", *m.weights]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([m.bias, m.leak, *m.weights.values()], pa.float64())], ["feature", "weight"])

    found = arrow_map(rows.repartition(1).sortWithinPartitions("taught_label", "taught_text"), run, "feature string, weight double").collect()
    weights = {r.feature: r.weight for r in found}
    return Model(weights.pop("", 0.0), weights.pop(" ", 0.0), weights)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.5, names: tuple[str, str] = ("score", "offending")) -> DataFrame:
    """The columns keep of docs, the score, and the sentences that alone reach threshold: (start, end, score), in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text = fresh([*keep, *names], "scored_text")
    picked = docs.select(*keep, F.col(text_col).alias(text))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, 256):
            scores, found = [], []
            for t in b.column(b.num_columns - 1).to_pylist():
                parts = m.sentence_scores(t or "")
                s, own = m.score(parts)
                scores.append(s)
                found.append([{"start": a, "end": e, "score": p} for (a, e, _), p in zip(parts, own, strict=True) if p >= threshold])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64()), pa.array(found, spans)], [*b.schema.names[:-1], *names])
        m.memo.clear()

    head = [f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]]
    return arrow_map(picked, run, ", ".join([*head, f"`{names[0]}` double", f"`{names[1]}` array<struct<start:int,end:int,score:double>>"]))


def drop_toxic(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", threshold: float = 0.5, **options) -> DataFrame:
    """docs without the documents that score threshold or more."""
    names = tuple(fresh(docs.columns, x) for x in ("toxic_score", "toxic_sentences"))
    scored = score(docs.withColumn(shadow := fresh(docs.columns, "text_again"), F.col(text_col)), train(docs, labels, text_col=text_col, **options), text_col=shadow, keep=tuple(docs.columns), threshold=threshold, names=names)
    return scored.where(F.col(names[0]) < threshold).select(*docs.columns)
