"""SentencePiece ids of whole texts, for vocabularies of the merge type, and texts back from ids.

A text is normalised as its vocabulary says, cut into symbols, and adjacent pairs whose union is a piece wait in an agenda
by score, ties to the left; the best pair is merged, its new neighbours come into the agenda, until it is empty. Where no
piece holds two characters side by side, no merge ever crosses them, so a text is cut there and each part has an agenda of
its own; a worker remembers what became of parts. Of every Arrow batch, one text in eight (or any other share, up to all) is
encoded by the sentencepiece library as well and compared.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2 as proto

from veilframe.llm.common import arrow_map, released, slices
from veilframe.llm.tokens import Memory

SPACE = "▁"
#: Parts remembered by a worker process: as many in use, and as many from before. Longer ones than LONG are not remembered.
MEMO, LONG = 150_000, 48
#: Bits of up to so many characters have their agendas side by side in a table, TOGETHER at a time; a longer one has a heap.
SHORT, TOGETHER = 24, 4096
NEVER = np.iinfo(np.int32).max
#: Texts, and characters, that are taken at a time.
ROWS, CHARS = 512, 1 << 20


class Pieces:
    """A vocabulary of the merge type with byte fallback."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            content = f.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        model = proto.ModelProto.FromString(content)
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE or not model.trainer_spec.byte_fallback:
            raise ValueError("only vocabularies of the merge type with byte fallback")
        kind = proto.ModelProto.SentencePiece
        self.ids, self.cost, self.unused = {}, {}, set()
        fixed = []
        for i, p in enumerate(model.pieces):
            if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED):
                self.ids[p.piece], self.cost[p.piece] = i, -p.score
            if p.type == kind.USER_DEFINED:
                fixed.append(p.piece)
            if p.type == kind.UNUSED:
                self.unused.add(p.piece)
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # pieces that the user defined are never cut, and may reach over any border
        self.fixed = frozenset(fixed)
        self.symbol = re.compile("|".join([*map(re.escape, sorted(fixed, key=len, reverse=True)), "."]), re.DOTALL).findall if fixed else list
        self.side_by_side = {p[i : i + 2] for p in self.cost for i in range(len(p) - 1)}
        spaced = any(x[1] == SPACE != x[0] for x in self.side_by_side)
        self.parts = (lambda text: [text]) if fixed or spaced else re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+").findall
        spec = model.normalizer_spec
        self.plain = not spec.precompiled_charsmap and spec.add_dummy_prefix and not spec.remove_extra_whitespaces and spec.escape_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        self.memory, self.bits = Memory(self.whole, MEMO), Memory(self.part, MEMO)
        self._tables()

    def _tables(self) -> None:
        """What agendas of many bits at once look up: characters to symbols, pairs of symbols to their union and its cost."""
        names = [*self.cost, *sorted({c for p in self.cost for c in p} - self.cost.keys())]
        code = {p: i for i, p in enumerate(names)}
        self.base, self.id_of = len(names), np.array([self.ids.get(p, -1) for p in names], np.int32)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        for p in names:
            if len(p) == 1:
                self.symbol_of[ord(p)] = code[p]
        pairs = sorted((code[p[:k]] * self.base + code[p[k:]], code[p], self.cost[p]) for p in self.cost for k in range(1, len(p)) if p[:k] in code and p[k:] in code)
        self.pair = np.array([x[0] for x in pairs], np.int64)
        self.union = np.array([x[1] for x in pairs], np.int32)
        self.rank = np.unique(np.array([x[2] for x in pairs]), return_inverse=True)[1].astype(np.int32)
        self.beside = np.array(sorted(ord(x[0]) << 21 | ord(x[1]) for x in self.side_by_side), np.int64)

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text)
        return SPACE + text.replace(" ", SPACE) if text else ""

    def looked_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cost of each pair of symbols (NEVER if they never merge) and the symbol they become."""
        key = np.where((left < 0) | (right < 0), -1, left.astype(np.int64) * self.base + right)
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.rank[at], NEVER), self.union[at]

    def together(self, bits: list[str]) -> list[bytes]:
        """Ids of many bits of at most SHORT characters, all of them known symbols. Each bit is a row with an agenda of its own, the
        costs of its adjacent pairs; a turn merges the first least one of every row that has any."""
        sizes = np.array([len(b) for b in bits])
        width = int(sizes.max())
        inside = np.arange(width) < sizes[:, None]
        symbols = np.full((len(bits), width + 1), -1, np.int32)
        symbols[:, :width][inside] = self.symbol_of[np.frombuffer("".join(bits).encode("utf-32-le"), np.uint32)]
        costs, unions = self.looked_up(symbols[:, :-1], symbols[:, 1:])
        costs = np.concatenate([costs, np.full((len(bits), 1), NEVER, np.int32)], axis=1)
        unions = np.concatenate([unions, unions[:, :1]], axis=1)
        done = symbols.copy()
        rows, places = np.arange(len(bits)), np.arange(width + 1)
        while len(rows):
            best = costs.argmin(1)
            n = np.arange(len(rows))
            going = costs[n, best] < NEVER
            if not going.all():
                done[rows[~going]] = symbols[~going]
                rows, symbols, costs, unions, best = rows[going], symbols[going], costs[going], unions[going], best[going]
                n = n[: len(rows)]
            if not len(rows):
                break
            symbols[n, best] = unions[n, best]
            # what stands behind the right one of the pair moves up
            moved = np.minimum(places + (places > best[:, None]), width)
            symbols = np.take_along_axis(symbols, moved, 1)
            symbols[:, width] = -1
            moved = np.minimum(places + (places >= best[:, None]), width)
            costs, unions = np.take_along_axis(costs, moved, 1), np.take_along_axis(unions, moved, 1)
            costs[:, width] = NEVER
            costs[n, best], unions[n, best] = self.looked_up(symbols[n, best], symbols[n, np.minimum(best + 1, width)])
            k = n[best > 0]
            costs[k, best[k] - 1], unions[k, best[k] - 1] = self.looked_up(symbols[k, best[k] - 1], symbols[k, best[k]])
        ends = 4 * np.cumsum((done >= 0).sum(1))
        found = self.id_of[done[done >= 0]]
        if (found < 0).any():  # a character of pieces that is none itself
            return [self.part(b) for b in bits]
        flat = found.tobytes()
        return [flat[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def learn(self, parts: list[str]) -> None:
        """Parts that are not in memory, cut and merged all together, so that memory has them."""
        new = [p for p in parts if p not in self.memory.old]
        if self.fixed or self.unused or not new:
            return
        points = np.frombuffer("".join(new).encode("utf-32-le"), np.uint32).astype(np.int64)
        key = points[:-1] << 21 | points[1:]
        at = np.minimum(np.searchsorted(self.beside, key), len(self.beside) - 1)
        cut = np.concatenate([[True], self.beside[at] != key])
        ends = np.cumsum(list(map(len, new)))
        cut[ends[:-1]] = True
        begins = np.flatnonzero(cut)
        text = "".join(new)
        cuts = [text[a:b] for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(text)], strict=True)]
        held, before = self.bits, self.bits.old
        short = sorted((b for b in dict.fromkeys(cuts) if 1 < len(b) <= SHORT and b not in held and b not in before), key=len)
        for k in range(0, len(short), TOGETHER):
            some = short[k : k + TOGETHER]
            held.update(zip(some, self.together(some), strict=True))
        sizes = np.searchsorted(begins, ends).tolist()
        for p, a, b in zip(new, [0, *sizes], sizes, strict=False):
            self.memory[p] = b"".join(map(held.__getitem__, cuts[a:b])) if b - a > 1 else held[cuts[a]]
        self.memory.turn()
        held.turn()

    def merged(self, text: str) -> list[str]:
        """The symbols of text after all merges."""
        symbols = self.symbol(text)
        return symbols if len(symbols) == 1 else self.heaped(symbols)

    def heaped(self, symbols: list[str]) -> list[str]:
        """All merges of any number of symbols: pairs wait in a heap, those out of date are passed over."""
        n = len(symbols)
        cost, frozen = self.cost.get, self.fixed
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        made_of: dict[str, tuple[str, str]] = {}
        agenda = []
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            c = cost(a + b)
            if c is not None and not (frozen and (a in frozen or b in frozen)):
                agenda.append((c, i, a, b))
        heapq.heapify(agenda)
        while agenda:
            _, i, a, b = heapq.heappop(agenda)
            j = after[i]
            # a pair of which one was merged meanwhile is out of date
            if symbols[i] is not a or j >= n or symbols[j] is not b:
                continue
            both = symbols[i] = a + b
            if both in self.unused:
                made_of[both] = (a, b)
            symbols[j] = None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                c = cost(both + symbols[k])
                if c is not None and symbols[k] not in frozen:
                    heapq.heappush(agenda, (c, i, both, symbols[k]))
            h = before[i]
            if h >= 0:
                c = cost(symbols[h] + both)
                if c is not None and symbols[h] not in frozen:
                    heapq.heappush(agenda, (c, h, symbols[h], both))
        out = [s for s in symbols if s is not None]
        while self.unused and any(s in made_of for s in out):  # what is not in use falls back to what it was made of
            out = [x for s in out for x in made_of.get(s, (s,))]
        return out

    def part(self, text: str) -> bytes:
        """Ids of a part of a normalised text, from its agenda, as 32-bit integers."""
        out = []
        for s in self.merged(text):
            i = self.ids.get(s)
            if i is None:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(i)
        return np.array(out, np.int32).tobytes()

    def cut(self, text: str) -> list[str]:
        """A long part, cut wherever no piece holds both neighbours."""
        if self.fixed:
            return [text]
        at = [0, *(i for i in range(1, len(text)) if text[i - 1 : i + 1] not in self.side_by_side), len(text)]
        return [text[a:b] for a, b in zip(at, at[1:], strict=False)]

    def whole(self, part: str) -> bytes:
        """Ids of what is between blanks, from those of what no merge can cross."""
        return b"".join(self.bits[x] if len(x) <= LONG else self.part(x) for x in self.cut(part))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what the texts have in common is worked out once."""
        split = [self.parts(self.normalised(t)) for t in texts]
        distinct = dict.fromkeys(chain.from_iterable(split))
        missing = [p for p in distinct if p not in self.memory and len(p) <= LONG]
        for k in range(0, len(missing), TOGETHER):
            self.learn(missing[k : k + TOGETHER])
        known = {p: self.memory[p] if len(p) <= LONG else self.whole(p) for p in distinct}
        return [np.frombuffer(b"".join(map(known.__getitem__, parts)), np.int32) for parts in split]

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    """One a worker process."""
    return Pieces(path)


def _runs(texts: list[str]) -> Iterator[list[str]]:
    """Texts in runs of about CHARS characters, at least one a run."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHARS:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", agreed: str = "agreed", decoded: str | None = None, every: int = 8) -> DataFrame:
    """docs without `text`, with its ids (array<int>) and whether the library has the same ones (asked of the first and then each
    `every`-th text of a batch, null for others; 1 asks for all); and, if a name is given, with the text that the library's
    decode makes of the ids.

    Cases: a null text is an empty one, which has no ids; characters that are no piece become their bytes; texts of any length are
    encoded whole; repeated rows each; no rows give no rows; columns of the names to be added are replaced.
    """
    added = [ids, agreed, *([decoded] if decoded else [])]
    kept = [f for f in docs.schema.fields if f.name not in (text, *added)]
    kinds = [f"`{ids}` array<int>", f"`{agreed}` boolean", *([f"`{decoded}` string"] if decoded else [])]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *kinds])
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in slices(batches, ROWS):
            done = 0
            for texts in _runs([t or "" for t in b.column(text).to_pylist()]):
                got = v.encode_all(texts)
                same: list[bool | None] = [None] * len(texts)
                for i, y in zip(range(0, len(texts), every), v.library.encode(texts[::every], out_type="numpy", num_threads=1), strict=True):
                    same[i] = np.array_equal(got[i], y)
                part, done = b.slice(done, len(texts)), done + len(texts)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                columns = {c: part.column(c) for c in names} | {ids: pa.ListArray.from_arrays(ends, np.concatenate(got)), agreed: pa.array(same, pa.bool_())}
                if decoded:
                    columns[decoded] = pa.array(v.library.decode(got), pa.string())
                yield pa.RecordBatch.from_pydict(columns)
            released()

    return arrow_map(docs.select(text, *names), run, schema)


def decode(encoded: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """encoded with the text of its ids (null ids: an empty one); columns of that name are replaced."""
    kept = [f for f in encoded.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), f"`{text}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = vocabulary(path).library
        for b in slices(batches, ROWS):
            texts = library.decode([x or [] for x in b.column(ids).to_pylist()])
            yield pa.RecordBatch.from_pydict({f.name: b.column(f.name) for f in kept} | {text: pa.array(texts, pa.string())})

    return arrow_map(encoded.select([f.name for f in kept]), run, schema)
