"""Token ids of whole texts by the tokenizers library, with a memory of the pieces that no merge can cross.

A byte-level vocabulary never merges across the boundary in front of a run of non-blanks (with the one blank that
leads it); a word vocabulary never merges across blanks at all. So ids of a text are the ids of its pieces in order,
and the same piece has the same ids wherever it stands. The library encodes each distinct piece once per task. Texts
with characters that Python and the library might class differently as blanks, or with an added token of the vocabulary
spelled out, are encoded whole. A piece of plain ASCII is cut once more where the word vocabulary's own pattern cuts it, as
most of its parts are remembered.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

from tokenizers import Tokenizer

#: White space by Unicode, as in both libraries.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Letters and marks of these sets are classed alike by every Unicode version; between the two a text may be cut as well.
LETTER, MARK = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
BYTE_PIECE = re.compile(f" ?[{LETTER}]+(?=[{MARK}{BLANK}]|$)| ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
WORD_PIECE = re.compile(f"[{LETTER}]+(?=[{MARK}\t-\r ]|$)|[^\t-\r ]+")
ODD = re.compile("[\x1c-\x1f\x85᠎​﻿]")
#: How the vocabulary of words cuts lower-case ASCII without blanks; the pattern in its file that says so.
PLAIN, PART = re.compile("[!-~]+").fullmatch, re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Distinct pieces remembered by a worker process: as many in use, and as many from before. Spark deals tasks in turn to more
#: workers than run at a time, and each keeps its memory; pieces of bytes are the more varied.
MEMO = {"bytes": 200_000, "words": 400_000}
LITTLE = sys.byteorder == "little"
#: Pieces of a very long text that are looked up at a time.
CHUNK = 1 << 20


def _packed(ids: list[int]) -> bytes:
    if LITTLE:
        return array("I", ids).tobytes()
    out = array("I", ids)
    out.byteswap()
    return out.tobytes()


class Memory(dict):
    """Ids by piece; a piece that is not there is encoded. When full, what was not used since the last time is forgotten."""

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def turn(self) -> None:
        """When full, what is in use becomes what is from before."""
        if len(self) >= self.most:
            self.old.clear()
            self.old = dict(self)
            self.clear()

    def __missing__(self, piece: str) -> bytes:
        self.turn()
        ids = self.old.get(piece)
        self[piece] = ids = self.encode(piece) if ids is None else ids
        return ids


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids. kind: "bytes" or "words", the vocabulary's way with blanks."""

    def __init__(self, path: str, kind: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.piece = {"bytes": BYTE_PIECE, "words": WORD_PIECE}[kind]
        # a piece of this shape is one word to the library, so its model can do without the steps before it
        self.word = re.compile({"bytes": f" ?[{LETTER}]+", "words": f"[{LETTER}]+"}[kind]).fullmatch
        self.letters = {ord(c): self._prepared(c) for c in map(chr, range(32, 256)) if self.word(c) or (c == " " and kind == "bytes")}
        self.memory = Memory(self._piece, MEMO[kind])
        steps = json.loads(self.tokenizer.to_str())
        lowers = {"type": "Lowercase"} in ((steps["normalizer"] or {}).get("normalizers") or [])
        cuts = [x.get("pattern") for x in ((steps["pre_tokenizer"] or {}).get("pretokenizers") or [])]
        self.plain = PLAIN if kind == "words" and lowers and cuts == [{"Regex": PARTS}, None] else lambda piece: None
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]

    def _prepared(self, letter: str) -> str:
        """A letter as the model is given it: normalised, and in the characters that stand for bytes."""
        if self.tokenizer.normalizer:
            letter = self.tokenizer.normalizer.normalize_str(letter)
        return "".join(part for part, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(letter))

    def _piece(self, piece: str) -> bytes:
        if self.word(piece):
            return _packed([t.id for t in self.model.tokenize(piece.translate(self.letters))])
        if self.plain(piece):
            parts = PART(piece.lower())
            return b"".join(map(self.memory.__getitem__, parts)) if len(parts) > 1 else _packed([t.id for t in self.model.tokenize(parts[0])])
        return self._whole(piece)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= CHUNK:
            yield self.piece.findall(text)
            return
        part = []
        for m in self.piece.finditer(text):
            part.append(m[0])
            if len(part) >= CHUNK:
                yield part
                part = []
        yield part

    def encode(self, text: str) -> bytes:
        # the library finds added tokens (a mark of a text's end, say) before it splits a text
        if ODD.search(text) or any(t in text for t in self.added):
            return self._whole(text)
        out = [b"".join(map(self.memory.__getitem__, pieces)) for pieces in self._pieces(text)]
        return out[0] if len(out) == 1 else b"".join(out)


@lru_cache(maxsize=4)
def encoder(path: str, kind: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(path, kind)
