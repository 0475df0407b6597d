import random

from veilframe.llm.queries import tokenizer_path
from veilframe.llm.tokens import Encoder


def test_plain_pieces_are_cut_as_the_library_cuts_them(monkeypatch):
    own = Encoder(tokenizer_path("word_bpe_49k.json"), "words")
    rng = random.Random(3)
    texts = ["It's 2021-03-04, JOHN'S a.b@c.de x'T 'd'dd'VE''re", "#$%'sa \"''t\" 10'000.5e-3 A_b_C\x7f \x01x"]
    texts += [" ".join("".join(rng.choice("'stREmlvd09AZz.-_@") for _ in range(rng.randint(1, 12))) for _ in range(200)) for _ in range(20)]
    for text in texts:
        assert own.encode(text) == own._whole(text)
    # the library is not asked about plain pieces
    monkeypatch.setattr(Encoder, "_whole", lambda self, text: 1 / 0)
    own.encode("never-seen-before@2031-12-09.example 77'000's")


def test_a_worker_remembers_a_bounded_number_of_pieces(monkeypatch):
    own = Encoder(tokenizer_path("byte_bpe_50k.json"), "bytes")
    text = "Some words, some 2021 numbers; Wörter and more words."
    whole = own._whole(text)
    monkeypatch.setattr(own.memory, "encode", lambda piece: b"")
    for i in range(500_000):
        own.memory[f" never{i}"]
    assert len(own.memory) + len(own.memory.old) <= 400_000
    monkeypatch.undo()
    assert own.encode(text) == whole == own.encode(text)
