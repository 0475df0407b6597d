import random

from veilframe.llm.words import PLACES, word_hashes


def test_words_hash_alike_exactly_when_they_are_alike():
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"aAbBzZ \t\n\x0b\x0c\r\x1c\x00,.'\xc3\xa9") for _ in range(rng.randint(0, 300))) for _ in range(200)]
    texts += [b"", b"  ", b"x" * PLACES + b" " + b"X" * PLACES, b"y" * (PLACES + 1) + b" " + b"Y" * (PLACES + 1) + b" " + b"y" * PLACES + b"z"]
    known = {}
    for text, hashes in zip(texts, word_hashes(texts), strict=True):
        words = text.lower().split()
        assert len(words) == len(hashes)
        for word, h in zip(words, hashes.tolist(), strict=True):
            assert known.setdefault(word, h) == h
        assert word_hashes([text])[0].tolist() == hashes.tolist()
    assert len(set(known.values())) == len(known)
