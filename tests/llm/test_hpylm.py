import tracemalloc

import numpy as np

from veilframe.llm import hpylm as H


def test_dishes_seated_in_parts_sit_as_they_do_together(monkeypatch):
    rng = np.random.default_rng(2)
    counts = np.minimum(rng.zipf(1.4, 5000), 100_000)
    keys, fresh = rng.integers(0, 1 << 63, 5000).astype(np.uint64), rng.random(10_000) * 9
    monkeypatch.setattr(H, "DISHES", 1 << 20)
    whole = H.seat(counts, fresh, 0.6, keys, 3, 4)
    monkeypatch.setattr(H, "DISHES", 7)
    assert (H.seat(counts, fresh, 0.6, keys, 3, 4) == whole).all()
    assert (whole >= 1).all() and (whole <= np.tile(counts, 2)).all()


def test_seating_takes_little_room():
    rng = np.random.default_rng(2)
    counts, keys, fresh = rng.integers(128, 4000, 300_000), rng.integers(0, 1 << 63, 300_000).astype(np.uint64), np.full(300_000, 3.0)
    tracemalloc.start()
    H.seat(counts, fresh, 0.6, keys, 3)
    most = tracemalloc.get_traced_memory()[1] / counts.nbytes
    tracemalloc.stop()
    assert most < 9  # arrays of a number for each dish
