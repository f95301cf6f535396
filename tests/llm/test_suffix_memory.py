"""Scratch memory of the suffix stage stays small beside the block it sorts."""

import random
import tracemalloc

import numpy as np

from clientlens.llm import suffix_dedup


def test_comparing_the_windows_of_a_block_takes_little_scratch(monkeypatch):
    rng = random.Random(3)
    n, cell = 600, suffix_dedup.CELL
    right = [bytes(rng.choice(b"abcd") for _ in range(cell - 1)) for _ in range(n // 2)] * 2
    left = [bytes(rng.choice(b"abcd") for _ in range(cell - 1)) for _ in range(n // 2)] * 2
    sort = suffix_dedup.suffix_array

    def sorted_(text):
        order = sort(text)
        tracemalloc.start()  # what comes after the sorting
        return order

    monkeypatch.setattr(suffix_dedup, "suffix_array", sorted_)
    try:
        flags = suffix_dedup.repeated_windows(left, right, [cell] * n, np.zeros(n, np.int64))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert all(f.all() for f in flags)
    assert most < 16 << 20
