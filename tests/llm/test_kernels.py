"""The numpy and Python kernels against plain definitions."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clientlens.llm.decontaminate import tiles
from clientlens.llm.packing import place
from clientlens.llm.quality import base_statistics
from clientlens.llm.suffix_dedup import segments
from clientlens.llm.suffix_sort import suffix_array
from clientlens.llm.words import shingle_sets, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40))
def test_suffix_array_sorts(values):
    text = [*values, 0]
    assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_suffix_array_of_runs_and_many_values():
    for text in ([1] * 300 + [0], list(range(1, 200)) + [0], list(range(200, 0, -1)) + [0], [2, 1] * 150 + [0]):
        assert suffix_array(np.array(text)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aB é\n\t\x0b\x1c中", max_size=20), min_size=1, max_size=5))
def test_words_and_shingles(texts):
    raw = [t.encode() for t in texts]
    w = words(raw)
    found = [[bytes(w.buffer[a:b]).decode() for a, b in zip(w.start[x:y], w.end[x:y], strict=True)] for x, y in zip(w.first[:-1], w.first[1:], strict=True)]
    assert found == [WORD.findall(t) for t in texts]
    for k in (1, 2, 3):
        sets = shingle_sets(raw, k)
        for t, own in zip(texts, sets, strict=True):
            lower = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
            plain = {tuple(lower[i:i + k]) for i in range(len(lower) - k + 1)} if len(lower) >= k else {tuple(lower)} if lower else set()
            assert len(own) == len(plain)
        for i in range(len(texts)):
            for j in range(i):
                a, b = ({tuple(x[n:n + k]) for n in range(len(x) - k + 1)} if len(x) >= k else {tuple(x)} if x else set()
                        for x in (WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[y])) for y in (i, j)))
                assert len(np.intersect1d(sets[i], sets[j])) == len(a & b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab# \n\té", max_size=40), min_size=1, max_size=4))
def test_base_statistics(texts):
    found = [x.tolist() for x in base_statistics([t.encode() for t in texts])]
    for i, t in enumerate(texts):
        w = WORD.findall(t)
        windows = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        hit = {j + n for j, x in enumerate(windows) if windows.count(x) > 1 for n in range(3)}
        lines = t.split("\n")
        again = sum(bool(WORD.search(x)) and x in lines[:n] for n, x in enumerate(lines))
        assert [x[i] for x in found] == [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), again, len(hit)]


def test_segments_cover_every_window_once_and_agree_between_texts():
    rng = random.Random(3)
    shared = bytes(rng.choice(b"abcd ") for _ in range(300))
    texts = [bytes(rng.choice(b"abcd ") for _ in range(150)) + shared + bytes(rng.choice(b"abcd ") for _ in range(100)) for _ in range(3)] + [b"", b"x" * 200, b"short"]
    length, gram = 60, 12
    text, start, windows, back, anchor, _ = segments(texts, length, gram)
    at = {}
    for t, s, n, b, a in zip(text.tolist(), start.tolist(), windows.tolist(), back.tolist(), anchor.tolist(), strict=True):
        for k in range(n):
            assert (t, s + k) not in at
            at[t, s + k] = (b - k, a)
    assert set(at) == {(t, s) for t, x in enumerate(texts) for s in range(len(x) - length + 1)}
    by_window: dict = {}
    for (t, s), where in at.items():
        assert by_window.setdefault(texts[t][s:s + length], where) == where


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_packing_is_gapless_and_opens_no_bin_too_early(sizes):
    lengths = np.array(sizes, np.int64)
    bins, offsets = place(lengths, 50)
    rows = sorted(zip(bins.tolist(), offsets.tolist(), sizes, strict=True))
    ends: dict = {}
    for b, o, s in rows:
        assert o == ends.get(b, 0)
        ends[b] = o + s
    assert all(e <= 50 for e in ends.values())
    if sizes:
        assert len(ends) <= 1 + 2 * -(-sum(sizes) // 50)


def test_packing_reaches_the_bound_on_usual_sizes():
    lengths = np.random.default_rng(0).lognormal(6, 1, 5000).astype(np.int64).clip(1, 4095)
    bins, _ = place(lengths, 4096)
    assert bins.max() + 1 <= -(-lengths.sum() // 4096) + 1


def test_tiles_find_moved_passages_and_never_overlap():
    item = list(range(1, 31))
    text = [99] * 5 + item[20:] + [98] * 3 + item[:10] + [97] + item[10:20]
    found = tiles(text, item, 4)
    assert sum(n for _, _, n in found) == 30
    assert tiles([5, 6, 7], item, 4) == []
    assert sum(n for _, _, n in tiles(item[:10] * 3, item, 4)) == 10  # a word of the item is tiled once
    assert sum(n for _, _, n in tiles([1, 1, 1, 1, 1, 1], [1, 1, 1, 1], 4)) == 4


@pytest.mark.parametrize("seed", range(20))
def test_tiles_cover_what_seeds_allow(seed):
    rng = random.Random(seed)
    item, text = ([rng.randint(1, 3) for _ in range(n)] for n in (12, 25))
    found = tiles(text, item, 3)
    covered = [q + k for _, q, n in found for k in range(n)]
    assert len(covered) == len(set(covered))
    placed = [p + k for p, _, n in found for k in range(n)]
    assert len(placed) == len(set(placed))
    assert all(text[p:p + n] == item[q:q + n] and n >= 3 for p, q, n in found)
    free_t, free_i = set(range(25)) - set(placed), set(range(12)) - set(covered)
    assert not any(all(p + k in free_t and q + k in free_i and text[p + k] == item[q + k] for k in range(3)) for p in range(23) for q in range(10))
