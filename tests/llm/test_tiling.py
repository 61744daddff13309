"""Greedy string tiling against a plain longest-first search, and texts of few different words."""
import random
import time

import numpy as np
import pytest

from timefuse.llm.tiling import tiles


def plain(doc, item, least):
    """Always the longest common run of unmarked words, the first in the document, then in the item."""
    free_d, free_i, out = [x >= 0 for x in doc], [x >= 0 for x in item], []
    while True:
        best = (least - 1,)
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and free_d[d + n] and free_i[p + n] and doc[d + n] == item[p + n]:
                    n += 1
                if n > best[0]:
                    best = (n, d, p)
        if len(best) == 1:
            return out
        n, d, p = best
        free_d[d:d + n], free_i[p:p + n] = [False] * n, [False] * n
        out.append((d, p, n))


@pytest.mark.parametrize("words", [2, 3, 6, 30])
def test_tiles_are_those_of_the_plain_search(words):
    for seed in range(80):
        rng = random.Random(100 * words + seed)
        item = [rng.randrange(words) for _ in range(rng.randrange(50))]
        doc = [-1 if rng.random() < .02 else rng.randrange(words) for _ in range(rng.randrange(60))]
        if seed % 3 == 0 and len(item) > 4:  # the item with its parts swapped
            cut = rng.randrange(len(item))
            doc = [*doc[:9], *item[cut:], -1, *item[:cut]]
        least = rng.choice([1, 2, 3, 5])
        assert tiles(np.array(doc, dtype=np.int64), np.array(item, dtype=np.int64), least) == plain(doc, item, least)


def test_one_word_repeated_ends_soon():
    t = time.time()
    assert tiles(np.zeros(32_000, dtype=np.int64), np.zeros(1600, dtype=np.int64)) == [(0, 0, 1600)]
    assert time.time() - t < 10
