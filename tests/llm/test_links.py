"""op5 keeps every link: numbers of links against all pairs."""

import tracemalloc

import numpy as np
import pytest
from test_corpus import near_texts, plain_sets

from formline.llm import op5_jaccard as op5


def plain_links(rows):
    sets = plain_sets(rows)
    near = lambda s, t: bool(s & t) and 100 * len(s & t) >= 80 * len(s | t)
    return sorted((d, sum(near(s, t) for j, (_, t) in enumerate(sets) if i != j)) for i, (d, s) in enumerate(sets))


@pytest.mark.parametrize(("block", "dense"), [(1 << 22, 2), (300, 1)])
def test_numbers_of_links(spark, monkeypatch, block, dense):
    monkeypatch.setattr(op5, "BLOCK", block)
    monkeypatch.setattr(op5, "BITMAP_BLOCK", block)
    monkeypatch.setattr(op5, "BROADCAST_ROWS", block)
    monkeypatch.setattr(op5, "DENSE", dense)
    base = [f"f{i}" for i in range(100)]
    family = [(2000 + i, " ".join([*base[:i], "y", *base[i + 1 :]])) for i in range(40)]
    rows = near_texts(60, 3) + family + [(3000, family[0][1]), (3001, family[0][1]), (2000, family[9][1]), (1003, ""), (1004, None)]
    got = op5.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_links"]) for r in got) == plain_links(rows)
    assert max(r["n_links"] for r in got) >= 40


def unlike(n, size, seed):
    rng = np.random.default_rng(seed)
    return [np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(n)]


@pytest.mark.parametrize("size", [50, 500, 2000, 20_000])
def test_nodes_of_unlike_sets_are_pruned(size):
    """Bitmaps grow with what lies below: above the leaves as well, most pairs of nodes without links are ruled out, whatever the sets' size."""
    families = [s for base in unlike(16, size, 1) for s in [np.unique(np.append(base[k:], base[:1])) for k in range(8)]]
    for sets in (families, unlike(128, size, 2)):
        met = {}
        list(op5._traverse(sorted(sets, key=lambda s: s[:4].tolist()), None, met))
        assert met[1][1] >= 0.75 * met[1][0] - 16  # a node and itself are never ruled out
        assert met[0][0] == 0 or met[1][1] > 0


@pytest.mark.parametrize("seed", range(20))
def test_bitmaps_keep_links_together(seed):
    rng = np.random.default_rng(seed)
    base = unlike(6, int(rng.integers(10, 300)), seed)
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) < 0.93], unlike(1, 3, int(rng.integers(0, 99)))[0]])) for b in base for _ in range(9)]
    sizes, bits = np.array([len(s) for s in sets]), [op5.bitmap(s, op5._bits(len(s))).tobytes() for s in sets]
    for side in (None, rng.integers(0, 2, len(sets))):
        label = op5.together(bits, sizes, side)
        for i, j in op5.linked(sets):
            assert label[i] == label[j] or side is not None and side[i] == side[j]
    assert len(set(op5.together(bits, sizes).tolist())) >= 6


def test_memory_of_long_texts():
    """A node's sets are compared over slices of their common tokens, so the length of texts does not multiply memory."""
    base = unlike(1, 100_000, 5)[0]
    sets = [np.delete(base, np.arange(k, len(base), 50)) for k in range(40)]
    tracemalloc.start()
    found = op5.linked(sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 40 * 39 // 2
    assert peak < 400e6
