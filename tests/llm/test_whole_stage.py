"""The near-duplicate stage compares all texts of a bucket, not a few pairs of it."""

import numpy as np
import pytest

from casalith.llm import similar
from tests.llm.test_ops import DOCS, prose


def edited(text, seed, n=6):
    w, r = text.split(), np.random.default_rng(seed)
    for i, at in enumerate(r.choice(len(w) // 8, n, replace=False)):
        w[8 * int(at) + 4] = f"edit{seed}x{i}"
    return " ".join(w)


@pytest.mark.parametrize("cell", [similar.CELL_SHINGLES, 2000])
def test_copies_join_their_original(spark, monkeypatch, cell):
    """Each copy is alike to the original alone: 270 common of 330 shingles, but 240 of 360 with another copy."""
    monkeypatch.setattr(similar, "CELL_SHINGLES", cell)
    text = prose(4, 304)
    rows = [(0, text, "en", "a", 1)] + [(i, edited(text, i), "en", "a", 1) for i in range(1, 51)] + [(100 + i, prose(900 + i, 100), "en", "a", 1) for i in range(5)]
    kept = similar.one_of_each(spark.createDataFrame(rows, DOCS))
    assert sorted(r.doc_id for r in kept.collect()) == [0, *range(100, 105)]


def test_cell_links_against_all_pairs():
    r = np.random.default_rng(5)
    base = r.choice(10_000, 60, replace=False)
    sets = [np.unique(np.where(r.random(60) < 0.1, r.integers(10_000, 20_000, 60), base)) for _ in range(40)] + [np.empty(0, int)] * 2
    offsets = np.cumsum([0, *map(len, sets)])
    links = similar._cell_links(np.arange(42), offsets, np.concatenate(sets).astype(np.int32), 0.8)

    def parts(pairs):
        root = list(range(42))
        for _ in range(42):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    alike = [(i, j) for i in range(42) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    assert parts(links) == parts(alike) and len(set(parts(links))) > 2
