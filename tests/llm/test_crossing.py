"""Families of texts below the threshold that hold pairs above it, against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest

from chronoward.llm import crossing, line_dedup, near_dup


def template_family(rng, parts, n, changed, again, join):
    """n variants of one template, each with `changed` parts of its own, and near copies of every third with `again` more."""
    stem = [f"{rng.randrange(16**6):06x}" for _ in range(parts)]

    def variant(of, k):
        out = list(of)
        for at in rng.sample(range(parts), k):
            out[at] = f"{rng.randrange(16**6):06x}"
        return out

    family = [variant(stem, changed) for _ in range(n)]
    near = [variant(x, again) for x in family[::3]]
    texts = [join.join(x) for x in family + near]
    rng.shuffle(texts)
    return texts


def near_links(sets, similarity=0.8):
    sizes = {i: len(s) for i, s in sets.items()}
    return [(a, b) for a, b in combinations(sets, 2) if (c := len(sets[a] & sets[b])) >= similarity * (sizes[a] + sizes[b] - c)]


@pytest.mark.parametrize("block", [32, 512])
def test_documents_of_a_family(make, block, monkeypatch):
    monkeypatch.setattr(crossing, "BLOCK", block)
    texts = template_family(random.Random(31), 200, 360, 3, 4, " ")
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in enumerate(t.split() for t in texts)}
    links = near_links(sets)
    assert len(links) >= 100
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(make(list(enumerate(texts)))).collect()}
    lost = [p for p in links if got[p[0]] != got[p[1]]]
    assert len(lost) <= 0.01 * len(links)


def test_lines_of_a_family(make, monkeypatch):
    monkeypatch.setattr(crossing, "BLOCK", 32)
    texts = template_family(random.Random(32), 30, 360, 2, 1, " ")
    n = line_dedup.SIZE
    sets = {i: {t[k : k + n] for k in range(len(t) - n + 1)} for i, t in enumerate(texts)}
    links = near_links(sets)
    assert len(links) >= 50
    bands = line_dedup.band_hashes(texts)
    # what banding does not bring together at all is another matter
    bands = np.concatenate([bands >> 32, bands & 0xFFFFFFFF], axis=1)
    links = [(a, b) for a, b in links if (bands[a] == bands[b]).any()]
    removed = {r["doc_id"] for r in line_dedup.decided(make(list(enumerate(texts)))).collect() if r["n_removed"]}
    above = {}
    for a, b in links:
        above.setdefault(b, a)
    assert set(above) <= removed


def test_one_inner_character_in_fifty(make):
    """48 shingles of five, five of them changed: a Jaccard similarity of 43 / 53."""
    rng = random.Random(33)
    lines = [f"{rng.randrange(16**52):052x}" for _ in range(400)]
    texts = lines + [x[:25] + "#" + x[26:] for x in lines]
    removed = {r["doc_id"] for r in line_dedup.decided(make(list(enumerate(texts)))).collect() if r["n_removed"]}
    assert len(removed & set(range(400, 800))) >= 0.97 * 400 and not removed & set(range(400))


def test_near_pairs_of_sets():
    rng = np.random.default_rng(3)
    left, right = ([np.unique(rng.integers(0, 60, rng.integers(1, 50))) for _ in range(40)] for _ in range(2))
    crossed = set(zip(*(x.tolist() for x in crossing.near_pairs(left, right, 0.5))))
    assert crossed == {(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if len(set(x) & set(y)) >= 0.5 * len(set(x) | set(y))}


def test_rows_without_an_id_stay(edge):
    kept = [(r["doc_id"], r["text"]) for r in near_dup.keep_one(edge).collect()]
    assert kept.count((None, "no id")) == 1 and kept.count((3, "word")) == 2 and (4, "word") not in kept


def test_stars_have_the_same_components():
    for seed in range(100):
        rng = random.Random(seed)
        edges = [(a, b) for a, b in (rng.sample(range(-30, 30), 2) for _ in range(rng.randint(0, 50)))]
        parent = {x: x for e in edges for x in e}

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
        a, b = crossing.stars(*(np.array([e[k] for e in edges], dtype=np.int64) for k in (0, 1)))
        assert set(zip(a.tolist(), b.tolist())) == {(root(x), x) for x in parent if root(x) != x}
