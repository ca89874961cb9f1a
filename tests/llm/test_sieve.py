"""Hashed bits that thin rows before a join, packs of bucket hashes, roots joined by later links, scratch tables of line deduplication."""

import random
from collections import defaultdict

import numpy as np
import pytest

from chronoward.llm import common, line_dedup, sieve
from chronoward.llm.crossing import near_pairs


@pytest.mark.parametrize("most", [1 << 27, 1 << 10])
def test_sieve_loses_no_row(spark, monkeypatch, most):
    """Every wanted row passes, also where the bits are far too few; with enough bits few others do."""
    monkeypatch.setattr(sieve, "MOST_BITS", most)
    wanted = spark.range(-3_000, 3_000, 3)
    rows = spark.range(-20_000, 20_000).selectExpr("id AS key", "CAST(id AS string) AS line")
    got = {r["key"] for r in sieve.sieved(rows, "key", wanted, 2_000).collect()}
    assert got >= set(range(-3_000, 3_000, 3)) and (most < 1 << 20 or len(got) < 3_500)
    assert sieve.sieved(rows, "key", wanted.where("id > 5000"), 0).count() == 0


def test_packs():
    for x in (np.array([7], dtype=np.int64), np.array([0, 2**32 - 1, 5], dtype=np.uint32), np.arange(-5, 70_000, dtype=np.int64)):
        assert (line_dedup.unpacked(line_dedup.packed(x), x.dtype) == x).all()


def test_bucket_pairs_connect_every_bucket(spark, monkeypatch):
    """The pairs of a bucket reach all of its lines, a bucket of nearly all lines among them, and name no other line."""
    monkeypatch.setattr(line_dedup, "FOLDED", 300)
    monkeypatch.setattr(line_dedup, "PACK", 100)
    rng, n = random.Random(5), 2_000
    bands = [[7 if rng.random() < 0.8 else rng.choice([0, 2**32 - 1, rng.randrange(900)]) for _ in range(line_dedup.BANDS)] for _ in range(n)]
    halves = lambda row: [int(np.uint64(a << 32 | b).view(np.int64)) for a, b in zip(row[::2], row[1::2])]
    names = ", ".join(f"{b} long" for b in line_dedup.BAND_NAMES)
    df = spark.createDataFrame([(10 * i, *halves(r)) for i, r in enumerate(bands)], f"place long, {names}").repartition(4)
    want, got = defaultdict(set), defaultdict(list)
    for i, row in enumerate(bands):
        for k, x in enumerate(row):
            want[k << 32 | x].add(10 * i)
    for r in line_dedup.bucket_pairs(df, n).collect():
        got[r["bucket"]].append((r["a"], r["b"]))
    assert set(got) == {b for b, ids in want.items() if len(ids) > 1}
    for bucket, pairs in got.items():
        assert len(pairs) == len(want[bucket]) - 1
        reached, left = {min(want[bucket])}, pairs
        while left:
            linked = [p for p in left if reached & set(p)]
            assert linked
            reached |= {x for p in linked for x in p}
            left = [p for p in left if p not in linked]
        assert reached == want[bucket]


def test_roots_joined_by_later_links(spark):
    roots = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (8, 8), (9, 8)], "id long, root long")
    links = spark.createDataFrame([(2, 4), (5, 6), (6, 7), (3, 1)], "a long, b long")
    got = defaultdict(set)
    for r in line_dedup.joined_roots(roots, links).collect():
        got[r["root"]].add(r["id"])
    assert sorted(map(sorted, got.values())) == [[1, 2, 3, 4], [5, 6, 7], [8, 9]] and all(k in v for k, v in got.items())


def test_near_pairs_of_one_side():
    rng = random.Random(9)
    sets = [np.unique(np.array([rng.randrange(60) for _ in range(rng.randint(1, 40))], dtype=np.uint64)) for _ in range(80)]
    want = {(i, j) for i, x in enumerate(sets) for j, y in enumerate(sets) if len(np.intersect1d(x, y)) >= 0.5 * len(np.union1d(x, y))}
    for right in (sets, list(sets)):
        assert set(zip(*map(np.ndarray.tolist, near_pairs(sets, right, 0.5)))) == want


def test_bands_and_texts_do_not_stay(make):
    """The tables with band hashes and with texts are deleted once nothing reads them: they are most of the disk."""
    before = set(common.MADE)
    df = make([(1, "the same line stands in both\none"), (2, "two\nthe same line stands in both"), (3, None), (4, "")])
    got = sorted((r["doc_id"], r["n_lines"], list(r["removed"])) for r in line_dedup.decided(df).collect())
    assert got == [(1, 2, []), (2, 2, [1]), (3, 0, []), (4, 1, [])]
    made = [x.rsplit("/", 1)[1] for x in common.MADE if x not in before]
    assert made and not any(x.startswith(("lines-distinct-", "lines-texts-")) or x[: len("lines-")] == "lines-" and x.count("-") == 1 for x in made)
