"""Duplicates, search, decontamination and the pipeline against brute force."""

import hashlib
import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from tests.compare import assert_same, connection
from pyspark.sql import functions as F

from chronoward.llm import components, decontaminate, line_dedup, near_dup, substrings, topk
from tests.llm.conftest import prose


def union(pairs, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def word_shingles(text):
    w = (text or "").split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def edited(rng, text, vocabulary, share):
    return " ".join(rng.choice(vocabulary) if rng.random() < share else w for w in text.split(" "))


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = union(pairs, {x for p in pairs for x in p})
    on_edges = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {i: want[i] for i in on_edges}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(make, vocabulary):
    rng = random.Random(6)
    base = [prose(rng, rng.randint(30, 300), vocabulary) for _ in range(40)]
    texts = base + [base[rng.randrange(40)] for _ in range(20)] + [edited(rng, base[rng.randrange(40)], vocabulary, 0.01) for _ in range(60)] + [edited(rng, base[0], vocabulary, 0.005) for _ in range(40)]
    rows = list(enumerate(texts))
    sets = {i: word_shingles(t) for i, t in rows}
    sure = [p for p in combinations(sets, 2) if jaccard(sets[p[0]], sets[p[1]]) >= 0.8]
    want = union(sure, sets)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(make(rows)).collect()}
    split = [p for p in sure if got[p[0]] != got[p[1]]]
    assert len(split) <= 0.01 * len(sure)
    assert all(want[a] == want[b] for a, b in combinations(got, 2) if got[a] == got[b])
    assert near_dup.keep_one(make(rows)).count() == len(set(got.values()))


def test_near_duplicate_edges(edge, empty):
    rows = [(r["doc_id"], r["class_id"]) for r in near_dup.classes(edge).collect()]
    assert len(rows) == edge.count() and (4, 3) in rows and rows.count((3, 3)) == 2
    assert all(c == d for d, c in rows if d in (0, 1, 2, 60)) and (None, None) in rows
    assert near_dup.classes(empty).count() == 0
    kept = near_dup.keep_one(edge)
    assert kept.columns == edge.columns and 4 not in {r["doc_id"] for r in kept.collect()}


def test_probminhash_estimates_probability_jaccard():
    rng = np.random.default_rng(2)
    a, b = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64)), np.unique(rng.integers(0, 2**63, 100).astype(np.uint64))
    both = np.concatenate([a, b])
    x, y = near_dup.signature(both, np.ones(len(both)), 2048), near_dup.signature(a, np.ones(len(a)), 2048)
    assert abs((x == y).mean() - 0.75) < 0.05
    heavy = np.where(np.arange(len(both)) < 300, 1.0, 6.0)
    z = near_dup.signature(both, heavy, 2048)
    # sum over shingles of 1 / sum over others of the greater of the two weight ratios
    assert abs((x == z).mean() - (300 / (300 + 6 * 100) + 100 / (300 + 100))) < 0.06


def test_lines(make, vocabulary):
    rng = random.Random(7)
    lines = [prose(rng, rng.randint(3, 25), vocabulary) for _ in range(120)]
    lines += [x + "s" for x in lines[:40]] + [x[:-1] for x in lines[40:60]] + ["ab", "abc", "x"]
    rows = [(i, "\n".join(rng.choice(lines + ["", "  "]) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    first, order = {}, []
    for i, t in rows:
        for k, x in enumerate(t.split("\n")):
            if x.strip() and x not in first:
                first[x] = (i, k)
                order.append(x)
    n = line_dedup.SIZE
    grams = {x: {x[j : j + n] for j in range(max(1, len(x) - n + 1))} for x in order}
    near = union([(a, b) for a, b in combinations(range(len(order)), 2) if jaccard(grams[order[a]], grams[order[b]]) >= 0.8], range(len(order)))
    keep = {first[order[r]] for r in set(near.values())}
    want = {(i, k) for i, t in rows for k, x in enumerate(t.split("\n")) if x.strip() and (i, k) not in keep}
    got = {(r["doc_id"], k) for r in line_dedup.decided(make(rows)).collect() for k in r["removed"]}
    assert got <= want and len(got) >= 0.97 * len(want)
    kept = {r["doc_id"]: (r["text"], r["n_chars"]) for r in line_dedup.deduplicated(make(rows)).collect()}
    for i, t in rows:
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in got)
        assert kept[i] == (text, len(text))


def test_line_edges(edge, empty):
    out = line_dedup.deduplicated(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    text = defaultdict(list)
    for r in out.collect():
        text[r["doc_id"]].append(r["text"])
    assert text[0] == [None] and text[1] == [""] and text[4] == [""] and text[3] == ["word", "word"] and text[None] == ["no id"] and text[2] == ["  \n\n \t"]
    assert line_dedup.deduplicated(empty).count() == 0 and line_dedup.decided(empty).count() == 0


def brute_substrings(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w, gone = re.findall(r"[^\x20\x09-\x0D]+", t or ""), set()
        for k in range(len(w) - 19):
            window = tuple(w[k : k + 20])
            gone.update(range(k, k + 20)) if window in seen else seen.add(window)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("passages", [512, 3])
def test_substrings(make, passages, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_PASSAGES", passages)
    rng = random.Random(8)
    base = [str(rng.randint(0, 99)) for _ in range(500)]
    rows = []
    for i in range(150):
        t = []
        for _ in range(rng.randint(0, 4)):
            a = rng.randint(0, 460)
            t += base[a : a + rng.randint(5, 90)] + [rng.choice("abc")] * rng.randint(0, 30)
        rows.append((i, "\t ".join(t)))
    rows += [(900, None), (901, ""), (902, "q " * 2000), (903, "a\x1cb c " * 30)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substrings.deduplicated(make(rows)).collect()}
    assert got == brute_substrings(rows)


def test_substrings_of_rows_that_share_an_id(make, vocabulary):
    """Such rows are documents of their own, one before the other; equal rows are one document."""
    long, other = prose(random.Random(81), 60, vocabulary), prose(random.Random(82), 40, vocabulary)
    out = lambda rows: sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substrings.deduplicated(make(rows)).collect())
    assert out([(0, long), (1, long), (1, "short")]) == [(0, 60, 0), (1, 1, 0), (1, 60, 60)]
    assert out([(1, long), (1, long), (2, "x")]) == [(1, 60, 0), (1, 60, 0), (2, 1, 0)]
    assert out([(1, f"{other} {long}"), (1, f"{long} y")]) in ([(1, 61, 0), (1, 100, 60)], [(1, 61, 60), (1, 100, 0)])
    assert out([(-5, long), (2**62, f"{long} z")]) == [(-5, 60, 0), (2**62, 61, 60)]


def test_substrings_of_the_tables(spark, sf_dir):
    df = substrings.query(spark, sf_dir).drop("removed")
    assert_same(df, connection(sf_dir), substrings.ORACLE)


def test_substring_edges(edge, empty):
    assert substrings.deduplicated(edge).count() == edge.where("doc_id IS NOT NULL").count() and substrings.deduplicated(empty).count() == 0


def test_automaton_matches():
    rng = random.Random(9)
    for _ in range(30):
        docs = [[rng.randint(0, 2) for _ in range(rng.randint(4, 25))] for _ in range(4)]
        automaton = substrings.Automaton()
        for rank, words in enumerate(docs):
            automaton.add(words, rank)
        for words in docs:
            for end, (rank, at) in automaton.matches(words, 4):
                window = words[end - 3 : end + 1]
                places = [(r, k + 3) for r, d in enumerate(docs) for k in range(len(d) - 3) if d[k : k + 4] == window]
                assert min(places) == (rank, at)


def brute_topk(rows, k):
    import math

    held = lambda s: max(min(s, topk.MOST), -topk.MOST)
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = set()
    for i, v in clean:
        if i % 50 == 0:
            best = sorted(((-held(sum(a * b for a, b in zip(v, w))), j) for j, w in clean if j != i and len(w) == len(v)))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


@pytest.mark.parametrize("shard_rows", [40_000, 60])
def test_topk(spark, shard_rows, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(topk, "LEAF", 8)
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(400)] + [(i, [0.5] * 6) for i in range(400, 700)]
    rows += [(700, None), (701, [None] * 6), (702, [float("nan")] * 6), (703, [float("inf")] * 6), (704, []), (750, [1e7] * 6), (751, [-1e7] * 6), (800, [1.0, 2.0]), (801, [3.0, 4.0]), (850, [1e10, 3e10] * 3), (851, [-2e10] * 6), (852, [9e300] * 6), (853, [1e10, 3e10] * 3), (854, [1e308] * 6)]
    df = spark.createDataFrame([(i, v, 1, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, score int")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5).collect()}
    assert got == brute_topk(rows, 5)
    assert topk.top_k(df.where("1 = 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_topk_of_the_tables(spark, sf_dir):
    assert_same(topk.query(spark, sf_dir), connection(sf_dir), topk.ORACLE)


def test_decontamination(spark, make, vocabulary):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.randint(14, 60), vocabulary)) for i in range(40)] + [(90, None), (91, ""), (92, "two words"), (None, "x")]
    docs, want = [], set()
    for i in range(200):
        t = prose(rng, rng.randint(0, 400), vocabulary).split(" ")
        if i % 4 == 0:
            k = rng.randrange(40)
            item = items[k][1].split(" ")
            item = [w for w in item if rng.random() > 0.05] if i % 8 == 0 else item
            at = rng.randint(0, len(t))
            t[at:at] = item
            want.add((i, k))
        docs.append((i, " ".join(t)))
    bench = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, share double")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(make(docs), bench).collect()}
    assert len(want - got) <= 2 and not {d for d, _ in got} - {d for d, _ in want}
    clean = decontaminate.clean(make(docs), bench)
    assert clean.count() == 200 - len({d for d, _ in got}) and clean.columns == make([]).columns


def test_decontamination_edges(spark, edge, empty):
    bench = spark.createDataFrame([(1, "some benchmark text of a few words in all")], "item_id long, text string")
    assert decontaminate.contaminated(edge, bench).count() == 0 and decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.clean(edge, bench.where("1 = 0")).count() == edge.count()


def test_common_subsequence():
    rng = random.Random(12)
    for _ in range(60):
        a, b = ([rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert decontaminate.common_subsequence(a, b) == table[-1][-1]


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        counts.append(docs.count())
        if name != "bpe":
            assert docs.columns == before.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0]
    assert corpus_pipeline.run(spark, sf_dir).select("doc_id", "ids_sha256").exceptAll(docs.select("doc_id", "ids_sha256")).count() == 0


def test_pipeline_edges(spark, edge, empty, sf_dir):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        for docs in (edge, empty):
            out = stage(spark, docs, sf_dir)
            assert out.count() <= docs.count()
            assert name == "bpe" or out.columns == docs.columns
