"""Exact deduplication, collocations and vector codes against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tests.compare import assert_same, connection
from pyspark.sql import functions as F

from chronoward.llm import collocations, exact_dedup, vector_codes
from tests.llm.conftest import prose


# exact deduplication


def grouped_by_hand(rows):
    groups = defaultdict(list)
    for at, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0, at))
    out = []
    for content, members in groups.items():
        best = min(members)
        out += [(None if m[1] else m[2], None if best[1] else best[2], len(members), m == best, hashlib.sha256(content.encode()).hexdigest()) for m in members]
    return sorted(out, key=str)


def found(docs, **how):
    rows = exact_dedup.grouped(docs, **how).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha"))).collect()
    return sorted(map(tuple, rows), key=str)


def test_copies(make, vocabulary):
    rng = random.Random(31)
    base = [prose(rng, rng.randint(1, 300), vocabulary) for _ in range(60)]
    texts = base + [rng.choice(base[:20]).replace(" ", rng.choice([" ", "\n", " \t "])) for _ in range(400)] + [base[0]] * 500 + [b + "é" for b in base[:5]]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = grouped_by_hand(rows)
    assert found(make(rows).repartition(7)) == want
    # one bucket that does not fit is dealt again until its parts do, whatever the number of copies
    assert found(make(rows).repartition(5), bucket_bytes=3_000, fan=1) == want


def test_small_folds_give_the_same(make, monkeypatch):
    rows = [(i, "same text") for i in range(40)] + [(100 + i, f"text {i % 7}") for i in range(60)]
    monkeypatch.setattr(exact_dedup, "FOLD_ROWS", 3)
    assert sum(len(b) for b in folded_here(rows)) == 100
    assert found(make(rows).coalesce(2)) == grouped_by_hand(rows)


def folded_here(rows):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})

    class Here:
        @staticmethod
        def get():
            return Here

        @staticmethod
        def partitionId():
            return 0

    real, exact_dedup.TaskContext = exact_dedup.TaskContext, Here
    try:
        return [b.to_pylist() for b in exact_dedup.fold(iter([batch]))]
    finally:
        exact_dedup.TaskContext = real


def test_copies_edges(spark, edge, edge_rows, empty):
    got = found(edge)
    assert got == grouped_by_hand([r[:2] for r in edge_rows])
    assert sum(r[3] for r in got) == len({r[4] for r in got})
    assert exact_dedup.grouped(empty).count() == 0
    kept = exact_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    # the blank text of most characters stays for null and empty; rows equal in id and text stay together
    assert 2 in ids and not {0, 1, 4} & set(ids) and ids.count(3) == 2 and None in ids
    clash = edge.select("doc_id", "text", F.lit(1).alias("row"), F.lit(2).alias("entry"), F.lit(3).alias("kept_id"), F.lit(4).alias("own_id"))
    assert exact_dedup.keep_one(clash).columns == clash.columns


def test_table_compares_contents():
    t = exact_dedup.Table()
    assert [t.number(7, b"a"), t.number(7, b"b"), t.number(7, b"a"), t.number(7 + 256, b"a")] == [0, 1, 0, 2]
    numbers = [t.number(i % 5, str(i).encode()) for i in range(1000)]
    assert numbers == [t.number(i % 5, str(i).encode()) for i in range(1000)] and len(set(numbers)) == 1000


# collocations


def phrases_by_hand(rows, least, first, share=100):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        several = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in several.items():
            inside = any(len(x) > len(g) and 100 * b >= share * a and any(x[i : i + len(g)] == g for i in range(len(x) - len(g) + 1)) for x, b in several.items())
            if not inside:
                score, k = min((1000 * a * n[lang] // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:first])]
    return sorted(out)


def many_phrases(seed=41, texts=120):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["Über", "日本", "naïve", "x\x1cy"]
    fixed = ["alpha beta gamma delta", "new york city", "a b", "beta gamma"]
    rows = []
    for _ in range(texts):
        parts = [rng.choice(fixed) if rng.random() < 0.4 else rng.choice(words) for _ in range(60)]
        rows.append((rng.choice(["en", "en", "en", "de", None]), "".join(p + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n"]) for p in parts)))
    return rows


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, 2, 3) for i, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, w1 string, n long, g long, total long")


@pytest.mark.parametrize("block", [6 << 20, 300])
def test_phrases(spark, monkeypatch, block):
    rows = many_phrases()
    if block < 1000:  # blocks cut inside texts, in tasks and here alike
        got = []
        monkeypatch.setattr(collocations, "BLOCK", block)
        import pyarrow as pa

        batch = pa.RecordBatch.from_pydict({"lang": [r[0] or "und" for r in rows], "text": [r[1] for r in rows]})
        pieces = defaultdict(list)
        for lang, data in collocations.blocks(iter([batch])):
            assert len(data) <= 3 * block
            pieces[lang] += [p for p in data.split(b"\n") if p.strip()]
        for lang, text in rows:
            got += [(lang or "und", p) for p in text.encode().translate(collocations.LOWER).split(b"\n") if p.strip()]
        assert Counter(got) == Counter((k, p) for k, v in pieces.items() for p in v)
        return
    for least, first in ((20, 2000), (5, 7)):
        got = sorted(map(tuple, collocations.phrases(as_docs(spark, rows).repartition(5), least=least, first=first).collect()))
        assert got == phrases_by_hand(rows, least, first)


def test_phrases_of_a_share(spark):
    rows = many_phrases(43, 60)
    got = sorted(map(tuple, collocations.phrases(as_docs(spark, rows), least=8, share=60).collect()))
    assert got == phrases_by_hand(rows, 8, 2000, 60)


def test_phrases_ranked_in_parts(spark, monkeypatch):
    rows = many_phrases(45, 60)
    monkeypatch.setattr(collocations, "RANKED", 10)
    monkeypatch.setattr(collocations, "GATHERED", 50)
    got = sorted(map(tuple, collocations.phrases(as_docs(spark, rows).coalesce(2), least=4, first=6).collect()))
    assert got == phrases_by_hand(rows, 4, 6)


def test_phrases_shared_numbers(spark, monkeypatch):
    """Words that share a number under one seed are told apart under the next."""
    real = collocations.words_of

    def weak(data, salt):
        h, *rest = real(data, salt)
        return (h % np.uint64(3) if salt == 0 else h, *rest)

    rows = many_phrases(44, 30)
    words = collocations.word_rows(as_docs(spark, rows).fillna("und", ["lang"]), 0)
    assert words.groupBy("lang", "w1").count().where("count > 1").count() == 0
    monkeypatch.setattr(collocations, "words_of", weak)
    import pyarrow as pa

    h = weak(b"one two three four five", 0)[0]
    assert len(set(h.tolist())) < 5 and len(set(weak(b"one two three four five", 1)[0].tolist())) == 5


def test_phrases_edges(spark, edge, edge_rows, empty):
    got = sorted(map(tuple, collocations.phrases(edge, least=2).collect()))
    assert got == phrases_by_hand([(r[2], r[1]) for r in edge_rows], 2, 2000)
    assert collocations.phrases(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, " \n\t ", "en"), (4, "...;", None)], "doc_id long, text string, lang string")
    assert collocations.phrases(blank, least=1).count() == 0
    same = spark.createDataFrame([(1, "a b", None), (1, "a b", None)], "doc_id long, text string, lang string")
    assert [tuple(r) for r in collocations.phrases(same, least=1).collect()] == [("und", 1, "a b", 2, 2, 2, 4, 2000)]


# vector codes


def codes_by_hand(rows, parts, entries, rounds):
    kept = [(i, lab, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [[q[p * width : (p + 1) * width] for p in range(parts)] for _, _, q in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))

    def assign():
        return [[min(range(len(books[p])), key=lambda e: (dist(c[p], books[p][e]), e)) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if own:
                    books[p][e] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    errors = [sum(dist(c[p], books[p][a[p]]) for p in range(parts)) for c, a in zip(cut, at)]
    of = Counter()
    for (_, lab, _), e in zip(kept, errors):
        of[lab] += e
    h = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{x:02x}" for x in a), e, of[lab], h) for (i, lab, _), a, e in zip(kept, at, errors))


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 1, "q") for i, v, lab in rows], "vec_id long, embedding array<float>, label int, error int, code string")


def near_grid(seed, n, dims):
    """Vectors on a coarse grid: many equal distances and equal vectors."""
    rng = random.Random(seed)
    return [(i * 3 % (3 * n), [rng.randint(-3, 3) / 64 for _ in range(dims)], rng.choice([0, 0, 0, 1, None])) for i in range(n)]


@pytest.mark.parametrize("parts, entries, rounds", [(4, 6, 2), (2, 8, 3), (1, 3, 0)])
def test_codes(spark, parts, entries, rounds):
    rows = near_grid(parts, 300, 8)
    got = sorted(map(tuple, vector_codes.coded(vectors(spark, rows).repartition(6), parts, entries, rounds).collect()))
    assert got == codes_by_hand(rows, parts, entries, rounds)


def test_bounds_leave_out_most(spark, sf_dir):
    """Bounds must save work after the first pass, not just be right."""
    data = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    state, _ = vector_codes.codes(data)
    n, computed = state.agg(F.count("*"), F.sum("computed")).first()
    assert computed < 0.7 * n * vector_codes.PARTS * vector_codes.ENTRIES


def test_later_pass_with_ties():
    rng = np.random.default_rng(5)
    for _ in range(30):
        points, book = rng.integers(-4, 5, (200, 2)), rng.integers(-4, 5, (9, 2))
        code, _, upper, lower = vector_codes.first_pass(points, book)
        new = book + rng.integers(-1, 2, book.shape)
        moved = np.sqrt(((new - book) ** 2).sum(axis=1)) * (1 + 1e-9)
        high, low = vector_codes.up(upper + moved[code]), vector_codes.down(lower - moved[None, :])
        got, own, upper, lower, _ = vector_codes.later_pass(points, new, vector_codes.between(new[None])[0], code, high, low)
        d2 = ((points[:, None] - new[None]) ** 2).sum(axis=2)
        assert (got == d2.argmin(axis=1)).all()
        done = own >= 0
        assert (own[done] == d2.min(axis=1)[done]).all()
        assert (upper.astype(float) ** 2 * (1 + 1e-6) >= d2[np.arange(200), got]).all() and (lower.astype(float) ** 2 <= d2 * (1 + 1e-6)).all()


def test_codes_edges(spark):
    rows = near_grid(9, 20, 4)
    bad = [(1000, None, 1), (1001, [], 1), (1002, [0.1, None, 0.2, 0.3], 1), (1003, [0.1, float("nan"), 0.2, 0.3], 1), (1004, [0.1, float("inf"), 0.2, 0.3], None)]
    want = codes_by_hand(rows, 2, 64, 2)
    assert sorted(map(tuple, vector_codes.coded(vectors(spark, rows + bad), 2).collect())) == want
    assert sorted(map(tuple, vector_codes.coded(vectors(spark, [*rows, (2000, [0.5] * 6, 1)]), 2).collect())) == want
    twice = rows + rows[:3]
    assert sorted(map(tuple, vector_codes.coded(vectors(spark, twice), 2, 5).collect())) == codes_by_hand(twice, 2, 5, 2)
    assert vector_codes.coded(vectors(spark, []), 2).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert vector_codes.coded(vectors(spark, bad), 2).count() == 0
    with pytest.raises(ValueError):
        vector_codes.coded(vectors(spark, rows), 3)
    far = vector_codes.coded(vectors(spark, [(1, [1e30, 0.0], 1), (2, [-1e30, 0.0], 1)]), 1, 1, 1).collect()
    assert len(far) == 2 and all(r["error"] > 0 for r in far)


def test_label_errors_salted(spark, monkeypatch):
    rows = near_grid(3, 60, 4)
    monkeypatch.setattr(vector_codes, "FEW_LABELS", 0)
    assert sorted(map(tuple, vector_codes.coded(vectors(spark, rows), 2, 4).collect())) == codes_by_hand(rows, 2, 4, 2)


@pytest.mark.parametrize("module", [exact_dedup, collocations, vector_codes])
def test_sql(spark, sf_dir, module):
    assert_same(module.query(spark, sf_dir), connection(sf_dir), module.ORACLE)


def test_phrases_rare_runs_of_frequent_pairs(spark, monkeypatch):
    """Runs of three words whose pairs are frequent and which are rare themselves are not exploded; those that are frequent are, with exact counts."""
    texts = [f"a{i} b c{j}" for i in range(30) for j in range(30)] + ["a0 b c0 d"] * 25
    docs = spark.createDataFrame([("x", t) for t in texts], "lang string, text string")
    made, plain = {}, collocations.run_rows

    def run_rows(docs, size, *others):
        made[size] = plain(docs, size, *others)
        return made[size]

    monkeypatch.setattr(collocations, "run_rows", run_rows)
    _, every, _ = collocations.frequent_runs(docs, 5, 20)
    assert sorted((len(r["g"]), r["n"]) for r in every.where(F.size("g") > 2).collect()) == [(3, 25), (3, 26), (4, 25)]
    assert made[3].count() < 20
