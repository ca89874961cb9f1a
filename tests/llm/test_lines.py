"""Line deduplication: any id, any number of lines, repeated shingles, rows that share an id, recall of fuzzy lines alone."""

import random

import numpy as np

from chronoward.llm import line_dedup


def removed(df):
    return sorted((r["doc_id"], list(r["removed"])) for r in line_dedup.decided(df).collect() if r["n_removed"])


def test_large_ids_and_many_lines(make):
    line = "a line that stands in all of these documents"
    rows = [(-(2**63), line), (2**41 + 7, f"new\n{line}"), (2**63 - 1, "\n" * 4_200_000 + line)]
    df = make(rows)
    assert removed(df) == [(2**41 + 7, [1]), (2**63 - 1, [4_200_000])]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(df).collect()}
    assert kept[-(2**63)] == line and kept[2**41 + 7] == "new" and kept[2**63 - 1] == "\n" * 4_199_999


def test_lines_of_one_shingle_repeated(make):
    assert removed(make([(1, "=" * 30), (2, "=" * 200), (3, "====="), (4, "-" * 60)])) == [(2, [0]), (3, [0])]


def test_rows_that_share_an_id(make):
    one, other = "the first line of the one text", "something else without a copy here"
    rows = [(5, f"{other}\n{one}"), (5, f"{one}\n{one}"), (5, f"{one}\n{one}"), (4, "early and unrelated words")]
    kept = sorted(r["text"] for r in line_dedup.deduplicated(make(rows)).collect())
    # the equal rows decide as one, and one of the two texts comes first by its hash
    assert kept.count("early and unrelated words") == 1 and kept in (
        sorted(["early and unrelated words", other, one, one]), sorted(["early and unrelated words", f"{other}\n{one}", "", ""]))


def test_recall_of_fuzzy_lines(make):
    """Pairs of distinct lines with a similarity of 0.8 to 0.9, each pair with nothing like it elsewhere."""
    rng = random.Random(41)
    n, pairs = line_dedup.SIZE, []
    while len(pairs) < 600:
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(rng.randint(40, 160))).strip()
        b = list(a)
        for _ in range(rng.randint(1, 3)):
            b[rng.randrange(len(b))] = "#"
        b = "".join(b)
        x, y = ({t[k : k + n] for k in range(len(t) - n + 1)} for t in (a, b))
        if a.strip() and 0.8 <= len(x & y) / len(x | y) < 0.9:
            pairs.append((a, b))
    rows = [(2 * i + k, t) for i, p in enumerate(pairs) for k, t in enumerate(p)]
    found = {d for d, _ in removed(make(rows))}
    assert not any(d % 2 == 0 for d in found) and len(found) >= 0.97 * len(pairs)


def test_outlines_leave_out_no_pair():
    """The bound of two outlines is never below the similarity, and tells strangers apart."""
    rng = random.Random(43)
    lines, strangers = [], 0
    for _ in range(600):
        n = rng.choice([3, 20, 60, 300, 2000])
        a = "".join(rng.choice(rng.choice(["ab", "abcdefghijklmnopqrstuvwxyz é"])) for _ in range(n))
        b = list(a)
        for _ in range(rng.randint(0, max(1, n // 12))):
            b[rng.randrange(n)] = rng.choice("xyz#")
        lines.append((a, "".join(b)))
    lines += [("=" * 20_000, "=" * 300), ("ab" * 9_000, "ab" * 40)]
    marks, sizes = line_dedup.outlines([x for p in lines for x in p])
    for i, (a, b) in enumerate(lines):
        x, y = line_dedup.shingles(a), line_dedup.shingles(b)
        most = int(np.minimum(marks[2 * i], marks[2 * i + 1]).sum())
        assert most >= len(x & y) and sizes[2 * i] <= len(x) and sizes[2 * i + 1] <= len(y)
    short = [i for i, p in enumerate(lines) if 40 < len(p[0]) < 100]
    for i, j in zip(short, short[1:]):
        most = int(np.minimum(marks[2 * i], marks[2 * j]).sum())
        strangers += most >= 0.8 * (int(sizes[2 * i] + sizes[2 * j]) - most)
    assert strangers <= 0.1 * len(short)


def test_names_that_clash(spark):
    """Columns named like those that the operator uses come back as they were."""
    names = ["gone", "tag", "row", "id__", "tag__", "gone__", "n_chars"]
    df = spark.createDataFrame([(i, "the same line in both\n" + "x" * i, *[str(k) for k in range(6)], 0) for i in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names[:-1]) + ", n_chars int")
    out = line_dedup.deduplicated(df)
    assert out.columns == df.columns
    assert [(r["doc_id"], r["text"], r["gone"], r["gone__"], r["n_chars"]) for r in out.orderBy("doc_id").collect()] == [(1, "the same line in both\nx", "0", "5", 23), (2, "xx", "0", "5", 2)]
