"""Kneser-Ney models against a row-by-row computation, whole and pruned; letters and marks."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoward.llm import common, language


def kneser_ney(texts):
    """Probability of a symbol after up to three, from all counts of the given sequences of codes."""
    grams = Counter()
    for t in texts:
        codes = (0, 0, 0, *t, 0)
        grams.update(codes[i : i + 4] for i in range(len(codes) - 3))
    levels = {4: grams}
    for size in (3, 2, 1):
        levels[size] = Counter(g[1:] for g in levels[size + 1])
    facts = {}
    for size, level in levels.items():
        once, twice = (sum(n == k for n in level.values()) for k in (1, 2))
        totals, kinds = defaultdict(int), defaultdict(int)
        for g, n in level.items():
            totals[g[:-1]] += n
            kinds[g[:-1]] += 1
        facts[size] = level, once / (once + 2 * twice) if once else 0.5, totals, kinds

    def p(gram):
        if not gram:
            return 1 / 2**16
        level, d, totals, kinds = facts[len(gram)]
        total = totals.get(gram[:-1], 0)
        if not total:
            return p(gram[1:])
        return max(level.get(gram, 0) - d, 0) / total + d * kinds[gram[:-1]] / total * p(gram[1:])

    return p


def scorer_of(spark, texts_by_lang, limit):
    df = spark.createDataFrame([(lang, t) for lang, ts in texts_by_lang.items() for t in ts], "lang string, text string")
    return language.Scorer(language.counted(df), limit)


def sums_of(spark, scorer, texts):
    """Sum of log probabilities of each text, its number of characters first."""
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return {r["i"]: (r["n"], r["sums"]) for r in scorer.sums(df).collect()}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(51)
    return {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(40)] for lang, letters in (("x", "abcd"), ("y", "cdefg"))}


@pytest.mark.parametrize("limit", [250_000, 60, 0])
def test_probabilities_against_all_counts(spark, corpus, limit):
    """With all sequences broadcast, some and none: the same model, with nothing left out."""
    scorer = scorer_of(spark, corpus, limit)
    assert scorer.whole == (limit == 250_000) and scorer.langs == ["x", "y"]
    model = scorer.sent.value
    assert scorer.whole or len(model.keys[4]) <= 2 * limit
    rng = random.Random(52)
    texts = ["".join(rng.choice("abcdefgz") for _ in range(rng.randint(1, 300))) for _ in range(60)] + [*corpus["x"][:5], "12", None, "z"]
    got = sums_of(spark, scorer, texts)
    assert len(got) == len(texts)
    for column, lang in enumerate(scorer.langs):
        p = kneser_ney([tuple(map(ord, t)) for t in corpus[lang]])
        for i, t in enumerate(texts):
            if t in ("12", None):
                assert got[i][0] == 0 and not any(got[i][1])
                continue
            codes = (0, 0, 0, *map(ord, t), 0)
            want = sum(math.log(p(codes[j : j + 4])) for j in range(len(t) + 1))
            assert got[i][0] == len(t) + 1 and math.isclose(got[i][1][column], want, rel_tol=1e-4)


def test_more_sequences_than_are_broadcast(spark):
    """A language of over 250,000 four-character sequences, by the bound that is in use, against all counts."""
    rng = random.Random(54)
    letters = [chr(0x4E00 + i) for i in range(3_000)]
    corpus = {"many": ["".join(rng.choice(letters) for _ in range(2_000)) for _ in range(140)], "few": ["abc abd"] * 5}
    scorer = scorer_of(spark, corpus, language.MAX_SEQUENCES)
    assert not scorer.whole
    texts = [corpus["many"][0][:500], "".join(rng.choice(letters) for _ in range(500)), "abc abz"]
    got = sums_of(spark, scorer, texts)
    for column, lang in enumerate(scorer.langs):
        p = kneser_ney([tuple(0 if c == " " else ord(c) for c in t) for t in corpus[lang]])
        for i, t in enumerate(texts):
            codes = (0, 0, 0, *(0 if c == " " else ord(c) for c in t), 0)
            assert math.isclose(got[i][1][column], sum(math.log(p(codes[j : j + 4])) for j in range(len(t) + 1)), rel_tol=1e-4)


def test_bound_changes_no_prediction(make):
    rng = random.Random(55)
    rows = [(i, " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(2, 7))) for _ in range(12))) for i in range(150)]
    rows += [(3, rows[3][1]), (None, "abc def"), (151, None), (152, "12 34"), (153, "xyz")]
    taken = lambda df: sorted((str(r["doc_id"]), r["held_out"], r["lang_pred"], round(r["score"], 5), r["rejected"]) for r in df.collect())
    assert taken(language.identify(make(rows))) == taken(language.identify(make(rows), limit=50))


def test_probabilities_sum_to_one(spark, corpus):
    model = scorer_of(spark, corpus, 250_000).sent.value
    symbols = np.array([0, *map(ord, "abcdefg")], dtype=np.uint64)
    rng = random.Random(53)
    for _ in range(60):
        context = sum(ord(rng.choice("abcdefg")) << 16 * i for i in (1, 2, 3))
        total = np.exp(model.look(4, symbols | np.uint64(context))).sum(axis=0)
        # what is missing belongs to symbols that no text has
        assert (total > 0.85).all() and (total < 1.001).all()


def test_letters_and_marks(make):
    rows = [(i, "some words of a text") for i in range(40)] + [(40, "́̂ ̃"), (41, "\U00020000\U00020001"), (42, "á"), (43, "12 \U0001f600")]
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(make(rows)).collect()}
    assert got[40] == got[43] == ("und", 0.0) and got[41][0] == got[42][0] == "en"


def test_all_learning_rows_count_and_calibrate(spark):
    """No learning row is kept from the models or from the calibration: halves are judged by each other's models."""
    rng = random.Random(56)
    rows = [(i, lang, "".join(rng.choice(letters) for _ in range(rng.randint(1, 40)))) for i in range(300) for lang, letters in (("x", "abcd"), ("y", "cdefg"))]
    df = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    scorer, choice = language.learn(df, F.lit(True))
    by_lang = lambda rows: {lang: [r[2] for r in rows if r[1] == lang] for lang in ("x", "y")}
    texts = [r[2] for r in rows]
    got, want = sums_of(spark, scorer, texts), sums_of(spark, scorer_of(spark, by_lang(rows), 250_000), texts)
    assert all(np.allclose(got[i][1], want[i][1], rtol=1e-6) for i in got)
    halves = [df.where(F.pmod(F.xxhash64("text"), F.lit(2)) == k).collect() for k in range(2)]
    entropies, sizes, truth = [], [], []
    for of, other in (halves, halves[::-1]):
        sums = sums_of(spark, scorer_of(spark, by_lang(other), 250_000), [r[2] for r in of])
        for i, r in enumerate(of):
            n, s = sums[i]
            entropies.append(-np.array(s) / n), sizes.append(n), truth.append("xy".index(r[1]))
    entropies, sizes, truth = map(np.array, (entropies, sizes, truth))
    assert len(truth) == len(rows)
    for k in range(2):
        own = entropies[truth == k, k]
        assert math.isclose(choice.limits[k], np.quantile(own, 1 - language.REJECT) + own.std(), rel_tol=1e-5)
    loss = lambda t: -np.log(0.99 * language.posteriors(entropies, sizes, t)[np.arange(len(truth)), truth] + 0.005).mean() + 1e-4 * np.log2(t) ** 2
    assert choice.temperature == min(language.TEMPERATURES, key=loss)


def test_one_build_for_three_models(spark):
    """The models of both halves and of all rows are made as languages of one: nine tables, not some for each model."""
    df = spark.createDataFrame([(i, lang, f"{word} {i}{word}") for i in range(20) for lang, word in (("x", "abc"), ("y", "def"))], "doc_id long, lang string, text string")
    had = len(common.MADE)
    scorer, choice = language.learn(df, F.lit(True))
    assert scorer.langs == choice.langs == ["x", "y"] and len(common.MADE) - had <= 9
