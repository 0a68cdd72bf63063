import math
import re
from collections import Counter

from folioscope.llm.divergence import MIN_WORDS, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = WORD.findall(t)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = [0] * len(w)
    for i in range(len(w) - 4):
        if seen[tuple(w[i : i + 5])] > 1:
            hit[i : i + 5] = [1] * 5
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), sum(hit)


GOOD = ["The cat of the house went to a garden and it was in the sun, as is right for the dog that ran. " * 1 + " ".join(f"word{i}x the of and" for i in range(k, k + 20)) for k in range(30)]
ODD = ["", None, " \t\n\x0b\x0c\r ", "one", "a b c d e a b c d e", "a a a a a a a", "x\ny\nx\n\n \nx", "naïve 🙂 ünïcödé #tags | $5 <b>", "w " * 5000, "long" * 20000, "a\x1cb c\x85d e", "1 2 3 4 5 1 2 3 4 5 6 7 8 9", "a b c d e f a b c d e f a b c d e f"]


def test_base_counts_against_brute_force(spark):
    texts = GOOD + ODD + [GOOD[0]]
    rows = [(i, t, None if i % 7 == 3 else "en", "clash", i) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string, n long").repartition(3)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r = got[i]
        want = brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, repr(t)[:80]
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_odd_distributions_go_and_ordinary_ones_stay(spark):
    junk = " ".join(f"#$%{i}|<>&* {i}%%" for i in range(60))
    short = "#$% 1 2 3 |4 %5 6 <7 8 9 0 1"
    rows = [(i, t, "en") for i, t in enumerate([*GOOD, junk, short])] + [(900, junk, "xx"), (901, junk, None)]
    got = {r.doc_id: r for r in quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept for i in range(len(GOOD)))
    assert not got[len(GOOD)].kept and not got[len(GOOD)].base_failed
    assert got[len(GOOD) + 1].kept and got[len(GOOD) + 1].n_words < MIN_WORDS
    assert got[900].kept and got[901].kept and got[900].char_distance is None


def test_distance_is_jensen_shannon(spark):
    from pyspark.sql import functions as F

    from folioscope.llm.divergence import js_distance

    p, q = [0.5, 0.5, 0.0], [0.1, 0.0, 0.9]
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log2(a / b) for a, b in zip(x, m) if a)
    got = spark.range(1).select(js_distance([F.lit(x) for x in p], [F.lit(x) for x in q])).first()[0]
    assert abs(got - math.sqrt((kl(p) + kl(q)) / 2)) < 1e-12


def test_empty(spark):
    assert quality(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
