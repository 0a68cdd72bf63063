import random

import numpy as np
import pytest

from folioscope.llm import graph
from folioscope.llm.graph import components
from folioscope.llm.near_duplicates import candidates, distance, kmers, near_duplicates, similar, sketched, sketches, without_near_duplicates


def edit(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def changed(rng, words, n, vocab=5000):
    words = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        if kind == 0:
            words[at] = f"w{rng.randrange(vocab)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"w{rng.randrange(vocab)}")
    return words


def test_banded_distance_and_similarity_against_brute_force():
    rng = random.Random(4)
    for t in range(4000):
        abc = "ab" if t % 3 else "abcdef"
        a = [rng.choice(abc) for _ in range(rng.randrange(30))]
        b = [rng.choice(abc) for _ in range(rng.randrange(30))] if t % 2 or len(a) < 8 else changed(rng, a, rng.randrange(6))
        limit, d = rng.randrange(12), edit(a, b)
        assert distance(a, b, limit) == min(d, limit + 1)
        number = {w: i for i, w in enumerate(sorted({*a, *b}))}
        xs, ys = (np.array([number[w] for w in s], "u4") for s in (a, b))
        assert similar(xs, ys) == (d <= 0.2 * max(len(a), len(b)) + 1e-9)


def test_sketches_keep_order_and_repeats():
    a = [f"w{i}".encode() for i in range(60)]
    assert (sketches(a)[0] == sketches(list(a))[0]).all()
    swapped = sketches(a[30:] + a[:30])[0]
    same = (sketches(a)[0] == swapped).mean()
    assert 0.1 < same < 0.9  # k-mers nearly equal, their order is not
    # a repeated k-mer has a label of its own and leaves the others as they are
    tail = a + a[:7]
    assert len(set(kmers(tail).tolist()) & set(kmers(a).tolist())) == len(kmers(a)) and len(set(kmers(tail).tolist())) == len(kmers(tail))
    assert (sketches(tail)[0] == sketches(a)[0]).mean() > 0.5
    assert len(sketches([b"x"])[0]) == len(sketches([b"x"] * 30000)[0])


@pytest.mark.parametrize("many,sent", [(100, 500_000), (3, 500_000), (3, 0)])
def test_components(spark, monkeypatch, many, sent):
    monkeypatch.setattr(graph, "MANY_EDGES", many)
    monkeypatch.setattr(graph, "BROADCAST_ROWS", sent)
    rng = random.Random(1)
    edges = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(60)] + [(7, 7)]
    edges += [(5000, 5001 + i) for i in range(150)] + [(7000 + i, 6000) for i in range(150)]  # stars
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    fresh = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    common = fresh(55)
    texts = [" ".join(fresh(rng.randrange(20, 150)) + common * (i % 2)) for i in range(160)]
    base = fresh(120)
    texts += [" ".join(changed(rng, base, 6)) for _ in range(60)]  # a large group of near copies
    for _ in range(25):
        w = fresh(rng.randrange(30, 200))
        texts += [" ".join(w), " ".join(changed(rng, w, max(1, len(w) // 14)))]
        if len(w) > 120:  # a near copy that repeats some of its own words
            texts.append(" ".join(changed(rng, w, 2) + w[3:12]))
    texts += [texts[3]] * 40 + ["", "", "!!", None, None, "one", "One!", "two words"]
    return texts


def test_classes_against_brute_force(spark, corpus):
    from folioscope.llm.contamination import words_of

    texts = corpus
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    words = [words_of(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] is None or texts[j] is None:
                continue
            a, b = words[i], words[j]
            if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)):
                hit = a == b or (len(set(a) & set(b)) > 0.4 * len(set(a)) and distance(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) <= 0.2 * max(len(a), len(b)) + 1e-9)
            else:
                hit = not a and not b and texts[i] == texts[j]
            if hit:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    docs = spark.createDataFrame([(i, t, 5, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n int, digest string").repartition(5)
    got = {r.doc_id: r for r in near_duplicates(docs).collect()}
    want = {i: find(i) for i in range(len(texts))}
    assert {i: r.class_id for i, r in got.items()} == want
    for i, r in got.items():
        assert r.kept == (i == want[i]) and r.class_size == sum(c == want[i] for c in want.values())


def test_pairs_stay_in_proportion(spark, corpus):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus)], "doc_id long, text string")
    pairs, large = candidates(sketched(docs, "doc_id", "text").filter("keys IS NOT NULL").cache())
    assert pairs.count() < 60 * 59 // 2 + 48 * 160 and large.count() >= 60
    assert near_duplicates(docs.limit(0)).count() == without_near_duplicates(docs.limit(0)).count() == 0


def test_one_row_of_a_class_stays(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve"
    rows = [(1, a, "x"), (1, a, "y"), (2, a, "x"), (3, b, "x"), (3, a, "z"), (4, None, "x"), (4, None, "x"), (None, a, "x"), (None, "alone", "x"), (None, None, "x"), (5, "", "x"), (5, "", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(3)
    got = near_duplicates(docs)
    kept = sorted((r.class_id or 0, r.class_size) for r in got.filter("kept").collect())
    assert got.count() == len(rows) and kept == [(0, 1), (0, 1), (1, 5), (3, 1), (4, 1), (4, 1), (5, 2)]
    left = without_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, "-" if r.text is None else r.text) for r in left.collect()) == [(0, "-"), (0, "alone"), (1, a), (3, b), (4, "-"), (4, "-"), (5, "")]


def test_texts_that_share_a_digest_by_chance(spark, monkeypatch):
    from folioscope.llm import near_duplicates as module

    long = " ".join(f"w{i}" for i in range(40))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([long, long, "something else entirely", "something else entirely", "third"])], "doc_id long, text string")
    sketch = sketched(docs, "doc_id", "text").selectExpr("doc_id", "row", "if(doc_id < 4, 7L, digest) AS digest", "check", "n", "keys")
    monkeypatch.setattr(module, "sketched", lambda *_: sketch)
    got = {r.doc_id: (r.class_id, r.kept) for r in near_duplicates(docs).collect()}
    merged = [i for i in (0, 2) if got[i + 1] == (i, False)]
    assert len(merged) == 1 and all(got[i] == (i, True) for i in range(5) if i - 1 not in merged)


def test_texts_with_very_many_copies(spark, monkeypatch):
    from folioscope.llm import near_duplicates as module

    monkeypatch.setattr(module, "MANY_COPIES", 3)
    docs = spark.createDataFrame([(i, "one two three four five six" if i % 2 else f"text {i} a b c d e") for i in range(12)] + [(99, None)], "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.class_size) for r in near_duplicates(docs).collect()}
    assert got == {i: (1, 6) if i % 2 else (i, 1) for i in range(12)} | {99: (99, 1)}


def test_ids_that_come_with_two_texts(spark):
    rng = random.Random(4)
    a, b = ([f"w{rng.randrange(5000)}" for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(changed(rng, a, 3))), (3, " ".join(changed(rng, b, 3))), (None, " ".join(a))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 5 and {r.class_id for r in got if r.doc_id in (2, 3)} == {1}


def test_large_groups_are_compared_whole(spark, monkeypatch):
    from folioscope.llm import near_duplicates as module

    rng = random.Random(12)
    passage = [f"p{i}" for i in range(154)]  # 77 % of each text; what is left agrees by common words alone
    zipf = [1 / (i + 1) for i in range(3000)]
    texts = [passage + [f"w{x}" for x in rng.choices(range(3000), zipf, k=46)] for _ in range(120)]
    number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    words = [np.array([number[w] for w in t], "u4") for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(words[i], words[j])]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    want = {i: find(i) for i in range(len(texts))}
    assert 20 < len(set(want.values())) < 118
    for blocks in (False, True):
        own = np.arange(len(texts))
        for a, b in module.links_between(words, own.copy(), own % 2 * blocks, np.empty((len(texts), 0))):
            assert similar(words[a], words[b]) and (not blocks or (a - b) % 2)
            own[own == own[b]] = own[a]
        assert all(own[a] == own[b] for a, b in links if not blocks or (a - b) % 2)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    for block in (module.BLOCK, 70):
        monkeypatch.setattr(module, "BLOCK", block)
        assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == want
