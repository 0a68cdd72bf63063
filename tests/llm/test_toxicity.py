import math
import random
import zlib

import numpy as np

from folioscope.llm import toxicity as module
from folioscope.llm.toxicity import fitted, grams, held_out, packed, toxicity

BAD = ["zorgle", "blarfen", "quintok"]


def _rows(n, seed=0):
    rng = random.Random(seed)
    plain = [f"word{i}" for i in range(300)]
    for i in range(n):
        words = rng.choices(plain, k=40)
        toxic = i % 6 == 0
        if toxic:
            words[rng.randrange(40)] = rng.choice(BAD)
        yield i, " ".join(words), int(toxic)


def test_learns_and_holds_out(spark):
    data = list(_rows(1500))
    docs = spark.createDataFrame([(i, t, 0.5, "en") for i, t, _ in data], "doc_id long, text string, score double, label string").repartition(4)
    labels = spark.createDataFrame([(i, 1, x) for i, _, x in data], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity(docs, labels).collect()}
    truth = {i: x for i, _, x in data}
    assert len(got) == 1500
    for i, r in got.items():
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) == held_out(i)
    tested = [r for r in got.values() if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in tested)
    assert right >= 0.97 * len(tested)
    # labels of held-out rows change nothing
    flipped = spark.createDataFrame([(i, 1, 1 - x if held_out(i) else x) for i, _, x in data], "doc_id long, quality int, toxic int")
    again = {r.doc_id: r.score for r in toxicity(docs, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "!!"), (4, "one"), (4, "one"), (None, "x"), (5, "long " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(4, 0), (4, 1), (7, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity(docs, labels).count() == 7
    assert {r.predicted for r in toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity(docs.limit(0), labels).count() == 0
    assert len(grams(None)) == 0 and len(grams("a b")) == 3 and len(grams("a b c")) == 6


def _plain_ftrl(rows, passes):
    """The published update, one coordinate at a time."""
    z, n, bias = {}, {}, 1 << module.BITS

    def weight(i):
        l1 = 0.0 if i == bias else module.L1
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= l1 else -(v - math.copysign(l1, v)) / ((module.BETA + math.sqrt(n.get(i, 0.0))) / module.ALPHA + module.L2)

    for _ in range(passes):
        for label, features in rows:
            own = [*features, bias]
            w = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in own:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / module.ALPHA * w[i]
                n[i] = old + g * g
    return {i: weight(i) for i in z if i != bias and weight(i)}, weight(bias)


def test_weights_against_a_plain_ftrl():
    rows = [(x, sorted(set(grams(t).tolist()))) for _, t, x in _rows(200, 4)]
    want, bias = _plain_ftrl(rows, module.PASSES)
    at, w, got = module.fit([(x, packed(np.array(f, np.int32))) for x, f in rows], 0.0)
    assert len(want) > 0 and set(at.tolist()) == set(want) and abs(got - bias) < 1e-6
    assert all(abs(want[i] - x) < 1e-5 for i, x in zip(at.tolist(), w.tolist()))


def test_repeated_rows_are_learned_once(spark):
    data = list(_rows(300))
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, x) for i, _, x in data], "doc_id long, toxic int")
    once = fitted(make([(i, t) for i, t, _ in data]), labels)
    often = fitted(make([(i, t) for i, t, _ in data] * 3), labels)
    assert all((np.asarray(a) == np.asarray(b)).all() for a, b in zip(once, often))
    mixed = make([(i, t) for i, t, _ in data] + [(1, f"other text {k}") for k in range(500)])
    rows, _ = module.training_rows(mixed, labels, id_col="doc_id", text_col="text", label_col="toxic")
    assert rows.count() == sum(not held_out(i) for i, _, _ in data)
