import hashlib
import random
import re

from folioscope.llm.contamination import ItemAutomaton, contamination, cut, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def brute(text, items, window):
    words = WORD.findall(lower(text))
    hit, found = [False] * len(words), set()
    for item, t in items:
        w = WORD.findall(lower(t))
        wins = [w] if 0 < len(w) < window else [w[i : i + window] for i in range(len(w) - window + 1)] if w else []
        for x in wins:
            for i in range(len(words) - len(x) + 1):
                if words[i : i + len(x)] == x:
                    found.add(str(item))
                    hit[i : i + len(x)] = [True] * len(x)
    return words, hit, found


def test_automaton_against_brute_force():
    rng = random.Random(1)
    for trial in range(150):
        window = rng.choice([2, 3, 5])
        abc = "abc" if trial % 2 else "abcdefgh"
        items = [(i, " ".join(rng.choice(abc) for _ in range(rng.randrange(0, 12)))) for i in range(6)]
        a = ItemAutomaton([(str(i), words_of(t)) for i, t in items], window)
        for _ in range(6):
            text = " ".join(rng.choice(abc + "z") for _ in range(rng.randrange(40)))
            words, hit, found = brute(text, items, window)
            h, f = a.match(words_of(text))
            assert h.tolist() == hit and f == found


def test_words_and_cut():
    assert words_of("A-b Été99  ÉX\x00y") == [x.encode() for x in ("a", "b", "Été99".replace("É", "É"), "Éx", "y")]
    assert words_of(None) == [] and cut(None, []) is None
    assert cut("Keep this, drop that word. End", [[2, 4]]) == "Keep this,  word. End"


def test_contamination_query(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (10, "Short item"), (2, None), (3, "!!"), (4, "one two three four five six seven eight nine ten eleven twelve thirteen")]
    docs = ["x One two three four five six seven eight nine ten eleven twelve thirteen, y", "short-ITEM " + "pad " * 39, "short item " + "pad " * 38, "nothing here", "", None, "one two three four five six seven eight nine ten eleven twelve", "a short item a short item"]
    d = spark.createDataFrame([(i, t, True, "x") for i, t in enumerate(docs)], "doc_id long, text string, contaminated boolean, item_id string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in contamination(d, b, with_text=True).collect()}
    for i, t in enumerate(docs):
        words, hit, found = brute(t, items, 13)
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items) == (len(words), sum(hit), len(found))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        assert r.contaminated == (sum(hit) > 0 and 20 * sum(hit) >= len(words))
    assert got[7].clean_text == "a  a " and got[7].hit_spans == [[1, 3], [4, 6]]
    assert contamination(d.limit(0), b).count() == 0
    assert contamination(d, b.limit(0)).filter("n_hit > 0").count() == 0


def test_many_blocks_decide_alike(spark, monkeypatch):
    from folioscope.llm import contamination as module

    rng = random.Random(8)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 20)))) for i in range(30)] + [(99, " ".join(rng.choices(words, k=400)))]
    docs = [(i, " ".join(rng.choices(words, k=rng.randrange(30)) + items[rng.randrange(30)][1].split() + rng.choices(words, k=rng.randrange(30)))) for i in range(60)]
    docs += [(60, None), (61, " ".join(items[-1][1].split()[40:90])), (62, items[-1][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(contamination(d, b).collect())
    monkeypatch.setattr(module, "BLOCK_WORDS", 60)
    for held, gather in ((100, 1), (2, 1), (2, 10_000)):
        monkeypatch.setattr(module, "BLOCKS_HELD", held)
        monkeypatch.setattr(module, "GATHER_BYTES", gather)
        sent = module._sent(d, b, "item_id", "text", 13)
        assert len(sent) > 5 and all(sum(len(w) for _, w in x.value.items) < 60 + 72 for x in sent)
        assert sorted(contamination(d, b).collect()) == one
        assert {r.doc_id for r in module.without_contaminated(d, b).collect()} == {r.doc_id for r in one if not r.contaminated}
        # rows are decided by their texts: repeated and missing ids do not matter
        rows = [(1, items[-1][1]), (1, "clean words"), (None, items[-1][1]), (None, "clean words")]
        left = module.without_contaminated(spark.createDataFrame(rows, "doc_id long, text string"), b)
        assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, "clean words"), (1, "clean words")]
