import math
import re
from collections import Counter

from folioscope.llm.licenses import LEAST, TEMPLATES, TemplateIndex, licenses

MIT, GPL = TEMPLATES["MIT"][0], TEMPLATES["GPL-3.0"][0]
WORD = re.compile(r"[a-z0-9]+")


def brute(line, n, df):
    idf = lambda w: math.log((1 + n) / (1 + df.get(w, 0))) + 1
    vocab = {w for ts in TEMPLATES.values() for t in ts for w in WORD.findall(t.lower())}
    own = Counter(WORD.findall(line.lower()))
    norm = math.sqrt(sum((c * (idf(w) if w in vocab else math.log(1 + n) + 1)) ** 2 for w, c in own.items()))
    best = (0.0, None)
    for name, ts in sorted(TEMPLATES.items()):
        for t in ts:
            tv = Counter(WORD.findall(t.lower()))
            tn = math.sqrt(sum((c * idf(w)) ** 2 for w, c in tv.items()))
            dot = sum(c * own.get(w, 0) * idf(w) ** 2 for w, c in tv.items())
            if norm and dot / norm / tn > best[0] + 1e-12:
                best = (dot / norm / tn, name)
    return best if best[0] >= LEAST else (0.0, None)


def test_trigger_words_lose_nothing():
    import random

    rng = random.Random(3)
    words = [w for ts in TEMPLATES.values() for t in ts for w in WORD.findall(t.lower())]
    for n, df in ((0, {}), (1000, {"the": 990, "of": 900, "license": 30, "licensed": 20, "under": 500}), (50, {w: 50 for w in words})):
        index = TemplateIndex(n, df)
        for _ in range(1500):
            ts = rng.choice(list(TEMPLATES.values()))
            line = WORD.findall(rng.choice(ts).lower())
            rng.shuffle(line)
            line = " ".join(line[: rng.randrange(1, len(line) + 1)] + rng.choices([*words, "zz", "yy"], k=rng.randrange(4)))
            got, want = index.scan(line, False), brute(line, n, df)
            assert abs(got[0] - want[0]) < 1e-9 and got[1] == want[1], line


def test_notices_within_lines_and_over_line_ends():
    index = TemplateIndex(10_000, {"the": 9900, "this": 9000, "of": 9800, "to": 9700, "under": 3000, "is": 9500, "in": 9600, "and": 9700, "or": 8000})
    assert index.scan("Copyright 2020 Foo Inc. Released under the MIT License. All rights reserved by nobody else at all", False)[1] == "MIT"
    assert index.scan("Released under the MIT License by us", False)[1] == "MIT"
    for name, notices in TEMPLATES.items():
        for notice in notices:
            words, lines = notice.split(), []
            while words:
                lines.append(" # " + " ".join(words[:4]))
                words = words[4:]
            text = "A file about whales and ships\n\n" + "\n".join(lines) + "\n\nimport everything from nowhere" + " and more" * 50
            score, got = index.scan(text, False)
            # "v. 2.0." ends a sentence after "v."
            assert got == name and score > (0.9 if "v. 2.0" in notice else 0.99), (name, got, score)
    assert index.scan("The licence of the museum was under review. Free software is a public domain.", False) == (0.0, None)
    assert index.scan(TEMPLATES["MIT"][0] + "\n" + TEMPLATES["Apache-2.0"][0], False)[1] == "Apache-2.0"


def test_inheritance(spark):
    rows = [(1, "LICENSE", f"text\n{GPL}"), (2, "a/b/COPYING", MIT), (3, "a/b/c/x.txt", "nothing"), (4, "a/y.txt", "nothing"), (5, "a/b/z.txt", f"more text\n{GPL}\nend"), (6, "abc/w.txt", None), (7, None, MIT), (8, None, None), (9, "a/b/LICENSE.txt", "no licence words"), (10, "q/LICENSE", ""), (11, "a/b/c/x.txt", "nothing"), (None, "a/b/c/d", "long " * 50000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, path string, text string, license string").repartition(3)
    got = sorted(((r.doc_id or 0, r.own_license, r.license, r.inherited_from) for r in licenses(df).collect()), key=lambda x: x[0])
    assert got == [
        (0, None, "MIT", "a/b"), (1, "GPL-3.0", "GPL-3.0", None), (2, "MIT", "MIT", None), (3, None, "MIT", "a/b"), (4, None, "GPL-3.0", ""), (5, "GPL-3.0", "GPL-3.0", None),
        (6, None, "GPL-3.0", ""), (7, "MIT", "MIT", None), (8, None, None, None), (9, None, "MIT", "a/b"), (10, None, "GPL-3.0", ""), (11, None, "MIT", "a/b"),
    ]
    assert licenses(df.limit(0)).count() == 0
