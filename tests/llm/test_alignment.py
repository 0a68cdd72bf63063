import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers as P
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from folioscope.llm import alignment as module
from folioscope.llm.alignment import Aligner, alignment
from folioscope.llm.queries import QUERIES

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "a", "a ", " a", "a  b", "the cat sat", "the cat sat", "The cat\n sat \n\n on\tit", "<s> a</s> <0x41> <unk> <|endoftext|>",
    "a▁b", "▁", "日本語 テキスト é", "naïve œuvre ﬁ   nbsp　wide", "a\x00b \x1c \x85 x", "x" * 3000, "ab12 " * 9000, "😀 😀", "é ́", "  z",
]


@pytest.fixture(scope="module")
def tokenizers():
    a, b = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    back = {c: i for c, i in module.byte_alphabet().items()}
    return a, b, back


def by_hand(tokenizers, texts):
    """The definition, over whole texts: token by token, all occurrence pairs."""
    a, b, back = tokenizers
    docs, count = [], Counter()
    for text in texts:
        text = text or ""
        a_ids = a.encode(" " + text, add_special_tokens=False).ids if text else []
        b_ids = b.encode(text) if text else []
        a_bytes = [bytes(back[c] for c in a.id_to_token(i)) for i in a_ids]
        b_bytes = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in b_ids]
        want = (" " + text).encode()
        if not text or b"".join(a_bytes) != want or b"".join(b_bytes) != want:
            docs.append(None)
            continue
        ends = lambda parts: [sum(map(len, parts[: i + 1])) for i in range(len(parts))] if len(parts) < 2000 else running(parts)

        def running(parts):
            out, at = [], 0
            for x in parts:
                at += len(x)
                out.append(at)
            return out

        ea, eb = ends(a_bytes), ends(b_bytes)
        both = sorted(set(ea) & set(eb))
        links, shown, i, j = [], [], 0, 0
        for end in both:
            ga, gb = i, j
            while i < len(ea) and ea[i] <= end:
                i += 1
            while j < len(eb) and eb[j] <= end:
                j += 1
            shown.append(",".join(map(str, a_ids[ga:i])) + "|" + ",".join(map(str, b_ids[gb:j])))
            for x in range(ga, i):
                for y in range(gb, j):
                    if max(ea[x] - len(a_bytes[x]), eb[y] - len(b_bytes[y])) < min(ea[x], eb[y]):
                        links.append((a_ids[x], b_ids[y]))
        docs.append((len(a_ids), len(b_ids), len(both), links, hashlib.sha256(";".join(shown).encode()).hexdigest()))
        count.update(set(links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    zero = (0, 0, 0, 0, 0, 0, "")
    return [zero if d is None else (*d[:3], len(d[3]), sum(count[p] == top[p[0]] for p in d[3]), sum(count[p] for p in d[3]), d[4]) for d in docs]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "clash", -1) for i, t in enumerate(texts)], "doc_id long, text string, keys string, row int")


def rows_of(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


@pytest.mark.parametrize("hot", [100_000, 3])
def test_odd_texts_equal_the_definition(spark, monkeypatch, tokenizers, hot):
    monkeypatch.setattr(module, "HOT", hot)
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice(" \n\tabcdE.,'s19é日▁<|>") for _ in range(rng.randrange(80))) for _ in range(400)] + ["a common line of words"] * 60
    assert rows_of(alignment(frame(spark, texts).repartition(7), A, B)) == by_hand(tokenizers, texts)


def test_whole_query_equals_the_definition(spark, tokenizers):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    assert rows_of(QUERIES["op12_group_alignment"](spark, sf)) == by_hand(tokenizers, [r.text for r in rows])


def test_memory_starts_anew_and_keys_give_their_ids_back(monkeypatch):
    rng = random.Random(9)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(60)]
    aligner = Aligner(A, B)
    align = lambda: [x[:5] for t in texts for x in aligner.align([t])]
    want = align()
    monkeypatch.setattr(module, "CACHE_GROUPS", 40)
    aligner.forget()
    assert align() == want and len(aligner.keys) < 400
    for n in (1, 5, 254, 255, 256, 70_000):
        a_ids, b_ids = [rng.randrange(50_000) for _ in range(n)], [rng.randrange(32_000) for _ in range(1 + n // 3)]
        assert aligner.ids_of(aligner.key(a_ids, b_ids)) == (a_ids, b_ids)


def test_empty_table_and_repeated_ids(spark):
    assert alignment(frame(spark, []), A, B).count() == 0
    twice = frame(spark, ["a b"]).union(frame(spark, ["a b"]))
    rows = alignment(twice, A, B).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0].count_sum == 2 * rows[0].n_links
