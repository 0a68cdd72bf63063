"""Operator 11, fill-in-middle: texts cut between whole lines and put into another order.

The lines of a text are what an isolating Split pre-tokenizer of the tokenizers library gives for the
pattern `[^\\n]*\\n|[^\\n]+`: one pair of code-point offsets each, nothing is trained. Their number is n.
Two ranks between 0 and n, drawn from a hash of the id, pick the cuts in that array of offsets, and the
text is sliced there: prefix, middle, suffix.

Forms: plain (the text as it is), psm (prefix, suffix, middle) and spm (suffix, prefix, middle), each part
behind its mark. The mark that ends a part cannot straddle the part's end (no mark's end is another's
beginning) and texts that hold a mark stay plain, so the first mark found is the right one and
`restored` gives the text back from output and form alone.

Every text is a row of its own: no shuffle, no state, and a long text is sliced, never copied by line.

Defined results: a null or empty text is plain with n = 0; a null id is hashed as the empty string; equal
rows give equal rows; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keep_only, slices, texts_of

LINE = r"[^\n]*\n|[^\n]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(seed: int, key: str) -> list[int]:
    """Four numbers below 2**32 from the id's hash."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def cut(text: str, offsets: list[tuple[int, int]], first: int, second: int) -> tuple[str, str, str]:
    """Prefix, middle and suffix: cut after so many units as the smaller and the larger rank say."""
    a, b = (offsets[rank - 1][1] if rank else 0 for rank in sorted((first, second)))
    return text[:a], text[a:b], text[b:]


def fill_in_middle(docs: DataFrame, *, seed: int = 7, rate: int = 100, spm_share: int = 50, unit: str = LINE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain), output.

    Of a hundred texts `rate` are transformed, and of these `spm_share` of a hundred are spm."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        keep_only()
        units = Split(Regex(unit), "isolated")
        for b in slices(batches):
            rows = []
            for key, text in zip(b.column("key").to_pylist(), texts_of(b)):
                offsets = [at for _, at in units.pre_tokenize_str(text)] if text else []
                h1, h2, h3, h4 = draws(seed, key or "")
                if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
                    rows.append((len(offsets), PLAIN, None, None, text))
                    continue
                prefix, middle, suffix = cut(text, offsets, h1 % (len(offsets) + 1), h2 % (len(offsets) + 1))
                if h4 % 100 < spm_share:
                    form, out = SPM, (SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
                else:
                    form, out = PSM, (PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle)
                rows.append((len(offsets), form, len(prefix), len(middle), "".join(out)))
            n, form, before, within, out = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(within, pa.int64()), pa.array(out, pa.string())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    return src.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that a transformed one was made of, from the output and its form."""
    after = lambda x, mark: F.substr(x, F.locate(mark, x) + F.lit(len(mark)))
    before = lambda x, mark: F.substr(x, F.lit(1), F.locate(mark, x) - F.lit(1))
    psm = lambda o: F.concat(before(after(o, PREFIX), SUFFIX), after(o, MIDDLE), before(after(o, SUFFIX), MIDDLE))
    spm = lambda o: F.concat(before(after(o, PREFIX), MIDDLE), after(o, MIDDLE), before(after(o, SUFFIX), PREFIX))
    return F.when(form == PSM, psm(output)).when(form == SPM, spm(output)).otherwise(output)
