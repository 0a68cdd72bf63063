"""Subword encoding with the tokenizers library, spread over executors.

Words repeat far more than texts do. A text is cut where the vocabulary's own rule cuts it before
merging, each distinct piece is encoded once by the library, and a text's ids are the pieces' ids
put together, so they equal those of the whole text (tested against it).

Texts of Latin-1 letters are cut by the rule itself, written out for these characters. Others are
cut only at spaces before a non-space, which both rules never join across.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np

from folioscope.llm.common import keep_only, remembers

#: Distinct pieces that a worker remembers; beyond it the memory starts anew.
CACHE_PIECES = 800_000
#: Pieces that go to the library in one string.
_JOINED = 256
# Letters, numbers and white space of Latin-1, and the contractions that both rules cut off.
_SMALL, _NUMBER, _SPACE = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LETTER = "A-ZÀ-ÖØ-Þ" + _SMALL
_SHORT = "'s|'t|'re|'ve|'m|'ll|'d"
#: Letters come first, as most pieces are words; no other alternative can take what they take.
_WORD_RULE = re.compile(f"[{_SMALL}]+|{_SHORT}|[{_NUMBER}]|[^{_SPACE}{_SMALL}{_NUMBER}]+")
_BYTE_RULE = re.compile(f" ?[{_LETTER}]+|{_SHORT}| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_BEYOND = re.compile("[^\x00-\xff]")
_CUT = re.compile(r"(?= \S)")
#: A piece with white space other than one leading space goes to the library alone.
_ALONE = re.compile(r"(?!^ )\s|^ ?\Z")
_LOADED: dict[tuple[str, bool], "Encoder"] = {}
remembers("tokens", _LOADED.clear)


class Encoder:
    """texts -> little-endian unsigned 32-bit ids, by a tokenizers file whose path is given.

    spaced: the vocabulary keeps a space with the word after it (byte-level kind); else it lowers
    letters and drops white space.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced, self.known = Tokenizer.from_file(path), spaced, {}
        self.between = "\n" if spaced else " \x01 "
        (self.mark,) = self.tokenizer.encode(self.between, add_special_tokens=False).ids

    @staticmethod
    def shared(path: str, spaced: bool) -> "Encoder":
        keep_only("tokens")
        if (path, spaced) not in _LOADED:
            _LOADED.clear()
            _LOADED[path, spaced] = Encoder(path, spaced)
        return _LOADED[path, spaced]

    def pieces(self, text: str) -> list[str]:
        if "<|" in text or _BEYOND.search(text):
            return _CUT.split(text) if self.spaced else text.replace("\n", " ").split(" ")
        return _BYTE_RULE.findall(text) if self.spaced else _WORD_RULE.findall(text.lower())

    def _learn(self, new: set[str]) -> None:
        """Encode distinct pieces: many to a string with a mark between, odd ones one by one."""
        odd = [x for x in new if _ALONE.search(x) or self.between.strip(" ") in x]
        plain = list(new.difference(odd))
        for piece, got in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)):
            self.known[piece] = np.array(got.ids, "<u4").tobytes()
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        for group, got in zip(groups, self.tokenizer.encode_batch_fast([self.between.join(x) for x in groups], add_special_tokens=False)):
            ids = np.array(got.ids, "<u4")
            ends = [*(np.flatnonzero(ids == self.mark) * 4).tolist(), 4 * len(ids)]
            if len(ends) != len(group):
                raise ValueError("a piece holds the mark")
            flat, at = ids.tobytes(), 0
            for piece, end in zip(group, ends):
                self.known[piece] = flat[at:end]
                at = end + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        """One look-up per piece; only the missing ones are looked up again once they are known."""
        cut = [self.pieces(x) for x in texts]
        got = [list(map(self.known.get, x)) for x in cut]
        new = {p for x, g in zip(cut, got) for p, ids in zip(x, g) if ids is None}
        if new:
            if len(self.known) + len(new) > CACHE_PIECES:
                self.known = {}
            self._learn(new)
            known = self.known
            got = [[known[p] if ids is None else ids for p, ids in zip(x, g)] for x, g in zip(cut, got)]
        return [b"".join(g) for g in got]


def crc32(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
