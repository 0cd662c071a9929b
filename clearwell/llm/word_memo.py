"""Encoding of whole texts with the tokenizers library, word by word with a memory.

The tokenizer's normalizer, pre-tokenizer and model never look across white
space: composition does not join a mark to a space, every pre-token lies
between spaces, and merges stay inside a pre-token.  A text's ids are therefore
the ids of its blank-separated words in order, and words repeat.  Words of
plain letters, digits and punctuation are cut into pre-tokens here and only
unseen pre-tokens go to the library; any other word goes to it whole.
"""

from __future__ import annotations

import functools
import re
import struct

from .common import Memo

#: Bounds of the two memories of a worker.
WORDS = 600_000
PRETOKENS = 700_000
#: Texts on which the encoder must agree with the library before it is used: another file may normalise or split otherwise.
PROBES = ("", " ", "a", "A b", "  two  blanks ", "\ttab", "a\nb", "É e\u0301 \ufb01 \uff21 \u2460", "日本語 テスト", "x1234,5.6!?", "don't I'LL", "<|endoftext|>", "</s>[INST]", "\U0001f642 ok")
#: Letters outside ASCII that Unicode has never changed, and lower case of which is one letter.
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(rf"[!-;=-~¿¡À-ÖØ-Þ{_LETTERS}]*")
_PRETOKEN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def _byte_letters() -> list[str]:
    """The letter that byte-level models have for each byte: printable ones stand for themselves, the rest follow 255 in order."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


_BYTES = _byte_letters()


class WordEncoder:
    """Texts to little-endian unsigned 32-bit ids; for tokenizers that split at white space and cut words as in _PRETOKEN."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(file)
        self.words = Memo(self._word, WORDS)
        self.pretokens = Memo(self._pretoken, PRETOKENS)
        for probe in PROBES:
            if self.encode(probe) != self._by_library(probe):
                raise ValueError("the tokenizer normalises or splits text in another way than this encoder")

    def _by_library(self, text: str) -> bytes:
        return self._packed(self.library.encode(text, add_special_tokens=False).ids)

    def _pretoken(self, text: str) -> bytes:
        """A pre-token straight to the library's model: it is normalised already, and nothing cuts it."""
        mapped = text if text.isascii() else "".join(map(_BYTES.__getitem__, text.encode()))
        return self._packed([t.id for t in self.library.model.tokenize(mapped)])

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def _word(self, word: str) -> bytes:
        core = word.rstrip(".,")
        if core.isalpha() and core.isascii():
            return self.pretokens[core.lower()] + (self.pretokens[word[len(core) :]] if len(core) < len(word) else b"")
        if _PLAIN.fullmatch(word):
            return b"".join(map(self.pretokens.__getitem__, _PRETOKEN.findall(word.lower())))
        return self._by_library(word)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))


@functools.lru_cache(maxsize=1)
def encoder_of(file: str) -> WordEncoder:
    """The worker's encoder: its bounded memories serve all tasks that it runs."""
    return WordEncoder(file)
