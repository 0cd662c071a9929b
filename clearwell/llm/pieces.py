"""Exact SentencePiece BPE encoding by backtracking, and decoding.

An Aho-Corasick automaton over the pieces finds every piece that starts at a
place of the text.  The encoder walks from left to right with the longest
piece; a piece may follow another only if merging the two pieces' text anew
gives the same two pieces.  Where no piece fits, the place is marked in a
bitfield of failed positions and the last piece is taken back and shortened.
The bitfield keeps every place from being tried twice, so the walk is linear.

A text is first cut where no piece spans two neighbouring characters: no merge
can cross such a cut, so the parts are encoded apart and remembered.  A
character that no piece holds becomes its byte pieces.

Edge cases: null and empty texts give the end id alone and decode to the empty
text; texts of any length are encoded whole; equal texts get equal ids; lone
surrogates cannot occur in Spark strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, lean

#: Bounds of a worker's memories: blank-separated words, parts between cuts, pairs of pieces.
WORDS, PARTS, PAIRS = 250_000, 300_000, 400_000
SPACE = "▁"
#: Texts on which the encoder must agree with the library before it is used: another file may normalise or split otherwise.
PROBES = ("", " ", "a", "A b", "  two  blanks ", "\ttab", "a\nb", "é e\u0301 \ufb01 \uff21 \u2460", "日本語 テスト", "x1234,5.6!", "▁low", "</s>[INST] <unk> <0x41>", "\U0001f642 ok")
_BARE = "\x02"


class PieceEncoder:
    def __init__(self, file: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=file)
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte: dict[int, int] = {}
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.id[piece], self.score[piece] = i, lib.get_score(i)
        self.piece = {i: p for p, i in self.id.items()}
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.inside = {p[k : k + 2] for p in self.id for k in range(len(p) - 1)}
        self.pairs = Memo(self._compatible, PAIRS)
        self.parts = Memo(self._part, PARTS)
        self.words = Memo(self._word, WORDS)
        # Words stay apart in the fast path below only if no piece has a space after another character.
        if lib.vocab_size() > 65_536 or any(lib.is_byte(lib.piece_to_id(f"<0x{b:02X}>")) is False for b in range(256)):
            raise ValueError("the model has too many pieces, or no pieces for single bytes")
        self.apart = not any(b == SPACE != a for a, b in self.inside) and not any("\n" in p for p in self.id)

        for probe in PROBES:
            if self.encode(probe).tolist() != lib.encode(probe):
                raise ValueError("the model normalises text, or has pieces that are no merges")

    def merge(self, text: str) -> list[str]:
        """The pieces of a short text by merging neighbours, the best score first, the leftmost of equal ones."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = self.score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, pair: int) -> bool:
        left, right = pair >> 32, pair & 0xFFFFFFFF
        if left == 0xFFFFFFF:  # the start of a text: the piece must stand as itself
            return self.merge(self.piece[right]) == [self.piece[right]]
        a, b = self.piece[left], self.piece[right]
        return self.merge(a + b) == [a, b]

    def backtrack(self, text: str) -> list[int]:
        """Ids of a text all characters of which are pieces."""
        n = len(text)
        if n == 1:
            return [self.id[text]]
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for end, (size, i) in self.automaton.iter(text):
            starts[end - size + 1].append((size, i))  # ascending by length, as the ends ascend
        pairs = self.pairs
        failed = bytearray(n + 1)
        out: list[tuple[int, int]] = []  # (id, index in starts)
        at, choice = 0, len(starts[0]) - 1
        while at < n:
            last = out[-1][0] if out else 0xFFFFFFF
            here, found = starts[at], False
            while choice >= 0:
                size, i = here[choice]
                if not failed[at + size] and pairs[last << 32 | i]:
                    found = True
                    break
                choice -= 1
            if found:
                out.append((i, choice))
                at += size
                choice = len(starts[at]) - 1 if at < n else 0
            else:
                failed[at] = 1
                if not out:
                    raise ValueError("no encoding: a character is no piece")
                i, choice = out.pop()
                at -= len(self.piece[i])
                choice -= 1
        return [i for i, _ in out]

    def _part(self, text: str) -> bytes:
        if len(text) == 1 and text not in self.id:
            ids = [self.byte[b] for b in text.encode()]
        else:
            ids = self.backtrack(text)
        return np.array(ids, "<u2").tobytes()

    def _cut(self, text: str) -> bytes:
        """Ids of a text whose spaces are already SPACE."""
        inside, out, start = self.inside, [], 0
        for k in range(1, len(text)):
            if text[k - 1 : k + 1] not in inside:
                out.append(self.parts[text[start:k]])
                start = k
        out.append(self.parts[text[start:]])
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        if word == "\n":
            return self._cut(word)
        if word[:1] == _BARE:
            return self._cut(word[1:]) if len(word) > 1 else b""
        return self._cut(SPACE + word)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text, without an end id."""
        if not text:
            return np.zeros(0, np.uint16)
        if not self.apart or text[0] == " " or "  " in text or _BARE in text or SPACE in text:
            ids = self._cut(SPACE + text.replace(" ", SPACE))
        else:
            # A line's end is cut from both neighbours; what follows it has no space of its own.
            if "\n" in text:
                text = text.replace("\n", " \n " + _BARE)
            ids = b"".join(map(self.words.__getitem__, text.split(" ")))
        return np.frombuffer(ids, "<u2")


def encode(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256): each whole text's ids with end_id, and digests of them and of what they decode to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(file)
        decimal = [str(i) for i in range(65536)]
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                ids = np.append(encoder.encode(t), np.uint16(end_id)).astype(np.int32)
                listed = ids.tolist()
                rows.append((len(listed), ids, _sha256(" ".join(map(decimal.__getitem__, listed))), _sha256(encoder.library.decode(listed))))
            n, i, a, d = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(i, pa.list_(pa.int32())), pa.array(a, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, n_tokens long, ids array<int>, ids_sha256 string, decoded_sha256 string")


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
