"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on text of toxic documents and one
on text of ordinary documents.  A window of text is compressed with both; a
window that the toxic dictionary makes shorter is closer to toxic text.  A
document's score is a logistic function of what its windows gain, and both the
weights and the decision threshold are calibrated on training rows.

Both dictionaries end in the same block, trained on ordinary text; the toxic one
also has, before it, a block trained on the words that mark toxic documents.
So an ordinary window costs the same under either, and the difference of the
two lengths holds only what sets the classes apart.  Windows are short enough
that zstandard stores their literals as they are, and each is followed by a
carrier that both dictionaries know, so no window falls back to a raw block.

The toxic block's words are chosen before it is trained: toxic text is ordinary
text but for a few words, and a dictionary trained on all of its running text
learns the language instead of them (the README has figures).

Edge cases: null and empty texts have no window and get the score of the
intercept alone; a text of any length is scored whole, window by window, in
constant memory; equal texts get equal scores; with labels of one class only
(or none) no dictionary can be trained and every score is the share of toxic
labels (0.0 without labels).  An id labelled several times counts as toxic if one
of its labels does, and where several documents share a labelled id the least
text is learned; repeated rows are scored row by row; a score of 0.5 is toxic;
null ids are no held-out rows; an empty table gives an empty result.  classify()
replaces columns named like its own; drop_toxic() adds and replaces none.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: Rows of each label that the fit may gather on the driver.  Their texts are read whole, as scoring does.
FIT_ROWS = {1: 1500, 0: 2500}
WINDOW_BYTES = 52
SPECIFIC_BYTES = 2048
COMMON_BYTES = 32_768
_WORD = re.compile(r"[^\W\d_]+")


def windows(text: str | None, size: int = WINDOW_BYTES) -> Iterator[bytes]:
    """Lower-cased UTF-8 windows of about ``size`` bytes, cut at white space.

    A cut without white space in its last half falls at ``size`` bytes, so an
    unbroken text is still covered whole.
    """
    words = (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()
    if not words:
        return
    data = b" " + b" ".join(words)
    at, end = 0, len(data)
    while at < end:
        to = at + size
        if to < end:
            cut = data.rfind(b" ", at + size // 2, to)
            to = cut if cut > 0 else to
        yield data[at:to]
        at = to


_SPACES = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """A model with its compressors; one per Python worker."""

    def __init__(self, model: Model):
        self.weights = model.weights
        self.pair = None
        if model.toxic:
            self.tail = model.ordinary[-64:]
            self.pair = [_compressor(d) for d in (model.toxic, model.ordinary)]

    def features(self, text: str | None) -> list[float]:
        if self.pair is None:
            return [0.0] * N_FEATURES
        toxic, ordinary = (c.compress for c in self.pair)
        tail = self.tail
        gains = [len(ordinary(w + tail)) - len(toxic(w + tail)) for w in windows(text)]
        if not gains:
            return [0.0] * N_FEATURES
        gains.sort(reverse=True)
        sure = sum(g for g in gains if g >= SURE)
        second = gains[1] if len(gains) > 1 else 0
        return [min(gains[0], 8) / 4, min(max(second, 0), 8) / 4, math.log1p(sure), math.log1p(len(gains)), min(sure / len(gains), 2.0)]

    def score(self, text: str | None) -> float:
        z = self.weights[0] + sum(w * x for w, x in zip(self.weights[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


N_FEATURES = 5
#: A gain of so many bytes is hardly chance.
SURE = 2


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_LAZY2, min_match=5, window_log=20, hash_log=17, chain_log=17, search_log=4, write_content_size=False, write_checksum=False, write_dict_id=False)
    shared.precompute_compress(compression_params=params)
    return zstandard.ZstdCompressor(dict_data=shared, compression_params=params)


def _train(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary of ``size`` bytes, or the samples themselves where they are too few to train on."""
    if not samples:
        return b""
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=6).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[:size]


def fit(rows: Iterable[tuple[str | None, int]]) -> Model:
    """Train the dictionaries and calibrate the weights on (text, label) rows."""
    rows = [(t or "", int(y)) for t, y in rows if y is not None]
    n_toxic = sum(y for _, y in rows)
    if not n_toxic or n_toxic == len(rows):
        share = n_toxic / len(rows) if rows else 0.0
        z = 60.0 if share == 1 else -60.0
        return Model(b"", b"", (z, *[0.0] * N_FEATURES))
    # Dictionaries come from two thirds of the rows; weights from all of them, in
    # which the last third shows what unseen windows gain.
    held = [k % 3 == 2 for k in range(len(rows))]
    words = [_WORD.findall(t.lower()) for t, _ in rows]
    learn = [(y, w) for (_, y), w, out in zip(rows, words, held, strict=True) if not out]
    stems = _stems(learn)
    pattern = re.compile("|".join(sorted(map(re.escape, stems), key=len, reverse=True)) or r"(?!)")
    toxic_words = [f" {x}".encode() for y, w in learn if y for x in w if pattern.match(x)]
    ordinary_words = [" ".join(w[k : k + 24]).encode() for y, w in learn if not y for k in range(0, len(w), 24)]
    shared = _train(ordinary_words, COMMON_BYTES) or bytes(64)
    own = _train(toxic_words, SPECIFIC_BYTES)
    # Training may pass over a rare mark; all of them close the block.
    own += b"".join(f" {x}".encode() for x in stems)
    toxic, ordinary = own + shared, shared
    probe = Scorer(Model(toxic, ordinary, (0.0,) * (N_FEATURES + 1)))
    x = np.array([[1.0, *probe.features(t)] for t, _ in rows])
    y = np.array([v for _, v in rows], float)
    weight = np.where(np.array(held), 2.0, 0.5)
    return Model(toxic, ordinary, tuple(_logistic(x, y, weight)))


def _stems(learn: list[tuple[int, list[str]]]) -> list[str]:
    """Word beginnings that mark toxic text: more of its documents have them than chance among so many explains.

    A passage that many copies share puts its words behind the same word each
    time; what marks a class stands behind many different ones.
    """
    n = Counter(y for y, _ in learn)
    seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for y, w in learn:
        seen[y].update({x[:k] for x in set(w) for k in range(4, len(x) + 1)})
    bar = 2 * math.log(1 + len(seen[0]) + len(seen[1])) + 8
    rate = n[1] / (n[0] + n[1])
    gain = {}
    for x, a in seen[1].items():
        b = seen[0][x]
        if a >= 3 and a * n[0] > 6 * b * n[1]:
            gain[x] = 2 * (a * math.log(a / ((a + b) * rate)) + (b * math.log(b / ((a + b) * (1 - rate))) if b else 0))
    gain = {x: g for x, g in gain.items() if g > bar}
    before: dict[str, set[str]] = {x: set() for x in gain}
    for y, w in learn:
        if y:
            for last, x in zip(["", *w], w):
                for k in range(4, len(x) + 1):
                    if x[:k] in before:
                        before[x[:k]].add(last)
    gain = {x: g for x, g in gain.items() if len(before[x]) >= max(3, seen[1][x] / 2)}
    best = set()
    for x in gain:
        parts = [x[:k] for k in range(4, len(x) + 1) if x[:k] in gain]
        top = max(gain[p] for p in parts)
        best.add(max((p for p in parts if gain[p] >= 0.8 * top), key=len))
    # Of two marks that begin alike the longer stays, unless the shorter explains much more.
    return sorted(x for x in best if not any(y != x and (y.startswith(x) and gain[y] >= 0.8 * gain[x] or x.startswith(y) and gain[x] < 0.8 * gain[y]) for y in best))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.02, steps: int = 60) -> list[float]:
    """Weighted logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (weight * (p - y)) + penalty * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return [float(v) for v in w]


def held_out(doc_id: str = "doc_id"):
    """Column: true for the rows that no fit may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_from(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on a bounded sample of labelled rows: of each label the FIT_ROWS rows whose hashed ids come first.

    Rows for which held_out() is true are not used.  The sample's ids are few
    whatever the size of the tables, so they are what the join broadcasts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    chosen = None
    for y, n in FIT_ROWS.items():
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select("doc_id", F.col("text").alias("t")).join(F.broadcast(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "y").agg(F.min("t").alias("t")).collect()
    return fit((r["t"], r["y"]) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["t"] or "")))


def score_column(model: Model, text: str = "text"):
    """Column with the score of each whole text."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = model.scorer()
        for texts in batches:
            yield pd.Series([scorer.score(t) for t in texts], dtype="float64")
        trim()

    return score(F.col(text))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with held_out, score (0 to 1) and predicted (1 from 0.5)."""
    return docs.withColumns({"held_out": held_out(), "score": score_column(model)}).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that score under 0.5."""
    return docs.where(score_column(model) < 0.5)
