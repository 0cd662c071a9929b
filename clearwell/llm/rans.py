"""Token-ID output: static range asymmetric numeral systems (rANS).

One frequency table, counted over all documents, is shared by all blocks.  A
block holds the ids of consecutive documents, dealt to LANES interleaved coders
whose words lie in one stream; blocks know nothing of each other, and inside a
block a checkpoint after every SEGMENT ids keeps the coders' states and the
stream's position, so that segments decode side by side.  A block's header and
body carry CRC-32 checksums.

Format of a block (little-endian): magic ``RANB``, version, lanes, scale bits,
number of documents, ids, segments and words as 32-bit integers, the CRC-32 of
the frequency table it needs and that of its body; then the body: document ids
(64 bit), ids per document (32 bit), position of each segment in the words (32
bit), states of each segment's lanes (64 bit), words (32 bit).

A data set is a folder ``blocks`` with a file for each range of doc_id, in
order, whose rows are blocks in order; and a folder ``table`` with the
frequency table.  Both are written and read by Spark only.

Edge cases: null or empty texts have their end id alone; a document longer
than a block gets a block of its own; repeated doc_ids stay separate rows, in
the order of their texts; rows without doc_id come first; an empty table gives
an empty data set.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, release, shared_folder, on_exit
from .word_memo import encoder_of

LANES = 1024
SEGMENT = 1 << 17
BLOCK = 1 << 19
SCALE = 20
LOW = np.uint64(1 << 31)
_HEAD = struct.Struct("<4s9I")


@dataclass(frozen=True)
class Table:
    """Frequencies that sum to 2**SCALE, and what coders look up."""

    freq: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> Table:
        """Scale counts; every id that occurs keeps a frequency of one at least."""
        total, size = int(counts.sum()), 1 << SCALE
        if not total:
            return Table(np.zeros(len(counts), np.uint32))
        freq = np.where(counts > 0, np.maximum(1, counts.astype(object) * size // total), 0).astype(np.int64)
        over = int(freq.sum()) - size
        order = np.argsort(-freq, kind="stable")
        k = 0
        while over:
            i = order[k % len(order)]
            step = -1 if over > 0 else 1
            if freq[i] + step >= 1:
                take = min(abs(over), max(1, int(freq[i]) // 64))
                take = min(take, int(freq[i]) - 1) if step < 0 else take
                freq[i] += step * max(1, take)
                over += step * max(1, take)
            k += 1
        return Table(freq.astype(np.uint32))

    @property
    def crc(self) -> int:
        return zlib.crc32(self.freq.astype("<u4").tobytes())

    def lookups(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        freq = self.freq.astype(np.uint64)
        start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        return freq, start, np.repeat(np.arange(len(freq), dtype=np.uint32), self.freq)


class Coder:
    def __init__(self, table: Table):
        self.crc = table.crc
        self.freq, self.start, self.symbol = table.lookups()

    def encode(self, docs: list[tuple[int, np.ndarray]]) -> bytes:
        """A block of (doc_id, ids)."""
        ids = np.concatenate([x for _, x in docs]).astype(np.int64)
        n, steps = len(ids), -(-len(ids) // LANES)
        per = SEGMENT // LANES
        segments = -(-steps // per)
        # A lane that has no id in the last step sits that step out.
        x = np.full(LANES, LOW, np.uint64)
        words: list[np.ndarray] = []
        count = np.zeros(steps, np.int64)
        states = np.zeros((segments, LANES), np.uint64)
        shift, down = np.uint64(SCALE), np.uint64(32)
        limit = np.uint64(31 - SCALE + 32)
        for t in range(steps - 1, -1, -1):
            s = ids[t * LANES : (t + 1) * LANES]
            y, f = x[: len(s)], self.freq[s]
            full = y >= f << limit
            if full.any():
                out = y[full]
                words.append(out.astype(np.uint32))
                count[t] = len(out)
                y[full] = out >> down
            q = y // f
            y[:] = (q << shift) + (y - q * f) + self.start[s]
            if t % per == 0:
                states[t // per] = x
        body_words = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
        at = np.concatenate([[0], np.cumsum(count)[:-1]])[::per] if steps else np.zeros(0)
        body = b"".join(
            [
                np.array([-1 << 63 if d is None else d for d, _ in docs], "<i8").tobytes(),
                np.array([len(x) for _, x in docs], "<u4").tobytes(),
                at.astype("<u4").tobytes(),
                states.astype("<u8").tobytes(),
                body_words.astype("<u4").tobytes(),
            ]
        )
        return _HEAD.pack(b"RANB", 1, LANES, SCALE, len(docs), n, segments, len(body_words), self.crc, zlib.crc32(body)) + body

    def decode(self, block: bytes) -> Iterator[tuple[int | None, np.ndarray]]:
        """The block's (doc_id, ids); all of its segments advance together."""
        magic, version, lanes, scale, n_docs, n, segments, n_words, table, crc = _HEAD.unpack_from(block)
        body = memoryview(block)[_HEAD.size :]
        if magic != b"RANB" or version != 1 or scale != SCALE:
            raise ValueError("not a block of this format")
        if zlib.crc32(body) != crc:
            raise ValueError("block is damaged: its checksum differs")
        if table != self.crc:
            raise ValueError("block needs another frequency table")
        parts, at = [], 0
        for kind, k in (("<i8", n_docs), ("<u4", n_docs), ("<u4", segments), ("<u8", segments * lanes), ("<u4", n_words)):
            parts.append(np.frombuffer(body, kind, k, at))
            at += parts[-1].nbytes
        doc_ids, sizes, position, states, words = parts
        ids = self._segments(n, lanes, states.reshape(segments, lanes), position.astype(np.int64), words)
        end = 0
        for d, k in zip(doc_ids.tolist(), sizes.tolist(), strict=True):
            yield (None if d == -1 << 63 else d), ids[end : end + k]
            end += k

    def _segments(self, n: int, lanes: int, states: np.ndarray, position: np.ndarray, words: np.ndarray) -> np.ndarray:
        per = SEGMENT // lanes
        segments = len(states)
        out = np.zeros((segments, per, lanes), np.uint32)
        x = states.astype(np.uint64).copy()
        at = position.copy()
        mask, shift, up = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
        steps = -(-n // lanes)
        for t in range(min(per, steps)):
            # Segments that still have this step; the last one may be short, and its last step too.
            live = sum(1 for g in range(segments) if g * per + t < steps)
            y = x[:live]
            slot = y & mask
            s = self.symbol[slot]
            new = self.freq[s] * (y >> shift) + slot - self.start[s]
            last = (live - 1) * per + t == steps - 1 and n % lanes
            if last:
                new[-1, n % lanes :] = y[-1, n % lanes :]
            need = new < LOW
            if need.any():
                k = need.sum(1)
                offset = np.cumsum(need, 1) - 1 + at[:live, None]
                new[need] = (new[need] << up) | words[offset[need]]
                at[:live] += k
            x[:live] = new
            out[:live, t] = s
        return out.reshape(-1)[:n]


def encode_ids(docs: DataFrame, tokenizer: str, end_id: int, bounds: list[float]) -> DataFrame:
    """(part, doc_id, ids): the ids of each whole text and end_id, packed; part is the range between bounds that has doc_id."""
    edges = np.array(bounds)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = encoder_of(tokenizer), end_id.to_bytes(4, "little")
        for b in batches:
            at = b.column(0).cast(pa.int64())
            part = np.searchsorted(edges, at.fill_null(-(1 << 63)).to_numpy(zero_copy_only=False), side="left")
            ids = [pack(encoder.encode(t) + end) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), at, pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "part int, doc_id long, ids binary")


def pack(ids: bytes) -> bytes:
    """Ids for a shuffle: two bytes each where all fit, with a mark before them."""
    x = np.frombuffer(ids, "<u4")
    return b"\2" + x.astype("<u2").tobytes() if len(x) and x.max() < 65536 else b"\4" + ids


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, f"<u{packed[0]}", offset=1).astype(np.uint32)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, vocabulary: int) -> None:
    """Encode docs' whole texts and write them at path in ascending doc_id order."""
    spark = docs.sparkSession
    prepare(spark)
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Bounds come from doc_id alone: a range partitioner over encoded rows would encode them twice.
    bounds = docs.select("doc_id").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    placed = encode_ids(docs, tokenizer, end_id, sorted(set(bounds))).repartitionById(parts, F.col("part")).sortWithinPartitions("doc_id", "ids")
    placed = placed.checkpoint()  # the ids in order, for the two passes below
    release(spark)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(vocabulary, np.int64)
        for b in batches:
            ids = [unpack(x) for x in b.column(2).to_pylist()]
            if ids:
                seen += np.bincount(np.concatenate(ids), minlength=vocabulary)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], ["id", "n"])

    # At most one row for each entry of the vocabulary.
    counts = np.zeros(vocabulary, np.int64)
    for r in placed.mapInArrow(count, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    table = Table.of(counts)
    spark.createDataFrame([(bytearray(table.freq.astype("<u4").tobytes()),)], "freq binary").coalesce(1).write.parquet(f"{path}/table")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before, held, size = Coder(table), 0, [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([coder.encode(held)], pa.binary())], ["part", "before", "n_ids", "block"])

        for b in batches:
            for d, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                x = unpack(x)
                if held and size + len(x) > BLOCK:
                    yield row()
                    before, held, size = before + size, [], 0
                held.append((d, x))
                size += len(x)
        if held:
            yield row()

    placed.mapInArrow(blocks, "part int, before long, n_ids long, block binary").write.option("compression", "none").parquet(f"{path}/blocks")
    on_exit(spark, path)
    release(spark)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files at path."""
    freq = np.frombuffer(bytes(spark.read.parquet(f"{path}/table").first()["freq"]), "<u4")
    table = Table(freq)
    stored = spark.read.schema("part int, before long, n_ids long, block binary").parquet(f"{path}/blocks")
    # One row for each range of doc_id: how many ids lie before it.
    base, total = {}, 0
    for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[r["part"]] = total
        total += r["n"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(table)
        for b in batches:
            for part, before, block in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = base[part] + before
                rows = []
                for d, ids in coder.decode(block):
                    rows.append((d, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.select("part", "before", "block").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
