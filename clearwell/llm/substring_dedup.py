"""Substring dedup by content-defined chunks.

Whole texts are cut into variable chunks by a gear rolling hash, so equal
passages are cut alike wherever they stand.  Chunks are grouped by digest; a
chunk that a document with a smaller doc_id also has is a repeat.  The cuts
inside a repeated passage agree from some bytes after its start to the last cut
before its end, so a run of ANCHOR repeats or more is taken as an anchor only:
the first document that has the run's first chunk is asked for the CONTEXT bytes
before it, the one that has the last chunk for those behind it, and the run is
extended as far as the bytes are equal.  Runs that then have MIN_WORDS words or
more are removed, at word boundaries, from every document but the first; shorter
ones are chance or common phrases and stay.

Edge cases: null and empty texts have no chunk and stay as they are; a text
that repeats another one whole becomes empty; texts of any length are cut whole;
equal doc_ids count as one document, so copies under the same id stay, while
rows are judged and returned one by one; rows without doc_id cannot be told
apart and so count as one document, the first; a passage that a document repeats
within itself stays; other columns are kept: dedup() replaces those that clash
with the result's, cut_texts() none; an empty table gives an empty result.
Digests have 64 bits: a removal needs a run of equal ones, so single collisions
remove nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, lean, prepare, written
from .gear import Chunker

CHUNKER = Chunker(bits=4, least=12, most=128, window=16)
MIN_WORDS = 40
#: Chunks of a run that is worth extending, and bytes by which it can grow on either side.
ANCHOR, CONTEXT = 2, 512
#: Chunks whose surroundings are asked for: up to this number they are sent to every task; more are joined by shuffle.
BROADCAST_WANTED = 1_000_000
_ID = -(1 << 63)
_RUN = "start int, end int, left_first long, left long, right_first long, right long"


def chunks(docs: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """(doc_id, h, digests): the digests of each text's chunks in order; h is a hash of the text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [[x for x, _, _ in _cut(t, chunker)] for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.list_(pa.int64()))], ["doc_id", "h", "digests"])

    return _keyed(docs).select("doc_id", "h", "text").mapInArrow(lean(run), "doc_id long, h long, digests array<long>")


def _cut(text: str | None, chunker: Chunker) -> Iterator[tuple[int, int, int]]:
    """(digest, start, end) of each chunk."""
    data, last = (text or "").encode(), 0
    for end in chunker.ends(data):
        yield xxhash.xxh3_64_intdigest(data[last:end]) - (1 << 63), last, end
        last = end


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"doc_id": _id(), "h": _hash()})


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_ID))


def _hash():
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def anchors(docs: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """(doc_id, h, start, end, left_first, left, right_first, right): runs of chunks, by number from 0, that earlier documents have; the digests at both ends and who has them first, null at an end of the text."""
    own = written(chunks(docs, chunker), "chunks")
    each = own.select("doc_id", "h", F.size("digests").alias("n"), F.posexplode("digests").alias("place", "digest"))
    shared = each.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    shared = written(shared, "shared")
    found = each.join(shared.hint("merge"), "digest").where("doc_id > first")
    found = found.groupBy("doc_id", "h").agg(F.first("n").alias("n"), F.sort_array(F.collect_set(F.struct("place", "first", "digest"))).alias("places"))

    def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _RUN.split(", ")]
        for b in batches:
            rows = []
            for d, h, n, places in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = 0
                for k, p in enumerate(places):
                    if k + 1 == len(places) or places[k + 1]["place"] != p["place"] + 1:
                        if k + 1 - at >= ANCHOR:
                            # At the ends of the text there is nothing to extend into.
                            left = (places[at]["first"], places[at]["digest"]) if places[at]["place"] else (None, None)
                            right = (p["first"], p["digest"]) if p["place"] + 1 < n else (None, None)
                            rows.append((d, h, places[at]["place"], p["place"], *left, *right))
                        at = k + 1
            columns = zip(*rows, strict=True) if rows else ((),) * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "h", *names])

    found = written(found.mapInArrow(runs, f"doc_id long, h long, {_RUN}"), "anchors")
    drop_table(own)
    drop_table(shared)
    return found


def surroundings(docs: DataFrame, wanted: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """(doc_id, digest, before, after): the bytes around the first chunk with that digest in the texts of that id."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for d, t, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data, asked = (t or "").encode(), set(asked)
                for x, start, end in _cut(t, chunker):
                    if x in asked:
                        asked.discard(x)
                        rows.append((d, x, data[max(0, start - CONTEXT) : start], data[end : end + CONTEXT]))
            columns = zip(*rows, strict=True) if rows else ((),) * 4
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "digest", "before", "after"])

    few = wanted.limit(BROADCAST_WANTED + 1).count() <= BROADCAST_WANTED
    by_doc = wanted.groupBy("doc_id").agg(F.collect_set("digest").alias("asked"))
    texts = _keyed(docs).select("doc_id", "text").join(F.broadcast(by_doc) if few else by_doc, "doc_id")
    found = texts.mapInArrow(lean(run), "doc_id long, digest long, before binary, after binary")
    return written(found.groupBy("doc_id", "digest").agg(F.min("before").alias("before"), F.min("after").alias("after")), "surroundings")


def repeats(docs: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """(doc_id, h, runs): for each text with repeats its runs of chunks as (start, end, before, after), with the bytes around them in earlier documents."""
    prepare(docs.sparkSession)
    found = anchors(docs, chunker)
    sides = [found.select(F.col(f"{s}_first").alias("doc_id"), F.col(s).alias("digest")) for s in ("left", "right")]
    wanted = written(sides[0].unionByName(sides[1]).where("digest IS NOT NULL").distinct(), "wanted")
    around = surroundings(docs, wanted, chunker)
    side = lambda s, what: around.select(F.col("doc_id").alias(f"{s}_first"), F.col("digest").alias(s), what)
    known = found.join(side("left", "before"), ["left_first", "left"], "left").join(side("right", "after"), ["right_first", "right"], "left")
    runs = known.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set(F.struct("start", "end", "before", "after"))).alias("runs"))
    runs = written(runs, "repeats")
    for table in (found, wanted, around):
        drop_table(table)
    return runs


_NEW = "n_chunks long, n_repeats long, removed_words long, removed array<struct<start:int,end:int>>"


def _judged(docs: DataFrame, chunker: Chunker, min_words: int) -> DataFrame:
    """(doc, new): the columns of each row of docs but text as a struct, and n_chunks, n_repeats, removed_words, removed and text."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string()]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [remove(t, r or [], chunker, min_words) for t, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc", "n_chunks", "n_repeats", "removed_words", "removed", "text"])

    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*own).alias("doc"), "text", _id().alias("__id"), _hash().alias("__h"))
    found = repeats(docs, chunker).select(F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "runs")
    joined = rows.join(found, ["__id", "__h"], "left").select("doc", "text", "runs")
    return joined.mapInArrow(lean(cut), f"doc {joined.schema['doc'].dataType.simpleString()}, {_NEW}, text string")


def dedup(docs: DataFrame, chunker: Chunker = CHUNKER, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, and n_chunks, n_repeats (runs), removed_words and removed (spans of the old text in code points)."""
    new = [x.split()[0] for x in _NEW.split(", ")]
    kept = [c for c in docs.columns if c not in new]
    out = _judged(docs, chunker, min_words)
    return out.select(*("text" if c == "text" else F.col("doc")[c].alias(c) for c in kept), *new)


def cut_texts(docs: DataFrame, chunker: Chunker = CHUNKER, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text cut, without the rows of which nothing but white space is left; an n_chars column is set anew where text went."""
    out = _judged(docs, chunker, min_words).where("NOT (removed_words > 0 AND trim(regexp_replace(text, '\\\\s+', ' ')) = '')")
    n_chars = F.when(F.col("removed_words") > 0, F.length("text").cast("long"))
    own = lambda c: F.col("doc")[c]
    return out.select(*("text" if c == "text" else F.coalesce(n_chars, own(c)).alias(c) if c == "n_chars" else own(c).alias(c) for c in docs.columns))


def remove(text: str | None, runs: list[dict], chunker: Chunker = CHUNKER, min_words: int = MIN_WORDS) -> tuple:
    """(chunks, runs, words removed, spans in code points, what is left) of one text."""
    if not text:
        return 0, 0, 0, [], text
    data = text.encode()
    ends = chunker.ends(data)
    if not runs:
        return len(ends), 0, 0, [], text
    spans: list[list[int]] = []
    for r in runs:
        a, b = ends[r["start"] - 1] if r["start"] else 0, ends[r["end"]]
        a, b = a - _alike(data[:a][::-1], (r["before"] or b"")[::-1]), b + _alike(data[b : b + CONTEXT], r["after"] or b"")
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(b, spans[-1][1])
        else:
            spans.append([a, b])
    out, removed, words, at, chars = [], [], 0, 0, 0
    for a, b in spans:
        a, b = _to_words(data, a, b)
        n = len(data[a:b].split())
        if n >= min_words:
            before, inside = data[at:a].decode(), data[a:b].decode()
            out.append(before)
            removed.append({"start": chars + len(before), "end": chars + len(before) + len(inside)})
            chars += len(before) + len(inside)
            words, at = words + n, b
    out.append(data[at:].decode())
    return len(ends), len(runs), words, removed, "".join(out)


def _alike(a: bytes, b: bytes) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def _to_words(data: bytes, a: int, b: int) -> tuple[int, int]:
    """The span without the parts of words at its ends."""
    while 0 < a < b and data[a - 1] not in b" \t\n\r":
        a += 1
    while a < b < len(data) and data[b] not in b" \t\n\r":
        b -= 1
    return a, b
