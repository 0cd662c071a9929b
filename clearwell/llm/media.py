"""Media columns: content-defined chunks of payloads, stored once, and read back verified.

A payload is cut by a gear rolling hash.  Chunks are told apart by SHA-256, and a
payload is its recipe, the ordered list of its chunks' digests.  Equal payloads
share a recipe.  Spark joins on digests find the chunks that several recipes
have; the least of these owns such a chunk and stores it, as a zstandard frame,
and the others only name it.  The store has a pack for each recipe: the list, the
frames it owns, which digests it lacks (foreign) and which others need (lent).

Reading puts each payload together again in the order of its list.  A pack that
lacks nothing is read where it lies; only lent frames and packs that lack some
are brought together, by joins on digest and recipe.  Each chunk is checked
against its digest, and the features come from the bytes read.  The stored form
of a payload is its frames in order (8-bit samples before compression, mono).

Hot payloads and chunks: recipes are grouped before their chunks are counted, and
digests are counted by partial aggregation.  What a document must know to store
its pack goes to all tasks if that is little (its number is checked), else it is
joined by shuffle; the result is the same.

Edge cases: null and empty texts give a payload of padding alone; texts of any
length are stored whole; equal texts give equal values; repeated rows and ids
stay repeated; a chunk that a payload repeats is stored once; other columns are
ignored, whatever their names; an empty table gives an empty store and an empty
result.  A damaged or missing chunk raises an error.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, prepare, written
from .gear import Chunker

CHUNKER = Chunker(bits=11, least=512, most=16_384)
LEVEL = 9
ALIGN = 64
#: Rows that all tasks may know, of documents that do not store all of their chunks.
BROADCAST_ROWS = 300_000
_ID = -(1 << 63)
FIELDS = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
PACK = "recipe binary, digests array<binary>, frames array<binary>, missing array<binary>, lent array<binary>"


def pad(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of ALIGN."""
    return data + bytes(-len(data) % ALIGN or (0 if data else ALIGN))


def _cut(text: str | None, chunker: Chunker) -> tuple[list[bytes], list[bytes], bytes]:
    """Chunks of a text's payload, their digests, and the recipe's name."""
    payload = pad((text or "").encode())
    ends = chunker.ends(payload)
    parts = [payload[a:b] for a, b in zip([0, *ends], ends)]
    digests = [hashlib.sha256(p).digest() for p in parts]
    return parts, digests, _recipe(digests)


def _recipe(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(digests)).digest()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumns({"id": F.coalesce("doc_id", F.lit(_ID)), "h": F.coalesce(F.xxhash64("text"), F.lit(0))})


def listed(docs: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """(doc_id, id, h, n_bytes, recipe, digests) of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            cut = [_cut(t, chunker) for t in texts]
            sizes = pa.array([len((t or "").encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], sizes, pa.array([x[2] for x in cut], pa.binary()), pa.array([x[1] for x in cut], pa.list_(pa.binary()))], ["doc_id", "id", "h", "n_bytes", "recipe", "digests"])

    return _keyed(docs).select("doc_id", "id", "h", "text").mapInArrow(lean(run), "doc_id long, id long, h long, n_bytes long, recipe binary, digests array<binary>")


def owners(lists: DataFrame) -> DataFrame:
    """(id, h, recipe, copy, missing, lent): the documents that store nothing, and those with chunks that other recipes have too."""
    named = lists.groupBy("recipe").agg(F.min(F.struct("id", "h")).alias("k"), F.first("digests").alias("digests"), F.count("*").alias("n"))
    named = written(named, "recipes")
    # Rows that repeat an id and a text all store the pack; readers take one.
    copies = lists.select("recipe", "id", "h").join(_sent(named.where("n > 1").select("recipe", "k")), "recipe").where("id <> k.id OR h <> k.h")
    copies = copies.select("id", "h", "recipe").distinct().select("*", F.lit(True).alias("copy"), F.array().cast("array<binary>").alias("missing"), F.array().cast("array<binary>").alias("lent"))
    each = named.select("recipe", "k", F.explode(F.array_distinct("digests")).alias("digest"))
    shared = each.groupBy("digest").agg(F.min(F.struct("k", "recipe"))["recipe"].alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = each.join(shared, "digest")
    parted = met.groupBy("recipe", "k").agg(*(F.collect_set(F.when(test, F.col("digest"))).alias(name) for name, test in (("missing", F.col("recipe") != F.col("owner")), ("lent", F.col("recipe") == F.col("owner")))))
    return written(copies.unionByName(parted.select("k.id", "k.h", "recipe", F.lit(False).alias("copy"), "missing", "lent")), "owners")


def _sent(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be sent to every task if they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def packs(docs: DataFrame, known: DataFrame, chunker: Chunker = CHUNKER) -> DataFrame:
    """PACK of each recipe, from the document that stores it; known is owners()."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = zstandard.ZstdCompressor(level=LEVEL)
        kinds = [pa.binary(), *[pa.list_(pa.binary())] * 4]
        for b in batches:
            rows = []
            for text, recipe, copy, missing, lent in zip(*(c.to_pylist() for c in b.columns), strict=True):
                parts, digests, own = _cut(text, chunker)
                if recipe is None or recipe != own:  # nothing is known of it: it stores all its chunks
                    copy, missing, lent = False, [], []
                if not copy:
                    stored = dict(zip(digests, parts))
                    for x in missing:
                        del stored[x]
                    rows.append((own, digests, [codec.compress(p) for p in stored.values()], missing, lent))
            columns = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [f.split()[0] for f in PACK.split(", ")])

    rows = _keyed(docs).join(known, ["id", "h"], "left")
    return rows.select("text", "recipe", "copy", "missing", "lent").mapInArrow(lean(run), PACK)


def store(docs: DataFrame, chunker: Chunker = CHUNKER, most_sent: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(documents, packs) as tables: (doc_id, n_bytes, recipe) and PACK."""
    prepare(docs.sparkSession)
    lists = written(listed(docs, chunker), "media-lists")
    known = _sent(owners(lists), most_sent)
    return lists.select("doc_id", "n_bytes", "recipe"), written(packs(docs, known, chunker), "media-packs")


def read(documents: DataFrame, stored: DataFrame) -> DataFrame:
    """documents with FIELDS of their payloads, from the stored packs."""
    whole = stored.where("size(missing) = 0").select("recipe", "digests", "missing", "frames", F.lit(None).cast("array<struct<digest:binary,frame:binary>>").alias("others"))
    parted = stored.where("size(missing) > 0").dropDuplicates(["recipe"])
    lent = stored.where("size(lent) > 0").mapInArrow(_lent, "digest binary, frame binary").dropDuplicates(["digest"])
    needed = parted.select("recipe", F.explode("missing").alias("digest")).join(lent, "digest")
    others = needed.groupBy("recipe").agg(F.collect_list(F.struct("digest", "frame")).alias("others"))
    joined = parted.join(others, "recipe", "left").select(whole.columns)
    found = written(whole.mapInArrow(_read, _schema()).unionByName(joined.mapInArrow(_read, _schema())).dropDuplicates(["recipe"]), "features")
    out = documents.join(found, "recipe", "left")
    absent = F.raise_error(F.concat(F.lit("recipe "), F.hex("recipe"), F.lit(" is not in the store")))
    return out.withColumn("payload_sha256", F.when(F.col("payload_sha256").isNull(), absent).otherwise(F.col("payload_sha256"))).drop("recipe")


def _own(digests: list[bytes], missing: list[bytes]) -> list[bytes]:
    """The digests of a pack's frames."""
    lacks = set(missing)
    return [x for x in dict.fromkeys(digests) if x not in lacks]


def _lent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for _, digests, frames, missing, lent in zip(*(c.to_pylist() for c in b.columns), strict=True):
            asked = set(lent)
            rows += [(x, f) for x, f in zip(_own(digests, missing), frames) if x in asked]
        x, f = zip(*rows, strict=True) if rows else ((),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), pa.array(f, pa.binary())], ["digest", "frame"])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Payloads from their packs; holds one at a time."""
    codec = zstandard.ZstdDecompressor()
    for b in batches:
        rows = []
        for recipe, digests, missing, frames, others in zip(*b.columns, strict=True):
            recipe, digests = recipe.as_py(), digests.as_py()
            if _recipe(digests) != recipe:
                raise ValueError(f"recipe {recipe.hex()} is damaged")
            known = dict(zip(_own(digests, missing.as_py()), frames.as_py()))
            known |= {o["digest"]: o["frame"] for o in others.as_py() or ()}
            listed = [known.get(x) for x in digests]
            rows.append((recipe, *features([_open(codec, x, f) for x, f in zip(digests, listed)], listed)))
        yield _batch(rows)


def _schema() -> str:
    return ", ".join(["recipe binary", *(f"{n} {t}" for n, t in FIELDS)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), *(pa.int64() if t == "long" else pa.string() for _, t in FIELDS)]
    columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["recipe", *(n for n, _ in FIELDS)])


def _open(codec: zstandard.ZstdDecompressor, digest: bytes, frame: bytes | None) -> bytes:
    if frame is None:
        raise ValueError(f"chunk {digest.hex()} is not in the store")
    data = codec.decompress(frame)
    if hashlib.sha256(data).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return data


def features(parts: list[bytes], frames: list[bytes]) -> tuple:
    payload, media = b"".join(parts), b"".join(frames)
    samples = np.frombuffer(payload, np.uint8)
    above = samples >= 128
    count = np.bincount(samples >> 4, minlength=16)
    feature = f"n={len(samples)};sum={int(samples.sum(dtype=np.int64))};peak={int(samples.max(initial=0))};crossings={int(np.count_nonzero(above[1:] != above[:-1]))};bins={','.join(map(str, count.tolist()))}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature
