"""N-gram Jaccard join with prefix filters under several global orders.

A document's set are the hashes of its distinct 5-word shingles; documents with
equal sets are one class.  Two sets are linked when their similarity is THRESHOLD
percent or more, that is when they share share(n, m) shingles or more, n and m
being their sizes.

1. Under a first global order, of hashes, any two linked sets share as many as
   need() of the shingles in their prefixes.  Prefixes meet by a shuffle; a class
   whose prefix shares fewer with classes of a fitting size links with nothing.
2. Only for the classes left are whole sets brought together.  A shingle counts
   for a class if another class has it whose size fits and that has itself enough
   of such shingles.  A class with too few links with nothing; this is repeated.
3. Each class is compared with the leader that it meets most often, one of
   another component each time, until rounds hardly link any more.  The original
   of many near copies links most of them, so a group of copies takes as many
   comparisons as it has classes.
4. What is left is joined exactly.  Two classes of different components are
   candidates if they share a prefix shingle under a second order (rare shingles
   first, counted exactly), at places that leave room for enough others, and also
   under a third and a fourth order (levels of rareness, each shuffled by another
   hash).  Only pairs that pass all of them are compared.  At a shingle, the
   classes of the component that is most frequent there are never paired with each other.

All filters are bounds: no link between different texts is lost, whatever the
leaders are.  A shingle's rows meet in one task.  A class has one row there and n
rows in all, so one shingle cannot hold a large part of the rows.

Edge cases: texts without words have an empty set and link with nothing; fewer
words than five are one shingle; very long texts are sets of as many shingles,
held one at a time; null ids take part and count as smaller than any other;
repeated rows are copies; rows that share an id are told apart by their text;
other columns are kept by dedup() and ignored by link(); an empty table gives an
empty result.  Class numbers are 64-bit hashes checked against independent ones;
on a collision the join starts again with another seed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NARROW_ROWS, Memo, batch_rows, drop_table, lean, release, written
from .components import components

WORDS = 5
THRESHOLD = 80
#: A first prefix is longer by this part of the least partner's size, and as many more shingles of it must be shared.
SHARED_PART = 16
#: Rounds of step 2; the first finds the shingles that no other class has.
USEFUL_ROUNDS = 2
#: Leaders are chosen by one in so many shingles, and by all of sets under so many.
LEADER_PART, SMALL = 4, 80
#: Rounds of leaders end when one links less than this part of the classes.
LEADER_GAIN = 100
#: Bound of a worker's memory of words, and of classes a task remembers having sent.
WORD_MEMORY, SENT = 300_000, 200_000
#: Classes and rows up to this number are sent to every task; more are joined by shuffle.
BROADCAST_ROWS = 300_000
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_M = np.uint64(0x9E3779B97F4A7C15)
_ID = -(1 << 63)

def _mix(h: np.ndarray, seed: int) -> np.ndarray:
    h = h ^ np.uint64(seed * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Shingler:
    def __init__(self, words: int = WORDS):
        self.words, self.memory = words, Memo(xxhash.xxh3_64_intdigest, WORD_MEMORY)

    def set_of(self, text: str | None) -> np.ndarray:
        """The sorted hashes of a text's distinct shingles."""
        return np.unique(self.all_of(text))

    def all_of(self, text: str | None) -> np.ndarray:
        """The hashes of a text's shingles in order."""
        words = (text or "").encode().translate(_LOWER).split()  # at x20 and x09-x0D
        n, k = len(words), min(len(words), self.words)
        if not n:
            return np.zeros(0, np.uint64)
        w = np.fromiter(map(self.memory.__getitem__, words), np.uint64, n)
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h = h * _M + w[j : n - k + 1 + j]
        return _mix(h, 1)


def share(n: int, m: int, threshold: int = THRESHOLD) -> int:
    """How many shingles sets of n and m share at least if they are linked."""
    return -(-threshold * (n + m) // (100 + threshold))


def need(n: int, threshold: int = THRESHOLD) -> int:
    """How many shingles of their first prefixes linked sets share at least; n is the smaller one's size."""
    return 1 + threshold * n // (100 * SHARED_PART)


def prefix(shingles: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """The first shingles of a set under the first order, so many that a linked set shares need() of them."""
    n = len(shingles)
    size = n - -(-threshold * n // 100) + need(n, threshold)
    if size >= n:
        return shingles
    return shingles[np.argpartition(_mix(shingles, 2), size - 1)[:size]]


def late_prefixes(n: int, df: np.ndarray, tokens: np.ndarray, threshold: int = THRESHOLD) -> list[np.ndarray]:
    """The first shingles, in order, under the other orders, of what is useful of a set of n."""
    least = share(n, -(-threshold * n // 100), threshold)
    size = max(0, len(tokens) - least + 1)
    level = np.log2(df).astype(np.uint64)
    out = []
    for k, rare in enumerate((np.minimum(df, (1 << 24) - 1).astype(np.uint64), level, level)):
        rank = (rare << np.uint64(40)) | (_mix(tokens, k + 3) >> np.uint64(24))
        out.append(tokens[np.lexsort((tokens, rank))[:size]])
    return out


def _class(shingles: np.ndarray, seed: int) -> tuple[int, int]:
    d = hashlib.blake2b(shingles.tobytes(), digest_size=16, key=b"%d" % seed).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(docs: DataFrame, words: int, threshold: int, seed: int) -> DataFrame:
    """(id, h, n, c, check, pre): a set's size, class, a second hash, and first prefix; pre is null where the task sent the class before."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sent = Shingler(words), set()
        for b in batches:
            rows = []
            for t in b.column(2).to_pylist():
                s = shingler.set_of(t)
                c, check = _class(s, seed)
                pre = None
                if len(s) and c not in sent:
                    if len(sent) < SENT:
                        sent.add(c)
                    pre = _long(prefix(s, threshold))
                rows.append((len(s), c, check, pre))
            n, c, k, p = zip(*rows, strict=True) if rows else ((),) * 4
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(p, pa.list_(pa.int64()))], ["id", "h", "n", "c", "check", "pre"])

    return _keyed(docs).mapInArrow(lean(run), "id long, h long, n long, c long, check long, pre array<long>")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_id().alias("id"), _hash().alias("h"), "text")


def _id():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_ID))


def _hash():
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def _meeting(sets: DataFrame, threshold: int) -> DataFrame:
    """(c): the classes that meet others of fitting sizes at enough of their first prefix."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come by token and size, so a class fits some other one if it fits the one before or after it.
        last = (np.zeros(0, np.int64),) * 3
        fits = np.zeros(0, bool)
        for b in batches:
            t, n, c = (np.concatenate([x, y.to_numpy(zero_copy_only=False)]) for x, y in zip(last, b.columns, strict=True))
            if not len(t):
                continue
            ok = np.zeros(len(t), bool)
            ok[: len(fits)] = fits
            fresh = np.ones(len(t), bool)  # several tasks may have sent a class
            fresh[1:] = (t[1:] != t[:-1]) | (c[1:] != c[:-1])
            t, n, c, ok = t[fresh], n[fresh], c[fresh], ok[fresh]
            near = (t[1:] == t[:-1]) & (100 * n[:-1] >= threshold * n[1:])
            ok[1:] |= near
            ok[:-1] |= near
            last, fits = (t[-1:], n[-1:], c[-1:]), ok[-1:]
            yield pa.RecordBatch.from_arrays([pa.array(x[:-1][ok[:-1]]) for x in (c, n)], ["c", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(x[fits], pa.int64()) for x in (last[2], last[1])], ["c", "n"])

    tokens = sets.where("pre IS NOT NULL").select(F.explode("pre").alias("token"), "n", "c")
    met = tokens.repartition("token").sortWithinPartitions("token", "n", "c").mapInArrow(lean(run), "c long, n long")
    least = f"({threshold} * n + 99) DIV 100"
    return met.groupBy("c", "n").count().where(f"count >= 1 + {threshold} * ({least}) DIV {100 * SHARED_PART}").select("c")


def _whole(docs: DataFrame, classes: DataFrame, words: int, seed: int) -> DataFrame:
    """(c, n, s): the whole sets of classes (c, rep)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(words)
        for b in batches:
            rows = []
            for t, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingler.set_of(t)
                if _class(s, seed)[0] == c:  # else another row with the same id
                    rows.append((c, len(s), _long(s)))
            c, n, s = zip(*rows, strict=True) if rows else ((),) * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.array(s, pa.list_(pa.int64()))], ["c", "n", "s"])

    texts = docs.select(_id().alias("rep"), "text").join(_sent(classes), "rep").select("text", "c")
    sets = written(texts.mapInArrow(lean(run), "c long, n long, s array<long>"), "whole")
    # Rows that repeat an id and a text give a class twice.
    return sets if sets.groupBy("c").count().where("count > 1").isEmpty() else written(sets.dropDuplicates(["c"]), "whole")


def _sent(rows: DataFrame) -> DataFrame:
    """rows, to be sent to every task if they are few."""
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def _useful(sets: DataFrame, threshold: int) -> DataFrame:
    """(c, n, s) of classes that may link: s are (df, token) of the shingles that partners of a fitting size may share; df counts the classes that have one."""
    # With u useful shingles a class can link with sets of up to (1 + 100 / threshold) * u - n.
    most = f"(({100 + threshold} * size(s)) DIV {threshold} - n)"
    group = Window.partitionBy("token")
    sets = sets.withColumn("s", F.expr("transform(s, x -> named_struct('df', 1, 'token', x))"))
    for turn in range(USEFUL_ROUNDS):
        each = sets.select("c", F.col("n").cast("int").alias("n"), F.expr(f"cast({most} AS int)").alias("most"), F.explode("s.token").alias("token"))
        met = each.select("c", "n", "most", "token", F.count("*").over(group).cast("int").alias("df"), F.min("n").over(group).alias("least"), F.max("most").over(group).alias("widest"))
        kept = met.where("df > 1 AND least <= most AND widest >= n").groupBy("c", "n").agg(F.collect_list(F.struct("df", "token")).alias("s"))
        before, sets = sets, written(kept.where(f"100 * {most} >= {threshold} * n"), "useful")
        if turn:
            drop_table(before)
    return sets


def _prefixes(useful: DataFrame, threshold: int) -> DataFrame:
    """(c, n, u, score, s, p0, p1, p2): u is the size of s; score is high where many classes share much of a class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = b.column(2)
            at, inside = s.offsets.to_numpy().tolist(), s.values
            df, token = (inside.field(k).to_numpy(zero_copy_only=False) for k in ("df", "token"))
            rows = []
            for k, n in enumerate(b.column(1).to_pylist()):
                d, t = df[at[k] : at[k + 1]], token[at[k] : at[k + 1]]
                first = late_prefixes(n, d, t.view(np.uint64), threshold)
                rows.append((len(t), float(np.log2(d).sum()) / n, t, _long(first[0]), *((_mix(p, 9) >> np.uint64(33)).astype(np.int32) for p in first[1:])))
            columns = zip(*rows, strict=True) if rows else ((),) * 6
            kinds = [pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(x, k) for x, k in zip(columns, kinds, strict=True))], ["c", "n", "u", "score", "s", "p0", "p1", "p2"])

    return useful.mapInArrow(lean(run), "c long, n int, u long, score double, s array<long>, p0 array<long>, p1 array<int>, p2 array<int>")


def _fit(a: str, b: str, threshold: int) -> str:
    """SQL: sets of sizes a and b can be linked."""
    return f"100 * least({a}, {b}) >= {threshold} * greatest({a}, {b})"


def _room(a: str, threshold: int) -> str:
    """SQL: the places in the prefix of class a at which the first shared shingle of a linked pair (a, b) can stand."""
    return f"(u{a} - ({threshold} * (na + nb) + {99 + threshold}) DIV {100 + threshold} + 1)"


def _named(rows: DataFrame, roots: DataFrame | None) -> DataFrame:
    """rows with the root of each class."""
    if roots is None:
        return rows.withColumn("root", F.col("c"))
    return rows.join(roots.withColumnRenamed("node", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))


def _to_leaders(sets: DataFrame, roots: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs (a, b): each class and the leader of another component that it meets most often; a shingle is led by the class of the highest score."""
    chosen = f"filter(s, x -> n < {SMALL} OR pmod(x, {LEADER_PART}) = 0)"
    rows = _named(sets.select("c", "n", "score", F.expr(chosen).alias("s")), roots).select("c", "n", "score", "root", F.explode("s").alias("token"))
    rows = written(rows, "leading")
    best = F.max(F.struct("score", "c", "n", "root")).alias("l")
    first = rows.groupBy("token").agg(best)
    met = rows.join(first, "token")
    second = met.where("root <> l.root").groupBy("token").agg(F.max(F.struct("score", "c", "n", "root")).alias("m"))
    led = met.join(second, "token", "left").withColumn("l", F.expr("CASE WHEN root <> l.root THEN l ELSE m END")).where(f"l IS NOT NULL AND {_fit('n', 'l.n', threshold)}")
    counts = led.groupBy("c", F.col("l.c").alias("leader")).count()
    chosen = counts.groupBy("c").agg(F.max(F.struct("count", "leader"))["leader"].alias("leader"))
    pairs = written(chosen.select(F.least("c", "leader").alias("a"), F.greatest("c", "leader").alias("b")).distinct(), "pairs")
    drop_table(rows)
    return pairs


def _left_over(sets: DataFrame, roots: DataFrame | None, threshold: int) -> DataFrame:
    """Pairs (a, b) of classes of different components that no order rules out."""
    rows = _named(sets.select("c", "n", "u", "p0"), roots).select("c", "n", "u", "root", F.posexplode("p0").alias("pos", "token"))
    frequent = rows.groupBy("token", "root").agg(F.count("*").alias("k")).groupBy("token").agg(F.max(F.struct("k", "root"))["root"].alias("top"), F.count("*").alias("roots"))
    rows = written(rows.join(frequent.where("roots > 1"), "token"), "open")
    side = lambda part, x: part.select("token", *(F.col(k).alias(f"{k}{x}") for k in ("c", "n", "u", "root", "pos")))
    others, tops = rows.where("root <> top"), rows.where("root = top")
    possible = f"{_fit('na', 'nb', threshold)} AND posa < {_room('a', threshold)} AND posb < {_room('b', threshold)}"
    among = side(others, "a").join(side(others, "b"), "token").where(f"ca < cb AND roota <> rootb AND {possible}")
    across = side(others, "a").join(side(tops, "b"), "token").where(possible)
    pairs = [p.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")) for p in (among, across)]
    met = written(pairs[0].unionByName(pairs[1]).distinct(), "met")
    drop_table(rows)
    left, right = (sets.select(*(F.col(k).alias(f"{k}{x}") for k in ("c", "n", "u", "p1", "p2"))) for x in "ab")
    both = met.join(left, F.col("a") == F.col("ca")).join(right, F.col("b") == F.col("cb"))
    under = [f"arrays_overlap(slice({p}a, 1, greatest({_room('a', threshold)}, 0)), slice({p}b, 1, greatest({_room('b', threshold)}, 0)))" for p in ("p1", "p2")]
    return written(both.where(" AND ".join(under)).select("a", "b"), "pairs")


def _linked(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Of pairs (a, b) of classes, those that are linked.  What two linked sets share is useful to both, so it is counted whole."""
    left, right = (sets.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("s").alias(f"s{x}")) for x in "ab")
    met = pairs.join(left, "a").join(right, "b").withColumn("both", F.size(F.array_intersect("sa", "sb")))
    return written(met.where(f"100 * both >= {threshold} * (na + nb - both)").select("a", "b"), "links")


def _judged(docs: DataFrame, words: int, threshold: int) -> DataFrame:
    """(id, h, n, first) of each row of docs, as a table: first is the smallest id that links reach."""
    spark = docs.sparkSession
    for seed in range(100):
        with batch_rows(spark):
            sets = written(_sets(docs, words, threshold, seed), "shingles")
        groups = sets.where("n > 0").groupBy("c").agg(F.min("id").alias("rep"), F.min("check").alias("x"), F.max("check").alias("y"))
        classes = written(groups, "classes")
        if classes.where("x <> y").isEmpty():
            break
    classes = classes.select("c", "rep")
    with batch_rows(spark, NARROW_ROWS):
        meeting = written(_meeting(sets, threshold).join(classes, "c"), "meeting")
    with batch_rows(spark):
        whole = _whole(docs, meeting, words, seed)
        useful = _useful(whole, threshold)
        sets_left = written(_prefixes(useful, threshold), "prefixes")
    drop_table(whole)
    drop_table(useful)

    n, links, tried, roots = sets_left.count(), None, None, None
    while True:
        pairs = _to_leaders(sets_left, roots, threshold)
        found = _linked(pairs, sets_left, threshold)
        k = found.count()
        if k:
            links = found if links is None else written(links.unionByName(found), "links")
            roots = components(links)
        if k * LEADER_GAIN <= n:
            break
    more = _linked(_left_over(sets_left, roots, threshold), sets_left, threshold)
    if not more.isEmpty():
        roots = components(more if links is None else links.unionByName(more))

    found = classes.withColumn("root", F.col("c")) if roots is None else _named(classes, roots)
    found = written(found, "least")
    first = found.groupBy("root").agg(F.min("rep").alias("first"))
    found = written(found.join(first, "root").select("c", "first"), "components")
    release(spark)
    out = sets.select("id", "h", "n", F.when(F.col("n") > 0, F.col("c")).alias("c")).join(found, "c", "left")
    return out.select("id", "h", "n", F.coalesce("first", "id").alias("first"))


def link(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs; component_id is the smallest doc_id that links reach."""
    known = lambda k: F.when(F.col(k) != _ID, F.col(k))
    return _judged(docs, words, threshold).select(known("id").alias("doc_id"), F.col("n").alias("n_shingles"), known("first").alias("component_id"))


def dedup(docs: DataFrame, words: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """docs with one row of each group, one with the smallest doc_id; every row without words stays."""
    judged = written(_judged(docs, words, threshold).where("n > 0"), "judged")
    first = judged.where("id = first")
    keepers = first.groupBy("first").agg(F.min("h").alias("keep"), F.max("h").alias("most")).where("keep <> most")  # few: rows that share the kept id
    gone = judged.where("id <> first").select("id", "h").unionByName(first.join(keepers, "first").where("h <> keep").select("id", "h"))
    gone = written(gone.distinct(), "copies")
    key = (F.col("id") == _id()) & (F.col("h") == _hash())
    kept = docs.join(_sent(gone), key, "left_anti")
    again = written(judged.where("id = first").groupBy("id", "h").count().where("count > 1").select("id", "h"), "again")
    if again.isEmpty():
        return kept
    # Rows that repeat an id and a text: one of them stays.
    names = [f"c{k}" for k in range(len(docs.columns))]
    repeated = kept.join(_sent(again), key, "left_semi")
    one = repeated.withColumns({"__id": _id(), "__h": _hash()}).toDF(*names, "__id", "__h").dropDuplicates(["__id", "__h"]).select(names).toDF(*docs.columns)
    return kept.join(_sent(again), key, "left_anti").unionByName(one)
