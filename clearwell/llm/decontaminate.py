"""Benchmark decontamination with DataFrame and SQL functions only.

Items are normalised into windows of WINDOW words (a shorter item is one
window).  Documents are scanned in place, without a shuffle: the hash of the
two words at a place is looked up in a hash set of the items' window starts;
only where it is there are the window's own hash and then its very text looked
up.  So a hit is always verified by equal words.

The sets travel as literals of the plan.  They hold the benchmark, not the
corpus, and their size is checked: beyond LITERAL_WINDOWS windows or LITERAL_BYTES
the documents' windows are joined with the items' windows by shuffle instead, by
the same rules and with the same result (see scan_by_join()).

Edge cases: null and empty texts, and texts without words, have no words, no
hits and are clean; items without words are ignored; items that share a window
all count; repeated documents are judged row by row; very long texts are scanned
whole; other columns are kept by scan(), where the result replaces those of its own names, and clean() returns
docs' own columns as they are; an empty benchmark leaves
all documents clean, an empty table of documents gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

WINDOW = 13
#: Windows whose hashes and texts a plan may hold as literals, and bytes of these texts.
LITERAL_WINDOWS, LITERAL_BYTES = 60_000, 16_000_000
#: Bytes below U+0080 that are neither a digit nor a letter, after lower-casing A-Z.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str = "text"):
    """Column: the words of a text; an empty array for null."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    return F.filter(F.split(low, NOT_WORD), lambda w: w != "")


def item_windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, k, gram): the distinct windows of each item, k words long, joined by blanks."""
    w = items.select("item_id", words().alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(size))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
    return w.select("item_id", k.alias("k"), F.explode(F.array_distinct(grams)).alias("gram"))


def scan(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = LITERAL_WINDOWS) -> DataFrame:
    """docs with n_words, hit_spans (1-based word positions, last included, disjoint), n_hit, items (ids, sorted) and contaminated."""
    grams = item_windows(items, size).groupBy("k", "gram").agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    many = grams.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("gram")), F.lit(0)).alias("bytes")).first()
    if many["n"] > limit or many["bytes"] > LITERAL_BYTES:
        return _verdict(scan_by_join(docs, grams))
    return _verdict(scan_by_literals(docs, grams.collect()))


def scan_by_literals(docs: DataFrame, grams: list) -> DataFrame:
    spark = docs.sparkSession
    out = docs.withColumn("__w", words())
    if not grams:
        none = F.array().cast("array<struct<p:int,k:int,ids:array<string>>>")
        return out.withColumn("n_words", F.size("__w")).withColumn("__hits", none).drop("__w")
    # Hashes by Spark itself, so that both sides agree.
    lead = min(2, min(r["k"] for r in grams))
    rows = spark.createDataFrame([(r["k"], r["gram"], list(r["ids"])) for r in grams], "k int, gram string, ids array<string>")
    rows = rows.withColumn("g", F.split("gram", " "))
    rows = rows.select("k", "gram", "ids", F.expr(f"xxhash64({_at('g', 1, lead)})").alias("a"), F.xxhash64("g").alias("h")).collect()
    number = {g: n for n, g in enumerate(sorted({r["gram"] for r in rows}), 1)}
    by_gram = {r["gram"]: r["ids"] for r in rows}
    starts = ",".join(f"{h}L" for h in sorted({r["a"] for r in rows}))
    tests = []
    for k in sorted({r["k"] for r in rows}):
        own = [r for r in rows if r["k"] == k]
        hashes = ",".join(f"{h}L" for h in sorted({r["h"] for r in own}))
        texts = ",".join(_text(r["gram"]) for r in own)
        tests.append(f"transform(filter(__at, i -> i + {k - 1} <= size(__w) AND xxhash64(slice(__w, i, {k})) IN ({hashes}) AND array_join(slice(__w, i, {k}), ' ') IN ({texts})), i -> named_struct('p', i, 'k', {k}))")
    out = out.withColumn("n_words", F.size("__w"))
    out = out.withColumn("__at", F.expr(f"CASE WHEN size(__w) >= {lead} THEN filter(sequence(1, size(__w) - {lead - 1}), i -> xxhash64({_at('__w', 'i', lead)}) IN ({starts})) ELSE array() END"))
    out = out.withColumn("__found", F.expr(f"concat({', '.join(tests)})" if len(tests) > 1 else tests[0]))
    texts = ",".join(_text(g) for g in number)
    ids = ",".join("array(" + ",".join(_text(i) for i in by_gram[g]) + ")" for g in number)
    look = f"element_at(map_from_arrays(array({texts}), array({ids})), array_join(slice(__w, h.p, h.k), ' '))"
    out = out.withColumn("__hits", F.expr(f"transform(__found, h -> named_struct('p', h.p, 'k', h.k, 'ids', {look}))"))
    return out.drop("__w", "__at", "__found")


def scan_by_join(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for benchmarks of any size: windows meet by a shuffle join on their hash, then on their text."""
    lengths = sorted(r["k"] for r in grams.select("k").distinct().collect())  # at most WINDOW values
    out = docs.withColumn("__w", words()).withColumn("n_words", F.size("__w")).withColumn("__row", F.struct(F.monotonically_increasing_id()))
    out = written(out, "numbered")  # row numbers stay the same when a task runs again

    def of_length(k: int):
        grams = F.transform(F.sequence(F.lit(1), F.size("__w") - k + 1), lambda i: F.struct(i.alias("p"), F.lit(k).alias("k"), F.array_join(F.slice("__w", i, F.lit(k)), " ").alias("gram")))
        return F.when(F.size("__w") >= k, grams).otherwise(F.array())

    each = [of_length(k) for k in lengths]
    windows = out.select("__row", F.explode(F.concat(*each)).alias("s")).select("__row", "s.*")
    hits = windows.join(grams, ["k", "gram"]).groupBy("__row").agg(F.collect_list(F.struct("p", "k", "ids")).alias("__hits"))
    return out.drop("__w").join(hits, "__row", "left").withColumn("__hits", F.coalesce("__hits", F.array())).drop("__row")


def _at(array: str, place, lead: int) -> str:
    return ", ".join(f"{array}[{place} - 1 + {j}]" for j in range(lead))


def _text(value: str) -> str:
    # Words hold no quote and no backslash; ids may.
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _verdict(scanned: DataFrame) -> DataFrame:
    spans = """aggregate(array_sort(transform(__hits, h -> named_struct('a', h.p, 'b', h.p + h.k - 1))),
        cast(array() AS array<struct<a:int,b:int>>),
        (s, h) -> CASE WHEN size(s) > 0 AND h.a <= element_at(s, -1).b + 1
                       THEN concat(slice(s, 1, size(s) - 1), array(named_struct('a', element_at(s, -1).a, 'b', greatest(element_at(s, -1).b, h.b))))
                       ELSE concat(s, array(h)) END)"""
    out = scanned.withColumn("hit_spans", F.expr(f"CASE WHEN size(__hits) = 0 THEN cast(array() AS array<struct<a:int,b:int>>) ELSE {spans} END"))
    out = out.withColumn("n_words", F.col("n_words").cast("long"))
    out = out.withColumn("n_hit", F.expr("aggregate(hit_spans, 0L, (n, s) -> n + s.b - s.a + 1)"))
    out = out.withColumn("items", F.array_sort(F.array_distinct(F.flatten(F.transform("__hits", lambda h: h["ids"])))))
    return out.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")).drop("__hits")


def clean(docs: DataFrame, items: DataFrame, size: int = WINDOW, limit: int = LITERAL_WINDOWS) -> DataFrame:
    """The rows of docs of which the items' windows cover less than a twentieth."""
    # The row number in the condition keeps the optimizer from copying the whole scan into the filter.
    whole = docs.select(F.struct(*docs.columns).alias("__doc"), "text")
    judged = scan(whole, items, size, limit).withColumn("__row", F.monotonically_increasing_id())
    return judged.where("NOT contaminated AND __row >= 0").select("__doc.*")


def report(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")
