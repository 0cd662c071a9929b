"""Relational forms: spans as rows, stores, scopes, joins that the scalar functions imply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def merge_spans(spans: DataFrame, key: str, over: str = "hidden", abutting: bool = False) -> DataFrame:
    """(key, start, end, kind) with overlapping spans as one, by gaps and islands; abutting ones too if told."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    apart = (F.col("start") > reach) if abutting else (F.col("start") >= reach)
    islands = spans.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0)).withColumn("__island", F.sum("__new").over(order))
    kind = F.when(F.max(F.col("kind") == over), F.lit(over)).otherwise(F.min("kind"))
    return islands.groupBy(key, "__island").agg(F.min("start").alias("start"), F.max("end").alias("end"), kind.alias("kind")).drop("__island")


def outermost(spans: DataFrame, key: str) -> DataFrame:
    """Spans that lie in no other span of their key."""
    order = Window.partitionBy(key).orderBy(F.col("start"), F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return spans.withColumn("__reach", reach).where("__reach IS NULL OR end > __reach").drop("__reach")


def as_of(left: DataFrame, right: DataFrame, key: str, at: str = "at", value: str = "end") -> DataFrame:
    """left with right's shift of the greatest ``value`` not after ``at``: one sort of both, no range join."""
    both = left.select(key, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__row"), F.lit(None).cast("long").alias("shift")).unionByName(
        right.select(key, F.col(value).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("__row"), F.col("shift").cast("long").alias("shift"))
    )
    order = Window.partitionBy(key).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shift", F.last("shift", ignorenulls=True).over(order)).where("__side = 1").select("__row.*", F.coalesce("shift", F.lit(0)).alias("shift"))


def span_store(pairs: DataFrame) -> DataFrame:
    """(key, original): write-once store of what placeholders stand for."""
    keyed = pairs.select(F.regexp_extract("placeholder", r"#([0-9a-f]{12})\]", 1).alias("key"), "original").where("key <> ''")
    return keyed.groupBy("key").agg(F.min("original").alias("original"))


def restore_from_store(texts: DataFrame, store: DataFrame, key: str, text: str = "text") -> DataFrame:
    """texts with restored, or null and denied = true where a placeholder's key is not in the store.

    What a text becomes depends on the text alone, so each distinct one is
    restored once and joined back by its hash: every row stays, whatever its
    ``key`` is.  Keys are exploded, found by join and folded back in order.
    """
    pattern = r"(\[(?:HTML comment|hidden HTML) removed #[0-9a-f]{12}\])"
    marks = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))
    named = texts.withColumn("__id", F.sha2(F.coalesce(text, F.lit("")), 256))
    rows = named.where(F.col(text).rlike(pattern)).dropDuplicates(["__id"]).select("__id", F.posexplode(marks).alias("n", "mark"))
    found = rows.withColumn("key", F.regexp_extract("mark", r"#([0-9a-f]{12})\]", 1)).join(store, "key", "left")
    folded = found.groupBy("__id").agg(F.bool_and(F.col("original").isNotNull()).alias("__ok"), F.sort_array(F.collect_list(F.struct("n", "original"))).alias("__o"))
    out = named.join(folded, "__id", "left").withColumn("__p", F.split(F.col(text), pattern)).withColumn("__ok", F.coalesce("__ok", F.lit(True)))
    whole = F.expr("aggregate(sequence(1, size(__p)), '', (s, i) -> concat(s, __p[i - 1], CASE WHEN i <= size(__o) THEN __o[i - 1].original ELSE '' END))")
    restored = F.when(F.col("__o").isNull(), F.col(text)).when(F.col("__ok"), whole)
    return out.withColumn("restored", restored).withColumn("denied", ~F.col("__ok")).drop("__id", "__ok", "__o", "__p")


def scope_fields(calls: DataFrame, scopes: DataFrame) -> DataFrame:
    """calls (tool, field) with kind: covered or exempt by exact name, else by the longest prefix, else undeclared.

    Each distinct call is looked up by equi-joins, of the name and of its
    beginnings of the lengths that scopes have; every row of calls stays one row.
    """
    prefix = F.col("tool").endswith("*")
    rules = scopes.select(F.when(prefix, F.expr("substring(tool, 1, length(tool) - 1)")).otherwise(F.col("tool")).alias("__name"), F.col("field").alias("__field"), "kind", (~prefix).alias("__exact"))
    rules = rules.groupBy("__name", "__field", "__exact").agg(F.min("kind").alias("__kind"))
    lengths = [r[0] for r in rules.where("NOT __exact").select(F.length("__name")).distinct().collect()]  # as many as prefixes have
    asked = calls.select("tool", "field").distinct()
    names = F.array(F.struct(F.col("tool").alias("__name"), F.lit(True).alias("__exact")), *(F.struct(F.expr(f"substring(tool, 1, {int(n)})").alias("__name"), F.lit(False).alias("__exact")) for n in lengths))
    tried = asked.select("tool", "field", F.explode(F.array_distinct(names)).alias("t")).select("tool", "field", "t.*", F.col("field").alias("__field"))
    best = tried.join(rules, ["__name", "__field", "__exact"]).groupBy("tool", "field").agg(F.max(F.struct("__exact", F.length("__name").alias("n"), "__kind"))["__kind"].alias("__kind"))
    best = best.select(F.col("tool").alias("__tool"), F.col("field").alias("__f"), "__kind")
    out = calls.join(best, (F.col("tool") == F.col("__tool")) & (F.col("field") == F.col("__f")), "left")
    return out.withColumn("kind", F.coalesce("__kind", F.lit("undeclared"))).drop("__tool", "__f", "__kind")


def exposed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Values that after has and before had not."""
    return after.select(key, value).distinct().join(before.select(key, value).distinct(), [key, value], "left_anti")


def scan_account(targets: DataFrame, scanned: DataFrame, skipped: DataFrame) -> DataFrame:
    """(status, n) of targets: scanned, skipped, absent."""
    out = targets.select("path").distinct().join(scanned.select("path", F.lit("scanned").alias("a")).distinct(), "path", "left").join(skipped.select("path", F.lit("skipped").alias("b")).distinct(), "path", "left")
    return out.groupBy(F.coalesce("a", "b", F.lit("absent")).alias("status")).agg(F.count("*").alias("n"))


def findings_cube(findings: DataFrame, *by: str) -> DataFrame:
    """Roll-up of findings over every set of columns, with the number of documents, counted exactly."""
    return findings.cube(*by).agg(F.count("*").alias("n_findings"), F.countDistinct("doc_id").alias("n_docs"))
