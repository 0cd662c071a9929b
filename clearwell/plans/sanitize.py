"""The whole pipeline over a column of text, over nested values, and as a long table of findings."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ansi, messages
from ..functions.characters import ANSI, COMMENTS, CONFUSABLE, EXFIL, HIDDEN, LABELS, LAYER, LONG_RUN
from ..functions.spans import unsplice_column
from ..operators import layer1, markup, redact, texts, toolcalls

DEPTH = 200


def sanitize(df: DataFrame, text: str = "text", html: bool = True, urls: bool = True, secrets: bool = False, local: Column | bool = True, injection: str | None = None, seconds: float | None = None) -> DataFrame:
    """df with cleaned, found (codes in order of layers), modified, and l1, l2, l3, l4 as asked for.

    Layer 3 reads the text before Layer 2 takes anything out, so that URLs in
    hidden parts are reported.  With html, reveal is the text before Layer 2 and
    splices are its pairs; both are null where nothing was taken out, and with
    secrets they are vetted too: what cannot be is withheld.  A row whose
    redaction fails, or takes longer than ``seconds``, has a null cleaned.
    injection names a column of (remove, code) by a filter of the caller's: its
    spans are deleted where they stand verbatim, nothing can be put in, its code
    must be one of messages.FILTER, and what is left is redacted again.
    """
    out = layer1.exact(df, text, "l1").withColumn("cleaned", F.col("l1.cleaned")).withColumn("found", F.col("l1.found"))
    if html:
        out = out.withColumn("__t", F.col("l1.cleaned"))
        out = markup.sanitize_html(out, "__t", "l2", "l3" if urls else None).withColumn("cleaned", F.col("l2.cleaned"))
        out = out.withColumn("found", F.concat("found", F.array_compact(F.array(F.when(F.col("l2.comments") > 0, COMMENTS), F.when(F.col("l2.hidden") > 0, HIDDEN)))))
    if urls:
        if not html:
            out = markup.report_urls(out.withColumn("__t", F.col("l1.cleaned")), "__t", "l3")
        out = out.withColumn("found", F.concat("found", F.array_compact(F.array(F.when(F.size("l3.threats") > 0, EXFIL), F.when(F.size("l3.hosts") > 0, CONFUSABLE)))))
    if secrets:
        values = F.concat(F.array(F.col("l1.cleaned")), F.transform("l2.pairs", lambda p: p["original"])) if html else None
        also = {"__v": redact.vet(F.when(F.size("l2.pairs") > 0, values), local)} if html else {}
        out = redact.redact(out, "cleaned", local, "l4", seconds=seconds, also=also).withColumn("cleaned", F.col("l4.view"))
    if injection:
        needles = F.coalesce(F.col(injection)["remove"], F.array().cast("array<string>"))
        out = texts.delete_spans(out.withColumns({"__c": F.col("cleaned"), "__n": needles}), "__c", "__n", "l5").drop("__n")
        out = out.withColumn("l5", F.col("l5").withField("message", messages.filter_warning(F.col(injection)["code"])))
        out = out.withColumn("cleaned", F.when(F.col("__c").isNotNull(), F.col("l5.cleaned"))).drop("__c")
        if secrets:
            out = redact.redact(out.withColumn("__t", F.when(F.col("l5.n_removed") > 0, F.col("cleaned"))), "__t", local, "__l4", seconds=seconds)
            out = out.withColumn("cleaned", F.when(F.col("l5.n_removed") > 0, F.col("__l4.view")).otherwise(F.col("cleaned"))).drop("__l4")
    if html:
        out = _exits(out, secrets)
    out = out.drop("__t").withColumn("found", F.array_distinct("found"))
    return out.withColumn("modified", ~F.col("cleaned").eqNullSafe(F.coalesce(F.col(text), F.lit(""))))


def _exits(out: DataFrame, vetted: bool) -> DataFrame:
    """out with reveal and splices; __v are the vetted texts of both."""
    spliced = F.size("l2.pairs") > 0
    if not vetted:
        return out.withColumns({"reveal": F.when(spliced, F.col("l1.cleaned")), "splices": F.when(spliced, F.col("l2.pairs"))})
    own = F.transform("l2.pairs", lambda p, k: p.withField("original", F.col("__v")[k + 1]))
    pairs = F.filter(own, lambda p: p["original"].isNotNull())
    return out.withColumns({"reveal": F.when(spliced, F.col("__v")[0]), "splices": F.when(spliced, pairs)}).drop("__v")


def tell(sanitized: DataFrame, quiet_colour: Column | bool = False) -> DataFrame:
    """sanitized with warnings and notes, in order of layers, and sgr_note: notes without a warning.

    What only changes how text looks is a note where the caller says so; URLs
    that are fetched of their own accord and hosts that read as others are
    warnings, other URLs and mixed scripts are notes.
    """
    quiet = quiet_colour if isinstance(quiet_colour, Column) else F.lit(quiet_colour)
    l1 = messages.stripped(F.col("l1.found"), F.col("l1.long_run"))
    inert = F.forall("l1.ansi_kinds", lambda k: k.isin(*ansi.BENIGN)) & ~F.col("l1.long_run") & (F.col("l1.payload") < LONG_RUN)
    only = (F.size("l1.found") == 1) & (F.col("l1.found")[0] == ANSI)
    loud, soft = [F.when(~(quiet & inert), l1)], [F.when(quiet & inert, F.when(only, F.lit(layer1.INERT)).otherwise(l1))]
    columns = sanitized.columns
    if "l2" in columns:
        loud += [messages.removed(F.col("l2.comments"), F.col("l2.hidden"))]
        soft += [messages.preserved(F.col("l2.tags"), F.col("l2.data_sources"))]
        lost = F.size("l2.pairs") > F.size("splices")
        loud += [F.when(lost, F.lit(f"splices {messages.WITHHELD}")), F.when((F.size("l2.pairs") > 0) & F.col("reveal").isNull(), F.lit(f"reveal {messages.WITHHELD}"))]
    if "l3" in columns:
        fetched, reads = F.exists("l3.threats", lambda t: t["auto_fetched"]), F.exists("l3.hosts", lambda h: h["severity"] == "warning")
        for message, is_loud in ((messages.exfil(F.col("l3.threats")), fetched), (messages.hosts(F.col("l3.hosts")), reads)):
            loud.append(F.when(is_loud, message))
            soft.append(F.when(~is_loud, message))
    if "l4" in columns:
        loud.append(F.when(F.size("l4.found") > 0, F.concat(F.lit("Redacted: "), F.array_join("l4.found", ", "))))
    if "l5" in columns:
        loud.append(F.col("l5.message"))
    out = sanitized.withColumns({"warnings": F.array_compact(F.array(*loud)), "notes": F.array_compact(F.array(*soft))})
    return out.withColumn("sgr_note", (F.size("notes") > 0) & (F.size("warnings") == 0))


#: What a row becomes whose layers failed.
POSTURES = ("pass_with_warning", "suppress", "fail")


def envelope(df: DataFrame, before: str, after: str = "cleaned", on_error: str = "suppress") -> DataFrame:
    """df with output and status (ok, failed): a null ``after`` is withheld, or passed with a warning, or stops the job."""
    if on_error not in POSTURES:
        raise ValueError(f"on_error is one of {', '.join(POSTURES)}")
    failed = F.col(after).isNull() & F.col(before).isNotNull()
    other = {"suppress": F.lit("[output withheld: it could not be sanitized]"), "pass_with_warning": F.concat(F.lit("[not sanitized] "), F.col(before)), "fail": F.raise_error(F.lit("a row could not be sanitized"))}[on_error]
    return df.withColumns({"status": F.when(failed, "failed").otherwise("ok"), "output": F.when(failed, other).otherwise(F.col(after))})


def any_leaf(schema: T.DataType, value: Column, test: Callable[[Column], Column], depth: int = 0) -> Column:
    """Whether test holds for any string inside value."""
    if isinstance(schema, T.StringType):
        return F.coalesce(test(value), F.lit(False))
    if isinstance(schema, T.ArrayType):
        return F.coalesce(F.exists(value, lambda v: any_leaf(schema.elementType, v, test, depth + 1)), F.lit(False))
    if isinstance(schema, T.MapType):
        return F.coalesce(F.exists(F.map_values(value), lambda v: any_leaf(schema.valueType, v, test, depth + 1)), F.lit(False))
    if isinstance(schema, T.StructType):
        parts = [any_leaf(f.dataType, value.getField(f.name), test, depth + 1) for f in schema.fields]
        return functools.reduce(lambda a, b: a | b, parts, F.lit(False))
    return F.lit(False)


def modified_values(df: DataFrame, *names: str) -> DataFrame:
    """df with modified: whether native Layer 1 changes any string of the named columns."""
    parts = [any_leaf(df.schema[n].dataType, F.col(n), layer1.touched) for n in names]
    return df.withColumn("modified", functools.reduce(lambda a, b: a | b, parts, F.lit(False)))


def pre_tool(calls: DataFrame, text: str = "text") -> DataFrame:
    """calls (tool, text) with updated and notes: look-alikes folded, then authored text stripped.

    The strip can bring characters together into a token that folds, so both run
    twice; a third round changes nothing, as nothing is left to strip.
    """
    out = calls.withColumns({"updated": F.coalesce(F.col(text), F.lit("")), "notes": F.array().cast("array<string>")})
    for _ in range(2):
        out = texts.fold(out.drop("folded", "folds"), "updated")
        folded = F.when(F.size("folds") > 0, F.array(F.lit("look-alike characters folded"))).otherwise(F.array().cast("array<string>"))
        stripped = toolcalls.strip_authored(F.col("folded"))
        out = out.withColumn("__s", stripped)
        told = F.when(F.col("__s") != F.col("folded"), F.array(F.lit("hidden characters removed"))).otherwise(F.array().cast("array<string>"))
        out = out.withColumns({"notes": F.array_distinct(F.concat("notes", folded, told)), "updated": F.col("__s")}).drop("__s", "folded", "folds")
    return out


def findings(sanitized: DataFrame, key: str = "doc_id", *keep: str) -> DataFrame:
    """(key, keep, layer, code, severity): one row for each code of each row."""
    layer = F.create_map(*[F.lit(x) for pair in LAYER.items() for x in pair])
    code = F.col("code")
    loud = code != EXFIL
    if "l3" in sanitized.columns:
        loud = loud | F.exists("l3.threats", lambda t: t["auto_fetched"])
    rows = sanitized.select("*", F.explode("found").alias("code"))
    return rows.select(key, *keep, layer[code].alias("layer"), "code", F.when(loud, "warning").otherwise("note").alias("severity"))


def banner(sanitized: DataFrame) -> DataFrame:
    """sanitized with banner, what a reader is told; null if nothing was found."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    told = F.concat(F.lit("WARNING: found "), F.array_join(F.transform("found", lambda c: labels[c]), ", "), F.lit("."))
    return sanitized.withColumn("banner", F.when(F.size("found") > 0, told))


def over_strings(schema: T.DataType, value: Column, change: Callable[[Column], Column], depth: int = 0) -> Column:
    """value with change applied to every string inside, its shape kept; map keys stay as they are.

    What lies deeper than DEPTH is withheld as null.
    """
    if depth >= DEPTH:
        return F.lit(None).cast(schema)
    if isinstance(schema, T.StringType):
        return change(value)
    if isinstance(schema, T.ArrayType):
        return F.transform(value, lambda v: over_strings(schema.elementType, v, change, depth + 1))
    if isinstance(schema, T.MapType):
        return F.transform_values(value, lambda _, v: over_strings(schema.valueType, v, change, depth + 1))
    if isinstance(schema, T.StructType):
        fields = [over_strings(f.dataType, value.getField(f.name), change, depth + 1).alias(f.name) for f in schema.fields]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def sanitize_values(df: DataFrame, *names: str) -> DataFrame:
    """df with native Layer 1 over every string of the named columns, however nested."""
    return df.withColumns({n: over_strings(df.schema[n].dataType, F.col(n), layer1.native) for n in names})


def clean_keys(c: Column) -> tuple[Column, Column]:
    """(map with Layer 1 over its keys, whether keys met): where two keys become one, the map is withheld as null."""
    keys = F.transform(F.map_keys(c), layer1.native)
    met = F.size(keys) != F.size(F.array_distinct(keys))
    return F.when(~met, F.map_from_arrays(keys, F.map_values(c))), met


def suppress(df: DataFrame, message: str, *names: str) -> DataFrame:
    """df with every string of the named columns replaced by a message."""
    return df.withColumns({n: over_strings(df.schema[n].dataType, F.col(n), lambda _: F.lit(message)) for n in names})


def to_fixed_point(df: DataFrame, steps: list[Callable[[Column], Column]], column: str, rounds: int = 8) -> DataFrame:
    """df with steps applied to a column again and again, up to rounds times, and settled: whether another round changes nothing."""
    c = F.col(column)
    for _ in range(rounds):
        for step in steps:
            c = step(c)
    out = df.withColumn(column, c)
    once = F.col(column)
    for step in steps:
        once = step(once)
    return out.withColumn("settled", once == F.col(column))


__all__ = ["any_leaf", "banner", "clean_keys", "envelope", "findings", "modified_values", "over_strings", "pre_tool", "sanitize", "sanitize_values", "suppress", "tell", "to_fixed_point", "unsplice_column"]
