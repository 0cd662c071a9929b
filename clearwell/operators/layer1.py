"""Layer 1: terminal escapes and invisible characters, to a fixed point.

The native form deletes every tracked character and never leaves the JVM.  The
exact form keeps those that are content; rows without a tracked character go
through Python as nulls.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ansi, invisible
from ..functions.characters import ANSI, LABELS, LONG_RUN, SURROGATES, TRACKED

PASSES = 4
INERT = "Inert ANSI stripped (display-only colour and/or a stray escape byte that formed no control sequence); pipe through cat -v to inspect raw escapes."


def touched(c: Column) -> Column:
    """Whether c has any tracked character; plain ASCII is told by its length, the rest by one class."""
    return (invisible.beyond_ascii(c) | c.contains("\x1b")) & c.rlike(TRACKED)


def native(c: Column) -> Column:
    """c without escapes and invisible characters; two rounds, then a sweep.  Each step names its input once."""
    out = c
    for _ in range(2):
        out = invisible.strip(ansi.strip(out))
    return F.when(touched(c), ansi.sweep(out)).otherwise(c)


def native_found(c: Column) -> Column:
    """Categories that native() removes from c, invisible ones first."""
    none = F.array().cast("array<string>")
    escapes = F.when(ansi.has_introducer(c), F.array(F.lit(ANSI))).otherwise(none)
    seen = F.flatten(F.transform(F.array(ansi.strip(c)), invisible.found))  # the stripped text is bound once
    return F.when(touched(c), F.concat(seen, escapes)).otherwise(none)


def clean_text(text: str) -> tuple[str, str, list[str], list[str]]:
    """(cleaned, without escapes, categories, kinds of escapes) of one text."""
    kinds: dict[str, None] = {}
    found: dict[str, None] = {}
    plain = ansi.strip_text(text, kinds)
    cleaned = text
    for n in range(PASSES):
        once, gone = invisible.strip_text(plain if n == 0 else ansi.strip_text(cleaned, kinds), text)
        found.update(dict.fromkeys(gone))
        if once == cleaned:
            once = ansi.sweep_text(cleaned, kinds)
            if once == cleaned:
                break
        cleaned = once
    cleaned = ansi.sweep_text(cleaned, kinds)
    if kinds:
        found[ANSI] = None
    return cleaned, plain, list(found), list(kinds)


def clean_units(units: list[int]) -> tuple[list[int], list[str]]:
    """Layer 1 over UTF-16 units, in which surrogates may stand alone; each lone one becomes U+FFFD."""
    data = b"".join(u.to_bytes(2, "little") for u in units)
    text = data.decode("utf-16-le", "surrogatepass")
    cleaned, _, found, _ = clean_text(text)
    whole = "".join("\ufffd" if "\ud800" <= ch <= "\udfff" else ch for ch in cleaned)
    out = whole.encode("utf-16-le")
    if whole != cleaned:
        found.append(SURROGATES)
    return [int.from_bytes(out[k : k + 2], "little") for k in range(0, len(out), 2)], found


@F.pandas_udf(T.StructType([T.StructField("cleaned", T.StringType()), T.StructField("de_ansi", T.StringType()), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("ansi_kinds", T.ArrayType(T.StringType())), T.StructField("long_run", T.BooleanType()), T.StructField("payload", T.IntegerType())]))
def _exact(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        yield pd.DataFrame([(None, None, [], [], False, 0) if t is None else (*(c := clean_text(t)), invisible.payload_run(c[1]) is not None, invisible.effective_count(c[1])) for t in texts], columns=["cleaned", "de_ansi", "found", "ansi_kinds", "long_run", "payload"])


def exact(df: DataFrame, text: str = "text", into: str = "l1") -> DataFrame:
    """df with a struct (cleaned, de_ansi, found, ansi_kinds, long_run, payload).  One scan: rows without any tracked character go to Python as null.

    Here and in the other layers the stage is declared nondeterministic: else a
    filter on its result is pushed below it and runs it a second time.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    out = df.withColumn(into, _exact.asNondeterministic()(F.when(touched(c), c)))
    whole = F.struct(*(F.coalesce(F.col(into)[k], c).alias(k) for k in ("cleaned", "de_ansi")), *(F.col(into)[k].alias(k) for k in ("found", "ansi_kinds", "long_run", "payload")))
    return out.withColumn(into, whole)


def is_inert(kinds: list[str]) -> bool:
    return all(k in ansi.BENIGN for k in kinds)


def describe(found: list[str], plain: str) -> str:
    mark = " [LONG RUN — possible injection payload]" if invisible.payload_run(plain) else ""
    return f"Stripped: {', '.join(LABELS[c] for c in found)}{mark} — inspect the removed bytes with a hex dump (xxd / od -c), which survives sanitization"


def severity(text: str, plain: str, found: list[str], kinds: list[str], quiet_colour: bool = False) -> tuple[str, str] | None:
    """(warning or note, message) for what Layer 1 removed, or None; quiet_colour lets inert escapes pass as a note."""
    if not found:
        return None
    incidental = invisible.payload_run(plain) is None and invisible.effective_count(plain) < LONG_RUN
    if quiet_colour and is_inert(kinds) and incidental:
        return ("note", INERT if found == [ANSI] else describe(found, plain))
    return ("warning", describe(found, plain))
