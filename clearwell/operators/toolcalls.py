"""Tool calls: authored text without hidden characters, policies by tool, and edits carried back to disk."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ansi, gates, invisible, rehydrate
from ..functions.characters import SCATTERED
from ..functions.spans import Pair

OUTCOME = T.StructType([T.StructField("outcome", T.StringType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType()), T.StructField("reason", T.StringType())])


def may_carry(c: Column) -> Column:
    """Native: a long run, or as many invisible characters as can carry a message."""
    return invisible.has_long_run(c) | (invisible.count(c) >= SCATTERED)


def strip_authored(c: Column) -> Column:
    """Authored text: escapes always go, invisible characters only where they can carry a message."""
    plain = ansi.sweep(ansi.strip(c))
    return F.when(may_carry(plain), invisible.strip(plain)).otherwise(plain)


def strip_edits(df: DataFrame, edits: str, *fields: str) -> DataFrame:
    """df with strip_authored() over fields of an array of structs."""

    def one(e):
        for f in fields:
            e = e.withField(f, strip_authored(e[f]))
        return e

    return df.withColumn(edits, F.transform(edits, one))


def policy(df: DataFrame, tool: str = "tool", text: str = "text") -> DataFrame:
    """df with what to do for its tool: html, urls, quiet_colour, local."""
    outside = gates.is_untrusted_tool(F.col(tool))
    web = F.col(tool).isin("WebFetch", "WebSearch")
    return df.withColumns({"html": web | outside & gates.has_tag(F.col(text)), "urls": outside, "quiet_colour": ~outside, "local": ~outside})


def rehydrate_edits(df: DataFrame, view: str = "view", pairs: str = "pairs", old: str = "old", new: str = "new", every: str = "replace_all", into: str = "edit") -> DataFrame:
    """df with a struct of OUTCOME: none, update or deny."""

    @F.pandas_udf(OUTCOME)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for views, maps, olds, news, alls in batches:
            rows = []
            for v, m, o, n, a in zip(views, maps, olds, news, alls, strict=True):
                own = [Pair(p["placeholder"], p["original"], p["start"]) for p in (m if m is not None else [])]
                got = rehydrate.edit(v or "", own, o or "", n or "", bool(a))
                if got is None:
                    rows.append(("none", o, n, None))
                elif isinstance(got, rehydrate.Deny):
                    rows.append(("deny", None, None, got.reason))
                else:
                    rows.append(("update", got.old, got.new, None))
            yield pd.DataFrame(rows, columns=OUTCOME.names)

    return df.withColumn(into, run(*(F.col(c) for c in (view, pairs, old, new, every))))


#: Tools that write files, and so may carry a placeholder to disk.
WRITERS = ("Edit", "MultiEdit", "NotebookEdit", "Write")


def may_rehydrate(tool: Column, texts: Column) -> Column:
    """Native: whether a call writes a file and any of its texts holds a placeholder."""
    return tool.isin(*WRITERS) & F.exists(texts, lambda t: F.size(placeholders(t)) > 0)


def placeholders(c: Column) -> Column:
    """Native: the placeholders in a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\[REDACTED(?:: [A-Za-z0-9 ()._-]{1,64})?\]|\[(?:HTML comment|hidden HTML) removed #[0-9a-f]{12}\])"), F.lit(1))


def describe_placeholders(c: Column, most: int = 5) -> Column:
    """Native: the distinct placeholders, the first few by name."""
    names = F.array_distinct(placeholders(c))
    more = F.when(F.size(names) > most, F.concat(F.lit(" and "), F.size(names) - most, F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(names, 1, most), ", "), more)
