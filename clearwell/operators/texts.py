"""Operators over a column of text that need a scanner: tokens, runs, prompts, folds, verbatim deletion."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ansi, gates, instructions, invisible, spans, urls
from .layer1 import touched

S, I = T.StringType(), T.IntegerType()  # noqa: E741
TOKEN = T.StructType([T.StructField("start", I), T.StructField("end", I), T.StructField("kind", S)])
FINDING = T.StructType([T.StructField("line", I), T.StructField("char_count", I), T.StructField("method", S), T.StructField("decoded", S)])
FOLD = T.StructType([T.StructField("index", I), T.StructField("char", S), T.StructField("latin", S)])
VERDICT = T.StructType([T.StructField("action", S), T.StructField("reason", S)])


@F.pandas_udf(T.ArrayType(TOKEN))
def _tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [x._asdict() for x in ansi.scan(t or "")])


def ansi_tokens(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, ord, start, end, kind): the escapes of each text; texts without an introducer never reach Python."""
    hit = df.where(ansi.has_introducer(F.col(text)))
    return hit.select(key, F.posexplode(_tokens(F.col(text))).alias("ord", "t")).select(key, "ord", "t.*")


@F.pandas_udf(T.ArrayType(FINDING))
def _findings(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [x._asdict() for x in instructions.scan(t or "")])


def scan_instructions(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line, char_count, method, decoded): hidden runs of each text, and what is scattered over it."""
    hit = df.where(invisible.has_any(F.col(text)))
    return hit.select(key, F.explode(_findings(F.col(text))).alias("f")).select(key, "f.*")


def prompt_verdicts(df: DataFrame, text: str = "text", into: str = "verdict", strip: Callable[[str], str] | None = None) -> DataFrame:
    """df with a struct (action, reason): pass, note or block; clean, empty and null prompts pass.  One scan: clean prompts go to Python as null.  strip, if given, takes the escapes out."""

    @F.pandas_udf(VERDICT)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([("pass", None) if t is None else instructions.classify_prompt(t, strip) for t in texts], columns=VERDICT.names)

    c = F.col(text)
    return df.withColumn(into, judge.asNondeterministic()(F.when(touched(c), c)))


def fold(df: DataFrame, text: str = "text", scan: Callable[[str], list[tuple[int, str, str]]] | None = None) -> DataFrame:
    """df with folded, its look-alike glyphs as ASCII, and folds; ASCII texts go to Python as null.

    scan, if given, finds the glyphs; what it finds is checked before anything is changed.
    """

    @F.pandas_udf(T.StructType([T.StructField("folded", S), T.StructField("folds", T.ArrayType(FOLD))]))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(None, []) if t is None else urls.fold_found(t, scan(t)) if scan else urls.fold_text(t) for t in texts]
            yield pd.DataFrame([(t, [dict(zip(FOLD.names, f, strict=True)) for f in fs]) for t, fs in rows], columns=["folded", "folds"])

    c = F.coalesce(F.col(text), F.lit(""))
    done = df.withColumn("__f", run.asNondeterministic()(F.when(gates.non_ascii(c), c)))
    return done.withColumns({"folded": F.coalesce("__f.folded", c), "folds": F.col("__f.folds")}).drop("__f")


def delete_spans(df: DataFrame, text: str = "text", needles: str = "needles", into: str | None = None) -> DataFrame:
    """df with cleaned, its text without the needles found verbatim, and n_removed; as one struct if ``into`` is given."""

    @F.pandas_udf(T.StructType([T.StructField("cleaned", S), T.StructField("n_removed", I)]))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            yield pd.DataFrame([spans.delete_verbatim(t or "", list(n) if n is not None else []) for t, n in zip(texts, lists, strict=True)], columns=["cleaned", "n_removed"])

    out = df.withColumn(into or "__d", run.asNondeterministic()(F.col(text), F.col(needles)))
    return out if into else out.withColumns({"cleaned": F.col("__d.cleaned"), "n_removed": F.col("__d.n_removed")}).drop("__d")


#: What a prompt's verdict means to a host, by its event.
VERDICTS = {"pass": "allow", "note": "note", "block": "deny"}


def host_verdicts(df: DataFrame, event: str = "event", action: str = "action") -> DataFrame:
    """df with decision: allow, note or deny; an event or an action that is not known is denied."""
    known = F.create_map(*[F.lit(x) for pair in VERDICTS.items() for x in pair])
    return df.withColumn("decision", F.when(F.col(event).isin("UserPromptSubmit", "prompt"), F.coalesce(known[F.col(action)], F.lit("deny"))).otherwise("deny"))
