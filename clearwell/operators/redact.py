"""Layer 4: redaction of secrets, and its inverse."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import secrets
from ..functions.spans import unsplice_column

PAIR = T.StructType([T.StructField("placeholder", T.StringType()), T.StructField("original", T.StringType()), T.StructField("start", T.IntegerType())])
RESULT = T.StructType([T.StructField("view", T.StringType()), T.StructField("found", T.ArrayType(T.StringType())), T.StructField("pairs", T.ArrayType(PAIR)), T.StructField("error", T.StringType())])


def redactor(high_confidence: bool = False, known: Mapping[str, str] | None = None, seconds: float | None = None, detectors: Sequence[secrets.Detector] | None = None):
    """Column function (text, local) -> RESULT.  A row that fails, or takes longer than ``seconds``, has a null view and the kind of its error, never its text."""
    known = dict(known or {})
    for name in known:
        secrets.label(name)

    @F.pandas_udf(RESULT)
    def run(texts: pd.Series, local: pd.Series) -> pd.DataFrame:
        rows = []
        for t, trusted in zip(texts, local, strict=True):
            if t is None:
                rows.append((None, [], [], None))
                continue
            try:
                view, found, pairs = secrets.redact(t, bool(trusted), high_confidence, known, seconds, detectors)
                rows.append((view, found, [p._asdict() for p in pairs], None))
            except Exception as e:  # the row is withheld, not the job stopped
                rows.append((None, [], [], type(e).__name__))
        return pd.DataFrame(rows, columns=RESULT.names)

    return run


def redact(df: DataFrame, text: str = "text", local: Column | bool = True, into: str = "l4", high_confidence: bool = False, known: Mapping[str, str] | None = None, seconds: float | None = None, also: Mapping[str, Column] | None = None, detectors: Sequence[secrets.Detector] | None = None) -> DataFrame:
    """df with a struct of RESULT, and the columns of ``also`` from the same stage.  One scan: rows without a hint of a secret go to Python as null.

    ``detectors``: the caller's own, in place of all of this library's (see secrets.find).
    """
    c = F.coalesce(F.col(text), F.lit(""))
    trusted = local if isinstance(local, Column) else F.lit(local)
    stage = redactor(high_confidence, known, seconds, detectors).asNondeterministic()(F.when(F.col("__hint"), c), trusted)
    out = secrets.with_hint(df, c, "__hint", known, detectors).withColumns({into: stage, **(also or {})})
    view = F.when(F.col("__hint"), F.col(into)["view"]).otherwise(c)
    return out.withColumn(into, F.struct(view.alias("view"), *(F.col(into)[k].alias(k) for k in RESULT.names[1:]))).drop("__hint")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _vet(rows: pd.Series, local: pd.Series) -> pd.Series:
    def one(text: str | None, trusted: bool) -> str | None:
        try:
            return None if text is None else secrets.redact(text, trusted)[0]
        except Exception:  # withheld
            return None

    return pd.Series([[one(t, bool(x)) for t in r] if r is not None else [] for r, x in zip(rows, local, strict=True)], dtype=object)


def vet(texts: Column, local: Column | bool = True) -> Column:
    """An array of texts without secrets; null in place of one that could not be vetted."""
    return _vet.asNondeterministic()(texts, local if isinstance(local, Column) else F.lit(local))


def unredact(df: DataFrame, view: str, pairs: str, into: str) -> DataFrame:
    """Native: the text that redaction or splicing started from."""
    return df.withColumn(into, unsplice_column(view, pairs))


def previews(df: DataFrame, text: str = "text", key: str = "doc_id", detectors: Sequence[secrets.Detector] | None = None, blanks: str | None = None) -> DataFrame:
    """(key, preview): the masked lines of each row that hold secrets; ``detectors`` and ``blanks`` as in secrets.previews."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: [] if t is None else secrets.previews(t, detectors=detectors, blanks=blanks))

    hinted = secrets.with_hint(df.select(key, text), F.col(text), "__hint", detectors=detectors).where("__hint")
    return hinted.select(key, F.explode(run(F.col(text))).alias("preview"))


def scan_distinct_lines(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, line_no, hits): each distinct line is scanned once, then joined back; lines repeat across documents."""
    lines = df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("line_no", "line"))
    lines = lines.where(secrets.names_field(F.col("line")))  # the pattern's literals first: few lines are shuffled
    hit = lines.select("line").distinct().withColumn("hits", secrets.count_fields(F.col("line"))).where("hits > 0")
    return lines.join(hit, "line").select(key, "line_no", "hits")
