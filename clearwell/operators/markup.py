"""Layers 2 and 3: hidden HTML behind placeholders, and reports on URLs and hosts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import css, gates, html, urls
from ..functions.spans import placeholder_column
from .redact import PAIR

S, I, B = T.StringType(), T.IntegerType(), T.BooleanType()  # noqa: E741
HTML = T.StructType([T.StructField("cleaned", S), T.StructField("pairs", T.ArrayType(PAIR)), T.StructField("comments", I), T.StructField("hidden", I), T.StructField("tags", T.MapType(S, I)), T.StructField("data_sources", I)])
THREAT = T.StructType([T.StructField("is_image", B), T.StructField("auto_fetched", B), T.StructField("reason", S), T.StructField("target", S)])
HOST = T.StructType([T.StructField("severity", S), T.StructField("ascii_host", S), T.StructField("host", S), T.StructField("reads", S)])
URL = T.StructType([T.StructField("url", S), T.StructField("is_image", B), T.StructField("auto_fetched", B), T.StructField("context", S)])
COMMENT = r"<!--(?:[^-]|-[^-]|--[^>])*?-->"
#: For engines without lazy groups of alternatives: a comment without "--" inside.
SIMPLE_COMMENT = r"(<!--[^>]*-->)"


# Series to frame, not iterators: Spark runs several such functions in one stage.
@F.pandas_udf(HTML)
def _sanitize(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if t is None:
            rows.append((None, [], 0, 0, {}, 0))
            continue
        c = html.sanitize(t)
        rows.append((c.text, [p._asdict() for p in c.pairs], c.comments, c.hidden, c.tags, c.data_sources))
    return pd.DataFrame(rows, columns=HTML.names)


def sanitize_html(df: DataFrame, text: str = "text", into: str = "l2", urls_into: str | None = None) -> DataFrame:
    """df with a struct of HTML, and in the same stage with report_urls() if ``urls_into`` is given.  One scan: rows without a tag go to Python as null."""
    c = F.coalesce(F.col(text), F.lit(""))
    stages = {into: _sanitize.asNondeterministic()(F.when(gates.has_tag(c), c))}
    if urls_into:
        stages[urls_into] = _report.asNondeterministic()(F.when(gates.needs_url_scan(c), c))
    out = df.withColumns(stages)
    return out.withColumn(into, F.struct(F.coalesce(F.col(into)["cleaned"], c).alias("cleaned"), *(F.col(into)[k].alias(k) for k in HTML.names[1:])))


def _exfil_rows(text: str | None) -> list[dict]:
    out = []
    for u in html.urls(text or ""):
        reason = urls.exfil_reason(u.url)
        if reason is None and u.context.split("[")[0] in ("form", "button", "input", "meta") and urls.is_off_origin(u.url):
            reason = "off-origin form action" if "action" in u.context else "off-origin refresh" if u.context == "meta[refresh]" else None
        if reason:
            out.append({"is_image": u.is_image, "auto_fetched": u.auto_fetched, "reason": reason, "target": urls.target(u.url)})
    return out


def _host_rows(text: str | None) -> list[dict]:
    seen: dict[str, dict] = {}
    for u in html.urls(text or ""):
        t = urls.host_tier(u.url) if "://" in u.url or u.url.startswith("//") else None
        if t:
            seen.setdefault(t[1], dict(zip(HOST.names, t, strict=True)))
    return list(seen.values())


@F.pandas_udf(T.StructType([T.StructField("threats", T.ArrayType(THREAT)), T.StructField("hosts", T.ArrayType(HOST))]))
def _report(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for t in texts:
        if t is None:
            rows.append(([], []))
            continue
        try:
            rows.append((_exfil_rows(t), _host_rows(t)))
        except Exception:  # a scan that fails must not read as one that found nothing
            rows.append(([{"is_image": False, "auto_fetched": False, "reason": urls.SENTINEL, "target": "(unparsable URL)"}], []))
    return pd.DataFrame(rows, columns=["threats", "hosts"])


def report_urls(df: DataFrame, text: str = "text", into: str = "l3") -> DataFrame:
    """df with a struct (threats, hosts).  One scan: rows without markup or a URL go to Python as null."""
    c = F.col(text)
    return df.withColumn(into, _report.asNondeterministic()(F.when(gates.needs_url_scan(c), c)))


@F.pandas_udf(T.ArrayType(URL))
def collect_urls(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: [u._asdict() for u in html.urls(t or "")])


def hidden_styles(df: DataFrame, style: str = "style") -> DataFrame:
    """df with hides, whether its style hides an element; each distinct style is judged once and joined back."""

    @F.pandas_udf(B)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for styles in batches:
            yield styles.map(lambda s: css.hides(s or ""))

    known = df.select(F.col(style).alias("__style")).distinct().withColumn("hides", judge(F.col("__style")))
    return df.join(known, F.col(style).eqNullSafe(F.col("__style")), "left").drop("__style")


# ---- native ----


def comments(c: Column) -> Column:
    """Proper comments without a nested end."""
    return F.regexp_extract_all(c, F.lit(SIMPLE_COMMENT), F.lit(1))


def splice_comments(df: DataFrame, text: str, into: str = "view") -> DataFrame:
    """Native: df with comments behind placeholders in ``into``, and pairs that restore the text."""
    fold = f"""aggregate(regexp_extract_all({text}, '{SIMPLE_COMMENT}', 1), named_struct('at', 0, 'out', '', 'p', cast(array() AS array<struct<placeholder:string,original:string,start:int>>)),
        (s, m) -> named_struct('at', s.at + locate(m, substring({text}, s.at + 1, length({text}))) - 1 + length(m),
            'out', concat(s.out, substring({text}, s.at + 1, locate(m, substring({text}, s.at + 1, length({text}))) - 1), '[HTML comment removed #', substring(sha2(m, 256), 1, 12), ']'),
            'p', concat(s.p, array(named_struct('placeholder', concat('[HTML comment removed #', substring(sha2(m, 256), 1, 12), ']'), 'original', m,
                'start', length(s.out) + locate(m, substring({text}, s.at + 1, length({text}))) - 1)))),
        s -> named_struct('view', concat(s.out, substring({text}, s.at + 1, length({text}))), 'pairs', s.p))"""
    return df.withColumn("__s", F.expr(fold)).withColumns({into: F.col("__s.view"), "pairs": F.col("__s.pairs")}).drop("__s")


def tag_counts(df: DataFrame, text: str, key: str) -> DataFrame:
    """Native: (key, tag, n) of the reported elements' opening tags."""
    names = "|".join(html.REPORTED)
    tags = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"<({names})(?:[\s/>])"), F.lit(1))
    return df.select(key, F.explode(tags).alias("tag")).groupBy(key, "tag").agg(F.count("*").alias("n"))


__all__ = ["collect_urls", "comments", "hidden_styles", "placeholder_column", "report_urls", "sanitize_html", "splice_comments", "tag_counts"]
