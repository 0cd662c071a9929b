"""SQL names for the library's functions: register(spark) makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import ansi, css, gates, html, instructions, invisible, secrets, urls
from .functions.characters import INTRODUCER, INVISIBLE
from .operators import layer1

_S = T.StringType()


def _scalar(function, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield values.map(lambda v: None if v is None else function(v))

    return run


def _table(rows, kind: str):
    class Table:
        def eval(self, text: str):
            yield from rows(text or "")

    return F.udtf(Table, returnType=kind)


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\x27") + "'"


def register(spark: SparkSession) -> list[str]:
    """The names registered."""
    native = {
        "cw_strip(t STRING) RETURNS STRING": f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, {_literal(ansi.SEQUENCE)}, ''), {_literal(INVISIBLE)}, ''), {_literal(ansi.SEQUENCE)}, ''), {_literal(INTRODUCER)}, '')",
        "cw_invisible_count(t STRING) RETURNS INT": f"regexp_count(t, {_literal(INVISIBLE)})",
        "cw_has_tag(t STRING) RETURNS BOOLEAN": f"t RLIKE {_literal(gates.HTML_TAG)}",
        "cw_has_url(t STRING) RETURNS BOOLEAN": f"t RLIKE {_literal(gates.URL)}",
        "cw_placeholder(label STRING, original STRING) RETURNS STRING": "concat('[', label, ' removed #', substring(sha2(original, 256), 1, 12), ']')",
    }
    for head, body in native.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    arrow = {
        "cw_l1": (lambda t: layer1.clean_text(t)[0], _S),
        "cw_found": (lambda t: layer1.clean_text(t)[2], T.ArrayType(_S)),
        "cw_prompt_verdict": (lambda t: instructions.classify_prompt(t)[0], _S),
        "cw_decode_run": (lambda t: instructions.printable(instructions.decode_run(t)[1]), _S),
        "cw_html_clean": (lambda t: html.sanitize(t).text, _S),
        "cw_style_hidden": (css.hides, T.BooleanType()),
        "cw_exfil_reason": (urls.exfil_reason, _S),
        "cw_url_target": (urls.target, _S),
        "cw_host_tier": (lambda u: (urls.host_tier(u) or (None,))[0], _S),
        "cw_fold": (lambda t: urls.fold_text(t)[0], _S),
        "cw_redact": (lambda t: secrets.redact(t, local=False)[0], _S),
        "cw_redact_local": (lambda t: secrets.redact(t, local=True)[0], _S),
    }
    for name, (function, kind) in arrow.items():
        spark.udf.register(name, _scalar(function, kind))
    tables = {
        "cw_ansi_tokens": (lambda t: [tuple(x) for x in ansi.scan(t)], "start int, end int, kind string"),
        "cw_long_runs": (lambda t: [(k, len(r), r) for k, r in invisible.runs_of(t)], "start int, char_count int, run string"),
        "cw_html_spans": (lambda t: [tuple(x) for x in html.scan(t).spans], "start int, end int, kind string"),
        "cw_urls": (lambda t: [tuple(x) for x in html.urls(t)], "url string, is_image boolean, auto_fetched boolean, context string"),
        "cw_secrets": (lambda t: [(h.start, h.end, h.secret_type) for h in secrets.find(t)], "start int, end int, secret_type string"),
    }
    for name, (rows, kind) in tables.items():
        spark.udtf.register(name, _table(rows, kind))
    return [*(h.split("(")[0] for h in native), *arrow, *tables]
