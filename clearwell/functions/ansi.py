"""Terminal escapes: column expressions and a scanner.

A control string opens with ESC and one of ``]PX^_`` or with the C1 byte of the
same, and runs to BEL, ST, CAN or SUB (taken with it) or to ESC, another opener,
a line end or the end of the text (left).  A control sequence is ESC or CSI,
any of ``[()#;?``, parameters, and one final byte.  Anything else is an orphan.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import INTRODUCER

SGR, CSI, OSC, STRING = "sgr", "csi", "osc", "control-string"
ORPHAN, ORPHAN_CSI, ORPHAN_C1 = "orphan-introducer", "orphan-csi", "orphan-c1"
BENIGN = (SGR, ORPHAN)
PASSES = 3

# --- fixed values: the grammar's byte classes ---
_OPEN = r"(?:\x1B[\x5D\x50\x58\x5E\x5F]|[\x90\x98\x9D\x9E\x9F])"
_BODY = r"[^\x07\x0A\x0D\x18\x1A\x1B\x90\x98\x9C\x9D\x9E\x9F]"
_CLOSE = r"[\x07\x18\x1A\x9C]"
_PREFIX = r"[\x5B()#;?]"
_FINAL = r"[A-PR-TZcf-nqrty~]"
_SGR_TEXT = r"(?:\x1B\x5B|\x9B)[0-9;:]*m"


def _pattern(possessive: str) -> str:
    # A string that neither closes nor meets ESC-backslash ends where its body does; that needs no look-ahead.
    string = rf"{_OPEN}{_BODY}*{possessive}(?:{_CLOSE}|\x1B\x5C)?"
    sequence = rf"[\x1B\x9B]{_PREFIX}*{possessive}[0-9;:]*{possessive}{_FINAL}"
    return f"(?:{string}|{sequence})"


#: For Java; possessive loops keep it linear and free of recursion.
SEQUENCE = _pattern("+")
_TOKEN = re.compile(rf"(?P<osc>(?:\x1B\x5D|\x9D){_BODY}*+(?:{_CLOSE}|\x1B\x5C)?)|(?P<string>{_OPEN}{_BODY}*+(?:{_CLOSE}|\x1B\x5C)?)|(?P<sgr>{_SGR_TEXT})|(?P<csi>[\x1B\x9B]{_PREFIX}*+[0-9;:]*+{_FINAL})|(?P<c1>[\x80-\x9F])|(?P<open>\x1B(?=\x5B))|(?P<lone>\x1B)")
_KIND = {"osc": OSC, "string": STRING, "sgr": SGR, "csi": CSI, "c1": ORPHAN_C1, "open": ORPHAN_CSI, "lone": ORPHAN}


class Token(NamedTuple):
    start: int
    end: int
    kind: str


def scan(text: str) -> list[Token]:
    """One token for each introducer, disjoint and in order."""
    return [Token(m.start(), m.end(), _KIND[m.lastgroup]) for m in _TOKEN.finditer(text)]


def strip_text(text: str, kinds: dict[str, None]) -> str:
    """text without whole sequences, to a fixed point in PASSES passes; kinds gathers what went, in order."""
    for _ in range(PASSES):
        gone = [t for t in scan(text) if not t.kind.startswith("orphan")]
        if not gone:
            break
        kinds.update(dict.fromkeys(t.kind for t in gone))
        ends = [0, *(t.end for t in gone)]
        text = "".join(text[a:b] for a, b in zip(ends, [*(t.start for t in gone), len(text)], strict=True))
    return text


def sweep_text(text: str, kinds: dict[str, None]) -> str:
    """text without introducers; each is judged by the character after it."""
    for m in re.finditer(r"[\x1b\x80-\x9f]", text):
        after = text[m.end() : m.end() + 1]
        kinds[ORPHAN_C1 if m.group() != "\x1b" else ORPHAN_CSI if after == "[" else ORPHAN] = None
    return re.sub(r"[\x1b\x80-\x9f]", "", text)


def strip(c: Column) -> Column:
    """Native strip of whole sequences."""
    for _ in range(PASSES):
        c = F.regexp_replace(c, F.lit(SEQUENCE), F.lit(""))
    return c


def sweep(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(INTRODUCER), F.lit(""))


def has_introducer(c: Column) -> Column:
    return c.rlike(INTRODUCER)


def token_texts(c: Column) -> Column:
    """Whole sequences and orphans, in order."""
    return F.regexp_extract_all(c, F.lit(f"({SEQUENCE}|{INTRODUCER})"), F.lit(1))


def kind_of(token: Column, sgr: str = rf"^{_SGR_TEXT}$") -> Column:
    """The kind of a token's text; orphans before a bracket need scan()."""
    return (
        F.when(token.rlike(sgr), SGR)
        .when(token.rlike(r"^(?:\x1B\x5D|\x9D)"), OSC)
        .when(token.rlike(f"^{_OPEN}"), STRING)
        .when(F.length(token) > 1, CSI)
        .when(token == "\x1b", ORPHAN)
        .otherwise(ORPHAN_C1)
    )
