"""Spans of a text: merge, splice with placeholders, restore, map offsets.

Offsets count code points from 0; a span is half-open.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Span(NamedTuple):
    start: int
    end: int
    kind: str


class Pair(NamedTuple):
    """What stands at start of the new text, and what it stands for."""

    placeholder: str
    original: str
    start: int


def placeholder(label: str, original: str) -> str:
    return f"[{label} removed #{hashlib.sha256(original.encode()).hexdigest()[:12]}]"


def merge(spans: Iterable[Span], over: str = "hidden", abutting: bool = False) -> list[Span]:
    """Overlapping spans as one; a merged span has the kind ``over`` if a part has.  Abutting ones stay apart unless told."""
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s.start, s.end)):
        if out and (s.start < out[-1].end or abutting and s.start == out[-1].end):
            last = out[-1]
            out[-1] = Span(last.start, max(last.end, s.end), over if over in (last.kind, s.kind) else last.kind)
        else:
            out.append(s)
    return out


def splice(text: str, spans: Iterable[Span], labels: dict[str, str]) -> tuple[str, list[Pair]]:
    """text with disjoint ascending spans behind placeholders."""
    parts, pairs, at, size = [], [], 0, 0
    for s in spans:
        original = text[s.start : s.end]
        new = placeholder(labels[s.kind], original)
        parts += [text[at : s.start], new]
        size += s.start - at
        pairs.append(Pair(new, original, size))
        size += len(new)
        at = s.end
    return "".join([*parts, text[at:]]), pairs


def restore(view: str, pairs: Iterable[Pair]) -> str:
    """The text of which splice() made view."""
    parts, at = [], 0
    for p in pairs:
        parts += [view[at : p.start], p.original]
        at = p.start + len(p.placeholder)
    return "".join([*parts, view[at:]])


def to_source(pairs: list[Pair], at: int) -> int | None:
    """The place in the old text of a place in the new one; None inside a placeholder."""
    k = bisect_right([p.start for p in pairs], at) - 1
    if k >= 0 and pairs[k].start < at < pairs[k].start + len(pairs[k].placeholder):
        return None
    passed = pairs[: k + 1] if k < 0 or at != pairs[k].start else pairs[:k]
    return at + sum(len(p.original) - len(p.placeholder) for p in passed)


def delete_verbatim(text: str, needles: list[str]) -> tuple[str, int]:
    """text without the needles: all are found in the text as given, the first in place wins, and nothing is searched again."""
    hits = []
    for order, needle in enumerate(dict.fromkeys(n for n in needles if n)):
        k = text.find(needle)
        while k >= 0:
            hits.append((k, order, needle))
            k = text.find(needle, k + len(needle))
    out, at, n = [], 0, 0
    for k, _, needle in sorted(hits):
        if k >= at:
            out.append(text[at:k])
            at, n = k + len(needle), n + 1
    return "".join([*out, text[at:]]), n


def align_deletions(content: str, cleaned: str) -> list[tuple[int, str]]:
    """(place, text) of the runs that content has beyond cleaned; cleaned must be a subsequence of it."""
    out, at = [], 0
    for ch in [*cleaned, None]:
        k = len(content) if ch is None else content.find(ch, at)
        if k < 0:
            raise ValueError("the cleaned text is no subsequence of the content")
        if k > at:
            out.append((at, content[at:k]))
        at = k + 1
    return out


def occurrences(text: str, needle: str, overlapping: bool = False) -> list[int]:
    out, k = [], text.find(needle) if needle else -1
    while k >= 0:
        out.append(k)
        k = text.find(needle, k + (1 if overlapping else len(needle)))
    return out


def anchors(view: str, content: str, taken: Iterable[tuple[int, int]] = ()) -> tuple[int, int]:
    """Lengths of the beginning and the end that two texts share, drawn back so that neither cuts one of the taken spans of view."""
    most = min(len(view), len(content))
    start = next((k for k in range(most) if view[k] != content[k]), most)
    end = next((k for k in range(most - start) if view[-1 - k] != content[-1 - k]), most - start)
    for a, b in sorted(taken):
        if a < start < b:
            start = a
        if a < len(view) - end < b:
            end = len(view) - b
    return start, end


# ---- native ----


def straddles(start: Column, end: Column, places: Column) -> Column:
    """Whether any of the places (line ends, say) lies inside a span."""
    return F.exists(places, lambda n: (n >= start) & (n < end))



def placeholder_column(label: str, original: Column) -> Column:
    return F.concat(F.lit(f"[{label} removed #"), F.substring(F.sha2(original, 256), 1, 12), F.lit("]"))


def unsplice_column(view: str, pairs: str) -> Column:
    """Native restore() of a view column with an array of (placeholder, original, start)."""
    return F.expr(f"""aggregate({pairs}, named_struct('at', 0, 'out', ''),
        (s, p) -> named_struct('at', p.start + length(p.placeholder), 'out', concat(s.out, substring({view}, s.at + 1, p.start - s.at), p.original)),
        s -> concat(s.out, substring({view}, s.at + 1, length({view}))))""")
