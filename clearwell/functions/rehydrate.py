"""Edits composed on a redacted view, carried back to the text on disk.

An edit either needs no change (None), becomes an edit of the disk text
(Update), or is refused (Deny) where what it means is not certain.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from .spans import Pair, occurrences

MARK = re.compile(r"\[REDACTED(?:: [A-Za-z0-9 ()._-]{1,64})?\]|\[(?:HTML comment|hidden HTML) removed #[0-9a-f]{12}\]")


class Update(NamedTuple):
    old: str
    new: str


class Deny(NamedTuple):
    reason: str


def marks(text: str) -> list[str]:
    return MARK.findall(text)


def check_view(view: str, pairs: Sequence[Pair]) -> str | None:
    """What is wrong with a view's map, or None: pairs ascend, do not overlap, and stand where they say."""
    at = 0
    for p in pairs:
        if p.start < at:
            return "pairs are out of order or overlap"
        if view[p.start : p.start + len(p.placeholder)] != p.placeholder:
            return "a placeholder is not where the map says"
        at = p.start + len(p.placeholder)
    return None


def disk_text(view: str, pairs: Sequence[Pair], start: int, end: int) -> str | None:
    """The disk text of view[start:end]; None where an end lies inside a placeholder."""
    out, at = [], start
    for p in pairs:
        stop = p.start + len(p.placeholder)
        if stop <= start or p.start >= end:
            continue
        if p.start < start or stop > end:
            return None
        out += [view[at : p.start], p.original]
        at = stop
    return "".join([*out, view[at:end]])


def fill(text: str, pairs: Sequence[Pair], within: Sequence[Pair]) -> str | Deny:
    """text with originals for its placeholders: those of ``within`` in turn if they are the same row, else those of one value in the file."""
    own = marks(text)
    if own == [p.placeholder for p in within]:
        values = [p.original for p in within]
    else:
        known: dict[str, set[str]] = {}
        for p in pairs:
            known.setdefault(p.placeholder, set()).add(p.original)
        if any(m not in known for m in own):
            return Deny("a placeholder is not one of this file's")
        if any(len(known[m]) > 1 for m in own):
            return Deny("a placeholder stands for several values")
        values = [next(iter(known[m])) for m in own]
    rest = iter(values)
    return MARK.sub(lambda _: next(rest), text)


def edit(view: str, pairs: Sequence[Pair], old: str, new: str, replace_all: bool = False) -> Update | Deny | None:
    if defect := check_view(view, pairs):
        return Deny(defect)
    if not pairs:
        return None
    found = occurrences(view, old)
    if not found:
        return None if not marks(old + new) else Deny("the text to replace is not in the view")
    if len(occurrences(view, old, overlapping=True)) > 1 and not replace_all:
        return Deny("the text to replace occurs more than once")
    originals = {disk_text(view, pairs, k, k + len(old)) for k in found}
    if None in originals:
        return Deny("the text to replace cuts a placeholder")
    if len(originals) > 1:
        return Deny("the places to replace differ on disk")
    within = [p for p in pairs if found[0] <= p.start < found[0] + len(old)]
    filled = fill(new, pairs, within)
    if isinstance(filled, Deny):
        return filled
    source = originals.pop()
    return None if (source, filled) == (old, new) else Update(source, filled)


def write(view: str, pairs: Sequence[Pair], content: str) -> Update | Deny | None:
    """A whole file composed on the view: originals come back, by place where the row of placeholders is the same."""
    if defect := check_view(view, pairs):
        return Deny(defect)
    if not marks(content):
        return None
    filled = fill(content, pairs, list(pairs))
    return filled if isinstance(filled, Deny) else Update(view, filled)


def dropped(before: Sequence[str], after: Sequence[str]) -> list[str]:
    """Values that an edit would lose, each once, in order."""
    kept = set(after)
    return list(dict.fromkeys(v for v in before if v not in kept))
