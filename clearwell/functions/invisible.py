"""Invisible characters: native strip, and the strip that keeps those that are content.

An invisible character is content where it does what its script needs: a joiner
between cursive letters, after a virama, or inside an emoji; a presentation
selector after an emoji; a registered variation; a flag's tags; a blank between
cells of its script.  Content has limits, so that it cannot carry a message:
runs of joiners or selectors, their number in a document, and a document with
many other invisible characters keeps none.  A grapheme cluster's content stays
or goes as one.
"""

from __future__ import annotations

import functools
import itertools
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator, Mapping

import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

from .characters import BLANKS, BLANK_RANGES, CLASS_OF, CONTENT_CANDIDATE, FORMAT, FORMAT_RANGES, INVISIBLE, LONG_RUN, SCATTERED, SELECTOR_RANGES, SELECTORS, python_class, regex_class

# --- fixed values: limits of what counts as content ---
JOINER_RUN, SELECTOR_RUN = 8, 8
KEEP_FLOOR, KEEP_CEILING, VISIBLE_PER_KEPT = 16, 64, 8
BLANK_FLOOR, ANCHORS_PER_BLANK = 16, 2
FLAG_REGIONS = ("gbeng", "gbsct", "gbwls")

BOM = "\ufeff"
_ALL = (FORMAT_RANGES, SELECTOR_RANGES, BLANK_RANGES)
_ANY = regex.compile(python_class(*_ALL))
_RUN = regex.compile(python_class(*_ALL) + "{%d,}" % LONG_RUN)
_CANDIDATE = regex.compile(python_class([(0x200C, 0x200D)], SELECTOR_RANGES, [(0xE0000, 0xE007F), (0x115F, 0x1160), (0x2800, 0x2800), (0x3164, 0x3164), (0xFFA0, 0xFFA0)]))
_FLAG = regex.compile("\U0001f3f4((?:" + "|".join("".join(chr(0xE0000 + ord(c)) for c in r) for r in FLAG_REGIONS) + ")\U000e007f)")
_CLUSTER = regex.compile(r"\X")


# ---- native ----


#: A byte-order mark that leads the text is no finding.
_NOT_BOM = r"(?<!\A\x{FEFF})"


def strip(c: Column) -> Column:
    """Every tracked character goes, but a leading byte-order mark."""
    return F.regexp_replace(c, F.lit(INVISIBLE + _NOT_BOM), F.lit(""))


def found(c: Column) -> Column:
    """Categories that c holds beyond a leading byte-order mark, in order."""
    tests = ((FORMAT, FORMAT_RANGES), (SELECTORS, SELECTOR_RANGES), (BLANKS, BLANK_RANGES))
    return F.array_compact(F.array(*(F.when(c.rlike(regex_class(r) + (_NOT_BOM if code == FORMAT else "")), code) for code, r in tests)))


def beyond_ascii(c: Column) -> Column:
    """Tracked characters other than ESC take several bytes: texts of as many bytes as characters have none."""
    return F.octet_length(c) != F.length(c)


def count(c: Column) -> Column:
    return F.when(c.isNull() | beyond_ascii(c), F.regexp_count(c, F.lit(INVISIBLE))).otherwise(0)


def has_any(c: Column) -> Column:
    return beyond_ascii(c) & c.rlike(INVISIBLE)


def has_long_run(c: Column) -> Column:
    return beyond_ascii(c) & c.rlike(INVISIBLE + "{%d,}" % LONG_RUN)


def long_runs(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(" + INVISIBLE + "{%d,}+)" % LONG_RUN), F.lit(1))


def may_have_content(c: Column) -> Column:
    return c.rlike(CONTENT_CANDIDATE)


# ---- with content ----


def _memo(pattern: str):
    test = regex.compile(pattern).match
    return functools.lru_cache(maxsize=8192)(lambda ch: bool(ch) and test(ch) is not None)


_cursive = _memo(r"[\p{jt=D}\p{jt=L}\p{jt=R}]")
_transparent = _memo(r"\p{jt=T}")
_virama = _memo(r"[\p{InSC=Virama}\p{InSC=Invisible_Stacker}]")
_consonant = _memo(r"\p{InSC=Consonant}")
_emoji = _memo(r"\p{Extended_Pictographic}")
_emoji_left = _memo(r"[\p{Extended_Pictographic}\p{Emoji_Modifier}]")
_ideograph = _memo(r"[\p{Unified_Ideograph}\uf900-\ufaff\U0002F800-\U0002FA1F]")
_braille = _memo(r"(?!\u2800)\p{Script=Braille}")
_hangul = _memo(r"(?![\u115f\u1160\u3164\uffa0])\p{Script=Hangul}")
#: Bases that standardized variation sequences are registered for: by block, not pair by pair.
_variant_base = _memo(r"[#*0-9\u1000-\u109f\u2205\u2229\u222a\u2268\u2269\u2272\u2273\u228a\u228b\u2293-\u2295\u2297\u229c\u22da\u22db\u2a3c\u2a3d\u2a9d\u2a9e\u2aac\u2aad\u2acb\u2acc\u3001\u3002\uff01\uff0c\uff0e\uff1a\uff1b\uff1f\ua840-\ua877\u1820-\u18aa\p{Unified_Ideograph}\U00010AC0-\U00010AFF]")

JOINER, EMOJI_SELECTOR, TAG, VARIANT, IDEOGRAPHIC, BLANK = "joiner", "emoji-selector", "tag", "variant", "ideographic", "blank"
#: What counts towards which limit of a stretch.
_LIMIT_OF = {JOINER: JOINER_RUN, VARIANT: SELECTOR_RUN, IDEOGRAPHIC: SELECTOR_RUN}


def _is(ch: str, code: str | None = None) -> bool:
    c = CLASS_OF.get(ord(ch)) if ch else None
    return c is not None and (code is None or c == code)


def kinds(text: str) -> dict[int, str | None]:
    """For each invisible place of a text what content it is, or None."""
    flags = {k for m in _FLAG.finditer(text) for k in range(*m.span(1))}
    out: dict[int, str | None] = {m.start(): None for m in _ANY.finditer(text)}
    for k in out:
        out[k] = TAG if k in flags else _content(text, k)
    for own, anchor in (((0x2800,), _braille), ((0x115F, 0x1160, 0x3164, 0xFFA0), _hangul)):
        kept = [k for k, v in out.items() if v == BLANK and ord(text[k]) in own]
        if len(kept) > BLANK_FLOOR and len(kept) > sum(map(anchor, text)) // ANCHORS_PER_BLANK:
            out.update(dict.fromkeys(kept))
    return out


def _content(text: str, k: int) -> str | None:
    ch, before, after = text[k], text[k - 1 : k] if k else "", text[k + 1 : k + 2]
    if ch in "\u200c\u200d":
        return JOINER if _joins(text, k) else None
    if ch in "\ufe0e\ufe0f":
        return EMOJI_SELECTOR if _emoji_left(before) or before in tuple("0123456789#*") and after == "\u20e3" else None
    if "\ufe00" <= ch <= "\ufe0d":
        return VARIANT if _variant_base(before) else None
    if "\U000e0100" <= ch <= "\U000e01ef":
        return IDEOGRAPHIC if _ideograph(before) else None
    if ch == "\u2800":
        return BLANK if _braille(before) or _braille(after) else None
    if ch in "\u115f\u1160\u3164\uffa0":
        return BLANK if _hangul(before) or _hangul(after) else None
    return None


def _near(text: str, k: int, step: int, skip) -> str:
    k += step
    while 0 <= k < len(text) and skip(text[k]):
        k += step
    return text[k] if 0 <= k < len(text) else ""


def _joins(text: str, k: int) -> bool:
    selector = lambda c: _is(c, SELECTORS)
    if text[k] == "\u200d" and _emoji_left(_near(text, k, -1, selector)) and _emoji(_near(text, k, 1, selector)):
        return True
    if k >= 2 and _virama(text[k - 1]):
        base = _near(text, k - 1, -1, lambda c: regex.match(r"\p{M}", c) is not None and not _virama(c))
        if _consonant(base):
            return True
    skip = lambda c: c not in "\u200c\u200d" and (_transparent(c) or _is(c))
    left, right = (_near(text, k, s, skip) for s in (-1, 1))
    if left in ("\u200c", "\u200d") or right in ("\u200c", "\u200d"):
        return False
    sides = _cursive(left), _cursive(right)
    return all(sides) if text[k] == "\u200c" else any(sides)


def strip_text(text: str, original: str | None = None) -> tuple[str, list[str]]:
    """(text without what is no content, categories removed); a byte-order mark that led the original stays in front."""
    lead = text.startswith(BOM) and (text if original is None else original).startswith(BOM)
    body = text[1:] if lead else text
    if not _CANDIDATE.search(body):
        gone = {CLASS_OF[ord(m.group())] for m in _ANY.finditer(body)}
        body = _ANY.sub("", body) if gone else body
    else:
        body, gone = _keep_content(body)
    return (BOM + body if lead else body), [c for c in (FORMAT, SELECTORS, BLANKS) if c in gone]


def _clusters(body: str, places: list[int]) -> Iterator[list[int]]:
    """The places, by grapheme cluster."""
    bounds = [m.end() for m in _CLUSTER.finditer(body)] if places else []
    for _, group in itertools.groupby(places, key=lambda k: bisect_right(bounds, k)):
        yield list(group)


def _stretches(places: Iterable[int]) -> dict[int, int]:
    """A number for each invisible place; two visible characters in a row end a stretch."""
    out, last, n = {}, -3, 0
    for k in places:
        n += k - last > 2
        out[k] = n
        last = k
    return out


def _keep_content(body: str) -> tuple[str, set[str]]:
    kind = kinds(body)
    kept: set[int] = set()
    if payload_of(kind) < SCATTERED:
        room = min(KEEP_CEILING, max(KEEP_FLOOR, math.ceil((len(body) - len(kind)) / VISIBLE_PER_KEPT)))
        stretch = _stretches(kind)
        used: Counter = Counter()
        for group in _clusters(body, [k for k, v in kind.items() if v not in (None, BLANK)]):
            cost = {of: [k for k in group if kind[k] in of] for of in ((JOINER,), (VARIANT, IDEOGRAPHIC))}
            if len(kept) + len(group) <= room and all(used[stretch[group[0]], of] + len(ks) <= _LIMIT_OF[of[0]] for of, ks in cost.items()):
                kept.update(group)
                used.update((stretch[k], of) for of, ks in cost.items() for k in ks)
        kept |= {k for k, v in kind.items() if v == BLANK}
    gone = [k for k in kind if k not in kept]
    ends = [-1, *gone, len(body)]
    return "".join(body[x + 1 : y] for x, y in zip(ends, ends[1:])), {CLASS_OF[ord(body[k])] for k in gone}


def payload_of(kind: Mapping[int, str | None]) -> int:
    return sum(v is None for v in kind.values())


def strip_mapped(text: str) -> tuple[str, list[int]]:
    """(text without any tracked character, deletions): deletions[k] is the place in the new text before which the k-th went.  For detection only."""
    gone = [m.start() for m in _ANY.finditer(text)]
    return _ANY.sub("", text), [at - k for k, at in enumerate(gone)]


def source_place(deletions: list[int], at: int) -> int:
    """The place in the old text of a place in the new one."""
    return at + bisect_right(deletions, at)


def payload_count(text: str) -> int:
    """Invisible characters that are no content."""
    return payload_of(kinds(text))


def effective_count(text: str) -> int:
    """Invisible characters that are no content, and content over the limits."""
    own = payload_count(text)
    return max(own, len(text) - len(strip_text(text)[0]))


def payload_run(text: str) -> str | None:
    """The first long run of invisible characters that are no content."""
    if not _RUN.search(text):
        return None
    kind = kinds(text)
    view = "".join(ch if k in kind and kind[k] is None else " " for k, ch in enumerate(text))
    m = _RUN.search(view)
    return m.group() if m else None


def runs_of(text: str) -> list[tuple[int, str]]:
    """(place, text) of each long run of invisible characters."""
    return [(m.start(), m.group()) for m in _RUN.finditer(text)]
