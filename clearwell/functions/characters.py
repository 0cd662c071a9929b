"""Code points that text can hide things in.

The ranges are fixed values (Unicode 17.0): they do not follow the Unicode
version of the JVM or of Python, which differ.
"""

from __future__ import annotations

# --- fixed values: general category Cf ---
FORMAT_RANGES = [
    (0xAD, 0xAD), (0x600, 0x605), (0x61C, 0x61C), (0x6DD, 0x6DD), (0x70F, 0x70F), (0x890, 0x891), (0x8E2, 0x8E2),
    (0x180E, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF),
    (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F), (0x1BCA0, 0x1BCA3),
    (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
]
# --- fixed values: variation selectors ---
SELECTOR_RANGES = [(0x180B, 0x180D), (0x180F, 0x180F), (0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
# --- fixed values: characters that render as nothing ---
BLANK_RANGES = [(0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x2800, 0x2800), (0x3164, 0x3164), (0xFFA0, 0xFFA0)]
# --- fixed values: ESC and the C1 block ---
INTRODUCER_RANGES = [(0x1B, 0x1B), (0x80, 0x9F)]

#: Category codes in the order in which they are reported.
FORMAT, SELECTORS, BLANKS = "cf-format", "variation-selectors", "blank-fillers"
ANSI, SURROGATES = "ansi", "lone-surrogates"
COMMENTS, HIDDEN, EXFIL, CONFUSABLE = "html-comments", "hidden-html", "exfil-urls", "confusable-host"
LABELS = {
    FORMAT: "Format chars (Cf)", SELECTORS: "Variation selectors", BLANKS: "Blank-rendering fillers", ANSI: "ANSI escapes",
    SURROGATES: "Lone UTF-16 surrogates", COMMENTS: "HTML comments", HIDDEN: "hidden HTML", EXFIL: "exfil URLs", CONFUSABLE: "confusable hosts",
}
LAYER = {FORMAT: 1, SELECTORS: 1, BLANKS: 1, ANSI: 1, SURROGATES: 1, COMMENTS: 2, HIDDEN: 2, EXFIL: 3, CONFUSABLE: 3}
#: Code points in a row from which a run can carry a message, and in all from which scattered ones can.
LONG_RUN, SCATTERED = 10, 30

CLASS_OF = {cp: code for code, ranges in ((FORMAT, FORMAT_RANGES), (SELECTORS, SELECTOR_RANGES), (BLANKS, BLANK_RANGES)) for a, b in ranges for cp in range(a, b + 1)}


def regex_class(*groups: list[tuple[int, int]], negate: bool = False) -> str:
    """A character class that Java, RE2 and Python's regex all read as \\x{...} ranges."""
    parts = [f"\\x{{{a:X}}}" + (f"-\\x{{{b:X}}}" if b > a else "") for g in groups for a, b in g]
    return f"[{'^' if negate else ''}{''.join(parts)}]"


def python_class(*groups: list[tuple[int, int]], negate: bool = False) -> str:
    parts = [f"\\U{a:08X}" + (f"-\\U{b:08X}" if b > a else "") for g in groups for a, b in g]
    return f"[{'^' if negate else ''}{''.join(parts)}]"


INVISIBLE = regex_class(FORMAT_RANGES, SELECTOR_RANGES, BLANK_RANGES)
INTRODUCER = regex_class(INTRODUCER_RANGES)
TRACKED = regex_class(INTRODUCER_RANGES, FORMAT_RANGES, SELECTOR_RANGES, BLANK_RANGES)
#: Characters that may be content in the right place: joiners, selectors, tags, gated blanks.
CONTENT_CANDIDATE = regex_class([(0x200C, 0x200D)], SELECTOR_RANGES, [(0xE0000, 0xE007F), (0x115F, 0x1160), (0x2800, 0x2800), (0x3164, 0x3164), (0xFFA0, 0xFFA0)])
