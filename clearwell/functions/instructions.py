"""Instruction files: hidden runs in them, decoded and made safe to print; and verdicts on prompts."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from . import ansi, invisible
from .characters import ANSI, BLANKS, CLASS_OF, FORMAT, LABELS, LONG_RUN, SCATTERED, SELECTORS

BITS_SHOWN = 80


class Finding(NamedTuple):
    line: int | None
    char_count: int
    method: str
    decoded: str


def decode_run(run: str) -> tuple[str, str]:
    """(method, text) of a hidden run: tags spell ASCII, zero-width characters bits, the rest is listed by code point."""
    tags = [chr(ord(c) - 0xE0000) for c in run if 0xE0020 <= ord(c) <= 0xE007E]
    bits = [{"\u200b": "0", "\u200c": "1", "\u200d": "|"}[c] for c in run if c in "\u200b\u200c\u200d"]
    if 2 * len(tags) > len(run):
        return "tag-ascii", "".join(tags)
    if 2 * len(bits) > len(run):
        return "zero-width-binary", "".join(bits)[:BITS_SHOWN] + ("…" if len(bits) > BITS_SHOWN else "")
    return ("mixed" if tags or bits else "code-points"), " ".join(f"U+{ord(c):04X}" for c in run[:16])


def printable(text: str) -> str:
    """text with backslashes, quotes and what does not print as \\xNN."""
    return "".join(c if " " <= c <= "~" and c not in '\\"' else "".join(f"\\x{b:02x}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def scan(content: str) -> list[Finding]:
    """A finding for each long run, and one for the file where what is scattered besides adds up."""
    out, inside = [], 0
    for at, run in invisible.runs_of(content):
        inside += len(run)
        method, text = decode_run(run)
        out.append(Finding(content.count("\n", 0, at) + 1, len(run), method, printable(text)))
    rest = invisible.payload_count(content) - inside
    if rest >= SCATTERED:
        out.append(Finding(None, rest, "scattered", ""))
    return out


def clean(content: str) -> tuple[str, bool]:
    """(text without invisible characters, True) if a scan finds anything, else (content, False)."""
    if not scan(content):
        return content, False
    cleaned = invisible.strip_text(content)[0]
    return cleaned, cleaned != content


def may_carry(text: str) -> bool:
    """True for authored text with a long run or as many invisible characters as can carry a message."""
    return bool(invisible.runs_of(text)) or sum(ord(c) in CLASS_OF for c in text) >= SCATTERED


def classify_prompt(prompt: str, strip: Callable[[str], str] | None = None) -> tuple[str, str | None]:
    """(pass, note or block, reason)."""
    from ..operators import layer1

    if not prompt:
        return "pass", None
    escapes = any(c == "\x1b" or "\x80" <= c <= "\x9f" for c in prompt)
    plain = strip(prompt) if strip else ansi.strip_text(prompt, {})
    run, n = invisible.payload_run(plain), invisible.effective_count(plain)
    if run is None and n < SCATTERED:
        if not escapes:
            return "pass", None
        if layer1.is_inert(layer1.clean_text(prompt)[3]):
            return "note", None
    held = {CLASS_OF[ord(c)] for c in plain if ord(c) in CLASS_OF}
    names = [LABELS[c] for c in (FORMAT, SELECTORS, BLANKS) if c in held] + ([LABELS[ANSI]] if escapes else [])
    reason = f"Detected: {', '.join(names)}. Invisible char count: {n} (long-run threshold: {LONG_RUN}, scattered threshold: {SCATTERED})."
    if run:
        reason += f" Long-run sample (first 16 code points): {' '.join(f'U+{ord(c):04X}' for c in run[:16])}."
    return "block", reason + " Resubmit the prompt with invisible/ANSI characters removed."


__all__ = ["Finding", "classify_prompt", "clean", "decode_run", "may_carry", "printable", "scan"]
