"""Hidden HTML and comments, reported tags, and the URLs of markup.

A compact tokenizer gives tags with their places; it follows the HTML standard
for comments, raw text, void elements and attributes, and ends what is left open
at the end of its parent.  Adoption and table foster-parenting are not done.
Markdown code, fenced or indented, is text and holds no tags.
"""

from __future__ import annotations

import html as entities
import re
from typing import NamedTuple

from .css import hides
from .spans import Pair, Span, merge, restore, splice

ROUNDS = 8
LABELS = {"comment": "HTML comment", "hidden": "hidden HTML"}
UNPARSEABLE = "unparseable HTML"
# --- fixed values: element groups ---
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
REPORTED = ("script", "style", "object", "embed", "iframe", "svg", "math")
FOREIGN = frozenset(["svg", "math"])
URL_ATTRIBUTES = ("src", "href", "background", "action", "formaction")

_ATTRIBUTES = r"(?:[^>\"'=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=|\"|')*"
_TOKEN = re.compile(rf"<!--(?:>|->|.*?(?:--!?>|\Z))|<!(?i:doctype)[^>]*>?|<[!?][^>]*>?|</[^a-zA-Z>][^>]*>?|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>{_ATTRIBUTES})(?P<end>>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")


class Tag(NamedTuple):
    start: int
    end: int
    name: str
    closing: bool
    attributes: dict[str, str]


class Scan(NamedTuple):
    spans: list[Span]
    tags: dict[str, int]
    data_sources: int


def code_ranges(text: str) -> list[tuple[int, int]]:
    """Where Markdown says a text is code; a text that begins with markup is no Markdown."""
    if re.match(r"\s*<(?:!|html|head|body|div|p|table|span|section|article)\b", text, re.I):
        return []
    out, at, fence, blank = [], 0, None, True
    for line in text.splitlines(keepends=True):
        m = _FENCE.match(line)
        if fence:
            out.append((at, at + len(line)))
            if m and m[1][0] == fence[0] and len(m[1]) >= len(fence) and not line.strip().strip(fence[0]):
                fence = None
        elif m:
            fence = m[1]
            out.append((at, at + len(line)))
        elif blank and line.strip() and (line.startswith("    ") or line.startswith("\t")):
            out.append((at, at + len(line)))
            at += len(line)
            continue  # an indented block goes on
        blank = not line.strip()
        at += len(line)
    if "`" in text:
        out += [m.span() for m in re.finditer(r"(?<!`)(`+)(?!`)[^`].*?(?<!`)\1(?!`)", text)]
    return sorted(out)


def attributes(rest: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def tokens(text: str) -> tuple[list[Tag], list[Span]]:
    """(tags, comments) of a text; comments are proper and bogus ones, no doctype."""
    code = code_ranges(text)
    tags, comments, at, c = [], [], 0, 0
    while m := _TOKEN.search(text, at):
        start, end = m.span()
        while c < len(code) and code[c][1] <= start:
            c += 1
        if c < len(code) and code[c][0] <= start:
            at = code[c][1]
            continue
        at = max(end, start + 1)
        if not m["name"]:
            if not m[0][:9].lower().startswith("<!doctype"):
                comments.append(Span(start, end, "comment"))
            continue
        name = m["name"].lower()
        tags.append(Tag(start, end, name, bool(m["close"]), {} if m["close"] else attributes(m["rest"])))
        if name in RAW and not m["close"]:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(text, at)
            at = close.start() if close else len(text)
    return tags, comments


def is_hidden(tag: Tag) -> bool:
    return "hidden" in tag.attributes or hides(tag.attributes.get("style", ""))


def scan(text: str) -> Scan:
    """Spans to take out, in order and not yet merged, and what is only reported."""
    tags, spans = tokens(text)
    counts: dict[str, int] = {}
    data, stack = 0, []  # stack: (name, start of a hidden element or None)
    for t in tags:
        if t.closing:
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == t.name), None)
            if k is not None:
                for name, start in stack[k + 1 :]:
                    if start is not None:
                        spans.append(Span(start, t.start, "hidden"))
                if stack[k][1] is not None:
                    spans.append(Span(stack[k][1], t.end, "hidden"))
                del stack[k:]
            continue
        inside = any(start is not None for _, start in stack)
        hidden = not inside and is_hidden(t)
        if not hidden and not inside:
            if t.name in REPORTED:
                counts[t.name] = counts.get(t.name, 0) + 1
            if re.match(r"\s*data:", t.attributes.get("src", ""), re.I):
                data += 1
        alone = t.name in VOID or text[t.end - 2 : t.end] == "/>" and (t.name in FOREIGN or any(n in FOREIGN for n, _ in stack))
        if alone:
            if hidden:
                spans.append(Span(t.start, t.end, "hidden"))
        else:
            stack.append((t.name, t.start if hidden else None))
    spans += [Span(start, len(text), "hidden") for _, start in stack if start is not None]
    hidden = merge([s for s in spans if s.kind == "hidden"])
    # A comment inside a hidden element goes with it.
    out = [s for s in spans if s.kind == "hidden" or not any(h.start <= s.start and s.end <= h.end for h in hidden)]
    return Scan(sorted(out), counts, data)


class Clean(NamedTuple):
    text: str
    pairs: list[Pair]
    comments: int
    hidden: int
    tags: dict[str, int]
    data_sources: int


def sanitize(text: str) -> Clean:
    """text with comments and hidden elements behind placeholders, scanned anew until nothing is left to take."""
    first = None
    comments = hidden = 0
    view, pairs = text, []
    for _ in range(ROUNDS):
        found = scan(view)
        first = first or found
        spans = merge(found.spans)
        comments += sum(s.kind == "comment" for s in found.spans)
        hidden += sum(s.kind == "hidden" for s in found.spans)
        if not spans:
            return Clean(view, pairs, comments, hidden, first.tags, first.data_sources)
        # A later round's span may hold placeholders of an earlier one: it is taken in the text as given.
        wide = [Span(_source(pairs, s.start, False), _source(pairs, s.end, True), s.kind) for s in spans]
        kept = [Span(p_start, p_start + len(p.original), "comment" if p.placeholder.startswith("[HTML comment") else "hidden") for p, p_start in _sources(pairs)]
        view, pairs = splice(text, merge([*kept, *wide]), LABELS)
    view, pairs = splice(text, [Span(0, len(text), "all")], {"all": UNPARSEABLE})
    return Clean(view, pairs, comments, hidden, first.tags, first.data_sources)


def _sources(pairs: list[Pair]) -> list[tuple[Pair, int]]:
    out, shift = [], 0
    for p in pairs:
        out.append((p, p.start + shift))
        shift += len(p.original) - len(p.placeholder)
    return out


def _source(pairs: list[Pair], at: int, end: bool) -> int:
    shift = 0
    for p in pairs:
        if at <= p.start:
            break
        if at < p.start + len(p.placeholder):
            return p.start + shift + (len(p.original) if end else 0)
        shift += len(p.original) - len(p.placeholder)
    return at + shift


class Url(NamedTuple):
    url: str
    is_image: bool
    auto_fetched: bool
    context: str


_INLINE = re.compile(r"(!?)\[((?:[^\[\]\\]|\\.|\[[^\[\]]*\])*)\]\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_DEFINITION = re.compile(r"^ {0,3}\[[^\[\]\n]+\]:\s*(?:<([^<>\n]*)>|(\S+))", re.M)
_BARE = re.compile(r"(?:(?<=[\s(<*_~\"'])|^)(?:https?://|www\.)[^\s<>\"']+", re.I | re.M)


def urls(text: str) -> list[Url]:
    """URLs of links, images, definitions, bare addresses and attributes, in that order of kinds, each by place."""
    code = code_ranges(text)
    inside = lambda k: any(a <= k < b for a, b in code)
    out: list[Url] = []
    for m in _INLINE.finditer(text):
        if not inside(m.start()):
            out.append(Url(entities.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", m[3] if m[3] is not None else m[4] or "")), m[1] == "!", m[1] == "!", "markdown"))
    for m in _DEFINITION.finditer(text):
        if not inside(m.start()):
            out.append(Url(entities.unescape(m[1] if m[1] is not None else m[2]), False, False, "definition"))
    tags, _ = tokens(text)
    spans = [(t.start, t.end) for t in tags] + [m.span() for p in (_INLINE, _DEFINITION) for m in p.finditer(text)]
    for m in _BARE.finditer(text):
        if not inside(m.start()) and not any(a <= m.start() < b for a, b in spans):
            url = m[0].rstrip("?!.,:*_~'\")")
            out.append(Url(url if "://" in url else "http://" + url, False, False, "autolink"))
    for t in tags:
        a = t.attributes
        for name in URL_ATTRIBUTES:
            if a.get(name, "").strip():
                out.append(Url(a[name].strip(), t.name == "img" and name == "src", not (t.name == "a" and name == "href"), f"{t.name}[{name}]"))
        for url in source_set(a.get("srcset", "")):
            out.append(Url(url, t.name == "img", True, f"{t.name}[srcset]"))
        for url in a.get("ping", "").split():
            out.append(Url(url, False, True, f"{t.name}[ping]"))
        if t.name == "meta" and a.get("http-equiv", "").strip().lower() == "refresh" and (url := refresh_url(a.get("content", ""))):
            out.append(Url(url, False, True, "meta[refresh]"))
    return out


def source_set(value: str) -> list[str]:
    """The URLs of a srcset: candidates end at commas outside parentheses; a URL's own trailing commas end it."""
    out, at = [], 0
    while m := re.compile(r"[\s,]*(\S+)").match(value, at):
        url, at = m[1], m.end()
        if url.endswith(","):
            url = url.rstrip(",")
        else:
            at = re.compile(r"(?:[^,(]|\([^)]*\)?)*").match(value, at).end()
        if url:
            out.append(url)
    return out


def refresh_url(content: str) -> str | None:
    m = re.match(r"\s*[\d.]+\s*[;,\s]\s*(?:url\s*=\s*)?(?:\"([^\"]*)\"?|'([^']*)'?|(.*))$", content, re.I | re.S)
    return next((g.strip() for g in m.groups() if g), None) if m else None


__all__ = ["Clean", "Scan", "Tag", "Url", "code_ranges", "restore", "sanitize", "scan", "tokens", "urls"]
