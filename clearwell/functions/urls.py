"""URLs that carry data away, and hosts that look like others."""

from __future__ import annotations

import functools
import re
import unicodedata
from typing import NamedTuple
from urllib.parse import unquote_to_bytes

from .secrets import names_credential

# --- fixed values: limits and names ---
LONG_PART, LONG_DATA, LONG_SEGMENT = 200, 4096, 128
KEYWORDS = frozenset("data d payload exfil leak steal secret token key env password pwd cookie session auth".split())
BENIGN = frozenset(
    "sig signature hmac policy credential expires key-pair-id skoid sktid code state cursor after before continuation continuationtoken continuation_token pagetoken page_token nexttoken next_token "
    "gclid fbclid dclid msclkid gbraid wbraid _ga _gl mc_eid mc_cid".split()
)
BENIGN_FAMILIES = re.compile(r"x-(?:amz|goog|ms|oss|obs)-[a-z0-9-]+|amz-[a-z0-9-]+|utm_[a-z]+")
BENIGN_SHORT = frozenset("se sp sr sv st spr si".split())
ACTIVE_TYPES = ("text/html", "image/svg+xml", "application/javascript", "application/ecmascript", "application/xhtml+xml")

ACTIVE, OVERSIZED, SCRIPT = "active-content data: URI", "oversized inline data: payload", "script-executing URI"
PARAMETER, CREDENTIAL, USERINFO = "suspicious query parameter", "credential-shaped token in URL parameter", "embedded credentials"
QUERY, FRAGMENT, PATH = "unusually long query string", "unusually long fragment", "encoded data blob in path segment"
SENTINEL = "URL scan failed"

_SPECIAL = ("http", "https", "ws", "wss", "ftp", "file")


class Parts(NamedTuple):
    """A URL split as browsers split it; host is None for a relative one."""

    scheme: str
    userinfo: str
    host: str | None
    path: str
    query: str
    fragment: str


def split(url: str) -> Parts | None:
    """The parts of a URL, or None where a browser would refuse it."""
    url = re.sub(r"[\t\n\r]", "", url).strip("".join(map(chr, range(33))))
    m = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", url)
    scheme, rest = (m[1].lower(), url[m.end() :]) if m else ("", url)
    rest, _, fragment = rest.partition("#")
    rest, _, query = rest.partition("?")
    if scheme in _SPECIAL or not scheme:
        rest = rest.replace("\\", "/")
    slashes = re.match(r"/*", rest).end()
    if scheme in _SPECIAL[:-1] or slashes >= 2:
        authority, _, path = rest[slashes if scheme in _SPECIAL else 2 :].partition("/")
        userinfo, _, host = authority.rpartition("@")
        m = re.fullmatch(r"(\[[0-9a-fA-F:.]+\]|[^:]*)(?::(\d*))?", host)
        if not m or not m[1] and scheme in _SPECIAL[:-1] or re.search(r"[\x00-\x20#%/<>?@\[\\\]^|]", m[1].strip("[]")) or m[2] and int(m[2]) > 65535:
            return None
        name = ascii_host(m[1].lower())
        port = m[2] if m[2] and (scheme, m[2]) not in (("http", "80"), ("https", "443"), ("ftp", "21"), ("ws", "80"), ("wss", "443")) else ""
        return Parts(scheme or "http", userinfo, name + (f":{int(port)}" if port else ""), "/" + path, query, fragment)
    return Parts(scheme or "http", "", None, rest, query, fragment)


def ascii_host(host: str) -> str:
    if host.isascii():
        return host
    host = unicodedata.normalize("NFKC", host)
    return ".".join(p if p.isascii() else "xn--" + p.encode("punycode").decode() for p in re.split(r"[.\u3002\uff0e\uff61]", host))


def is_blob(value: str) -> bool:
    """Base64 of 40 characters or more, hex of 32 or more, or URL-safe base64 of 40 or more with a capital and a digit."""
    if re.fullmatch(r"[A-Za-z0-9+/]{40,}={0,2}|[A-Fa-f0-9]{32,}", value):
        return True
    return bool(re.fullmatch(r"[A-Za-z0-9_-]{40,}={0,2}", value)) and _mixed(value)


def _mixed(value: str) -> bool:
    return any("A" <= c <= "Z" for c in value) and any("0" <= c <= "9" for c in value)


def _decoded(value: str) -> str:
    if re.search(r"%(?![0-9a-fA-F]{2})", value):
        return ""
    try:
        return unquote_to_bytes(value).decode()
    except UnicodeDecodeError:
        return ""


def parameters(query: str) -> list[tuple[str, str]]:
    """(name, value) of each part between & or ;, nothing decoded."""
    pairs = (p.partition("=") for p in re.split(r"[&;]", query) if p)
    return [(n, v) for n, _, v in pairs]


def _benign(name: str) -> bool:
    return name.lower() in BENIGN or BENIGN_FAMILIES.fullmatch(name.lower()) is not None


def parameter_reason(name: str, value: str) -> str | None:
    if _benign(name):
        return None
    for part in filter(None, (name, value)):
        if any(re.search(r"\d", run) and names_credential(run) for run in re.findall(r"[A-Za-z0-9_]{20,}", part)):
            return CREDENTIAL
        if is_blob(part) or is_blob(_decoded(part)):
            return PARAMETER
    return None


def _segment_is_blob(segment: str) -> bool:
    joined = re.sub(r"[.,]", "", segment)
    plain = r"[A-Za-z0-9+/]+={0,2}"
    safe = r"[A-Za-z0-9_-]{40,}={0,2}"
    if len(segment) > LONG_SEGMENT and joined == segment:
        return bool(re.fullmatch(plain, segment)) or bool(re.fullmatch(safe, segment)) and _mixed(segment)
    return joined != segment and len(joined) > LONG_SEGMENT and _mixed(joined) and bool(re.fullmatch(f"{plain}|{safe}", joined))


def exfil_reason(url: str) -> str | None:
    """Why a URL looks as if it carried data away; the first reason that holds."""
    flat = re.sub(r"[\t\n\r]", "", url).lstrip()
    scheme = flat.split(":", 1)[0].lower() if ":" in flat else ""
    if scheme == "data":
        kind = re.match(r"data:([^;,]*)[;,]", flat, re.I)
        return ACTIVE if kind and kind[1].lower() in ACTIVE_TYPES else OVERSIZED if len(url) > LONG_DATA else None
    if scheme in ("javascript", "vbscript"):
        return SCRIPT
    tail = re.search(r"[?#].*", url, re.S)
    if tail:
        if re.search(r"\$\{[^{}]+\}|\{\{[^{}]+\}\}", tail[0]):
            return PARAMETER
        for part in tail[0][1:].split("#"):
            for name, value in parameters(part):
                if name.lower() in KEYWORDS and (reason := parameter_reason(name, value)):
                    return reason
    parts = split(url)
    if parts is None:
        return None
    if parts.userinfo.strip(":"):
        return USERINFO
    named = [n.lower() for n, _ in parameters(parts.query)]
    if len(parts.query) + 1 > LONG_PART and not all(_benign(n) or n in BENIGN_SHORT for n in named):
        return QUERY
    if len(parts.fragment) + 1 > LONG_PART:
        return FRAGMENT
    for name, value in parameters(parts.query) + parameters(parts.fragment):
        if reason := parameter_reason(name, value):
            return reason
    return PATH if any(map(_segment_is_blob, parts.path.split("/"))) else None


def target(url: str) -> str:
    """What to call a URL's target; never its path, query or fragment."""
    if re.match(r"\s*data:", url, re.I):
        return "(inline data: URI)"
    parts = split(url)
    if parts is None:
        return "(unparsable URL)"
    return "(relative URL)" if parts.host is None and not re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*:", url) else parts.host or ""


def is_off_origin(url: str) -> bool:
    parts = split(url)
    return parts is not None and (parts.host is not None or re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*:", url) is not None)


# ---- look-alikes ----


@functools.cache
def look_alikes() -> dict[str, str]:
    """Single letters of other scripts to the ASCII letter that they look like.

    Compatibility forms come from Unicode's own decompositions; the rest are the
    usual Cyrillic, Greek and Armenian look-alikes.
    """
    # --- fixed values: look-alike letters ---
    rows = {
        "a": "\u0430\u03b1\u0251", "b": "\u042c\u13cf", "c": "\u0441\u03f2\u1d04", "d": "\u0501\u217e", "e": "\u0435\u212e\u04bd", "g": "\u0261\u0581", "h": "\u04bb\u0570", "i": "\u0456\u03b9\u0131\u04cf", "j": "\u0458\u03f3",
        "k": "\u043a\u03ba", "l": "\u217c\u2113", "n": "\u0578\u057c", "o": "\u043e\u03bf\u0585\u0d20", "p": "\u0440\u03c1", "q": "\u051b\u0566", "r": "\u0433\u1d26", "s": "\u0455\u1d22", "t": "\u0442\u03c4", "u": "\u057d\u03c5\u1d1c",
        "v": "\u03bd\u0475\u1d20", "w": "\u051d\u0561\u1d21", "x": "\u0445\u03c7", "y": "\u0443\u03b3\u04af", "z": "\u1d22", "A": "\u0410\u0391", "B": "\u0412\u0392", "C": "\u0421\u03f9", "E": "\u0415\u0395", "H": "\u041d\u0397",
        "I": "\u0406\u0399", "J": "\u0408", "K": "\u041a\u039a", "M": "\u041c\u039c", "N": "\u039d", "O": "\u041e\u039f", "P": "\u0420\u03a1", "S": "\u0405", "T": "\u0422\u03a4", "X": "\u0425\u03a7", "Y": "\u04ae\u03a5", "Z": "\u0396", "-": "\u2010\u2011\u2012\u2013", "/": "\u2044\u2215", ".": "\u2024",
    }
    out = {c: latin for latin, row in rows.items() for c in row}
    for first, last in ((0xFF01, 0xFF5E), (0x1D400, 0x1D7FF), (0x2100, 0x214F)):
        for cp in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(cp))
            if len(plain) == 1 and plain.isascii() and plain != chr(cp):
                out.setdefault(chr(cp), plain)
    return out


def _script(ch: str) -> str:
    if ch.isascii() or not ch.isalpha():
        return "" if not ch.isalpha() else "LATIN"
    return unicodedata.name(ch, "UNKNOWN").split()[0]


def label_tier(label: str) -> tuple[str, str] | None:
    """(warning, what it reads as) for a label that reads as ASCII; (note, ...) for one that mixes scripts; None otherwise."""
    if label.isascii():
        return None
    table = look_alikes()
    read = "".join(table.get(c, c) for c in unicodedata.normalize("NFC", label))
    if read.isascii():
        return "warning", read
    scripts = {_script(c) for c in label} - {""}
    if scripts & {"CJK", "HIRAGANA", "KATAKANA", "HANGUL"}:
        scripts -= {"CJK", "HIRAGANA", "KATAKANA", "HANGUL", "LATIN"} if not scripts & {"CYRILLIC", "GREEK"} else set()
    return ("note", read) if len(scripts) > 1 else None


def host_tier(url: str) -> tuple[str, str, str, str] | None:
    """(severity, ASCII host, host, what it reads as) of a URL's host, by its loudest label."""
    parts = split(url if re.match(r"\s*[a-zA-Z][a-zA-Z0-9+.-]*:", url) else "http://" + url if not url.startswith("//") else "http:" + url)
    if parts is None or not parts.host or "xn--" not in parts.host:
        return None
    host = parts.host.rsplit(":", 1)[0] if re.search(r":\d+$", parts.host) else parts.host
    labels = []
    for p in host.split("."):
        try:
            labels.append(p[4:].encode().decode("punycode") if p.startswith("xn--") else p)
        except UnicodeError:
            labels.append(p)
    tiers = [label_tier(p) for p in labels]
    loud = next((t for t in tiers if t and t[0] == "warning"), None) or next((t for t in tiers if t), None)
    if loud is None:
        return None
    return loud[0], host, ".".join(labels), ".".join(t[1] if t else p for t, p in zip(tiers, labels, strict=True))


def fold_text(text: str) -> tuple[str, list[tuple[int, str, str]]]:
    """(text, (place, glyph, letter) of each fold): look-alikes inside a token of more than one character, all of whose foreign characters look like ASCII."""
    table, out, folds = look_alikes(), list(text), []
    for m in re.finditer(r"(?:[A-Za-z0-9]|[^\x00-\x7f])+", text):
        foreign = [k for k in range(*m.span()) if not text[k].isascii()]
        if foreign and m.end() - m.start() > 1 and all(text[k] in table for k in foreign):
            for k in foreign:
                out[k] = table[text[k]]
                folds.append((k, text[k], out[k]))
    return "".join(out), folds


def fold_found(text: str, found: list[tuple[int, str, str]]) -> tuple[str, list[tuple[int, str, str]]]:
    """(text, folds) by what another scanner found; each find must be a glyph beyond ASCII that stands where it says, with an ASCII character for it."""
    out = list(text)
    for at, glyph, latin in found:
        if not 0 <= at < len(text):
            raise ValueError("a find lies outside the text")
        if len(glyph) != 1 or glyph.isascii() or text[at] != glyph:
            raise ValueError("a find does not stand where it says")
        if len(latin) != 1 or not latin.isascii() or not latin.isprintable():
            raise ValueError("a find has no ASCII character for it")
        out[at] = latin
    return "".join(out), sorted(found)


def describe_folds(folds: list[tuple[int, str, str]], most: int = 8) -> str:
    seen = list(dict.fromkeys(f'U+{ord(g):04X} → "{x}"' for _, g, x in folds))
    return ", ".join(seen[:most]) + (", …" if len(seen) > most else "")
