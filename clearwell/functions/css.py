"""Whether an inline style hides its element from a reader.

Only what is certain counts: a value that a browser must resolve (``calc()``,
``var()``, unknown units) never hides.
"""

from __future__ import annotations

import colorsys
import functools
import re

# --- fixed values: thresholds ---
NEAR_ZERO = 0.01
FAR_LENGTH, FAR_VIEWPORT = -900, -100
LENGTH_UNITS = frozenset("px em rem ex ch pt pc in cm mm".split())
VIEWPORT_UNITS = frozenset("vw vh vmin vmax %".split())
TURN = {"deg": 360.0, "grad": 400.0, "rad": 6.283185307179586, "turn": 1.0}
#: The colours by name that pages hide text with; other names are compared as names.
NAMED = {"black": (0, 0, 0), "white": (255, 255, 255), "red": (255, 0, 0), "lime": (0, 255, 0), "blue": (0, 0, 255), "yellow": (255, 255, 0), "cyan": (0, 255, 255), "aqua": (0, 255, 255),
         "magenta": (255, 0, 255), "fuchsia": (255, 0, 255), "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192), "maroon": (128, 0, 0), "olive": (128, 128, 0), "green": (0, 128, 0),
         "purple": (128, 0, 128), "teal": (0, 128, 128), "navy": (0, 0, 128), "orange": (255, 165, 0), "snow": (255, 250, 250), "ivory": (255, 255, 240), "whitesmoke": (245, 245, 245)}

_NUMBER = re.compile(r"([+-]?(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?)([a-z%]*)$")


def declarations(style: str) -> dict[str, str]:
    """Property to value, both in lower case, escapes decoded; the last of a property counts, an important one before others."""
    text = re.sub(r"/\*.*?(\*/|$)", " ", style, flags=re.S)
    text = re.sub(r"\\([0-9a-fA-F]{1,6})\s?", lambda m: chr(min(int(m[1], 16), 0x10FFFF)) if int(m[1], 16) not in range(0xD800, 0xE000) else "\ufffd", text)
    text = re.sub(r"\\(.)", r"\1", text)
    out: dict[str, tuple[bool, str]] = {}
    for part in re.findall(r"(?:[^;\"'(]|\"[^\"]*\"?|'[^']*'?|\([^)]*\)?)+", text):
        name, colon, value = part.partition(":")
        name, value = name.strip().lower(), " ".join(value.lower().split())
        if not colon or not value or not re.fullmatch(r"-{0,2}[a-z][a-z0-9-]*", name):
            continue
        strong = bool(re.search(r"!\s*important$", value))
        value = re.sub(r"\s*!\s*important$", "", value)
        if strong or not out.get(name, (False, ""))[0]:
            out[name] = (strong, value)
    return {k: v for k, (_, v) in out.items()}


def number(token: str) -> tuple[float, str] | None:
    m = _NUMBER.match(token.strip())
    return (float(m[1]), m[2]) if m else None


def _zero(token: str | None, units: frozenset = LENGTH_UNITS | VIEWPORT_UNITS) -> bool:
    n = number(token or "")
    return n is not None and (n[1] in units or n[1] == "") and abs(n[0]) < NEAR_ZERO


def _far(token: str | None) -> bool:
    n = number(token or "")
    return n is not None and (n[1] in LENGTH_UNITS and n[0] < FAR_LENGTH or n[1] in VIEWPORT_UNITS and n[0] <= FAR_VIEWPORT)


def arguments(value: str, name: str) -> list[list[str]]:
    """The arguments of each call of a function in a value."""
    return [re.split(r"\s*,\s*|\s+", m.strip()) for m in re.findall(rf"(?:^|[\s,]){re.escape(name)}\(([^()]*)\)", " " + value)]


def colour(value: str | None) -> tuple | None:
    """(r, g, b) as integers, "transparent", or None for what is not certain."""
    v = (value or "").strip()
    if v == "transparent":
        return ("transparent",)
    if v in NAMED:
        return NAMED[v]
    if m := re.fullmatch(r"#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})", v):
        h = m[1] if len(m[1]) > 4 else "".join(c * 2 for c in m[1])
        return ("transparent",) if len(h) == 8 and h[6:] == "00" else tuple(int(h[k : k + 2], 16) for k in (0, 2, 4))
    if m := re.fullmatch(r"(rgb|hsl)a?\(([^()]*)\)", v):
        parts = [p for p in re.split(r"[\s,/]+", m[2].strip()) if p]
        values = [number(p) for p in parts]
        if len(values) not in (3, 4) or None in values:
            return None
        if len(values) == 4 and values[3][0] <= 0:
            return ("transparent",)
        if m[1] == "rgb":
            return tuple(round(n * 2.55 if u == "%" else n) for n, u in values[:3])
        h = values[0][0] / TURN.get(values[0][1] or "deg", 360.0) % 1
        return tuple(round(c * 255) for c in colorsys.hls_to_rgb(h, values[2][0] / 100, values[1][0] / 100))
    return None


def _hides_transform(value: str) -> bool:
    near = lambda t: (n := number(t)) is not None and n[1] in ("", "%") and abs(n[0] / (100 if n[1] == "%" else 1)) < NEAR_ZERO
    for name, places in (("scale", (0, 1)), ("scalex", (0,)), ("scaley", (0,)), ("scale3d", (0, 1)), ("matrix", (0, 3)), ("matrix3d", (0, 5))):
        if any(near(a[k]) for a in arguments(value, name) for k in places if k < len(a)):
            return True
    for name in ("rotatex", "rotatey"):
        for a in arguments(value, name):
            n = number(a[0])
            if n and (n[1] in TURN or n[0] == 0):
                turn = n[0] / TURN.get(n[1], 360.0) % 1
                if min(abs(turn - 0.25), abs(turn - 0.75)) < 1e-3:
                    return True
    return any(_far(t) and not t.endswith("%") for name in ("translate", "translatex", "translatey", "translate3d") for a in arguments(value, name) for t in a[:2])


def _hides_clip(d: dict[str, str]) -> bool:
    if d.get("position") in ("absolute", "fixed"):
        for a in arguments(d.get("clip", ""), "rect"):
            n = [number(t) for t in a]
            if len(n) == 4 and all(n) and (n[0][0] >= n[2][0] or n[3][0] >= n[1][0]):
                return True
    path = d.get("clip-path", "")
    for a in arguments(path, "circle"):
        n = number(a[0])
        if n and n[0] == 0:
            return True
    for m in re.findall(r"inset\(([^()]*)\)", path):
        n = [number(t) for t in m.split("round")[0].split()]
        if n and all(n) and all(u == "%" for _, u in n):
            v = [x for x, _ in n]
            top, right, bottom, left = (v * 4)[:4] if len(v) == 1 else (v * 2)[:4] if len(v) == 2 else [*v, v[1]] if len(v) == 3 else v[:4]
            if min(top, right, bottom, left) >= 50:
                return True
    return False


def _edges(d: dict[str, str], what: str, axis: tuple[str, str]) -> bool:
    """True if padding or border certainly adds nothing on an axis."""
    sides = {"top": 0, "right": 1, "bottom": 2, "left": 3}
    short = d.get(what)
    for side in axis:
        v = d.get(f"{what}-{side}" + ("-width" if what == "border" else ""))
        if v is None and what == "border":
            v = d.get("border-width", short)
            if v is not None and (v == "none" or any(t == "none" for t in v.split())):
                continue
        elif v is None and short is not None:
            parts = short.split()
            v = (parts * 4 if len(parts) == 1 else parts * 2 if len(parts) == 2 else [*parts, parts[1]] if len(parts) == 3 else parts)[sides[side]]
        if v is not None and not any(_zero(t) for t in v.split()):
            return False
    return True


def _hides_box(d: dict[str, str]) -> bool:
    if not any(d.get(k, "").split(" ")[0] in ("hidden", "clip") for k in ("overflow", "overflow-x", "overflow-y")):
        return False
    for sizes, axis in ((("height", "max-height"), ("top", "bottom")), (("width", "max-width"), ("left", "right"))):
        if any(_zero(d.get(s)) for s in sizes) and _edges(d, "padding", axis) and _edges(d, "border", axis):
            return True
    return False


def _hides_colour(d: dict[str, str]) -> bool:
    text = colour(d.get("-webkit-text-fill-color", d.get("color")))
    if text is None:
        return False
    if text == ("transparent",):
        clip = "text" in d.get("background-clip", "") + d.get("-webkit-background-clip", "") + (d.get("background", "") if "url(" in d.get("background", "") or "gradient" in d.get("background", "") else "")
        stroke = d.get("-webkit-text-stroke", d.get("-webkit-text-stroke-color", ""))
        return not clip and not stroke
    if d.get("background-image", "none") != "none" or re.search(r"url\(|gradient\(|image\(", d.get("background", "")):
        return False
    back = d.get("background-color", d.get("background"))
    return back is not None and colour(back) == text


@functools.lru_cache(maxsize=4096)
def hides(style: str) -> bool:
    d = declarations(style)
    if d.get("display") == "none" or d.get("visibility") in ("hidden", "collapse") or d.get("content-visibility") == "hidden":
        return True
    n = number(d.get("opacity", ""))
    if n and n[1] in ("", "%") and n[0] / (100 if n[1] == "%" else 1) < NEAR_ZERO:
        return True
    if _zero(d.get("font-size")) or next((_zero(t.split("/")[0]) for t in d.get("font", "").split() if (k := number(t.split("/")[0])) and k[1]), False):
        return True
    if d.get("position") in ("absolute", "fixed", "relative", "sticky") and any(_far(d.get(s)) for s in ("left", "right", "top", "bottom")):
        return True
    if _far(d.get("text-indent")) or _hides_clip(d):
        return True
    if _hides_transform(d.get("transform", "")) or d.get("scale") and any(number(t) and abs(number(t)[0]) < NEAR_ZERO for t in d["scale"].split()):
        return True
    for a in arguments(d.get("filter", ""), "opacity"):
        n = number(a[0])
        if n and n[0] / (100 if n[1] == "%" else 1) < NEAR_ZERO:
            return True
    return _hides_colour(d) or _hides_box(d)
