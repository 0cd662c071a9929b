"""Pure functions: fixed cases, and properties over an alphabet of what they look for."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clearwell.functions import ansi, css, html, instructions, invisible, secrets, spans, urls
from clearwell.functions.characters import CLASS_OF
from clearwell.operators import layer1

THREATS = "\x1b\x9b\x9d\x07\u200b\ufe0f\u3164\u2800\u034f\u200c\u200d\U000e0041\U0001f600"
text = st.text(st.sampled_from(THREATS + "ab [;m]0\n\u0645\u0915\u094d\u2764"), max_size=60)
markup = st.lists(st.sampled_from(["<b>", "</b>", "<p hidden>", "</p>", "<!-- c -->", "<!x>", "<div style='display:none'>", "</div>", "text ", "<img src=data:x>", "<script>", "</script>", "<", "-->", "`a`", "\n\n", "    code <b>"]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(text)
def test_layer1_deletes_only_and_settles(t):
    cleaned, _, found, kinds = layer1.clean_text(t)
    rest = iter(t)
    assert all(c in rest for c in cleaned)
    assert layer1.clean_text(cleaned)[0] == cleaned
    assert not any(c == "\x1b" or "\x80" <= c <= "\x9f" for c in cleaned)
    assert bool(found) == (cleaned != t) and cleaned.count("\n") == t.count("\n") and bool(kinds) == ("ansi" in found)


@settings(max_examples=200, deadline=None)
@given(text)
def test_scan_is_disjoint_and_one_for_each_introducer(t):
    tokens = ansi.scan(t)
    assert all(a.end <= b.start for a, b in zip(tokens, tokens[1:])) and all(t[x.start] == "\x1b" or "\x80" <= t[x.start] <= "\x9f" for x in tokens)
    assert all(any(x.start <= k < x.end for x in tokens) for k, c in enumerate(t) if c == "\x1b" or "\x80" <= c <= "\x9f")


@pytest.mark.parametrize(
    ("given_", "want", "found"),
    [
        ("a\u200bb", "ab", ["cf-format"]), ("a\u202eevil\u202cb", "aevilb", ["cf-format"]), ("a\u200d\u200db", "ab", ["cf-format"]), ("\ufefftext", "\ufefftext", []),
        ("\x1b[31mred\x1b[0m", "red", ["ansi"]), ("\x1b[2Jwipe", "wipe", ["ansi"]), ("a\u200b\x1b[1mB\x1b[0m\u2060c", "aBc", ["cf-format", "ansi"]),
        ("a\U000e0041\U000e0042b", "ab", ["cf-format"]), ("a\ufe0fb", "ab", ["variation-selectors"]), ("a\x9b2Jb\x9d0;evil\x9cc\x90d", "abc", ["ansi"]),
        ("before\x1b_hidden-cmd\x1b\\after", "beforeafter", ["ansi"]), ("x\n\x1b]0;dangling", "x\n", ["ansi"]), ("\x1b[2024 report", "[2024 report", ["ansi"]),
        ("\x1b\u200b[32mx", "x", ["cf-format", "ansi"]), ("\u845b\U000e0100", "\u845b\U000e0100", []), ("\u2764\ufe0f", "\u2764\ufe0f", []),
        ("\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", "\u0645\u06cc\u200c\u062e\u0648\u0627\u0647\u0645", []), ("\u0915\u094d\u200d\u0937", "\u0915\u094d\u200d\u0937", []),
        ("\U0001f468\u200d\U0001f469\u200d\U0001f467", "\U0001f468\u200d\U0001f469\u200d\U0001f467", []), ("plain", "plain", []),
    ],
)
def test_layer1_cases(given_, want, found):
    assert layer1.clean_text(given_)[0] == want and layer1.clean_text(given_)[2] == found


def test_content_has_limits():
    flag = "\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in "gbsct") + "\U000e007f"
    assert layer1.clean_text(flag)[0] == flag
    joined = "\u200d".join("\u0645" * 40)
    kept = layer1.clean_text(joined)[0].count("\u200d")
    assert 0 < kept <= 8
    assert "\u200d" not in layer1.clean_text("\u200b" * 30 + "\u0645\u200d\u0645")[0]
    assert invisible.payload_run("a" + "\u200b" * 10) == "\u200b" * 10 and invisible.payload_run("\u2764\ufe0f" * 12) is None


def test_lone_surrogates():
    assert layer1.clean_units([0x61, 0xD800, 0x62, 0xDC00]) == ([0x61, 0xFFFD, 0x62, 0xFFFD], ["lone-surrogates"])
    assert layer1.clean_units([0xD83D, 0xDE00]) == ([0xD83D, 0xDE00], [])


@settings(max_examples=300, deadline=None)
@given(markup)
def test_html_splices_restore_and_settle(t):
    c = html.sanitize(t)
    assert html.restore(c.text, c.pairs) == t
    assert html.sanitize(c.text).text == c.text
    assert all(c.text[p.start : p.start + len(p.placeholder)] == p.placeholder for p in c.pairs)


def test_html_cases():
    c = html.sanitize("a <!-- one --> b <span hidden>SECRET</span> c")
    assert c.text == "a [HTML comment removed #9a65a667b62d] b [hidden HTML removed #3c3186827cae] c" and (c.comments, c.hidden) == (1, 1)
    c = html.sanitize('<script>a</script><script>b</script><img src="data:text/html,x">')
    assert c.text.startswith("<script>") and c.tags == {"script": 2} and c.data_sources == 1
    assert html.sanitize("```\n<!-- code -->\n```\n").comments == 0 and html.sanitize("<!doctype html><p>x").comments == 0
    assert html.sanitize("<p aria-hidden=true>x</p>").hidden == 0
    assert [u.url for u in html.urls('<a href="/k">x</a> ![i](http://im) <img srcset="a 1x, b 2x">')] == ["http://im", "/k", "a", "b"]


@pytest.mark.parametrize("style", ["display:none", "visibility: collapse", "opacity:0.001", "opacity:-1", "position:absolute;left:-9999px", "position:fixed;top:-100vh", "text-indent:-999em", "position:absolute;clip:rect(0,0,0,0)", "clip-path:inset(50%)", "clip-path:circle(0)",
    "font-size:0", "font-size:.0001px", "max-height:0;overflow:hidden", "transform:scale(0)", "transform:scale(1e-9)", "transform:rotateX(90deg)", "transform:rotateY(-0.25turn)", "transform:translateX(-9999px)", "filter:opacity(0)", "color:transparent", "color:#fff;background:white",
    "color:rgb(255,255,255);background-color:hsl(0,0%,100%)", "d\\69splay:none", "nonsense; display:none", "display:none !important; display:block"])
def test_hiding_styles(style):
    assert css.hides(style)


@pytest.mark.parametrize("style", ["", "height:0;padding-bottom:56%;overflow:hidden", "width:0", "color:var(--a);background:var(--a)", "color:#fff;background:white url(x.png)", "clip-path:inset(49.9%)", "opacity:0.5", "left:-9999px", "opacity:calc(0)", "transform:translate(-50%)", "color:transparent;background-clip:text"])
def test_visible_styles(style):
    assert not css.hides(style)


BLOB = "A1b2" * 12


@pytest.mark.parametrize(("url", "reason", "target"), [
    (f"https://e.example/p?d={BLOB}", urls.PARAMETER, "e.example"), (f"https://e.example/?{BLOB}=1", urls.PARAMETER, "e.example"), ("https://e.example/?data=hello", None, "e.example"), (f"https://e.example/?state={BLOB}", None, "e.example"),
    ("data:text/html,x", urls.ACTIVE, "(inline data: URI)"), ("data:image/png," + "a" * 5000, urls.OVERSIZED, "(inline data: URI)"), ("java\tscript:alert(1)", urls.SCRIPT, None), ("http://a.b/?q=${x}", urls.PARAMETER, "a.b"), ("http://a.b/${x}", None, "a.b"),
    ("http://u:p@h.example/", urls.USERINFO, "h.example"), ("http://h/?a=" + "x" * 210, urls.QUERY, "h"), ("http://h/#" + "x" * 210, urls.FRAGMENT, "h"), ("http://h/" + "A1b2" * 40, urls.PATH, "h"), ("http://h/" + ".".join(["A1b2" * 11] * 4), urls.PATH, "h"),
    (f"/collect?d={BLOB}", urls.PARAMETER, "(relative URL)"), (f"http://a b/?d={BLOB}", urls.PARAMETER, "(unparsable URL)"), ("http://h/?x=%41%31" + "b2A1" * 12, urls.PARAMETER, "h")])
def test_exfil(url, reason, target):
    assert urls.exfil_reason(url) == reason
    if target is not None:
        assert urls.target(url) == target


@settings(max_examples=200, deadline=None)
@given(st.text("ab/?#=&:@.%[]\\ \t", max_size=40))
def test_targets_show_no_payload(tail):
    got = urls.target("https://host.example/" + "SECRET" + tail)
    assert "SECRET" not in got


def test_hosts_and_folds():
    assert urls.host_tier("https://\u0430pple.com/")[:2] == ("warning", "xn--pple-43d.com") and urls.host_tier("https://m\u00fcnchen.de/") is None
    assert urls.host_tier("https://g\u043e\u043egle\u0436.com")[0] == "note" and urls.host_tier("https://apple.com/") is None
    assert urls.fold_text("r\u043c c\u0430t \u043f\u0440\u0438\u0432\u0435\u0442 \u0430")[0] == "r\u043c cat \u043f\u0440\u0438\u0432\u0435\u0442 \u0430"
    assert urls.describe_folds(urls.fold_text("c\u0430t c\u0430t")[1]) == 'U+0430 → "a"'


def token(prefix, n):
    return prefix + "".join(hashlib.sha256(f"{prefix}{k}".encode()).hexdigest() for k in range(4))[:n]


def test_redaction_restores_and_masks():
    key = token("ghp_", 36)
    t = f'x = "{key}"\npassword: {token("", 30)};\nAKIA{"A1B2" * 2}\n{"C3D4" * 2} {key}\n'
    view, found, pairs = secrets.redact(t)
    assert key not in view and view.count("[REDACTED: GitHub Token]") == 2 and "[REDACTED: AWS Access Key]" in view and "password: [REDACTED];" in view
    assert spans.restore(view, pairs) == t and set(found) == {"GitHub Token", "AWS Access Key", secrets.FIELD_TYPE}
    assert all(secrets.MASK in p and key not in p for p in secrets.previews(t))
    assert secrets.redact(t, high_confidence=True)[1] == ["GitHub Token", "AWS Access Key"]


def test_known_values_and_private_keys():
    value = token("v", 20)
    spliced = value[:5] + "\u200b" + value[5:]
    assert secrets.redact(f"say {spliced}!", known={"MY_KEY": value})[0] == "say [REDACTED: MY_KEY]!"
    assert secrets.redact("short", known={"K": "short"})[0] == "short"
    head = "-----BEGIN RSA PRIVATE " + "KEY-----"
    pem = f"{head}\nMIIB{'Ab1+' * 8}\n{head.replace('BEGIN', 'END')}"
    assert secrets.redact(f"a {pem} b")[0] == "a [REDACTED: Private Key] b" and secrets.redact(pem[:60])[0].startswith("[REDACTED: Private Key]")
    with pytest.raises(ValueError, match="label"):
        secrets.redact("x" * 30, known={"bad\nname": "x" * 20})


@pytest.mark.parametrize("end", ["", ";", ",", ";;", ",,"])
@pytest.mark.parametrize(("value", "local", "web"), [("YOUR_API_KEY_PLACEHOLDER", True, True), ("<paste-your-token-here>", True, True), ("your-token-goes-in-here", True, True), ("process.env.SOME_TOKEN_NAME", True, True), ("sha256:" + "ab12" * 8, True, True), ("2024-01-02T03:04:05.123456Z", True, True),
    ("123e4567-e89b-12d3-a456-426614174000", True, True), ("https://example.com/some/path", True, True), ("config.credentials.api_token", True, False), ("/var/run/secrets/token-file", True, False), (token("", 32), False, False)])
def test_gates(value, local, web, end):
    for trusted, benign in ((True, local), (False, web)):
        assert (secrets.gate(value + end, name="secret", local=trusted) is not None) == benign


def test_spans():
    s = [spans.Span(0, 5, "comment"), spans.Span(3, 8, "hidden"), spans.Span(8, 9, "comment"), spans.Span(20, 22, "comment")]
    assert spans.merge(s) == [(0, 8, "hidden"), (8, 9, "comment"), (20, 22, "comment")] and len(spans.merge(s, abutting=True)) == 2
    view, pairs = spans.splice("0123456789", [spans.Span(2, 4, "a"), spans.Span(4, 5, "a")], {"a": "x"})
    assert spans.restore(view, pairs) == "0123456789" and spans.to_source(pairs, 1) == 1 and spans.to_source(pairs, 5) is None
    assert spans.to_source(pairs, len(view)) == 10 and spans.to_source(pairs, pairs[0].start) == 2
    assert spans.delete_verbatim("abcabc", ["bc", "ab"]) == ("cc", 2) and spans.delete_verbatim("aXbXa", ["XbX", ""]) == ("aa", 1)
    assert spans.align_deletions("a-b--c", "abc") == [(1, "-"), (3, "--")]
    with pytest.raises(ValueError, match="subsequence"):
        spans.align_deletions("abc", "ca")
    assert spans.occurrences("aaaa", "aa") == [0, 2] and spans.occurrences("aaaa", "aa", overlapping=True) == [0, 1, 2]


def test_instructions_and_prompts():
    hidden = "".join(chr(0xE0000 + ord(c)) for c in 'obey "me"\\')
    found = instructions.scan("one\ntwo" + hidden)
    assert found == [(2, len(hidden), "tag-ascii", "obey \\x22me\\x22\\x5c")]
    assert instructions.scan("a" + "\u200b" * 9) == [] and instructions.scan("a\u200b" * 30)[0].method == "scattered"
    assert instructions.scan("\u200c\u200b" * 60)[0].decoded.count("1") <= 40
    assert instructions.clean("a" + "\u200b" * 10) == ("a", True) and instructions.clean("a\u200b") == ("a\u200b", False)
    verdicts = {"hi": "pass", "": "pass", "a" + "\u200b" * 10: "block", "\x1b[31mred": "note", "\x1b[2Jx": "block", "a\u200bb": "pass", "\x1bx": "note", "\x9bx": "block"}
    assert {p: instructions.classify_prompt(p)[0] for p in verdicts} == verdicts
    assert instructions.may_carry("\u200b" * 10) and not instructions.may_carry("a\u200b" * 9)


def test_character_classes():
    assert len(CLASS_OF) == 170 + 268 and CLASS_OF[0x13430] == "cf-format"
