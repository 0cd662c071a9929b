"""Secrets: the gate never passes over what a detector matches, each family is found, and time grows with the text."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from clearwell.functions import invisible, secrets
from clearwell.operators import redact

ALPHABETS = {"hex": "0123456789abcdef", "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"}


def body(seed, n, alphabet="alnum"):
    rng = random.Random(f"{seed}{n}")
    return "".join(rng.choice(ALPHABETS[alphabet]) for _ in range(n))


def samples():
    """One key of each family, made at run time."""
    h, a = (lambda n: body("s", n, "hex")), (lambda n: body("s", n))
    jwt = ".".join(__import__("base64").urlsafe_b64encode(x).decode().rstrip("=") for x in (b'{"alg":"none"}', b'{"sub":"someone"}')) + "." + a(30)
    return {
        "AWS Access Key": "AKIA" + a(16).upper(), "Anthropic API Key": "sk-ant-" + a(40), "Google API Key": "AIza" + a(35), "DigitalOcean Token": "dop_v1_" + h(64), "Cloudflare Origin CA Key": f"v1.0-{h(24)}-{h(146)}", "Vault Token": "hvs." + a(30),
        "Terraform Cloud API Token": f"{a(14)}.atlasv1.{a(64)}", "GitHub Fine-Grained PAT": "github_pat_" + a(82), "GitHub Token": "ghp_" + a(36), "GitLab Token": "glpat-" + a(20), "OpenRouter API Key": "sk-or-v1-" + h(64), "OpenAI Token": f"sk-{a(20)}T3BlbkFJ{a(20)}",
        "Groq API Key": "gsk_" + a(52), "xAI API Key": "xai-" + a(80), "npm Token": "npm_" + a(36), "Replicate API Token": "r8_" + a(37), "Slack Token": "xoxb-123456-" + a(24), "Slack Webhook": f"https://hooks.slack.com/services/T{a(8)}/B{a(8)}/{a(24)}", "Stripe Access Key": "sk_live_" + a(24),
        "SendGrid API Key": f"SG.{a(22)}.{a(43)}", "Square OAuth Secret": "sq0csp-" + a(43), "Twilio API Key": "SK" + h(32), "Telegram Bot Token": f"123456789:{a(35)}", "Mailchimp Access Key": f"{h(32)}-us12", "Discord Bot Token": f"M{a(23)}.{a(6)}.{a(27)}", "PyPI Token": "pypi-AgE" + a(60),
        "Artifactory Credentials": "AKC" + a(20), "JSON Web Token": jwt, "Basic Auth Credentials": "https://user:" + a(12) + "@host.example/",
    }


def test_every_detector_has_a_sample():
    assert set(samples()) == {d.name for d in secrets.DETECTORS}


@pytest.mark.parametrize("name", [d.name for d in secrets.DETECTORS])
def test_each_family_is_found_and_restored(name):
    key = samples()[name]
    text = f"before é {key} after"
    hits = secrets.find(text)
    assert name in {h.secret_type for h in hits}
    low = key.lower()
    assert not secrets._LITERALS[name] or any(x in low for x in secrets._LITERALS[name])


def test_gate_passes_over_nothing(spark):
    keys = samples()
    texts = [f"x {k} y" for k in keys.values()] + [f"x {k[:9]}\r\n{k[9:]} y" for n, k in keys.items() if n in secrets._CROSSING]
    texts += ["password: 'correct horse battery staple'", "contraseña = " + body("c", 24), "cloudant_key = " + body("c", 64, "hex"), "IBM_CLOUD_IAM_KEY: " + body("i", 44), "softlayer api key = " + body("s", 64, "hex"), "db_pass => " + body("d", 24)]
    texts += ["plain words", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    hint = {r["doc_id"]: r["h"] for r in secrets.with_hint(df, F.col("text"), "h").collect()}
    got = {r["doc_id"]: r["l4"] for r in redact.redact(df).collect()}
    for k, t in enumerate(texts):
        want = secrets.redact(t or "")
        assert hint[k] or not want[1], t
        assert got[k]["view"] == want[0] and got[k]["found"] == want[1] and got[k]["error"] is None
    assert sum(hint.values()) == len(texts) - 3
    shown = {r["doc_id"] for r in redact.previews(df).collect()}
    assert shown == {k for k, t in enumerate(texts) if secrets.previews(t or "")}


def test_known_values_of_any_characters(spark):
    value = "pässwörd-värde lång 1"
    df = spark.createDataFrame([(1, f"it is {value}!"), (2, f"it is {value[:4]}​{value[4:]}!"), (3, "other")], "doc_id long, text string")
    got = {r["doc_id"]: r["l4"]["view"] for r in redact.redact(df, known={"V": value}).collect()}
    assert got == {1: "it is [REDACTED: V]!", 2: "it is [REDACTED: V]!", 3: "other"}


def test_services_phrases_and_gates():
    key = body("k", 64, "hex")
    assert secrets.redact(f"cloudant_api_key = '{key}'")[1] == ["Cloudant Credentials"]
    assert secrets.redact("password = 'correct horse battery staple'")[0] == "password = '[REDACTED]'"
    assert secrets.redact("password = 'your own words go here'")[1] == [] and secrets.redact("password = 'one two three four five six seven eight nine'")[1] == []
    assert secrets.reference("process.env['A'].b") == "environment" and secrets.reference("$HOME.x") == "environment" and secrets.reference("self.config[0].key") == "config" and secrets.reference("other.env") is None and secrets.reference("self.a b") is None
    assert secrets.gate("https://user:pw@example.com/a/b/c") is None and secrets.gate("0x" + "ab" * 20) == "content-digest" and secrets.gate("1.2.3-rc.1") == "version"
    assert secrets.gate("/opt/app/file.txt:latest") == "path" and secrets.gate("/other/app/file.txt", local=False) is None and secrets.gate("/^a|b$/gi") == "regex"


def test_required_literals():
    assert secrets.required_literals("(?:ab|cd)?ef(?:gh|ij)+k") == {"ef"} and secrets.required_literals("a*b?") == frozenset()
    assert secrets.required_literals("(?:foo|bar)x|quux") == {"foox", "barx", "quux"}
    for d in secrets.DETECTORS:
        for key in (samples()[d.name], samples()[d.name].swapcase()):
            if re.search(d.pattern, key) and secrets._LITERALS[d.name]:
                assert any(x in key.lower() for x in secrets._LITERALS[d.name])


def test_time_grows_with_the_hits():
    def took(n):
        text = " ".join("AKIA" + hashlib.sha256(str(k).encode()).hexdigest()[:16].upper() for k in range(n))
        start = time.perf_counter()
        view, _, pairs = secrets.redact(text)
        assert len(pairs) == n and "AKIA" not in view
        return time.perf_counter() - start

    took(200)
    small, large = min(took(1000) for _ in range(3)), min(took(8000) for _ in range(3))
    assert large < 24 * small


def test_content_has_limits():
    family = "\U0001f468‍\U0001f469‍\U0001f467"
    assert invisible.strip_text(family * 3)[0] == family * 3
    run = "क्‍"  # a consonant, its virama, a joiner
    assert invisible.strip_text("x " + run + " y")[0] == "x " + run + " y"
    many = "a" + "​" * 30 + family
    assert "‍" not in invisible.strip_text(many)[0]
    glued = "\U0001f468" + "‍\U0001f468" * 12  # one cluster with more joiners than a run may have
    assert invisible.strip_text(glued)[0].count("‍") == 0
