"""Operators on small frames, files and streams."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from clearwell import sql
from clearwell.functions import rehydrate
from clearwell.functions.spans import Pair
from clearwell.operators import layer1, markup, redact, relational, texts, toolcalls
from clearwell.plans import sanitize
from clearwell.queries import QUERIES
from clearwell.sources import files, stores
from clearwell.streaming import notices

Z = "\u200b"
KEY = "ghp_" + hashlib.sha256(b"key").hexdigest()[:36]


def test_exact_and_native_agree_without_content(spark):
    rows = ["plain", "a\u200bb\x1b[31mc\x1b[0m", "\x1b\u200b[32mx", "x" * 3000 + Z * 40, "", None, "\x9b2Jz"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string")
    exact = {r["doc_id"]: r["l1"] for r in layer1.exact(df).collect()}
    native = {r["doc_id"]: r for r in df.select("doc_id", layer1.native(F.col("text")).alias("c"), layer1.native_found(F.col("text")).alias("f")).collect()}
    for k, t in enumerate(rows):
        want = layer1.clean_text(t or "")
        assert exact[k]["cleaned"] == want[0] and exact[k]["found"] == want[2]
        if t is not None:
            assert native[k]["c"] == want[0] and set(want[2]) <= set(native[k]["f"])


def test_pipeline(spark):
    rows = [(1, f"clean {Z}text"), (2, '<p hidden>x <a href="https://e.example/?d=' + "A1b2" * 12 + '">l</a></p> seen'), (3, f"my key {KEY} end"), (4, "see https://\u0430pple.example/"), (5, None)]
    out = sanitize.sanitize(spark.createDataFrame(rows, "doc_id long, text string"), secrets=True)
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[1]["cleaned"] == "clean text" and got[1]["found"] == ["cf-format"]
    assert got[2]["found"] == ["hidden-html", "exfil-urls"] and "hidden HTML removed" in got[2]["cleaned"]
    assert got[3]["cleaned"] == "my key [REDACTED: GitHub Token] end" and got[4]["found"] == ["confusable-host"] and got[5]["cleaned"] == ""
    codes = sorted((r["doc_id"], r["layer"], r["severity"]) for r in sanitize.findings(out).collect())
    assert codes == [(1, 1, "warning"), (2, 2, "warning"), (2, 3, "note"), (4, 3, "warning")]
    assert sanitize.banner(out).where("banner IS NOT NULL").count() == 3


def test_nested_values(spark):
    df = spark.createDataFrame([({"k" + Z: [f"a{Z}"]}, (1, f"b{Z}", None))], "m map<string,array<string>>, s struct<n:int,t:string,u:array<string>>")
    r = sanitize.sanitize_values(df, "m", "s").first()
    assert r["m"] == {"k" + Z: ["a"]} and r["s"]["t"] == "b" and r["s"]["n"] == 1
    assert sanitize.suppress(df, "gone", "s").first()["s"]["t"] == "gone"
    keys = spark.createDataFrame([({f"a{Z}": 1, "a": 2},), ({f"b{Z}": 1},)], "m map<string,int>")
    kept, met = sanitize.clean_keys(F.col("m"))
    assert [(r["k"], r["x"]) for r in keys.select(kept.alias("k"), met.alias("x")).collect()] == [(None, True), ({"b": 1}, False)]
    fixed = sanitize.to_fixed_point(spark.createDataFrame([("abab",)], "t string"), [lambda c: F.regexp_replace(c, "ab", "b")], "t", 3).first()
    assert fixed["settled"]


def test_redaction_fails_closed(spark, monkeypatch):
    df = spark.createDataFrame([(1, f"token = {KEY}"), (2, "nothing")], "doc_id long, text string")
    got = {r["doc_id"]: r["l4"] for r in redact.redact(df).collect()}
    assert got[1]["view"] == "token = [REDACTED: GitHub Token]" and got[2]["view"] == "nothing" and got[1]["error"] is None
    with pytest.raises(ValueError, match="label"):
        redact.redactor(known={"bad\n": "x" * 20})


def test_toolcalls(spark):
    df = spark.createDataFrame([("Edit", [(f"a{Z}b", f"c{Z * 12}\x1b[0m")])], "tool string, edits array<struct<old:string,new:string>>")
    e = toolcalls.strip_edits(df, "edits", "old", "new").first()["edits"][0]
    assert e["old"] == f"a{Z}b" and e["new"] == "c"
    p = toolcalls.policy(spark.createDataFrame([("WebFetch", "x"), ("mcp__a__b", "<p>"), ("Bash", "<p>")], "tool string, text string")).collect()
    assert [(r["html"], r["urls"], r["local"]) for r in p] == [(True, True, False), (True, True, False), (False, False, True)]
    view, pairs = "a = [REDACTED]; b = [REDACTED]", [Pair("[REDACTED]", "one", 4), Pair("[REDACTED]", "two", 20)]
    rows = [(view, [p._asdict() for p in pairs], "a = [REDACTED];", "A = [REDACTED];", False), (view, [p._asdict() for p in pairs], "[REDACTED]", "x", False), (view, [p._asdict() for p in pairs], "a =", "A =", False)]
    df = spark.createDataFrame(rows, "view string, pairs array<struct<placeholder:string,original:string,start:int>>, old string, new string, replace_all boolean")
    got = [r["edit"] for r in toolcalls.rehydrate_edits(df).collect()]
    assert [g["outcome"] for g in got] == ["update", "deny", "none"] and (got[0]["old"], got[0]["new"]) == ("a = one;", "A = one;")
    assert df.select(toolcalls.describe_placeholders(F.col("view")).alias("d")).first()["d"] == "[REDACTED]"


def test_rehydrate():
    pairs = [Pair("[REDACTED: K]", "s1", 2), Pair("[REDACTED: L]", "s2", 18)]
    view = "x [REDACTED: K] y [REDACTED: L] z"
    assert rehydrate.edit(view, pairs, "y [REDACTED: L]", "[REDACTED: L] y") == ("y s2", "s2 y")
    assert rehydrate.edit(view, pairs, "y", "[REDACTED: K]") == ("y", "s1") and rehydrate.edit(view, pairs, "y", "w") is None
    assert isinstance(rehydrate.edit(view, pairs, "y", "[REDACTED: Other]"), rehydrate.Deny) and isinstance(rehydrate.edit(view, pairs, "ACTED", "x"), rehydrate.Deny)
    assert isinstance(rehydrate.edit(view, [pairs[1], pairs[0]], "y", "w"), rehydrate.Deny)
    assert rehydrate.write(view, pairs, view.upper().replace("X", "q")) == (view, "q s1 Y s2 Z")
    assert rehydrate.write(view, pairs, "none") is None and isinstance(rehydrate.write(view, pairs, "[REDACTED]"), rehydrate.Deny)
    assert rehydrate.dropped(["a", "b", "a"], ["b"]) == ["a"]


def test_stores_and_spans(spark, tmp_path):
    rows = spark.createDataFrame([("one",), ("two",), ("one",), (None,)], "content string")
    stores.append_reveals(rows, str(tmp_path / "reveals"))
    stores.append_reveals(rows, str(tmp_path / "reveals"))
    store = stores.read_reveals(spark, str(tmp_path / "reveals"))
    assert store.count() == 2
    keys = spark.createDataFrame([(hashlib.sha256(b"one").hexdigest(),), ("none",)], "sha256 string")
    assert sorted(r["content"] or "" for r in stores.lookup(keys, store).collect()) == ["", "one"]
    pages = spark.createDataFrame([(1, "a<!-- x -->b<!-- y -->"), (2, "none")], "page_id long, html string")
    spliced = markup.splice_comments(pages, "html")
    pairs = spliced.select(F.explode("pairs").alias("p")).select("p.*")
    full = relational.restore_from_store(spliced.select("page_id", F.col("view").alias("text")), relational.span_store(pairs), "page_id")
    assert {r["page_id"]: r["restored"] for r in full.collect()} == {1: "a<!-- x -->b<!-- y -->", 2: "none"}
    part = relational.restore_from_store(spliced.select("page_id", F.col("view").alias("text")), relational.span_store(pairs.limit(1)), "page_id")
    assert {r["page_id"]: r["denied"] for r in part.collect()} == {1: True, 2: False}
    before, after = (spark.createDataFrame(x, "k int, v string") for x in ([(1, "a")], [(1, "a"), (1, "b")]))
    assert [tuple(r) for r in relational.exposed(before, after, "k", "v").collect()] == [(1, "b")]


def test_files(spark, tmp_path):
    (tmp_path / "sub" / "node_modules").mkdir(parents=True)
    hidden = "".join(chr(0xE0000 + ord(c)) for c in "do as I say")
    for p, t in (("CLAUDE.md", "one\ntwo" + hidden), ("sub/AGENTS.md", "fine"), ("sub/node_modules/CLAUDE.md", hidden), ("other.md", hidden)):
        (tmp_path / p).write_text(t)
    (tmp_path / "sub" / "SKILL.md").write_bytes(b"\xff\xfe")
    assert files.read_files(spark, str(tmp_path)).count() == 3
    found = files.scan_files(spark, str(tmp_path))
    assert [(r["line"], r["method"], r["decoded"]) for r in found.collect()] == [(2, "tag-ascii", "do as I say")]
    assert "line 2: 11 invisible characters" in files.report(found).first()["report"]
    target = str(tmp_path / "CLAUDE.md")
    assert files.clean_file(target) and open(target).read() == "one\ntwo" and not files.clean_file(target)
    os.symlink(target, tmp_path / "link.md")
    with pytest.raises(OSError):
        files.clean_file(str(tmp_path / "link.md"))
    with pytest.raises(UnicodeDecodeError):
        files.clean_file(str(tmp_path / "sub" / "SKILL.md"))
    assert files.ancestors("a/b/c") == ["a", "a/b", "a/b/c"] and files.is_contained(str(tmp_path), target) and not files.is_contained(str(tmp_path), "/etc/passwd")
    assert files.context_kind("x/SKILL.md") == "skill" and files.context_kind("x.txt") is None


def test_requests(spark):
    lines = spark.createDataFrame([('{"op":"sanitize","text":"a\\u200bb","id":"1"}',), ("nonsense",), ('{"op":"other","text":"x","id":"2"}',), ('{"op":"sanitize","id":"3"}',)], "value string")
    got = {(r["id"], r["cleaned"], r["error"]) for r in notices.answer(lines).collect()}
    assert got == {("1", "ab", None), (None, None, "not a request"), ("2", None, "unknown op"), ("3", None, "text is not a string")}
    more = [{"op": "classifyPrompt", "text": "x" + Z * 12, "id": "4"}, {"op": "scanText", "text": "x" + Z * 12, "id": "5"}, {"op": "redact", "text": f"a{Z} {KEY}", "id": "6"}, {"op": "redact", "text": "secret = config.credentials.api_token", "id": "7"}, {"op": "redact", "text": "secret = config.credentials.api_token", "id": "8", "options": {"web": True}}]
    rows = {r["id"]: r for r in notices.answer(spark.createDataFrame([(json.dumps(m),) for m in more], "value string")).collect()}
    assert rows["4"]["action"] == "block" and [f["char_count"] for f in rows["5"]["findings"]] == [12] and rows["6"]["cleaned"] == "a [REDACTED: GitHub Token]"
    assert rows["7"]["cleaned"] == more[3]["text"] and rows["8"]["cleaned"] == "secret = [REDACTED]" and all(r["error"] is None for r in rows.values())


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("s1", "n", "2024-01-01"), ("s1", "n", "2024-01-02"), ("s2", "n", "2024-01-01")], "session string, notice string, t string").withColumn("t", F.to_timestamp("t")).write.parquet(str(source))
    stream = spark.readStream.schema("session string, notice string, t timestamp").parquet(str(source))
    q = notices.once(stream, "session", "notice", "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == 2


def test_sql_names(spark):
    sql.register(spark)
    r = spark.sql(f"SELECT cw_strip('a{Z}b') a, cw_l1('a{Z}b') b, cw_found('a{Z}') c, cw_prompt_verdict('x') d, cw_style_hidden('display:none') e, cw_exfil_reason('data:text/html,x') f, cw_url_target('http://h/x') g, cw_placeholder('HTML comment', '<!-- one -->') h, cw_fold('c\u0430t') i, cw_has_tag('<b>') j, cw_invisible_count('a{Z}') k").first()
    assert tuple(r) == ("ab", "ab", ["cf-format"], "pass", True, "active-content data: URI", "h", "[HTML comment removed #9a65a667b62d]", "cat", True, 1)
    rows = spark.sql(f"SELECT start, char_count FROM cw_long_runs('a{Z * 12}')").collect()
    assert [tuple(r) for r in rows] == [(1, 12)]
    assert spark.sql("SELECT t.kind FROM VALUES ('x <!-- c -->') AS v(h), LATERAL cw_html_spans(h) t").first()["kind"] == "comment"


def test_texts(spark):
    df = spark.createDataFrame([(1, "aXbXa", ["XbX"]), (2, None, None)], "doc_id long, text string, needles array<string>")
    assert [(r["cleaned"], r["n_removed"]) for r in texts.delete_spans(df).orderBy("doc_id").collect()] == [("aa", 1), ("", 0)]
    spans = spark.createDataFrame([(1, 0, 5, "comment"), (1, 1, 3, "hidden"), (1, 5, 6, "comment")], "k int, start int, end int, kind string")
    assert relational.outermost(spans, "k").count() == 2 and relational.merge_spans(spans, "k").count() == 2 and relational.merge_spans(spans, "k", abutting=True).count() == 1


def test_injected_filter_reads_every_document(spark, tmp_path):
    rows = [(1, "the thande and x"), (2, "weathethe r anandd "), (3, "plain")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {1: "thande x", 2: "weather anandd ", 3: "plain"}
    found = {r["doc_id"]: r["text_sha256"] for r in QUERIES["injected_filter"](spark, str(tmp_path)).collect()}
    assert found == {d: hashlib.sha256(brute(t).encode()).hexdigest() for d, t in rows} and {d: brute(t) for d, t in rows} == want


def brute(text, needles=("the ", "and ")):
    """One pass over text, place by place."""
    out, at = "", 0
    while at < len(text):
        hit = next((n for n in needles if text.startswith(n, at)), None)
        out, at = (out, at + len(hit)) if hit else (out + text[at], at + 1)
    return out


def test_instruction_scan_reads_every_document(spark, tmp_path):
    spark.createDataFrame([(1, "a\nb" + Z * 12), (2, "clean"), (11, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = [tuple(r)[:3] for r in QUERIES["instruction_scan"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert found == [(1, 2, 12), (11, 1, 12)]


def test_host_confusables_reads_the_pages(spark, tmp_path):
    pages = [(1, "<p>go to https://аpple.example/y</p>"), (2, "<p>plain</p>"), (10, None)]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["host_confusables_salted"](spark, str(tmp_path)).where("reads = 'apple.example'").collect()
    assert {r["page_id"] for r in found} == {1, 10}


def test_restore_keeps_every_row(spark):
    mark = "[HTML comment removed #9a65a667b62d]"
    rows = [(None, f"a{mark}b"), (1, f"a{mark}b"), (1, "none"), (1, None), (2, f"{mark}{mark}"), (2, "[HTML comment removed #000000000000]")]
    store = relational.span_store(spark.createDataFrame([(mark, "<!-- one -->")], "placeholder string, original string"))
    back = relational.restore_from_store(spark.createDataFrame(rows, "page_id long, text string"), store, "page_id")
    got = sorted(((r["page_id"] or 0, r["text"] or "", r["restored"], r["denied"]) for r in back.collect()), key=repr)
    assert got == sorted([(0, f"a{mark}b", "a<!-- one -->b", False), (1, f"a{mark}b", "a<!-- one -->b", False), (1, "none", "none", False), (1, "", None, False), (2, f"{mark}{mark}", "<!-- one -->" * 2, False), (2, rows[5][1], None, True)], key=repr)


def test_the_longest_scope_wins_and_rows_stay_single(spark):
    scopes = spark.createDataFrame([("mcp__*", "content", "covered"), ("mcp__files__*", "content", "exempt"), ("Edit", "content", "covered"), ("Edit", "content", "covered")], "tool string, field string, kind string")
    calls = spark.createDataFrame([("mcp__files__x", "content"), ("mcp__a", "content"), ("mcp__a", "content"), ("Edit", "content"), ("Edit", "other"), (None, "content")], "tool string, field string")
    got = sorted((r["tool"] or "", r["field"], r["kind"]) for r in relational.scope_fields(calls, scopes).collect())
    assert got == [("", "content", "undeclared"), ("Edit", "content", "covered"), ("Edit", "other", "undeclared"), ("mcp__a", "content", "covered"), ("mcp__a", "content", "covered"), ("mcp__files__x", "content", "exempt")]


def test_spread(spark):
    from clearwell.sources.spread import spread

    one, many = spark.range(0, 100, 1, 1), spark.range(0, 100, 1, 4)
    assert spread(one, "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and spread(many, "id") is many
    assert spread(one, "id").count() == 100


def test_exits_are_vetted_and_layer_five_only_deletes(spark):
    rows = [(1, f"<p hidden>key {KEY}</p> seen", None), (2, "say evil words now", (["evil words", "absent"], "spans-removed")), (3, "plain", ([], "filter-flagged")), (4, f"to{KEY[:10]}--{KEY[10:]}", (["--"], "spans-removed")), (5, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, injection struct<remove:array<string>,code:string>")
    got = {r["doc_id"]: r for r in sanitize.tell(sanitize.sanitize(df, secrets=True, injection="injection")).collect()}
    assert KEY not in got[1]["reveal"] and "[REDACTED: GitHub Token]" in got[1]["reveal"] and [p["original"] for p in got[1]["splices"]] == ["<p hidden>key [REDACTED: GitHub Token]</p>"]
    assert got[1]["warnings"][0] == "HTML sanitized: 1 hidden element(s) replaced with placeholders" and got[1]["modified"]
    assert got[2]["cleaned"] == "say  now" and got[2]["warnings"][-1].startswith("Layer-5 injection filter removed") and got[2]["reveal"] is None and got[2]["splices"] is None
    assert got[3]["cleaned"] == "plain" and not got[3]["modified"] and "content not modified" in got[3]["warnings"][0]
    assert got[4]["cleaned"] == "to[REDACTED: GitHub Token]"  # what a deletion brings together is redacted again
    assert got[5]["cleaned"] == "" and got[5]["warnings"] == [] and not got[5]["modified"]
    bad = df.withColumn("injection", F.struct(F.array(F.lit("x")).alias("remove"), F.lit("free text").alias("code")))
    with pytest.raises(Exception, match="unknown code"):
        sanitize.sanitize(bad, injection="injection").collect()


def test_messages_and_notes(spark):
    rows = [(1, "\x1b[31mred\x1b[0m"), (2, f"a{Z * 12}"), (3, '<script>x</script><img src="data:image/png;base64,AA"> <a href="https://e.example/?d=' + "A1b2" * 12 + '">l</a>')]
    out = sanitize.sanitize(spark.createDataFrame(rows, "doc_id long, text string"))
    loud, quiet = ({r["doc_id"]: r for r in sanitize.tell(out, q).collect()} for q in (False, True))
    assert loud[1]["warnings"][0].startswith("Stripped: ANSI escapes") and quiet[1]["warnings"] == [] and quiet[1]["notes"] == [layer1.INERT] and quiet[1]["sgr_note"]
    assert "[LONG RUN" in quiet[2]["warnings"][0] and any("1 <script>" in n for n in loud[3]["notes"]) and any(n.startswith("URLs shaped like data exfiltration detected (left intact): link to e.example: suspicious") for n in loud[3]["notes"])


def test_postures_budgets_and_leaves(spark):
    df = spark.createDataFrame([("a", "b"), ("c", None), (None, None)], "text string, cleaned string")
    assert [r["output"] for r in sanitize.envelope(df, "text").collect()] == ["b", "[output withheld: it could not be sanitized]", None]
    assert [r["output"] for r in sanitize.envelope(df, "text", on_error="pass_with_warning").collect()] == ["b", "[not sanitized] c", None]
    with pytest.raises(Exception, match="could not be sanitized"):
        sanitize.envelope(df, "text", on_error="fail").collect()
    spent = redact.redact(spark.createDataFrame([(f"x {KEY}",), ("none",)], "text string"), seconds=0.0).collect()
    assert [(r["l4"]["view"], r["l4"]["error"]) for r in spent] == [(None, "BudgetExceeded"), ("none", None)]
    nested = spark.createDataFrame([(["a"], {"k": "b"}), (["a" + Z], {"k": "b"}), (["a"], {"k": "\x1b"}), (None, None)], "a array<string>, m map<string,string>")
    assert [r["modified"] for r in sanitize.modified_values(nested, "a", "m").collect()] == [False, True, True, False]
    calls = spark.createDataFrame([("Bash", f"c\u0430t file{Z * 12}"), ("Bash", "plain"), ("Bash", None)], "tool string, text string")
    assert [(r["updated"], len(r["notes"])) for r in sanitize.pre_tool(calls).collect()] == [("cat file", 2), ("plain", 0), ("", 0)]


def test_small_functions(spark, tmp_path):
    from clearwell.functions import invisible, spans, urls
    from clearwell.operators import codepoints

    bare, gone = invisible.strip_mapped(f"a{Z}b{Z}{Z}c")
    assert bare == "abc" and [invisible.source_place(gone, k) for k in range(3)] == [0, 2, 5]
    assert spans.anchors("abcXdef", "abcYYdef") == (3, 3) and spans.anchors("ab[RED]cd", "ab[RAD]cd", [(2, 7)]) == (2, 2) and spans.anchors("same", "same") == (4, 0)
    assert urls.fold_found("c\u0430t", [(1, "\u0430", "a")])[0] == "cat"
    for bad in ([(9, "\u0430", "a")], [(0, "\u0430", "a")], [(1, "\u0430", "\u0431")], [(0, "c", "c")]):
        with pytest.raises(ValueError, match="find"):
            urls.fold_found("c\u0430t", bad)
    df = spark.createDataFrame([(1, "c\u0430t")], "doc_id long, text string")
    assert texts.fold(df, scan=lambda t: [(1, "\u0430", "o")]).first()["folded"] == "cot"
    assert texts.prompt_verdicts(spark.createDataFrame([("a\x1b[31mb",)], "text string"), strip=lambda t: t + Z * 12).first()["verdict"]["action"] == "block"
    verdicts = spark.createDataFrame([("prompt", "pass"), ("prompt", "note"), ("prompt", "block"), ("prompt", "odd"), ("other", "pass")], "event string, action string")
    assert [r["decision"] for r in texts.host_verdicts(verdicts).collect()] == ["allow", "note", "deny", "deny", "deny"]
    calls = spark.createDataFrame([("Edit", ["x", "[REDACTED]"]), ("Edit", ["x"]), ("Bash", ["[REDACTED]"])], "tool string, texts array<string>")
    assert [r["m"] for r in calls.select(toolcalls.may_rehydrate(F.col("tool"), F.col("texts")).alias("m")).collect()] == [True, False, False]
    lines = spark.createDataFrame([(0, 4, [5]), (3, 9, [5]), (5, 6, [5])], "a int, b int, n array<int>")
    assert [r["s"] for r in lines.select(spans.straddles(F.col("a"), F.col("b"), F.col("n")).alias("s")).collect()] == [False, True, True]
    points = codepoints.code_points(spark.createDataFrame([(1, "\u2205\ufe00a\ufe00")], "k int, t string"), "t", "k")
    pairs = spark.createDataFrame([(0x2205, 0xFE00)], "base int, selector int")
    assert [r["pos"] for r in codepoints.registered_variations(points, pairs, "k").collect()] == [1]
    events = spark.createDataFrame([("info", "a"), ("debug", "b")], "level string, what string")
    assert [notices.trace(events, x).count() for x in ("off", "info", "debug")] == [0, 1, 2] and json.loads(notices.trace(events, "info").first()["line"]) == {"level": "info", "what": "a"}
    now = "current_timestamp()"
    found = spark.sql(f"SELECT 's' AS session, {now} - INTERVAL 2 DAYS AS time UNION ALL SELECT 's', {now} UNION ALL SELECT 't', {now} - INTERVAL 9 DAYS UNION ALL SELECT 'u', {now}")
    acks = spark.sql(f"SELECT 's' AS session, {now} - INTERVAL 1 DAYS AS time")
    assert sorted(r["session"] for r in notices.unacknowledged(found, acks).collect()) == ["s", "u"]
    runs = spark.createDataFrame([(0.5, 0.5), (3.0, 2.5), (4.0, 0.5)], "seconds double, cpu_seconds double")
    assert [r["notice"] for r in notices.slow_runs(runs).collect()] == ["took 3.0 s, mostly working", "took 4.0 s, mostly waiting"]
    store = str(tmp_path / "store")
    stores.append_reveals(spark.createDataFrame([("x",)], "content string"), store)
    os.makedirs(f"{store}/day=2001-01-01")
    assert stores.sweep(spark, store) == ["day=2001-01-01"] and stores.read_reveals(spark, store).count() == 1
