"""Each query over a whole table against a plain version, and each operator on awkward tables."""

import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from clearwell.llm import decontaminate, media, page_diff, pieces, queries, rans, reply_tree, shingle_join, substring_dedup, toxicity, url_filter
from clearwell.llm.common import shared_folder, table
from clearwell.llm.components import components
from clearwell.llm.queries import QUERIES, tokenizer_file


def rows(data, name, columns):
    return duckdb.sql(f"select {columns} from '{data}/{name}.parquet'").fetchall()


def got(df, key):
    return {r[key]: r.asDict(recursive=True) for r in df.collect()}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


AWKWARD = [(3, "a b c d e f g"), (1, None), (2, ""), (3, "a b c d e f g"), (None, "only words without an id here"), (9, "x" * 40_000 + " é"), (5, " \n\t "), (6, "a b c d e f g")]


@pytest.fixture(scope="module")
def awkward(spark):
    docs = spark.createDataFrame([(d, t, "en", 7, "z") for d, t in AWKWARD], "doc_id long, text string, lang string, n_words long, score string")
    return docs.repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def test_op1(spark, data):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    found, start = got(QUERIES["op1_rans_token_ids"](spark, data), "doc_id"), 0
    docs = sorted(rows(data, "documents", "doc_id, text"))
    assert len(found) == len(docs)
    for d, t in docs:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert found[d] == {"doc_id": d, "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(np.array(ids, "<u4").tobytes())}
        start += len(ids)


def test_op1_awkward(spark, awkward, empty):
    for n, docs in enumerate((awkward, empty)):
        path = f"{shared_folder(spark)}/awkward-{n}"
        rans.write(docs, path, tokenizer_file("word_bpe_49k.json"), 2, 49408)
        found = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in rans.read(spark, path).collect()))
        assert [d for _, d, _ in found] == ([None, 1, 2, 3, 3, 5, 6, 9] if docs is awkward else [])
        assert all(s == sum(k for _, _, k in found[:i]) for i, (s, _, _) in enumerate(found))


def test_op2(spark, data):
    found = got(QUERIES["op2_media_chunks"](spark, data), "doc_id")
    docs = rows(data, "documents", "doc_id, text")
    assert len(found) == len(docs)
    by_text = {}
    for d, t in docs:
        raw = (t or "").encode()
        payload, r = media.pad(raw), found[d]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r["media_bytes"] > 0 and f"sum={sum(payload)};" in r["feature"]
        assert by_text.setdefault(t, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])


def test_op2_awkward(awkward, empty):
    named = awkward.withColumnsRenamed({"lang": "recipe", "score": "missing", "n_words": "digests"})
    found = media.read(*media.store(named)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in found) == sorted((d or 0, len((t or "").encode())) for d, t in AWKWARD)
    assert all(r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 for r in found)
    assert media.read(*media.store(empty)).count() == 0


def test_op2_chunks_are_shared_and_damage_is_seen(spark):
    from clearwell.llm.gear import Chunker

    text = "".join(sha(str(k)) for k in range(200))
    texts = {1: text, 2: "before " + text, 3: text, 4: text[:9000] * 2, 5: "elsewhere"}
    docs = spark.createDataFrame([*texts.items(), (5, "elsewhere")], "doc_id long, text string")
    small = Chunker(bits=8, least=64, most=1024)
    documents, packs = media.store(docs, small)
    by_shuffle = media.store(docs, small, most_sent=0)
    assert sorted(map(repr, media.read(*by_shuffle).collect())) == sorted(map(repr, media.read(documents, packs).collect()))
    found = got(media.read(documents, packs), "doc_id")
    for d, t in texts.items():
        assert found[d]["payload_sha256"] == hashlib.sha256(media.pad(t.encode())).hexdigest()
    # Each chunk is stored once, and the chunks of plain cutting are all there.
    stored = [x for p in packs.dropDuplicates(["recipe"]).collect() for x in media._own(p["digests"], p["missing"])]
    plain = set()
    for t in texts.values():
        data = media.pad(t.encode())
        ends = small.ends(data)
        plain |= {hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends], ends)}
    assert len(stored) == len(set(stored)) and {bytes(x) for x in stored} == plain
    frames = media.F.transform("frames", lambda f: media.F.lit(media.zstandard.compress(b"other")))
    with pytest.raises(Exception, match="damaged"):
        media.read(documents, packs.withColumn("frames", frames)).collect()
    with pytest.raises(Exception, match="not in the store"):
        media.read(documents, packs.limit(0)).collect()
    with pytest.raises(Exception, match="not in the store"):
        media.read(documents, packs.withColumn("lent", media.F.array().cast("array<binary>"))).collect()


GEAR = [int.from_bytes(hashlib.sha256(b"gear %d" % (k // 8)).digest()[4 * (k % 8) : 4 * (k % 8) + 4], "little") for k in range(256)]


def plain_chunks(data):
    """A cut where the top 4 bits of the hash of the last 16 bytes are zero, between 12 and 128 bytes apart."""
    out, last, h = [], 0, 0
    for k, byte in enumerate(data, 1):
        h = (2 * h + GEAR[byte] - (GEAR[data[k - 17]] << 16 if k > 16 else 0)) % 2**32
        if k - last >= 12 and h < 2**28 or k - last == 128:
            out.append((last, k))
            last = k
    return out + ([(last, len(data))] if last < len(data) else [])


def plain_dedup(docs):
    """(words removed, what is left) by plain comparison of the bytes around runs of two chunks or more."""
    data = {d: (t or "").encode() for d, t in docs}
    cuts = {d: plain_chunks(x) for d, x in data.items()}
    where = {}
    for d in sorted(data):
        for a, b in cuts[d]:
            where.setdefault(data[d][a:b], (d, a, b))
    out = {}
    for d, x in data.items():
        again = [where[x[a:b]][0] < d for a, b in cuts[d]]
        gone = [False] * len(x)
        k = 0
        while k < len(again):
            end = k
            while end < len(again) and again[end]:
                end += 1
            if end - k >= 2:
                (a, left), (right, b) = cuts[d][k], cuts[d][end - 1]
                e, at, _ = where[x[a:left]]
                f, _, to = where[x[right:b]]
                n = 0
                while n < min(512, a, at) and x[a - 1 - n] == data[e][at - 1 - n]:
                    n += 1
                m = 0
                while m < 512 and b + m < len(x) and to + m < len(data[f]) and x[b + m] == data[f][to + m]:
                    m += 1
                gone[a - n : b + m] = [True] * (b + m - a + n)
            k = max(end, k + 1)
        left, words, at = b"", 0, 0
        for m in re.finditer(b"\x01+", bytes(gone)):
            a, b = m.span()
            while 0 < a < b and not x[a - 1 : a].isspace():
                a += 1
            while a < b < len(x) and not x[b : b + 1].isspace():
                b -= 1
            if len(x[a:b].split()) >= 40:
                left, words, at = left + x[at:a], words + len(x[a:b].split()), b
        out[d] = words, (left + x[at:]).decode()
    return out


def test_op3(spark):
    data = "/root/testdata/sf0.01"
    found = got(QUERIES["op3_substring_dedup"](spark, data), "doc_id")
    docs = rows(data, "documents", "doc_id, text")
    want = plain_dedup(docs)
    assert len(found) == len(docs) and any(w for w, _ in want.values())
    for d, t in docs:
        r = found[d]
        assert (r["removed_words"], r["text"] or "") == want[d]
        cut = t or ""
        for span in reversed(r["removed"]):
            cut = cut[: span["start"]] + cut[span["end"] :]
        assert cut == (r["text"] or "")


def test_op3_passages(spark):
    filler = lambda k, n: " ".join(sha(f"{k} {j}")[: 3 + j % 6] for j in range(n))
    docs = [(k, f"{filler(k, 40 + k)} {filler('shared', 60)} {filler(-k, 30)}") for k in range(1, 9)] + [(20, filler("clean", 200))]
    found = got(substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")
    assert found[1]["text"] == docs[0][1] and found[20]["removed_words"] == 0
    assert all(found[k]["removed_words"] == 60 for k in range(2, 9))


def test_op3_finds_each_passage_of_51_words(spark):
    filler = lambda k, n: " ".join(sha(f"{k} {j}")[: 2 + j % 8] for j in range(n))
    docs = [(2 * k + side, f"{filler((k, side), 30)} {filler(('p', k), 51)} {filler((side, k), 30)}") for k in range(400) for side in (0, 1)]
    found = got(substring_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id")
    assert all(found[2 * k]["removed_words"] == 0 for k in range(400))
    assert sum(found[2 * k + 1]["removed_words"] == 51 for k in range(400)) >= 396  # the rest have too few whole chunks to be found


def test_op3_awkward(awkward, empty):
    found = substring_dedup.dedup(awkward)
    assert found.columns[:5] == awkward.columns and sorted(map(repr, found.select(awkward.columns).collect())) == sorted(map(repr, awkward.collect()))
    assert substring_dedup.dedup(empty).count() == 0


def test_op4(spark):
    data = "/root/testdata/sf0.1"
    docs = table(spark, data, "documents")
    labels = dict(rows(data, "labels", "doc_id, toxic"))
    found = got(QUERIES["op4_toxicity"](spark, data), "doc_id")
    assert len(found) == docs.count()
    for d, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    held = [(labels[d], r["predicted"]) for d, r in found.items() if r["held_out"] and d in labels]
    assert sum(y == p for y, p in held) >= 0.95 * len(held)


def test_op4_awkward(spark, awkward, empty):
    labels = spark.createDataFrame([(3, 1), (1, 0), (9, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    model = toxicity.fit_from(awkward, labels)
    scored = toxicity.classify(awkward, model)
    assert scored.count() == len(AWKWARD) and toxicity.classify(empty, toxicity.fit_from(empty, labels.limit(0))).count() == 0
    assert len({r["score"] for r in scored.where("text = 'a b c d e f g'").collect()}) == 1


def plain_turns(turns):
    by = defaultdict(list)
    for c, k, role, text in turns:
        by[c].append((k, role or "", text or ""))
    for c, own in by.items():
        yield c, sorted(own)


def test_op5(spark, data):
    both = "</s>[INST] ok [/INST]"
    turns = rows(data, "conversations", "conv_id, turn, role, text") + [(-7, 0, "user", both), (-7, 1, "assistant", both)]
    found = got(QUERIES["op5_reply_trees"](spark, data), "conv_id")
    want = dict(plain_turns(turns))
    assert set(found) == set(want)
    for c, own in want.items():
        loss = "".join(t for _, r, t in own if r == "assistant")
        assert found[c]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, r, t in own)) and found[c]["n_turns"] == len(own)
        assert (found[c]["loss_chars"], found[c]["loss_sha256"]) == (len(loss), sha(loss))


def test_op5_trees(spark):
    # 1 -> 2 -> 4 and 1 -> 3, of which 3 scores more; 9 is a tree of its own; 7 and 8 are a cycle.
    data = [("c", 1, None, "user", "q <|end|>\\l", 0.0), ("c", 2, 1, "assistant", "low", 1.0), ("c", 4, 2, "user", "on", 0.5), ("c", 3, 1, "assistant", "high [x]|>", 5.0),
            ("c", 9, 77, "user", None, 1.0), ("c", 7, 8, "user", "a", 1.0), ("c", 8, 7, "user", "b", 1.0), (None, 1, None, "user", "lone", 1.0)]
    messages = spark.createDataFrame(data, "conv_id string, node long, parent long, role string, text string, score double")
    messages = messages.na.fill({"text": ""})
    best = {(r["conv_id"], r["root"]): r for r in reply_tree.read_turns(reply_tree.format_turns(reply_tree.best_branches(messages))).collect()}
    assert set(best) == {("c", 1), ("c", 9), (None, 1)}
    chosen = best["c", 1]
    assert chosen["leaf"] == 3 and [(t["role"], t["text"]) for t in chosen["read"]] == [("user", "q <|end|>\\l"), ("assistant", "high [x]|>")]
    assert chosen["read_loss"] == ["high [x]|>"] and chosen["formatted"].count("<|end|>") == 2


def test_op5_leaf_below_a_cycle(spark):
    messages = [(1, 1, 2, "user", "a", 1.0), (1, 2, 1, "user", "b", 1.0), (1, 3, 2, "user", "leaf", 9.0), (2, 1, None, "user", "root", 0.0), (2, 2, 1, "assistant", "leaf", 0.0)]
    best = reply_tree.best_branches(spark.createDataFrame(messages, "conv_id long, node long, parent long, role string, text string, score double"))
    assert [(r["conv_id"], [t["text"] for t in r["turns"]]) for r in best.collect()] == [(2, ["root", "leaf"])]


def test_op5_awkward(spark):
    schema = "conv_id long, turn long, role string, text string, extra int"
    turns = spark.createDataFrame([(1, 2, "user", "b", 1), (1, None, "user", "a", 1), (1, 2, "user", "b", 1), (None, 0, None, None, 2)], schema)
    for t, want in ((turns, {1: 3, None: 1}), (turns.limit(0), {})):
        read = reply_tree.read_turns(reply_tree.format_turns(reply_tree.best_branches(reply_tree.chain(t))))
        assert {r["conv_id"]: len(r["read"]) for r in read.collect()} == want


def test_op6(spark, data):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    found = got(QUERIES["op6_pieces"](spark, data), "doc_id")
    docs = rows(data, "documents", "doc_id, text")
    assert len(found) == len(docs)
    for d, t in docs:
        ids = library.encode(t or "", add_eos=True)
        assert found[d] == {"doc_id": d, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(str, ids))), "decoded_sha256": sha(library.decode(ids))}


def test_op6_awkward(awkward, empty):
    encode = lambda df: pieces.encode(df, tokenizer_file("piece_bpe_32k.model"), 2)
    assert sorted(r["n_tokens"] for r in encode(awkward).collect())[:2] == [1, 1] and encode(awkward).count() == len(AWKWARD)
    assert encode(empty).count() == 0


def test_op7(spark, data):
    pages = rows(data, "pages", "page_id, url, html")
    found = got(QUERIES["op7_page_diff"](spark, data), "page_id")
    assert len(found) == len(pages)
    for i, url, html in pages:
        article = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        want = " ".join(page_diff.entities.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", article))).split())
        assert (found[i]["url"], found[i]["text"], found[i]["n_chars"]) == (url, want, len(want))


def plain_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def test_op7_shares_what_plain_differencing_shares(spark):
    data = "/root/testdata/sf0.01"
    pages = rows(data, "pages", "page_id, url, html")
    placed = []
    for i, url, html in pages:
        rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
        host = re.match("[^/?#]*", rest).group()
        placed.append((host.lower(), re.match("[^?#]*", rest[len(host) :]).group(), i, [t for t, _, _ in page_diff.lines(html)]))
    placed.sort(key=lambda p: (p[0].encode(), p[1].encode(), p[2]))
    found = {r["page_id"]: r["shared"] for r in page_diff.shared_lines(spark.read.parquet(f"{data}/pages.parquet")).collect()}
    alike = lambda a, b: next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    for k, (host, path, i, own) in enumerate(placed):
        near = [placed[j] for j in range(max(0, k - 2), min(len(placed), k + 3)) if j != k and placed[j][0] == host]
        copies = [g for g in near if sum(min(own.count(t), g[3].count(t)) for t in set(own)) >= 0.9 * len(own)]
        near = [g for g in near if g not in copies] or near
        most = max((alike(path, g[1]) for g in near), default=0)
        partners = [g for g in near if alike(path, g[1]) == most]
        assert len(found[i]) in {plain_lcs(own, g[3]) for g in partners} if partners else found[i] == []
    assert any(found.values())


def test_op7_pairs(spark):
    site = lambda body, foot="Contact us": f"<body><p>The Daily</p>{body}<p>{foot}</p></body>"
    pages = [(1, "http://a.com/x/1", site("<p>one</p>")), (2, "http://a.com/x/2", site("<p>two</p>")), (3, "http://b.com/x/1", site("<p>three</p>")), (4, None, None), (5, "http://a.com/x/2", site("<p>two</p>")),
             (1, "http://a.com/x/1", site("<p>one</p>")), (None, "http://c.com/", "<p>c")]
    df = spark.createDataFrame([(*p, "kept", "lost") for p in pages], "page_id long, url string, html string, shared_with string, text string").repartition(5)
    found = page_diff.extract(df).collect()
    assert len(found) == len(pages) and all(r["shared_with"] == "kept" for r in found)
    texts = {r["page_id"]: r["text"] for r in found}
    # 3 is alone on its host; 2 and 5 are copies, as are the two of 1, and are paired with another page.
    assert texts[3] == "The Daily three Contact us" and texts[4] == "" and texts[None] == "c"
    assert texts[1] == "one" and texts[2] == texts[5] == "two"
    assert page_diff.extract(df.limit(0)).count() == 0


def plain_components(docs, words=5):
    sets = {}
    for k, (_, t) in enumerate(docs):
        w = [x for x in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if x]
        sets[k] = {tuple(w[j : j + words]) for j in range(max(1, len(w) - words + 1))} if w else set()
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    at = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            at[x].add(k)
    for k, s in sets.items():
        for j in {j for x in s for j in at[x] if j < k}:
            both = len(s & sets[j])
            if 100 * both >= 80 * (len(s) + len(sets[j]) - both):
                a, b = find(k), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for k, (d, _) in enumerate(docs):
        least[find(k)] = min(d, least.get(find(k), d))
    return {d: (len(sets[k]), least[find(k)]) for k, (d, _) in enumerate(docs)}


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_op8(spark, folder):
    data = f"/root/testdata/{folder}"
    docs = sorted(rows(data, "documents", "doc_id, text"))
    found = got(QUERIES["op8_shingle_join"](spark, data), "doc_id")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == plain_components(docs)


def test_op8_chains_and_groups(spark):
    words = [sha(str(k))[:5] for k in range(400)]
    docs = [(100 + k, " ".join(words[3 * k : 3 * k + 120])) for k in range(40)]  # each like the next, the ends unlike
    docs += [(500 + k, " ".join([*words[200:330], f"end{k}"])) for k in range(30)]  # all alike
    docs += [(700 + k, " ".join([*words[0:20], *(sha(f"{k}-{j}")[:5] for j in range(60))])) for k in range(30)]  # a passage in common
    docs += [(900, "A b"), (901, "a B"), (902, "a b c"), (903, ""), (904, ""), (905, "   ")]
    found = got(shingle_join.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(7)), "doc_id")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == plain_components(docs)


def test_op8_long_chain(spark):
    words = [sha(str(k))[:8] for k in range(8200)]
    order = sorted(range(1000), key=lambda k: sha(f"at {k}"))
    docs = [(order[k], " ".join(words[8 * k : 8 * k + 120])) for k in range(1000)]  # each like the next alone
    found = got(shingle_join.link(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)), "doc_id")
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in found.items()} == plain_components(docs)
    assert {r["component_id"] for r in found.values()} == {0}


def test_components_of_paths(spark):
    order = sorted(range(1000), key=lambda k: sha(f"at {k}"))
    edges = [*zip(order, order[1:], strict=False), (5000, 4000), (3000, 4000), (7000, 7000)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1000), 0), **dict.fromkeys((3000, 4000, 5000), 3000)}


def test_op8_awkward(awkward, empty):
    found = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in shingle_join.link(awkward).collect()))
    assert [(d, c) for n, d, _, c in found if not n] == [(1, 1), (2, 2), (3, 3), (3, 3), (5, 5), (6, 3), (9, 9)] and found[-1][3] is None
    assert shingle_join.link(empty).count() == 0 and shingle_join.dedup(empty).count() == 0
    left = shingle_join.dedup(awkward)  # repeated rows are copies of each other too
    assert left.columns == awkward.columns and sorted((r["doc_id"] or 0, r["text"], r["score"]) for r in left.collect()) == sorted((d or 0, t, "z") for d, t in {*AWKWARD} - {(6, "a b c d e f g")})


def test_op8_rows_that_share_an_id(spark):
    docs = [(1, "a b c d e f", 1), (5, "a b c d e f", 2), (5, "quite another text stands here", 3), (5, "quite another text stands here", 3), (7, "quite another text stands here", 4), (None, "p q r s t u v", 5), (8, "p q r s t u v", 6), (1, "", 7)]
    left = shingle_join.dedup(spark.createDataFrame(docs, "doc_id long, text string, first long"))
    assert sorted(r["first"] for r in left.collect()) == [1, 3, 5, 7]


def plain_hits(docs, items, size=13):
    words = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or "")) if w]
    grams = defaultdict(set)
    for i, t in items:
        w = words(t)
        k = min(len(w), size)
        for j in range(len(w) - k + 1 if w else 0):
            grams[tuple(w[j : j + k])].add(str(i))
    lengths = {len(g) for g in grams}
    for d, t in docs:
        w = words(t)
        hit, ids = set(), set()
        for k in lengths:
            for j in range(len(w) - k + 1):
                if (g := tuple(w[j : j + k])) in grams:
                    hit.update(range(j, j + k))
                    ids |= grams[g]
        yield d, (len(w), len(hit), len(ids), sha(",".join(sorted(ids))), len(hit) > 0 and 20 * len(hit) >= len(w))


def test_op9(spark):
    data = "/root/testdata/sf0.01"
    found = got(QUERIES["op9_decontaminate"](spark, data), "doc_id")
    want = dict(plain_hits(rows(data, "documents", "doc_id, text"), rows(data, "benchmark", "item_id, text")))
    names = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert {d: tuple(r[n] for n in names) for d, r in found.items()} == want and any(w[4] for w in want.values())


def test_op9_small(spark, awkward, empty):
    items = [("b'1", "One two, three."), ("a", "three"), ("c", "..."), ("d", None), ("b'1", "w0 " + " ".join(f"w{k}" for k in range(1, 20)))]
    docs = [(1, "zero ONE two three four"), (2, "one two"), (3, " ".join(f"w{k}" for k in range(40))), (4, "élan one two"), (5, None)]
    frame = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame(docs, "doc_id long, text string")
    want = dict(plain_hits(docs, items))
    for limit in (1000, 0):  # sets in the plan, and by join
        found = got(decontaminate.report(decontaminate.scan(table, frame, limit=limit)), "doc_id")
        assert {d: tuple(r[n] for n in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for d, r in found.items()} == want
    assert decontaminate.scan(awkward, frame).count() == len(AWKWARD) and decontaminate.scan(empty, frame).count() == 0
    assert decontaminate.scan(awkward, frame.limit(0)).where("contaminated").count() == 0
    assert decontaminate.clean(awkward, frame).columns == awkward.columns


def plain_verdict(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    whole = re.match(r"[^?#]*", rest).group()
    host = re.sub("[A-Z]", lambda m: m.group().lower(), re.match(r"[^/?#]*", rest).group())
    path = whole[len(host) :]
    fits = [(len(r), len(h), v == "block", r, v) for v, r in rules for h, p in [(r[: r.index("/")], r[r.index("/") :])] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[3], max(fits)[4]) if fits else (host, path, None, "allow")


def test_op10(spark):
    data = "/root/testdata/sf0.01"
    found = got(QUERIES["op10_url_filter"](spark, data), "page_id")
    assert {i: tuple(r[n] for n in ("host", "path", "rule", "verdict")) for i, r in found.items()} == {i: plain_verdict(u) for i, u in rows(data, "pages", "page_id, url")}


def test_op10_very_long_hosts(spark):
    urls = [(1, "http://" + "a." * 100_000 + "example.net/en/x"), (2, "http://" + "net." * 50_000 + "com/" + "d" * 100_000), (3, "http://" + "." * 100_000)]
    judged = url_filter.judge(spark.createDataFrame(urls, "page_id long, url string"), url_filter.rules_table(spark, url_filter.RULES))
    assert {r["page_id"]: (r["rule"], r["verdict"]) for r in judged.collect()} == {1: ("example.net/en/", "allow"), 2: (None, "allow"), 3: (None, "allow")}


def test_op10_awkward(spark):
    urls = [None, "", "no scheme", "http://", "http://NET/x", "http://a.Net", "ftp://x.example.net/en/a?b", "//net/", "http://knet/a", "http://u@example.com:80/de/", "http://example.com/de/é#x", "http://org/fr/", "a://b.org/fr/\n://net/"]
    pages = spark.createDataFrame([(k, u, "mine") for k, u in enumerate(urls + urls)], "page_id long, url string, verdict string")
    found = got(url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES)), "page_id")
    assert {k: tuple(r[n] for n in ("host", "path", "rule", "verdict")) for k, r in found.items()} == {k: plain_verdict(u) for k, u in enumerate(urls + urls)}
    assert url_filter.judge(pages, url_filter.rules_table(spark, url_filter.RULES).limit(0)).where("verdict = 'allow'").count() == len(urls) * 2
    assert url_filter.judge(pages.limit(0), url_filter.rules_table(spark, url_filter.RULES)).count() == 0


def test_sql_of_queries(spark, data):
    for name, sql in queries.SQL.items():
        for t in ("documents", "pages", "benchmark", "labels", "conversations"):
            duckdb.sql(f"create or replace view {t} as select * from '{data}/{t}.parquet'")
        want = duckdb.sql(sql)
        df = QUERIES[name](spark, data)
        assert sorted(want.columns) == sorted(df.columns), name
        columns = sorted(df.columns)
        assert sorted(map(repr, want.select(", ".join(columns)).fetchall())) == sorted(repr(tuple(r)) for r in df.select(columns).collect()), name
