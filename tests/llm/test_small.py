"""Plain Python on small inputs: codes, cuts, merges, lines, edge cases."""

import random
import zlib

import numpy as np
import pytest

from clearwell.llm import media, page_diff, pieces, rans, shingle_join, substring_dedup, toxicity
from clearwell.llm.gear import Chunker
from clearwell.llm.queries import tokenizer_file
from clearwell.llm.word_memo import WordEncoder

ODD = ["", " ", "  a  b\n\n c", " x", "x ", "a \n b", "\x01\x02q", "É è ﬁ Å ́a", "<|endoftext|>x <|startoftext|>", "</s>[INST]", "日本語 テスト", "ΑΣ ΟΔΟΣ", "İstanbul", "🙂🙂 ok", "x" * 3000,
       "é" * 100, "a\x00b \x1c c", "▁▁a ▁ b", "....!!!???", "    def f(x):\n        return x", "don't I'LL 123 45.6", "¿Qué? «a» ª º ² µ ÿŸ ß ẞ", "'s 's's ''s", "\t\x0b x y"]


def test_word_encoder_is_the_library():
    encoder = WordEncoder(tokenizer_file("word_bpe_49k.json"))
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab Té'sñ.,1\n<|") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids, text


def test_pieces_are_the_library():
    encoder = pieces.PieceEncoder(tokenizer_file("piece_bpe_32k.model"))
    rng = random.Random(2)
    vocabulary = list(encoder.id)
    texts = ODD + ["".join(rng.choice("abcdeothins. ,'\n▁-=()é日x1/ ") for _ in range(rng.randint(1, 30))) for _ in range(1500)]
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 8))).replace("▁", " ") for _ in range(1500)]
    for text in texts:
        assert encoder.encode(text).tolist() == encoder.library.encode(text), text


@pytest.mark.parametrize("n", [1, 5, 511, 512, 513, 65535, 65536, 65537, 140001])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.zipf(1.3, n) % 1000).astype(np.uint32)
    coder = rans.Coder(rans.Table.of(np.bincount(ids, minlength=1200)))
    docs = [(None, ids[: n // 2]), (7, ids[n // 2 :]), (7, ids[:0])]
    block = coder.encode(docs)
    back = list(coder.decode(block))
    assert [d for d, _ in back] == [None, 7, 7]
    assert all((a[1] == b[1]).all() and len(a[1]) == len(b[1]) for a, b in zip(docs, back, strict=True))


def test_rans_damage_and_wrong_table():
    ids = np.arange(1000, dtype=np.uint32) % 50
    coder = rans.Coder(rans.Table.of(np.bincount(ids)))
    block = bytearray(coder.encode([(1, ids)]))
    with pytest.raises(ValueError, match="another frequency table"):
        list(rans.Coder(rans.Table.of(np.bincount(ids[:977]))).decode(bytes(block)))
    block[-1] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        list(coder.decode(bytes(block)))


def test_frequencies_fill_the_scale():
    counts = np.array([0, 1, 10**9, 3, 0, 5])
    table = rans.Table.of(counts)
    assert table.freq.sum() == 1 << rans.SCALE and ((table.freq > 0) == (counts > 0)).all()
    assert rans.Table.of(np.zeros(4, int)).freq.sum() == 0


def test_gear_is_the_sum_over_its_window():
    from clearwell.llm.gear import TABLE

    chunker = Chunker(bits=3, least=4, most=40, window=16)
    data = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    got = chunker.hashes(data)
    for k in (0, 5, 15, 16, 100, 199):
        want = sum(int(TABLE[data[k - j]]) << j for j in range(min(16, k + 1))) & 0xFFFFFFFF
        assert int(got[k]) == want


def test_chunks_cover_the_data_and_resist_shifts():
    chunker = Chunker(bits=4, least=12, most=64, window=16)
    data = random.Random(4).randbytes(5000)
    ends = chunker.ends(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= 64 and (sizes[:-1] >= 12).all()
    own = {data[a:b] for a, b in zip([0, *ends], ends)}
    moved = b"inserted" + data
    ends = chunker.ends(moved)
    assert len(own & {moved[a:b] for a, b in zip([0, *ends], ends)}) > 0.9 * len(own)
    assert chunker.ends(b"") == [] and chunker.ends(b"abc") == [3]


def test_padding():
    assert media.pad(b"") == bytes(64) and media.pad(b"x" * 64) == b"x" * 64 and len(media.pad(b"x" * 65)) == 128


def test_remove_cuts_at_words():
    text = "First words here. " + " ".join(f"word{k}" for k in range(60)) + " and the end, ñ."
    n = len(substring_dedup.CHUNKER.ends(text.encode()))
    run = {"start": 2, "end": n - 3, "before": b"other", "after": b""}
    total, runs, words, spans, left = substring_dedup.remove(text, [run])
    assert total == n and runs == 1 and words >= 40 and len(spans) == 1
    assert left == text[: spans[0]["start"]] + text[spans[0]["end"] :]
    assert set(left.split()) <= set(text.split())
    whole = substring_dedup.remove(text, [run | {"before": b"?" + text.encode()[6 : substring_dedup.CHUNKER.ends(text.encode())[1]], "after": b"!"}])
    assert whole[2] > words and whole[4] == "First " + left[left.index(" word59") :]
    assert substring_dedup.remove(text, [run | {"end": 3}])[4] == text
    assert substring_dedup.remove(None, [])[4] is None


def brute_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_is_longest():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 12))] for _ in "ab")
        places = page_diff.common(a, b)
        kept, rest = [a[k] for k in places], iter(b)
        assert places == sorted(set(places)) and all(v in rest for v in kept) and len(kept) == brute_lcs(a, b)


def test_common_of_many_repeated_lines():
    a = [0] * 30_000 + [1] + [0] * 10 + [2]
    b = [3] + [0] * 20_000 + [1] + [0] * 30_000 + [2]
    places = page_diff.common(a, b)
    rest = iter(b)
    assert places == sorted(set(places)) and all(a[k] in rest for k in places) and {1, 2} <= {a[k] for k in places} and len(places) >= 20_000


def test_longest_however_many_pairs_are_equal():
    rng = random.Random(6)
    a, b = ([rng.randint(0, 2) for _ in range(n)] for n in (1200, 1300))
    places = page_diff.longest(a, b)
    rest = iter(b)
    assert places == sorted(set(places)) and all(a[k] in rest for k in places) and len(places) == brute_lcs(a, b)
    # The same choice among equals in short lists and in long ones: the first lines of b, then of a.
    many = [9] * 600
    assert page_diff.longest([1, 2, 1], [2, 1, 2]) == [1, 2] and page_diff.longest([1, 2, 1, *many, 3], [2, 1, 2, *many, 4]) == list(range(1, 603))
    for _ in range(300):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 40))] for _ in "ab")
        assert page_diff.longest(a, b) == page_diff.common(a, b) and len(page_diff.longest(a, b)) == brute_lcs(a, b)


def test_op7_takes_the_longest_of_long_pages(spark):
    from pyspark.sql import functions as F

    # Marked-out lines, so often repeated that the two pages have over 200,000 equal pairs: all 460 are shared.
    first, second = ["x"] * 450 + ["one"] + ["x"] * 10, ["own"] + ["x"] * 300 + ["one"] + ["x"] * 450
    rows = [(k, f"https://a.example/{k}", "".join(f"<p>{t}</p>" for t in page)) for k, page in enumerate((first, second))]
    got = page_diff.shared_lines(spark.createDataFrame(rows, "page_id long, url string, html string")).where(F.col("page_id") == 0).first()["shared"]
    assert got == [*range(450), *range(451, 461)]


def test_main_text():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header>Top</header><nav><ul><li><a href="/x">Menu</a></li></ul></nav><!-- c --><div class="ad">Buy</div>
    <article><h1>Head &amp; line</h1><p>One<b>two</b> three<br>four<p>five &#233;&nbsp;six<form><input><label>Name</label></form>
    <div class="comments"><p>Nice!</p></div><aside>More</aside></article><footer>&copy; me</footer>"""
    assert page_diff.main_text(page, []) == "Head & line Onetwo three four five é six"
    assert page_diff.main_text("", []) == "" and page_diff.main_text(None, []) == ""
    # Without markup that names the article, shared lines are the frame.
    plain = "<body><p>Site name</p><p>The story of the day.</p><p>All rights</p></body>"
    assert page_diff.main_text(plain, [0, 2]) == "The story of the day."
    # Shared lines of an article stay.
    assert page_diff.main_text(page, [0, 1, 2, 3, 4]) == "Head & line Onetwo three four five é six"
    assert page_diff.main_text(plain, [0, 1, 2]) == "Site name The story of the day. All rights"
    assert page_diff.main_text("<p>open <b>bold <i>x", []) == "open bold x"


def test_shingles():
    shingler = shingle_join.Shingler()
    assert len(shingler.set_of(None)) == len(shingler.set_of(" \t\n")) == 0
    assert len(shingler.set_of("a b")) == 1 and (shingler.set_of("A B") == shingler.set_of("a\x0bb")).all()
    assert len(shingler.set_of("a b c d e f")) == 2 and len(shingler.set_of("a a a a a a a")) == 1
    assert (shingler.set_of("a b c d") != shingler.set_of("a b c d e")).all()


def test_similar_sets_share_prefixes_under_every_order():
    rng = np.random.default_rng(6)
    for _ in range(400):
        n = int(rng.integers(1, 300))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        edits = 1 + n // 12
        b = np.unique(np.concatenate([a[: max(1, len(a) - int(rng.integers(0, edits)))], rng.integers(0, 2**63, int(rng.integers(0, edits))).astype(np.uint64)]))
        both = np.intersect1d(a, b)
        if 100 * len(both) >= 80 * (len(a) + len(b) - len(both)):
            assert len(both) >= shingle_join.share(len(a), len(b))
            shared = np.intersect1d(shingle_join.prefix(a), shingle_join.prefix(b))
            assert len(shared) >= shingle_join.need(min(len(a), len(b)))
            df = {x: int(rng.integers(1, 50)) for x in np.union1d(a, b).tolist()}
            useful = [np.array([x for x in s.tolist() if x in both or rng.random() < 0.3], np.uint64) for s in (a, b)]
            first = [shingle_join.late_prefixes(len(s), np.array([df[x] for x in u.tolist()]), u) for s, u in zip((a, b), useful)]
            room = [len(u) - shingle_join.share(len(a), len(b)) + 1 for u in useful]
            for x, y in zip(*first):
                assert set(x[: room[0]].tolist()) & set(y[: room[1]].tolist())


def test_toxicity_windows_cover_the_text():
    text = "Ab cd, " * 100 + "x" * 500 + " é"
    joined = b"".join(toxicity.windows(text))
    assert joined == b" " + b" ".join(text.lower().replace(",", " ").encode().split())
    assert list(toxicity.windows(None)) == [] and max(map(len, toxicity.windows(text))) <= toxicity.WINDOW_BYTES


def test_toxicity_of_one_class_and_of_none():
    assert toxicity.fit([]).scorer().score("a") < 0.01
    assert toxicity.fit([("a b", 1), (None, 1)]).scorer().score("") > 0.99
    model = toxicity.fit([("", 0), (None, 1), ("x", 0)])
    assert 0 <= model.scorer().score("anything") <= 1


def test_toxicity_learns_marks():
    rng = random.Random(8)
    syllables = ["ba", "ko", "ti", "re", "mu", "la", "ne", "so", "vi", "da"]

    def text(bad):
        words = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(30, 200))]
        for _ in range(rng.randint(2, 5) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["frightful", "wretchedly", "abhorrent"]))
        return " ".join(words)

    rows = [(text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    scorer = toxicity.fit(rows[:300]).scorer()
    right = sum((scorer.score(t) >= 0.5) == (y == 1) for t, y in rows[300:])
    assert right >= 95
    assert scorer.score(rows[0][0]) == scorer.score(rows[0][0])


def test_crc_of_ids():
    assert zlib.crc32(np.array([2], "<u4").tobytes()) == zlib.crc32((2).to_bytes(4, "little"))
