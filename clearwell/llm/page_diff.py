"""Main text of pages by differencing with the page of the nearest URL.

Pages are put in order of host, path and id; of its neighbours of the same host,
NEAR on either side, each page is paired with the one whose path shares the
longest beginning with its own, copies of the page itself last.  The two pages'
lines of text are aligned by longest common subsequence, and shared lines are
deleted: what two pages of a site say alike, in the same order, is their frame.

A line is the text of one block.  Markup decides what differencing cannot: where
it names the article (``article``, ``main`` or the like), shared lines inside it
stay, for copies and quotations share them, and lines outside it go even if they
are not shared.  Navigation, headers, footers, sidebars, notices, adverts, forms
and reader comments named by element, role, class or id are frame anywhere.

Pairing exchanges hashes of lines only.  Its rows are dealt by range of (host,
path, id), so that a host with most of the pages is spread over many tasks.

Edge cases: null or empty html gives an empty text; a null URL is a host of its
own; a page alone on its host is judged by markup alone; unmarked pages whose
text is wholly shared with the neighbour keep it, as copies; equal ids are told
apart by URL and html, and repeated rows stay repeated and are copies of each
other; html gives way to text, a column of that name is replaced, and the other
columns are kept; broken markup is read as far as it goes; very long pages are
read whole, in time that grows with their lines; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, release, shared_folder, written
from .url_filter import host_and_path

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Elements whose content is no text of the page.
HIDDEN = frozenset("script style template noscript iframe object svg math head title textarea select option button canvas audio video".split())
#: Of these, the content is not markup either.
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes".split())
FRAME = frozenset("nav aside footer form dialog menu".split())
MAIN = frozenset("article main".split())
#: Pages and lines up to these numbers are sent to every task; of more, they are joined by shuffle.
BROADCAST_PAGES, BROADCAST_LINES = 100_000, 4_000_000
#: Neighbours on either side that a page may be paired with, and the part of its lines that a copy shares.
NEAR, COPY = 2, 0.9
#: For common(): pairs of equal lines up to which a longest common subsequence is looked for; beyond, lines that stand once in both come first.
MOST_MATCHES = 200_000
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one of the same group ends, within the nearest of the second set.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
BARRIER = frozenset("article main section div body table ul ol dl nav aside footer header form blockquote td th".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_FRAME_WORDS = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|menu|menus|breadcrumbs?|header|masthead|banner|footer|sidebar|side|aside|notice|notices|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|subscription|signup|login|ad|ads|adv|advert|adverts|advertisement|sponsor|sponsored|promo|promoted|share|sharing|social|related|recommended|comments?|commentlist|replies|respond|disqus|widget|toolbar|copyright|pagination|pager|skip|search|form|alert)(?:$|[\s_-])", re.I
)
_FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())


def lines(html: str | None) -> list[tuple[str, bool, bool]]:
    """(text, in frame, in main) of each block of a page, in order; never recurses, and reads broken markup to its end."""
    out: list[tuple[str, bool, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # (element, hidden, frame, main) of what is open
    parts: list[str] = []
    state = (False, False, False)

    def end_block() -> None:
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((text, state[1], state[2]))
            parts.clear()

    def pop(to: int) -> None:
        nonlocal state
        if any(e[0] not in INLINE for e in stack[to:]):
            end_block()
        del stack[to:]
        state = stack[-1][1:] if stack else (False, False, False)

    html, at = html or "", 0
    while at < len(html):
        m = _TOKEN.search(html, at)
        start = m.start() if m else len(html)
        if start > at and not state[0]:
            parts.append(html[at:start])
        if not m:
            break
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            k = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name == "br" or name == "p" and k is None:
                end_block()
            if k is not None and (name not in INLINE or all(e[0] in INLINE for e in stack[k:])):
                pop(k)
            continue
        if name in ENDS_P or name in CLOSES:
            shut = CLOSES.get(name, set()) | ({"p"} if name in ENDS_P else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    pop(k)
                    if name in ("p",) or stack and stack[-1][0] in BARRIER:
                        break
                elif stack[k][0] in BARRIER:
                    break
        if name not in INLINE:
            end_block()
        if name in VOID:
            continue
        attributes = {a.lower(): x or y or z for a, x, y, z in _ATTRIBUTE.findall(m.group(3))} if m.group(3) else {}
        hidden, frame, main = state
        hidden = hidden or name in HIDDEN or "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I) is not None
        role = attributes.get("role", "").lower()
        is_main = name in MAIN or role in ("main", "article") or "articlebody" in attributes.get("itemprop", "").lower()
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip()
        if not is_main:
            frame = frame or name in FRAME or role in _FRAME_ROLES or name == "header" and not main or bool(named and name not in ("html", "body") and _FRAME_WORDS.search(named))
        elif named and re.search(r"(?:^|[\s_-])comments?(?:$|[\s_-])", named, re.I):
            frame = True
        main = main or is_main
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(html, at)
            if name in HIDDEN:
                at = close.end() if close else len(html)
            continue
        if not m.group(3).rstrip().endswith("/") or name not in ("path", "circle", "rect", "use", "line", "polygon"):
            stack.append((name, hidden, frame, main))
            state = (hidden, frame, main)
    end_block()
    return out


def longest(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, whatever their length and however often lines stand again.

    Of several longest ones it is, from the end, the one whose lines come first in b, then first in a.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    middle = _longest(a[lo : len(a) - hi], b[lo : len(b) - hi])
    return [*range(lo), *(lo + k for k in middle), *range(len(a) - hi, len(a))]


def _longest(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b.

    Row i is a number whose n-th set bit is the least place in b that ends a common
    subsequence of n lines with a[: i + 1]; one addition makes a row from the one
    before.  Time is len(a) * len(b) / 64 steps, since a number's bits go 64 at a
    time.  Every k-th row is kept, and those between are made again on the way back.
    """
    known, mine = set(b), set(a)
    rows = [i for i, line in enumerate(a) if line in known]  # what stands on one side only changes no row
    places: dict[int, list[int]] = {}
    m = 0
    for line in b:
        if line in mine:
            places.setdefault(line, []).append(m)
            m += 1
    if not rows:
        return []
    masks = {line: _bits(at, m) for line, at in places.items()}
    full = (1 << m) - 1

    def after(row: int, i: int) -> int:
        # Zeros of left are the row's bits: the usual form of the recurrence.
        left = full ^ row
        met = left & masks[a[rows[i]]]
        return full ^ ((left + met | left - met) & full)

    every = isqrt(len(rows)) + 1
    kept, row = [], 0
    for i in range(len(rows)):
        if i % every == 0:
            kept.append(row)
        row = after(row, i)
    n, j, out = row.bit_count(), row.bit_length() - 1, []
    while kept and n:
        start = (len(kept) - 1) * every
        block = [kept.pop()]  # block[k]: the row before start + k
        for i in range(start, min(start + every, len(rows))):
            block.append(after(block[-1], i))
        for k in range(len(block) - 2, -1, -1):
            before = block[k]
            # The first row whose n-th bit is j is the one that lines up with it.
            if not before >> j & 1 or (before & (2 << j) - 1).bit_count() != n:
                out.append(rows[start + k])
                n -= 1
                if not n:
                    break
                # Of what ends before j, the last has n lines.
                j = (before & (1 << j) - 1).bit_length() - 1
    return out[::-1]


def _bits(at: list[int], m: int) -> int:
    """The number with these bits set."""
    out = bytearray((m >> 3) + 1)
    for k in at:
        out[k >> 3] |= 1 << (k & 7)
    return int.from_bytes(out, "little")


def common(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a common subsequence of a and b; the extraction does not use it, but longest(), whose rule does not change with the size.

    Equal beginnings and endings are set aside.  Where what is left has more than
    MOST_MATCHES equal pairs (lines that stand again and again), the lines that
    stand once in either are aligned first, and between two of them only equal
    beginnings and endings: a common subsequence, if not always a longest one.
    """
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    x, y = a[lo : len(a) - hi], b[lo : len(b) - hi]
    n, m = Counter(x), Counter(y)
    if sum(k * m[line] for line, k in n.items()) <= MOST_MATCHES:
        middle = [i for i, _ in _aligned(x, y)]
    else:
        once = {line for line, k in n.items() if k == m[line] == 1}
        i_of, j_of = ([k for k, line in enumerate(z) if line in once] for z in (x, y))
        anchors = [(i_of[i], j_of[j]) for i, j in _aligned([x[k] for k in i_of], [y[k] for k in j_of])]
        middle = []
        for (i, j), (p, q) in zip([(-1, -1), *anchors], [*anchors, (len(x), len(y))]):
            start, end = 1, 1
            while i + start < p and j + start < q and x[i + start] == y[j + start]:
                middle.append(i + start)
                start += 1
            back = []
            while p - end >= i + start and q - end >= j + start and x[p - end] == y[q - end]:
                back.append(p - end)
                end += 1
            middle += [*reversed(back), *([p] if p < len(x) else [])]
    return [*range(lo), *(lo + k for k in middle), *range(len(a) - hi, len(a))]


def _aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places in a and b of a longest common subsequence.

    For each length the least place in b that ends one is kept, and each place of
    a lengthens what it can (time and memory follow the matches, not the product).
    """
    places: dict[int, list[int]] = {}
    for j in range(len(b) - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    least: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(a):
        for j in places.get(line, ()):
            n = bisect_left(least, j)
            if n == len(least):
                least.append(j)
                ends.append((i, j, ends[n - 1] if n else None))
            elif j < least[n]:
                least[n], ends[n] = j, (i, j, ends[n - 1] if n else None)
    out, node = [], ends[-1] if ends else None
    while node:
        out.append(node[:2])
        node = node[2]
    return out[::-1]


def is_marked(own: list[tuple[str, bool, bool]]) -> bool:
    """True if a page's markup names an article with text."""
    return any(main and not frame for _, frame, main in own)


def main_text(html: str | None, shared: Iterable[int]) -> str:
    """The page's text without its frame; shared: numbers of the lines that the paired page has too."""
    own, shared = lines(html), set(shared)
    marked = is_marked(own)
    # What is shared goes, but for the article's own; of the rest, what markup calls frame.
    left = [line for k, line in enumerate(own) if k not in shared or marked and line[2]]
    kept = [text for text, frame, main in left if not frame and (main or not marked)]
    return " ".join(kept or [text for text, frame, _ in own if not frame and not marked])


def _beginning(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _is_copy(own: list[int], other: list[int]) -> bool:
    """Whether another page has nearly all of a page's lines, whatever their order."""
    return sum((Counter(own) & Counter(other)).values()) >= COPY * len(own)


def shared_lines(pages: DataFrame) -> DataFrame:
    """(page_id, h, shared): the numbers of the lines that each page shares with the one it is paired with; h is a hash of url and html."""
    spark = pages.sparkSession
    prepare(spark)
    shared_folder(spark)
    host, path = host_and_path()

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [lines(h) for h in b.column(4).to_pylist()]
            rows = [[xxhash.xxh3_64_intdigest(t.encode()) - (1 << 63) for t, _, _ in page] for page in own]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(rows, pa.list_(pa.int64()))], ["page_id", "h", "host", "path", "lines"])

    rows = pages.select("page_id", _hash().alias("h"), host.alias("host"), path.alias("path"), "html")
    rows = rows.mapInArrow(hashed, f"page_id {pages.schema['page_id'].dataType.simpleString()}, h long, host string, path string, lines array<long>")
    rows = written(rows, "lines")
    ordered = rows.repartitionByRange("host", "path", "page_id", "h").sortWithinPartitions("host", "path", "page_id", "h")

    def numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for b in batches:
            size = b.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([part] * size, pa.int32()), pa.array(range(n, n + size), pa.int64()), *b.columns], ["part", "n", *b.schema.names])
            n += size

    placed = written(ordered.mapInArrow(numbered, f"part int, n long, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ordered.schema.fields)}"), "placed")
    # One number for each part: where its rows begin in the whole order.
    base, total = {}, 0
    for r in placed.groupBy("part").count().orderBy("part").collect():
        base[r["part"]] = total
        total += r["count"]
    starts = spark.createDataFrame([(k, v) for k, v in base.items()] or [(0, 0)], "part int, base long")
    placed = placed.join(F.broadcast(starts), "part").select((F.col("base") + F.col("n")).alias("at"), "page_id", "h", "host", "path", "lines")

    # A page goes to its own place and to its neighbours'.
    sent = placed.select(F.explode(F.expr(f"transform(sequence(-{NEAR}, {NEAR}), k -> named_struct('to', at - k, 'from', k))")).alias("s"), "page_id", "h", "host", "path", "lines").select("s.*", "page_id", "h", "host", "path", "lines")
    met = sent.repartition("to").sortWithinPartitions("to", "from")

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: dict[int, dict] = {}
        place = None

        def judged() -> list:
            own = group.get(0)
            if own is None:
                return []
            near = [g for k, g in sorted(group.items()) if k and g["host"] == own["host"]]
            if not near:
                return [(own["page_id"], own["h"], [])]
            best = max(near, key=lambda g: (not _is_copy(own["lines"], g["lines"]), _beginning(g["path"], own["path"])))
            return [(own["page_id"], own["h"], longest(own["lines"], best["lines"]))]

        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["to"] != place:
                    rows += judged()
                    place, group = r["to"], {}
                group[r["from"]] = r
            yield pack(rows, b.schema.field("page_id").type)
        rows = judged()
        if rows:
            yield pack(rows, kind)

    kind = {"long": pa.int64(), "bigint": pa.int64(), "int": pa.int32()}.get(pages.schema["page_id"].dataType.simpleString(), pa.string())

    def pack(rows: list, kind: pa.DataType) -> pa.RecordBatch:
        i, h, s = zip(*rows, strict=True) if rows else ((),) * 3
        return pa.RecordBatch.from_arrays([pa.array(i, kind), pa.array(h, pa.int64()), pa.array(s, pa.list_(pa.int32()))], ["page_id", "h", "shared"])

    found = met.mapInArrow(pair, f"page_id {pages.schema['page_id'].dataType.simpleString()}, h long, shared array<int>")
    found = written(found.dropDuplicates(["page_id", "h"]), "shared-lines")
    release(spark)
    return found


def _hash():
    return F.xxhash64(F.coalesce("url", F.lit("")), F.coalesce("html", F.lit("")))


def extract(pages: DataFrame) -> DataFrame:
    """pages with text, the main text of each."""
    found = shared_lines(pages).where("size(shared) > 0").select(F.col("page_id").alias("__id"), F.col("h").alias("__h"), "shared")
    size = found.agg(F.count("*").alias("pages"), F.coalesce(F.sum(F.size("shared")), F.lit(0)).alias("lines")).first()
    if size["pages"] <= BROADCAST_PAGES and size["lines"] <= BROADCAST_LINES:
        found = F.broadcast(found)
    rows = pages.withColumn("__key", _hash())
    joined = rows.join(found, F.col("page_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__h")), "left").drop("__id", "__h", "__key")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h, s or ()) for h, s in zip(b.column("html").to_pylist(), b.column("shared").to_pylist(), strict=True)]
            old = [c for c in b.schema.names if c not in ("html", "shared", "text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in old), pa.array(texts, pa.string())], [*old, "text"])

    kept = [f for f in joined.schema.fields if f.name not in ("html", "shared", "text")]
    return joined.mapInArrow(cut, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "text string"]))
