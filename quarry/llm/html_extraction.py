"""Main text of pages by differencing each with the pages whose URLs are nearest.

A page is cut into lines, the texts of its blocks, each with what its markup says: part
of an article, furniture (menus, headers, footers, sidebars, notices, adverts, forms,
comments), or neither. Within a host pages are sorted by URL path, and each is aligned
with the ones before and after it by a longest common subsequence of lines. Shared lines
go, with two exceptions that the markup decides: lines of an article stay, as copies and
common passages share lines, too; furniture goes even where no neighbour shares it, as
menus and adverts change from page to page. Where a page has an article, nothing
outside of it is main text. A neighbour whose lines outside of furniture are all the
page's own is a copy, which tells nothing.

Pages are dealt out once, by ranges of host and path. The ranges' bounds come from a
sample of the keys, and the pages next to a bound (found by a pass over the URLs) are
sent to both sides, so results don't depend on where the bounds are. A hot host is many
ranges. Only lines that may be main text are sent as text, all others as hashes.

Defined cases: null html has no text; a null URL, or one without a host, has no
neighbours; pages of one path follow by URL and id, repeated rows by their lines, and
each row gives a row; null ids come first; html that is cut off or badly nested is read
as far as it goes; very long pages are aligned in memory that grows with their lines; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import on_batches

# Names of HTML's elements, and words that sites use in the class, id or role of furniture.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split())
UNSEEN = frozenset("script style noscript template iframe object svg math canvas audio video head textarea select button datalist noembed noframes".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside form dialog menu search fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments disqus respond reply replies widget widgets toolbar pagination pager copyright".split())
HEADERS = frozenset(["header", "banner"])
#: Elements that a new one of the same name, or of the second kind, ends.
ENDS = {"head": BLOCKS - {"title", "html"}, "p": BLOCKS - {"body", "html"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
#: What an element is looked for in, when the start of another ends it.
INSIDE = frozenset("ul ol dl table td th div section article aside nav main body html blockquote form".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^\"'>])*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
WORDS = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
#: Open elements among which the one is looked for that a tag ends without naming it, or that an inline element's end tag names; so deep nesting takes no more than its time.
NEAR = 512
#: Kinds of lines.
OTHER, MAIN, ARTICLE, OUT = 0, 1, 2, 3

#: Keys that are sampled for each range.
SAMPLED = 40
#: Bits of an alignment's rows that are held at once.
HELD_BITS = 1 << 29


def kind_of(name: str, attributes: str, now: int) -> int:
    """The kind of the lines in an element, of which the one around is `now`."""
    if now == OUT:
        return OUT
    found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    roles, inside = set(found.get("role", "").lower().split()), now == ARTICLE
    marks = {w.lower() for k in ("class", "id") for w in WORDS.findall(found.get(k, ""))}
    if name not in ("html", "body", "main"):
        if name in FURNITURE or roles & ROLES or not inside and (name == "header" or marks & HEADERS):
            return OUT
        if marks & MARKS and (name != "article" or inside or marks & {"comment", "comments", "reply"}):
            return OUT
    if name == "article" or "article" in roles or "articlebody" in found.get("itemprop", "").lower():
        return ARTICLE
    return max(now, MAIN) if name == "main" or "main" in roles else now


def lines_of(page: str) -> list[tuple[str, int]]:
    """(text, kind) of the blocks of a page, in order; empty ones are left out."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    open_: list[tuple[str, int]] = []
    counts: Counter[str] = Counter()
    kind, at, unseen = OTHER, 0, 0

    def ended() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, kind))

    while True:
        tag = TAG.search(page, at)
        if not unseen and (tag.start() if tag else len(page)) > at:
            text.append(page[at : tag.start() if tag else len(page)])
        if not tag:
            break
        at = tag.end()
        if tag[2] is None:
            if not unseen and tag[0].startswith("<![CDATA["):
                text.append(html.escape(tag[0][9:].removesuffix("]]>")))
            continue
        name = tag[2].lower()
        if tag[1]:
            if name in BLOCKS:
                ended()
            if not counts[name]:
                continue
            if name not in BLOCKS:  # an inline element ends inside its block only
                near = takewhile(lambda e: e[0] not in BLOCKS, islice(reversed(open_), NEAR))
                if not any(x == name for x, _ in near):
                    continue
            while open_:
                last, kind = open_.pop()
                counts[last] -= 1
                unseen -= last in UNSEEN
                if last in BLOCKS and last != name:
                    ended()
                if last == name:
                    break
            continue
        if name in BLOCKS:
            ended()
        elif name == "br":
            text.append("\n")
        while name in BLOCKS and open_:
            k = next((k for k in range(len(open_) - 1, max(-1, len(open_) - 1 - NEAR), -1) if name in ENDS.get(open_[k][0], ()) or open_[k][0] in INSIDE), -1)
            if k < 0 or name not in ENDS.get(open_[k][0], ()):
                break
            kind = open_[k][1]
            for x, _ in open_[k:]:
                counts[x] -= 1
                unseen -= x in UNSEEN
            del open_[k:]
        if name in VOID or tag[3].rstrip().endswith("/") and name in ("svg", "math"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        open_.append((name, kind))
        counts[name] += 1
        unseen += name in UNSEEN
        kind = kind_of(name, tag[3], kind)
    ended()
    return out


def common(a: list[int], b: list[int]) -> list[int]:
    """The places in a of one longest common subsequence of a and b, by rows of bits (one for each place in b)."""
    both = set(a) & set(b)
    at = [i for i, x in enumerate(a) if x in both]
    other = [x for x in b if x in both]
    head = 0
    while head < min(len(at), len(other)) and a[at[head]] == other[head]:
        head += 1
    out, at, other = at[:head], at[head:], other[head:]

    def rows(x: list[int], y: list[int]) -> Iterator[int]:
        where: dict[int, int] = {}
        for i, v in enumerate(x):
            where[v] = where.get(v, 0) | 1 << i
        whole = (1 << len(x)) - 1
        row = whole
        for v in y:
            same = row & where.get(v, 0)
            row = (row + same | row - same) & whole
            yield row

    def found(at: list[int], other: list[int]) -> Iterator[int]:
        if not at or not other:
            return
        x = [a[i] for i in at]
        if len(at) * len(other) > HELD_BITS and len(other) > 1:  # halves of b, each with its part of a
            half = len(other) // 2
            ways = []
            for v, w in ((x, other[:half]), (x[::-1], other[half:][::-1])):
                for last in rows(v, w):
                    pass
                bits = np.unpackbits(np.frombuffer(last.to_bytes((len(v) + 7) // 8, "little"), dtype=np.uint8), bitorder="little")[: len(v)]
                ways.append(np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))]))
            best = int(np.argmax(ways[0] + ways[1][::-1]))
            yield from found(at[:best], other[:half])
            yield from found(at[best:], other[half:])
            return
        kept = list(rows(x, other))
        i, j, own = len(x), len(other), []
        while i and j:
            if kept[j - 1] >> (i - 1) & 1:
                i -= 1
            elif j > 1 and not kept[j - 2] >> (i - 1) & 1:
                j -= 1
            else:
                i, j = i - 1, j - 1
                own.append(at[i])
        yield from reversed(own)

    return [*out, *found(at, other)]


def hashes(lines: list[str]) -> list[int]:
    return [xxhash.xxh3_64_intdigest(x) for x in lines]


def main_text(lines: list[str], kinds: bytes, own: list[int], neighbours: list[tuple[bytes, list[int]]]) -> tuple[str, int]:
    """What stays of a page's lines, and how many are shared. Given are those that may be main text, kinds and hashes of all, and kinds and hashes of the neighbours."""
    shared: set[int] = set()
    gone: set[int] = set()
    mine = [h for h, k in zip(own, kinds, strict=True) if k != OUT]
    for other_kinds, other in neighbours:
        places = common(own, other)
        shared.update(places)
        if mine != [h for h, k in zip(other, other_kinds, strict=True) if k != OUT]:
            gone.update(i for i in places if kinds[i] != ARTICLE)
    text = iter(lines)
    return "\n\n".join(line for i, k in enumerate(kinds) if k != OUT for line in [next(text)] if i not in gone), len(shared)


def key_of(url: str | None, page_id: int | None) -> str:
    """What pages are sorted by: host, path with its parts in order, the whole URL, and the id. Without a host it begins with a zero character."""
    m = re.match(r"(?s)[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].lower(), m[2]) if m else ("", "")
    return "\0".join([host, path.strip("/").replace("/", "\1"), url or "", "" if page_id is None else f"{page_id + (1 << 63):020d}"])


def host_of(key: str) -> str:
    return key.partition("\0")[0]


def bounds_of(pages: DataFrame, ranges: int) -> tuple[list[str], dict[int, tuple[str, str]]]:
    """Keys that begin ranges 1 and up, and the first and last key of each range that has pages. Both are as many as the ranges."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [key_of(u, i) for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([xxhash.xxh3_64_intdigest(k) >> 1 for k in own], pa.int64())], names=["key", "h"])

    urls = pages.select("page_id", "url")
    n = urls.count()
    if not n:
        return [], {}
    # The hash of a key decides, so a sample made again is the same; those with the least hashes would need a sort.
    share = min(1.0, SAMPLED * ranges / n)
    sample = sorted(r["key"] for r in on_batches(urls, keys, "key string, h long").filter(F.col("h") <= min((1 << 63) - 1, int(share * (1 << 63)))).select("key").collect())
    bounds = sorted({sample[len(sample) * k // ranges] for k in range(1, ranges)}) if sample else []

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[str, str]] = {}
        for b in batches:
            for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                k = key_of(u, i)
                r = bisect_right(bounds, k)
                low, high = found.get(r, (k, k))
                found[r] = (min(low, k), max(high, k))
        yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int32()), *(pa.array([x[j] for x in found.values()], pa.string()) for j in (0, 1))], names=["r", "low", "high"])

    rows = on_batches(urls, ends, "r int, low string, high string").groupBy("r").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect()
    return bounds, {r["r"]: (r["low"], r["high"]) for r in rows}


def extract(pages: DataFrame, ranges: int | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_lines and n_shared (of the lines, those in a nearest page, too) for every page."""
    spark = pages.sparkSession
    pages = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds, ends = bounds_of(pages, ranges)
    filled = sorted(ends)
    #: Where a key at the end of a range is needed besides its own.
    also: dict[str, list[int]] = {}
    for r, s in zip(filled, filled[1:], strict=False):
        also.setdefault(ends[r][1], []).append(s)
        also.setdefault(ends[s][0], []).append(r)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(9)]
            size = 0
            for i, url, page in zip(*(c.to_pylist() for c in b.columns), strict=True):
                key, found = key_of(url, i), lines_of(page or "")
                lines, kinds = [x for x, _ in found], bytes(k for _, k in found)
                # Without an article all is text that may be wanted; with one, only its lines.
                wanted = ARTICLE if ARTICLE in kinds else MAIN if MAIN in kinds else OTHER
                kinds = bytes(k if k == wanted else OUT for k in kinds)
                own = hashes(lines)
                packed = np.array(own, dtype="<u8").tobytes()
                kept = [x for x, k in zip(lines, kinds, strict=True) if k != OUT]
                tie = xxhash.xxh3_64_intdigest(packed) >> 1
                size += sum(map(len, kept))
                for r in (bisect_right(bounds, key), *also.get(key, ())):
                    mine = r == bisect_right(bounds, key)
                    for c, v in zip(cols, (r, key, tie, mine, i, url, kept if mine else None, kinds, packed), strict=True):
                        c.append(v)
                if size > 2 << 20:
                    yield out(cols)
                    cols, size = [[] for _ in range(9)], 0
            yield out(cols)

    names = ["r", "key", "tie", "own", "page_id", "url", "lines", "kinds", "hashes"]
    types = [pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.binary(), pa.binary()]

    def out(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def differenced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = now = None
        found: list[tuple] = []

        def judged(before: dict | None, now: dict, after: dict | None) -> None:
            if now["own"]:
                host = host_of(now["key"])
                near = [(x["kinds"], x["all"]) for x in (before, after) if x and host and host_of(x["key"]) == host and x["r"] == now["r"]]
                text, shared = main_text(now["lines"], now["kinds"], now["all"], near)
                found.append((now["page_id"], now["url"], text, len(text), len(now["all"]), shared))

        def rows() -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) if found else [()] * 6
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3], strict=True)], names=["page_id", "url", "text", "n_chars", "n_lines", "n_shared"])

        for b in batches:
            for after in b.to_pylist():
                after["all"] = np.frombuffer(after["hashes"], dtype="<u8").tolist()
                if now:
                    judged(before, now, after)
                before, now = now, after
            yield rows()
        if now:
            judged(before, now, None)
        yield rows()

    dealt = on_batches(pages, parsed, "r int, key string, tie long, own boolean, page_id long, url string, lines array<string>, kinds binary, hashes binary")
    by_range = dealt.repartitionById(ranges, F.col("r")).sortWithinPartitions("r", "key", "tie")
    return on_batches(by_range, differenced, "page_id long, url string, text string, n_chars long, n_lines long, n_shared long")
