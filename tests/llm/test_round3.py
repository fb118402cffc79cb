"""The later operators against brute force: alignment of tokenisers, spelling variants, text of pages."""

import collections
import difflib
import hashlib
import random
import re
import zlib
from html.parser import HTMLParser

import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment, html_extraction, spelling

BYTE_BPE, PIECE_BPE = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# --- alignment ---


def spelled_out(a, b):
    """Token ids and byte ranges of a text under both tokenisers, by the libraries' plain calls."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(sorted(set(range(256)) - set(shown)))}

    def tokens(text):
        ids_a = a.encode(" " + text, add_special_tokens=False).ids
        raw_a = [bytes(of[c] for c in a.id_to_token(i)) for i in ids_a]
        ids_b = b.encode(text)
        raw_b = [bytes([int(x[3:5], 16)]) if b.is_byte(i) else x.replace("▁", " ").encode() for i in ids_b for x in [b.id_to_piece(i)]]
        if not text or b"".join(raw_a) != (" " + text).encode() or b"".join(raw_b) != (" " + text).encode():
            return [], []
        out = []
        for ids, raw in ((ids_a, raw_a), (ids_b, raw_b)):
            at, own = 0, []
            for i, x in zip(ids, raw, strict=True):
                own.append((i, at, at + len(x)))
                at += len(x)
            out.append(own)
        return out

    return tokens


def aligned_by_hand(pairs):
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    tokens = spelled_out(a, sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE))
    each, counts = [], collections.Counter()
    for i, text in pairs:
        x, y = tokens(text or "")
        links = [(p, q) for p, s, e in x for q, t, f in y if s < f and t < e] if len(x) < 3000 else None
        if links is None:  # long texts: both in order
            links, j = [], 0
            for p, s, e in x:
                while y[j][2] <= s:
                    j += 1
                k = j
                while k < len(y) and y[k][1] < e:
                    links.append((p, y[k][0]))
                    k += 1
        counts.update(set(links))
        cuts = sorted({e for _, _, e in x} & {e for _, _, e in y})
        side = lambda own: [[str(i) for i, _, e in own if low < e <= high] for low, high in zip([0, *cuts], cuts, strict=False)]
        groups = ";".join(",".join(p) + "|" + ",".join(q) for p, q in zip(side(x), side(y), strict=True)) if len(x) < 3000 else None
        each.append((i, len(x), len(y), len(cuts), links, hashlib.sha256(groups.encode()).hexdigest() if groups else groups))
    best = collections.Counter()
    for (p, _), n in counts.items():
        best[p] = max(best[p], n)
    return [(i, na, nb, ng, len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), d) for i, na, nb, ng, links, d in each]


AWKWARD = ["a  b", " ", "   ", "x ", "\n", "a\n  b \n c", "tab\t x", "  lead", "▁a", "a▁ b", "<|endoftext|> <s> <0x41>", "naïve 東京🙂 \x00 \x1c y\x1c z", "é 　 w  q", "a   b\x85 c", "''s 're  'll", "....    ----", "\r\n\r\n x", "it's, 'sure' (word), 'll x.y.z a-b_c don't.'s \"q\"", "e\u0301. word1, 1st. x\n. .\nÀ× ÷y!Z", "...a ...1 a,1 a\u3000. .\u3000b", "que&&& re%%%.### $$$a"]


@pytest.mark.parametrize("most", [2_000_000, 40, 0])
def test_alignment(spark, docs, nothing, pairs, most):
    rows = [*pairs, *((1000 + i, x) for i, x in enumerate(AWKWARD)), (1000, "a  b")]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[len(pairs) :], "doc_id long, text string"))
    got = alignment.align(df, BYTE_BPE, PIECE_BPE, most_sent=most).collect()
    want = aligned_by_hand(rows)
    long = {(w[0], w[1]) for w in want if w[-1] is None}
    assert collections.Counter((*r[:-1], None) if (r[0], r[1]) in long else tuple(r) for r in got) == collections.Counter(want)
    assert alignment.align(nothing, BYTE_BPE, PIECE_BPE).count() == 0


def test_alignment_of_a_text_of_one_chunk():
    aligner = alignment.Aligner(BYTE_BPE, PIECE_BPE)
    for chunk in (" " + "ab" * 5000, " \n\n", " 東京" * 1):
        (x,) = aligner.of([chunk])
        assert x[0] and x[3] >= 1 and aligner.of([chunk])[0] is x


# --- spelling ---


def spelled_by_hand(pairs, noise, length, least):
    seen = collections.Counter()
    for i, text in pairs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= length:
                seen[run] += 1
    return {w: n for w, n in seen.items() if n >= least}


def one_edit(x, y):
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y, strict=True)) == 1
    x, y = sorted((x, y), key=len)
    return len(y) == len(x) + 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def formed_by_hand(words):
    near = {w: sorted((-words[v], v) for v in words if v != w and abs(len(v) - len(w)) < 2 and one_edit(v, w)) for w in words}
    form = {w: near[w][0][1] if near[w] and -near[w][0][0] >= 5 * words[w] else None for w in words}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], len(near[w]), words[form[w]] if form[w] else None) for w in words}


def letters(seed, n):
    """Words of few letters, so that many are near and blocks are large; some with runs of one letter."""
    r = random.Random(seed)
    return ["".join(r.choice("aabé") for _ in range(r.randint(5, 9))) for _ in range(n)]


@pytest.mark.parametrize("most", [128, 4, 1])
def test_spelling(spark, nothing, most):
    rows = [(i, " ".join(letters(i, 400)) + " Áaaaaa-Zebraaa zebraaa, " + "aaaaaa " * i) for i in range(12)] + [(None, "aabaab " * 9), (3, None), (3, ""), (4, "aabaab " * 9), (4, "aabaab " * 9), (99, "x" * 5000 + " " + "x" * 4999)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    limits = {"noise": 7, "length": 5, "least": 2}
    words = spelled_by_hand(rows, **limits)
    assert {tuple(r) for r in spelling.vocabulary(df, **limits).collect()} == set(words.items())
    got = [tuple(r) for r in spelling.spelling(df, most=most, **limits).collect()]
    assert len(got) == len(words) and set(got) == formed_by_hand(words)
    assert spelling.spelling(nothing).count() == 0


def test_each_pair_once(spark):
    words = sorted({w for w in letters(5, 3000)})
    df = spark.createDataFrame([(w, 5) for w in words], "word string, n long")
    for most in (128, 2):
        blocks = spelling.blocks(df, most).groupBy(*spelling.BLOCK).count()
        assert blocks.filter(f"count > {most} and m - a - b > 1").count() == 0
        got = collections.Counter((r.word, r.other) for r in spelling.near(df, most).collect())
        assert set(got.values()) == {1} and set(got) == {(x, y) for x in words for y in words if x != y and one_edit(x, y)}


# --- pages ---

PAGE = """<!DOCTYPE html><html lang=en><head><title>Not this</title><style>p{margin:0}</style><script>var t="</p><article>no</article>";</script></head>
<body class="post comments-open"><header class=site><h1>Site</h1></header><nav><ul><li><a href="/x">Home<li>News</ul></nav><!-- <p>no</p> --><div class="cookie-banner">We use cookies</div>
<div class="ad">Buy {k}</div><article class="entry"><header><h1>Title &amp; &#233;t&eacute; {k}</h1></header><p><b>One
 two<br>three &lt;b&gt;<p>Same line</p><aside>Read also</aside><div>Four <i>fi</i>ve&nbsp;six<ul><li>Item<li>Item 2</ul>tail</div>
<form><input value=x><label>Mail</label></form><table><tr><td>a<td>b</table><script>no()</script><div id="comments"><article class="comment"><p>First!</p></article></div></article>
<footer>&copy; us</footer></body></html>"""
MAIN = "Title & été {k}\n\nOne two three <b>\n\nSame line\n\nFour five six\n\nItem\n\nItem 2\n\ntail\n\na\n\nb"
PLAIN = "<div>Menu</div><div>Top stories</div><p>Text {k}</p><p>More of {k}</p><div>About us</div><div>Legal"


def test_lines_of_a_page():
    page = PAGE.replace("{k}", "7")
    assert "\n\n".join(t for t, k in html_extraction.lines_of(page) if k == html_extraction.ARTICLE) == MAIN.replace("{k}", "7")
    assert html_extraction.lines_of("") == [] and html_extraction.lines_of("<p") == []
    assert html_extraction.lines_of("a <b>b</b>c<p>d &amp") == [("a bc", 0), ("d &", 0)]
    assert html_extraction.lines_of("<p>x < y & z</p></p></div><td>1") == [("x < y & z", 0), ("1", 0)]
    assert html_extraction.lines_of("<div>" * 3000 + "deep") == [("deep", 0)]


class Reader(HTMLParser):
    """The article's lines by another parser, for pages of the test tables' kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.lines, self.text = False, [], ""

    def ended(self):
        if self.text.split():
            self.lines.append(" ".join(self.text.split()))
        self.text = ""

    def handle_starttag(self, tag, attrs):
        if tag not in ("b", "br"):
            self.ended()
        self.inside |= tag == "article"
        self.text += " " if tag == "br" else ""

    def handle_endtag(self, tag):
        if tag not in ("b", "br"):
            self.ended()
        self.inside &= tag != "article"

    def handle_data(self, data):
        self.text += data if self.inside else ""


def read(page):
    r = Reader()
    r.feed(page or "")
    r.close()
    return "\n\n".join(r.lines)


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_pages(spark, ranges):
    urls = [f"http://{'hot' if i % 3 else 'h%d' % (i % 5)}.example.org/{'abc'[i % 3]}/{i}{'?q=1' if i % 2 else ''}" for i in range(60)]
    rows = [(i, u, (PAGE if i % 4 else PLAIN).replace("{k}", str(i))) for i, u in enumerate(urls)]
    rows += [(100, None, PLAIN.replace("{k}", "no url")), (101, "not a url", None), (102, urls[8], ""), (None, urls[4], PAGE.replace("{k}", "4")), (4, urls[4], rows[4][2]), (4, urls[4], rows[4][2])]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], "page_id long, url string, html string, key string, r int").repartition(5)
    got = collections.Counter((r.page_id, r.url, r.text) for r in html_extraction.extract(df, ranges).collect())
    assert got == collections.Counter((i, u, t) for (i, u, _), t in zip(rows, differenced_by_hand(rows), strict=True))
    texts = {i: t for i, _, t in got}
    assert texts[5] == MAIN.replace("{k}", "5") and texts[100].startswith("Menu") and texts[101] == texts[102] == ""
    assert html_extraction.extract(df.limit(0), ranges).count() == 0


def differenced_by_hand(rows):
    """Texts by sorting all pages and a plain table of common subsequences."""
    order = sorted(range(len(rows)), key=lambda k: (html_extraction.key_of(rows[k][1], rows[k][0]), k))
    lines = [html_extraction.lines_of(h or "") for _, _, h in rows]
    out = [""] * len(rows)
    for at, k in enumerate(order):
        kinds = [x for _, x in lines[k]]
        wanted = next((x for x in (2, 1, 0) if x in kinds), 0)
        mine = [t for t, x in lines[k] if x == wanted]
        gone = set()
        for j in (order[n] for n in (at - 1, at + 1) if 0 <= n < len(order)):
            host = [html_extraction.host_of(html_extraction.key_of(rows[x][1], rows[x][0])) for x in (j, k)]
            other = next((x for x in (2, 1, 0) if x in [y for _, y in lines[j]]), 0)
            if host[0] == host[1] != "" and wanted != 2 and mine != [t for t, x in lines[j] if x == other]:
                # In these pages no line is repeated, so any longest common subsequence has the same lines.
                a, b = [t for t, _ in lines[k]], [t for t, _ in lines[j]]
                gone |= {a[x] for m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for x in range(m.a, m.a + m.size)}
        out[k] = "\n\n".join(t for t in mine if t not in gone)
    return out


def test_unmarked_pages_lose_what_neighbours_share(spark):
    df = spark.createDataFrame([(i, f"https://a.org/x/{i}", PLAIN.replace("{k}", str(i))) for i in range(5)] + [(9, "https://b.org/x/9", PLAIN.replace("{k}", "9"))], "page_id long, url string, html string")
    got = {r.page_id: (r.text, r.n_shared) for r in html_extraction.extract(df).collect()}
    assert got[2] == ("Text 2\n\nMore of 2", 4) and got[9] == ("Menu\n\nTop stories\n\nText 9\n\nMore of 9\n\nAbout us\n\nLegal", 0)


def test_common_subsequences():
    for seed in range(300):
        r = random.Random(seed)
        a, b = ([r.randrange(r.choice([2, 5, 40])) for _ in range(r.randrange(30))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        for most in (1 << 29, 20):
            held, html_extraction.HELD_BITS = html_extraction.HELD_BITS, most
            places = html_extraction.common(a, b)
            html_extraction.HELD_BITS = held
            assert len(places) == table[-1][-1] and places == sorted(set(places))
            rest = iter(b)
            assert all(a[i] in rest for i in places)


def test_given_pages_by_another_parser(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: read(r.html) for r in df.collect()}
    assert {r.page_id: r.text for r in html_extraction.extract(df).collect()} == want
