"""Quality rules from the fertility of a public tokeniser.

A document is measured by how a public vocabulary takes it: characters per
token, the share of tokens that are raw bytes (characters the vocabulary lacks)
and the entropy of its tokens. Bands for the document's script say what can be
language at all. What is normal is measured: fences around the quartiles of the
characters per token and of the entropy over all documents of the script and of
about the same number of tokens. The fewer documents there are of a script and length, the
more its fences are those of the whole script, and the fewer of a script, the more they
are the bands: weights n / (n + HALF) see to it that nothing jumps at a number. Simple
rules on words and repetition come first.

Texts are measured in one pass; the fences come from the measures, which are small.
Only different measures count, so copies of one document do not set them.

Defined cases: a null or empty text has no words, so n_words is 0, base_failed is
true and kept false; repeated rows each give a row; a null id stays null; very
long texts are measured whole; an empty table gives an empty result; columns
other than the two named are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, free_names, held, id_bytes, on_batches, quoted, slices, without

SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, script string, n_pieces long, chars_per_token double, byte_share double, token_entropy double"


@dataclass(frozen=True)
class Band:
    """What is kept: characters per token from low to high, at most so large a share of
    byte tokens and, from `entropy_from` tokens on, at least so many bits of entropy."""

    low: float
    high: float
    byte_share: float
    entropy: float
    entropy_from: int = 64


#: Fences lie so many spreads of the quartiles outside of them ; a spread is so large a part of the median at least.
FENCE, LEAST_SPREAD = 2.0, 0.02
#: So many documents give their own fences half of the weight; those of the script, or then the band, have the rest.
HALF = 1
#: More bits than a token's entropy can have.
MOST_BITS = 32.0
#: By script. Wide on purpose: they are to catch text that is not language, not unusual language.
BANDS = {
    "latin": Band(1.2, 12.0, 0.20, 3.0),
    "greek": Band(0.5, 8.0, 0.60, 3.0),
    "cyrillic": Band(0.8, 8.0, 0.40, 3.0),
    "arabic": Band(0.4, 6.0, 0.80, 2.5),
    "hebrew": Band(0.4, 6.0, 0.80, 2.5),
    "indic": Band(0.2, 6.0, 0.95, 2.5),
    "cjk": Band(0.2, 4.0, 0.90, 2.5),
    "other": Band(0.2, 12.0, 0.95, 2.5),
}
#: First and last code points of the scripts told apart, after Unicode's blocks; what is below 0x250 is Latin.
SCRIPTS = (
    ("greek", 0x370, 0x3FF),
    ("cyrillic", 0x400, 0x52F),
    ("hebrew", 0x590, 0x5FF),
    ("arabic", 0x600, 0x77F),
    ("indic", 0x900, 0xDFF),
    ("cjk", 0x2E80, 0x9FFF),
    ("cjk", 0xAC00, 0xD7AF),
    ("latin", 0x1E00, 0x1EFF),
)
FAR = re.compile("[^\x00-ɏ]+")


def script_of(text: str, letters: int) -> str:
    """The script of most word characters; ties go to the first by name."""
    far = "".join(FAR.findall(text))
    if 2 * len(far) < letters or not letters:
        return "latin"
    found: Counter[str] = Counter({"latin": letters - len(far)})
    points, n = np.unique(np.frombuffer(far.encode("utf-32-le", "replace"), dtype=np.uint32), return_counts=True)
    for p, k in zip(points.tolist(), n.tolist(), strict=True):
        found[next((s for s, a, b in SCRIPTS if a <= p <= b), "other")] += k
    return min(found, key=lambda s: (-found[s], s))


def repeated(ids: np.ndarray, n: int = 5) -> int:
    """Words inside windows of n that occur twice or more, their first occurrence included.

    Windows are ranked exactly by pairing ranks (1, 2, 4 words, ...), not hashed.
    """
    if len(ids) < n + 1:
        return 0
    rank, width = ids.astype(np.int64), 1
    while width < n:
        step = min(width, n - width)
        top = int(rank.max()) + 1
        _, rank = np.unique(rank[: len(rank) - step] * top + rank[step:], return_inverse=True)
        width += step
    count = np.bincount(rank)
    hot = count[rank] > 1
    if not hot.any():
        return 0
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, np.flatnonzero(hot), 1)
    np.add.at(edge, np.flatnonzero(hot) + n, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


class Pieces:
    """Token ids of white-space words under a sentencepiece model, kept for the words seen last."""

    def __init__(self, model: str, most: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = self.sp.get_piece_size()
        self.is_byte = np.array([self.sp.is_byte(i) for i in range(self.size)])
        self.known: dict[bytes, bytes] = {}
        self.most = most

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > self.most:
            self.known.clear()
        new = list(words.difference(self.known))
        if new:
            for w, ids in zip(new, self.sp.encode([x.decode("utf-8", "replace") for x in new], num_threads=1), strict=True):
                self.known[w] = np.array(ids, dtype=np.uint16 if self.size <= 65536 else np.uint32).tobytes()

    def __call__(self, words: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype=np.uint16 if self.size <= 65536 else np.uint32)


def measure(text: bytes | None, pieces: Pieces, bands: dict[str, Band]) -> tuple:
    text = text or b""
    words = text.split()
    if not words:
        return (0, 0, sum(map(text.count, (bytes([c]) for c in SYMBOLS))), 0, 0, True, False, "latin", 0, None, None, None)
    whole = text.decode("utf-8", "replace")
    word_chars = len(whole) - sum(map(text.count, (bytes([c]) for c in SPACE)))
    symbols = sum(map(text.count, (bytes([c]) for c in SYMBOLS)))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    local: dict[bytes, int] = {}
    ids = np.fromiter((local.setdefault(w, len(local)) for w in words), dtype=np.int64, count=len(words))
    repeats = repeated(ids)
    failed = len(words) < 10 or 100 * repeats > 20 * len(words)
    tokens = pieces(words)
    n = len(tokens)
    count = np.bincount(tokens)
    count = count[count > 0]
    per_token = word_chars / n if n else 0.0
    share = float(pieces.is_byte[tokens].mean()) if n else 0.0
    entropy = float(np.log2(n) - (count * np.log2(count)).sum() / n) if n else 0.0
    script = script_of(whole, word_chars)
    band = bands.get(script, bands["other"])
    normal = band.low <= per_token <= band.high and share <= band.byte_share and (n < band.entropy_from or entropy >= band.entropy)
    return (len(words), word_chars, symbols, len(lines) - len(set(lines)), repeats, failed, bool(not failed and normal), script, n, per_token, share, entropy)


def measured(rows: DataFrame, model: str, used: dict[str, Band]) -> DataFrame:
    """The measures of rows (doc_id, text); kept is by base rules and bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = held("quality", "pieces", lambda: Pieces(model), model)
        for ids, texts in slices(batches):
            pieces.learn({w for t in texts if t for w in t.split()})
            found = [measure(t, pieces, used) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True), KINDS, strict=True))], names=NAMES)

    return on_batches(rows, run, SCHEMA)


def fences(normal: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """By keys, the weight of what was measured, and the fences of each measure."""
    sides = []
    for c in FENCED:
        low, mid, high = (F.percentile(F.round(c, 3), F.lit(q)) for q in (0.25, 0.5, 0.75))
        far = FENCE * F.greatest(high - low, LEAST_SPREAD * mid)
        sides += [(low - far).alias(f"{prefix}_{c}_low"), (high + far).alias(f"{prefix}_{c}_high")]
    return normal.groupBy(*keys).agg((F.count("*") / (F.count("*") + HALF)).alias(f"{prefix}_weight"), *sides)


def fenced(found: DataFrame, bands: dict[str, Band]) -> DataFrame:
    """found (kept already) with kept only inside the fences of the script and of half an octave of tokens."""
    octave = F.floor(2 * F.log2("n_pieces")).cast("int").alias("octave")
    normal = found.filter("kept").select("script", "n_pieces", octave, "chars_per_token", "token_entropy").distinct()
    both = found.withColumn("octave", octave)
    for keys, prefix in ((["script", "octave"], "own"), (["script"], "all")):
        both = both.join(F.broadcast(fences(normal, keys, prefix)), keys, "left")

    def of_band(value: Callable[[Band], float]) -> Column:
        known = F.create_map(*(x for s, b in bands.items() for x in (F.lit(s), F.lit(float(value(b))))))
        return F.coalesce(F.element_at(known, F.col("script")), F.lit(float(value(bands["other"]))))

    outer = {"chars_per_token_low": of_band(lambda b: b.low), "chars_per_token_high": of_band(lambda b: b.high), "token_entropy_low": F.when(F.col("n_pieces") < of_band(lambda b: b.entropy_from), 0.0).otherwise(of_band(lambda b: b.entropy)), "token_entropy_high": F.lit(MOST_BITS)}
    mixed = {}
    for side, band in outer.items():
        mixed[side] = band
        for prefix in ("all", "own"):
            w = F.col(f"{prefix}_weight")
            mixed[side] = F.coalesce(w * F.col(f"{prefix}_{side}") + (1 - w) * mixed[side], mixed[side])
    inside = F.lit(True)
    for c in FENCED:
        inside &= F.coalesce(F.col(c).between(mixed[f"{c}_low"], mixed[f"{c}_high"]), F.lit(True))
    return both.withColumn("kept", F.col("kept") & inside).select(*NAMES)


def quality_rules(docs: DataFrame, model: str, bands: dict[str, Band] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with its counts, its fertility and whether it is kept.

    model: the file of a sentencepiece vocabulary, at the same place on every worker.
    """
    used = BANDS | (bands or {})
    return fenced(cut(measured(id_bytes(docs, id_col, text_col), model, used)), used)


def quality_filter(docs: DataFrame, model: str, bands: dict[str, Band] | None = None, text_col: str = "text") -> DataFrame:
    """docs without the rows that quality_rules doesn't keep, all columns as they are.

    A text alone says whether its row is kept, so rows are taken away by the text's hash.
    """
    key = F.xxhash64(F.col(text_col).cast("string"))
    used = BANDS | (bands or {})
    found = fenced(cut(measured(docs.select(key.alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text")), model, used)), used)
    (name,) = free_names(docs, "key")
    gone = cut(found.filter("not kept").select(F.col("doc_id").alias(name)).distinct())
    return without(docs.withColumn(name, key), gone, [name]).select(*quoted(docs))


FENCED = ("chars_per_token", "token_entropy")
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
KINDS = [{"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")][1:]
