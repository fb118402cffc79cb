"""Runs operators over ten corpora in one session, in a process of its own: again.py MASTER."""

import collections
import math
import os
import sys
import zlib

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import public_tokenizers as P  # noqa: E402
from conftest import prose  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from quarry.llm.lm_scoring import lm_scoring  # noqa: E402
from quarry.llm.token_counts import token_counts  # noqa: E402

spark = SparkSession.builder.master(sys.argv[1]).config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.python.worker.reuse", "true").getOrCreate()
path = P.path("word_bpe_49k.json")
tokenizer = Tokenizer.from_file(path)
for c in range(10):
    words = [f"{a}{b}{c}x" if c % 2 else f"{b}{'lmnopqrstu'[c]}{a}" for a in "abcdefgh" for b in "ijklmnop"]
    rows = [(i, prose(1000 * c + i, 30, words)) for i in range(120)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r.doc_id: r.n_tokens for r in token_counts(d, path).collect()} == want, c
    seen = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in [*t.lower().split(), " "])
    total = sum(seen.values()) + len(seen) + 1
    base = {i: sum(math.log10((seen[w] + 1) / total) for w in [*t.lower().split(), " "]) for i, t in rows}
    for r in lm_scoring(d, F.crc32(F.col("doc_id").cast("string")) % 7 == 2).collect():
        assert abs(r.base_score - base[r.doc_id]) < 1e-6, (c, r)
print("10 corpora right")
