"""Token counts by a dictionary of pre-tokens.

Pre-tokens are the tokeniser's own (see word_tokens). Their distinct forms are found
over the corpus; each is tokenised once and gives a number of pieces. A document's
count is the sum of those numbers over its pre-tokens: by a table in the workers for
frequent ones, by a join for the others (see dictionary). Ids are never made for a
document.

Defined cases: a null text is empty and has 0 tokens; repeated rows each give a
row; a null id stays null; texts are counted whole; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import cut, held, id_bytes, on_batches
from quarry.llm.dictionary import summed, word_counts
from quarry.llm.word_tokens import PreTokens, TermsOf

#: Bytes of pre-tokens that are sent to every worker at most.
MOST_SENT = 72_000_000


def pre_tokens(path: str) -> TermsOf:
    """Splits texts into pre-tokens; one for each worker process."""
    return held("counts", "pre", lambda: PreTokens(path), path).terms


def pieces(words: DataFrame, tokenizer: str) -> DataFrame:
    """(word, n, a, b): b is the number of the pre-token's tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = PreTokens(tokenizer)
        for batch in batches:
            b = [len(tokens.ids(x.decode())) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(b))), pa.array(b, pa.int64())], names=["word", "n", "a", "b"])

    return on_batches(words, run, "word binary, n long, a double, b long")


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048, most_sent: int = MOST_SENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit for every document.

    tokenizer: a tokeniser file, at the same place on every worker, to which word_tokens applies.
    """
    rows = id_bytes(docs, id_col, text_col)
    split = lambda: pre_tokens(tokenizer)
    values = cut(pieces(word_counts(rows, split), tokenizer))
    size = lambda _, texts: [pc.binary_length(texts).fill_null(0)]
    found = summed(rows, split, values, most_sent, size, "n_bytes long", ("a", "n_tokens"))
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
