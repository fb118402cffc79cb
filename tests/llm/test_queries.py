"""The registered queries over the smallest tables, those with SQL against DuckDB."""

import glob
import os

import duckdb
import pytest

from quarry.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
#: What the contracts ask for; op4 and op8 have none.
COLUMNS = {
    "op1": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op2": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op3": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
    "op5": {"conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"},
    "op6": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op7": {"doc_id", "held_out", "lang_pred", "score"},
    "op9": {"doc_id", "n_shingles", "component_id"},
    "op10": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op11": {"page_id", "url", "text", "n_chars"},
    "op12": {"word", "form", "root", "n", "n_near", "form_n"},
    "op13": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
}


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, DATA)
    assert COLUMNS.get(name.split("_")[0], set()) <= set(df.columns)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(str, r)) for r in df.select(cols).collect())
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    if name in ORACLE_SQL:
        assert rows == sorted(tuple(map(str, r)) for r in con.sql(f"select {', '.join(cols)} from ({ORACLE_SQL[name]})").fetchall())
    elif name != "op2_packing":
        assert len(rows) == con.sql(f"select count(*) from {'pages' if name.startswith('op11') else 'documents'}").fetchall()[0][0]


def test_all_are_registered():
    import __spark_entry__

    assert {f"op{n}" for n in range(1, 14)} | {"pipeline"} <= {name.split("_")[0] for name in __spark_entry__.queries()}
